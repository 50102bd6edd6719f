"""Registered queries of the reference operators over the adapter views, with the DuckDB SQL each is checked against.

Every double is rounded to six decimals on both sides. Names begin with the operator they show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import as_column, clip, clip01, finite, hash_split, norm2, quadrant, r6, soft_weights, unit_rows
from ..operators import features, interpretation, joins, neighbors, profiles, retrieval, statistics
from ..operators import audit, clustering, dataset, micro, selection, strategies
from ..sources.tables import stored
from .adapters import SONG, TRACKS, song, table, tracks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Those columns, doubles to six decimals."""
    types = dict(df.dtypes)
    return df.select(*((r6(c) if types[c] == "double" else F.col(c)).alias(c) for c in columns))


def r(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def rs(*columns: str) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


# ---------------------------------------------------------------- projections and features

GEO = f"""{TRACKS}, g0 AS (SELECT *, has_audio AND has_lyrics AS b, av - 0.5 AS pv, aa - 0.5 AS pa, lv - 0.5 AS qv, la - 0.5 AS qa FROM t),
g1 AS (SELECT *, sqrt(pv*pv + pa*pa) AS ra, sqrt(qv*qv + qa*qa) AS rl, pv*qv + pa*qa AS dot, pv*qa - pa*qv AS det, sqrt((av-lv)*(av-lv) + (aa-la)*(aa-la)) / sqrt(2) AS gp FROM g0),
g AS (SELECT *, CASE WHEN b THEN (av + lv) / 2 WHEN has_audio THEN av WHEN has_lyrics THEN lv ELSE 0.5 END AS con_v,
 CASE WHEN b THEN (aa + la) / 2 WHEN has_audio THEN aa WHEN has_lyrics THEN la ELSE 0.5 END AS con_a,
 CASE WHEN b THEN av - lv ELSE 0.0 END::DOUBLE AS d_v, CASE WHEN b THEN aa - la ELSE 0.0 END::DOUBLE AS d_a, CASE WHEN b THEN abs(av - lv) ELSE 0.0 END::DOUBLE AS abs_v,
 CASE WHEN b THEN abs(aa - la) ELSE 0.0 END::DOUBLE AS abs_a, CASE WHEN b THEN gp ELSE 0.0 END::DOUBLE AS gap, CASE WHEN b THEN (abs(av - lv) + abs(aa - la)) / 2 ELSE 0.0 END::DOUBLE AS mean_abs,
 CASE WHEN b THEN least(1.0, greatest(-1.0, dot / greatest(ra * rl, 1e-6))) ELSE 0.0 END::DOUBLE AS cosine, CASE WHEN b THEN atan2(det, dot) / pi() ELSE 0.0 END::DOUBLE AS angle,
 CASE WHEN b THEN ra ELSE 0.0 END::DOUBLE AS radius_audio, CASE WHEN b THEN rl ELSE 0.0 END::DOUBLE AS radius_lyrics, CASE WHEN b THEN abs(ra - rl) ELSE 0.0 END::DOUBLE AS radius_gap,
 CASE WHEN b THEN exp(-0.5 * (gp / 0.35) * (gp / 0.35)) ELSE 0.0 END::DOUBLE AS agreement FROM g1)"""


@query("f01_geometry", f"WITH {GEO} SELECT track_id, {rs(*features.GEOMETRY)} FROM g")
def f01(spark, d):
    return rounded(features.geometry(tracks(spark, d), mask_columns=False), "track_id", *features.GEOMETRY)


@query("f04_geometry_with_masks", f"WITH {GEO} SELECT track_id, {rs(*features.GEOMETRY)}, b::INT::DOUBLE AS m_both, has_audio::INT::DOUBLE AS m_audio, has_lyrics::INT::DOUBLE AS m_lyrics FROM g")
def f04(spark, d):
    return rounded(features.geometry(tracks(spark, d)), "track_id", *features.GEOMETRY, "m_both", "m_audio", "m_lyrics")


@query("f05_balanced_difference", f"WITH {GEO} SELECT track_id, {rs('con_v', 'con_a', 'd_v', 'd_a', 'gap')}, {r('angle')} AS angular_gap, {r('radius_gap')} AS radial_gap, {r('agreement')} AS agreement FROM g")
def f05(spark, d):
    return rounded(features.balanced_difference(tracks(spark, d)), "track_id", "con_v", "con_a", "d_v", "d_a", "gap", "angular_gap", "radial_gap", "agreement")


_SOFT = ", ".join(f"exp(-(({v}-{x})*({v}-{x}) + ({a}-{y})*({a}-{y})) / 0.08) AS {n}{i}" for n, v, a in (("p", "av", "aa"), ("q", "lv", "la")) for i, (x, y) in enumerate(features.SOFT_CENTRES))
_PAIRS = ", ".join(f"{r(f'CASE WHEN b THEN p{i} / (p0+p1+p2+p3) * (q{j} / (q0+q1+q2+q3)) ELSE 0.0 END')} AS q{i}{j}" for i in range(4) for j in range(4))


@query("f13_difference_geometry", f"WITH {GEO}, h AS (SELECT *, {_SOFT} FROM g) SELECT track_id, {rs('con_v', 'con_a', 'd_v', 'd_a', 'abs_v', 'abs_a', 'gap', 'angle', 'radius_gap')}, {_PAIRS}, {r('CASE WHEN b THEN 1 / (1 + exp(-5 * (gap - 0.2))) ELSE 0.0 END')} AS conflict FROM h")
def f13(spark, d):
    names = [f"q{i}{j}" for i in range(4) for j in range(4)]
    return rounded(features.difference_geometry(tracks(spark, d)), "track_id", "con_v", "con_a", "d_v", "d_a", "abs_v", "abs_a", "gap", "angle", "radius_gap", *names, "conflict")


CAL = f"""{TRACKS}, bias AS (SELECT CASE WHEN count(*) < 2 THEN 0.0 ELSE quantile_cont(lv - av, 0.5) END AS bias_v, CASE WHEN count(*) < 2 THEN 0.0 ELSE quantile_cont(la - aa, 0.5) END AS bias_a FROM t WHERE has_audio AND has_lyrics),
cal AS (SELECT t.*, bias_v, bias_a, has_audio AND has_lyrics AS b, av + bias_v / 2 AS av_cal, aa + bias_a / 2 AS aa_cal, lv - bias_v / 2 AS lv_cal, la - bias_a / 2 AS la_cal FROM t, bias)"""


@query("a03_f07_calibrated_views", f"WITH {CAL} SELECT track_id, {rs('bias_v', 'bias_a', 'av_cal', 'aa_cal', 'lv_cal', 'la_cal')} FROM cal")
def a03(spark, d):
    return rounded(features.calibrated(tracks(spark, d)), "track_id", "bias_v", "bias_a", "av_cal", "aa_cal", "lv_cal", "la_cal")


@query(
    "f06_calibrated_tension",
    f"""WITH {CAL}, raw AS (SELECT *, CASE WHEN b THEN (av_cal + lv_cal) / 2 WHEN has_audio THEN av_cal WHEN has_lyrics THEN lv_cal ELSE 0.5 END AS con_v,
 CASE WHEN b THEN (aa_cal + la_cal) / 2 WHEN has_audio THEN aa_cal WHEN has_lyrics THEN la_cal ELSE 0.5 END AS con_a,
 CASE WHEN b THEN lv_cal - av_cal ELSE 0.0 END::DOUBLE AS raw_v, CASE WHEN b THEN la_cal - aa_cal ELSE 0.0 END::DOUBLE AS raw_a FROM cal),
 sg AS (SELECT (quantile_cont(raw_v, 0.75) - quantile_cont(raw_v, 0.25)) / 1.349 AS sv, (quantile_cont(raw_a, 0.75) - quantile_cont(raw_a, 0.25)) / 1.349 AS sa FROM raw WHERE b),
 z AS (SELECT raw.*, least(3.0, greatest(-3.0, raw_v / CASE WHEN sv > 1e-6 THEN sv ELSE 1.0 END)) AS ten_v, least(3.0, greatest(-3.0, raw_a / CASE WHEN sa > 1e-6 THEN sa ELSE 1.0 END)) AS ten_a FROM raw, sg)
 SELECT track_id, {rs('con_v', 'con_a', 'ten_v', 'ten_a')}, {r('sqrt(ten_v*ten_v + ten_a*ten_a)')} AS ten_norm FROM z""",
)
def f06(spark, d):
    return rounded(features.tension(tracks(spark, d)), "track_id", "con_v", "con_a", "ten_v", "ten_a", "ten_norm")


@query("f08_alpha_grid", f"SELECT {r('(50 + 5 * i) / 100.0')}::DOUBLE AS alpha FROM (SELECT unnest(range(0, 9)) AS i)")
def f08(spark, d):
    return spark.range(0, 9).select(r6((50 + 5 * F.col("id")) / 100).alias("alpha"))


@query("f09_balanced_consensus", f"WITH {TRACKS} SELECT track_id, {', '.join(r(f'CASE WHEN has_audio AND has_lyrics THEN {a} * 0.75 + {l} * 0.25 WHEN has_audio THEN {a} WHEN has_lyrics THEN {l} ELSE 0.5 END') + f' AS {n}' for n, a, l in (('con_v', 'av', 'lv'), ('con_a', 'aa', 'la')))} FROM t")
def f09(spark, d):
    t = tracks(spark, d)
    for n, a, l in (("con_v", "av", "lv"), ("con_a", "aa", "la")):
        t = t.withColumn(n, features.balanced(F.col(a), F.col(l), F.col("has_audio"), F.col("has_lyrics"), 0.75))
    return rounded(t, "track_id", "con_v", "con_a")


@query("f16_f30_masked_mean", f"WITH {SONG} SELECT track_id, {rs('bv', 'ba')} FROM s")
def f30(spark, d):
    t = tracks(spark, d)
    for n, a, l in (("bv", "av", "lv"), ("ba", "aa", "la")):
        t = t.withColumn(n, features.masked_mean(F.col(a), F.col(l), F.col("has_audio"), F.col("has_lyrics")))
    return rounded(t, "track_id", "bv", "ba")


@query("f15_two_view_features", f"WITH {TRACKS} SELECT track_id, {rs('av', 'aa', 'lv', 'la')} FROM t WHERE has_audio OR has_lyrics")
def f15(spark, d):
    return rounded(tracks(spark, d).filter("has_audio or has_lyrics"), "track_id", "av", "aa", "lv", "la")


@query("a01_f21_scaled_view", f"WITH {TRACKS}, st AS (SELECT avg(av) mv, stddev_pop(av) sv, avg(aa) ma, stddev_pop(aa) sa FROM t WHERE has_audio) SELECT track_id, {r('CASE WHEN has_audio THEN (av - mv) / CASE WHEN sv < 1e-6 THEN 1 ELSE sv END ELSE 0.0 END')} AS av_z, {r('CASE WHEN has_audio THEN (aa - ma) / CASE WHEN sa < 1e-6 THEN 1 ELSE sa END ELSE 0.0 END')} AS aa_z FROM t, st")
def a01(spark, d):
    return rounded(features.scaled(tracks(spark, d), ["av", "aa"], "has_audio"), "track_id", "av_z", "aa_z")


@query("f17_tfidf_binary", f"""WITH rows AS (SELECT DISTINCT p_partkey AS idx, unnest(string_split(p_name, ' ')) AS token FROM part), n AS (SELECT count(DISTINCT idx) AS n FROM rows),
 df AS (SELECT token, count(*) AS df FROM rows GROUP BY token ORDER BY df DESC, token LIMIT 40), w AS (SELECT idx, token, ln((1 + n) / (1 + df)) + 1 AS w FROM rows JOIN df USING (token), n)
 SELECT idx, token, {r('w / sqrt(sum(w * w) OVER (PARTITION BY idx))')} AS weight FROM w""")
def f17(spark, d):
    rows = features.token_rows(table(spark, d, "part").withColumnRenamed("p_partkey", "idx"), "idx", F.split("p_name", " ")).distinct()
    return rounded(features.tfidf(rows, "idx", features.vocabulary(rows, "idx", 40)), "idx", "token", "weight")


@query("f18_tfidf_counts", f"""WITH rows AS (SELECT p_partkey AS idx, unnest(string_split(p_name || ' ' || p_name || ' ' || p_type, ' ')) AS token FROM part), n AS (SELECT count(DISTINCT idx) AS n FROM rows),
 tf AS (SELECT token, count(*) AS f FROM rows GROUP BY token HAVING count(*) >= 3 ORDER BY f DESC, token LIMIT 128), c AS (SELECT idx, token, count(*) AS k FROM rows JOIN tf USING (token) GROUP BY idx, token),
 df AS (SELECT token, count(*) AS df FROM c GROUP BY token), w AS (SELECT idx, token, k * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN df USING (token), n) SELECT idx, token, {r('w / sqrt(sum(w * w) OVER (PARTITION BY idx))')} AS weight FROM w""")
def f18(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "idx")
    rows = features.token_rows(p, "idx", F.split(F.concat_ws(" ", "p_name", "p_name", "p_type"), " "))
    return rounded(features.tfidf(rows, "idx", features.vocabulary(rows, "idx", 128, 3, False), binary=False), "idx", "token", "weight")


def _skew(c: str) -> str:
    return f"CASE WHEN n_{c} > 2 AND m3_{c} / power(m2_{c}, 1.5) * sqrt(n_{c} * (n_{c} - 1)) / (n_{c} - 2) > 1 THEN ln(1 + {c}) ELSE {c} END"


@query("f19_numeric_block", f"""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice::DOUBLE AS p_retailprice FROM part), st AS (SELECT {', '.join(f'count({c})::DOUBLE AS n_{c}, avg({c}) AS a_{c}' for c in ('p_size', 'p_retailprice'))} FROM p),
 m AS (SELECT {', '.join(f'avg(power({c} - a_{c}, 3)) AS m3_{c}, avg(power({c} - a_{c}, 2)) AS m2_{c}' for c in ('p_size', 'p_retailprice'))} FROM p, st)
 SELECT p_partkey, {', '.join(f'{r(_skew(c))} AS {c}_num' for c in ('p_size', 'p_retailprice'))} FROM p, st, m""")
def f19(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return rounded(features.numeric_block(p, ["p_size", "p_retailprice"]), "p_partkey", "p_size_num", "p_retailprice_num")


@query("f19_tempo_bins", "SELECT l_orderkey, l_linenumber, (q < 80)::INT AS q_bin0, (q >= 80 AND q < 120)::INT AS q_bin1, (q >= 120 AND q < 160)::INT AS q_bin2, (q >= 160)::INT AS q_bin3 FROM (SELECT *, l_quantity::DOUBLE * 4 AS q FROM lineitem)")
def f19b(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("double") * 4).alias("q"))
    return t.select("l_orderkey", "l_linenumber", *features.tempo_bins("q"))


@query("f31_tension_matrix", f"WITH {SONG} SELECT track_id, {rs('dv', 'da', 'norm')} FROM s")
def f31(spark, d):
    rows, _ = micro.tension_rows(song(spark, d))
    return rows.select("track_id", *(r6(f"t_{c}").alias(c) for c in ("dv", "da", "norm")))


@query("f33_view_with_mean", f"WITH {SONG} SELECT track_id, {r('CASE WHEN has_audio THEN av ELSE bv END')} AS view_v, {r('CASE WHEN has_audio THEN aa ELSE ba END')} AS view_a FROM s")
def f33(spark, d):
    of = strategies.build(tracks(spark, d), "audio_va")
    return of.df.select("track_id", r6("f0").alias("view_v"), r6("f1").alias("view_a"))


@query("pf07_quadrants", f"WITH {TRACKS} SELECT track_id, CASE WHEN NOT has_audio THEN -1 WHEN av >= 0.5 AND aa >= 0.5 THEN 0 WHEN av < 0.5 AND aa >= 0.5 THEN 1 WHEN av < 0.5 THEN 2 ELSE 3 END AS label, CASE WHEN abs(av - 0.5) < 0.05 OR abs(aa - 0.5) < 0.05 THEN -1 WHEN av >= 0.5 AND aa >= 0.5 THEN 0 WHEN av < 0.5 AND aa >= 0.5 THEN 1 WHEN av < 0.5 THEN 2 ELSE 3 END AS strict FROM t")
def pf07(spark, d):
    return tracks(spark, d).select("track_id", quadrant("av", "aa", F.col("has_audio")).alias("label"), quadrant("av", "aa", margin=0.05).alias("strict"))


@query("pf05_stack_views", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice::DOUBLE END AS v, o_orderkey % 5 <> 0 AS observed FROM orders")
def pf05(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("double").cast("string"))
    t = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return t.select("o_orderkey", F.coalesce(finite("raw"), F.lit(0.0)).alias("v"), finite("raw").isNotNull().alias("observed"))


@query("pf08_pf09_labels", f"""WITH {SONG}, l AS (SELECT *, CASE WHEN idx % 3 = 0 THEN 'Q' || (idx % 5) WHEN idx % 3 = 1 THEN (idx % 6)::VARCHAR END AS raw FROM s),
 x AS (SELECT *, CASE WHEN raw IN ('Q1', '1') THEN 0 WHEN raw IN ('Q2', '2') THEN 1 WHEN raw IN ('Q3', '3') THEN 2 WHEN raw IN ('Q4', '4') THEN 3 WHEN raw = '0' THEN 0 ELSE -1 END AS given,
 CASE WHEN idx % 4 = 0 THEN -1 WHEN ov >= 0.5 AND oa >= 0.5 THEN 0 WHEN ov < 0.5 AND oa >= 0.5 THEN 1 WHEN ov < 0.5 THEN 2 ELSE 3 END AS original, CASE WHEN NOT (has_audio OR has_lyrics) THEN -1 WHEN bv >= 0.5 AND ba >= 0.5 THEN 0 WHEN bv < 0.5 AND ba >= 0.5 THEN 1 WHEN bv < 0.5 THEN 2 ELSE 3 END AS mean FROM l)
 SELECT track_id, CASE WHEN given >= 0 THEN given WHEN original >= 0 THEN original ELSE mean END AS label, CASE WHEN given >= 0 THEN 'explicit' WHEN original >= 0 THEN 'original' WHEN mean >= 0 THEN 'mean' ELSE 'none' END AS origin FROM x""")
def pf09(spark, d):
    t = song(spark, d)
    raw = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("Q"), F.col("idx") % 5)).when(F.col("idx") % 3 == 1, (F.col("idx") % 6).cast("string"))
    given, original = X.label_number(raw), quadrant("ov", "oa", F.col("idx") % 4 != 0)
    mean = quadrant("bv", "ba", F.col("has_audio") | F.col("has_lyrics"))
    origin = F.when(given >= 0, "explicit").when(original >= 0, "original").when(mean >= 0, "mean").otherwise("none")
    return t.select("track_id", F.when(given >= 0, given).when(original >= 0, original).otherwise(mean).alias("label"), origin.alias("origin"))


@query("pf12_both_views", f"WITH {TRACKS} SELECT track_id FROM t WHERE has_audio AND has_lyrics")
def pf12(spark, d):
    return dataset.both_views(tracks(spark, d))[0].select("track_id")


@query("pf14_source_filter", "SELECT page_id, NOT regexp_matches(lower('name ' || url), 'genius|lyrics|reddit|youtube|amazon|spotify|forum|blogspot') AS allowed FROM pages")
def pf14(spark, d):
    return table(spark, d, "pages").select("page_id", retrieval.source_allowed(F.lit("name"), F.col("url")).alias("allowed"))


@query("pf17_block_policy", f"WITH {TRACKS}, m AS (SELECT track_id, has_audio OR has_lyrics AS c, has_audio AND has_lyrics AS ten, idx % 2 = 0 AS meta FROM t) SELECT track_id, c OR NOT ten AS consensus, ten AS tension, false AS metadata FROM m")
def pf17(spark, d):
    audio, lyrics = F.col("has_audio"), F.col("has_lyrics")
    masks = strategies.without_blocks([audio | lyrics, audio & lyrics, F.col("idx") % 2 == 0], metadata_weight=0.0)
    return tracks(spark, d).select("track_id", *(m.alias(n) for n, m in zip(("consensus", "tension", "metadata"), masks)))


@query("a12_mask_patterns", f"WITH {TRACKS} SELECT track_id, has_audio::INT::VARCHAR || has_lyrics::INT::VARCHAR AS pattern FROM t")
def a12(spark, d):
    return tracks(spark, d).select("track_id", F.concat(F.col("has_audio").cast("int"), F.col("has_lyrics").cast("int")).alias("pattern"))


@query("s08_hash_split", "SELECT track, CASE WHEN h < 0.70 THEN 'train' WHEN h < 0.85 THEN 'val' ELSE 'test' END AS split FROM (SELECT 't' || vec_id AS track, ('0x' || substr(sha256('t' || vec_id || '|42'), 1, 12))::BIGINT / 281474976710656.0 AS h FROM embeddings)")
def s08(spark, d):
    t = tracks(spark, d).select(F.col("track_id").alias("track"))
    return t.withColumn("split", hash_split("track", 42))


# ---------------------------------------------------------------- text functions


@query("s01_s06_text_forms", r"""SELECT p_partkey, regexp_replace(lower(trim(p_type)), '[ \-/]', '_', 'g') AS name_form, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS free, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || '_' || p_type || ' (x)'), '[_-]+', ' ', 'g'), '[^a-z0-9&/,\s]', '', 'g'), '\s+', ' ', 'g')) AS lookup,
 list_filter(list_transform(string_split(replace(p_name, ' ', ' , '), ','), lambda x: trim(lower(x))), lambda x: x <> '') AS tokens, trim(regexp_replace(lower(p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def s01(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.column_name("p_type").alias("name_form"), X.free_text("p_name").alias("free"), X.lookup_text(F.concat("p_brand", F.lit("_"), "p_type", F.lit(" (x)"))).alias("lookup"), X.token_list(F.replace("p_name", F.lit(" "), F.lit(" , "))).alias("tokens"), X.slug(F.concat("p_type", F.lit("!"))).alias("slug"))


@query("s07_weight_lists", "SELECT p_partkey, string_split(p_name, ' ') AS tokens, list_transform(range(1, len(string_split(p_name, ' ')) + 1), lambda i: coalesce(try_cast(string_split(p_size || ',x', ',')[i] AS DOUBLE), 1.0)) AS weights FROM part")
def s07(spark, d):
    tokens = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", tokens.alias("tokens"), X.weight_list(F.concat(F.col("p_size"), F.lit(",x")), tokens).alias("weights"))


@query("s13_s14_numbers_in_text", r"""SELECT p_partkey, coalesce(nullif(regexp_extract(p_brand, 'C?\s*([0-3])\b', 1), '')::INT, NULL) AS cluster, coalesce(try_cast(nullif(regexp_extract(p_brand, '-?\d+', 0), '') AS BIGINT), 2147483647) AS first FROM part""")
def s13(spark, d):
    return table(spark, d, "part").select("p_partkey", X.cluster_number("p_brand").alias("cluster"), X.first_integer("p_brand").alias("first"))


@query("s16_s18_flags", "SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AS truthy, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE trim(o_orderpriority) END AS shown FROM orders")
def s16(spark, d):
    o = table(spark, d, "orders")
    said = F.when(F.col("o_orderkey") % 3 == 0, " Yes").when(F.col("o_orderkey") % 3 == 1, "1").otherwise("off")
    return o.select("o_orderkey", X.truthy(said).alias("truthy"), X.report_text(F.when(F.col("o_orderkey") % 2 == 0, "NaN").otherwise(F.col("o_orderpriority"))).alias("shown"))


@query("s19_s22_names_and_pairs", f"WITH {SONG} SELECT track_id, 'Moods' AS field, tension_name AS token, cluster_id AS macro, (label // 4)::INT AS micro, CASE WHEN has_audio THEN printf('%.4f,%.4f', av, aa) ELSE '' END AS pair, printf('%.1f%%', 100 * av) AS share FROM s")
def s19(spark, d):
    t = song(spark, d)
    field, token = X.feature_parts(F.concat(F.lit("Moods::"), "tension_name"))
    letter = F.substring(F.lit("abc"), F.floor(F.col("label") / 4).cast("int") + 1, F.lit(1))
    macro, micro, _ = X.macro_micro(F.concat(F.lit("M"), "cluster_id", F.lit("-"), letter))
    return t.select("track_id", field.alias("field"), token.alias("token"), macro.alias("macro"), micro.alias("micro"), X.va_pair(F.when(F.col("has_audio"), F.col("av")), F.col("aa")).alias("pair"), X.percent_text("av").alias("share"))


@query("s20_distinct_display", "SELECT p_partkey, list_slice(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), 1, 3) AS shown FROM (SELECT p_partkey, string_split(p_name || ' ' || upper(p_name), ' ') AS l FROM part)")
def s20(spark, d):
    return table(spark, d, "part").select("p_partkey", X.distinct_display(F.split(F.concat("p_name", F.lit(" "), F.upper("p_name")), " "), 3).alias("shown"))


_WORDS = ["the", "and", "that", "was"]


@query("s26_keyword_grades", f"SELECT doc_id, least(3, {' + '.join(f'contains(lower(text), $${w}$$)::INT' for w in _WORDS)}) AS grade, contains(text, chr(65533)) OR contains(text, chr(38175)) AS broken, regexp_matches(text, '(?i)\\b(the|and)\\b') AS plain FROM documents")
def s26(spark, d):
    return table(spark, d, "documents").select("doc_id", X.keyword_grade("text", _WORDS).alias("grade"), X.has_encoding_issue("text").alias("broken"), X.has_word(["the", "and"], "text").alias("plain"))


@query("s28_softmax_weights", f"WITH {SONG} SELECT track_id, {r('exp(-av*av/2) / (exp(-av*av/2) + exp(-aa*aa/2))')} AS w0, {r('exp(-aa*aa/2) / (exp(-av*av/2) + exp(-aa*aa/2))')} AS w1 FROM s")
def s28(spark, d):
    w = soft_weights("av", "aa")
    return tracks(spark, d).select("track_id", r6(w[0]).alias("w0"), r6(w[1]).alias("w1"))


@query("s30_row_length", f"WITH {TRACKS} SELECT track_id, {', '.join(r(f'{c} / sqrt(av*av + aa*aa + lv*lv + la*la)') + f' AS {c}' for c in ('av', 'aa', 'lv', 'la'))} FROM t")
def s30(spark, d):
    cs = ("av", "aa", "lv", "la")
    return tracks(spark, d).select("track_id", *(r6(u).alias(c) for c, u in zip(cs, unit_rows(*cs))))


@query("s11_s12_coerce_clip", "SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, l_discount::DOUBLE * 15 - 0.2)) AS clipped, CASE WHEN l_linenumber = 1 THEN 0.5 ELSE l_tax::DOUBLE END AS coerced FROM lineitem")
def s11(spark, d):
    t = table(spark, d, "lineitem")
    raw = F.when(F.col("l_linenumber") == 1, "inf?").otherwise(F.col("l_tax").cast("double").cast("string"))
    return t.select("l_orderkey", "l_linenumber", (clip(F.col("l_discount").cast("double") * 15 - 0.2, 0, 1)).alias("clipped"), F.coalesce(finite(raw), F.lit(0.5)).alias("coerced"))


# ---------------------------------------------------------------- joins


@query("j01_align_views", f"""WITH p AS (SELECT DISTINCT o_orderkey AS a, o_custkey AS l FROM orders), n AS (SELECT *, row_number() OVER (ORDER BY a, l) - 1 AS pair_index FROM p)
 SELECT a, l, pair_index, {r('o_totalprice::DOUBLE')} AS audio, {r('c_acctbal::DOUBLE')} AS lyrics FROM n JOIN orders ON o_orderkey = a JOIN customer ON c_custkey = l""")
def j01(spark, d):
    o = table(spark, d, "orders")
    pairs = joins.pair_index(o.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("l")).distinct(), "a", "l")
    audio = o.select(F.col("o_orderkey").alias("a"), r6(F.col("o_totalprice").cast("double")).alias("audio"))
    lyrics = table(spark, d, "customer").select(F.col("c_custkey").alias("l"), r6(F.col("c_acctbal").cast("double")).alias("lyrics"))
    return pairs.join(audio, "a").join(lyrics, "l").select("a", "l", "pair_index", "audio", "lyrics")


@query("j03_composite_left_join", "SELECT ps.idx, ps.kind, coalesce(nullif(trim(p_name), ''), p_brand) AS name, p_size FROM (SELECT vec_id AS idx, label % 2 AS kind FROM embeddings) ps LEFT JOIN part ON p_partkey = idx AND p_partkey % 2 = kind")
def j03(spark, d):
    left = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), (F.col("label") % 2).cast("bigint").alias("kind"))
    right = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("idx"), (F.col("p_partkey") % 2).cast("bigint").alias("kind"), "p_name", "p_brand", "p_size")
    out = joins.one_to_one(left, right, ["idx", "kind"])
    return out.select("idx", "kind", F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), "p_brand").alias("name"), "p_size")


@query("j04_w09_first_row_dedup", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def w09(spark, d):
    return joins.first_rows(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("j05_merge_fill", f"""WITH b AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE label END AS label, vec_id % 5 AS v FROM embeddings WHERE vec_id % 4 <> 0),
 a AS (SELECT vec_id AS id, label + (vec_id % 7 = 0)::INT AS label, label * 2 AS extra FROM embeddings WHERE vec_id % 6 <> 0)
 SELECT coalesce(b.id, a.id) AS id, b.v, coalesce(b.label, a.label) AS label, a.extra, coalesce(b.label <> a.label, false) AS conflict_label FROM b FULL JOIN a ON b.id = a.id""")
def j05(spark, d):
    e = table(spark, d, "embeddings")
    base = e.filter("vec_id % 4 <> 0").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("label"), (F.col("vec_id") % 5).alias("v"))
    addition = e.filter("vec_id % 6 <> 0").select(F.col("vec_id").alias("id"), (F.col("label") + (F.col("vec_id") % 7 == 0).cast("int")).alias("label"), (F.col("label") * 2).alias("extra"))
    return joins.merge_fill(base, addition, "id")


@query("j09_selected_and_missing", "SELECT c_custkey AS id, count(o_orderkey) AS orders, count(o_orderkey) = 0 AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j09(spark, d):
    chosen = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    have = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    missing = joins.missing_keys(chosen, have, "id").withColumn("orders", F.lit(0).cast("bigint")).withColumn("missing", F.lit(True))
    return chosen.join(have, "id").withColumn("missing", F.lit(False)).select("id", "orders", "missing").union(missing)


@query("j11_select_with_override", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'override' ELSE p_brand END AS p_brand, p_size FROM part WHERE p_partkey % 2 = 0")
def j11(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    chosen = p.filter("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "override").alias("p_brand"))
    return joins.select_rows(chosen, p, "p_partkey", ["p_brand"])


@query("j12_fallback_key", """WITH l AS (SELECT 'q' || (item_id % 3) AS q, item_id AS s FROM benchmark), ev AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'q' || (doc_id % 3) END AS q, doc_id % 40 AS s, quality AS grade, doc_id AS n FROM labels),
 last AS (SELECT q, s, arg_max(grade, n) AS grade FROM ev GROUP BY q, s) SELECT l.q, l.s, coalesce(e.grade, f.grade) AS grade FROM l LEFT JOIN last e ON e.q = l.q AND e.s = l.s AND e.q <> '' LEFT JOIN last f ON f.q = '' AND f.s = l.s""")
def j12(spark, d):
    left = table(spark, d, "benchmark").select(F.concat(F.lit("q"), F.col("item_id") % 3).alias("q"), F.col("item_id").alias("s"))
    ev = table(spark, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("q"), F.col("doc_id") % 3)).alias("q"), (F.col("doc_id") % 40).alias("s"), F.col("quality").alias("grade"), F.col("doc_id").alias("n"))
    return joins.with_fallback_key(left, ev, "q", "s", "grade").select("q", "s", "grade")


@query("j13_previous_split", "WITH n AS (SELECT vec_id, 't' || vec_id AS track, ('0x' || substr(sha256('t' || vec_id || '|42'), 1, 12))::BIGINT / 281474976710656.0 AS h FROM embeddings) SELECT track, CASE WHEN vec_id % 4 = 0 THEN 'test' WHEN h < 0.70 THEN 'train' WHEN h < 0.85 THEN 'val' ELSE 'test' END AS split FROM n")
def j13(spark, d):
    t = tracks(spark, d).select("idx", F.col("track_id").alias("track"))
    before = t.filter("idx % 4 = 0").select("track", F.lit("test").alias("old"))
    return joins.previous_split(t, before, "track", "old", hash_split("track", 42)).select("track", "split")


@query("j18_neighbour_purity", f"WITH {TRACKS}, p AS (SELECT a.idx, b.cluster_id = a.cluster_id AS same, row_number() OVER (PARTITION BY a.idx ORDER BY (a.av-b.av)*(a.av-b.av) + (a.aa-b.aa)*(a.aa-b.aa), b.idx) AS n FROM t a JOIN t b ON a.idx <> b.idx), e AS (SELECT idx, avg(same::INT) AS s FROM p WHERE n <= 20 GROUP BY idx) SELECT {r('avg(s)')} AS purity FROM e")
def j18(spark, d):
    return rounded(neighbors.label_purity(tracks(spark, d), ["av", "aa"], "cluster_id", 20), "purity")


@query("j16_impute_unobserved", f"WITH {SONG}, o AS (SELECT *, has_audio AND has_lyrics AS seen FROM s), p AS (SELECT a.idx, b.dv, b.da, row_number() OVER (PARTITION BY a.idx ORDER BY (a.bv-b.bv)*(a.bv-b.bv) + (a.ba-b.ba)*(a.ba-b.ba), b.idx) AS n FROM o a JOIN o b ON NOT a.seen AND b.seen), m AS (SELECT idx, avg(dv) AS dv, avg(da) AS da FROM p WHERE n <= 5 GROUP BY idx) SELECT o.idx, {r('CASE WHEN seen THEN o.dv ELSE m.dv END')} AS dv, {r('CASE WHEN seen THEN o.da ELSE m.da END')} AS da FROM o LEFT JOIN m ON m.idx = o.idx")
def j16(spark, d):
    t = song(spark, d).withColumn("seen", F.col("has_audio") & F.col("has_lyrics"))
    return rounded(neighbors.impute_unobserved(t, ["bv", "ba"], ["dv", "da"], "seen"), "idx", "dv", "da")


@query("j15_f12_neighbour_residual", f"WITH {SONG}, o AS (SELECT *, has_audio AND has_lyrics AS seen FROM s), p AS (SELECT a.idx, b.dv, b.da, row_number() OVER (PARTITION BY a.idx ORDER BY (a.bv-b.bv)*(a.bv-b.bv) + (a.ba-b.ba)*(a.ba-b.ba), b.idx) AS n FROM o a JOIN o b ON a.seen AND b.seen), m AS (SELECT idx, avg(dv) AS dv, avg(da) AS da FROM p WHERE n <= 101 GROUP BY idx) SELECT o.idx, {r('CASE WHEN seen THEN o.dv - m.dv ELSE 0.0 END')} AS dv_residual, {r('CASE WHEN seen THEN o.da - m.da ELSE 0.0 END')} AS da_residual FROM o LEFT JOIN m ON m.idx = o.idx")
def j15(spark, d):
    t = song(spark, d).withColumn("seen", F.col("has_audio") & F.col("has_lyrics"))
    return rounded(neighbors.residual(t, ["bv", "ba"], ["dv", "da"], "seen"), "idx", "dv_residual", "da_residual")


@query("j25_best_jaccard", f"WITH {TRACKS}, n AS (SELECT cluster_id AS a, label % 3 AS b, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb FROM n) SELECT a AS cluster_id, {r('max(n / (ra + rb - n))')} AS best FROM m GROUP BY a")
def j25(spark, d):
    return rounded(statistics.best_jaccard(tracks(spark, d).withColumn("other", F.col("label") % 3), "cluster_id", "other"), "cluster_id", "best")


# ---------------------------------------------------------------- aggregates and contingency metrics


@query("a04_a06_robust_scales", f"""WITH m AS (SELECT event_type, value::DOUBLE AS v, quantile_cont(value::DOUBLE, 0.5) OVER (PARTITION BY event_type) AS center FROM events), g AS (SELECT event_type, center, quantile_cont(abs(v - center), 0.5) AS mad, stddev_pop(v) AS sd, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 AS iqr, quantile_cont(v, 0.5) FILTER (v > 1e-8) AS pm FROM m GROUP BY event_type, center)
 SELECT event_type, {r('center')} AS center, {r('CASE WHEN mad > 1e-8 THEN mad WHEN sd > 1e-8 THEN sd ELSE 1 END')} AS scale, {r('iqr')} AS sigma, {r('coalesce(pm, 1.0)')} AS positive FROM g""")
def a04(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").cast("double").alias("v"))
    more = e.groupBy("event_type").agg(features.robust_sigma(F.col("v")).alias("sigma"), statistics.positive_median(F.col("v"), F.lit(1.0)).alias("positive"))
    return rounded(statistics.robust_scale(e, "v", "event_type").join(more, "event_type"), "event_type", "center", "scale", "sigma", "positive")


@query("a07_cluster_centres", f"WITH {SONG}, f(target, fv, fa) AS (VALUES (0, 0.25, 0.25), (1, 0.65, 0.30), (2, 0.25, 0.80), (3, 0.80, 0.75)), m AS (SELECT cluster_id, avg(bv) AS mv, avg(ba) AS ma FROM s WHERE cluster_id <> 3 GROUP BY cluster_id) SELECT target, {r('coalesce(mv, fv)')} AS tv, {r('coalesce(ma, fa)')} AS ta FROM f LEFT JOIN m ON cluster_id = target")
def a07(spark, d):
    return rounded(retrieval.centres(song(spark, d).filter("cluster_id <> 3")), "target", "tv", "ta")


_Q = "CASE WHEN NOT (has_audio OR has_lyrics) THEN -1 WHEN bv >= 0.5 AND ba >= 0.5 THEN 0 WHEN bv < 0.5 AND ba >= 0.5 THEN 1 WHEN bv < 0.5 THEN 2 ELSE 3 END"


@query("a08_cluster_summary", f"""WITH {SONG}, q AS (SELECT *, {_Q} AS q FROM s), g AS (SELECT cluster_id, count(*) AS size, {', '.join(f'count(*) FILTER (q = {i}) AS q{i}' for i in range(4))}, {', '.join(f'avg({c}) FILTER (has_{v}) AS mean_{c}' for v, cs in (('audio', ('av', 'aa')), ('lyrics', ('lv', 'la'))) for c in cs)},
 avg(bv) AS mean_bv, avg(ba) AS mean_ba, avg(norm) FILTER (has_audio AND has_lyrics) AS mean_norm, avg(abs(atan2(da, dv)) / pi()) FILTER (has_audio AND has_lyrics) AS mean_angle, avg(has_audio::INT) AS audio_ratio, avg(has_lyrics::INT) AS lyrics_ratio FROM q GROUP BY cluster_id), x AS (SELECT *, greatest(q0, q1, q2, q3) AS top FROM g)
 SELECT cluster_id, size, {r('size / sum(size) OVER ()')} AS fraction, q0, q1, q2, q3, CASE WHEN top = 0 THEN -1 WHEN q0 = top THEN 0 WHEN q1 = top THEN 1 WHEN q2 = top THEN 2 ELSE 3 END AS dominant, {r('top / size')} AS dominant_ratio, {rs('mean_av', 'mean_aa', 'mean_lv', 'mean_la', 'mean_bv', 'mean_ba', 'mean_norm', 'mean_angle', 'audio_ratio', 'lyrics_ratio')} FROM x""")
def a08(spark, d):
    cs = ["cluster_id", "size", "fraction", "q0", "q1", "q2", "q3", "dominant", "dominant_ratio", "mean_av", "mean_aa", "mean_lv", "mean_la", "mean_bv", "mean_ba", "mean_norm", "mean_angle", "audio_ratio", "lyrics_ratio"]
    return rounded(statistics.cluster_summary(song(spark, d)), *cs)


@query("a09_quadrant_pivot", f"WITH {SONG}, q AS (SELECT cluster_id, {_Q} AS q FROM s) SELECT cluster_id, {', '.join(r(f'count(*) FILTER (q = {i}) / count(*)') + f' AS q{i}' for i in range(4))} FROM q WHERE q >= 0 GROUP BY cluster_id")
def a09(spark, d):
    q = song(spark, d).withColumn("q", quadrant("bv", "ba", F.col("has_audio") | F.col("has_lyrics"))).filter("q >= 0")
    wide = q.groupBy("cluster_id").pivot("q", [0, 1, 2, 3]).count().na.fill(0)
    total = profiles.add([F.col(str(i)) for i in range(4)])
    return wide.select("cluster_id", *(r6(F.col(str(i)) / total).alias(f"q{i}") for i in range(4)))


_PATTERN = "has_audio::INT::VARCHAR || has_lyrics::INT::VARCHAR"


@query("a10_mask_purity", f"WITH {TRACKS}, n AS (SELECT cluster_id, {_PATTERN} AS pattern, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY cluster_id) AS size, sum(n) OVER (PARTITION BY pattern) AS f, sum(n) OVER () AS al, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, pattern) AS place FROM n) SELECT cluster_id, size::BIGINT AS size, pattern AS dominant, round(n / size, 4) AS purity, round((n / size) / (f / al), 4) AS enrichment FROM m WHERE place = 1")
def a10(spark, d):
    t = tracks(spark, d).withColumn("pattern", F.concat(F.col("has_audio").cast("int"), F.col("has_lyrics").cast("int")))
    return statistics.mask_purity(t, "cluster_id", "pattern")


@query("a13_affect_purity", f"""WITH {SONG}, q AS (SELECT cluster_id, {_Q} AS q FROM s), n AS (SELECT cluster_id, q, count(*) AS n FROM q WHERE q >= 0 GROUP BY ALL), e AS (SELECT cluster_id, sum(n) AS size, max(n) AS top, max(n) / sum(n) AS ratio FROM n GROUP BY cluster_id)
 SELECT {r('min(ratio)')} AS min_dominant, {r('sum(top) / sum(size)')} AS weighted_dominant, {r('sum(CASE WHEN ratio < 0.7 THEN size ELSE 0 END) / sum(size)')} AS mixed_fraction, (SELECT cluster_id FROM e ORDER BY ratio, cluster_id LIMIT 1) AS worst_cluster, {r('(SELECT avg((q >= 0)::INT) FROM q)')} AS valid_fraction, min(ratio) >= 0.7 AS gate_ok FROM e""")
def a13(spark, d):
    q = song(spark, d).withColumn("q", quadrant("bv", "ba", F.col("has_audio") | F.col("has_lyrics")))
    return rounded(statistics.affect_purity(q, "cluster_id", "q"), "min_dominant", "weighted_dominant", "mixed_fraction", "worst_cluster", "valid_fraction", "gate_ok")


@query("a14_centre_separation", f"WITH {SONG}, c AS (SELECT cluster_id, avg(bv) AS cx, avg(ba) AS cy FROM s GROUP BY cluster_id), g AS (SELECT cluster_id, cx, cy, avg(sqrt((bv-cx)*(bv-cx) + (ba-cy)*(ba-cy))) AS r FROM s JOIN c USING (cluster_id) GROUP BY cluster_id, cx, cy) SELECT {r('min(sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy)) / greatest(a.r + b.r, 1e-8))')} AS separation FROM g a JOIN g b ON a.cluster_id < b.cluster_id")
def a14(spark, d):
    return rounded(statistics.separation(song(spark, d), "bv", "ba", "cluster_id"), "separation")


_BW = f"{SONG}, m AS (SELECT cluster_id, count(*) AS n, avg(dv) AS m1, avg(da) AS m2, var_pop(dv) AS v1, var_pop(da) AS v2 FROM s GROUP BY cluster_id), g AS (SELECT avg(dv) AS g1, avg(da) AS g2 FROM s), bw AS (SELECT sum(n * ((m1-g1)*(m1-g1) + (m2-g2)*(m2-g2))) AS b, sum(n * (v1 + v2)) AS w, count(*) AS k, sum(n) AS n FROM m, g)"


@query("a15_a16_between_within", f"WITH {_BW} SELECT {r('b / w')} AS ratio, {r('sqrt((b / (k - 1)) / (w / (n - k)))')} AS effect FROM bw")
def a15(spark, d):
    t = song(spark, d)
    one, two = statistics.between_within(t, ["dv", "da"], "cluster_id"), statistics.between_within(t, ["dv", "da"], "cluster_id", adjusted=True)
    return rounded(one.crossJoin(two.withColumnRenamed("ratio", "effect")), "ratio", "effect")


@query("a17_effect_size", f"WITH {_BW}, p AS (SELECT sum(v1 * (n - 1)) AS s1, sum(v2 * (n - 1)) AS s2, sum(n) AS n, count(*) AS k FROM m) SELECT {r('(SELECT max(sqrt((a.m1-b.m1)*(a.m1-b.m1) + (a.m2-b.m2)*(a.m2-b.m2))) FROM m a JOIN m b ON a.cluster_id < b.cluster_id) / sqrt((s1 + s2) / 2 / (n - k))')} AS effect FROM p")
def a17(spark, d):
    return rounded(statistics.effect_size(song(spark, d), ["dv", "da"], "cluster_id"), "effect")


@query("a18_raw_audit", """SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) - count(DISTINCT o_custkey) AS repeats, count(*) FILTER (o_totalprice IS NULL) AS no_price, round(min(o_totalprice::DOUBLE), 6) AS low, round(max(o_totalprice::DOUBLE), 6) AS high, count(DISTINCT (round(o_totalprice::DOUBLE, 8), o_orderstatus)) AS pairs, avg((trim(coalesce(o_orderpriority, '')) <> '')::INT) AS coverage FROM orders""")
def a18(spark, d):
    o = table(spark, d, "orders")
    price = F.col("o_totalprice").cast("double")
    return o.agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), (F.count("*") - F.countDistinct("o_custkey")).alias("repeats"), F.count_if(price.isNull()).alias("no_price"), F.round(F.min(price), 6).alias("low"), F.round(F.max(price), 6).alias("high"),
        F.countDistinct(F.round(price, 8), "o_orderstatus").alias("pairs"), F.avg((F.trim(F.coalesce("o_orderpriority", F.lit(""))) != "").cast("int")).alias("coverage"),
    )


@query("a18_functional_dependency", "SELECT p_brand, count(DISTINCT p_type) <= 1 AS determines FROM part GROUP BY p_brand HAVING count(*) >= 2")
def a18b(spark, d):
    return statistics.determines(table(spark, d, "part"), "p_brand", "p_type")


@query("a20_weighted_ratios", f"SELECT l_returnflag, {r('sum(l_quantity::DOUBLE * l_discount::DOUBLE) / sum(l_quantity::DOUBLE)')} AS weighted, {r('min(l_discount::DOUBLE)')} AS least, {r('sum(CASE WHEN l_discount < 0.05 THEN l_quantity::DOUBLE ELSE 0 END) / sum(l_quantity::DOUBLE)')} AS mixed FROM lineitem GROUP BY l_returnflag")
def a20(spark, d):
    q, x = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(F.sum(q * x) / F.sum(q)).alias("weighted"), r6(F.min(x)).alias("least"), r6(F.sum(F.when(F.col("l_discount") < 0.05, q).otherwise(0.0)) / F.sum(q)).alias("mixed"))


@query("a23_missing_counts", "SELECT unnest(['title', 'artist']) AS field, unnest([count(*) FILTER (title = ''), count(*) FILTER (artist = '')]) AS blank, count(*) AS n FROM (WITH " + SONG + " SELECT * FROM s)")
def a23(spark, d):
    t = song(spark, d)
    wide = t.agg(*(F.count_if(F.col(c) == "").alias(c) for c in ("title", "artist")), F.count("*").alias("n"))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("blank")) for c in ("title", "artist")))).alias("s"), "n").select("s.field", "s.blank", "n")


@query("a27_document_frequency", "SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents) GROUP BY token")
def a27(spark, d):
    rows = table(spark, d, "documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("df"))


@query("a28_o06_vocabulary", "SELECT token, frequency, row_number() OVER (ORDER BY frequency DESC, token) - 1 AS place FROM (SELECT token, count(*) AS frequency FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY token ORDER BY frequency DESC, token LIMIT 25)")
def a28(spark, d):
    rows = features.token_rows(table(spark, d, "part"), "p_partkey", F.split("p_name", " "))
    return features.vocabulary(rows, "p_partkey", 25, distinct=False).withColumn("place", F.col("place").cast("bigint"))


@query("a32_duplicates", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY n DESC, o_custkey LIMIT 1000")
def a32(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "o_custkey").limit(1000)


_CONT = f"{TRACKS}, ct AS (SELECT cluster_id AS a, label % 3 AS b, count(*)::DOUBLE AS n FROM t GROUP BY ALL)"


@query("m01_adjusted_rand", f"WITH {_CONT}, x AS (SELECT sum(n*(n-1)/2) AS c, sum(n) AS n FROM ct), y AS (SELECT sum(n*(n-1)/2) AS ra FROM (SELECT sum(n) AS n FROM ct GROUP BY a)), z AS (SELECT sum(n*(n-1)/2) AS rb FROM (SELECT sum(n) AS n FROM ct GROUP BY b)) SELECT {r('(c - ra*rb/(n*(n-1)/2)) / ((ra+rb)/2 - ra*rb/(n*(n-1)/2))')} AS ari FROM x, y, z")
def m01(spark, d):
    return rounded(statistics.adjusted_rand(tracks(spark, d).withColumn("b", F.col("label") % 3), "cluster_id", "b"), "ari")


@query("m02_mutual_information", f"WITH {_CONT}, x AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM ct) SELECT {r('sum(n/t * ln(n*t/(ra*rb))) / ((-sum(n/t*ln(ra/t)) - sum(n/t*ln(rb/t))) / 2)')} AS nmi FROM x")
def m02(spark, d):
    return rounded(statistics.mutual_information(tracks(spark, d).withColumn("b", F.col("label") % 3), "cluster_id", "b"), "nmi")


@query("m03_silhouette", f"WITH {TRACKS}, p AS (SELECT a.idx, a.cluster_id AS own, b.cluster_id AS o, sum(sqrt((a.av-b.av)*(a.av-b.av) + (a.aa-b.aa)*(a.aa-b.aa))) AS s, count(*) AS n FROM t a, t b GROUP BY ALL), q AS (SELECT idx, own, max(CASE WHEN own = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> o THEN s / n END) AS b FROM p GROUP BY ALL) SELECT idx, own AS cluster_id, {r('CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END')} AS silhouette FROM q")
def m03(spark, d):
    return rounded(neighbors.silhouette(tracks(spark, d), ["av", "aa"], "cluster_id"), "idx", "cluster_id", "silhouette")


@query("m08_overlap_gate", f"""WITH {TRACKS}, p AS (SELECT a.idx, a.cluster_id AS own, b.cluster_id AS o, sqrt((a.av-b.av)*(a.av-b.av) + (a.aa-b.aa)*(a.aa-b.aa)) AS dd, b.idx AS other FROM t a, t b), h AS (SELECT idx, own, o, sum(dd) AS s, count(*) AS n FROM p GROUP BY ALL),
 q AS (SELECT idx, max(CASE WHEN own = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> o THEN s / n END) AS b FROM h GROUP BY idx), sl AS (SELECT avg((b - a) / greatest(a, b)) AS m, avg(((b - a) / greatest(a, b) < 0)::INT) AS neg FROM q),
 k AS (SELECT idx, own = o AS same, row_number() OVER (PARTITION BY idx ORDER BY dd, other) AS n FROM p WHERE idx <> other), k1 AS (SELECT avg(x) AS p10 FROM (SELECT idx, avg(same::INT) AS x FROM k WHERE n <= 10 GROUP BY idx)), k2 AS (SELECT avg(x) AS p20 FROM (SELECT idx, avg(same::INT) AS x FROM k WHERE n <= 20 GROUP BY idx)),
 c AS (SELECT cluster_id, avg(av) AS cx, avg(aa) AS cy FROM t GROUP BY cluster_id), g AS (SELECT cluster_id, cx, cy, avg(sqrt((av-cx)*(av-cx) + (aa-cy)*(aa-cy))) AS r FROM t JOIN c USING (cluster_id) GROUP BY ALL), sp AS (SELECT min(sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy)) / (a.r + b.r)) AS sep FROM g a JOIN g b ON a.cluster_id < b.cluster_id)
 SELECT {r('p10')} AS purity_10, {r('p20')} AS purity_20, {r('sep')} AS separation, {r('neg')} AS negative_fraction, {r('m')} AS mean_silhouette, p20 >= 0.9 AND sep >= 0.7 AND neg <= 0.1 AS gate_ok FROM k1, k2, sp, sl""")
def m08(spark, d):
    t = tracks(spark, d)
    sil = neighbors.silhouette(t, ["av", "aa"], "cluster_id").agg(F.avg((F.col("silhouette") < 0).cast("double")).alias("negative_fraction"), F.avg("silhouette").alias("mean_silhouette"))
    one = neighbors.label_purities(t, ["av", "aa"], "cluster_id", [10, 20])
    out = one.crossJoin(statistics.separation(t, "av", "aa", "cluster_id")).crossJoin(sil)  # one row each
    ok = (F.col("purity_20") >= 0.9) & (F.col("separation") >= 0.7) & (F.col("negative_fraction") <= 0.1)
    return rounded(out.withColumn("gate_ok", ok), "purity_10", "purity_20", "separation", "negative_fraction", "mean_silhouette", "gate_ok")


@query("m09_davies_bouldin", f"WITH {SONG}, c AS (SELECT cluster_id, avg(bv) AS cx, avg(ba) AS cy FROM s GROUP BY cluster_id), g AS (SELECT cluster_id, cx, cy, avg(sqrt((bv-cx)*(bv-cx) + (ba-cy)*(ba-cy))) AS r FROM s JOIN c USING (cluster_id) GROUP BY ALL), w AS (SELECT a.cluster_id, max((a.r + b.r) / sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy))) AS w FROM g a JOIN g b ON a.cluster_id <> b.cluster_id GROUP BY ALL) SELECT {r('avg(w)')} AS davies_bouldin FROM w")
def m09(spark, d):
    return rounded(statistics.davies_bouldin(song(spark, d), ["bv", "ba"], "cluster_id"), "davies_bouldin")


@query("st01_token_enrichment", f"""WITH rows AS (SELECT DISTINCT p_partkey AS idx, p_size % 4 AS g, unnest(string_split(p_name, ' ')) AS token FROM part), ks AS (SELECT DISTINCT idx, g FROM rows), sz AS (SELECT g, count(*) AS size FROM ks GROUP BY g), al AS (SELECT count(*) AS al FROM ks),
 c AS (SELECT g, token, count(*) AS k FROM rows GROUP BY ALL), o AS (SELECT token, count(*) AS f FROM rows GROUP BY token), j AS (SELECT * FROM c JOIN o USING (token) JOIN sz USING (g), al WHERE k >= 5 AND f >= 10),
 tl AS (SELECT j.*, unnest(range(k, least(f, size) + 1)) AS x FROM j), p AS (SELECT g, token, k, f, size, al, least(1.0, sum(exp(lgamma(f+1) - lgamma(x+1) - lgamma(f-x+1) + lgamma(al-f+1) - lgamma(size-x+1) - lgamma(al-f-size+x+1) - lgamma(al+1) + lgamma(size+1) + lgamma(al-size+1)))) AS p FROM tl WHERE al - f - size + x >= 0 GROUP BY ALL)
 SELECT g, token, k, f AS total, {r('p')} AS p, {r('(k / size) / (f / al)')} AS enrichment FROM p""")
def st01(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), (F.col("p_size") % 4).alias("g"), F.explode(F.split("p_name", " ")).alias("token"))
    out = statistics.enrichment(rows, "idx", "g", "token").withColumnRenamed("of", "total")
    return rounded(out, "g", "token", "k", "total", "p", "enrichment")


# ---------------------------------------------------------------- windows, limits and sets


@query("w01_w02_percentiles", f"SELECT event_id, {r('cume_dist() OVER (PARTITION BY event_type ORDER BY value)')} AS ecdf, {r('1 - (rank() OVER (PARTITION BY event_type ORDER BY value) - 1) / count(*) OVER (PARTITION BY event_type)')} AS centrality FROM events")
def w01(spark, d):
    ranked = statistics.with_ranks(table(spark, d, "events"), F.col("value"), "event_type", ecdf="ecdf", centrality="centrality")
    return rounded(ranked, "event_id", "ecdf", "centrality")


@query("w03_fill_percentile", f"WITH {SONG}, n AS (SELECT idx, cluster_id, CASE WHEN idx % 5 = 0 THEN NULL ELSE norm END AS nm, CASE WHEN idx % 2 = 0 THEN 0.25 END AS p FROM s), c AS (SELECT *, cume_dist() OVER (PARTITION BY cluster_id, nm IS NULL ORDER BY nm) AS e FROM n) SELECT idx, {r('coalesce(p, CASE WHEN nm IS NOT NULL THEN e END)')} AS percentile FROM c")
def w03(spark, d):
    t = song(spark, d).select("idx", "cluster_id", F.when(F.col("idx") % 5 != 0, F.col("norm")).alias("nm"), F.when(F.col("idx") % 2 == 0, 0.25).alias("p"))
    return statistics.fill_percentiles(t, "p", "nm", "cluster_id").select("idx", r6("p").alias("percentile"))


@query("w05_bh_qvalues", f"WITH x AS (SELECT s_suppkey, s_nationkey, (abs(hash(1)) * 0 + (s_suppkey * 37 % 101) / 101.0) AS p FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) AS n, count(*) OVER (PARTITION BY s_nationkey) AS m FROM x) SELECT s_suppkey, {r('least(1.0, min(p * m / n) OVER (PARTITION BY s_nationkey ORDER BY n DESC ROWS UNBOUNDED PRECEDING))')} AS q FROM k")
def w05(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", ((F.col("s_suppkey") * 37 % 101) / 101.0).alias("p"))
    return rounded(statistics.bh_qvalues(t, "p", "s_nationkey"), "s_suppkey", "q")


@query("w06_dcg", f"SELECT o_custkey, {r('sum((power(2, rel) - 1) / log2(n + 1))')} AS dcg FROM (SELECT o_custkey, o_orderkey % 4 AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) GROUP BY o_custkey")
def w06(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    t = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 4).cast("double").alias("rel"), F.row_number().over(w).alias("n"))
    return t.groupBy("o_custkey").agg(r6(F.sum(retrieval.gain(F.col("rel"), F.col("n")))).alias("dcg"))


@query("w07_elbow", f"WITH b AS (SELECT l_linenumber AS k, sum(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY ALL), c AS (SELECT k, lag(v) OVER (ORDER BY k) - 2 * v + lead(v) OVER (ORDER BY k) AS d2 FROM b) SELECT arg_max(k, d2) AS elbow FROM c WHERE d2 IS NOT NULL")
def w07(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))
    return selection.elbow(b, "v").select(F.col("k").alias("elbow"))


@query("w08_min_max", f"WITH b AS (SELECT l_linenumber AS k, avg(l_extendedprice::DOUBLE) AS v FROM lineitem GROUP BY ALL) SELECT k, {r('(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())')} AS scaled FROM b")
def w08(spark, d):
    from ..operators.selection import min_max

    b = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("v"))
    return b.select("k", r6(min_max("v")).alias("scaled"))


@query("w11_canonical_order", f"WITH {SONG}, g AS (SELECT label, avg(norm) AS n, avg(atan2(da, dv)) AS a FROM s GROUP BY label) SELECT label, row_number() OVER (ORDER BY round(n, 9), round(a, 9), label) - 1 AS place FROM g")
def w11(spark, d):
    g = song(spark, d).groupBy("label").agg(F.avg("norm").alias("n"), F.avg(F.atan2("da", "dv")).alias("a"))
    return g.select("label", (F.row_number().over(Window.orderBy(F.round("n", 9), F.round("a", 9), "label")) - 1).cast("bigint").alias("place"))  # a row a label


@query("w14_representatives", f"WITH {SONG}, c AS (SELECT cluster_id, avg(bv) AS cx, avg(ba) AS cy FROM s GROUP BY cluster_id), e AS (SELECT s.cluster_id, idx, artist, round(sqrt((bv-cx)*(bv-cx) + (ba-cy)*(ba-cy)), 9) AS dd FROM s JOIN c USING (cluster_id)), a AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, artist ORDER BY dd, idx) AS n FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY dd, idx) AS place FROM a WHERE artist = '' OR n = 1) SELECT cluster_id, idx, place FROM f WHERE place <= 8")
def w14(spark, d):
    from ..operators.selection import representatives

    return representatives(song(spark, d), 8).select("cluster_id", "idx", F.col("place").cast("bigint").alias("place"))


@query("o02_o03_ranked_candidates", "SELECT o_orderstatus, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def o02(spark, d):
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("place", F.row_number().over(w).cast("bigint")).filter("place <= 3").select("o_orderstatus", "o_orderkey", "place")


@query("o10_top_by_norm", f"WITH {SONG} SELECT idx, {r('norm')} AS norm FROM s ORDER BY round(norm, 9) DESC, idx LIMIT 200")
def o10(spark, d):
    return song(spark, d).orderBy(F.desc(F.round("norm", 9)), "idx").limit(200).select("idx", r6("norm").alias("norm"))


@query("o08_o09_select_k", f"WITH b AS (SELECT l_linenumber AS k, round(avg(l_discount::DOUBLE), 9) AS score, min(l_tax::DOUBLE) >= 0 AND l_linenumber > 1 AS eligible FROM lineitem GROUP BY l_linenumber) SELECT k, {r('score')} AS score FROM b WHERE eligible ORDER BY score DESC, k LIMIT 1")
def o08(spark, d):
    from ..operators.selection import select_k

    b = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 9).alias("score"), F.min(F.col("l_tax").cast("double")).alias("t"))
    return rounded(select_k(b.withColumn("eligible", (F.col("t") >= 0) & (F.col("k") > 1))), "k", "score")


@query("set02_set03_configs", "SELECT name, name IN (SELECT p_brand FROM part WHERE p_size > 25) AS large, name IN (SELECT p_brand FROM part WHERE p_size <= 10) AS small FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 25 UNION SELECT p_brand FROM part WHERE p_size <= 10)")
def set02(spark, d):
    p = table(spark, d, "part")
    large, small = p.filter("p_size > 25").select(F.col("p_brand").alias("name")).distinct(), p.filter("p_size <= 10").select(F.col("p_brand").alias("name")).distinct()
    both = large.intersect(small).select("name", F.lit(True).alias("large"), F.lit(True).alias("small"))
    return both.union(large.subtract(small).select("name", F.lit(True), F.lit(False))).union(small.subtract(large).select("name", F.lit(False), F.lit(True)))


@query("set06_tagged_union", "SELECT 'S' AS dataset, s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT 'L', c_custkey, c_name, c_mktsegment FROM customer")
def set06(spark, d):
    a = table(spark, d, "supplier").select(F.lit("S").alias("dataset"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = table(spark, d, "customer").select(F.lit("L").alias("dataset"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


# ---------------------------------------------------------------- profiles, interpretation, retrieval

_W = range(4)
PROFILE = f"""{SONG},
 c AS (SELECT cluster_id, avg(bv) AS cx, avg(ba) AS cy, count(*) AS m FROM s GROUP BY cluster_id), dd AS (SELECT s.cluster_id, sqrt((bv-cx)*(bv-cx) + (ba-cy)*(ba-cy)) AS d FROM s JOIN c USING (cluster_id)),
 rd AS (SELECT c.*, CASE WHEN m < 3 THEN NULL ELSE (SELECT quantile_cont(d, 0.5) FROM dd WHERE dd.cluster_id = c.cluster_id AND d > 1e-8) END AS own, (SELECT quantile_cont(d, 0.5) FROM dd WHERE d > 1e-8) AS al FROM c),
 w4 AS (SELECT {', '.join(f'max(CASE WHEN cluster_id = {i} THEN {c} END) AS {n}{i}' for i in _W for n, c in (('cx', 'cx'), ('cy', 'cy'), ('rr', 'greatest(coalesce(own, al, 1.0), 1e-8)')))} FROM rd),
 p0 AS (SELECT s.*, {', '.join(f'sqrt((bv-cx{i})*(bv-cx{i}) + (ba-cy{i})*(ba-cy{i})) / rr{i} AS D_{i}' for i in _W)} FROM s, w4),
 p1 AS (SELECT *, {', '.join(f'exp(-0.5 * (D_{i}*D_{i} - least(D_0, D_1, D_2, D_3) * least(D_0, D_1, D_2, D_3))) AS e{i}' for i in _W)} FROM p0),
 p2 AS (SELECT *, {', '.join(f'e{i} / (e0 + e1 + e2 + e3) AS w_{i}' for i in _W)} FROM p1),
 p3 AS (SELECT *, CASE cluster_id WHEN 0 THEN D_0 WHEN 1 THEN D_1 WHEN 2 THEN D_2 ELSE D_3 END AS D_own, CASE cluster_id WHEN 0 THEN w_0 WHEN 1 THEN w_1 WHEN 2 THEN w_2 ELSE w_3 END AS region_confidence,
  list_min(list_filter([{{'d': D_0, 'r': 0, 'w': w_0}}, {{'d': D_1, 'r': 1, 'w': w_1}}, {{'d': D_2, 'r': 2, 'w': w_2}}, {{'d': D_3, 'r': 3, 'w': w_3}}], lambda x: x.r <> cluster_id)) AS alt FROM p2),
 pr AS (SELECT *, alt.r AS nearest_alt, alt.w AS nearest_alt_weight, alt.d - D_own AS region_margin, 1 - (rank() OVER (PARTITION BY cluster_id ORDER BY D_own) - 1) / count(*) OVER (PARTITION BY cluster_id) AS region_typicality FROM p3)"""
PROFILE_COLUMNS = ["D_0", "D_1", "D_2", "D_3", "w_0", "w_1", "w_2", "w_3", "region_confidence", "nearest_alt_weight", "region_margin", "region_typicality"]

TENSION = f"""{PROFILE},
 m1 AS (SELECT cluster_id, quantile_cont(dv, 0.5) AS mv, quantile_cont(da, 0.5) AS ma, stddev_pop(dv) AS sv, stddev_pop(da) AS sa FROM s GROUP BY cluster_id), m2 AS (SELECT cluster_id, quantile_cont(abs(dv - mv), 0.5) AS av_, quantile_cont(abs(da - ma), 0.5) AS aa_ FROM s JOIN m1 USING (cluster_id) GROUP BY cluster_id),
 z AS (SELECT pr.*, (dv - mv) / CASE WHEN av_ > 1e-8 THEN av_ WHEN sv > 1e-8 THEN sv ELSE 1 END AS z_dv, (da - ma) / CASE WHEN aa_ > 1e-8 THEN aa_ WHEN sa > 1e-8 THEN sa ELSE 1 END AS z_da FROM pr JOIN m1 USING (cluster_id) JOIN m2 USING (cluster_id)),
 tc AS (SELECT cluster_id, tension_label, avg(z_dv) AS tx, avg(z_da) AS ty, count(*) AS m FROM z GROUP BY ALL), td AS (SELECT cluster_id, tension_label, sqrt((z_dv-tx)*(z_dv-tx) + (z_da-ty)*(z_da-ty)) AS d FROM z JOIN tc USING (cluster_id, tension_label)),
 tr AS (SELECT tc.*, greatest(coalesce(CASE WHEN m < 3 THEN NULL ELSE (SELECT quantile_cont(d, 0.5) FROM td WHERE td.cluster_id = tc.cluster_id AND td.tension_label = tc.tension_label AND d > 1e-8) END, (SELECT quantile_cont(d, 0.5) FROM td WHERE d > 1e-8), 1.0), 1e-8) AS rr FROM tc),
 te AS (SELECT idx, z.tension_label = tr.tension_label AS mine, sqrt((z_dv-tx)*(z_dv-tx) + (z_da-ty)*(z_da-ty)) / rr AS d FROM z JOIN tr USING (cluster_id)), tf AS (SELECT *, exp(-0.5 * (d*d - min(d) OVER (PARTITION BY idx) * min(d) OVER (PARTITION BY idx))) AS e FROM te),
 tg AS (SELECT idx, mine, d, e / sum(e) OVER (PARTITION BY idx) AS w FROM tf),
 tn AS (SELECT z.*, tg.d AS D_tension, tg.w AS w_tension, 1 - (rank() OVER (PARTITION BY cluster_id, tension_label ORDER BY tg.d) - 1) / count(*) OVER (PARTITION BY cluster_id, tension_label) AS tension_typicality, {', '.join(f'cume_dist() OVER (PARTITION BY cluster_id ORDER BY {e}) AS {n}' for n, e in (('tension_percentile', 'norm'), ('dv_percentile', 'dv'), ('da_percentile', 'da'), ('abs_dv_percentile', 'abs(dv)'), ('abs_da_percentile', 'abs(da)')))} FROM z JOIN tg USING (idx) WHERE mine)"""
TENSION_COLUMNS = ["z_dv", "z_da", "D_tension", "w_tension", "tension_typicality", "tension_percentile", "dv_percentile", "da_percentile", "abs_dv_percentile", "abs_da_percentile"]

_CONSISTENT = "regexp_matches(lower(tension_label || ' ' || tension_name), 'consistent|concordant|agreement|aligned')"
FLAGS = f"""{TENSION}, f0 AS (SELECT *, CASE WHEN region_margin < 0 OR region_confidence < 0.60 THEN 'boundary' WHEN region_typicality >= 0.80 AND region_confidence >= 0.75 AND region_margin >= 0.50 THEN 'prototype' WHEN region_typicality >= 0.50 AND region_confidence >= 0.70 AND region_margin >= 0.30 THEN 'representative' ELSE 'peripheral' END AS region_role,
 nearest_alt_weight > region_confidence AS descriptor_conflict, false AS encoding_issue, false AS explicit_title FROM tn), f1 AS (SELECT *, region_role = 'boundary' AS boundary_flag, CASE WHEN region_role = 'boundary' OR descriptor_conflict THEN 'boundary_case' WHEN tension_percentile >= 0.75 AND tension_typicality >= 0.50 AND region_margin > 0 THEN 'tension_case'
 WHEN region_role = 'prototype' THEN 'region_prototype' WHEN region_role = 'representative' THEN 'region_representative' ELSE 'appendix_only' END AS selected_role FROM f0), fl AS (SELECT *, selected_role IN ('region_prototype', 'region_representative', 'tension_case') AS main_text_eligible FROM f1)"""


def profiled(spark, d):
    return profiles.region_profiles(song(spark, d))


_stages: dict[tuple, DataFrame] = {}


def _version(spark: SparkSession, d: str) -> tuple:
    """Names, times and sizes of what is in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in found))


def staged(name: str, spark: SparkSession, d: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage of the profile pipeline, written once for a session and version of the input and read by the queries after it."""
    key = (name, spark.sparkContext.applicationId, d, _version(spark, d))
    if key not in _stages:
        _stages[key] = stored(make(), name)
    return _stages[key]


def flagged(spark, d):
    return staged("profile", spark, d, lambda: profiles.review_flags(profiles.tension_profiles(profiled(spark, d))))


@query("p01_region_profiles", f"WITH {PROFILE} SELECT track_id, cluster_id, nearest_alt, {rs(*PROFILE_COLUMNS)} FROM pr")
def p01(spark, d):
    return rounded(profiled(spark, d), "track_id", "cluster_id", "nearest_alt", *PROFILE_COLUMNS)


@query("p01_mahalanobis", f"""WITH {SONG}, c AS (SELECT cluster_id, avg(bv) AS cx, avg(ba) AS cy, count(*) AS n, var_samp(bv) AS vx, var_samp(ba) AS vy, covar_samp(bv, ba) AS vxy FROM s GROUP BY cluster_id), k AS (SELECT cluster_id, cx, cy, 0.9*vx + 0.1*greatest((vx+vy)/2, 1e-8) + 1e-8 AS a, 0.9*vy + 0.1*greatest((vx+vy)/2, 1e-8) + 1e-8 AS b, 0.9*vxy AS c FROM c)
 SELECT track_id, {r('sqrt((b*(bv-cx)*(bv-cx) - 2*c*(bv-cx)*(ba-cy) + a*(ba-cy)*(ba-cy)) / (a*b - c*c))')} AS M_own FROM s JOIN k USING (cluster_id)""")
def p01m(spark, d):
    return rounded(profiles.mahalanobis(song(spark, d)), "track_id", "M_own")


@query("p02_w04_tension_profiles", f"WITH {TENSION} SELECT track_id, tension_label, {rs(*TENSION_COLUMNS)} FROM tn")
def p02(spark, d):
    return rounded(profiles.tension_profiles(profiled(spark, d)), "track_id", "tension_label", *TENSION_COLUMNS)


@query("p03_p06_review_flags", f"WITH {FLAGS} SELECT track_id, region_role, boundary_flag, descriptor_conflict, encoding_issue, explicit_title, selected_role, main_text_eligible FROM fl")
def p03(spark, d):
    return flagged(spark, d).select("track_id", "region_role", "boundary_flag", "descriptor_conflict", "encoding_issue", "explicit_title", "selected_role", "main_text_eligible")


@query("p07_p08_tension_keys", f"""WITH {FLAGS}, k AS (SELECT *, lower(tension_label || ' ' || tension_name) AS nm, {_CONSISTENT} AS ag FROM fl), o AS (SELECT *, tension_percentile >= 0.35 AND (NOT ag OR (tension_percentile >= 0.60 AND greatest(abs_dv_percentile, abs_da_percentile) >= 0.75)) AS allowed FROM k)
 SELECT track_id, allowed, (ag AND NOT allowed) OR tension_percentile < 0.35 OR regexp_matches(nm, 'consistent|concordant|agreement|aligned') AS concordant, NOT ((ag AND NOT allowed) OR tension_percentile < 0.35) AND regexp_matches(nm, 'bright|lift') AS uplift, NOT ((ag AND NOT allowed) OR tension_percentile < 0.35) AND (tension_percentile >= 0.75 OR regexp_matches(nm, 'high tension|contrast')) AS high_tension FROM o""")
def p07(spark, d):
    t = flagged(spark, d)
    keys = profiles.tension_keys()
    allowed = profiles.directional(F.col("tension_percentile"), X.consistent("tension_label", "tension_name"), F.greatest("abs_dv_percentile", "abs_da_percentile"))
    return t.select("track_id", allowed.alias("allowed"), *(keys[k].alias(k) for k in ("concordant", "uplift", "high_tension")))


def _descriptor_sql() -> str:
    """The rules of descriptors as one row a row, rule and name; the highest weight of a name wins."""
    words = lambda ws: "(" + " OR ".join(f"contains(tn_, '{w}')" for w in ws) + ")"
    agreeing = "(" + " OR ".join(f"contains(tn_, '{w}')" for w in X.CONSISTENT_WORDS) + ")"
    allowed = f"(tension_percentile >= 0.35 AND (NOT {agreeing} OR (tension_percentile >= 0.60 AND greatest(abs_dv_percentile, abs_da_percentile) >= 0.75)))"
    only = f"(({agreeing} AND NOT {allowed}) OR tension_percentile < 0.35)"
    kinds = {k: words(ws) for k, ws in profiles.KEYWORDS.items()} | {"high_tension": f"(tension_percentile >= 0.75 OR {words(['high tension', 'contrast'])})"}
    none = f"NOT ({' OR '.join(kinds.values())})"
    rules = [
        ("'boundary between assigned region and nearest alternative'", "1 + greatest(region_confidence, nearest_alt_weight, 0.01)", "boundary_flag"),
        ("'assigned region: C' || cluster_id", "region_confidence * 0.5", "boundary_flag"),
        ("'nearest alternative: C' || nearest_alt", "nearest_alt_weight * 0.5", "boundary_flag"),
    ]
    for i, names in profiles.REGION_DESCRIPTORS.items():
        for n in names:
            rules.append((f"'{n}'", "region_confidence * greatest(0.25, region_typicality)", f"NOT boundary_flag AND cluster_id = {i}"))
            rules.append((f"'{n}'", f"least(w_{i} * 0.25, greatest(region_confidence * 0.75, 0.01))", f"NOT boundary_flag AND cluster_id <> {i} AND w_{i} >= 0.15"))
    for k, holds in kinds.items():
        told = f"CASE WHEN {only} THEN {str(k == 'concordant').lower()} ELSE {holds}{f' OR {none}' if k == 'concordant' else ''} END"
        rules += [(f"'{n}'", "w_tension * greatest(0.35, tension_percentile) * tension_typicality", told) for n in profiles.TENSION_DESCRIPTORS[k]]
    for k, c, sign, share in (("uplift", "dv", "> 1e-8", "dv_percentile"), ("tempering", "dv", "< -1e-8", "abs_dv_percentile"), ("intensification", "da", "> 1e-8", "da_percentile"), ("softening", "da", "< -1e-8", "abs_da_percentile")):
        rules += [(f"'{n}'", f"greatest(0.35, tension_percentile) * greatest(0.5, tension_typicality) * {share}", f"{allowed} AND {c} {sign}") for n in profiles.TENSION_DESCRIPTORS[k]]
    each = " UNION ALL ".join(f"SELECT track_id, {n} AS descriptor, {w} AS raw FROM dk WHERE {c}" for n, w, c in rules)
    return f"""WITH {FLAGS}, dk AS MATERIALIZED (SELECT *, lower(tension_label || ' ' || tension_name) AS tn_ FROM fl), dr AS ({each}), db AS (SELECT track_id, descriptor, max(raw) AS raw FROM dr WHERE raw > 0 GROUP BY ALL),
 dw AS (SELECT track_id, descriptor, round(raw, 6) AS raw, round(raw / max(raw) OVER (PARTITION BY track_id), 6) AS weight FROM db), dp AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY {{order}}) AS place FROM dw) SELECT track_id, descriptor, raw + 0.0 AS raw, weight + 0.0 AS weight, place FROM dp WHERE place <= 8"""


@query("p09_descriptors", _descriptor_sql().replace("{order}", "weight DESC, raw DESC, descriptor"))
def p09(spark, d):
    found = profiles.descriptors(flagged(spark, d), "track_id").withColumn("place", F.col("place").cast("bigint"))
    return rounded(found, "track_id", "descriptor", "raw", "weight", "place")


@query("p12_role_counts", f"WITH {FLAGS} SELECT cluster_id, selected_role, count(*) AS n, count(*) FILTER (main_text_eligible) AS eligible FROM fl GROUP BY ALL")
def a21(spark, d):
    return flagged(spark, d).groupBy("cluster_id", "selected_role").agg(F.count("*").alias("n"), F.count_if("main_text_eligible").alias("eligible"))


_AFFECT = lambda c: f"CASE {c} {' '.join(f'WHEN {i} THEN $${n}$$' for i, n in enumerate(interpretation.AFFECTS))} ELSE 'Unknown' END"
INTERPRET = f"""{FLAGS}, i0 AS (SELECT *, {_AFFECT('cluster_id')} AS primary_affect, {_AFFECT('nearest_alt')} AS alt_affect, nearest_alt_weight / greatest(region_confidence, 1e-8) AS blend_ratio, tension_percentile AS p FROM fl),
 i1 AS (SELECT *, CASE WHEN region_margin < 0 OR blend_ratio >= 0.80 THEN 'boundary_blend' WHEN blend_ratio >= 0.45 THEN 'strong_secondary_affect' WHEN blend_ratio >= 0.20 THEN 'mild_secondary_undertone' ELSE 'clear_primary_region' END AS mixture_type, CASE WHEN p < 0.25 THEN 'low' WHEN p < 0.60 THEN 'mild' WHEN p < 0.80 THEN 'moderate' ELSE 'high' END AS tension_level FROM i0),
 i2 AS (SELECT *, CASE WHEN mixture_type = 'boundary_blend' THEN 'boundary' WHEN region_typicality >= 0.80 THEN 'prototype' WHEN region_typicality >= 0.60 THEN 'representative' WHEN region_typicality >= 0.30 THEN 'peripheral_representative' WHEN region_confidence >= 0.75 AND region_margin > 0 THEN 'peripheral_extreme' ELSE 'ambiguous_boundary' END AS geometry_role,
  concat_ws('; ', CASE WHEN dv > 0 THEN (CASE tension_level WHEN 'mild' THEN 'mild_' ELSE '' END) || 'lyric_valence_uplift' WHEN dv < 0 THEN (CASE tension_level WHEN 'mild' THEN 'mild_' ELSE '' END) || 'lyric_valence_tempering' END, CASE WHEN da > 0 THEN (CASE tension_level WHEN 'mild' THEN 'mild_' ELSE '' END) || 'lyric_arousal_intensification' WHEN da < 0 THEN (CASE tension_level WHEN 'mild' THEN 'mild_' ELSE '' END) || 'lyric_arousal_softening' END) AS rel FROM i1),
 i3 AS (SELECT *, CASE WHEN p < 0.25 OR tension_name LIKE '%modality-consistent%' OR rel = '' THEN 'affective_concordance' ELSE rel END AS cross_modal_relation, CASE WHEN cluster_id = 3 AND p < 0.40 AND geometry_role IN ('prototype', 'representative') THEN 'Concordant Vitality' WHEN p < 0.25 THEN 'Low Tension Concordance' WHEN p < 0.60 THEN 'Mild Cross-modal Inflection' WHEN cluster_id = 0 AND dv > 0 THEN 'Bittersweet Lyrical Lift'
  WHEN cluster_id = 1 AND (dv > 0 OR da > 0) THEN 'Warm Elegiac / Lyrical Warmth Lift' WHEN cluster_id = 2 AND p >= 0.70 AND da > 0 THEN 'Lyrically Amplified Tension' WHEN cluster_id = 2 AND dv > 0 AND da <= 0 THEN 'Valence-Reframed Intensity' WHEN cluster_id = 3 AND (dv < 0 OR da < 0) THEN 'Audio-led Exuberance with Dark Lyrical Undercurrent' WHEN p >= 0.80 THEN 'High Cross-modal Tension' ELSE 'Moderate Cross-modal Tension' END AS tension_overlay,
  CASE WHEN p >= 0.60 AND ((cluster_id = 0 AND dv > 0) OR (cluster_id = 1 AND greatest(abs(dv), abs(da)) >= 0.25) OR (cluster_id = 2 AND dv > 0) OR (cluster_id = 3 AND (dv < 0 OR da < 0))) THEN 1 ELSE 0 END AS opposition FROM i2),
 i4 AS (SELECT *, least(1.0, greatest(0.0, 0.35 * least(1.0, greatest(0.0, blend_ratio)) + 0.35 * p + 0.15 * (1 - region_typicality) + 0.15 * opposition)) AS complexity, CASE geometry_role {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in interpretation.PREFIXES.items())} END AS prefix FROM i3),
 it AS (SELECT *, CASE WHEN complexity < 0.25 THEN 'simple / concordant' WHEN complexity < 0.50 THEN 'mildly complex' WHEN complexity < 0.70 THEN 'complex' ELSE 'highly complex / ambivalent' END AS complexity_level,
  CASE WHEN mixture_type = 'boundary_blend' THEN primary_affect || ' / ' || alt_affect || ' Boundary Blend' WHEN mixture_type = 'mild_secondary_undertone' THEN primary_affect || ' with mild ' || alt_affect || ' undertone' WHEN mixture_type = 'strong_secondary_affect' THEN primary_affect || ' with strong ' || alt_affect || ' undertone'
  WHEN geometry_role = 'prototype' AND tension_level = 'low' THEN 'Concordant ' || primary_affect WHEN geometry_role = 'prototype' AND p >= 0.60 THEN primary_affect || ' with ' || tension_overlay WHEN geometry_role = 'peripheral_extreme' AND p >= 0.70 THEN 'Peripheral high-tension ' || primary_affect
  WHEN p >= 0.60 AND tension_overlay NOT IN ('Moderate Cross-modal Tension', 'High Cross-modal Tension') THEN primary_affect || ' with ' || tension_overlay WHEN tension_level IN ('moderate', 'high') THEN prefix || ' ' || primary_affect || ' with ' || tension_level || ' tension' ELSE prefix || ' ' || primary_affect END AS final_label FROM i4)"""
_I = ["primary_affect", "alt_affect", "mixture_type", "geometry_role", "tension_level", "cross_modal_relation", "tension_overlay", "opposition", "complexity_level", "final_label"]


def interpreted(spark, d):
    return staged("interpretation", spark, d, lambda: interpretation.interpret(flagged(spark, d)))


@query("i01_interpretation", f"WITH {INTERPRET} SELECT track_id, {', '.join(_I)}, {rs('blend_ratio', 'complexity')} FROM it")
def i01(spark, d):
    return rounded(interpreted(spark, d), "track_id", *_I, "blend_ratio", "complexity")


@query("i12_i16_eligible", f"WITH {INTERPRET} SELECT track_id, NOT descriptor_conflict AND NOT (mixture_type = 'boundary_blend' AND selected_role <> 'boundary_case') AND NOT (tension_level = 'low' AND regexp_matches(lower(final_label), 'lyric|valence-reframed|undercurrent|amplified tension|cross-modal tension')) AS eligible FROM it")
def i12(spark, d):
    return interpreted(spark, d).select("track_id", interpretation.eligible().alias("eligible"))


_SECOND = "CASE mixture_type WHEN 'mild_secondary_undertone' THEN 'with a mild ' || alt_affect || ' undertone' WHEN 'strong_secondary_affect' THEN 'with a strong ' || alt_affect || ' undertone' WHEN 'boundary_blend' THEN primary_affect || ' / ' || alt_affect || ' boundary blend' ELSE 'without a substantive secondary affective undertone' END"


@query("i14_explanations", f"""WITH {INTERPRET} SELECT track_id, CASE WHEN mixture_type = 'boundary_blend' THEN 'boundary mixture; the ' || primary_affect || ' center is qualified by ' || {_SECOND} WHEN cross_modal_relation = 'affective_concordance' THEN primary_affect || ' remains the main frame, ' || {_SECOND} || '; audio and lyrics agree'
 ELSE primary_affect || ' is the main frame, ' || {_SECOND} || ', with ' || tension_level || ' audio-lyric contrast (' || cross_modal_relation || ') and ' || complexity_level || ' structure' END AS explanation FROM it""")
def i14(spark, d):
    return interpreted(spark, d).select("track_id", interpretation.explanation().alias("explanation"))


@query("o11_label_representatives", f"WITH {INTERPRET}, n AS (SELECT final_label, idx, row_number() OVER (PARTITION BY final_label ORDER BY round(complexity, 9) DESC, round(region_typicality, 9) DESC, idx) AS place FROM it) SELECT * FROM n WHERE place <= 3")
def o11(spark, d):
    w = Window.partitionBy("final_label").orderBy(F.desc(F.round("complexity", 9)), F.desc(F.round("region_typicality", 9)), "idx")
    return interpreted(spark, d).withColumn("place", F.row_number().over(w).cast("bigint")).filter("place <= 3").select("final_label", "idx", "place")


_VALUES = ", ".join(f"('{q[0]}', {q[1]}, {q[2]}::DOUBLE, {q[3]}::DOUBLE, '{q[4]}', '{q[5]}', '{q[6]}', '{q[7]}')" for q in retrieval.QUERIES)
_CQ = """qc(query_id, target, q_dv, q_da, strength, ct, role, mixture) AS (VALUES {values}), fx(target, fv, fa) AS (VALUES (0, 0.25, 0.25), (1, 0.65, 0.30), (2, 0.25, 0.80), (3, 0.80, 0.75)), cm AS (SELECT cluster_id, avg(bv) AS mv, avg(ba) AS ma FROM s GROUP BY cluster_id),
 tgt AS (SELECT fx.target, coalesce(mv, fv) AS tv, coalesce(ma, fa) AS ta FROM fx LEFT JOIN cm ON cluster_id = fx.target), sc AS (SELECT stddev_pop(bv) AS sv, stddev_pop(ba) AS sa FROM s), qq AS (SELECT qc.*, tv, ta, sv, sa FROM qc LEFT JOIN tgt USING (target), sc)""".format(values=_VALUES)
_SVA = "CASE WHEN target < 0 THEN 1.0 ELSE exp(-0.5 * (((bv-tv)/sv)*((bv-tv)/sv) + ((ba-ta)/sa)*((ba-ta)/sa))) END"


@query("rt_va_only", f"WITH {SONG}, {_CQ}, sco AS (SELECT query_id, track_id, {_SVA} AS score FROM s, qq), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, track_id) AS rank FROM sco) SELECT query_id, track_id, rank, {r('score')} AS score FROM rk WHERE rank <= 20")
def rt_va(spark, d):
    """The plain nearness of rows to each query's point: the flagship slice from scan to ranking."""
    s = retrieval.crossed(song(spark, d)).withColumn("score", retrieval.va_similarity()).withColumn("system", F.lit("va_only"))
    return rounded(retrieval.top(s).withColumn("rank", F.col("rank").cast("bigint")), "query_id", "track_id", "rank", "score")


_OW = "CASE cluster_id WHEN 0 THEN w_0 WHEN 1 THEN w_1 WHEN 2 THEN w_2 ELSE w_3 END"
RANKED = f"""{INTERPRET}, {_CQ},
 c0 AS (SELECT it.*, qq.query_id, target, q_dv, q_da, strength, ct, role, mixture, {_SVA} AS s_va, CASE WHEN target < 0 THEN region_confidence WHEN target = 0 THEN w_0 WHEN target = 1 THEN w_1 WHEN target = 2 THEN w_2 ELSE w_3 END AS s_region,
  0.65 * region_typicality + 0.35 * least(1.0, greatest(0.0, (region_margin + 0.25) / 1.25)) AS proto, sqrt(dv*dv + da*da) AS sn, sqrt(q_dv*q_dv + q_da*q_da) AS qn,
  greatest(CASE WHEN region_margin <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - region_margin)) END, least(1.5, greatest(0.0, greatest(CASE WHEN cluster_id <> 0 THEN w_0 ELSE 0 END, CASE WHEN cluster_id <> 1 THEN w_1 ELSE 0 END, CASE WHEN cluster_id <> 2 THEN w_2 ELSE 0 END, CASE WHEN cluster_id <> 3 THEN w_3 ELSE 0 END) / greatest({_OW}, 1e-8))) / 1.5, 1 - region_typicality) AS bound FROM it, qq),
 c1 AS (SELECT *, CASE WHEN role = 'prototype_or_representative' THEN proto WHEN mixture <> '' THEN bound WHEN strength IN ('high', 'moderate_or_high') THEN greatest(p, 1 - region_typicality) ELSE proto END AS s_geometry,
  CASE WHEN qn <= 1e-8 THEN 1.0 WHEN sn <= 1e-8 THEN 0.5 ELSE (least(1.0, greatest(-1.0, (dv*q_dv + da*q_da) / (sn*qn))) + 1) / 2 END AS dir, CASE strength WHEN 'high' THEN p WHEN 'moderate_or_high' THEN least(1.0, p / 0.60) WHEN 'low' THEN 1 - p ELSE 0.5 END AS str,
  CASE ct WHEN 'simple' THEN 1 - complexity WHEN 'mild_or_complex' THEN CASE WHEN complexity >= 0.45 AND complexity <= 0.65 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - abs(complexity - 0.55) / 0.55)) END WHEN 'complex_or_high' THEN complexity WHEN 'high' THEN CASE WHEN complexity_level = 'highly complex / ambivalent' THEN 1.0 ELSE least(1.0, greatest(0.0, complexity / 0.70)) END ELSE 0.5 END AS s_complexity FROM c0),
 c2 AS (SELECT *, CASE WHEN qn <= 1e-8 AND strength = '' THEN 0.5 WHEN qn <= 1e-8 THEN str WHEN strength = '' THEN dir ELSE 0.65 * dir + 0.35 * str END AS s_tension FROM c1),
 c3 AS (SELECT query_id, track_id, 'va_only' AS system, s_va AS score, s_va, s_region, s_tension, s_complexity, s_geometry FROM c2 UNION ALL SELECT query_id, track_id, 'va_cluster_profile', 0.50 * s_va + 0.30 * s_region + 0.10 * region_typicality + 0.10 * s_geometry, s_va, s_region, s_tension, s_complexity, s_geometry FROM c2
  UNION ALL SELECT query_id, track_id, 'full', 0.30 * s_va + 0.20 * s_region + 0.25 * s_tension + 0.15 * s_complexity + 0.10 * s_geometry, s_va, s_region, s_tension, s_complexity, s_geometry FROM c2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, system ORDER BY round(score, 12) DESC, track_id) AS rank FROM c3)"""
_S = ["score", "s_va", "s_region", "s_tension", "s_complexity", "s_geometry"]


def ranked(spark, d):
    return staged("rankings", spark, d, lambda: retrieval.top(retrieval.scores(interpreted(spark, d)))).withColumn("rank", F.col("rank").cast("bigint"))


@query("rt03_rt13_scores", f"WITH {RANKED} SELECT query_id, system, track_id, {rs(*_S)} FROM rk")
def rt13(spark, d):
    return rounded(retrieval.scores(interpreted(spark, d)), "query_id", "system", "track_id", *_S)


@query("j22_o01_rankings", f"WITH {RANKED} SELECT query_id, system, track_id, rank, {r('score')} AS score FROM rk WHERE rank <= 20")
def j22(spark, d):
    return rounded(ranked(spark, d), "query_id", "system", "track_id", "rank", "score")


_3 = lambda c: f"printf('%.3f', {c})"


@query("rt14_reasons", f"""WITH {RANKED.replace("s_va, s_region, s_tension, s_complexity, s_geometry FROM c2", "s_va, s_region, s_tension, s_complexity, s_geometry, cluster_id, bv, ba, p, complexity FROM c2")}, rs AS (SELECT *, 'C' || cluster_id || ' at balanced VA=(' || {_3('bv')} || ', ' || {_3('ba')} || ')' AS base FROM rk WHERE rank <= 20)
 SELECT query_id, system, track_id, CASE system WHEN 'va_only' THEN base || '; VA similarity=' || {_3('s_va')} WHEN 'va_cluster_profile' THEN base || '; region match=' || {_3('s_region')} || '; geometry match=' || {_3('s_geometry')} ELSE base || '; ' || CASE WHEN p >= 0.80 THEN 'high cross-modal tension' ELSE 'calibrated audio-lyric tension' END || '; tension match=' || {_3('s_tension')} || '; ACS=' || {_3('complexity')} END AS reason FROM rs""")
def rt14(spark, d):
    return ranked(spark, d).select("query_id", "system", "track_id", retrieval.reason().alias("reason"))


@query("j14_annotation_pool", f"WITH {RANKED} SELECT query_id, track_id, string_agg(DISTINCT system, ',' ORDER BY system) AS systems, {', '.join(f'max(CASE WHEN system = $${s}$$ THEN rank END) AS rank_{s}' for s in retrieval.SYSTEMS)} FROM rk WHERE rank <= 20 GROUP BY query_id, track_id")
def j14(spark, d):
    return retrieval.pool(ranked(spark, d))


_LABELS = "lb AS (SELECT query_id, track_id, (idx % 4)::DOUBLE AS grade FROM (SELECT 'volatile_high_tension' AS query_id, track_id, idx FROM s WHERE idx % 3 = 0 UNION ALL SELECT 'concordant_region_prototype', track_id, idx FROM s WHERE idx % 5 = 0))"


def _labels(spark, d):
    s = song(spark, d)
    one = s.filter("idx % 3 = 0").select(F.lit("volatile_high_tension").alias("query_id"), "track_id", "idx")
    two = s.filter("idx % 5 = 0").select(F.lit("concordant_region_prototype").alias("query_id"), "track_id", "idx")
    return one.union(two).select("query_id", "track_id", (F.col("idx") % 4).cast("double").alias("grade"))


_EVAL = f"""{RANKED}, {_LABELS}, kk(k) AS (VALUES (5), (10), (20)), mt AS (SELECT rk.query_id, system, k, rank, grade, coalesce(grade, 0) AS rel FROM rk LEFT JOIN lb USING (query_id, track_id), kk WHERE rank <= 20 AND rank <= k),
 ev AS (SELECT query_id, system, k, sum((power(2, rel) - 1) / log2(rank + 1)) AS dcg, avg(rel) AS mean_relevance, count(*) FILTER (rel >= 2) / k AS precision, count(*) FILTER (rel = 3) / k AS strong_rate, count(grade) AS judged FROM mt GROUP BY query_id, system, k),
 idl AS (SELECT query_id, k, sum((power(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, track_id) AS place FROM lb), kk WHERE place <= k GROUP BY query_id, k), me AS (SELECT ev.*, CASE WHEN ideal > 1e-8 THEN dcg / ideal END AS ndcg FROM ev LEFT JOIN idl USING (query_id, k))"""


@query("a24_retrieval_metrics", f"WITH {_EVAL} SELECT query_id, system, k, judged, {rs('ndcg', 'mean_relevance', 'precision', 'strong_rate')} FROM me")
def a24(spark, d):
    return rounded(retrieval.evaluate(ranked(spark, d), _labels(spark, d), [5, 10, 20]), "query_id", "system", "k", "judged", "ndcg", "mean_relevance", "precision", "strong_rate")


@query("a24_system_comparison", f"WITH {_EVAL} SELECT system, {r('avg(ndcg)')} AS mean_ndcg, {r('avg(mean_relevance)')} AS mean_relevance, {r('avg(precision)')} AS mean_precision, {r('avg(strong_rate)')} AS mean_strong, {r('CASE WHEN system <> $$va_only$$ THEN avg(CASE WHEN k = 10 THEN (mean_relevance > (SELECT b.mean_relevance FROM me b WHERE b.query_id = me.query_id AND b.k = 10 AND b.system = $$va_only$$))::INT END) END')} AS win_rate FROM me GROUP BY system")
def a24b(spark, d):
    m = retrieval.evaluate(ranked(spark, d), _labels(spark, d), [5, 10, 20])
    return rounded(retrieval.compare_systems(m), "system", "mean_ndcg", "mean_relevance", "mean_precision", "mean_strong", "win_rate")


@query("rt16_evidence_grades", """WITH g AS (SELECT doc_id, least(3, contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'work')::INT) AS region_grade, least(3, contains(lower(text), 'and')::INT + contains(lower(text), 'gnu')::INT) AS tension_grade, contains(lower(text), 'contradict') OR contains(lower(text), 'opposite') AS ag FROM documents), o AS (SELECT *, round_even(0.45 * region_grade + 0.55 * tension_grade, 0)::INT AS overall_grade FROM g)
 SELECT doc_id, region_grade, tension_grade, overall_grade, CASE WHEN overall_grade <= 1 AND (region_grade > 0 OR tension_grade > 0) THEN 'partial' WHEN ag AND overall_grade = 0 THEN 'contradiction' ELSE 'verified' END AS status FROM o""")
def rt16(spark, d):
    out = retrieval.grades(table(spark, d, "documents"), "text", ["the", "license", "work"], ["and", "gnu"])
    return out.select("doc_id", "region_grade", "tension_grade", "overall_grade", "status")


@query("pf13_usable_labels", "SELECT doc_id, quality::DOUBLE AS grade FROM labels WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0")
def pf13(spark, d):
    raw = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "n/a").otherwise(F.col("quality").cast("string")).alias("grade"), F.when(F.col("doc_id") % 2 == 0, "verified").otherwise("unverified").alias("status"))
    return retrieval.usable_labels(raw).select("doc_id", "grade")


@query("rt15_search_strings", "SELECT item_id, unnest([item_id || ' review', item_id || ' analysis', item_id || ' interview']) AS search FROM benchmark")
def rt15(spark, d):
    return retrieval.search_strings(table(spark, d, "benchmark"), F.col("item_id").cast("string")).select("item_id", "search")


@query("st04_st06_names", f"""WITH {SONG}, g AS (SELECT cluster_id, tension_label, avg(bv) AS v, avg(ba) AS a, avg(dv) AS x, avg(da) AS y, avg(norm) AS n FROM s GROUP BY ALL), h AS (SELECT *, concat_ws(' + ', CASE WHEN x >= 0.05 THEN 'Lyric Valence Uplift' WHEN x <= -0.05 THEN 'Lyric Valence Tempering' END, CASE WHEN y >= 0.05 THEN 'Lyric Arousal Intensification' WHEN y <= -0.05 THEN 'Lyric Arousal Softening' END) AS ps FROM g)
 SELECT cluster_id, tension_label, CASE WHEN v >= 0.88 AND a >= 0.75 THEN 'Euphoric Excitement' WHEN v >= 0.68 AND a >= 0.45 THEN 'Bright Romantic Vitality' WHEN v >= 0.60 AND a < 0.35 THEN 'Restorative Calm' WHEN v < 0.35 AND a < 0.50 THEN 'Lonely Melancholy' WHEN a < 0.50 AND v >= 0.35 THEN 'Bittersweet Nostalgia' WHEN v < 0.50 AND a >= 0.50 THEN 'Agitated Negative-Active' WHEN v >= 0.50 AND a >= 0.50 THEN 'Positive Energetic' ELSE 'Affect Region ' || cluster_id END AS region,
 CASE WHEN n < 0.08 AND abs(x) < 0.05 AND abs(y) < 0.05 THEN 'Affective Concordance' WHEN n >= 0.18 THEN 'High Cross-Modal Tension: ' || CASE WHEN ps = '' THEN 'Directionally Mixed' ELSE ps END WHEN ps = '' THEN 'Affective Concordance' ELSE ps END AS subtype FROM h""")
def st04(spark, d):
    from ..operators.selection import region_name, subtype_name

    g = song(spark, d).groupBy("cluster_id", "tension_label").agg(F.avg("bv").alias("v"), F.avg("ba").alias("a"), F.avg("dv").alias("x"), F.avg("da").alias("y"), F.avg("norm").alias("n"))
    return g.select("cluster_id", "tension_label", region_name(F.col("v"), F.col("a"), F.col("cluster_id")).alias("region"), subtype_name(F.col("x"), F.col("y"), F.col("n")).alias("subtype"))


# ---------------------------------------------------------------- estimators, search and audit


@query("c03_c04_assign", f"WITH {SONG}, d AS (SELECT track_id, (bv-0.4)*(bv-0.4) + (ba-0.4)*(ba-0.4) AS x, (bv-0.6)*(bv-0.6) + (ba-0.6)*(ba-0.6) AS y FROM s) SELECT track_id, CASE WHEN x <= y THEN 0 ELSE 1 END AS region, {r('exp(least(x, y) - x) / (exp(least(x, y) - x) + exp(least(x, y) - y))')} AS p0 FROM d")
def c03(spark, d):
    centres = [[0.4, 0.4], [0.6, 0.6]]
    return song(spark, d).select("track_id", clustering.nearest_centre(["bv", "ba"], centres).alias("region"), r6(clustering.soft_assign(["bv", "ba"], centres)[0]).alias("p0"))


@query("c01_c02_balanced_regions")
def c01(spark, d):
    return clustering.balanced_regions(stored(song(spark, d), "song"), ["bv", "ba"], 4, 20).labelled.select("idx", "region")


@query("c08_c10_masked_mixture")
def c10(spark, d):
    t = stored(tracks(spark, d), "tracks")
    m = clustering.gaussian_mixture(t, ["av", "aa", "lv", "la"], 3, {"av": "has_audio", "aa": "has_audio", "lv": "has_lyrics", "la": "has_lyrics"}, most=15)
    return t.select("idx", m.predict().alias("component"), *(x.alias(f"p{i}") for i, x in enumerate(m.responsibilities())))


@query("k06_region_search")
def k06(spark, d):
    return clustering.search_regions(stored(song(spark, d), "song"), ["bv", "ba"], range(2, 5), 10)


@query("k02_composite_score", f"WITH b AS (SELECT l_linenumber AS k, sum(l_quantity::DOUBLE) AS bic, avg(l_discount::DOUBLE) AS silhouette, count(*) AS n, avg(l_tax::DOUBLE) AS stability FROM lineitem GROUP BY l_linenumber) SELECT k, {r('0.30 * (1 - (bic - min(bic) OVER ()) / (max(bic) OVER () - min(bic) OVER ())) + 0.30 * (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ()) + 0.20 * least(1.0, n / 5000.0) + 0.20 * (stability - min(stability) OVER ()) / (max(stability) OVER () - min(stability) OVER ()) - 0.15 * 0.5 * 0.3')} AS composite_score FROM b")
def k02(spark, d):
    from ..operators.selection import composite

    q = lambda c: F.col(c).cast("double")
    b = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.sum(q("l_quantity")).alias("bic"), F.avg(q("l_discount")).alias("silhouette"), F.count("*").alias("min_size"), F.avg(q("l_tax")).alias("stability"))
    return rounded(composite(b.withColumns({"size_needed": F.lit(5000.0), "mask_nmi": F.lit(0.1), "mask_purity": F.lit(0.2)})), "k", "composite_score")


@query("au02_split_consistency", f"WITH {SONG}, q AS (SELECT idx % 3 AS sp, cluster_id, {_Q} AS q FROM s), a AS (SELECT cluster_id, q, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, q) AS n FROM q GROUP BY cluster_id, q), b AS (SELECT sp, cluster_id, q, row_number() OVER (PARTITION BY sp, cluster_id ORDER BY count(*) DESC, q) AS n FROM q GROUP BY sp, cluster_id, q) SELECT {r('avg((b.q = a.q)::INT)')} AS share FROM b JOIN a ON a.cluster_id = b.cluster_id AND a.n = 1 WHERE b.n = 1")
def au02(spark, d):
    t = song(spark, d).withColumns({"sp": F.col("idx") % 3, "q": quadrant("bv", "ba", F.col("has_audio") | F.col("has_lyrics"))})
    return rounded(audit.split_consistency(t, "sp", "cluster_id", "q"), "share")


@query("au05_count_reproduction", f"WITH {SONG} SELECT cluster_id, count(*) FILTER (idx % 2 = 0) AS n_split, count(*) AS n_all, abs(count(*) FILTER (idx % 2 = 0) - count(*)) <= greatest(1.0, round(0.25 * greatest(count(*), 1))) AS ok FROM s GROUP BY cluster_id")
def au05(spark, d):
    return audit.count_reproduced(song(spark, d).groupBy("cluster_id").agg(F.count_if(F.col("idx") % 2 == 0).alias("n_split"), F.count("*").alias("n_all")))


@query("au11_snk15_ablation_deltas", f"WITH b AS (SELECT l_linenumber AS k, avg(l_discount::DOUBLE) AS sep, avg(l_tax::DOUBLE) AS nmi, avg(l_quantity::DOUBLE) / 20 AS en FROM lineitem GROUP BY ALL), c AS (SELECT k, sep - greatest(0.0, nmi - 0.05) - 0.05 * greatest(0.0, en - 1.3) - (greatest(0.0, 0.80 - sep) + greatest(0.0, nmi - 0.15) + greatest(0.0, 0.70 - sep)) AS claim FROM b) SELECT k, {r('claim')} AS claim, {r('claim - (SELECT claim FROM c WHERE k = 1)')} AS delta_claim FROM c")
def au11(spark, d):
    q = lambda c: F.col(c).cast("double")
    b = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.avg(q("l_discount")).alias("sep"), F.avg(q("l_tax")).alias("nmi"), (F.avg(q("l_quantity")) / 20).alias("en"))
    penalty = audit.affect_penalty(F.col("sep"), F.col("nmi"), F.col("sep"))
    c = b.select("k", audit.claim_score(F.col("sep"), F.col("nmi"), F.col("en"), penalty).alias("claim"))
    return rounded(audit.ablation_deltas(c, 1, ["claim"], "k"), "k", "claim", "delta_claim")


@query("au01_gates", f"WITH {SONG} SELECT gate, status, value, '' AS detail FROM (SELECT unnest(['overlap', 'seed_stability', 'min_size', 'affect_purity']) AS gate, unnest(['fail', 'pass', CASE WHEN min(n) >= 10 THEN 'pass' ELSE 'fail' END, 'warn']) AS status, unnest([0.5, 0.95, (min(n) >= 10)::INT::DOUBLE, 0.6]) AS value FROM (SELECT count(*) AS n FROM s GROUP BY cluster_id))")
def au01(spark, d):
    sizes = song(spark, d).groupBy("cluster_id").count().agg((F.min("count") >= 10).alias("min_size_ok"))
    m = sizes.withColumns({"purity_20": F.lit(0.5), "separation": F.lit(0.2), "negative_fraction": F.lit(0.3), "seed_ari": F.lit(0.95), "affect_purity": F.lit(0.6)})
    return audit.overlap_gates(m)
