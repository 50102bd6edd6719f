"""More registered queries: sources in standard form, strategies, scores of searches, losses, reports, and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import audit, dataset, joins, metadata, micro, neighbors, reports, runs, search, selection, spectral, strategies, templates, training
from ..runtime import remove_at_end, shared_folder
from ..schema import FEATURES, REGIONS
from ..sources import arrays, frames
from ..sources.tables import stored
from .adapters import SONG, TRACKS, song, table, tracks
from .catalog import FLAGS, INTERPRET, flagged, interpreted, query, r, rounded, rs

# ---------------------------------------------------------------- sources in standard form

_RAW = "raw AS (SELECT ' ' || track_id || ' ' AS identifier, 'C' || cluster_id AS cluster, bv::VARCHAR AS balanced_v, ba::VARCHAR AS c_arousal, tension_label AS subtype, tension_name AS subtype_name, dv::VARCHAR AS dv, da::VARCHAR AS delta_a, idx FROM s)"


def _raw(spark, d):
    s = song(spark, d)
    text = lambda c: F.col(c).cast("string")
    return s.select(F.concat(F.lit(" "), "track_id", F.lit(" ")).alias("identifier"), F.concat(F.lit("C"), text("cluster_id")).alias("Cluster"), text("bv").alias("Balanced-V"), text("ba").alias("c_arousal"), F.col("tension_label").alias("subtype"), F.col("tension_name").alias("Subtype Name"), text("dv").alias("dv"), text("da").alias("delta_a"), "title", "artist")


@query("src24_cluster_frame", f"WITH {SONG} SELECT track_id AS song_id, cluster_id, {r('bv')} AS balanced_valence, {r('ba')} AS balanced_arousal FROM s")
def src24(spark, d):
    return rounded(frames.cluster_frame(_raw(spark, d)), "song_id", "cluster_id", "balanced_valence", "balanced_arousal")


@query("src25_tension_frame", f"WITH {SONG} SELECT track_id AS song_id, tension_label, tension_name, {rs('dv', 'da').replace(' AS dv', ' AS tension_dv').replace(' AS da', ' AS tension_da')}, {r('norm')} AS tension_norm FROM s")
def src25(spark, d):
    return rounded(frames.tension_frame(_raw(spark, d)), "song_id", "tension_label", "tension_name", "tension_dv", "tension_da", "tension_norm")


@query("src23_titles", "SELECT p_partkey::VARCHAR AS song_id, trim(p_name) AS title, '' AS artist FROM part")
def src23(spark, d):
    return frames.titles(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_name").alias("Title")))


@query("src06_metadata_table", "SELECT o_custkey::VARCHAR AS track_id, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def src06(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("Song"), "o_orderkey").orderBy("o_orderkey")
    return frames.metadata_table(rows, "song", "track_id")


@query("src08_aligned_pairs", "SELECT c_custkey::VARCHAR AS \"Audio_Song\", c_nationkey::VARCHAR AS \"Lyric_Song\", upper(c_mktsegment) AS \"Quadrant\" FROM customer")
def src08(spark, d):
    rows = table(spark, d, "customer").select(F.concat(F.col("c_custkey"), F.lit(" ")).alias("Audio_Song"), F.col("c_nationkey").cast("string").alias("Lyric_Song"), F.lower(F.concat(F.lit(" "), "c_mktsegment")).alias("Quadrant"))
    return frames.aligned_pairs(rows)


@query("src21_cluster_plane", f"WITH {SONG} SELECT track_id AS song_id, cluster_id, {r('bv')} AS balanced_valence, {r('ba')} AS balanced_arousal FROM s")
def src21(spark, d):
    s = song(spark, d)
    ids = s.select(F.col("track_id").alias("identifier"), F.format_string("%d.0", F.col("cluster_id")).alias("cluster"))
    return rounded(frames.cluster_plane(ids, s.select(F.col("track_id").alias("song"), F.col("bv").alias("balanced_v"), F.col("ba").alias("balanced_a"))), "song_id", "cluster_id", "balanced_valence", "balanced_arousal")


@query("src22_tension_values", f"WITH {SONG} SELECT track_id AS song_id, tension_label, tension_label AS tension_name, {r('dv')} AS tension_dv, {r('da')} AS tension_da, {r('norm')} AS tension_norm FROM s")
def src22(spark, d):
    s = song(spark, d)
    return rounded(frames.tension_values(s.select("track_id", "tension_label"), s.select("track_id", "dv", "da", "norm")), "song_id", "tension_label", "tension_name", "tension_dv", "tension_da", "tension_norm")


_INTERP = f"{INTERPRET}, {_RAW.replace('raw AS', 'raw0 AS')}, ip AS (SELECT track_id AS song_id, title, artist, cluster_id, region_typicality, w_0, w_1, w_2, w_3, tension_name, CASE WHEN idx % 3 = 0 THEN NULL ELSE dv END AS dv, complexity, complexity_level, final_label, idx, bv, ba, da, tension_label FROM it WHERE idx % 5 <> 0)"
_FULL = f"""{_INTERP}, cs AS (SELECT track_id AS song_id, cluster_id, bv, ba FROM s WHERE idx % 2 = 0), ts AS (SELECT track_id AS song_id, tension_label, tension_name, dv, da, norm FROM s WHERE idx % 4 <> 0),
 rf0 AS (SELECT coalesce(ip.song_id, cs.song_id, ts.song_id) AS song_id, coalesce(trim(title), '') AS title, coalesce(trim(artist), '') AS artist, coalesce(ip.cluster_id, cs.cluster_id) AS cluster_id, cs.bv AS balanced_valence, cs.ba AS balanced_arousal, region_typicality, w_0, w_1, w_2, w_3,
  ts.tension_label, coalesce(ip.tension_name, ts.tension_name) AS tension_name, coalesce(ip.dv, ts.dv) AS tension_dv, ts.da AS tension_da, ts.norm AS tension_norm, complexity, complexity_level, final_label FROM ip FULL JOIN cs ON ip.song_id = cs.song_id FULL JOIN ts ON coalesce(ip.song_id, cs.song_id) = ts.song_id),
 rf1 AS (SELECT *, CASE cluster_id WHEN 0 THEN w_0 WHEN 1 THEN w_1 WHEN 2 THEN w_2 WHEN 3 THEN w_3 END AS own, list_max(list_filter([CASE WHEN cluster_id IS DISTINCT FROM 0 AND w_0 IS NOT NULL THEN w_0 END, CASE WHEN cluster_id IS DISTINCT FROM 1 THEN w_1 END, CASE WHEN cluster_id IS DISTINCT FROM 2 THEN w_2 END, CASE WHEN cluster_id IS DISTINCT FROM 3 THEN w_3 END], lambda x: x IS NOT NULL)) AS alt FROM rf0)"""


def _sources(spark, d):
    it, s = interpreted(spark, d), song(spark, d)
    told = it.filter("idx % 5 <> 0").select(
        "track_id", "title", "artist", "cluster_id", "region_typicality", *(F.col(f"w_{i}").alias(f"w_region_C{i}") for i in range(4)), "tension_name", F.when(F.col("idx") % 3 != 0, F.col("dv")).alias("dv"),
        F.col("complexity").alias("acs"), "complexity_level", F.col("final_label").alias("interpretation_label"),
    )
    return told, s.filter("idx % 2 = 0").select("track_id", "cluster_id", F.col("bv").alias("balanced_v"), F.col("ba").alias("balanced_a")), s.filter("idx % 4 <> 0").select("track_id", "tension_label", "tension_name", "dv", "da", "norm")


@query("src26_interpretation_frame", f"WITH {_INTERP} SELECT song_id, trim(title) AS title, cluster_id, {r('region_typicality')} AS region_typicality, {r('w_2')} AS \"w_region_C2\", {r('complexity')} AS affective_complexity_score, final_label AS final_interpretation_label FROM ip")
def src26(spark, d):
    return rounded(frames.interpretation_frame(_sources(spark, d)[0]), "song_id", "title", "cluster_id", "region_typicality", "w_region_C2", "affective_complexity_score", "final_interpretation_label")


_NAMED = "CASE cluster_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(REGIONS)) + " ELSE 'missing' END"


@query("rt01_rt02_retrieval_features", f"""WITH {_FULL}, rf2 AS (SELECT *, coalesce(tension_norm, sqrt(tension_dv*tension_dv + tension_da*tension_da)) AS nm FROM rf1), rf3 AS (SELECT *, CASE WHEN nm IS NOT NULL THEN cume_dist() OVER (PARTITION BY cluster_id, nm IS NULL ORDER BY nm) END AS pc FROM rf2)
 SELECT song_id, title, cluster_id, {_NAMED} AS cluster_name, {r('balanced_valence')} AS balanced_valence, {r('own')} AS region_confidence, {r('own - alt')} AS region_margin, CASE WHEN alt IS NULL THEN NULL ELSE {' '.join(f"CASE WHEN cluster_id IS DISTINCT FROM {i} AND w_{i} = alt THEN 'C{i} {n}' ELSE" for i, n in enumerate(REGIONS))} '' END END END END END AS nearest_alt_cluster,
  coalesce(tension_label, 'missing') AS tension_label, coalesce(tension_name, tension_label, 'missing') AS tension_name, {r('tension_dv')} AS tension_dv, {r('nm')} AS tension_norm, {r('pc')} AS tension_strength_percentile, coalesce(complexity_level, 'missing') AS complexity_level FROM rf3""")
def rt01(spark, d):
    features, _ = frames.retrieval_features(*_sources(spark, d))
    return rounded(features, "song_id", "title", "cluster_id", "cluster_name", "balanced_valence", "region_confidence", "region_margin", "nearest_alt_cluster", "tension_label", "tension_name", "tension_dv", "tension_norm", "tension_strength_percentile", "complexity_level")


@query("a23_rt01_missing_features", f"WITH {_FULL} SELECT unnest(['balanced_valence', 'region_typicality', 'tension_label', 'tension_dv', 'complexity_level']) AS feature, unnest([count(*) FILTER (balanced_valence IS NULL), count(*) FILTER (region_typicality IS NULL), count(*) FILTER (tension_label IS NULL), count(*) FILTER (tension_dv IS NULL), count(*) FILTER (complexity_level IS NULL)]) AS missing FROM rf1")
def a23(spark, d):
    features, _ = frames.retrieval_features(*_sources(spark, d))
    return frames.missing_features(features).filter(F.col("feature").isin("balanced_valence", "region_typicality", "tension_label", "tension_dv", "complexity_level"))


@query("set04_id_column", "SELECT 'identifier' AS chosen")
def set04(spark, d):
    t = tracks(spark, d)
    found = frames.id_column(t.select(F.col("track_id").alias("identifier"), F.col("idx").alias("song_id"), F.lit("x").alias("id")), t.select(F.col("track_id").alias("song_id")))
    return spark.createDataFrame([(found,)], "chosen string")


@query("pf22_pf23_typed_columns", "SELECT o_orderkey, o_custkey::INT AS whole, trim(o_orderpriority) AS words, o_totalprice::DOUBLE AS number FROM orders")
def pf22(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("a"), F.concat(F.lit(" "), "o_orderpriority").alias("b"), F.col("o_totalprice").cast("string").alias("c"))
    return frames.cluster_ids(frames.cluster_ids(o, "a", "whole"), "b", "words").select("o_orderkey", "whole", "words", frames.required_number("c", "c").alias("number"))


# ---------------------------------------------------------------- joins, splits and blocks


@query("j02_pairs_with_metadata", "SELECT o_orderkey, c_name, n_name, row_number() OVER (ORDER BY o_orderkey) - 1 AS pair_index FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_orderkey % 30")
def j02(spark, d):
    pairs = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 30).alias("n_nationkey"))
    met = pairs.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return joins.pair_index(met, "o_orderkey").select("o_orderkey", "c_name", "n_name", F.col("pair_index").cast("bigint").alias("pair_index"))


@query("j10_subtype_join", f"WITH {SONG} SELECT a.track_id, a.cluster_id, t.tension_label FROM s a LEFT JOIN (SELECT * FROM s WHERE idx % 3 <> 0) t ON a.track_id = t.track_id AND a.cluster_id = t.cluster_id")
def j10(spark, d):
    s = song(spark, d)
    return s.select("track_id", "cluster_id").join(s.filter("idx % 3 <> 0").select("track_id", "cluster_id", "tension_label"), ["track_id", "cluster_id"], "left")


_NEAR = "sqrt((u.bv-o.bv)*(u.bv-o.bv) + (u.ba-o.ba)*(u.ba-o.ba))"


@query("j17_impute_from_state", f"WITH {SONG}, n AS (SELECT u.idx, o.dv, row_number() OVER (PARTITION BY u.idx ORDER BY {_NEAR}, o.idx) AS k FROM s u, s o WHERE u.idx % 4 = 0 AND o.idx % 4 = 1) SELECT idx, {r('avg(dv)')} AS dv FROM n WHERE k <= 5 GROUP BY idx")
def j17(spark, d):
    s = song(spark, d).select("idx", "bv", "ba", "dv").withColumn("seen", F.col("idx") % 4 == 1)
    return rounded(neighbors.impute_from(s.filter("idx % 4 = 0"), s, ["bv", "ba"], ["dv"], "seen"), "idx", "dv")


_SPLIT = "CASE WHEN idx % 5 < 3 THEN 'train' WHEN idx % 5 = 3 THEN 'val' ELSE 'test' END"


def _splits(t):
    return t.select("idx", F.when(F.col("idx") % 5 < 3, "train").when(F.col("idx") % 5 == 3, "val").otherwise("test").alias("split"))


@query("j24_x48_split_rows", f"WITH {TRACKS} SELECT idx, label FROM t WHERE {_SPLIT} = 'val'")
def j24(spark, d):
    t = tracks(spark, d)
    return dataset.split_rows(t, _splits(t), "val").select("idx", "label")


@query("src31_assembled_split", f"WITH {TRACKS}, m AS (SELECT avg(av) AS m, stddev_pop(av) AS sd FROM t WHERE has_audio AND {_SPLIT} = 'train') SELECT idx, {r('CASE WHEN has_audio THEN av ELSE 0 END')} AS av, {r('CASE WHEN has_audio THEN (av - m) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END ELSE 0 END')} AS av_z FROM t, m WHERE {_SPLIT} = 'test'")
def src31(spark, d):
    t = tracks(spark, d)
    out = dataset.assemble(t, _splits(t), "test", {"audio": (["av", "aa"], "has_audio"), "lyrics": (["lv", "la"], "has_lyrics")})
    return rounded(out, "idx", "av", "av_z")


@query("a02_f22_block_scaling", f"WITH {TRACKS}, m AS (SELECT avg((av+lv)/2) FILTER (has_audio AND has_lyrics) AS x FROM t), f AS (SELECT idx, has_audio, has_lyrics, CASE WHEN has_audio AND has_lyrics THEN (av+lv)/2 WHEN has_audio THEN av WHEN has_lyrics THEN lv ELSE 0.5 END AS c, CASE WHEN has_audio AND has_lyrics THEN av - lv ELSE 0 END AS g FROM t), st AS (SELECT avg(g) FILTER (has_audio AND has_lyrics) AS gm, stddev_pop(g) FILTER (has_audio AND has_lyrics) AS gs, avg(c) FILTER (has_audio OR has_lyrics OR NOT (has_audio OR has_lyrics)) AS cm, stddev_pop(c) AS cs FROM f) SELECT idx, {r('(c - cm) / cs')} AS f0, {r('CASE WHEN has_audio AND has_lyrics THEN (g - gm) / gs ELSE 0 END')} AS f2 FROM f, st")
def a02(spark, d):
    of = strategies.build(tracks(spark, d), "balanced_va_diff")
    return rounded(strategies.scaled(of, "observed").df, "idx", "f0", "f2")


@query("f24_f28_weighted_features", f"WITH {TRACKS} SELECT idx, {r('2.5 * CASE WHEN has_audio AND has_lyrics THEN (av+lv)/2 WHEN has_audio THEN av WHEN has_lyrics THEN lv ELSE 0.5 END')} AS f0, {r('0.35 * CASE WHEN has_audio AND has_lyrics THEN av - lv ELSE 0 END')} AS f2 FROM t")
def f24(spark, d):
    return rounded(strategies.weighted(strategies.build(tracks(spark, d), "balanced_va_diff")).df, "idx", "f0", "f2")


@query("f26_x40_block_masks", f"WITH {TRACKS} SELECT idx, has_audio OR has_lyrics OR NOT (has_audio OR has_lyrics OR (has_audio AND has_lyrics)) AS b0, has_audio AND has_lyrics AS b1, has_audio OR NOT has_lyrics AS l0, has_lyrics AS l1 FROM t")
def f26(spark, d):
    b, l = strategies.block_masks("calibrated_va_tension"), strategies.block_masks("latent_two_view_va")
    return tracks(spark, d).select("idx", b[0].alias("b0"), b[1].alias("b1"), l[0].alias("l0"), l[1].alias("l1"))


_MEAN = "CASE WHEN has_audio AND has_lyrics THEN ({a}+{l})/2 WHEN has_audio THEN {a} WHEN has_lyrics THEN {l} ELSE 0.5 END"
_MV, _MA = _MEAN.format(a="av", l="lv"), _MEAN.format(a="aa", l="la")


@query("f23_x35_strategies", f"WITH {TRACKS} SELECT idx, {r(_MV)} AS mean_va, {r(f'CASE WHEN has_audio THEN av ELSE {_MV} END')} AS audio_va, {r(f'CASE WHEN has_lyrics THEN la ELSE {_MA} END')} AS lyrics_va, {r('ov')} AS original_va, {r(f'CASE WHEN has_lyrics THEN lv ELSE {_MV} END')} AS latent_two_view_va FROM t")
def f23(spark, d):
    t, out = tracks(spark, d), None
    for name, column in (("mean_va", "f0"), ("audio_va", "f0"), ("lyrics_va", "f1"), ("original_va", "f0"), ("latent_two_view_va", "f2")):
        one = strategies.build(t, name).df.select("idx", r6(column).alias(name))
        out = one if out is None else out.join(one, "idx")
    return out


@query("f32_raw_embeddings", f"WITH {TRACKS} SELECT idx, {r(_MV)} AS mean_v, {r('1.0 / 3')} AS gate_audio, {r('CASE WHEN has_audio AND has_lyrics THEN aa - la ELSE 0 END')} AS signed_a FROM t")
def f32(spark, d):
    return rounded(strategies.raw_embeddings(tracks(spark, d)), "idx", "mean_v", "gate_audio", "signed_a")


@query("f27_primary_plane", f"WITH {TRACKS} SELECT idx, {r(f'(CASE WHEN has_audio THEN av ELSE {_MV} END + CASE WHEN has_lyrics THEN lv ELSE {_MV} END) / 2')} AS v FROM t")
def f27(spark, d):
    of = strategies.build(tracks(spark, d), "latent_two_view_va")
    return of.df.select("idx", r6(strategies.primary_plane(of.strategy, of.columns)[0]).alias("v"))


_D2 = "(u.cv-o.cv)*(u.cv-o.cv) + (u.ca-o.ca)*(u.ca-o.ca)"


@query("f34_conflict_features", f"WITH {TRACKS}, g AS (SELECT idx, has_audio AND has_lyrics AS b, {_MV} AS cv, {_MA} AS ca, abs(av - lv) AS x FROM t), n AS (SELECT u.idx, o.x, row_number() OVER (PARTITION BY u.idx ORDER BY sqrt({_D2}), o.idx) AS k FROM g u, g o WHERE NOT u.b AND o.b) SELECT idx, {r('x')} AS abs_v FROM g WHERE b UNION ALL SELECT idx, {r('avg(x)')} FROM n WHERE k <= 5 GROUP BY idx")
def f34(spark, d):
    return rounded(strategies.conflict_features(tracks(spark, d)), "idx", "abs_v")


@query("f23_principal_components", f"WITH {TRACKS}, m AS (SELECT avg(av) AS a, avg(lv) AS b, var_pop(av) AS x, var_pop(lv) AS z, covar_pop(av, lv) AS y FROM t), e AS (SELECT *, (x + z) / 2 + sqrt((x-z)*(x-z)/4 + y*y) AS l FROM m), v AS (SELECT *, y / sqrt(y*y + (l-x)*(l-x)) AS p, (l - x) / sqrt(y*y + (l-x)*(l-x)) AS q FROM e) SELECT idx, {r('abs(p * (av - a) + q * (lv - b))')} AS p0 FROM t, v")
def f23p(spark, d):
    out, _ = strategies.principal(tracks(spark, d), ["av", "lv"], 1)
    return out.select("idx", r6(F.abs("p0")).alias("p0"))


@query("pf19_affective_features", "SELECT p_partkey, starts_with(p_type, 'STANDARD') OR contains(lower(p_type), 'tempo') OR contains(lower(p_type), 'mood') AS affective FROM part")
def pf19(spark, d):
    name = F.when(F.col("p_type").startswith("STANDARD"), F.concat(F.lit("Moods::"), "p_type")).otherwise(F.concat(F.lit("Genres::"), "p_type"))
    return table(spark, d, "part").select("p_partkey", strategies.affective(name).alias("affective"))


# ---------------------------------------------------------------- scores of searches

_M = "m AS (SELECT l_linenumber AS k, sum(l_quantity::DOUBLE) AS bic, avg(l_discount::DOUBLE) AS a, avg(l_tax::DOUBLE) AS b, stddev_pop(l_discount::DOUBLE) AS c, count(*) AS n, l_linenumber % 3 <> 0 AS ok, l_linenumber < 5 AS inside FROM lineitem GROUP BY l_linenumber)"
_NORM = "(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()))"


def _metrics(spark, d):
    q = lambda c: F.col(c).cast("double")
    m = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.sum(q("l_quantity")).alias("bic"), F.avg(q("l_discount")).alias("a"), F.avg(q("l_tax")).alias("b"), F.stddev_pop(q("l_discount")).alias("c"), F.count("*").alias("n"))
    return m.withColumns({"ok": F.col("k") % 3 != 0, "inside": F.col("k") < 5})


@query("k03_semantic_composite", f"WITH {_M} SELECT k, {r('0.25 * (1 - ' + _NORM.format(c='bic') + ') + 0.25 * ' + _NORM.format(c='a') + ' + 0.25 * least(1.0, n / 5000.0) + 0.25 * ' + _NORM.format(c='b') + ' - 0.25 * 0.5 * 0.3')} AS composite_score FROM m")
def k03(spark, d):
    m = _metrics(spark, d).withColumns({"silhouette": F.col("a"), "min_size": F.col("n"), "size_needed": F.lit(5000.0), "stability": F.col("b"), "mask_nmi": F.lit(0.1), "mask_purity": F.lit(0.2)})
    return rounded(selection.semantic_composite(m), "k", "composite_score")


_MM = "0.35 * a + 0.20 * b + 0.20 * c + 0.15 * a + 0.10 * least(1.0, b) - 0.10 * c - 0.25 * b"


@query("k05_macro_micro_score", f"WITH {_M} SELECT k, {r('0.35 * a + 0.25 * b + 0.25 * c - 0.25 * b')} AS open, {r(_MM)} AS gated FROM m")
def k05(spark, d):
    m = _metrics(spark, d).withColumns({"macro_silhouette": F.col("a"), "final_silhouette": F.col("b"), "seed_ari": F.col("c"), "purity_20": F.col("a"), "separation": F.col("b"), "negative": F.col("c"), "mask_nmi": F.col("b")})
    return m.select("k", r6(selection.macro_micro_score()).alias("open"), r6(selection.macro_micro_score(True)).alias("gated"))


@query("k05_bounded_choice", f"WITH {_M}, b AS (SELECT k, bic FROM m WHERE ok AND inside ORDER BY bic DESC, k LIMIT 1), u AS (SELECT k, bic FROM m WHERE ok ORDER BY bic DESC, k LIMIT 1) SELECT b.k, {r('b.bic')} AS bic, u.k AS best_unbounded_k, u.k <> b.k AS forced, {r('greatest(0.0, u.bic - b.bic)')} AS gap FROM b, u")
def k05b(spark, d):
    return rounded(selection.select_bounded(_metrics(spark, d).withColumn("k", F.col("k").cast("int")), "bic", ["ok"], "inside").withColumn("k", F.col("k").cast("int")), "k", "bic", "best_unbounded_k", "forced", "gap")


@query("k07_latent_score", f"WITH {_M} SELECT k, {r('0.35 * (1 - ' + _NORM.format(c='bic') + ') + 0.20 * ' + _NORM.format(c='a') + ' + 0.15 * ' + _NORM.format(c='b') + ' + 0.15 * a + 0.10 * least(1.0, b) + 0.05 * ' + _NORM.format(c='c') + ' - 0.05 * c')} AS score FROM m")
def k07(spark, d):
    m = _metrics(spark, d).withColumns({"icl": F.col("bic"), "silhouette": F.col("a"), "seed_ari": F.col("b"), "purity_20": F.col("a"), "separation": F.col("b"), "margin": F.col("c"), "negative": F.col("c")})
    return m.select("k", r6(selection.latent_score()).alias("score"))


@query("k08_lowest_bic", f"WITH {_M} SELECT k, {r('-bic')} AS score, false AS overridden FROM m WHERE ok ORDER BY bic, k LIMIT 1")
def k08(spark, d):
    m = _metrics(spark, d).withColumn("score", -F.col("bic"))
    return rounded(selection.select_k(m, "score", "ok"), "k", "score", "overridden")


@query("o08_k16_diagnostic_choice", f"WITH {_M} SELECT k, {r('a')} AS a, true AS overridden FROM m WHERE inside ORDER BY a DESC, k LIMIT 1")
def o08(spark, d):
    return rounded(selection.select_k(_metrics(spark, d).withColumn("never", F.lit(False)), "a", "never", True, "inside"), "k", "a", "overridden")


@query("w07_elbow_and_fallback", f"WITH {_M}, e AS (SELECT k, lead(bic) OVER (ORDER BY k) - 2 * bic + lag(bic) OVER (ORDER BY k) AS bend FROM m) SELECT 'all' AS part, (SELECT k FROM e WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1) AS k UNION ALL SELECT 'two', (SELECT k FROM m WHERE k < 3 ORDER BY bic, k LIMIT 1)")
def w07(spark, d):
    m = _metrics(spark, d)
    return selection.elbow(m).select(F.lit("all").alias("part"), "k").union(selection.elbow(m.filter("k < 3")).select(F.lit("two"), "k"))


@query("w12_posterior_margin", f"WITH {TRACKS}, m AS (SELECT list_sort([av, aa, lv, la], 'DESC') AS p FROM t) SELECT {r('avg(p[1] - p[2])')} AS margin FROM m")
def w12(spark, d):
    return tracks(spark, d).agg(r6(F.avg(selection.posterior_margin(F.array("av", "aa", "lv", "la")))).alias("margin"))


@query("w11_canonical_order_of_rows", f"WITH {SONG}, g AS (SELECT cluster_id, row_number() OVER (ORDER BY avg(norm), atan2(avg(da), avg(dv)), cluster_id) - 1 AS ordinal FROM s GROUP BY cluster_id) SELECT idx, ordinal::INT AS ordinal FROM s JOIN g USING (cluster_id)")
def w11(spark, d):
    return selection.canonical_order(song(spark, d), "cluster_id", "norm", "dv", "da").select("idx", F.col("ordinal").cast("int").alias("ordinal"))


@query("f08_x18_alpha_grid", "SELECT round(0.20::DOUBLE + 0.05::DOUBLE * i, 10) AS alpha FROM range(15) t(i)")
def f08(spark, d):
    return spark.createDataFrame([(a,) for a in search.alpha_grid()], "alpha double")


# ---------------------------------------------------------------- losses and targets

_Q3 = "q3 AS (SELECT idx, [av / (av + aa + lv), aa / (av + aa + lv), lv / (av + aa + lv)] AS q, [la / (la + av + aa), av / (la + av + aa), aa / (la + av + aa)] AS p, has_audio, av, la FROM t)"


def _q3(spark, d):
    share = lambda a, b, c: F.array(*(F.col(x) / (F.col(a) + F.col(b) + F.col(c)) for x in (a, b, c)))
    return tracks(spark, d).withColumns({"q": share("av", "aa", "lv"), "p": share("la", "av", "aa")})


@query("r05_target_distribution", f"WITH {TRACKS}, {_Q3}, f AS (SELECT sum(q[1]) AS x, sum(q[2]) AS y, sum(q[3]) AS z FROM q3), s AS (SELECT idx, q[1]*q[1]/x AS a, q[2]*q[2]/y AS b, q[3]*q[3]/z AS c FROM q3, f) SELECT idx, {r('a / (a + b + c)')} AS t0, {r('c / (a + b + c)')} AS t2 FROM s")
def r05(spark, d):
    out = training.target_distribution(_q3(spark, d), "q", 3)
    return out.select("idx", r6(F.col("target")[0]).alias("t0"), r6(F.col("target")[2]).alias("t2"))


@query("r06_soft_assignment", f"WITH {TRACKS}, d AS (SELECT idx, -((av-0.3)*(av-0.3) + (aa-0.3)*(aa-0.3)) / 0.5 AS x, -((av-0.7)*(av-0.7) + (aa-0.7)*(aa-0.7)) / 0.5 AS y FROM t) SELECT idx, {r('exp(x) / (exp(x) + exp(y))')} AS q0 FROM d")
def r06(spark, d):
    q = training.soft_assignment(["av", "aa"], [[0.3, 0.3], [0.7, 0.7]], 0.5)
    return tracks(spark, d).select("idx", r6(q[0]).alias("q0"))


@query("x42_x53_divergence", f"WITH {TRACKS}, {_Q3} SELECT idx, {r('q[1] * (ln(q[1]) - ln(p[1])) + q[2] * (ln(q[2]) - ln(p[2])) + q[3] * (ln(q[3]) - ln(p[3]))')} AS kl, {r('ln(exp(q[1]) + exp(q[2]) + exp(q[3]))')} AS lse FROM q3 WHERE least(q[1], q[2], q[3], p[1], p[2], p[3]) > 1e-6")
def x53(spark, d):
    rows = _q3(spark, d).filter((F.array_min("q") > 1e-6) & (F.array_min("p") > 1e-6))
    return rows.select("idx", r6(training.divergence(F.col("q"), F.col("p"))).alias("kl"), r6(training.log_sum_exp(F.col("q"))).alias("lse"))


@query("x51_masked_losses", f"WITH {TRACKS}, {_Q3} SELECT {r('sum(CASE WHEN has_audio THEN av ELSE 0 END) / greatest(count(*) FILTER (has_audio), 1)')} AS mean, {r('avg(((q[1]-p[1])*(q[1]-p[1]) + (q[2]-p[2])*(q[2]-p[2]) + (q[3]-p[3])*(q[3]-p[3])) / 3) FILTER (has_audio)')} AS mse, {r('avg(2 * (la >= 0.5)::INT * ln(1 + exp(-av)) + (1 - (la >= 0.5)::INT) * (av + ln(1 + exp(-av)))) FILTER (has_audio)')} AS bce FROM q3")
def x51(spark, d):
    m, y = F.col("has_audio"), (F.col("la") >= 0.5).cast("int")
    return _q3(spark, d).agg(r6(training.masked_mean(F.col("av"), m)).alias("mean"), r6(training.masked_square_error(F.col("q"), F.col("p"), m)).alias("mse"), r6(training.masked_cross_entropy(F.col("av"), y, m, 2.0)).alias("bce"))


@query("x52_gate_balance", f"WITH {TRACKS}, g AS (SELECT avg(av / (av + aa)) AS x, avg(aa / (av + aa)) AS y, avg(has_audio::INT / greatest(has_audio::INT + has_lyrics::INT, 1)) AS u, avg(has_lyrics::INT / greatest(has_audio::INT + has_lyrics::INT, 1)) AS w FROM t) SELECT {r('x * (ln(x) - ln(u)) + y * (ln(y) - ln(w))')} AS loss FROM g")
def x52(spark, d):
    t = tracks(spark, d).withColumns({"g0": F.col("av") / (F.col("av") + F.col("aa")), "g1": F.col("aa") / (F.col("av") + F.col("aa"))})
    return rounded(training.gate_balance(t, ["g0", "g1"], ["has_audio", "has_lyrics"]), "loss")


@query("a31_weighted_moments", f"WITH {TRACKS}, {_Q3}, e AS (SELECT unnest([0, 1, 2]) AS component, unnest(q) AS r, la FROM q3) SELECT component, {r('sum(r)')} AS mass, {r('sum(r * la) / sum(r)')} AS la_mean, {r('sum(r * la * la) / sum(r) - (sum(r * la) / sum(r)) * (sum(r * la) / sum(r))')} AS la_var FROM e GROUP BY component")
def a31(spark, d):
    return rounded(training.weighted_moments(_q3(spark, d), "q", ["la"]), "component", "mass", "la_mean", "la_var")


# ---------------------------------------------------------------- reports

_HINT = "CASE WHEN cluster_id = 2 AND lower(trim(title)) IN ('born in the u.s.a.', 'price you pay', 'give me it', 'maimed and slaughtered', 'room 13') THEN 1 ELSE 0 END"
_REGION_ORDER = f"{_HINT} DESC, round(region_typicality, 9) DESC, round(region_confidence, 9) DESC, round(tension_percentile, 9) DESC, idx"
_TENSION_ORDER = "round(tension_percentile, 9) DESC, round(tension_typicality, 9) DESC, round(region_confidence, 9) DESC, idx"


@query("o02_region_ranking", f"WITH {FLAGS} SELECT cluster_id, idx, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_REGION_ORDER}) AS place FROM fl) WHERE place <= 3")
def o02(spark, d):
    out = reports.top_rows(flagged(spark, d), ["cluster_id"], 3, *reports.region_order())
    return out.select("cluster_id", "idx", F.col("place").cast("bigint").alias("place"))


@query("o03_tension_ranking", f"WITH {FLAGS} SELECT cluster_id, idx, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_TENSION_ORDER}) AS place FROM fl) WHERE place <= 2")
def o03(spark, d):
    out = reports.top_rows(flagged(spark, d), ["cluster_id"], 2, *reports.tension_order())
    return out.select("cluster_id", "idx", F.col("place").cast("bigint").alias("place"))


@query("o04_final_candidates", f"WITH {FLAGS}, sf AS (SELECT * FROM fl WHERE main_text_eligible), a AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_REGION_ORDER}) AS k FROM sf WHERE region_role IN ('prototype', 'representative')), b AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {_TENSION_ORDER}) AS k FROM sf WHERE selected_role = 'tension_case' AND idx NOT IN (SELECT idx FROM a WHERE k <= 3)) SELECT cluster_id, idx, 'region_candidate' AS final_role, k AS final_rank FROM a WHERE k <= 3 UNION ALL SELECT cluster_id, idx, 'tension_case', k FROM b WHERE k <= 2")
def o04(spark, d):
    return reports.final_candidates(flagged(spark, d)).select("cluster_id", "idx", "final_role", F.col("final_rank").cast("bigint").alias("final_rank"))


@query("o05_boundary_rows", f"WITH {FLAGS}, b AS (SELECT cluster_id, idx, row_number() OVER (PARTITION BY cluster_id ORDER BY round(region_margin, 9), round(region_confidence, 9) DESC, idx) AS k FROM fl WHERE selected_role = 'boundary_case') SELECT cluster_id, idx FROM b WHERE k = 1")
def o05(spark, d):
    return reports.boundary_rows(flagged(spark, d)).select("cluster_id", "idx")


@query("pf16_x10_roles", f"WITH {FLAGS} SELECT track_id, selected_role FROM fl WHERE selected_role IN ('tension_case', 'boundary_case')")
def pf16(spark, d):
    return reports.display_columns(reports.with_role(flagged(spark, d), ["tension_case", "boundary_case"]), ["track_id", "absent", "selected_role"])


@query("o12_o13_top_rows", f"WITH {FLAGS} SELECT cluster_id, tension_label, idx, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, tension_label ORDER BY round(tension_typicality, 9) DESC, idx) AS k FROM fl) WHERE k <= 10")
def o12(spark, d):
    out = reports.top_rows(flagged(spark, d), ["cluster_id", "tension_label"], 10, F.desc(F.round("tension_typicality", 9)), "idx")
    return out.select("cluster_id", "tension_label", "idx", F.col("place").cast("bigint").alias("place"))


@query("o13_first_rows", f"WITH {SONG} SELECT cluster_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY idx) AS k FROM s) WHERE k <= 8")
def o13(spark, d):
    return reports.top_rows(song(spark, d), ["cluster_id"], 8, "idx").select("cluster_id", "idx")


_TESTS = "ts AS (SELECT o_orderstatus AS g, o_orderpriority AS token, count(*) AS support, avg(o_totalprice::DOUBLE) AS enrichment, (count(*) % 7) / 10.0 AS p, (count(*) % 3) / 10.0 AS q FROM orders GROUP BY ALL)"


@query("o07_token_ranking", f"WITH {_TESTS} SELECT g, token, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(q, 12), round(p, 12), round(enrichment, 9) DESC, support DESC, token) AS k FROM ts) WHERE k <= 10")
def o07(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("token")).agg(F.count("*").alias("support"), F.avg(F.col("o_totalprice").cast("double")).alias("enrichment"))
    t = t.withColumns({"p": F.col("support") % 7 / 10.0, "q": F.col("support") % 3 / 10.0})
    return reports.token_ranking(t, "g").select("g", "token", F.col("place").cast("bigint").alias("place"))


@query("a21_a22_label_counts", "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS rows FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a21(spark, d):
    return reports.label_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("a23_missing_by_column", "SELECT unnest(['lang', 'text']) AS \"column\", unnest([count(*) FILTER (lang IS NULL OR trim(lang) IN ('', 'missing')), count(*) FILTER (text IS NULL OR trim(text, ' ') IN ('', 'missing'))]) AS missing FROM documents")
def a23c(spark, d):
    return reports.missing_counts(table(spark, d, "documents"), ["lang", "text"])


_DIRECTION = "regexp_matches(lower(final_label), 'lift|amplif|reframed|uplift|intensif|soften|temper')"


@query("a22_i15_sanity", f"WITH {INTERPRET} SELECT count(*) AS total, count(*) FILTER (mixture_type = 'boundary_blend') AS boundary_blend, count(*) FILTER (complexity_level = 'highly complex / ambivalent') AS high_complexity, count(*) FILTER (tension_level = 'low' AND {_DIRECTION}) AS low_tension_violations, count(*) FILTER (regexp_matches(lower(tension_name), 'consistent|concordant|agreement|aligned') AND tension_percentile < 0.25 AND {_DIRECTION}) AS consistent_violations FROM it")
def a22(spark, d):
    return reports.interpretation_sanity(interpreted(spark, d))


@query("a20_weighted_ratios_of_groups", "WITH g AS (SELECT o_orderstatus, count(*) AS n, avg((o_orderpriority < '3')::INT) AS q FROM orders GROUP BY ALL) SELECT round(sum(q * n) / sum(n), 6) + 0.0 AS weighted, round(min(q), 6) + 0.0 AS minimum, round(sum(CASE WHEN q < 0.4 THEN n ELSE 0 END) / sum(n), 6) + 0.0 AS mixed FROM g")
def a20(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg((F.col("o_orderpriority") < "3").cast("int")).alias("q"))
    return rounded(reports.weighted_ratios(g, "q", "n", 0.4), "weighted", "minimum", "mixed")


@query("a26_run_means", f"WITH {SONG} SELECT 'Dataset-S' AS dataset, count(*) AS rows, {r('avg(dv)')} AS dv_mean, NULL::DOUBLE AS absent_mean FROM s WHERE idx % 2 = 0 UNION ALL SELECT 'Dataset-L', count(*), {r('avg(dv)')}, NULL FROM s WHERE idx % 2 = 1")
def a26(spark, d):
    s = song(spark, d)
    return rounded(reports.run_means({"Dataset-S": s.filter("idx % 2 = 0"), "Dataset-L": s.filter("idx % 2 = 1")}, ["dv", "absent"]), "dataset", "rows", "dv_mean", "absent_mean")


_TOKENS = "tk AS (SELECT DISTINCT idx, unnest(string_split(genres, ' ')) AS token FROM s WHERE genres <> '')"


def _tokens(spark, d):
    return song(spark, d).filter("genres <> ''").select("idx", F.explode(F.split("genres", " ")).alias("token")).distinct()


@query("a30_top_tokens", f"WITH {SONG}, {_TOKENS}, n AS (SELECT cluster_id, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT cluster_id, token, count(*) / max(n) AS mean FROM tk JOIN s USING (idx) JOIN n USING (cluster_id) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY mean DESC, token) AS place FROM m) SELECT cluster_id, string_agg(token, ', ' ORDER BY place) AS top_tokens FROM k WHERE place <= 5 GROUP BY cluster_id")
def a30(spark, d):
    return micro.top_tokens(song(spark, d).select("idx", "cluster_id"), _tokens(spark, d), ["cluster_id"])


@query("a29_completeness", f"WITH {SONG} SELECT idx, {r('((title <> $$$$)::INT + (artist <> $$$$)::INT) / 3.0')} AS completeness FROM s")
def a29(spark, d):
    s = song(spark, d)
    tokens = s.select("idx", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("token")) for c in ("title", "artist")))).alias("v")).select("idx", "v.*").filter("token <> ''")
    return rounded(reports.completeness(tokens, s, ["title", "artist", "moods"]), "idx", "completeness")


@query("s15_x03_region_tokens", "SELECT c_custkey, (c_nationkey % 4)::INT AS named, CASE WHEN c_custkey % 2 = 0 THEN (c_nationkey % 4)::INT END AS coded, 'C' || (c_nationkey % 4) AS token FROM customer")
def s15(spark, d):
    n = (F.col("c_nationkey") % 4).cast("int")
    name = F.get(F.array(*map(F.lit, REGIONS)), n)
    return table(spark, d, "customer").select("c_custkey", reports.region_in_text(F.concat(F.lit("near "), F.upper(name))).alias("named"), reports.region_in_text(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("c"), n, F.lit(" x"))).otherwise("none")).alias("coded"), reports.cluster_token(F.concat(F.lit("C"), n)).alias("token"))


@query("s29_directions", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 3 = 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS dv FROM orders")
def s29(spark, d):
    word = F.when(F.col("o_orderkey") % 3 == 0, " Positive").when(F.col("o_orderkey") % 3 == 1, "-").otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", reports.direction(word, F.lit(""))[0].alias("dv"))


@query("i13_nearest_alternative", f"WITH {FLAGS} SELECT idx, CASE WHEN idx % 2 = 0 THEN 3 WHEN greatest(CASE WHEN cluster_id <> 0 THEN w_0 ELSE -1 END, CASE WHEN cluster_id <> 1 THEN w_1 ELSE -1 END, CASE WHEN cluster_id <> 2 THEN w_2 ELSE -1 END, CASE WHEN cluster_id <> 3 THEN w_3 ELSE -1 END) = w_0 AND cluster_id <> 0 THEN 0 WHEN greatest(CASE WHEN cluster_id <> 1 THEN w_1 ELSE -1 END, CASE WHEN cluster_id <> 2 THEN w_2 ELSE -1 END, CASE WHEN cluster_id <> 3 THEN w_3 ELSE -1 END) = w_1 AND cluster_id <> 1 THEN 1 WHEN greatest(CASE WHEN cluster_id <> 2 THEN w_2 ELSE -1 END, CASE WHEN cluster_id <> 3 THEN w_3 ELSE -1 END) = w_2 AND cluster_id <> 2 THEN 2 ELSE 3 END AS alternative FROM fl")
def i13(spark, d):
    f = flagged(spark, d).withColumn("told", F.when(F.col("idx") % 2 == 0, "Playful vitality").otherwise("unknown"))
    return f.select("idx", reports.nearest_alternative("told", "cluster_id", [f"w_{i}" for i in range(4)]).alias("alternative"))


@query("x30_track_text", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand || ' - ' || p_name WHEN p_partkey % 4 = 1 THEN p_name WHEN p_partkey % 4 = 2 THEN p_brand || ' - ' || p_partkey ELSE p_type END AS track FROM part")
def x30(spark, d):
    n = F.col("p_partkey") % 4
    return table(spark, d, "part").select("p_partkey", reports.track_text(F.when(n < 2, F.col("p_name")), F.when((n == 0) | (n == 2), F.col("p_brand")).otherwise("nan"), F.when(n != 3, F.col("p_partkey")), F.col("p_type")).alias("track"))


@query("x06_x07_x09_descriptor_rules", "SELECT o_custkey, max(o_totalprice::DOUBLE) AS weight, o_orderstatus AS descriptor FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL")
def x06(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("descriptor"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("double")).otherwise(-1.0).alias("weight"))
    return reports.merge_weights(rows, "o_custkey")


@query("x14_set05_flags", "SELECT o_orderkey, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS issue, o_orderkey % 5 = 0 AS conflict FROM orders")
def x14(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("0").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "true").alias("b"))
    name = F.when(F.col("o_orderkey") % 5 == 0, "Modality-Consistent").otherwise("x")
    return o.select("o_orderkey", reports.issue_flag("a", "b").alias("issue"), reports.directional_conflict(name, F.array(F.lit("calm"), F.lit("uplift")), ["uplift", "softening"]).alias("conflict"))


@query("x08_score_bounds", "SELECT min(l_tax::DOUBLE) AS low, greatest(max(l_tax::DOUBLE), max(l_discount::DOUBLE)) AS high FROM lineitem")
def x08(spark, d):
    return reports.score_bounds(table(spark, d, "lineitem").select(F.array(F.col("l_tax").cast("double"), F.col("l_discount").cast("double")).alias("s")), "s")


@query("x18_x20_selected_row", f"WITH {_M} SELECT k, {r('a')} AS a FROM m WHERE k = 4")
def x18(spark, d):
    return rounded(reports.selected_row(_metrics(spark, d).withColumn("total_clusters", F.col("k") + 20), 4), "k", "a")


@query("au13_x21_first_score", f"WITH {_M} SELECT k, {r('CASE WHEN k % 2 = 0 THEN a ELSE b END')} AS score FROM m")
def au13(spark, d):
    m = _metrics(spark, d).withColumns({"macro_micro_score": F.when(F.col("k") % 2 == 0, F.col("a")), "silhouette": F.col("b")})
    return m.select("k", r6(reports.score_of(m.columns)).alias("score"))


@query("x23_policy_text", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'report_only:weight=0.5' ELSE 'report_only' END AS policy FROM customer")
def x23(spark, d):
    return table(spark, d, "customer").select("c_custkey", reports.policy_text(F.lit("report_only"), F.when(F.col("c_custkey") % 2 == 0, 0.5)).alias("policy"))


@query("x28_token_statistics", "SELECT g, string_agg('Moods::' || token || '(n=' || support || ',N=' || support * 2 || ',q=0.250)', '; ' ORDER BY token) AS told FROM (SELECT o_orderstatus AS g, o_orderpriority AS token, count(*) AS support FROM orders GROUP BY ALL) GROUP BY g")
def x28(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("token")).agg(F.count("*").alias("support"))
    one = F.struct("token", F.lit("Moods").alias("field"), "support", (F.col("support") * 2).alias("global_support"), F.lit(0.25).alias("q"))
    return t.groupBy("g").agg(micro.token_statistics(F.sort_array(F.collect_list(one))).alias("told"))


@query("x31_label_names", "SELECT n_nationkey, map([n_nationkey::INT], [n_name])[n_nationkey::INT] AS name FROM nation")
def x31(spark, d):
    names = F.map_from_arrays(F.array(F.col("n_nationkey").cast("string"), F.lit("bad")), F.array("n_name", F.lit("x")))
    return table(spark, d, "nation").select("n_nationkey", reports.label_names(names)[F.col("n_nationkey").cast("int")].alias("name"))


@query("x16_x24_mask_enrichment", f"WITH {TRACKS}, p AS (SELECT cluster_id, has_audio, count(*) AS n FROM t GROUP BY ALL) SELECT {r('max(n)::DOUBLE')} AS max_enrichment FROM p")
def x16(spark, d):
    return rounded(audit.mask_enrichment(tracks(spark, d).groupBy("cluster_id", "has_audio").agg(F.count("*").cast("double").alias("enrichment"))), "max_enrichment")


@query("x32_overlap_row", f"WITH {_M} SELECT {r('a')} AS va_silhouette, {r('b')} AS knn_purity_20, NULL::DOUBLE AS center_radius_sep, {r('c')} AS negative_silhouette_fraction, true AS overlap_gate FROM m WHERE k = 1")
def x32(spark, d):
    m = _metrics(spark, d).filter("k = 1").select(F.col("a").alias("va_mean_silhouette"), F.col("b").alias("va_knn_purity_20"), F.col("c").alias("va_negative_silhouette_fraction"), F.lit("True").alias("overlap_gate_ok"))
    return rounded(reports.overlap_row(m), "va_silhouette", "knn_purity_20", "center_radius_sep", "negative_silhouette_fraction", "overlap_gate")


@query("au04_overlap_by_split", f"WITH {_M} SELECT k, ok OR (a >= 0.88 AND b >= 0.70 AND c <= 0.05) AS passed FROM m")
def au04(spark, d):
    m = _metrics(spark, d).select("k", F.col("ok").alias("overlap_gate_ok"), F.col("a").alias("va_knn_purity_20"), F.col("b").alias("va_center_radius_sep"), F.col("c").alias("va_negative_silhouette_fraction"))
    return m.select("k", audit.overlap_ok().alias("passed"))


@query("au08_metadata_unused", "SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS unused FROM orders")
def au08(spark, d):
    k = F.col("o_orderkey")
    policy = F.when(k % 2 == 0, "Report_Only").otherwise("all_metadata_upper_bound")
    return table(spark, d, "orders").select("o_orderkey", audit.metadata_unused(policy, F.lit(0.0), F.when(k % 3 == 0, True)).alias("unused"))


@query("au06_au09_ablation_coverage", "SELECT ['z'] AS missing, ['b'] AS failed, 0.5::DOUBLE AS main_score, ['c'] AS not_improved, false AS ok")
def au06(spark, d):
    b = spark.createDataFrame([("a", "ok", 0.5), ("b", "failed", 0.1), ("c", "ok", 0.7)], "config string, status string, claim_score double")
    return audit.ablation_coverage(b, b.limit(0), ["a", "b", "c", "z"], "a")


@query("au14_compare_runs", f"WITH {SONG}, a AS (SELECT cluster_id, avg(bv) AS v, avg(ba) AS a FROM s GROUP BY cluster_id) SELECT cluster_id::INT AS left_id, cluster_id::INT AS right_id, 0.0::DOUBLE AS center_distance, false AS extra FROM a")
def au14(spark, d):
    regions = song(spark, d).groupBy("cluster_id").agg(F.avg("bv").alias("balanced_valence"), F.avg("ba").alias("balanced_arousal"))
    return rounded(reports.compare_runs({"regions": regions}, {"regions": regions})["alignment"], "left_id", "right_id", "center_distance", "extra")


def _p10_sql() -> str:
    """The templates in SQL: phrases by CASE, numbers by printf."""
    t, out = templates, []
    agreeing = "regexp_matches(lower(tension_label || ' ' || tension_name), 'consistent|concordant|agreement|aligned')"
    allowed = f"tension_percentile >= 0.35 AND (NOT {agreeing} OR (tension_percentile >= 0.60 AND greatest(abs_dv_percentile, abs_da_percentile) >= 0.75))"
    name = lambda c: f"CASE {c} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(REGIONS)) + " END"
    share = lambda c: f"printf('%.1f%%', {c} * 100)"
    q = lambda text: "$$" + text + "$$"
    for i, template in enumerate((t.CHINESE, t.ENGLISH)):
        near = f"'C' || nearest_alt || ' ' || {name('nearest_alt')}"
        margin = "CASE " + " ".join(f"WHEN region_margin >= {m[0]} THEN replace({q(m[1 + i])}, '{{0}}', {near})" for m in t.MARGINS) + f" ELSE replace({q(t.NEGATIVE[i])}, '{{0}}', {near}) END"
        role = "CASE region_role " + " ".join(f"WHEN '{k}' THEN {q(v[i])}" for k, v in t.ROLES.items()) + " END"
        sign = lambda c, texts: f"CASE WHEN {c} > 1e-8 THEN {q(texts[0][i])} WHEN {c} < -1e-8 THEN {q(texts[1][i])} ELSE {q(texts[2][i])} END"  # noqa: E731, B023
        way = f"CASE WHEN {allowed} THEN {sign('dv', t.VALENCE)} || {q(t.BETWEEN[i])} || {sign('da', t.AROUSAL)} WHEN tension_percentile < 0.35 THEN {q(t.WEAK[i])} ELSE {q(t.AGREEING[i])} END"
        values = [name("cluster_id"), role, share("region_typicality"), share("region_confidence"), margin, "printf('%.3f', region_margin)", "tension_label || ' / ' || tension_name", share("tension_percentile"), way, "'rhythm'"]
        pieces = template.replace("%.3f", "%s").split("%s")
        out.append(" || ".join(x for pair in zip([q(p) for p in pieces], [f"({v})" for v in values] + ["''"]) for x in pair))
    return f"WITH {FLAGS} SELECT track_id, {out[0]} AS chinese_interpretation, {out[1]} AS english_interpretation FROM fl"


@query("p10_interpretations", _p10_sql())
def p10(spark, d):
    f = flagged(spark, d)
    one = f.select("track_id", F.lit("rhythm").alias("descriptor"), F.lit(1).alias("place"))
    return templates.interpretations(f, one, "track_id").select("track_id", "chinese_interpretation", "english_interpretation")


# ---------------------------------------------------------------- estimators, searches and whole runs: no SQL


def _small(**more) -> search.Config:
    return search.Config(**({"k_min": 2, "k_max": 4, "least": 5, "runs": 3, "starts": 3, "macro_min": 2, "macro_max": 3} | more))


def _features(spark, d, strategy: str) -> strategies.Features:
    seen = tracks(spark, d).filter("has_audio or has_lyrics") if strategy == "latent_two_view_va" else tracks(spark, d)
    built = strategies.build(stored(seen, "tracks"), strategy)
    built.df = stored(built.df, "features")
    return built


def _data(spark, d, strategy: str) -> search.Table:
    return runs.table_of(_features(spark, d, strategy))


@query("k01_k02_k15_composite_search")
def k01(spark, d):
    return search.search(spark, _data(spark, d, "mean_va"), "composite", _small()).metrics


@query("k04_k11_masked_search")
def k04(spark, d):
    return search.search(spark, _data(spark, d, "balanced_va_diff"), "semantic_composite", _small()).metrics


@query("k05_k14_c13_c14_macro_micro_search")
def k05s(spark, d):
    return search.search(spark, _data(spark, d, "calibrated_va_tension"), "macro_micro", _small(k_max=20, micro_effect=0.1)).metrics


@query("k07_k13_c12_latent_search")
def k07s(spark, d):
    return search.search(spark, _data(spark, d, "latent_two_view_va"), "latent_va_gmm", _small()).metrics


@query("k06_k12_balanced_search")
def k06s(spark, d):
    return search.search(spark, _data(spark, d, "mean_va"), "balanced_va_regions", _small()).metrics


@query("k08_bic_search")
def k08s(spark, d):
    return search.search(spark, _data(spark, d, "mean_va"), "bic_only", _small(runs=1)).metrics


@query("c15_hierarchical_labels")
def c15(spark, d):
    features = _features(spark, d, "mean_va")
    found = search.search(spark, runs.table_of(features), "hierarchical", _small())
    names = F.array(*map(F.lit, found.info["label_names"]))
    return runs.labels_of(features, found).select("idx", "cluster_id", names[F.col("cluster_id")].alias("name"))


@query("c12_latent_labels")
def c12(spark, d):
    features = _features(spark, d, "latent_two_view_va")
    found = search.search(spark, runs.table_of(features), "latent_va_gmm", _small())
    return runs.labels_of(features, found).select("idx", "cluster_id")


@query("c13_two_level_labels")
def c13(spark, d):
    features = _features(spark, d, "calibrated_va_tension")
    found = search.search(spark, runs.table_of(features), "macro_micro", _small(k_max=20))
    names = F.array(*map(F.lit, found.model.names))
    return runs.labels_of(features, found).select("idx", "cluster_id", names[F.col("cluster_id")].alias("name"))


@query("c05_c07_c16_kmeans")
def c05(spark, d):
    found = search.kmeans_regions(_data(spark, d, "mean_va"), 4)
    return spark.createDataFrame([(i, *map(float, c), int(n)) for i, (c, n) in enumerate(zip(*found))], "cluster_id int, v double, a double, size long")


@query("c09_robust_mixture")
def c09(spark, d):
    m = search.robust_mixture(_data(spark, d, "mean_va"), 3)
    return search.as_rows(spark, m.attempts)


@query("c11_imputed_mixture")
def c11(spark, d):
    features = _features(spark, d, "balanced_va_diff")
    m = search.imputed_mixture(runs.table_of(features), 3)
    return runs.labels_of(features, search.Found(3, m, None)).select("idx", F.col("cluster_id").alias("component"))


@query("m05_m12_sampled_silhouette")
def m05(spark, d):
    return neighbors.sampled_silhouette(song(spark, d), ["bv", "ba"], "cluster_id", limit=200, above=200)


@query("f10_f11_alpha_search")
def f10(spark, d):
    return search.learn_alpha(spark, _data(spark, d, "mean_va"), [0.3, 0.5, 0.7], range(4, 6))[1]


def _tension(spark, d):
    """Songs are stored, as a probe reads them several times: each would merge in the parts anew."""
    return micro.tension_rows(stored(song(spark, d), "songs"))


@query("c17_st02_st03_tension_probe")
def st02(spark, d):
    rows, _ = _tension(spark, d)
    return micro.probe(rows, least=10, silhouette=0.0)[1]


@query("st03_st08_micro_labels")
def st03(spark, d):
    rows, _ = _tension(spark, d)
    return micro.probe(rows, least=10, silhouette=0.0)[2].select("idx", "cluster_id", "micro_id", "micro_label")


@query("st05_a25_substructure")
def st05(spark, d):
    rows, _ = _tension(spark, d)
    return micro.substructure(micro.probe(rows, least=10, silhouette=0.0)[2], tokens=_tokens(spark, d))[0]


@query("run_region_discovery")
def discovery_run(spark, d):
    run = runs.discover_regions(tracks(spark, d), config=_small())
    return run.rows.select("idx", "cluster_id", "micro_label", "subtype_label")


@query("rt17_retrieval_run")
def rt17(spark, d):
    out = runs.run_retrieval(*_sources(spark, d))
    return out["rankings"].select("query_id", "system", "track_id", "rank", "score")


@query("p11_profile_run")
def p11(spark, d):
    flagged_, _ = runs.profile_rows(song(spark, d))
    return runs.interpret_rows(flagged_).select("track_id", "final_label", "explanation", "eligible")


@query("au01_all_gates")
def au01(spark, d):
    summary = {"selected_k": 4, "selection_mode": "balanced_va_regions", "require_both_va": True, "metadata_policy": {"metadata_policy": "report_only", "effective_metadata_cluster_weight": 0.0}}
    found = search.search(spark, _data(spark, d, "mean_va"), "balanced_va_regions", _small())
    pattern = F.concat(F.col("has_audio").cast("int"), F.col("has_lyrics").cast("int"))
    from ..operators.statistics import mutual_information

    leak = mutual_information(song(spark, d).withColumn("m", pattern), "cluster_id", "m").first()["nmi"]
    metrics = found.metrics.withColumnsRenamed({"size_ok": "min_size_ok", "ari": "seed_ari_mean", "purity_20": "va_knn_purity_20"})
    return audit.audit_run(spark, summary | {"selected_k": found.k, "mask_purity_diagnostics": {"nmi": leak}}, metrics)


# ---------------------------------------------------------------- arrays and metadata blocks


def _part_fields(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("idx"), F.regexp_replace("p_name", " ", ",").alias("styles"), F.col("p_type").alias("genres"), F.col("p_size").cast("double").alias("size"))
    return part, {"Styles": "styles", "Genres": "genres"}


@query("f20_metadata_blocks", f"""WITH rows AS (SELECT DISTINCT p_partkey::BIGINT AS idx, 'Styles' AS field, 0 AS o, lower(trim(unnest(string_split(p_name, ' ')))) AS token FROM part UNION SELECT p_partkey, 'Genres', 1, lower(trim(p_type)) FROM part),
 df AS (SELECT field, o, token, count(*) AS df FROM rows WHERE token <> '' GROUP BY ALL), kept AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY df DESC, token) AS k FROM df QUALIFY k <= 40), n AS (SELECT count(*) AS n FROM part),
 w AS (SELECT idx, field || '::' || token AS feature, (ln((1 + n) / (1 + df)) + 1) * CASE WHEN field = 'Styles' THEN 0.35 ELSE 0.25 END AS w FROM rows JOIN kept USING (field, token), n)
 SELECT idx, feature, {r('w / sqrt(sum(w * w) OVER (PARTITION BY idx))')} AS value FROM w UNION ALL SELECT p_partkey, 'size', {r('p_size::DOUBLE')} FROM part""")
def f20_blocks(spark, d):
    part, fields = _part_fields(spark, d)
    return rounded(metadata.features_with_numbers(part, "idx", fields, ["size"], weights={"Styles": 0.35, "Genres": 0.25}, most=40), "idx", "feature", "value")


@query("f17_metadata_svd")
def f17_svd(spark, d):
    part, fields = _part_fields(spark, d)
    return metadata.represented(part, "idx", fields, to=8)[0]


@query("snk04_src11_arrays", f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, {r('embedding[1]::DOUBLE')} AS e0, {r('embedding[3]::DOUBLE')} AS e2 FROM embeddings")
def snk04_arrays(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)))
    path = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    arrays.write_npy(e, path, "vec_id", ["e0", "e1", "e2", "e3"], "<f8")
    remove_at_end(spark, path)
    return rounded(arrays.read_npy(spark, path, columns=["e0", "e2"]), "idx", "e0", "e2")


@query("c06_spectral_regions")
def c06_spectral(spark, d):
    return spectral.spectral_regions(song(spark, d).select("idx", "bv", "ba"), ["bv", "ba"], 4).select("idx", "cluster_id")
