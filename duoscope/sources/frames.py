"""Standard forms of a run's tables: canonical columns, trimmed ids, numbers, and one row an id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import finite, norm2
from ..operators.joins import first_rows, merge_fill, one_to_one
from ..operators.statistics import fill_percentiles
from ..schema import ALIASES, FEATURES, REGIONS, TEXTS, find_column, script_form
from . import discovery
from .tables import assert_unique, read_csv, with_ordinal

WEIGHTS = [f"w_region_C{i}" for i in range(len(REGIONS))]


def song_id(c: Column | str) -> Column:
    """A trimmed id; null is blank."""
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def required_number(c: Column | str, label: str) -> Column:
    """A double; the job fails at the first value that is none."""
    x = finite(c)
    return F.coalesce(x, F.raise_error(F.lit(f"{label} has missing values or such that are no numbers")).cast("double"))


def cluster_ids(df: DataFrame, column: str, out: str = "cluster_id") -> DataFrame:
    """df with integers where all values are whole numbers, else trimmed text; that is found by one aggregate before the plan is made."""
    x = finite(column)
    whole = df.agg(F.count_if(x.isNull() | (F.abs(x - F.round(x)) > 1e-8 + 1e-5 * F.abs(F.round(x)))).alias("n")).first()["n"] == 0
    return df.withColumn(out, F.round(x).cast("int") if whole else F.trim(F.col(column).cast("string")))


def standard(df: DataFrame, logical: Sequence[str]) -> DataFrame:
    """The logical columns that are there, in standard types, the first row of each id in file order."""
    taken = with_ordinal(df)
    out: dict[str, Column] = {}
    for name in logical:
        physical = find_column(df.columns, ALIASES.get(name, [name]), script_form, name == "song_id")
        if physical is None:
            continue
        c = taken[physical]
        out[name] = song_id(c) if name in TEXTS else X.cluster_number(c) if name == "cluster_id" else finite(c)
    rows = taken.select("ordinal", *(c.alias(n) for n, c in out.items()))
    return first_rows(rows, ["song_id"], "ordinal").drop("ordinal")


def cluster_frame(df: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """song_id, cluster_id and consensus of a cluster source; no rows without one."""
    if df is None:
        return spark.createDataFrame([], "song_id string, cluster_id int, balanced_valence double, balanced_arousal double")
    return standard(df, ["song_id", "cluster_id", "balanced_valence", "balanced_arousal"])


def tension_frame(df: DataFrame | None, spark: SparkSession | None = None) -> DataFrame:
    """The tension columns of a source; the norm is derived where it has none."""
    names = ["song_id", "tension_label", "tension_name", "tension_dv", "tension_da", "tension_norm", "tension_strength_percentile"]
    if df is None:
        return spark.createDataFrame([], ", ".join(f"{n} {'string' if n in TEXTS else 'double'}" for n in names))
    out = standard(df, names)
    if "tension_norm" not in out.columns and {"tension_dv", "tension_da"} <= set(out.columns):
        out = out.withColumn("tension_norm", norm2("tension_dv", "tension_da"))
    return out


def interpretation_frame(df: DataFrame) -> DataFrame:
    """Those of the 24 retrieval features that a source has."""
    return standard(df, FEATURES)


def titles(df: DataFrame) -> DataFrame:
    """song_id, title, artist; blanks where a column or value is missing; the first row of each id."""
    out = standard(df, ["song_id", "title", "artist"])
    return out.select("song_id", *((F.col(c) if c in out.columns else F.lit("")).alias(c) for c in ("title", "artist")))


def metadata_table(df: DataFrame, key: str, out: str) -> DataFrame:
    """A metadata source under one id name, the first row of each trimmed id."""
    physical = find_column(df.columns, [key], required=True)
    rows = with_ordinal(df).withColumn(physical, song_id(F.col(physical))).withColumnRenamed(physical, out)
    return first_rows(rows, [out], "ordinal").drop("ordinal")


def aligned_pairs(df: DataFrame, audio: str = "Audio_Song", lyric: str = "Lyric_Song", quadrant: str = "Quadrant") -> DataFrame:
    """A pair source with its quadrant in upper case, the first row of each pair; ValueError without those columns."""
    if missing := [c for c in (audio, lyric, quadrant) if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    rows = with_ordinal(df).withColumns({audio: F.trim(F.col(audio)), lyric: F.trim(F.col(lyric)), quadrant: F.upper(F.trim(F.col(quadrant)))})
    return first_rows(rows, [audio, lyric], "ordinal").drop("ordinal")


def cluster_plane(assignments: DataFrame, plane: DataFrame) -> DataFrame:
    """Assignments with the consensus of a source, one to one; ids that repeat and gaps fail the job."""
    of = lambda df, name: F.col(find_column(df.columns, ALIASES[name], script_form, True))
    left = assignments.select(song_id(of(assignments, "song_id")).alias("song_id"), of(assignments, "cluster_id").alias("cluster_id"))
    right = plane.select(song_id(of(plane, "song_id")).alias("song_id"), *(required_number(of(plane, c), c).alias(c) for c in ("balanced_valence", "balanced_arousal")))
    return one_to_one(assert_unique(cluster_ids(left, "cluster_id"), "song_id"), right, ["song_id"], strict=True)


def load_cluster_plane(spark: SparkSession, run_dir: str) -> DataFrame:
    """cluster_plane() of the best files of a run; the consensus may be in another one."""
    ids, planes = [ALIASES["song_id"], ALIASES["cluster_id"]], [ALIASES["balanced_valence"], ALIASES["balanced_arousal"]]
    names = ["cluster_assignments.csv", "assignments.csv"]
    path = discovery.find(spark, run_dir, ids, names)
    other = path if discovery.has_columns(spark, path, planes) else discovery.find(spark, run_dir, [ids[0], *planes], [*names, "canonical_affect_regions.csv"])
    return cluster_plane(read_csv(spark, path), read_csv(spark, other))


def tension_values(assignments: DataFrame, values: DataFrame) -> DataFrame:
    """song_id, tension label and name, cluster_id_tension if it is there, and dv, da, norm, one to one without gaps."""
    find = lambda df, name, must: find_column(df.columns, ALIASES[name], script_form, must)
    name, cluster = find(assignments, "tension_name", False), find(assignments, "cluster_id", False)
    label = song_id(find(assignments, "tension_label", True))
    own = assignments.select(song_id(find(assignments, "song_id", True)).alias("song_id"), label.alias("tension_label"), (song_id(name) if name else label).alias("tension_name"), *([F.col(cluster).alias("_c")] if cluster else []))
    if cluster:
        own = cluster_ids(own, "_c", "cluster_id_tension").drop("_c")
    numbers = values.select(song_id(find(values, "song_id", True)).alias("song_id"), *(required_number(find(values, c, True), c).alias(c) for c in ("tension_dv", "tension_da", "tension_norm")))
    return one_to_one(assert_unique(own, "song_id"), numbers, ["song_id"], strict=True)


def load_tension(spark: SparkSession, run_dir: str) -> DataFrame:
    """tension_values() of the best files of a run; the values may be in another one."""
    names = ["tension_subtype_assignments.csv", "tension_micro_assignments.csv", "tension_micro_probe.csv"]
    numbers = [ALIASES[c] for c in ("tension_dv", "tension_da", "tension_norm")]
    path = discovery.find(spark, run_dir, [ALIASES["song_id"], ALIASES["tension_label"]], names)
    other = path if discovery.has_columns(spark, path, numbers) else discovery.find(spark, run_dir, [ALIASES["song_id"], *numbers], names)
    return tension_values(read_csv(spark, path), read_csv(spark, other))


def id_column(df: DataFrame, known: DataFrame, candidates: Sequence[str] = ("song_id", "identifier", "track_id", "Song", "song", "id")) -> str:
    """The candidate column that has most of the known ids (song_id), the first of equals; ValueError without any."""
    columns = list(dict.fromkeys(c for n in candidates if (c := find_column(df.columns, [n], script_form))))
    if not columns:
        raise ValueError(f"none of {list(candidates)} is there")
    ids = known.select("song_id").distinct()
    counts = [df.select(song_id(F.col(c)).alias("song_id")).intersect(ids).count() for c in columns]
    return columns[counts.index(max(counts))]


# ---------------------------------------------------------------- retrieval features


def derived(df: DataFrame) -> DataFrame:
    """All 24 features: norm, confidence, nearest alternative, margin and percentile are filled where they can be."""
    for c in FEATURES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if c in TEXTS else "int" if c == "cluster_id" else "double"))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan")
    df = df.withColumns({c: song_id(c) for c in ("song_id", "title", "artist")})
    names = F.get(F.array(*map(F.lit, REGIONS)), F.col("cluster_id"))
    df = df.withColumn("cluster_name", F.when(blank("cluster_name"), F.coalesce(names, F.lit("missing"))).otherwise(F.trim("cluster_name")))
    df = df.withColumn("tension_norm", F.coalesce("tension_norm", norm2("tension_dv", "tension_da")))
    own = F.get(F.array(*map(F.col, WEIGHTS)), F.col("cluster_id"))
    others = F.array(*(F.when((F.col("cluster_id").isNull() | (F.col("cluster_id") != i)) & F.col(w).isNotNull(), F.struct(F.col(w).alias("w"), F.lit(-i).alias("i"))) for i, w in enumerate(WEIGHTS)))
    alternative = F.array_max(others)  # nulls are skipped; the lowest number of equals
    told = F.concat(F.lit("C"), -alternative["i"], F.lit(" "), F.get(F.array(*map(F.lit, REGIONS)), -alternative["i"]))
    df = df.withColumn("region_confidence", F.coalesce("region_confidence", own))
    df = df.withColumn("nearest_alt_cluster", F.when(F.col("nearest_alt_cluster").isNull() | (F.trim("nearest_alt_cluster") == ""), told).otherwise(F.col("nearest_alt_cluster")))
    df = df.withColumn("region_margin", F.coalesce(F.col("region_margin"), F.when(F.col("cluster_id").isNotNull(), own - alternative["w"])))
    df = fill_percentiles(df, "tension_strength_percentile", "tension_norm", "cluster_id")
    unit = lambda c: F.when(F.col(c).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))))
    df = df.withColumns({c: unit(c) for c in ("tension_strength_percentile", "affective_complexity_score")})
    df = df.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit("missing"))) for c in ("complexity_level", "final_interpretation_label", "tension_label")})
    return df.withColumn("tension_name", F.trim(F.coalesce("tension_name", "tension_label"))).select(*FEATURES)


def retrieval_features(interpretation: DataFrame, cluster: DataFrame | None = None, tension: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, counts of conflicting values by source and column): three sources, the interpretation's values first."""
    merged, conflicts = interpretation_frame(interpretation), []
    for kind, other in (("cluster", cluster), ("tension", tension)):
        if other is not None:
            side = cluster_frame(other) if kind == "cluster" else tension_frame(other)
            merged = merge_fill(merged, side, "song_id")
            for c in [c for c in merged.columns if c.startswith("conflict_")]:
                conflicts.append(merged.agg(F.lit(kind).alias("source"), F.lit(c.removeprefix("conflict_")).alias("column"), F.count_if(F.col(c)).alias("conflicts")))
                merged = merged.drop(c)
    spark = interpretation.sparkSession
    told = spark.createDataFrame([], "source string, column string, conflicts long")
    for c in conflicts:
        told = told.union(c)
    return derived(merged), told.filter("conflicts > 0")


def missing_features(features: DataFrame) -> DataFrame:
    """(feature, missing): nulls, blanks and the word missing, of each feature."""
    text = lambda c: F.col(c).cast("string")
    counts = [F.count_if(text(c).isNull() | text(c).isin("", "missing", "<NA>")).alias(c) for c in FEATURES if c != "song_id"]
    pairs = F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in FEATURES[1:])), F.array(*(F.col(c) for c in FEATURES[1:])))).alias("feature", "missing")
    return features.agg(*counts).select(pairs)
