"""Aggregates and window statistics: robust scales, percentiles, contingency metrics, enrichment, cluster geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import decimals, norm2, quadrant

EPS = 1e-8


def ecdf(x: Column | str, *group: str) -> Column:
    """Share of the group's values that are at most x, in a window: for groups that fit a task. with_ranks() has no such bound."""
    return F.cume_dist().over(Window.partitionBy(*group).orderBy(x))


def centrality(x: Column | str, *group: str) -> Column:
    """1 less the share of the group's values below x, in a window, like ecdf()."""
    w = Window.partitionBy(*group)
    return 1 - (F.rank().over(w.orderBy(x)) - 1) / F.count("*").over(w)


def ranked_values(df: DataFrame, value: Column, *group: str) -> DataFrame:
    """(group, _v, n, upto, of): each distinct value's rows, the rows up to it in its group, and the group's rows.

    Values are counted, dealt out by ranges of (group, value) and summed within ranges; only the ranges' totals, a row
    a range and group, come together. So a group of any size is spread over tasks, and one value is one row."""
    from ..sources.tables import stored

    counts = df.select(*group, value.alias("_v")).groupBy(*group, "_v").agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange(*group, "_v").withColumn("_range", F.spark_partition_id()), "value-counts")
    inside = F.sum("n").over(Window.partitionBy("_range", *group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    totals = ranged.groupBy("_range", *group).agg(F.sum("n").alias("_n"))
    by_group = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_range", *(F.col(g).alias(f"_{g}") for g in group), before.alias("_before"), F.sum("_n").over(by_group).alias("of"))
    same = F.col("_range") == F.col("_r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    met = ranged.withColumn("_in", inside).join(F.broadcast(offsets.withColumnRenamed("_range", "_r")), same)  # a row a range and group
    return met.select(*group, "_v", "n", (F.col("_before") + F.col("_in")).alias("upto"), "of")


def with_ranks(df: DataFrame, value: Column, *group: str, ecdf: str | None = None, centrality: str | None = None) -> DataFrame:
    """df with the share of the group's values up to the row's, and 1 less the share below it; nulls come first.

    Rows and ranks are merged: their files may be small enough to be broadcast, but not their rows in memory.

    df is stored before it is ranked: sums of doubles in its columns may come out otherwise when computed again, and rows would meet no rank."""
    from ..sources.tables import stored

    own = stored(df, "own-values").withColumn("_own", value)
    ranks = ranked_values(own, F.col("_own"), *group)
    shown = [(F.col("upto") / F.col("of")).alias(ecdf)] if ecdf else []
    shown += [(1 - (F.col("upto") - F.col("n")) / F.col("of")).alias(centrality)] if centrality else []
    side = ranks.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_v").alias("_w"), *shown)
    same = F.col("_own").eqNullSafe(F.col("_w"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return own.join(side.hint("merge"), same).drop("_own", "_w", *(f"_g{i}" for i in range(len(group))))


def with_many_ranks(df: DataFrame, key: str, specs: dict[str, tuple[Column, list[str], str]]) -> DataFrame:
    """df with several shares of with_ranks() in one pass: {name: (value, groups, "ecdf" or "centrality")}; key is unique.

    df is stored first, as in with_ranks()."""
    from ..sources.tables import stored

    df = stored(df, "own-values")
    each = [F.struct(F.lit(name).alias("kind"), F.concat_ws("\u0001", *(F.coalesce(F.col(g).cast("string"), F.lit("\u0002")) for g in groups)).alias("g"), v.cast("double").alias("v")) for name, (v, groups, _) in specs.items()]
    long = df.select(key, F.explode(F.array(*each)).alias("e")).select(key, "e.*")
    ranks = ranked_values(long, F.col("v"), "kind", "g").select(F.col("kind").alias("_k"), F.col("g").alias("_g"), "_v", "n", "upto", "of")
    met = long.join(ranks.hint("merge"), (F.col("kind") == F.col("_k")) & (F.col("g") == F.col("_g")) & F.col("v").eqNullSafe(F.col("_v")))
    up, below = F.col("upto") / F.col("of"), 1 - (F.col("upto") - F.col("n")) / F.col("of")
    wide = met.groupBy(key).agg(*(F.max(F.when(F.col("kind") == name, up if how == "ecdf" else below)).alias(name) for name, (_, _, how) in specs.items()))
    return df.join(wide.hint("merge"), key)


def fill_percentiles(df: DataFrame, percentile: str, norm: str, *group: str) -> DataFrame:
    """df with the percentile, or where it is null the share of the group's norms (that aren't null) up to the row's."""
    ranked = with_ranks(df.withColumn("_missing", F.col(norm).isNull()), F.col(norm), *group, "_missing", ecdf="_filled")
    return ranked.withColumn(percentile, F.coalesce(F.col(percentile), F.when(F.col(norm).isNotNull(), F.col("_filled")))).drop("_missing", "_filled")


def column_percentiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row of percentiles over all rows: {name: (value, quantile)}; null where a column has no value. All in one pass."""
    values = {str(v): v for v, _ in wanted.values()}
    quantiles = {f"q{i}": q for i, q in enumerate(sorted({q for _, q in wanted.values()}))}
    of = {q: n for n, q in quantiles.items()}
    each = [F.struct(F.lit(i).alias("kind"), v.cast("double").alias("v")) for i, v in enumerate(values.values())]
    long = df.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    found = exact_percentiles(long, F.col("v"), quantiles, "kind")
    number = {k: i for i, k in enumerate(values)}
    return found.agg(*(F.max(F.when(F.col("kind") == number[str(v)], F.col(of[q]))).alias(name) for name, (v, q) in wanted.items()))


def exact_percentiles(df: DataFrame, value: Column, quantiles: dict[str, float], *group: str) -> DataFrame:
    """(group, <name>...): interpolated percentiles of the values that aren't null, from ranked values: no task holds a group."""
    ranks = ranked_values(df.filter(value.isNotNull()), value, *group)
    out = []
    for name, q in quantiles.items():
        at = (F.col("of") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        holds = lambda place: (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)
        out += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_l_{name}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_h_{name}"), F.max(at - low).alias(f"_f_{name}")]
    found = ranks.groupBy(*group).agg(*out)
    return found.select(*group, *((F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_f_{n}")).alias(n) for n in quantiles))


def fill_percentile(percentile: Column, norm: Column, *group: str) -> Column:
    """The percentile, or where it is null the ECDF of the norm among the group's norms that aren't null."""
    within = F.cume_dist().over(Window.partitionBy(*group, norm.isNull()).orderBy(norm))
    return F.coalesce(percentile, F.when(norm.isNotNull(), within))


def percentiles_with_all(df: DataFrame, value: Column, quantile: float, *group: str) -> DataFrame:
    """(group, own, everywhere): a percentile of each group's values and that of all values, in one pass; groups without values are left out."""
    keys = [F.struct(F.lit(False).alias("_all"), *(F.col(g) for g in group)), F.struct(F.lit(True).alias("_all"), *(F.lit(None).cast(df.schema[g].dataType).alias(g) for g in group))]
    long = df.select(value.alias("v"), F.explode(F.array(*keys)).alias("k")).select("v", "k.*")
    found = exact_percentiles(long, F.col("v"), {"own": quantile}, "_all", *group)
    whole = found.filter("_all").select(F.col("own").alias("everywhere"))
    return found.filter("not _all").select(*group, "own").crossJoin(F.broadcast(whole))  # one row


def robust_scale(df: DataFrame, value: str, *group: str) -> DataFrame:
    """(group, center, scale): median, and median absolute deviation, else population deviation, else 1."""
    spread = df.groupBy(*group).agg(F.stddev_pop(value).alias("sd"))
    median = exact_percentiles(df, F.col(value), {"center": 0.5}, *group)
    met = df.join(F.broadcast(median), list(group))  # a row a group
    mad = exact_percentiles(met, F.abs(F.col(value) - F.col("center")), {"mad": 0.5}, *group)
    scale = F.coalesce(F.when(F.col("mad") > EPS, F.col("mad")), F.when(F.col("sd") > EPS, F.col("sd")), F.lit(1.0))
    return median.join(mad, list(group), "left").join(spread, list(group), "left").select(*group, "center", scale.alias("scale"))


def positive_median(c: Column, fallback: Column) -> Column:
    return F.coalesce(F.percentile(F.when(c > EPS, c), 0.5), fallback)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings; 1 where both are trivial."""
    t = contingency(df, a, b)
    cells = t.agg(F.sum(_pairs(F.col("n"))).alias("cells"), F.sum("n").alias("n"))
    rows = t.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("rows"))
    columns = t.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("cols"))
    one = cells.crossJoin(rows).crossJoin(columns)  # one row each
    expected = F.try_divide(F.col("rows") * F.col("cols"), _pairs(F.col("n")))
    most = (F.col("rows") + F.col("cols")) / 2
    return one.select(F.coalesce(F.try_divide(F.col("cells") - expected, most - expected), F.lit(1.0)).alias("ari"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information over the mean of the entropies; 0 where either is constant, 1 where both are."""
    t = contingency(df, a, b)
    total = F.sum("n").over(Window.partitionBy())
    t = t.withColumns({"ra": F.sum("n").over(Window.partitionBy("a")), "rb": F.sum("n").over(Window.partitionBy("b")), "t": total})
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ra") * F.col("rb"))))
    ha = -F.sum(F.col("n") / F.col("t") * F.log(F.col("ra") / F.col("t")))
    hb = -F.sum(F.col("n") / F.col("t") * F.log(F.col("rb") / F.col("t")))
    one = t.agg(mi.alias("mi"), ha.alias("ha"), hb.alias("hb"))
    return one.select(F.when((F.col("ha") < 1e-12) & (F.col("hb") < 1e-12), 1.0).otherwise(F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(0.0))).alias("nmi"))


def best_jaccard(df: DataFrame, reference: str, candidate: str) -> DataFrame:
    """(reference, best): the highest Jaccard overlap of each reference label with a candidate label."""
    t = contingency(df, reference, candidate)
    t = t.withColumns({"ra": F.sum("n").over(Window.partitionBy("a")), "rb": F.sum("n").over(Window.partitionBy("b"))})
    return t.groupBy("a").agg(F.max(F.col("n") / (F.col("ra") + F.col("rb") - F.col("n"))).alias("best")).withColumnRenamed("a", reference)


def affect_purity(df: DataFrame, cluster: str, label: str, least: float = 0.70, mixed_below: float = 0.70) -> DataFrame:
    """One row over rows with a label >= 0: valid share, minimum and weighted dominant ratio, mixed mass, worst cluster."""
    valid = df.filter(F.col(label) >= 0).groupBy(cluster, label).agg(F.count("*").alias("n"))
    each = valid.groupBy(cluster).agg(F.sum("n").alias("size"), F.max("n").alias("top")).withColumn("ratio", F.col("top") / F.col("size"))
    share = df.agg(F.avg((F.col(label) >= 0).cast("double")).alias("valid_fraction"))
    out = each.agg(
        F.min("ratio").alias("min_dominant"), (F.sum("top") / F.sum("size")).alias("weighted_dominant"),
        (F.sum(F.when(F.col("ratio") < mixed_below, F.col("size")).otherwise(0)) / F.sum("size")).alias("mixed_fraction"),
        F.min_by(cluster, F.struct("ratio", cluster)).alias("worst_cluster"),
    )
    return out.crossJoin(share).withColumn("gate_ok", F.col("min_dominant") >= least)


def mask_purity(df: DataFrame, cluster: str, pattern: str) -> DataFrame:
    """(cluster, size, dominant pattern, purity, enrichment over the pattern's share of all rows)."""
    n = df.groupBy(cluster, pattern).agg(F.count("*").alias("n"))
    n = n.withColumns({"size": F.sum("n").over(Window.partitionBy(cluster)), "of": F.sum("n").over(Window.partitionBy(pattern)), "all": F.sum("n").over(Window.partitionBy())})
    top = n.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), pattern))).filter("place = 1")
    purity = F.col("n") / F.col("size")
    return top.select(cluster, "size", F.col(pattern).alias("dominant"), decimals(purity, 4).alias("purity"), decimals(purity / (F.col("of") / F.col("all")), 4).alias("enrichment"))


def separation(df: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    """One row: the least distance of two cluster centres over the sum of their mean radii; null below two clusters."""
    centres = df.groupBy(cluster).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    radius = df.join(F.broadcast(centres), cluster).groupBy(cluster, "cx", "cy").agg(F.avg(norm2(F.col(x) - F.col("cx"), F.col(y) - F.col("cy"))).alias("r"))  # a row a cluster
    a, b = radius.alias("a"), radius.alias("b")
    pairs = a.join(b, F.col(f"a.{cluster}") < F.col(f"b.{cluster}"))
    gap = norm2(F.col("a.cx") - F.col("b.cx"), F.col("a.cy") - F.col("b.cy"))
    return pairs.agg(F.min(gap / F.greatest(F.col("a.r") + F.col("b.r"), F.lit(EPS))).alias("separation"))


def between_within(df: DataFrame, columns: list[str], label: str, adjusted: bool = False) -> DataFrame:
    """One row: between over within sums of squares; adjusted: the root of their mean squares' ratio."""
    means = df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"{c}_m") for c in columns), *((F.var_pop(c) * F.count(c)).alias(f"{c}_w") for c in columns))
    total = df.agg(*(F.avg(c).alias(f"{c}_g") for c in columns))
    met = means.crossJoin(F.broadcast(total))  # one row
    between = sum((F.col("n") * (F.col(f"{c}_m") - F.col(f"{c}_g")) * (F.col(f"{c}_m") - F.col(f"{c}_g")) for c in columns[1:]), F.col("n") * (F.col(f"{columns[0]}_m") - F.col(f"{columns[0]}_g")) * (F.col(f"{columns[0]}_m") - F.col(f"{columns[0]}_g")))
    within = sum((F.col(f"{c}_w") for c in columns[1:]), F.col(f"{columns[0]}_w"))
    sums = met.agg(F.sum(between).alias("b"), F.sum(within).alias("w"), F.count("*").alias("g"), F.sum("n").alias("n"))
    ratio = F.try_divide(F.col("b"), F.col("w"))
    if adjusted:
        ratio = F.sqrt(F.try_divide(F.try_divide(F.col("b"), F.col("g") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("g"))))
    return sums.select(F.coalesce(ratio, F.lit(0.0)).alias("ratio"))


def effect_size(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One row: the largest distance of two group means over the pooled deviation; 0 below two groups or four rows."""
    groups = df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"{c}_m") for c in columns), *(F.var_pop(c).alias(f"{c}_v") for c in columns))
    a, b = groups.alias("a"), groups.alias("b")
    square = [(F.col(f"a.{c}_m") - F.col(f"b.{c}_m")) * (F.col(f"a.{c}_m") - F.col(f"b.{c}_m")) for c in columns]
    apart = a.join(b, F.col(f"a.{label}") < F.col(f"b.{label}")).agg(F.max(F.sqrt(sum(square[1:], square[0]))).alias("far"))
    per = [F.sum(F.col(f"{c}_v") * (F.col("n") - 1)) for c in columns]
    pooled = groups.agg((sum(per[1:], per[0]) / len(columns)).alias("v"), F.sum("n").alias("n"), F.count("*").alias("g"))
    sd = F.sqrt(F.col("v") / F.nullif(F.col("n") - F.col("g"), F.lit(0)))
    return apart.crossJoin(pooled).select(F.when((F.col("g") < 2) | (F.col("n") < 4), 0.0).otherwise(F.coalesce(F.try_divide(F.col("far"), sd), F.lit(0.0))).alias("effect"))


def davies_bouldin(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One row: the Davies-Bouldin index."""
    centres = df.groupBy(label).agg(*(F.avg(c).alias(f"{c}_c") for c in columns))
    d2 = [(F.col(c) - F.col(f"{c}_c")) * (F.col(c) - F.col(f"{c}_c")) for c in columns]
    spread = df.join(F.broadcast(centres), label).groupBy(label, *(f"{c}_c" for c in columns)).agg(F.avg(F.sqrt(sum(d2[1:], d2[0]))).alias("s"))  # a row a label
    a, b = spread.alias("a"), spread.alias("b")
    gap = [(F.col(f"a.{c}_c") - F.col(f"b.{c}_c")) * (F.col(f"a.{c}_c") - F.col(f"b.{c}_c")) for c in columns]
    pairs = a.join(b, F.col(f"a.{label}") != F.col(f"b.{label}")).groupBy(F.col(f"a.{label}").alias("l")).agg(F.max((F.col("a.s") + F.col("b.s")) / F.sqrt(sum(gap[1:], gap[0]))).alias("worst"))
    return pairs.agg(F.avg("worst").alias("davies_bouldin"))


def bh_qvalues(df: DataFrame, p: str, *group: str) -> DataFrame:
    """df with q: p n / rank, then the least from the largest p down, at most 1; ties get one value."""
    g = Window.partitionBy(*group)
    ranked = df.withColumn("_rank", F.row_number().over(g.orderBy(p))).withColumn("_raw", F.col(p) * F.count("*").over(g) / F.col("_rank"))
    least = F.min("_raw").over(g.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("q", F.least(F.lit(1.0), least)).drop("_rank", "_raw")


def ln_factorial(n: Column) -> Column:
    """ln n! of whole numbers: of 0 to 9 as they are, beyond by Stirling's series, whose error is below 1e-10 there."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n < 10, F.get(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(10))), n.cast("int"))).otherwise(series)


TAIL = 40  # standard deviations beyond which a hypergeometric term is nothing in double precision
STEPS = 256


def enrichment(df: DataFrame, key: str, group: str, token: str, support: int = 5, total: int = 10) -> DataFrame:
    """Tokens over-represented in groups: support, share over base share, right-tail hypergeometric p and BH q by group.

    Counts are of distinct keys. The tail of a cell is summed in its row: the first term from logarithms of factorials, each next by its
    ratio to the one before, STEPS at a time, until terms beyond the mode vanish beside the sum. No cell makes rows.
    """
    rows = df.select(key, group, token).distinct()
    keys = df.select(key, group).distinct()
    sizes = keys.groupBy(group).agg(F.count("*").alias("size"))
    everything = keys.agg(F.count("*").alias("all"))
    cells = rows.groupBy(group, token).agg(F.count("*").alias("k"))
    of = rows.groupBy(token).agg(F.count("*").alias("of"))
    cells = cells.join(of, token).join(F.broadcast(sizes), group).crossJoin(F.broadcast(everything))  # a row a group; one row
    cells = cells.filter((F.col("k") >= support) & (F.col("of") >= total))
    share = F.col("of") / F.col("all")
    wide = F.ceil(TAIL * F.sqrt(F.col("size") * share * (1 - share))) + TAIL
    mode = F.floor((F.col("size") + 1) * (F.col("of") + 1) / (F.col("all") + 2))
    low = F.greatest(F.col("k"), mode - wide, F.col("of") + F.col("size") - F.col("all"))
    high = F.least("of", "size", F.greatest(F.col("k"), mode) + wide)
    f, n, s, o = ln_factorial, F.col("all"), F.col("size"), F.col("of")
    first = F.exp(f(o) - f(F.col("low")) - f(o - F.col("low")) + f(n - o) - f(s - F.col("low")) - f(n - o - s + F.col("low")) - f(n) + f(s) + f(n - s))
    cells = cells.withColumns({"low": low.cast("double"), "parts": F.floor((F.greatest(low, high) - low) / STEPS), "mode": mode}).withColumn("first", first)
    start = F.struct(F.col("low").alias("x"), F.col("first").alias("term"), F.lit(0.0).alias("sum"))

    def next_term(a: Column, _: Column) -> Column:
        x = a["x"]
        ratio = (o - x) * (s - x) / ((x + 1) * (n - o - s + x + 1))
        return F.struct((x + 1).alias("x"), (a["term"] * ratio).alias("term"), (a["sum"] + a["term"]).alias("sum"))

    def some_terms(a: Column, _: Column) -> Column:
        done = (a["x"] > F.col("mode")) & (a["term"] <= a["sum"] * 1e-18)
        return F.when(done, a).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), a, next_term))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("parts")), start, some_terms, lambda a: a["sum"])
    p = cells.select(group, token, "k", "of", "size", "all", F.least(F.lit(1.0), tail).alias("p"))
    out = p.withColumn("enrichment", (F.col("k") / F.col("size")) / (F.col("of") / F.col("all")))
    return bh_qvalues(out, "p", group)


def cluster_summary(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """A row a cluster: size, share, quadrant counts, dominant quadrant, means of observed views, tension, ratios."""
    both = F.col("has_audio") & F.col("has_lyrics")
    q = df.withColumn("q", quadrant("bv", "ba", F.col("has_audio") | F.col("has_lyrics")))
    agg = [F.count("*").alias("size"), *(F.count_if(F.col("q") == i).alias(f"q{i}") for i in range(4))]
    agg += [F.avg(F.when(F.col(f"has_{view}"), F.col(c))).alias(f"mean_{c}") for view, cs in (("audio", ("av", "aa")), ("lyrics", ("lv", "la"))) for c in cs]
    agg += [F.avg("bv").alias("mean_bv"), F.avg("ba").alias("mean_ba"), F.avg(F.when(both, F.col("norm"))).alias("mean_norm"), F.avg(F.when(both, F.abs(F.atan2("da", "dv")) / math.pi)).alias("mean_angle")]
    agg += [F.avg(F.col("has_audio").cast("double")).alias("audio_ratio"), F.avg(F.col("has_lyrics").cast("double")).alias("lyrics_ratio")]
    out = q.groupBy(cluster).agg(*agg)
    top = F.greatest(*(F.col(f"q{i}") for i in range(4)))
    dominant = F.when(top == 0, -1)
    for i in range(4):
        dominant = dominant.when(F.col(f"q{i}") == top, i)
    return out.withColumn("fraction", F.col("size") / F.sum("size").over(Window.partitionBy())).withColumn("dominant", dominant).withColumn("dominant_ratio", top / F.col("size"))


def determines(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """(key, determines): whether each key of `least` rows and more has one value at most."""
    return df.groupBy(key).agg(F.count("*").alias("_n"), (F.countDistinct(value) <= 1).alias("determines")).filter(F.col("_n") >= least).drop("_n")
