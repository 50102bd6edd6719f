"""Row-wise features of two views on the valence-arousal plane, as projections.

A view counts only if its mask is true; pairwise features are 0 unless both views are there, and a row without any
view stands at the neutral point. Scalars learnt from data (medians, scales) come from one aggregate and are joined
as a one-row table, so nothing is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, norm2
from .statistics import column_percentiles

NEUTRAL = 0.5
SIGMA = 0.35
GEOMETRY = ["con_v", "con_a", "d_v", "d_a", "abs_v", "abs_a", "gap", "mean_abs", "cosine", "angle", "radius_audio", "radius_lyrics", "radius_gap", "agreement"]
# Centres of the four soft quadrants, and their temperature.
SOFT_CENTRES = [(0.75, 0.75), (0.25, 0.75), (0.25, 0.25), (0.75, 0.25)]
SOFT_TEMPERATURE = 0.08


def masked_mean(x: Column, y: Column, has_x: Column, has_y: Column, neutral: float = NEUTRAL) -> Column:
    """The mean of the views that are there."""
    return F.when(has_x & has_y, (x + y) / 2).when(has_x, x).when(has_y, y).otherwise(neutral)


def balanced(x: Column, y: Column, has_x: Column, has_y: Column, alpha: float) -> Column:
    """alpha x + (1 - alpha) y if both are there, the one that is, or the neutral point."""
    return F.when(has_x & has_y, x * alpha + y * (1 - alpha)).when(has_x, x).when(has_y, y).otherwise(NEUTRAL)


def geometry(df: DataFrame, av: str = "av", aa: str = "aa", lv: str = "lv", la: str = "la", has_audio: str = "has_audio", has_lyrics: str = "has_lyrics", mask_columns: bool = True) -> DataFrame:
    """The 14 features of GEOMETRY (audio minus lyrics), and three mask columns besides."""
    a, l = F.col(has_audio), F.col(has_lyrics)
    both = a & l
    paired = lambda c: F.when(both, c).otherwise(0.0)
    pv, pa = F.col(av) - NEUTRAL, F.col(aa) - NEUTRAL
    qv, qa = F.col(lv) - NEUTRAL, F.col(la) - NEUTRAL
    dv, da = F.col(av) - F.col(lv), F.col(aa) - F.col(la)
    ra, rl = norm2(pv, pa), norm2(qv, qa)
    dot, det = pv * qv + pa * qa, pv * qa - pa * qv
    gap = norm2(dv, da) / math.sqrt(2)
    out = {
        "con_v": masked_mean(F.col(av), F.col(lv), a, l), "con_a": masked_mean(F.col(aa), F.col(la), a, l),
        "d_v": paired(dv), "d_a": paired(da), "abs_v": paired(F.abs(dv)), "abs_a": paired(F.abs(da)), "gap": paired(gap),
        "mean_abs": paired((F.abs(dv) + F.abs(da)) / 2), "cosine": paired(clip(dot / F.greatest(ra * rl, F.lit(1e-6)), -1, 1)),
        "angle": paired(F.atan2(det, dot) / math.pi), "radius_audio": paired(ra), "radius_lyrics": paired(rl),
        "radius_gap": paired(F.abs(ra - rl)), "agreement": paired(F.exp(-0.5 * (gap / SIGMA) * (gap / SIGMA))),
    }
    if mask_columns:
        out |= {"m_both": both.cast("double"), "m_audio": a.cast("double"), "m_lyrics": l.cast("double")}
    return df.withColumns(out)


def balanced_difference(df: DataFrame) -> DataFrame:
    """Eight features: consensus, signed difference, gap, angular and radial gap, agreement."""
    g = geometry(df, mask_columns=False)
    return g.select(*df.columns, "con_v", "con_a", "d_v", "d_a", "gap", F.col("angle").alias("angular_gap"), F.col("radius_gap").alias("radial_gap"), "agreement")


def soft_quadrants(v: Column, a: Column) -> list[Column]:
    """Softmin over the four centres."""
    parts = [F.exp(-((v - x) * (v - x) + (a - y) * (a - y)) / SOFT_TEMPERATURE) for x, y in SOFT_CENTRES]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def difference_geometry(df: DataFrame) -> DataFrame:
    """26 features: consensus, deltas, gap, angle, radial gap, 16 soft quadrant pairs and a sigmoid of the gap."""
    g = geometry(df, mask_columns=False)
    both = (F.col("has_audio") & F.col("has_lyrics")).cast("double")
    audio, lyrics = soft_quadrants(F.col("av"), F.col("aa")), soft_quadrants(F.col("lv"), F.col("la"))
    pairs = {f"q{i}{j}": audio[i] * lyrics[j] * both for i in range(4) for j in range(4)}
    g = g.withColumns(pairs).withColumn("conflict", both / (1 + F.exp(-5 * (F.col("gap") - 0.2))))
    return g.select(*df.columns, "con_v", "con_a", "d_v", "d_a", "abs_v", "abs_a", "gap", "angle", "radius_gap", *pairs, "conflict")


def one_row(df: DataFrame, *aggregates: Column) -> DataFrame:
    """df with the aggregates of all its rows on each: a broadcast of one row."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def calibrated(df: DataFrame) -> DataFrame:
    """Adds bias_v, bias_a (median of lyrics minus audio where both are there; 0 below two rows) and the shifted views."""
    both = F.col("has_audio") & F.col("has_lyrics")
    medians = column_percentiles(df.filter(both), {"_bias_v": (F.col("lv") - F.col("av"), 0.5), "_bias_a": (F.col("la") - F.col("aa"), 0.5)})
    enough = df.agg((F.count_if(both) >= 2).alias("_enough"))
    bias = medians.crossJoin(enough).select(*(F.when(F.col("_enough"), F.col(f"_{b}")).otherwise(0.0).alias(b) for b in ("bias_v", "bias_a")))
    out = df.crossJoin(F.broadcast(bias))  # one row
    return out.withColumns({"av_cal": F.col("av") + F.col("bias_v") / 2, "aa_cal": F.col("aa") + F.col("bias_a") / 2, "lv_cal": F.col("lv") - F.col("bias_v") / 2, "la_cal": F.col("la") - F.col("bias_a") / 2})


def robust_sigma(c: Column) -> Column:
    """Aggregate: inter-quartile range over 1.349; its buffer holds a group's distinct values, column_percentiles() has no such bound."""
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    return (q[1] - q[0]) / 1.349


def tension(df: DataFrame, alpha: float = 0.5, most: float = 3.0) -> DataFrame:
    """Calibrated consensus and the lyrics minus audio difference in robust units, clipped, with its norm."""
    cal = calibrated(df)
    both = F.col("has_audio") & F.col("has_lyrics")
    cal = cal.withColumns({
        "con_v": balanced(F.col("av_cal"), F.col("lv_cal"), F.col("has_audio"), F.col("has_lyrics"), alpha),
        "con_a": balanced(F.col("aa_cal"), F.col("la_cal"), F.col("has_audio"), F.col("has_lyrics"), alpha),
        "raw_v": F.when(both, F.col("lv_cal") - F.col("av_cal")).otherwise(0.0), "raw_a": F.when(both, F.col("la_cal") - F.col("aa_cal")).otherwise(0.0),
    })
    quartiles = column_percentiles(cal.filter(both), {f"{c}{n}": (F.col(f"raw_{c}"), q) for c in "va" for n, q in (("l", 0.25), ("h", 0.75))})
    sigmas = quartiles.select(*(((F.col(f"{c}h") - F.col(f"{c}l")) / 1.349).alias(f"sigma_{c}") for c in "va"))
    scaled = cal.crossJoin(F.broadcast(sigmas))  # one row
    for c in ("v", "a"):
        sigma = F.when(F.col(f"sigma_{c}") > 1e-6, F.col(f"sigma_{c}")).otherwise(1.0)
        scaled = scaled.withColumn(f"ten_{c}", clip(F.col(f"raw_{c}") / sigma, -most, most))
    return scaled.withColumn("ten_norm", norm2("ten_v", "ten_a"))


def scaled(df: DataFrame, columns: list[str], observed: str, floor: float = 1e-6) -> DataFrame:
    """z-scores by mean and population deviation of observed rows; unobserved rows are 0."""
    seen = F.col(observed)
    stats = []
    for c in columns:
        stats += [F.avg(F.when(seen, F.col(c))).alias(f"{c}_mean"), F.stddev_pop(F.when(seen, F.col(c))).alias(f"{c}_sd")]
    out = one_row(df, *stats)
    sd = {c: F.when(F.col(f"{c}_sd") < floor, 1.0).otherwise(F.col(f"{c}_sd")) for c in columns}
    return out.withColumns({f"{c}_z": F.when(seen, (F.col(c) - F.col(f"{c}_mean")) / sd[c]).otherwise(0.0) for c in columns})


def token_rows(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, token) for each token, repeats kept."""
    return df.select(key, F.explode(tokens).alias("token"))


def vocabulary(rows: DataFrame, key: str, most: int, least: int = 1, distinct: bool = True) -> DataFrame:
    """(token, frequency, place): the most frequent tokens, ties by token; document or total frequency."""
    from pyspark.sql import Window

    rows = rows.distinct() if distinct else rows
    counts = rows.groupBy("token").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= least)
    ranked = counts.orderBy(F.desc("frequency"), "token").limit(most)  # the cap is the feature
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("frequency"), "token")) - 1)


def tfidf(rows: DataFrame, key: str, vocab: DataFrame, binary: bool = True) -> DataFrame:
    """(key, token, weight): smooth inverse document frequency times (binary) term frequency, rows of length 1."""
    from pyspark.sql import Window

    counts = rows.groupBy(key, "token").agg(F.count("*").alias("tf")).join(vocab.select("token"), "token")
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    total = rows.agg(F.countDistinct(key).alias("n"))
    idf = df.crossJoin(F.broadcast(total)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = F.col("idf") * (F.lit(1) if binary else F.col("tf"))
    out = counts.join(idf, "token").withColumn("w", weight)
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return out.select(key, "token", (F.col("w") / length).alias("weight"))


def numeric_block(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median-imputed numbers; a column whose adjusted skewness is over 1 goes through log1p."""
    stats = []
    for c in columns:
        stats += [F.skewness(c).alias(f"{c}_skew"), F.count(c).alias(f"{c}_n")]
    out = one_row(df, *stats).crossJoin(F.broadcast(column_percentiles(df, {f"{c}_median": (F.col(c), 0.5) for c in columns})))  # one row
    for c in columns:
        filled = F.coalesce(c, f"{c}_median", F.lit(0.0))
        n = F.col(f"{c}_n").cast("double")
        skew = F.col(f"{c}_skew") * F.sqrt(n * (n - 1)) / (n - 2)
        out = out.withColumn(f"{c}_num", F.when((n > 2) & (skew > 1), F.log1p(filled)).otherwise(filled))
    return out.select(*df.columns, *(f"{c}_num" for c in columns))


def tempo_bins(c: str, edges: list[float] | None = None) -> list[Column]:
    """One-hot of the bins between edges."""
    edges = edges or [80.0, 120.0, 160.0]
    low, high = [None, *edges], [*edges, None]
    x = F.col(c)
    return [((x >= a if a is not None else F.lit(True)) & (x < b if b is not None else F.lit(True))).cast("int").alias(f"{c}_bin{i}") for i, (a, b) in enumerate(zip(low, high))]
