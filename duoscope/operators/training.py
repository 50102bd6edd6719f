"""Losses and targets of soft clusterings, as columns and aggregates: the parts of representation learning that are relational.

The encoder itself is not trained here; assignments, targets and losses work on any table that has its outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def log_sum_exp(values: Column) -> Column:
    """ln of the summed exponentials of an array, without overflow; minus infinity throughout stays so."""
    high = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - high))
    return F.when(high == float("-inf"), high).otherwise(high + F.log(total))


def soft_assignment(columns: list[str], centres: list[list[float]], temperature: float = 1.0) -> Column:
    """Array of softmax(-squared distance / temperature); the centres are K x D numbers of the plan."""
    d = []
    for centre in centres:
        one = F.lit(0.0)
        for c, m in zip(columns, centre):
            one = one + (F.col(c) - float(m)) * (F.col(c) - float(m))
        d.append(-one / float(temperature))
    scores = F.array(*d)
    return F.transform(scores, lambda x: F.exp(x - log_sum_exp(scores)))


def target_distribution(df: DataFrame, q: str, k: int, out: str = "target", eps: float = EPS) -> DataFrame:
    """df with sharpened assignments: squares over cluster masses, each row to sum 1; the masses are one broadcast row."""
    mass = df.agg(F.array(*(F.sum(F.col(q)[i]) for i in range(k))).alias("_mass"))
    sharp = F.zip_with(q, "_mass", lambda x, m: x * x / F.greatest(m, F.lit(eps)))
    met = df.crossJoin(F.broadcast(mass)).withColumn("_s", sharp)
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    return met.withColumn(out, F.transform("_s", lambda x: x / F.greatest(total, F.lit(eps)))).drop("_s", "_mass")


def divergence(target: Column, predicted: Column, eps: float = EPS) -> Column:
    """Kullback-Leibler divergence of two arrays, bounded away from ln 0."""
    safe = lambda x: F.greatest(x, F.lit(eps))
    return F.aggregate(F.zip_with(target, predicted, lambda t, p: safe(t) * (F.log(safe(t)) - F.log(safe(p)))), F.lit(0.0), lambda a, x: a + x)


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: mean over rows of mask true; 0 without any."""
    m = mask.cast("double")
    return F.sum(F.coalesce(value, F.lit(0.0)) * m) / F.greatest(F.sum(m), F.lit(1.0))


def masked_square_error(a: Column, b: Column, mask: Column) -> Column:
    """Aggregate: mean over masked rows of the mean squared difference of two arrays."""
    row = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))
    return masked_mean(row, mask)


def masked_cross_entropy(logit: Column, target: Column, mask: Column, positive_weight: float = 1.0, most: float = 20.0) -> Column:
    """Aggregate: binary cross entropy with logits, positives weighted by at most `most`."""
    w = min(float(positive_weight), most)
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))  # softplus(-logit)
    return masked_mean(w * target * soft + (1 - target) * (logit + soft), mask)


def cosine_distance(a: Column, b: Column, eps: float = EPS) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
    return 1 - total(F.zip_with(a, b, lambda x, y: x * y)) / F.greatest(norm(a) * norm(b), F.lit(eps))


def gate_balance(df: DataFrame, gates: list[str], masks: list[str]) -> DataFrame:
    """One row: divergence of the mean gate over views from the mean uniform share of the views that are there."""
    there = sum((F.col(m).cast("double") for m in masks), F.lit(0.0))
    uniform = [F.avg(F.col(m).cast("double") / F.greatest(there, F.lit(1.0))) for m in masks]
    return df.agg(F.array(*(F.avg(g) for g in gates)).alias("g"), F.array(*uniform).alias("u")).select(divergence(F.col("g"), F.col("u")).alias("loss"))


def assignment_balance(df: DataFrame, q: str, k: int) -> DataFrame:
    """One row: divergence of the mean assignment from the uniform one."""
    return df.agg(F.array(*(F.avg(F.col(q)[i]) for i in range(k))).alias("g")).select(divergence(F.col("g"), F.array_repeat(F.lit(1.0 / k), k)).alias("loss"))


def weighted_moments(df: DataFrame, shares: str, columns: list[str]) -> DataFrame:
    """(component, mass, <column>_mean, <column>_var): moments weighted by each component's responsibilities, one aggregate."""
    each = df.select(F.posexplode(shares).alias("component", "r"), *columns)
    mean = lambda c: F.sum(F.col("r") * F.col(c)) / F.sum("r")
    square = lambda c: F.sum(F.col("r") * F.col(c) * F.col(c)) / F.sum("r")
    return each.groupBy("component").agg(F.sum("r").alias("mass"), *(mean(c).alias(f"{c}_mean") for c in columns), *((square(c) - mean(c) * mean(c)).alias(f"{c}_var") for c in columns))


class EarlyStopping:
    """Says when a value has not improved for `patience` steps; remembers the best state."""

    def __init__(self, patience: int = 10, least: float = 0.0):
        self.patience, self.least, self.best, self.state, self.waited = patience, least, float("inf"), None, 0

    def step(self, value: float, state: object = None) -> bool:
        if value < self.best - self.least:
            self.best, self.state, self.waited = value, state, 0
        else:
            self.waited += 1
        return self.waited >= self.patience
