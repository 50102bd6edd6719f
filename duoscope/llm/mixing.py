"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are summed to cells of (source, language, topic). Raking multiplies a cell's tokens by target over present
weight of each margin in turn, until the tokens of every source, language and topic meet their targets to TOLERANCE (or ROUNDS rounds
are done; rake() returns the error that is left). A document's probability is its cell's calibrated over present tokens, relative to the largest ratio; it is
kept where a hash of its id is below that.

Targets are given as {category: share} for a margin, or follow from the data: the share to the power TEMPERATURE,
which lifts small categories; one below SMALL of all tokens is lifted as one of just SMALL is, so that a rare category
does not set the scale of all probabilities and the kept share does not fall as the input grows. (The SQL has no such
bound; it gives the same rows where no category is below SMALL.) Targets that are given are met as they are. The topic
margin keeps its shares by default. Cells are partially aggregated before
they are shuffled, so a source with a third of all rows is one row a task; the fit runs on cells alone, as sums and
windows by category.

Defined results: a null source or language is the category "none"; a null or empty text has no tokens and the
probability of its cell; categories without a target keep their weight; a cell without tokens has ratio 1; equal
rows with equal ids are kept or left together; null ids hash as "null". Other columns pass through; a clash raises
ValueError.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

ROUNDS = 60
ROUNDS_A_WRITE = 3
TOLERANCE = 1e-9
TEMPERATURE = 0.8
SMALL = 0.02
MARGINS = ("mix_source", "mix_lang", "mix_topic")
NAMES = (*MARGINS, "n_tokens", "probability", "kept")
TOPICS = [("legal", "icense"), ("table", " | "), ("contact", "@")]


def tokens(text: Column) -> Column:
    """Number of white-space words; a word begins after a blank, a tab or a line end."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """The first topic of TOPICS whose mark the text holds, else prose."""
    out = F.when(F.lit(False), "")
    for name, mark in TOPICS:
        out = out.when(F.contains(F.coalesce(text, F.lit("")), F.lit(mark)), name)
    return out.otherwise("prose")


def described(df: DataFrame, text: str, source: str, lang: str, topics: str | None = None, sizes: str | None = None) -> DataFrame:
    taken = {c.lower() for c in df.columns}
    if clash := [c for c in NAMES if c in taken]:
        raise ValueError(f"the input already has columns {clash}")
    return df.withColumns({
        "mix_source": F.coalesce(F.col(source).cast("string"), F.lit("none")),
        "mix_lang": F.coalesce(F.col(lang).cast("string"), F.lit("none")),
        "mix_topic": topic(F.col(text)) if topics is None else F.coalesce(F.col(topics).cast("string"), F.lit("none")),
        "n_tokens": tokens(F.col(text)) if sizes is None else F.coalesce(F.col(sizes), F.lit(0)).cast("long"),
    })


def targets_of(cells: DataFrame, margin: str, given: dict[str, float] | None, power: float) -> DataFrame:
    """(margin, target): target tokens of each category that has one."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("has"))
    total = sums.agg(F.sum("has").alias("total"))
    if given is not None:
        shares = cells.sparkSession.createDataFrame(list(given.items()), f"{margin} string, share double")
        sums = sums.join(F.broadcast(shares), margin)  # as many rows as the caller gave
    else:
        share = F.col("has") / F.col("total")
        if power != 1:
            share = F.when(share < SMALL, share * SMALL ** (power - 1)).otherwise(F.pow(share, F.lit(power)))
        sums = sums.crossJoin(total).withColumn("share", share).drop("total")  # one row on the right
    sums = sums.crossJoin(sums.agg(F.sum("share").alias("shares"), F.sum("has").alias("of")))  # one row on the right
    return sums.filter("shares > 0").select(margin, (F.col("share") / F.col("shares") * F.col("of")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """cells (margins, tokens, documents) with calibrated weights w, and the largest relative error of a margin.

    Rounds go on until that error is at most `tolerance`, `rounds` of them at most.
    """
    state = cells.withColumn("w", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        state = state.join(target.withColumnRenamed("target", f"target_{margin}"), margin, "left")
    state, worst = cut(state, "cells"), float("inf")
    for turn in range(rounds):
        for margin in targets:  # a window reads the cells once, so the plan grows by one step a margin
            present, goal = F.sum("w").over(Window.partitionBy(margin)), F.col(f"target_{margin}")
            state = state.withColumn("present", present).withColumn("w", F.when(goal.isNull() | (F.col("present") <= 0), F.col("w")).otherwise(F.col("w") * (goal / F.col("present")))).drop("present")
        if (turn + 1) % ROUNDS_A_WRITE == 0 or turn + 1 == rounds:
            state = cut(state, "cells")
            if (worst := marginal_error(state, list(targets))) <= tolerance:
                break
    return state.select(*targets, "tokens", "documents", "w"), worst


def marginal_error(state: DataFrame, margins: list[str]) -> float:
    """The largest |present / target - 1| of a category with tokens and a target; one number reaches the driver."""
    errors = [
        state.groupBy(m).agg(F.sum("w").alias("present"), F.max(f"target_{m}").alias("target")).filter("present > 0 and target > 0").select(F.abs(F.col("present") / F.col("target") - 1).alias("error"))
        for m in margins
    ]
    return reduce(DataFrame.union, errors).agg(F.max("error")).first()[0] or 0.0


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS, topics: str | None = None, sizes: str | None = None) -> DataFrame:
    """All rows with margins, n_tokens, probability and kept (0 or 1).

    topics and sizes name columns that have each document's topic and number of tokens, where a classifier and a
    tokenizer have run; without them topics are TOPICS by their marks, and tokens white-space words."""
    targets = targets or {}
    docs = described(df, text, source, lang, topics, sizes)
    cells = cut(docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), "cells")
    goals = {m: targets_of(cells, m, targets.get(m.removeprefix("mix_")), 1.0 if m == "mix_topic" else temperature) for m in MARGINS}
    fitted, _ = rake(cells, goals, rounds)
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
    fitted = fitted.select(*MARGINS, ratio.alias("ratio"))
    fitted = cut(fitted.crossJoin(fitted.agg(F.max("ratio").alias("most"))).select(*MARGINS, F.coalesce(F.col("ratio") / F.col("most"), F.lit(1.0)).alias("probability")), "fitted")
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)
    out = docs.join(fitted, list(MARGINS)).withColumn("kept", (draw < F.col("probability")).cast("int"))
    return out.select(*df.columns, *NAMES)


def oracle_sql(rounds: int = 24, temperature: float = TEMPERATURE) -> str:
    """DuckDB SQL for the rows of op7 over the view documents."""
    topics = " ".join(f"WHEN contains(coalesce(text, ''), '{mark}') THEN '{name}'" for name, mark in TOPICS)
    parts = [
        f"docs AS MATERIALIZED (SELECT doc_id, coalesce(source, 'none') AS mix_source, coalesce(lang, 'none') AS mix_lang, CASE {topics} ELSE 'prose' END AS mix_topic, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens FROM documents)",
        "c AS MATERIALIZED (SELECT mix_source, mix_lang, mix_topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL)",
    ]
    for m in MARGINS:
        share = "has / total" if m == "mix_topic" else f"pow(has / total, {temperature})"
        parts.append(f"g_{m} AS MATERIALIZED (SELECT {m}, share / sum(share) OVER () * total AS target FROM (SELECT {m}, has, total, {share} AS share FROM (SELECT {m}, sum(tokens)::DOUBLE AS has, (SELECT sum(tokens)::DOUBLE FROM c) AS total FROM c GROUP BY {m})))")
    at = "s0"
    parts.append("s0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS w FROM c)")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            n += 1
            parts.append(f"s{n} AS MATERIALIZED (SELECT mix_source, mix_lang, mix_topic, tokens, CASE WHEN sum(w) OVER (PARTITION BY {m}) <= 0 THEN w ELSE w * (target / sum(w) OVER (PARTITION BY {m})) END AS w FROM {at} JOIN g_{m} USING ({m}))")
            at = f"s{n}"
    parts.append(f"f AS (SELECT mix_source, mix_lang, mix_topic, CASE WHEN tokens > 0 THEN w / tokens END AS ratio FROM {at})")
    parts.append("p AS (SELECT *, coalesce(ratio / max(ratio) OVER (), 1.0) AS probability FROM f)")
    draw = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, mix_source, mix_lang, mix_topic, n_tokens, round(probability, 6) AS probability, ({draw} < probability)::INT AS kept FROM docs JOIN p USING (mix_source, mix_lang, mix_topic)"
