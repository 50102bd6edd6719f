"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text is a bag of white-space words; a word's weight is its count. For each of SAMPLES samples and each word, hashes
of (word, sample) give r and c, gamma variables of shape 2, and b, uniform. With t = floor(ln(weight) / r + b) the
word's value is ln c - r (t - b + 1); the word of least value and its t are the sample. Two bags give the same sample
with the probability of their generalised Jaccard similarity, sum of minima over sum of maxima of weights.

The least value of a text of n words is below ln(SURE / n) but for a chance of exp(-SURE), as its exponential is of
rate n; only words that a bound without logarithms does not put above that have their values computed. Should none
be below it, the sample is the word of least plain hash, which changes a likeness by that chance at most.

The word counts of a document are aggregated by (document, word), then the least values by document, both below one
exchange by document, so no word or group is hot. A signature is 16 bits of each sample's (word, t).

Defined results: a null or empty text, or one of white space alone, has the fingerprint of EMPTY; two of these are of
likeness 1, one of these and any other text of 0. Rows that repeat an id are one document; rows of null id are left
out. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

SAMPLES = 64
GROUP = 2  # samples that one row evaluates at once: keeps generated methods small enough to be compiled
SURE = 18.0  # a text's least value is above ln(SURE / words) with the probability exp(-SURE)
EMPTY = "-"
_SPACE = "[ \\n\\r\\t]+"


def _unit(bits: Column, shift: int) -> Column:
    """21 bits as a number between 0 and 1, neither included."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0x1FFFFF)).cast("double") + 0.5) * (2.0**-21)


def _uniforms(term: Column, seed: Column) -> dict[str, Column]:
    """What one sample draws for a word: p and q, products of two uniforms; b, uniform; the signature's bits and a plain hash."""
    one, two = (F.xxhash64(term, seed * 2 + i) for i in range(2))
    return {
        "p": _unit(one, 0) * _unit(one, 21),
        "q": _unit(two, 0) * _unit(two, 21),
        "b": _unit(one, 42),
        "bits": F.shiftrightunsigned(two, 42).bitwiseAND(F.lit(0xFFFF)),
        "hash": F.shiftrightunsigned(one, 2).bitwiseOR(F.lit(1 << 62)),
    }


def _may_be_least(p: Column, q: Column, b: Column, limit: Column, once: Column) -> Column:
    """False only if the word's value is certainly above ln of what `limit` (a bound times the weight) stands for.

    Without logarithms: -ln q >= 2 (1 - q) / (1 + q), and for weight 1, p^(1 - b) >= p / (1 - b + b p).
    """
    return 2 * (1 - q) * p < (1 + q) * limit * F.when(once, 1 - b + b * p).otherwise(1.0)


def _packed(p: Column, q: Column, b: Column, bits: Column, log_weight: Column) -> Column:
    """One number for a weight: the word's value above, the signature in the low 16 bits."""
    r = -F.log(p)
    t = F.floor(log_weight / r + b)
    rank = (F.greatest(F.log(-F.log(q)) - r * (t - b + 1), F.lit(-4000.0)) + 4000.0) * float(2**33)
    return F.shiftleft(rank.cast("long"), 16).bitwiseOR(bits.bitwiseXOR(t.bitwiseAND(F.lit(0xFFFF))))


def words_of(text: Column) -> Column:
    return F.split(text, _SPACE)


def signatures(texts: DataFrame, names: list[str], key: str = "id", samples: int = SAMPLES, carried: list[Column] | None = None) -> DataFrame:
    """key and, for each text column named, an array of `samples` 16-bit signatures of (nullable) integers.

    `texts` should be partitioned by key already; then nothing is exchanged here. Integers to carry along go through
    the aggregates as rows of their own (k0, k1, ...), so that the texts need not be made twice.
    """
    carried = carried or []
    of = [F.struct(F.lit(i).alias("which"), words_of(F.col(c)).alias("words"), F.lit(0).cast("long").alias("value")) for i, c in enumerate(names)]
    of += [F.struct(F.lit(-1 - i).alias("which"), F.array(F.lit("x")).alias("words"), v.cast("long").alias("value")) for i, v in enumerate(carried)]
    words = texts.select(key, F.explode(F.array(*of)).alias("of"))
    words = words.select(key, F.col("of.which").alias("which"), F.col("of.value").alias("value"), F.size("of.words").alias("size"), F.explode("of.words").alias("word")).filter("word <> ''")
    term = F.when(F.col("which") >= 0, F.xxhash64("word")).otherwise(F.col("which"))
    counts = words.select(key, (F.col("which") < 0).alias("kept"), term.alias("term"), "which", "value", "size").groupBy(key, "kept", "term")
    counts = counts.agg(F.max("value").alias("value"), F.min("size").alias("size"), *(F.count_if(F.col("which") == i).alias(f"n{i}") for i in range(len(names))))
    logs = [F.when(F.col(f"n{i}") > 0, F.log(F.col(f"n{i}").cast("double"))).alias(f"w{i}") for i in range(len(names))]
    heaviest = F.greatest(F.lit(0), *(F.col(f"n{i}") for i in range(len(names))))
    parts = F.sequence(F.lit(0), F.when(F.col("kept"), 0).otherwise(samples // GROUP - 1))
    limits = [(heaviest <= 1).alias("once"), (heaviest * SURE / F.col("size")).alias("limit")]
    rows = counts.select(key, "term", "kept", "value", *limits, *logs).withColumn("part", F.explode(parts))
    drawn: dict[str, Column] = {}
    packed: dict[str, Column] = {}
    values = [F.max(F.when(F.col("kept") & (F.col("term") == -1 - i), F.col("value"))).alias(f"k{i}") for i in range(len(carried))]
    for j in range(GROUP):  # the draws of a word are columns of their own, made once for all its weights
        drawn |= {f"{d}{j}": v for d, v in _uniforms(F.col("term"), F.col("part") * GROUP + j).items()}
        p, q, b, bits, plain = (F.col(f"{d}{j}") for d in ("p", "q", "b", "bits", "hash"))
        maybe = _may_be_least(p, q, b, F.col("limit"), F.col("once"))
        for i in range(len(names)):
            w, value = F.col(f"w{i}"), None
            for earlier in range(i):  # most words have one weight in all texts
                same = w == F.col(f"w{earlier}")
                value = F.when(same, F.col(f"v{earlier}_{j}")) if value is None else value.when(same, F.col(f"v{earlier}_{j}"))
            first = w.isNotNull() & maybe
            value = F.when(first, _packed(p, q, b, bits, w)) if value is None else value.when(first, _packed(p, q, b, bits, w))
            packed[f"v{i}_{j}"] = value.when(w.isNotNull(), plain)
            values.append(F.min(f"v{i}_{j}").alias(f"m{i}_{j}"))
    rows = rows.withColumns(drawn)
    for i in range(len(names)):
        rows = rows.withColumns({c: v for c, v in packed.items() if c.startswith(f"v{i}_")})
    least = rows.groupBy(key, "part").agg(*values)
    low = [F.array(*(F.col(f"m{i}_{j}").bitwiseAND(F.lit(0xFFFF)).cast("int") for j in range(GROUP))).alias(f"s{i}") for i in range(len(names))]
    kept = [F.max(f"k{i}").alias(f"k{i}") for i in range(len(carried))]
    whole = least.select(key, "part", *(f"k{i}" for i in range(len(carried))), *low).groupBy(key)
    whole = whole.agg(*kept, F.sort_array(F.collect_list(F.struct("part", *(f"s{i}" for i in range(len(names)))))).alias("parts"))
    return whole.select(key, *(f"k{i}" for i in range(len(carried))), *(_whole(F.flatten(F.col(f"parts.s{i}"))).alias(c) for i, c in enumerate(names)))


def _whole(signature: Column) -> Column:
    """A signature, or null for a text without words."""
    return F.when(F.isnotnull(signature[0]), signature)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 if one has none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / float(samples)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits for each sample."""
    return F.coalesce(F.concat_ws("", F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0"))), F.lit("")).alias("t")


def next_ids(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, next): the next smaller id, and the largest for the smallest. ids are cut into ranges; only their ends meet."""
    ranged = ids.select(F.col(key).cast("long").alias("id")).filter("id is not null").distinct().repartitionByRange("id").select("id", F.spark_partition_id().alias("range"))
    ranged = cut(ranged, "ids")
    ends = ranged.groupBy("range").agg(F.max("id").alias("largest"))
    ends = ends.select("range", "largest").crossJoin(ends.agg(F.max("largest").alias("top")))  # one row on the right
    before = F.lag("largest").over(Window.orderBy("range"))  # one row a partition: as many as there are tasks
    ends = ends.select("range", F.coalesce(before, "top").alias("before"))
    inside = F.lag("id").over(Window.partitionBy("range").orderBy("id"))
    return ranged.withColumn("inside", inside).join(ends, "range").select("id", F.coalesce("inside", "before").alias("next"))


def edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, text, edited, next): the last third of each text replaced by the first as much of the next document."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")).filter("id is not null").dropDuplicates(["id"])
    sizes = df.select(F.col(key).cast("long").alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars")).dropDuplicates(["id"])
    pairs = next_ids(df, key).join(sizes, "id")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    heads = pairs.select(F.col("id").alias("of"), F.col("next").alias("id"), "n_chars").join(docs, "id")
    heads = heads.select(F.col("of").alias("id"), F.col("id").alias("next"), "n_chars", F.substring("text", F.lit(1), third).alias("head"))
    both = docs.join(heads, "id")
    changed = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), "head")
    return both.select("id", "n_chars", "text", changed.alias("edited"), "next")


def compare(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and edited texts, and their likenesses."""
    texts = edited(df, key, text).withColumn("sha", F.sha2("edited", 256))
    pieces = [F.conv(F.substring("sha", 1 + 15 * i, 15), 16, 10).cast("long") for i in range(5)]
    carried = [F.col("next"), F.col("n_chars"), *pieces]
    found = cut(signatures(texts, ["text", "edited"], carried=carried), "signatures")
    digits = [F.lpad(F.lower(F.hex(F.col(f"k{i + 2}"))), 15 if i < 4 else 4, "0") for i in range(5)]
    rows = found.select("id", F.col("k0").alias("next"), F.col("k1").alias("n_chars"), F.concat(*digits).alias("edited_sha256"), "text", "edited")
    other = found.select(F.col("id").alias("next"), F.col("text").alias("after"))
    rows = rows.join(other, "next", "left")
    shown = lambda c: F.when(F.col(c).isNull(), EMPTY).otherwise(as_text(F.col(c)))
    return rows.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", shown("text").alias("fingerprint"), shown("edited").alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("after")).alias("near_next"),
    )
