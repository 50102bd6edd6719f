"""The prefix trie of conversations: every distinct sequence of first turns is a node, with what shares it below.

A node's key is 128 bits: the exclusive or of a hash of (place, role and text) over its turns. So a prefix's key is a
running aggregate, which slices of a conversation make alone and small tables of carries complete; a conversation of
any length is spread over tasks. Each partition combines its nodes before anything is shuffled (a partial trie: members,
least conversation, end lists by blocks of ids); partial tries are merged by key in rounds of FAN, until one is left. Sums
over subtrees go bottom-up with pointers that double their reach each round, so their number of rounds is the logarithm of
the depth that two conversations share; nodes of a single member need none. End lists are digested as streams, block
by block. Every round is a table in the shared folder, from which a lost executor's work is repeated.

Defined results: rows of null id belong to no conversation and are left out; a null role or text is an empty one; turns
are in ascending order, null first, and rows of one turn in the order of their digests; equal rows are turns of their own;
an empty table has no nodes. The remainder of a negative id is negative, as in SQL. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .storage import cut

FAN = 32  # partial tries that one merge takes together
IDS = 4096  # a block of an end list holds the ids of one range of this size
HEAD = 8  # turns at most that a conversation may take from another

KEY = ["a", "b"]


def _bits(half: str, place: Column, digest: Column) -> Column:
    """One 64-bit hash of a turn at a place; the halves a and b are independent."""
    return F.xxhash64(F.lit(half), digest, place.cast("long"))


def _running(bits: Column, upto: Column) -> Column:
    """The exclusive or of an array's first elements."""
    return F.aggregate(F.slice(bits, F.lit(1), upto), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, slice, place, digest, bytes) of each turn: place counts from 1 within the slice; a slice is a range of all turns in order."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), 256), 1, 32)
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes"))
    dealt = rows.repartitionByRange("conv", F.asc_nulls_first("turn"), "digest").withColumn("slice", F.spark_partition_id())
    own = Window.partitionBy("conv", "slice").orderBy(F.asc_nulls_first("turn"), "digest")
    return cut(dealt, "turns").withColumn("place", F.row_number().over(own).cast("long")).drop("turn")


def _carried(sums: DataFrame, total: Column, name: str) -> DataFrame:
    """`total` over the earlier slices of a conversation; only for slices that go on with one, of which each has one at most."""
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, total.over(before)).filter(F.col(name).isNotNull()).select("conv", "slice", name)


def members(conversations: DataFrame, heads: tuple[Column, Column] | None = None, **names: str) -> DataFrame:
    """(conv, depth, a, b, pa, pb, bytes, ends, part): a row for each conversation and node that it starts with.

    heads are two columns over `conv`, (other, n): the first n turns (HEAD at most) of the conversation `other` replace the
    first n of a conversation. part is the partition that has the row.
    """
    found = turns(conversations, **names)
    sizes = found.groupBy("conv", "slice").agg(F.count("*").alias("n"))
    every = sizes.groupBy("conv").agg(F.sum("n").alias("n"))
    other, h = heads or (F.col("conv"), F.lit(0))
    every = every.withColumns({"other": other, "h": F.least(h, F.lit(HEAD)).cast("long")})
    # the first HEAD turns of a conversation lie in few slices, and those of one slice are enough unless it goes on
    before = F.broadcast(_carried(sizes, F.sum("n"), "before"))  # a row a slice at most
    placed = found.join(before, ["conv", "slice"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("before")
    first = placed.filter(F.col("place") <= HEAD).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "bytes"))).alias("first"))
    info = every.join(first.withColumnRenamed("conv", "other"), "other", "left")
    info = info.withColumn("head", F.slice("first", F.lit(1), F.col("h").cast("int")))  # null if there is no such conversation
    info = info.withColumn("m", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).cast("long"))
    info = info.withColumns({f"bits_{k}": F.transform("head", lambda x: _bits(k, x["place"], x["digest"])) for k in KEY})
    info = info.withColumns({f"head_{k}": F.coalesce(_running(F.col(f"bits_{k}"), F.col("m").cast("int")), F.lit(0)) for k in KEY})
    info = cut(info.withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("first", "other", "n"), "conversations")

    root = info.select("conv", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(k) for k in KEY), *(F.lit(None).cast("long").alias(f"p{k}") for k in KEY), F.lit(0).cast("long").alias("bytes"), (F.col("size") == 0).alias("ends"))
    taken = info.filter("m > 0").select("conv", "size", "bits_a", "bits_b", F.posexplode("head").alias("i", "x"))
    taken = taken.select(
        "conv", (F.col("i") + 1).cast("long").alias("depth"), *(_running(F.col(f"bits_{k}"), F.col("i") + 1).alias(k) for k in KEY),
        *(_running(F.col(f"bits_{k}"), F.col("i")).alias(f"p{k}") for k in KEY), F.col("x.bytes").alias("bytes"), (F.col("size") == F.col("i") + 1).alias("ends"),
    )

    shift = sizes.join(info.select("conv", "h", "m", "size", "head_a", "head_b"), "conv").select("conv", "slice", "h", "m", "size", "head_a", "head_b")
    own = placed.join(shift, ["conv", "slice"]).filter("place > h").withColumn("depth", F.col("m") + F.col("place") - F.col("h"))
    own = own.withColumns({f"bit_{k}": _bits(k, F.col("depth"), F.col("digest")) for k in KEY})
    upto = Window.partitionBy("conv", "slice").orderBy("depth")
    own = own.withColumns({k: F.bit_xor(f"bit_{k}").over(upto).bitwiseXOR(F.col(f"head_{k}")) for k in KEY})
    own = cut(own.select("conv", "slice", "depth", "size", "bytes", *KEY, "bit_a", "bit_b"), "own")
    within = own.groupBy("conv", "slice").agg(*(F.bit_xor(f"bit_{k}").alias(f"sum_{k}") for k in KEY))
    for k in KEY:
        over = F.broadcast(_carried(within, F.bit_xor(f"sum_{k}"), "over"))  # a row a slice at most
        own = own.join(over, ["conv", "slice"], "left").withColumn(k, F.col(k).bitwiseXOR(F.coalesce("over", F.lit(0)))).drop("over")
    own = own.select("conv", "depth", *KEY, *(F.col(k).bitwiseXOR(F.col(f"bit_{k}")).alias(f"p{k}") for k in KEY), "bytes", (F.col("depth") == F.col("size")).alias("ends"))
    return root.unionByName(taken).unionByName(own).withColumn("part", F.spark_partition_id())


def merged(partial: DataFrame, keys: list[str], parts: int, **sums: Column) -> DataFrame:
    """Partial tries by `part` merged by key, FAN of them a round; sums are aggregates that take their own results again."""
    while True:
        parts = -(-parts // FAN)
        partial = partial.groupBy(*keys, F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(*(s.alias(n) for n, s in sums.items()))
        if parts <= 1:
            return partial.drop("part")


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of end lists in blocks (a, b, block, ids): read in order as streams, no list is ever whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if at == (a, b):
                    state.update(b",")
                else:
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield _digests(out)
        if at:
            yield _digests([(*at, state.hexdigest())])

    ship(ends.sparkSession)
    listed = ends.select(*KEY, "block", F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",").alias("ids"))
    return listed.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids").mapInArrow(run, "a long, b long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], [*KEY, "ends_sha256"])


def rolled_up(nodes: DataFrame, values: list[str], depth: int) -> DataFrame:
    """(a, b, values): sums over each node's subtree, for nodes (a, b, pa, pb, depth, values) of at most this depth.

    After round r a node has the sums of all less than 2**r below it, and its pointer is its ancestor 2**r above.
    """
    reach = 1
    while reach <= depth:
        below = nodes.filter(F.col("pa").isNotNull()).groupBy("pa", "pb").agg(*(F.sum(v).alias(f"_{v}") for v in values)).withColumnsRenamed({"pa": "a", "pb": "b"})
        more = nodes.join(below, KEY, "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(*(f"_{v}" for v in values))
        up = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("qa"), F.col("pb").alias("qb")).filter("qa is not null")
        more = more.join(up, ["pa", "pb"], "left").drop("pa", "pb").withColumnsRenamed({"qa": "pa", "qb": "pb"})
        nodes, reach = cut(more, "rollup"), 2 * reach
    return nodes.select(*KEY, *values)


def prefix_trie(conversations: DataFrame, heads: tuple[Column, Column] | None = None, **names: str) -> DataFrame:
    """A row a node, the root included: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, and over its
    subtree n_leaves and saved_tokens (bytes of last texts that members share, once for each member but one), and
    ends_sha256 of the ascending ids of the conversations that end there.

    names may give the columns conv, turn, role and text; heads as in members().
    """
    found = cut(members(conversations, heads, **names), "members")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    sums = dict(pa=F.max("pa"), pb=F.max("pb"), depth=F.max("depth"), conv=F.min("conv"), bytes=F.max("bytes"), n_convs=F.sum("n_convs"))
    nodes = cut(merged(found.withColumn("n_convs", F.lit(1).cast("long")), KEY, parts, **sums), "nodes")
    ending = found.filter("ends").select(*KEY, "part", F.floor(F.col("conv") / IDS).alias("block"), F.array("conv").alias("ids"))
    digests = end_digests(merged(ending, [*KEY, "block"], parts, ids=F.flatten(F.collect_list("ids"))))

    kids = nodes.filter("pa is not null").groupBy("pa", "pb").agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    trie = cut(nodes.join(kids.withColumnsRenamed({"pa": "a", "pb": "b"}), KEY, "left").na.fill(0, ["n_children", "lone"]), "trie")
    shared = trie.filter("n_convs > 1").select(*KEY, "pa", "pb", "depth", (F.col("lone") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    sums_below = rolled_up(shared, ["n_leaves", "saved_tokens"], deepest)

    parents = trie.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    whole = trie.join(parents, ["pa", "pb"], "left").join(sums_below, KEY, "left").join(digests, KEY, "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def shared_heads(every: int = 5, most: int = HEAD + 1) -> tuple[Column, Column]:
    """heads that give each run of `every` ids the first turns of its first conversation, crc32(id) modulo `most` of them."""
    conv = F.col("conv")
    return conv - conv % every, F.crc32(conv.cast("string").cast("binary")) % most


def oracle_sql() -> str:
    """The same trie from prefixes as lists, subtrees by every pair of node and ancestor."""
    return """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, octet_length(encode(coalesce(text, ''))) AS nb,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda s, v: CASE WHEN v >= 0 THEN xor(s, v) ELSE xor(s >> 1, 3988292384 * (s & 1)) END, CAST(4294967295 AS BIGINT))) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)
), heads AS (
  SELECT convs.c, t.p AS d, r, x, nb FROM convs JOIN t ON t.c = base AND t.p <= h
), owned AS (
  SELECT convs.c, t.p - h + coalesce(taken.m, 0) AS d, r, x, nb FROM convs JOIN t ON t.c = convs.c AND t.p > h LEFT JOIN (SELECT c, count(*) AS m FROM heads GROUP BY c) taken ON taken.c = convs.c
), rows AS (
  SELECT * FROM heads UNION ALL SELECT * FROM owned
), members AS (
  SELECT c, 0 AS d, sha256('') AS node, 0 AS nb FROM convs
  UNION ALL
  SELECT c, d, sha256(string_agg(sha256(r) || sha256(x), ' ') OVER (PARTITION BY c ORDER BY d)), nb FROM rows
), ending AS (
  SELECT c, max(d) AS size FROM members GROUP BY c
), nodes AS (
  SELECT node, d, min(m.c) AS c, count(*) AS n, max(nb) AS nb,
    sha256(coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (size = d), '')) AS ends
  FROM members m JOIN ending ON ending.c = m.c GROUP BY node, d
), up AS (
  SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN members m ON m.c = n.c AND m.d = n.d - 1 LEFT JOIN nodes p ON p.node = m.node AND p.d = m.d
), kids AS (
  SELECT parent, count(*) AS n FROM up GROUP BY parent
), sums AS (
  SELECT a.node, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.nb) AS saved
  FROM up u LEFT JOIN kids ON kids.parent = u.node JOIN members a ON a.c = u.c AND a.d <= u.d GROUP BY a.node
)
SELECT u.c AS conv_id, CAST(u.d AS BIGINT) AS depth, p.c AS parent_conv_id, u.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, u.ends AS ends_sha256
FROM up u LEFT JOIN nodes p ON p.node = u.parent LEFT JOIN kids ON kids.parent = u.node JOIN sums ON sums.node = u.node
"""
