"""Fill-in-the-middle rows: a text cut into prefix, middle and suffix, and put together in another order.

A batch's texts are one run of UTF-8 bytes. Each byte is looked up in a table of classes; two adjacent classes tell
whether a unit (line, word or character) begins between them; sums of that mask that restart at each document number the
units; and one binary search in the sums places the cuts of all rows together. The draws come from a digest of the seed
and the document's id, made by Spark in the same projection, so that neither a retry nor another partitioning changes a
row. There is no shuffle.

Defined results: a null text is an empty one and stays plain, as does a text that holds one of the sentinels; a null id
draws like an empty one; equal rows have equal results; other columns pass through, and a clash of names raises
ValueError. Blocks of texts are bounded (textblocks.BLOCK_BYTES), and a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .textblocks import row_blocks, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
DRAWS = 4

OTHER, NEWLINE, BLANK, INNER = range(4)  # classes of bytes; INNER are the later bytes of a character
CLASS = np.zeros(256, np.uint8)
CLASS[0x80:0xC0] = INNER
CLASS[[0x20, 0x09, 0x0D]] = BLANK
CLASS[0x0A] = NEWLINE

#: Whether a unit begins at a byte, by the class of the byte before it (row) and its own (column).
BEGINS = {
    "line": np.array([[a == NEWLINE for b in range(4)] for a in range(4)]),
    "word": np.array([[a in (NEWLINE, BLANK) and b not in (NEWLINE, BLANK) for b in range(4)] for a in range(4)]),
    "character": np.array([[b != INNER for b in range(4)] for a in range(4)]),
}


def cuts(raw: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit: str = "line") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units of each row, first cut, second cut) of the rows raw[offsets[i] : offsets[i + 1]]; a cut is a place in raw.

    draws has two columns; a cut comes after draw modulo (units + 1) units of its row.
    """
    kind = CLASS[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[1:-1] = BEGINS[unit][kind[:-1], kind[1:]]
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True  # a document's first byte begins its first unit
    number = np.cumsum(begins[:-1], dtype=np.int64)  # of the unit that a byte is in, over the block
    before = np.append(0, number)[offsets[:-1]]  # a document's numbers restart after this
    units = np.append(0, number)[offsets[1:]] - before
    after = np.sort(draws % (units + 1)[:, None], axis=1)
    at = np.searchsorted(number, before[:, None] + after + 1, side="left")
    at = np.minimum(at, offsets[1:, None])  # after the last unit: the end of the row
    return units, at[:, 0], at[:, 1]


def _check(sentinels: tuple[str, ...]) -> None:
    """No sentinel may overlap another or itself, else a text next to one could look like another."""
    for a, b in product(sentinels, repeat=2):
        if not a or (a != b and a in b) or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError(f"the sentinels {a!r} and {b!r} overlap")


def _kernel(raw: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit: str, rate: int, spm: int, sentinels: tuple[str, ...]) -> list[pa.Array]:
    n = len(offsets) - 1
    units, one, two = cuts(raw, offsets, draws[:, :2], unit)
    body = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
    plain = (np.diff(offsets) == 0) | (draws[:, 2] % 100 >= rate)
    for s in sentinels:
        plain |= pc.match_substring(body, s).to_numpy(zero_copy_only=False)
    swapped = draws[:, 3] % 100 < spm
    chars = np.append(0, np.cumsum(CLASS[raw] != INNER, dtype=np.int64))
    form = np.where(plain, "plain", np.where(swapped, "spm", "psm"))
    view, (p, s, m) = memoryview(np.ascontiguousarray(raw)), (x.encode() for x in sentinels)
    parts: list[bytes | memoryview] = []
    for kind, lo, a, b, hi in zip(form.tolist(), offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist()):
        if kind == "plain":
            parts.append(view[lo:hi])
        elif kind == "psm":
            parts += (p, view[lo:a], s, view[b:hi], m, view[a:b])
        else:
            parts += (s, view[b:hi], p, view[lo:a], m, view[a:b])
    sizes = np.diff(offsets) + np.where(plain, 0, len(p) + len(s) + len(m))
    ends = np.append(0, np.cumsum(sizes)).astype(np.int64)
    output = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(b"".join(parts)))
    spans = [pa.array(np.diff(chars[[x, y]], axis=0)[0] if n else np.zeros(0, np.int64), pa.int64(), mask=plain) for x, y in ((offsets[:-1], one), (one, two))]
    return [pa.array(units, pa.int64()), pa.array(form.tolist(), pa.string()), *spans, output]


def draw(key: str, seed: int) -> Column:
    """Four unsigned 32-bit integers: the first groups of eight digits of the SHA-256 of seed, a colon and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(DRAWS)))


def transform(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, unit: str = "line", rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)
) -> DataFrame:
    """df with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and output.

    `rate` of a hundred texts are cut, `spm` of a hundred of those with the suffix first; sentinels stand before prefix,
    suffix and middle. ValueError if a sentinel overlaps another, or for a column that is there already.
    """
    _check(sentinels)
    if unit not in BEGINS:
        raise ValueError(f"a unit is one of {', '.join(BEGINS)}")
    added = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    clash = {f.name for f in added} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the input already has {', '.join(sorted(clash))}")
    drawn = "_draws"
    while drawn in df.columns:
        drawn += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(text))
            draws = np.asarray(batch.column(drawn).flatten()).reshape(-1, DRAWS)
            kept = batch.drop_columns([drawn])
            for lo, hi in row_blocks(offsets):
                some = raw[offsets[lo] : offsets[hi]]
                made = _kernel(some, offsets[lo : hi + 1] - offsets[lo], draws[lo:hi], unit, rate, spm, sentinels)
                made[-1] = made[-1].cast(pa.string())
                part = kept.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *(f.name for f in added)])

    ship(df.sparkSession)
    return df.withColumn(drawn, draw(key, seed)).mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def restore(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of transform() was made from, as an expression; each sentinel occurs once in it."""
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text restored from it."""
    made = transform(df.select(key, text), key, text)
    return made.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    return """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), split AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS parts,
    length(t) - length(replace(t, chr(10), '')) + CASE WHEN t <> '' AND right(t, 1) <> chr(10) THEN 1 ELSE 0 END AS n,
    CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
  FROM drawn
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM split
), cut AS (
  SELECT doc_id, n, form, t,
    CASE WHEN a = 0 THEN '' WHEN a = n THEN t ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS upto_a,
    CASE WHEN b = 0 THEN '' WHEN b = n THEN t ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS upto_b
  FROM placed
), spans AS (
  SELECT doc_id, n, form, t, upto_a AS p, substr(upto_b, length(upto_a) + 1) AS m, substr(t, length(upto_b) + 1) AS s FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM spans
"""
