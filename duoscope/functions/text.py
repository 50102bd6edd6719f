"""Text column functions: names, labels, token lists, flags and keyword grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_column, clip, finite

# Texts that stand for a missing value, and for true.
MISSING_TEXTS = ["nan", "none", "null", "<na>"]
TRUE_TEXTS = ["1", "true", "yes", "y", "t"]
# Words that mark a name as of agreeing views.
CONSISTENT_WORDS = ["consistent", "concordant", "agreement", "aligned"]


def _text(c: Column | str) -> Column:
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def column_name(c: Column | str) -> Column:
    """Lower case, with blanks, hyphens and slashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(_text(c))), "[ \\-/]", "_")


def free_text(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(c), "\\s+", " "))


def lookup_text(c: Column | str) -> Column:
    """Lower case; underscores and hyphens are blanks; only letters, digits, &, / and commas stay."""
    x = F.regexp_replace(F.lower(_text(c)), "[_-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9&/,\\s]", ""), "\\s+", " "))


def list_text(c: Column | str) -> Column:
    return F.regexp_replace(free_text(c), "\\s*,\\s*", ",")


def token_list(c: Column | str, separators: str = ",") -> Column:
    """Normalised tokens in order, blanks left out, repeats kept."""
    parts = F.transform(F.split(_text(c), f"[{separators}]"), lookup_text)
    return F.filter(parts, lambda t: t != "")


def weight_list(c: Column | str, tokens: Column) -> Column:
    """One weight a token: bad or missing ones are 1, surplus ones are left out."""
    given = F.split(_text(c), ",")
    return F.transform(F.slice(F.transform(tokens, lambda t, i: i), 1, F.size(tokens)), lambda i: F.coalesce(finite(F.get(given, i)), F.lit(1.0)))


def cluster_number(c: Column | str) -> Column:
    """0 to 3 from the first "C0" to "C3" or lone digit in the text, else from a number in that range, else null."""
    x = _text(c)
    found = F.nullif(F.regexp_extract(x, "C?\\s*([0-3])\\b", 1), F.lit(""))
    whole = finite(x).try_cast("int")
    return F.coalesce(found.cast("int"), F.when((whole >= 0) & (whole <= 3), whole))


def first_integer(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_text(c), "-?\\d+", 0), F.lit("")).try_cast("bigint"), F.lit(2**31 - 1).cast("bigint"))


def truthy(c: Column | str) -> Column:
    return F.lower(F.trim(_text(c))).isin(TRUE_TEXTS)


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def report_text(c: Column | str) -> Column:
    x = F.trim(_text(c))
    return F.when(F.lower(x).isin(MISSING_TEXTS), "").otherwise(x)


def feature_parts(c: Column | str) -> tuple[Column, Column]:
    """(field, token) of "field::token"; without a mark the whole is the token."""
    x = _text(c)
    marked = x.contains("::")
    return F.when(marked, F.substring_index(x, "::", 1)).otherwise(""), F.when(marked, F.regexp_replace(x, "^.*?::", "")).otherwise(x)


def distinct_display(tokens: Column, limit: int) -> Column:
    """First `limit` tokens, the first of each lower-case form."""
    lowered = F.transform(tokens, lambda t: F.lower(t))
    firsts = F.filter(tokens, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)
    return F.slice(firsts, 1, limit)


def macro_micro(c: Column | str) -> tuple[Column, Column, Column]:
    """(macro, micro ordinal, micro letter) of "M2-b"; nulls where a part is missing."""
    x = _text(c)
    macro = F.nullif(F.regexp_extract(x, "^M(\\d+)", 1), F.lit("")).cast("int")
    letter = F.nullif(F.regexp_extract(x, "^M\\d+-([a-z])$", 1), F.lit(""))
    return macro, (F.ascii(letter) - 97).cast("int"), letter


def va_pair(v: Column | str, a: Column | str) -> Column:
    v, a = finite(v), finite(a)
    return F.when(v.isNull() | a.isNull(), "").otherwise(F.format_string("%.4f,%.4f", v, a))


def percent_text(c: Column | str) -> Column:
    """One decimal; exact halves go to the even digit."""
    x = as_column(c) * 100
    low = F.floor(x * 10)
    even = (x * 10 - low == 0.5) & (F.pmod(low, F.lit(2)) == 0)
    return F.format_string("%.1f%%", F.when(even, low / 10.0).otherwise(x))


def has_encoding_issue(*columns: Column | str) -> Column:
    joined = F.concat_ws(" ", *(as_column(c) for c in columns))
    return joined.contains("\ufffd") | joined.contains("\u951f")


def has_word(words: list[str], *columns: Column | str) -> Column:
    """Any of the words, whole and in either case."""
    return F.concat_ws(" ", *(as_column(c) for c in columns)).rlike(f"(?i)\\b({'|'.join(words)})\\b")


def contains_any(c: Column | str, words: list[str]) -> Column:
    low = F.lower(_text(c))
    out = F.lit(False)
    for w in words:
        out |= low.contains(w)
    return out


def consistent(*columns: Column | str) -> Column:
    return contains_any(F.concat_ws(" ", *(as_column(c) for c in columns)), CONSISTENT_WORDS)


def keyword_grade(c: Column | str, words: list[str]) -> Column:
    """0 to 3: how many of the words the text holds, as substrings."""
    low = F.lower(_text(c))
    return F.least(F.lit(3), sum((low.contains(w).cast("int") for w in words), F.lit(0)))


def agreement_grade(c: Column | str) -> Column:
    """0 to 3 from words or a number, else null."""
    low = F.lower(F.trim(_text(c)))
    named = F.when(low.isin("strong", "high"), 3).when(low.isin("moderate", "medium"), 2).when(low.isin("weak", "low"), 1).when(low.isin("none", "no"), 0)
    return F.coalesce(named, clip(F.floor(finite(low) + 0.5).cast("double"), 0, 3).cast("int"))


def split_name(c: Column | str) -> Column:
    low = F.lower(F.trim(_text(c)))
    return F.when(low == "validate", "val").otherwise(low)


def label_number(c: Column | str) -> Column:
    """Label text to 0..3 or -1: Q1..Q4 and 1..4 by name, then a number 0..3 as it is."""
    x = F.upper(F.trim(_text(c)))
    out = F.lit(None).cast("int")
    for i in range(4):
        out = F.coalesce(out, F.when(x.isin(f"Q{i + 1}", str(i + 1)), i))
    whole = F.when(finite(x) == F.floor(finite(x)), finite(x).cast("int"))
    return F.coalesce(out, F.when((whole >= 0) & (whole <= 3), whole), F.lit(-1))
