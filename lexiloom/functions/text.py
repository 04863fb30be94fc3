"""Text functions as Column expressions; Arrow UDFs only where no expression has the semantics."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space as Unicode's isspace, and tokens (a run of letters, digits, underscores, or one other visible character).
WS = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + WS + "]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space text."""
    return F.coalesce(~text.rlike(f"[^{WS}]"), F.lit(True))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+\\z", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(rstrip(text), f"\\A[{WS}]+", "")


def one_line(text: Column) -> Column:
    """Line breaks to blanks, ends trimmed."""
    return strip(F.regexp_replace(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", " "))


def tsv_escape(text: Column) -> Column:
    r"""Backslash, TAB, LF, CR as \\, \t, \n, \r."""
    for raw, out in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(out))
    return text


def bound_batches(spark: SparkSession | None, most: int = 8 << 20) -> None:
    """Let no Arrow batch that goes to Python exceed `most` bytes by more than a row, where the session allows more. The setting stays for the
    session: it is read when the result is computed."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None:
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def sliced(*columns: pa.Array, rows: int = 64):
    """Rows of Arrow columns as tuples of Python values (lists as numpy arrays), so many rows at a time: as Python strings, the tokens of a batch
    take many times its bytes."""
    for start in range(0, len(columns[0]), rows):
        yield from zip(*(c.slice(start, rows).to_numpy(zero_copy_only=False) for c in columns))


def edit_distance(a, b) -> int:
    """Levenshtein distance of two sequences: equal ends are left out, then one column of the table at a time as the bits of two integers."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # where the column grows and shrinks from one cell to the next
    for x in b:
        same = where.get(x, 0)
        flat = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (full & ~(flat | up)), up & flat
        distance += bool(right_up & last) - bool(right_down & last)
        right_up = (right_up << 1 | 1) & full
        up, down = ((right_down << 1) & full) | (full & ~(flat | right_up)), right_up & flat
    return distance


def _struct(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array((r[i] for r in rows), kind, size=len(rows)) for i in range(len(names))], names)


def _distances(a: pa.Array, b: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
    rows = [(0, len(x), 0, len(p)) if x == y else (edit_distance(x, y), max(len(x), len(y)), edit_distance(p.tolist(), q.tolist()), max(len(p), len(q))) for x, y, p, q in sliced(a, b, left, right)]
    return _struct(rows, ["char_distance", "char_length", "word_distance", "word_length"], pa.int32())


def _char_distances(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = [(0, len(x)) if x == y else (edit_distance(x, y), max(len(x), len(y))) for x, y in sliced(a, b)]
    return _struct(rows, ["char_distance", "char_length"], pa.int32())


def with_char_distances(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Add char_distance and char_length alone: tokens are neither cut nor sent. Both texts are not null."""
    bound_batches(pairs.sparkSession)
    made = F.arrow_udf(_char_distances, "char_distance int, char_length int")(F.col(a), F.col(b))
    return pairs.withColumn("_distances", made).select(*pairs.columns, "_distances.*")


def with_distances(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Add identical and, for characters and words, distance, longer length and their quotient (0 where both are empty). Both texts are not null.

    Lengths and distances come from one Arrow function, called once for each row."""
    bound_batches(pairs.sparkSession)
    made = F.arrow_udf(_distances, "char_distance int, char_length int, word_distance int, word_length int")(F.col(a), F.col(b), tokens(F.col(a)), tokens(F.col(b)))
    rows = pairs.withColumn("_distances", made).select(*pairs.columns, (F.col(a) == F.col(b)).alias("identical"), "_distances.*")
    part = lambda u: F.when(F.col(f"{u}_length") > 0, F.col(f"{u}_distance") / F.col(f"{u}_length")).otherwise(F.lit(0.0)).alias(f"{u}_normalized")
    return rows.select("*", part("char"), part("word"))


def safe_exp(x: Column) -> Column:
    """exp, null from 709 on."""
    return F.when(x < 709, F.exp(x))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)


def describe(x: Column) -> Column:
    """count, mean, median, p10, p90 with linear interpolation."""
    p = F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return F.struct(F.count(x).alias("count"), F.avg(x).alias("mean"), p[1].alias("median"), p[0].alias("p10"), p[2].alias("p90"))


def blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the equal stretches of the two lists by gestalt matching, and the empty one at both ends."""
    return [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]


def _aligned(a: pa.Array, b: pa.Array) -> pa.Array:
    rows = []
    for x, y in sliced(a, b):
        equal = changed = at_x = at_y = 0
        for i, j, n in blocks(x.tolist(), y.tolist()) if x is not None and y is not None else ():
            changed += max(i - at_x, j - at_y)  # the gap before this stretch
            equal, at_x, at_y = equal + n, i + n, j + n
        rows.append((equal, changed))
    return _struct(rows, ["equal", "changed"], pa.int64())


def alignment(a: Column, b: Column) -> Column:
    """Of two token lists: struct of equal, the tokens in equal stretches, and changed, the sum over the gaps between them of the longer side."""
    bound_batches(SparkSession.getActiveSession())
    return F.arrow_udf(_aligned, "equal long, changed long")(a, b)


def edit_fraction(a: Column, b: Column) -> Column:
    """Changed tokens over those of the longer text (at least 1); not bounded by 1. Null where a text is null."""
    left, right = tokens(a), tokens(b)
    part = alignment(left, right)["changed"] / F.greatest(F.size(left), F.size(right), F.lit(1))
    return F.when(a.isNotNull() & b.isNotNull(), part)


def case_folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Full case folding: characters that become one other character, those characters, and the ones that become several."""
    changed = [(c, f) for c in map(chr, range(sys.maxunicode + 1)) if (f := c.casefold()) != c and not "\ud800" <= c <= "\udfff"]
    one = [(c, f) for c, f in changed if len(f) == 1]
    return "".join(c for c, _ in one), "".join(f for _, f in one), [(c, f) for c, f in changed if len(f) > 1]


def folded(text: Column) -> Column:
    """Punctuation to blanks, then full case folding."""
    source, target, longer = case_folding()
    text = F.regexp_replace(text, r"\p{P}", " ")
    for c, f in longer:
        text = F.replace(text, F.lit(c), F.lit(f))
    return F.translate(text, source, target)


def folded_tokens(text: Column) -> Column:
    """Tokens without punctuation and case differences."""
    return tokens(folded(text))
