"""Document fingerprints from closed syncmers, in DataFrame functions only.

The symbols are characters, A-Z lower-cased. A k-mer is `k` characters in a row, its inner substrings are the s-mers of `s` characters in it.
A k-mer is chosen when the smallest s-mer hash in it lies at its first or last place. The choice looks at nothing outside the k-mer, so a
passage gives the same anchors wherever it stands. The fingerprint is all anchors in order of position: 8 hex digits of the position (from 0)
and 8 of the k-mer's hash each. Two fingerprints are matched by hash and relative position: the likeness is the Jaccard index of their sets of
(anchor's hash, next anchor's hash, distance between the two), so a shared passage is seen wherever it stands.

One pattern with a lookahead gives all s-mers; the least value inside a k-mer is made from those of four s-mers in a row, so k-s-1 is 1, 2 or
divided by four. A text of which no k-mer is chosen is one anchor, the hash of the whole; an empty text has the empty fingerprint, whose likeness
to another empty one is 1 and to any other 0. Null texts are empty texts. Very long texts are one row each and fingerprinted whole. An empty
table gives an empty result. Columns of docs other than doc_id and text are not read, so their names cannot clash.

Texts move once: rows are dealt by ranges of doc_id, anchors are made after that, once for each text, and a row takes text and anchors of the
next row of its range. The first text of each range goes to the range before it.

The edited text is the document without its last quarter, and as many characters of the next document's beginning. Its anchors are those of
the two that lie within the parts, and those of the few characters where they meet.
Rows with one doc_id more than once: each row is fingerprinted; as "next document" the row with the smallest text stands for the id. The row
after a null id is that of the smallest id. A table whose only id is a document's own has that document as its next one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions

LOW = 0xFFFFFFFF


def with_anchors(df: DataFrame, text: str, out: str, k: int = 25, s: int = 8) -> DataFrame:
    """Add column `out`: the closed syncmers of a text column, ascending (array<bigint>, position in the upper and hash in the lower half)."""
    inner = k - s  # index of the last s-mer in a k-mer
    if inner < 2 or (inner > 3 and (inner - 1) % 4):
        raise ValueError("k - s - 1 must be 1, 2 or divided by four")
    h, m = f"{out}_h", f"{out}_m"
    folded = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    df = df.withColumn(h, F.transform(F.regexp_extract_all(folded, F.lit(f"(?s)(?=(.{{{s}}})).")), lambda x: F.xxhash64(x)))
    # Least values of four s-mers in a row, or of as many as there are between the first and the last; a k-mer's inside is covered by some of them.
    n = min(4, inner - 1)
    at, low = lambda i: F.get(F.col(h), i), lambda i: F.get(F.col(m), i)
    df = df.withColumn(m, F.transform(F.col(h), lambda x, i: F.least(x, *[at(i + j) for j in range(1, n)]) if n > 1 else x))
    middle, *others = sorted(range(1, inner, n), key=lambda j: abs(j - inner // 2))
    least = lambda parts: F.least(*parts) if len(parts) > 1 else parts[0]

    def smallest_at_an_end(x: Column, i: Column) -> Column:  # two of three k-mers fail by the middle alone
        ends = F.least(x, at(i + inner))
        return (ends <= low(i + middle)) & (ends <= least([low(i + j) for j in others])) if others else ends <= low(i + middle)

    kmer = lambda i: F.shiftleft(i.cast("long"), 32).bitwiseOR(F.xxhash64(*[at(i + j) for j in (*range(0, inner, s), inner)]).bitwiseAND(F.lit(LOW)))
    chosen = lambda x, i: F.when(smallest_at_an_end(x, i), F.when(at(i + inner).isNotNull(), kmer(i)))
    return df.withColumn(out, F.array_compact(F.transform(F.col(h), chosen))).drop(h, m)


def anchored(anchors: str, text: str) -> Column:
    """The anchors, or the hash of the whole text where there are none."""
    whole = F.xxhash64(F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)).bitwiseAND(F.lit(LOW))
    return F.when((F.size(anchors) == 0) & (F.length(text) > 0), F.array(whole)).otherwise(F.col(anchors))


def digits(anchors: str) -> Column:
    return F.lower(F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def steps(anchors: str) -> Column:
    """The distinct (hash, next hash, distance) of an anchor array; the last anchor has its hash only."""
    place = lambda x: F.shiftright(x, 32)
    after = lambda i: F.get(F.col(anchors), i + 1)
    return F.array_distinct(F.transform(anchors, lambda x, i: F.xxhash64(x.bitwiseAND(F.lit(LOW)), after(i).bitwiseAND(F.lit(LOW)), place(after(i)) - place(x))))


def likeness(shared: Column, a: Column, b: Column) -> Column:
    """The Jaccard index of two arrays of distinct values that share so many."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def with_next(base: DataFrame, k: int = 25, s: int = 8) -> DataFrame:
    """base (doc_id, text) with next_text, the smallest text of the next doc_id in ascending order (the last followed by the first), and the
    anchors a and b of the two.

    Rows are dealt by ranges of ids; only each range's first id and text meet the driver."""
    spark, kind = base.sparkSession, base.schema["doc_id"].dataType.simpleString()
    count = 4 * partitions(spark)
    ids = base.select("doc_id").where("doc_id is not null").repartitionByRange(count, "doc_id")
    lows = sorted(r.low for r in ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("low")).collect())
    if not lows:
        return with_anchors(with_anchors(base.withColumn("next_text", F.lit("")), "text", "a", k, s), "next_text", "b", k, s)
    firsts = spark.createDataFrame([(x,) for x in lows], f"low {kind}").coalesce(1)
    texts = {r.low: r.text for r in base.join(F.broadcast(firsts), F.col("doc_id") == F.col("low")).groupBy("low").agg(F.min("text").alias("text")).collect()}
    after = [(i + 1, texts[lows[(i + 1) % len(lows)]]) for i in range(len(lows))] + [(-i, texts[lows[0]]) for i in range(count)]
    bounds = F.array(*[F.lit(x).cast(kind) for x in lows])
    part = F.when(F.col("doc_id").isNull(), -F.pmod(F.xxhash64("text"), F.lit(count))).otherwise(F.size(F.filter(bounds, lambda x: x <= F.col("doc_id"))))
    dealt = base.withColumn("part", part.cast("int")).repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id", "text")
    order = "partition by part order by doc_id, text"
    rows = with_anchors(dealt.withColumn("repeated", F.expr(f"lag(doc_id) over ({order}) <=> doc_id")), "text", "a", k, s)
    rows = rows.withColumn("lead", F.when(~F.col("repeated"), F.struct("text", "a"))).withColumn("following", F.expr(f"lead(lead) ignore nulls over ({order})"))
    ends = with_anchors(spark.createDataFrame(after, "part int, next_text string").coalesce(1), "next_text", "b", k, s)
    ends = ends.select("part", F.struct(F.col("next_text").alias("text"), F.col("b").alias("a")).alias("after"))
    rows = rows.join(F.broadcast(ends), "part").withColumn("following", F.coalesce("following", "after"))
    return rows.select("doc_id", "text", "a", F.col("following.text").alias("next_text"), F.col("following.a").alias("b"))


def fingerprint_pairs(docs: DataFrame, k: int = 25, s: int = 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), k, s)
    n = F.length("text")
    rows = rows.withColumn("cut", (n - F.floor(n / 4)).cast("int"))
    rows = rows.withColumn("kept", F.substring("text", F.lit(1), F.col("cut"))).withColumn("head", F.substring("next_text", F.lit(1), n - F.col("cut")))
    rows = rows.withColumn("edited", F.concat("kept", "head")).withColumn("taken", F.length("head")).withColumn("from", F.greatest(F.col("cut") - (k - 1), F.lit(0)))
    rows = rows.withColumn("seam", F.concat(F.substring("kept", F.col("from") + 1, F.lit(k - 1)), F.substring("head", 1, k - 1)))
    rows = with_anchors(rows, "seam", "c", k, s)
    within = lambda anchors, end: F.filter(anchors, lambda x: (end >= k) & (F.shiftright(x, 32) <= end - k))
    moved = lambda anchors, by: F.transform(anchors, lambda x: x + F.shiftleft(F.col(by).cast("long"), 32))
    rows = rows.withColumn("d", F.concat(within("a", F.col("cut")), moved("c", "from"), moved(within("b", F.col("taken")), "cut")))
    for text, out in (("text", "a"), ("next_text", "b"), ("edited", "d")):
        rows = rows.withColumn(out, anchored(out, text)).withColumn(f"{out}_steps", steps(out))
    shared = lambda side: F.size(F.array_intersect("a_steps", f"{side}_steps")).cast("double")
    rows = rows.withColumn("kept_steps", shared("d")).withColumn("next_steps", shared("b"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digits("a").alias("fingerprint"),
        digits("d").alias("edited_fingerprint"),
        likeness(F.col("kept_steps"), F.col("a_steps"), F.col("d_steps")).alias("near_edited"),
        likeness(F.col("next_steps"), F.col("a_steps"), F.col("b_steps")).alias("near_next"),
    )
