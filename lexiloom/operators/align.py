"""Alignment of two record tables by line, and of their targets by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .validate import ValidationError


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on line; columns of the sides are prefixed l_ and r_. A missing side is a null l_present or r_present."""
    side = lambda df, p: df.select("line", F.lit(True).alias(f"{p}present"), *[F.col(c).alias(p + c) for c in df.columns if c != "line"])
    return side(left, "l_").join(side(right, "r_"), "line", "full_outer")


def alignment_codes(aligned: DataFrame) -> DataFrame:
    """(line, code) of what keeps a line from being a pair: count, source or languages."""
    code = F.when(F.col("l_present").isNull() | F.col("r_present").isNull(), "count").when(~F.col("l_seg").eqNullSafe(F.col("r_seg")), "source").when(~F.col("l_languages").eqNullSafe(F.col("r_languages")), "languages")
    return aligned.select("line", code.alias("code")).where("code is not null")


def attach_references(rows: DataFrame, references: DataFrame) -> DataFrame:
    """references (line, text) take the place of tgt, by line, before anything is filtered. Every line has its reference, or this fails."""
    both = rows.drop("tgt").join(references.select("line", F.col("text").alias("tgt"), F.lit(True).alias("_given")), "line", "full_outer")
    lines = both.agg(F.count_if(F.col("_given").isNull()), F.count_if(F.col("_given").isNotNull()), F.count("*")).first()
    if lines[0] or lines[1] != rows.count():
        raise ValidationError("reference count must match the original input count before filtering")
    return both.drop("_given")


def align_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pos, src, a, b, diff) of two systems' sentence scores (pos, src, has_ref, ref, score). Fails where their counts, sources or references differ."""
    side = lambda df, p: df.select("pos", F.struct("src", "has_ref", "ref").alias(p + "key"), F.col("score").alias(p))
    both = side(a, "a").join(side(b, "b"), "pos", "full_outer")
    differ = lambda f: ~F.col(f"akey.{f}").eqNullSafe(F.col(f"bkey.{f}"))
    field = F.when(F.col("a").isNull() | F.col("b").isNull(), "count").when(differ("src"), "src").when(differ("has_ref") | differ("ref"), "ref")
    worst = both.agg(F.count("a").alias("a"), F.count("b").alias("b"), F.min(F.when(field.isNotNull(), F.struct("pos", field.alias("field")))).alias("bad")).first()
    if worst.a != worst.b:
        raise ValidationError(f"different sentence counts: A={worst.a}, B={worst.b}")
    if worst.bad is not None:
        raise ValidationError(f"sentence {worst.bad.pos + 1}: '{worst.bad.field}' differs between systems")
    return both.select("pos", F.col("akey.src").alias("src"), "a", "b", (F.col("b") - F.col("a")).alias("diff"))


def with_hypotheses(rows: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """rows (line, src, tgt) and hypotheses (line, hyp) to (line, src, mt, ref) for a metric; one hypothesis a row, or this fails."""
    both = rows.select("line", "src", "tgt").join(hypotheses.select("line", "hyp"), "line", "full_outer")
    n = both.agg(F.count_if(F.col("hyp").isNull() | F.col("src").isNull())).first()[0]
    if n:
        raise ValidationError(f"{n} lines lack a source or a hypothesis")
    return both.select("line", "src", F.col("hyp").alias("mt"), F.col("tgt").alias("ref"))


def remaining(rows: DataFrame, done: DataFrame) -> DataFrame:
    return rows.join(done.select("line"), "line", "left_anti")


def first_gap(journal: DataFrame) -> int | None:
    """The first line of a journal that is not its number in order; no global sort: the largest line must equal the count, and lines be distinct."""
    total = journal.agg(F.count("*"), F.count_distinct("line"), F.min("line"), F.max("line")).first()
    if total[0] == 0 or (total[0] == total[1] == total[3] and total[2] == 1):
        return None
    after = journal.select((F.col("line") + 1).alias("line")).unionByName(journal.sparkSession.range(1).select(F.lit(1).cast("long").alias("line")))
    return after.join(journal.select("line"), "line", "left_anti").agg(F.min("line")).first()[0]


def score_distinct(rows: DataFrame, text: str, scorer) -> DataFrame:
    """scorer (DataFrame of `text` -> DataFrame of `text` and results) runs once for each distinct text."""
    return rows.join(scorer(rows.select(text).where(F.col(text).isNotNull()).distinct()), text, "left")
