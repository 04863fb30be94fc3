"""Corpus metrics from their published definitions: BLEU (clipped n-grams, brevity penalty, exponential smoothing) and chrF (beta 2).

Clipping is within a line, so each line gives its own counts in one Arrow function and only their sums are shuffled."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .text import WS

BLEU_ORDER, CHRF_ORDER, CHRF_BETA = 4, 6, 2.0
#: The rewriting rules of the 13a tokenization, in order.
RULES_13A = (
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def tokens_13a(text: Column) -> Column:
    """Words as the 13a tokenization cuts them; null text has none."""
    text = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    for pattern, by in RULES_13A:
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_extract_all(text, F.lit(f"[^{WS}]+"), F.lit(0))


def characters(text: Column) -> Column:
    """Characters that are not white space; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?s)[^{WS}]"), F.lit(0))


def line_matches(left: Column, right: Column, orders: range) -> Column:
    """array<struct<n, matched, left_total, right_total>> of a line's two token lists."""

    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y, row = list(x), list(y), []
            for n in orders:
                own, other = (Counter(zip(*(z[i:] for i in range(n)))) for z in (x, y))
                row.append({"n": n, "matched": (own & other).total(), "left_total": own.total(), "right_total": other.total()})
            out.append(row)
        return pd.Series(out)

    return F.pandas_udf(count, "array<struct<n: int, matched: long, left_total: long, right_total: long>>")(left, right)


def ngram_matches(pairs: DataFrame, left: str, right: str, orders: range) -> DataFrame:
    """pairs: (line, two token lists). (n, matched, left_total, right_total), matches clipped in each line."""
    each = pairs.select(F.explode(line_matches(F.col(left), F.col(right), orders)).alias("x")).select("x.*")
    return each.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("matched", "left_total", "right_total")])


def bleu_score(matches: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row (bleu) from (n, matched, left_total, right_total) of orders 1 to 4, left being the hypothesis, and lengths (hyp_len, ref_len)."""
    rows = F.array_sort(F.collect_list(F.struct("n", "matched", "left_total")))
    one = matches.agg(rows.alias("rows")).crossJoin(lengths)  # one row each
    start = F.struct(F.lit(0.0).alias("logs"), F.lit(1.0).alias("smooth"))

    def step(acc: Column, x: Column) -> Column:
        smooth = F.when(x["matched"] == 0, acc["smooth"] * 2).otherwise(acc["smooth"])
        share = F.when(x["matched"] == 0, 1 / smooth).otherwise(x["matched"]) / x["left_total"]
        return F.struct((acc["logs"] + F.log(share)).alias("logs"), smooth.alias("smooth"))

    logs = F.aggregate("rows", start, step)["logs"]
    penalty = F.when(F.col("hyp_len") >= F.col("ref_len"), F.lit(1.0)).otherwise(F.exp(1 - F.try_divide("ref_len", "hyp_len")))
    zero = (F.size("rows") == 0) | F.exists("rows", lambda x: x["left_total"] == 0) | F.forall("rows", lambda x: x["matched"] == 0)
    return one.select(F.when(zero, F.lit(0.0)).otherwise(100 * penalty * F.exp(logs / F.size("rows"))).alias("bleu"))


def chrf_score(matches: DataFrame, beta: float = CHRF_BETA) -> DataFrame:
    """One row (chrf): precision and recall are averaged over the orders that have n-grams on both sides, then joined."""
    used = (F.col("left_total") > 0) & (F.col("right_total") > 0)
    p, r = (F.coalesce(F.avg(F.when(used, F.try_divide("matched", c))), F.lit(0.0)).alias(a) for c, a in (("left_total", "p"), ("right_total", "r")))
    joined = 100 * (1 + beta**2) * F.col("p") * F.col("r") / (beta**2 * F.col("p") + F.col("r"))
    return matches.agg(p, r).select(F.when(F.col("p") + F.col("r") > 0, joined).otherwise(F.lit(0.0)).alias("chrf"))


def corpus_scores(pairs: DataFrame) -> DataFrame:
    """pairs: (hyp, ref) texts. One row: bleu (13a words) and chrf (characters without white space)."""
    words = pairs.select(tokens_13a(F.col("hyp")).alias("h"), tokens_13a(F.col("ref")).alias("r"))
    matches = ngram_matches(words, "h", "r", range(1, BLEU_ORDER + 1))
    lengths = matches.where("n = 1").agg(F.sum("left_total").alias("hyp_len"), F.sum("right_total").alias("ref_len"))
    letters = pairs.select(characters(F.col("hyp")).alias("h"), characters(F.col("ref")).alias("r"))
    return bleu_score(matches, lengths).crossJoin(chrf_score(ngram_matches(letters, "h", "r", range(1, CHRF_ORDER + 1))))
