"""System comparison: paired bootstrap, wins, agreement, post-edit statistics, best checkpoints."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window, functions as F

from ..functions.text import alignment, edit_fraction, folded_tokens, percentage, tokens
from .align import align, align_scores, alignment_codes
from .validate import raise_first


def paired_bootstrap(diffs: DataFrame, resamples: int = 20_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """diffs (pos, diff). One row: mean, low, high. Exact form: one generator over the differences in order, in one task; meant for one evaluation set."""
    if resamples <= 0 or not 0 < confidence < 1:
        raise ValueError("resamples must be positive and confidence between 0 and 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("pos")["diff"].to_numpy()
        g, n = np.random.default_rng(seed), len(d)
        means = np.concatenate([d[g.integers(0, n, (1, n))].mean(axis=1) for _ in range(resamples)])
        low, high = np.percentile(means, [50 * (1 - confidence), 50 * (1 + confidence)])
        return pd.DataFrame({"mean": [d.mean()], "low": [low], "high": [high]})

    return diffs.groupBy().applyInPandas(run, "mean double, low double, high double")


def _uniform(seed: int, rows: np.ndarray, resamples: int) -> np.ndarray:
    """A number in [0, 1) for each row and resample, from a hash of seed, row and resample."""
    with np.errstate(over="ignore"):
        x = (rows.astype(np.uint64)[:, None] + np.uint64(seed % (1 << 32)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(resamples, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


#: The distribution function of a Poisson variable of mean 1, until it is 1 in double precision.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])


def poisson_bootstrap(diffs: DataFrame, resamples: int = 20_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """The scalable form: each row has a Poisson(1) weight in each resample, drawn from its position. Other draws, same estimator; partial sums are combined, rows never move. A resample without any row is left out."""

    def run(batches):
        total = np.zeros((2, resamples))
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                some = pdf.iloc[start : start + 64]
                weight = np.searchsorted(POISSON, _uniform(seed, some["pos"].to_numpy(), resamples), side="right")
                total += np.stack([some["diff"].to_numpy(), np.ones(len(some))]) @ weight
        yield pd.DataFrame({"b": np.arange(resamples), "s": total[0], "w": total[1]})

    sums = diffs.mapInPandas(run, "b int, s double, w double").groupBy("b").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    tail = (1 - confidence) / 2
    return sums.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


def compare_systems(a: DataFrame, b: DataFrame, resamples: int = 20_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Two systems' sentence scores (see records.read_scores), aligned or refused. One row: sentences, system_a, system_b, difference, low, high,
    significant (zero is outside the interval), b_better, a_better, ties."""
    both = align_scores(a, b)
    interval = paired_bootstrap(both.select("pos", "diff"), resamples, seed, confidence)
    sums = both.agg(F.count("*").alias("sentences"), F.avg("a").alias("system_a"), F.avg("b").alias("system_b"), F.avg("diff").alias("difference"), *[F.count_if(c).alias(n) for n, c in (("b_better", F.col("diff") > 0), ("a_better", F.col("diff") < 0), ("ties", F.col("diff") == 0))])
    return sums.crossJoin(interval.select("low", "high")).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))  # one row each


def comparison_report(row: Row, confidence: float = 0.95) -> str:
    """The row of compare_systems as lines of text."""
    return "\n".join(
        [
            f"Sentences: {row.sentences:,}",
            f"System A: {row.system_a:.6f}   System B: {row.system_b:.6f}   B - A: {row.difference:+.6f}",
            f"{100 * confidence:g}% interval: {row.low:+.6f} to {row.high:+.6f} ({'significant' if row.significant else 'not significant'})",
            f"B better: {row.b_better:,}   A better: {row.a_better:,}   Ties: {row.ties:,}",
        ]
    )


def win_loss(diffs: DataFrame) -> DataFrame:
    return diffs.agg(F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") == 0).alias("ties"), F.avg("diff").alias("mean_diff"))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs (line, language, left, right token lists): sentences, pairs, token counts, equal tokens, lines with all targets equal."""
    each = pairs.select("line", F.size("left").alias("l"), F.size("right").alias("r"), alignment(F.col("left"), F.col("right"))["equal"].alias("e"), (F.col("left") == F.col("right")).alias("same"))
    lines = each.groupBy("line").agg(F.count("*").alias("pairs"), F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum("e").alias("e"), F.every("same").alias("same"))
    sums = lines.agg(F.count("*").alias("sentences"), F.sum("pairs").alias("pairs"), F.sum("l").alias("left_tokens"), F.sum("r").alias("right_tokens"), F.sum("e").alias("equal_tokens"), F.count_if("same").alias("equal_lines"))
    return sums.withColumn("left_percent", percentage(F.col("equal_tokens"), F.col("left_tokens"))).withColumn("right_percent", percentage(F.col("equal_tokens"), F.col("right_tokens"))).withColumn("line_percent", percentage(F.col("equal_lines"), F.col("sentences")))


def compare_translations(left: DataFrame, right: DataFrame, ignore_case_punct: bool = False) -> DataFrame:
    """Agreement of two sets of translations (line, language, seg, target_language, text), aligned by line and target language or refused."""
    sides = [x.groupBy("line").agg(F.first(F.struct("language", "seg")).alias("seg"), F.array_sort(F.collect_set("target_language")).alias("languages")) for x in (left, right)]
    raise_first(alignment_codes(align(*sides)).select("line", F.lit(0).alias("rank"), F.col("code").alias("message")))
    cut = folded_tokens if ignore_case_punct else tokens
    named = [x.select("line", F.col("target_language").alias("language"), cut(F.col("text")).alias(n)) for x, n in ((left, "left"), (right, "right"))]
    return agreement(named[0].join(named[1], ["line", "language"]))


def agreement_report(row: Row) -> str:
    """The row of agreement as lines of text."""
    side = lambda n, total: f"{n:,} of {total:,} tokens equal ({100 * n / total if total else 0:.2f}%)"
    return "\n".join(
        [
            f"Source sentences: {row.sentences:,}; translation pairs: {row.pairs:,}",
            f"Equal lines: {row.equal_lines:,} ({row.line_percent:.2f}%); different lines: {row.sentences - row.equal_lines:,} ({100 - row.line_percent if row.sentences else 0:.2f}%)",
            f"Left: {side(row.equal_tokens, row.left_tokens)}",
            f"Right: {side(row.equal_tokens, row.right_tokens)}",
        ]
    )


def post_edit_stats(targets: DataFrame, threshold: float = 0.30) -> DataFrame:
    """targets (line, base, corrected, finish_reason): counts and mean edit fraction; missing corrections are in no denominator."""
    t = targets.withColumn("fraction", edit_fraction(F.col("base"), F.col("corrected")))
    got = F.col("corrected").isNotNull()
    changed, extracted = F.count_if(got & (F.col("base") != F.col("corrected"))), F.count_if(got)
    return t.agg(F.count_distinct("line").alias("source_lines"), F.count("*").alias("pairs"), changed.alias("changed"), (extracted - changed).alias("unchanged"), percentage(changed, extracted).alias("changed_percent"), F.count_if(~got).alias("missing"), F.count_if(F.col("finish_reason") != "stop").alias("non_stop"), F.count_if(got & (F.col("fraction") > threshold)).alias("large_edits"), F.coalesce(F.avg(F.when(got, F.col("fraction"))), F.lit(0.0)).alias("mean_edit_fraction"))


def best_checkpoints(scores: DataFrame) -> DataFrame:
    """scores (run, step, score): adds whether a step beats all steps before it."""
    before = F.max("score").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return scores.withColumn("best_before", before).withColumn("improves", F.coalesce(F.col("score") > before, F.lit(True)))


def queue_ranks(jobs: DataFrame) -> DataFrame:
    """jobs (partition, job_id, priority): place in its partition, highest priority first."""
    return jobs.withColumn("position", F.row_number().over(Window.partitionBy("partition").orderBy(F.desc("priority"), "job_id")))


def queue_position(jobs: DataFrame, job_id: str, partition: str) -> int:
    """A job's place in its partition; fails if it is not listed."""
    found = queue_ranks(jobs.where(F.col("partition") == partition)).where(F.col("job_id") == job_id).select("position").first()
    if found is None:
        raise ValueError(f"job {job_id} is not pending in partition {partition}")
    return found.position


def scores_to_evaluate(steps: DataFrame, scored: DataFrame) -> DataFrame:
    """Steps (run, step) that have no score yet."""
    return steps.join(scored.select("run", "step"), ["run", "step"], "left_anti")


def best_step(scores: DataFrame) -> DataFrame:
    """(run, step, score) of the first step with the highest score of its run."""
    return scores.groupBy("run").agg(F.min_by("step", F.struct(-F.col("score"), F.col("step"))).alias("step"), F.max("score").alias("score"))
