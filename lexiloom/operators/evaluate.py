"""Decoding and scoring of an evaluation set behind plug-ins, with the outputs of a run.

ScoreFn: pandas frame (line, src, mt[, ref]) -> frame (line, score). The one here is a stand-in without a model.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.metrics import corpus_scores
from ..functions.text import one_line
from ..sources import files
from ..streaming.generate import ModelFn, echo_model, responses
from .align import with_hypotheses
from .validate import ValidationError

ScoreFn = Callable[[pd.DataFrame], pd.DataFrame]


def decode(rows: DataFrame, model: ModelFn = echo_model) -> DataFrame:
    """rows (line, src) to (line, hyp, hit_token_limit): one answer a row, on one line."""
    jobs = rows.select("line", F.lit("").alias("language"), F.col("src").alias("prompt"))
    return responses(jobs, model).select("line", one_line(F.coalesce("text", F.lit(""))).alias("hyp"), (F.col("finish_reason") == "length").alias("hit_token_limit"))


def length_metric(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a learned metric: how near the lengths of mt and ref (without ref: src) are, 0 to 1."""
    other = (pdf["ref"] if "ref" in pdf else pdf["src"]).fillna("").str.len()
    own = pdf["mt"].fillna("").str.len()
    return pd.DataFrame({"line": pdf["line"], "score": 1 - (own - other).abs() / pd.concat([own, other, pd.Series(1, own.index)], axis=1).max(axis=1)})


def learned_scores(triples: DataFrame, metric: ScoreFn = length_metric, with_reference: bool = True) -> DataFrame:
    """triples (line, src, mt, ref) to (line, score). Without references the metric does not see ref. One score a row, or the run fails."""
    asked = triples.select("line", "src", "mt", *(["ref"] if with_reference else []))

    def run(batches):
        for pdf in batches:
            out = metric(pdf)
            if sorted(out["line"]) != sorted(pdf["line"]):
                raise ValidationError("metric returned an unexpected number of scores")
            yield out[["line", "score"]]

    return asked.mapInPandas(run, "line long, score double")


def system_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("system_score"))


def ready(spark: SparkSession, sources: str, hypotheses: list[str], suffix: str) -> list[str]:
    """The hypothesis files that can be scored now: they and the sources are there, and their output is not."""
    return [h for h in hypotheses if files.exists(spark, sources) and files.exists(spark, h) and not files.exists(spark, h + suffix)]


def parity(counts: dict[str, int]) -> None:
    """Line counts of sources, references and hypotheses must be equal and not zero."""
    if not counts or 0 in counts.values() or len(set(counts.values())) > 1:
        raise ValidationError(f"line counts differ or are zero: {counts}")


def metrics(rows: DataFrame, decoded: DataFrame, references: bool = True) -> DataFrame:
    """One row: sentences, token_limit_hits and, with references, bleu and chrf."""
    base = decoded.agg(F.count("*").alias("sentences"), F.count_if("hit_token_limit").alias("token_limit_hits"))
    if not references:
        return base
    return base.crossJoin(corpus_scores(with_hypotheses(rows, decoded).select(F.col("mt").alias("hyp"), "ref")))  # one row each


def evaluate(spark: SparkSession, rows: DataFrame, excluded: DataFrame, folder: str, references: bool, model: ModelFn = echo_model, metric: ScoreFn | None = None) -> dict:
    """Decode, score and write a run into a new or empty folder: excluded, hyps (text and JSON lines), sources, references and scores as folders of
    parts in line order, metrics.json. Returns the metrics."""
    from ..operators.prepare import write_excluded

    if not files.is_empty_folder(spark, folder):
        raise ValueError("output directory must be new or empty")
    write_excluded(spark, f"{folder}/excluded", excluded)
    answers = f"{folder}/hyps"
    decode(rows, model).orderBy("line").select(F.to_json(F.struct("line", "hyp", "hit_token_limit")).alias("value")).write.text(answers)
    decoded = spark.read.schema("line long, hyp string, hit_token_limit boolean").json(answers)  # the model runs once
    decoded.orderBy("line").select("hyp").write.text(f"{folder}/hyps_text")
    lines = lambda c: rows.orderBy("line").select(F.to_json(F.struct("line", F.col(c).alias("text"))).alias("value"))
    lines("src").write.text(f"{folder}/sources")
    found = metrics(rows, decoded, references).first().asDict()
    if references:
        lines("tgt").write.text(f"{folder}/references")
        if metric is not None:
            learned_scores(with_hypotheses(rows, decoded), metric).orderBy("line").select(F.to_json(F.struct("line", "score")).alias("value")).write.text(f"{folder}/scores")
            found |= system_score(spark.read.schema("line long, score double").json(f"{folder}/scores")).first().asDict()
    files.write_json(spark, f"{folder}/metrics.json", found)
    return found
