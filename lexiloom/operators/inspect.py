"""Inspection of translation variants: likelihood under a scorer, edit distances between variants, and reports.

LikelihoodFn: pandas frame (line, source, text) -> frame (line, text, total_logprob), total_logprob being the sum over the text's tokens. The one
here is a stand-in without a model.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Inspection
from ..functions.text import describe, is_blank, safe_exp, with_distances
from ..sources import files
from ..sources.loaders import load_examples, load_template
from .training import code_points, prompt_ids
from .validate import ValidationError

VARIANTS = ("base", "human", "corrected")
PAIRS = tuple(combinations(VARIANTS, 2))
UNITS = {"character": "char", "word": "word"}
LikelihoodFn = Callable[[pd.DataFrame], pd.DataFrame]


def vowel_likelihood(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stand-in: half a nat for each character and a quarter more for each small vowel."""
    return pd.DataFrame({"line": pdf["line"], "text": pdf["text"], "total_logprob": [-(0.5 * len(t) + 0.25 * sum(t.count(v) for v in "aeiou")) for t in pdf["text"]]})


def candidates(rows: DataFrame) -> DataFrame:
    """(line, source, variant, text) of the three variants of each row."""
    made = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("text")) for v in VARIANTS])
    return rows.select("line", "source", F.explode(made).alias("x")).select("line", "source", "x.*")


def score_candidates(rows: DataFrame, config: Inspection, score: LikelihoodFn = vowel_likelihood, tokenize: Callable[[Column], Column] = code_points) -> DataFrame:
    """(line, variant, text, status, tokens, total_logprob, nll, perplexity). Equal texts of a line are scored once; only the candidate's tokens count."""
    tokens, prefix = F.size(tokenize(F.col("text"))), F.size(prompt_ids(F.col("source"), tokenize))
    status = F.when(is_blank(F.col("text")), "missing_or_empty").when(F.lit(config.dry_run), "not_scored_dry_run").when(tokens == 0, "empty_tokenization").when(prefix + tokens > config.max_length, "context_budget_exceeded").otherwise("ok")
    each = candidates(rows).withColumn("status", status).withColumn("tokens", F.when(F.col("status").isin("ok", "context_budget_exceeded"), tokens.cast("long")))

    def run(batches):
        for pdf in batches:
            out = score(pdf)
            if len(out) != len(pdf):
                raise ValidationError("scorer returned an unexpected number of likelihoods")
            yield out[["line", "text", "total_logprob"]]

    ready = each.where("status = 'ok'").select("line", "source", "text").dropDuplicates(["line", "text"])
    scored = each.drop("source").join(ready.mapInPandas(run, "line long, text string, total_logprob double"), ["line", "text"], "left")
    nll = -F.col("total_logprob") / F.col("tokens")
    return scored.withColumn("total_logprob", F.when(F.col("status") == "ok", F.col("total_logprob"))).withColumn("nll", nll).withColumn("perplexity", safe_exp(F.col("nll")))


def pair_distances(rows: DataFrame) -> DataFrame:
    """(line, pair, a, b, identical, distances) of the pairs of which both texts are not blank."""
    made = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in PAIRS])
    pairs = rows.select("line", F.explode(made).alias("p")).select("line", "p.*")
    return with_distances(pairs.where(~is_blank(F.col("a")) & ~is_blank(F.col("b"))))


def inspect(rows: DataFrame, config: Inspection, score: LikelihoodFn = vowel_likelihood, tokenize: Callable[[Column], Column] = code_points) -> DataFrame:
    """rows of load_examples to one nested row a line: translations, distances by pair, scores by variant, nll_deltas by pair.

    distances and nll_deltas hold the pairs only of which both texts, or both scores, are there."""
    one = ("status", "tokens", "total_logprob", "nll", "perplexity")
    scores = score_candidates(rows, config, score, tokenize).groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("variant", F.struct(*one)))).alias("scores"))  # three a line
    unit = lambda u: F.struct(F.col(f"{u}_distance").alias("distance"), F.col(f"{u}_length").alias("normalizer"), F.col(f"{u}_normalized").alias("normalized"))
    measured = F.struct("identical", *[unit(u).alias(n) for n, u in UNITS.items()])
    distances = pair_distances(rows).groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("pair", measured))).alias("distances"))
    both = rows.select("line", "source_language", "target_language", "source", F.struct(*VARIANTS).alias("translations")).join(scores, "line").join(distances, "line", "left")
    ok = lambda v: F.col("scores")[v]["status"] == "ok"
    deltas = F.array_compact(F.array(*[F.when(ok(a) & ok(b), F.struct(F.lit(f"{b}_minus_{a}").alias("pair"), (F.col("scores")[b]["nll"] - F.col("scores")[a]["nll"]).alias("delta"))) for a, b in PAIRS]))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array())
    return both.withColumn("distances", F.coalesce("distances", empty.cast(distances.schema["distances"].dataType))).withColumn("nll_deltas", F.map_from_entries(deltas))


def _wide() -> list[Column]:
    out = [F.col(c) for c in ("line", "source_language", "target_language", "source")]
    for v in VARIANTS:
        out += [F.col("translations")[v].alias(v), *[F.col("scores")[v][k].alias(f"{v}_{k}") for k in ("status", "tokens", "total_logprob", "nll", "perplexity")]]
    for a, b in PAIRS:
        key = f"{a}_vs_{b}"
        edit = F.try_element_at("distances", F.lit(key))
        out += [edit["identical"].alias(f"{key}_identical"), *[edit[u][m].alias(f"{key}_{u}_{m}") for u in UNITS for m in ("distance", "normalized")], F.try_element_at("nll_deltas", F.lit(f"{b}_minus_{a}")).alias(f"nll_{b}_minus_{a}")]
    return out


def flatten(rows: DataFrame) -> DataFrame:
    """The nested rows of inspect as one wide row a line; what is missing is null."""
    return rows.select(*_wide())


def summarize(rows: DataFrame) -> dict:
    """The summary of the nested rows of inspect: a few numbers a variant and pair, from one aggregation for each of the two groups of lines, one for
    the statuses and one a pair."""
    lengths = [F.try_element_at("distances", F.lit(f"{a}_vs_{b}"))[u]["normalizer"].alias(f"{a}_vs_{b}_{u}_whole") for a, b in PAIRS for u in UNITS]
    flat = rows.select(*_wide(), *lengths)
    ok = lambda v: F.col(f"{v}_status") == "ok"
    complete = ok("base") & ok("human") & ok("corrected")

    def group(rows: DataFrame) -> dict:
        aggs = [F.count("*").alias("n")]
        for v in VARIANTS:
            of = lambda c: F.when(ok(v), F.col(f"{v}_{c}"))  # noqa: B023,E731
            aggs += [describe(of("nll")).alias(f"{v}_nll"), F.coalesce(F.sum(of("tokens")), F.lit(0)).alias(f"{v}_tokens"), (-F.try_divide(F.sum(of("total_logprob")), F.sum(of("tokens")))).alias(f"{v}_micro")]
        r = rows.agg(*aggs, *[describe(F.when(complete, F.col(f"nll_{b}_minus_{a}"))).alias(f"{b}_minus_{a}") for a, b in PAIRS]).first().asDict(recursive=True)
        exp = {v: rows.sparkSession.range(1).select(safe_exp(F.lit(r[f"{v}_micro"]).cast("double"))).first()[0] for v in VARIANTS}
        likelihood = {v: {"sentence_nll": _described(r[f"{v}_nll"]), "tokens": r[f"{v}_tokens"], "token_weighted_nll": r[f"{v}_micro"], "corpus_perplexity": exp[v]} for v in VARIANTS}
        return {"n": r["n"], "likelihood": likelihood, "deltas": {f"{b}_minus_{a}": _described(r[f"{b}_minus_{a}"]) for a, b in PAIRS}}

    every, triplets = group(flat), group(flat.where(complete))
    statuses = flat.select(F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"{v}_status").alias("s")) for v in VARIANTS])).alias("x")).groupBy("x.v", "x.s").agg(F.count("*").alias("n")).collect()
    edits = {}
    for a, b in PAIRS:
        key = f"{a}_vs_{b}"
        aggs = [F.count(f"{key}_identical").alias("pairs"), F.count_if(F.col(f"{key}_identical")).alias("identical")]
        for u in UNITS:
            aggs += [describe(F.col(f"{key}_{u}_normalized")).alias(u), F.sum(f"{key}_{u}_distance").alias(f"{u}_distance"), F.sum(f"{key}_{u}_whole").alias(f"{u}_whole")]
        r = flat.agg(*aggs).first().asDict(recursive=True)
        edits[key] = {"pairs": r["pairs"], "identical": r["identical"], "changed_fraction": (r["pairs"] - r["identical"]) / r["pairs"] if r["pairs"] else None} | {u: {"sentence_normalized": _described(r[u]), "pooled_normalized": r[f"{u}_distance"] / r[f"{u}_whole"] if r[f"{u}_whole"] else None} for u in UNITS}
    return {
        "sentences": every["n"],
        "likelihood": {"all_available": every["likelihood"], "complete_triplets": triplets["likelihood"]},
        "edit_distance": edits,
        "complete_triplets": triplets["n"],
        "status_counts": {v: {r.s: r.n for r in sorted(statuses) if r.v == v} for v in VARIANTS},
        "paired_nll_deltas_complete_triplets": triplets["deltas"],
    }


def _described(x: dict) -> dict:
    return x if x["count"] else {"count": 0}


def run_inspection(spark: SparkSession, path: str, prompt: str, config: Inspection = Inspection(), prefix: str | None = None, score: LikelihoodFn = vowel_likelihood, tokenize: Callable[[Column], Column] = code_points) -> dict:
    """Read, score, measure and write: PREFIX.sentences.jsonl (nested), PREFIX.sentences.tsv (wide, quoted, with a header) and PREFIX.summary.json.

    The first two are folders of parts in line order. Outputs must be new. Returns the summary."""
    prefix = prefix or files.output_prefix(path) + ".distribution"
    nested, wide, summary = (prefix + s for s in (".sentences.jsonl", ".sentences.tsv", ".summary.json"))
    if any(files.exists(spark, p) or p in (path, prompt) for p in (nested, wide, summary)):
        raise ValueError("outputs must be new paths, distinct from input and prompt")
    template = load_template(spark, prompt)
    rows = inspect(load_examples(spark, path, config.target_language, config.limit), config, score, tokenize)
    schema = rows.schema
    rows.orderBy("line").select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(nested)
    stored = spark.read.schema(schema).json(nested)  # nothing is scored twice
    flatten(stored).orderBy("line").write.csv(wide, sep="\t", header=True)
    found = summarize(stored)
    found["configuration"] = {"input": path, "input_sha256": files.stream_digest(spark, path), "prompt": template, "max_length": config.max_length, "limit": config.limit, "dry_run": config.dry_run}
    files.write_json(spark, summary, found)
    return found
