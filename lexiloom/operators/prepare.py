"""Training and evaluation tables from files: selected fields, reasons of what is left out, and the sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Evaluation, Selection, Training
from ..functions.text import is_blank
from ..sources import files
from ..sources.loaders import load_input
from ..sources.records import parse_records, parse_tsv, read_lines, text_variant, write_jsonl, write_tsv
from . import align as A, targets as T, training as R, validate as V
from .validate import first_reason

BUDGET = "generation_context_budget"


def extract(records: DataFrame, selection: Selection, tsv: bool = False) -> DataFrame:
    """records (line, form, seg, tgts) to (line, src, tgt[, reject], reason): the selected fields in any direction. reason is missing_or_empty,
    tsv_control_characters (for TSV) or null. Fails where a record has several targets to choose from."""
    rules = V.object_rules() | (V.one_target_rules(selection.target_language) if any(s.startswith("tgts.") for s in selection.columns().values()) else {})
    V.checked(records, rules)
    rows = records.select("line", "seg", T.target_of(F.col("tgts"), selection.target_language).alias("t"))
    picked = {name: F.col("seg") if s == "seg" else text_variant(F.col("t"), s.removeprefix("tgts.")) for name, s in selection.columns().items()}
    rows = rows.select("line", *[c.alias(n) for n, c in picked.items()])
    missing, control = F.lit(False), F.lit(False)
    for name in picked:
        missing, control = missing | is_blank(F.col(name)), control | F.col(name).rlike("[\t\r\n]")
    return rows.withColumn("reason", first_reason(("missing_or_empty", missing), ("tsv_control_characters", control & F.lit(tsv))))


def counts(rows: DataFrame) -> dict[str, int]:
    """read, written, missing_or_empty, tsv_control_characters of extracted rows."""
    found = {r.reason: r.n for r in rows.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    return {"read": sum(found.values()), "written": found.get(None, 0)} | {k: found.get(k, 0) for k in ("missing_or_empty", "tsv_control_characters")}


def prepare(spark: SparkSession, source: str, output: str, selection: Selection) -> dict[str, int]:
    """Extract from JSONL records to TSV or JSONL (by selection.format, else by the suffix; gzip by .gz), and return the counts.

    The output is a folder of parts in line order; it must not exist, and appears as a whole or not at all."""
    if source == output:
        raise ValueError("input and output must differ")
    if files.exists(spark, output):
        raise ValueError("output exists; choose a new output path")
    suffix = output.removesuffix(".gz").rsplit(".", 1)[-1]
    kind = selection.format or (suffix if suffix in ("jsonl", "tsv") else None)
    if kind is None:
        raise ValueError("use a .jsonl/.tsv output suffix or name a format")
    rows = extract(parse_records(read_lines(spark, source)), selection, tsv=kind == "tsv")
    found, kept = counts(rows), rows.where("reason is null").drop("reason")
    codec = "gzip" if output.endswith(".gz") else "none"
    if kind == "tsv":
        write_tsv(kept, list(selection.columns()), output, codec)
    else:
        write_jsonl(kept, output, codec)
    return found


def training_rows(spark: SparkSession, path: str, config: Training, tokenize: Callable[[Column], Column] = R.code_points) -> tuple[DataFrame, DataFrame]:
    """The kept rows as sequences (sft) or preferences, and the excluded lines with their reasons, of a file with four columns."""
    columns = ["src", "human", "base", "corrected"]
    rows = V.checked(parse_tsv(read_lines(spark, path), columns), {"arity": (~F.col("well_formed"), "expected exactly 4 TAB-separated fields")}, path)
    source, *answers = [columns[c - 1] for c in (config.src_col, *config.answers())]
    marked = R.with_reason(rows, source, answers, config.max_length, tokenize)
    kept = marked.where("reason is null")
    made = R.sft_rows(kept, source, answers[0], tokenize) if config.method == "sft" else R.preference_rows(kept, source, *answers, tokenize)
    return (R.cpo_rows(made) if config.method == "cpo" else made), marked.where("reason is not null").select("line", "reason")


def with_budget(rows: DataFrame, config: Evaluation, tokenize: Callable[[Column], Column] = R.code_points) -> DataFrame:
    """Add input_ids (the prompt's) and reason: generation_context_budget where prompt and reserved tokens do not fit."""
    ids = rows.withColumn("input_ids", R.prompt_ids(F.col("src"), tokenize))
    return ids.withColumn("reason", F.when(F.size("input_ids") + config.max_new_tokens > config.max_length, BUDGET))


def _split(rows: DataFrame, message: str) -> tuple[DataFrame, DataFrame]:
    kept = V.not_empty(rows.where("reason is null").select("line", "src", "tgt", "input_ids"), message)
    return kept, rows.where("reason is not null").select("line", "reason")


def eval_rows(spark: SparkSession, path: str, config: Evaluation, tokenize: Callable[[Column], Column] = R.code_points) -> tuple[DataFrame, DataFrame]:
    """(line, src, tgt, input_ids) and the excluded lines of a development file of source and human; blank fields are errors here."""
    rows = parse_tsv(read_lines(spark, path), ["src", "tgt"])
    rules = {"arity": (~F.col("well_formed"), "expected exactly 2 TAB-separated fields"), "blank": (is_blank(F.col("src")) | is_blank(F.col("tgt")), "expected nonempty src/human fields")}
    return _split(with_budget(V.checked(rows, rules, path), config, tokenize), f"{path}: no evaluation rows fit the generation budget")


def input_rows(rows: DataFrame, config: Evaluation, references: DataFrame | None = None, tokenize: Callable[[Column], Column] = R.code_points, where: str = "input") -> tuple[DataFrame, DataFrame, bool]:
    """rows (line, src, tgt, has_tgt; see load_input) to the kept rows, the excluded ones, and whether there are references.

    references (line, text) replace those of the input, line by line, before anything is filtered; all lines have one, or none has."""
    if references is not None:
        rows = A.attach_references(rows, references).withColumn("has_tgt", F.lit(True))
    supplied = rows.agg(F.bool_or("has_tgt")).first()[0] or False
    rules = {"src": (is_blank(F.col("src")), "expected a nonempty src string")}
    if supplied:
        rules = {"tgt": (is_blank(F.col("tgt")), "references must be nonempty strings for every input record, or absent for all")} | rules
    kept, excluded = _split(with_budget(V.checked(rows, rules, where), config, tokenize), "no input sentences fit the generation context budget")
    return kept, excluded, supplied


def prepare_input(spark: SparkSession, path: str, config: Evaluation, references: str | None = None, tokenize: Callable[[Column], Column] = R.code_points) -> tuple[DataFrame, DataFrame, bool]:
    given = None if references is None else read_lines(spark, references).withColumnRenamed("value", "text")
    return input_rows(load_input(spark, path), config, given, tokenize, path)


def write_excluded(spark: SparkSession, path: str, excluded: dict[str, DataFrame] | DataFrame) -> None:
    """excluded rows as JSON lines (line, reason[, part]) in a folder; they may be as many as the input."""
    parts = excluded if isinstance(excluded, dict) else {"": excluded}
    rows = None
    for name, df in parts.items():
        one = df.withColumn("part", F.lit(name)) if name else df
        rows = one if rows is None else rows.unionByName(one)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
