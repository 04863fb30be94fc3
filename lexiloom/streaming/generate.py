"""Model calls behind a batch function, with a journal to resume from.

ModelFn: pandas frame (line, language, prompt) -> frame (line, language, text, finish_reason). The one here is a stand-in without a model.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import edit_fraction, is_blank, rstrip
from ..operators import align as A, targets as T
from ..operators.compare import post_edit_stats
from ..operators.validate import ValidationError
from ..sources import files
from ..sources.records import read_lines, write_jsonl

ModelFn = Callable[[pd.DataFrame], pd.DataFrame]
OUT = "line long, language string, text string, finish_reason string"


def echo_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in: the prompt in upper case; every seventh line is cut."""
    return pd.DataFrame({"line": pdf["line"], "language": pdf["language"], "text": pdf["prompt"].str.upper(), "finish_reason": ["length" if x % 7 == 0 else "stop" for x in pdf["line"]]})


def echo_teacher(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for post-editing: the student's translation of the prompt's payload, with a stop for its last full stop, as the teacher's JSON."""
    texts = [json.loads(json.loads(p)[-1]["content"])["student_translation"] for p in pdf["prompt"]]
    return pd.DataFrame({"line": pdf["line"], "language": pdf["language"], "text": [json.dumps({"corrected_translation": t.rstrip(".") + ".", "edits": []}, ensure_ascii=False) for t in texts], "finish_reason": "stop"})


def responses(jobs: DataFrame, model: ModelFn) -> DataFrame:
    """jobs (line, language, prompt), each once. (line, language, text, finish_reason): exactly one answer a job, or the run fails."""

    def run(batches):
        for pdf in batches:
            out = model(pdf)
            asked, given = (sorted(zip(x["line"], x["language"])) for x in (pdf, out))
            if asked != given:
                raise ValidationError(f"model returned {len(given)} answers to {len(asked)} prompts, or to other ones")
            yield out[["line", "language", "text", "finish_reason"]]

    return jobs.select("line", "language", "prompt").mapInPandas(run, OUT)


def generate(jobs: DataFrame, model: ModelFn = echo_model, budget: int | None = None, reserved: int = 0) -> DataFrame:
    """jobs (line, language, prompt). Adds text, finish_reason, skip_reason; null prompts and those over budget never reach the model."""
    reason = F.when(F.col("prompt").isNull(), "skipped")
    if budget is not None:
        reason = reason.when(F.length("prompt") + reserved > budget, "context_budget_exceeded")
    marked = jobs.withColumn("skip_reason", reason)
    joined = marked.join(responses(marked.where("skip_reason is null"), model), ["line", "language"], "left")
    after = F.when(F.col("finish_reason") != "stop", F.concat(F.lit("generation_"), "finish_reason")).when(F.col("skip_reason").isNull() & is_blank(F.col("text")), "empty_translation")
    why = F.coalesce("skip_reason", after)
    return joined.select("line", "language", "prompt", F.when(why.isNull(), F.col("text")).alias("text"), F.col("text").alias("raw_response"), F.coalesce("finish_reason", F.lit("skipped")).alias("finish_reason"), why.alias("skip_reason"))


def run_stream(stream: DataFrame, journal: str, checkpoint: str, model: ModelFn = echo_model):
    """Process what is new in a stream of (line, language, prompt), append to the Parquet journal, and stop. A batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        generate(batch, model).write.mode("overwrite").parquet(f"{journal}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def check_manifest(old: dict | None, new: dict, may_change: frozenset[str] = frozenset()) -> None:
    """Refuse to resume under another configuration, but for the named keys."""
    if old is not None and (bad := sorted(k for k in old.keys() | new.keys() if k not in may_change and old.get(k) != new.get(k))):
        raise ValueError(f"configuration changed: {json.dumps(bad)}")


def extract_response(rows: DataFrame) -> DataFrame:
    """raw_response to corrected and extraction_error: JSON object with a string field corrected_translation; an empty string is a value."""
    parsed = F.try_parse_json("raw_response")
    value = F.try_variant_get(parsed, "$.corrected_translation", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))
    error = F.when(F.col("raw_response").isNull(), F.lit(None)).when(parsed.isNull(), F.lit("invalid_json")).when(text.isNull(), F.lit("missing_string_field"))
    return rows.withColumn("corrected", text).withColumn("extraction_error", error)


def chat_payload(source_language, target_language, source, student, human, system: str):
    """The teacher's messages as JSON: a system prompt, and a payload that has human_reference only where there is one."""
    fields = [F.lit("source_language"), source_language, F.lit("target_language"), target_language, F.lit("source"), source, F.lit("student_translation"), student]
    payload = F.when(human.isNull(), F.to_json(F.create_map(*fields))).otherwise(F.to_json(F.create_map(*fields, F.lit("human_reference"), human)))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.array(message("system", F.lit(system)), message("user", payload)))


def translation_payload(source, source_language: str, target_language: str):
    """A translation request as JSON: the source and the two codes, and nothing else."""
    content = F.struct(F.lit("text").alias("type"), F.lit(source_language).alias("source_lang_code"), F.lit(target_language).alias("target_lang_code"), source.alias("text"))
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.array(content).alias("content"))))


def instruction_payload(source, template: str, source_language: str, target_language: str):
    """A system instruction with the two languages filled in, and the source, as JSON."""
    text = template.replace("{source_language}", source_language).replace("{target_language}", target_language)
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(text).alias("content")), F.struct(F.lit("user").alias("role"), source.alias("content"))))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(line, entry) of a JSONL journal of one file. A last line without its end is the rest of an interrupted write and left out; the others must
    be objects numbered 1, 2, 3 and so on."""
    lines = read_lines(spark, path)
    if not _ends(spark, path):
        lines = lines.where(F.col("line") < (lines.agg(F.max("line")).first()[0] or 0))
    rows = lines.select("line", F.try_parse_json("value").alias("entry"))
    bad = rows.where(~F.coalesce(F.try_variant_get("entry", "$.line", "long") == F.col("line"), F.lit(False))).agg(F.min("line")).first()[0]
    if bad is not None:
        raise ValidationError(f"nonsequential audit checkpoint at line {bad}")
    return rows


def _ends(spark: SparkSession, path: str) -> bool:
    fs, target = files._at(spark, path)
    size = fs.getFileStatus(target).getLen()
    if not size:
        return True
    stream = fs.open(target)
    try:
        stream.seek(size - 1)
        return stream.read() == 10
    finally:
        stream.close()


class Run:
    """A resumable run with output PATH: PATH.manifest.json, PATH.audit (Parquet, one folder a batch of lines, committed as a whole), PATH.lock.

    Without resume nothing of it may exist; with it the manifest must, and be equal but for keys that may change, whose change is recorded."""

    def __init__(self, spark: SparkSession, output: str, config: dict, resume: bool = False, may_change: frozenset[str] = frozenset()):
        self.spark, self.output, self.config, self.resume, self.may_change = spark, output, config, resume, may_change
        self.manifest, self.audit, self.stats = (output + s for s in (".manifest.json", ".audit", ".stats.json"))

    def start(self) -> None:
        spark = self.spark
        if not self.resume:
            if any(files.exists(spark, p) for p in (self.output, self.manifest, self.audit, self.stats)):
                raise ValueError("output/checkpoint exists; resume, or choose a new output")
            files.atomic_json(spark, self.manifest, self.config)
            return
        if not files.exists(spark, self.manifest):
            raise ValueError("resuming requires an existing manifest")
        old = json.loads(files.read_text(spark, self.manifest))
        check_manifest(old, self.config, self.may_change)
        if old != self.config:
            files.write_json(spark, f"{self.output}.resume-{len(files.children(spark, self.audit)):06d}.json", {"completed_batches": files.children(spark, self.audit), "previous": old, "next": self.config})
            files.atomic_json(spark, self.manifest, self.config)

    def completed(self) -> DataFrame | None:
        return self.spark.read.parquet(self.audit) if any(n.startswith("batch=") for n in files.children(self.spark, self.audit)) else None

    def check_completed(self, done: DataFrame, jobs: DataFrame) -> None:
        """What is done must be the first lines of the input, with the same prompts."""
        pairs = done.select("line", "language", F.col("prompt").alias("was"), F.lit(True).alias("_done")).join(jobs.select("line", "language", "prompt", F.lit(True).alias("_job")), ["line", "language"], "full_outer")
        last = done.agg(F.max("line")).first()[0]
        bad = pairs.where(F.col("_done").isNotNull() & (F.col("_job").isNull() | ~F.col("was").eqNullSafe(F.col("prompt"))) | F.col("_done").isNull() & (F.col("line") <= last))
        if not bad.isEmpty():
            raise ValidationError("checkpoint differs from input")
        if (gap := A.first_gap(done.select("line").distinct())) is not None:
            raise ValidationError(f"nonsequential audit checkpoint at line {gap}")

    def answers(self, jobs: DataFrame, model: ModelFn, budget: int | None, reserved: int, lines: int = 100_000) -> DataFrame:
        """jobs (line, language, prompt) answered and journalled, `lines` lines at a time; lines that are done are not asked again."""
        with files.Lock(self.spark, self.output + ".lock"):
            self.start()
            done, first = self.completed(), 1
            if done is not None:
                self.check_completed(done, jobs)
                first = done.agg(F.max("line")).first()[0] + 1
            last = jobs.agg(F.max("line")).first()[0] or 0
            for start in range(first, last + 1, lines):
                part = jobs.where(F.col("line").between(start, start + lines - 1))
                generate(part, model, budget, reserved).write.mode("overwrite").parquet(f"{self.audit}/batch={start:012d}")
        return self.completed()


def translate(spark: SparkSession, records: DataFrame, output: str, config, model: ModelFn = echo_model, resume: bool = False, prompt=None, lines: int = 100_000, references: str | None = None) -> dict:
    """records (line, language, seg, tgts) with the translation of each set as config.output_field of the target, skipped ones as null; JSONL at
    `output`, and the records as they came at `references`. prompt: source column to prompt column. Returns counts."""
    made = (prompt or (lambda c: translation_payload(c, config.source_language, config.target_language)))(F.col("seg"))
    jobs = records.select("line", F.lit(config.target_language).alias("language"), made.alias("prompt"))
    run = Run(spark, output, config.manifest(), resume)
    done = run.answers(jobs, model, config.max_model_len, config.max_new_tokens, lines)
    files.remove(spark, output)
    rows = records.join(done.select("line", F.col("text").alias("answer"), "skip_reason"), "line")
    field = T.upsert(F.col("tgts"), config.target_language, config.output_field, rstrip(F.col("answer")))
    write_jsonl(rows.select("line", "language", "seg", field.alias("tgts")), output)
    if references is not None:
        write_jsonl(records.select("line", "language", "seg", "tgts"), references)
    return done.agg(F.count("*").alias("translations"), F.count("skip_reason").alias("skipped")).first().asDict()


def corrections(pairs: DataFrame, answers: DataFrame, threshold: float) -> DataFrame:
    """pairs (see load_pairs) and answers (see generate) to the audit: line, pos, language, base, human, corrected, edit_fraction, large_edit,
    raw_response, finish_reason, extraction_error. Answers are not validated; what gives no text is null with a reason."""
    got = extract_response(answers.select("line", "language", "raw_response", "finish_reason", "skip_reason"))
    rows = pairs.withColumnRenamed("language", "source_language").withColumn("language", F.col("target_language")).join(got, ["line", "language"])
    error = F.when(F.col("skip_reason") == "skipped", "base translation unavailable").when(F.col("skip_reason") == "context_budget_exceeded", "context budget exceeded").otherwise(F.col("extraction_error"))
    rows = rows.withColumn("extraction_error", error).withColumn("edit_fraction", edit_fraction(F.col("base"), F.col("corrected")))
    return rows.select("line", "pos", "language", "base", "human", "corrected", "edit_fraction", F.coalesce(F.col("edit_fraction") > threshold, F.lit(False)).alias("large_edit"), "raw_response", "finish_reason", "extraction_error")


def post_edit(spark: SparkSession, pairs: DataFrame, output: str, config, model: ModelFn = echo_teacher, resume: bool = False, lines: int = 100_000) -> dict:
    """pairs of load_pairs, each corrected by the teacher; the records in their present form at `output`, statistics at output.stats.json (returned)."""
    prompt = F.when(F.col("base").isNotNull(), chat_payload(F.col("language"), F.col("target_language"), F.col("seg"), F.col("base"), F.col("human"), config.prompt))
    jobs = pairs.select("line", F.col("target_language").alias("language"), prompt.alias("prompt"))
    run = Run(spark, output, config.manifest(), resume)
    done = run.answers(jobs, model, config.max_model_len, config.max_new_tokens, lines)
    files.remove(spark, output)
    audit = corrections(pairs, done, config.review_edit_fraction)
    new = audit.select("line", "pos", "human", "corrected")
    records = pairs.select("line", F.col("language"), "seg", "pos", F.get("tgts", F.col("pos")).alias("t")).join(new, ["line", "pos"])
    t = T.set_field(T.upgrade_legacy(F.col("t")), "corrected", F.col("corrected"))
    t = F.when(F.col("human").isNotNull(), T.set_field(t, "human", F.col("human"))).otherwise(t)
    grouped = records.groupBy("line", "language", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(t).alias("t")))), lambda x: F.parse_json(x["t"])).alias("tgts"))  # a record's own targets
    write_jsonl(grouped.select("line", "language", "seg", "tgts"), output)
    found = post_edit_stats(audit, config.review_edit_fraction).first().asDict()
    files.atomic_json(spark, run.stats, found)
    return found
