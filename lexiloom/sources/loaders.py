"""From a path to checked rows in one call. Errors name the path and the smallest line that breaks a rule; what is beyond a limit is checked too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import is_blank
from ..operators import align as A, targets as T, validate as V
from .records import RECORD, SUFFIXES, parse_records, parse_tsv, read_examples, read_lines, sniff_format, text_variant, whole_json


def load_records(spark: SparkSession, path: str, rules: V.Rules | None = None, gzip_only: bool = False) -> DataFrame:
    """Strict JSONL records: every line is a JSON object of the record's shape. rules: further ones, after those."""
    if gzip_only and not path.endswith(".gz"):
        raise ValueError(f"{path}: expected a .gz file")
    return V.checked(parse_records(read_lines(spark, path)), V.record_rules() | (rules or {}), path)


def load_translations(spark: SparkSession, path: str) -> DataFrame:
    """(line, language, seg, target_language, text) of a gzip file of records, one row a target; the first present of the compared names is read,
    empty texts are values and nothing is trimmed."""
    r = load_records(spark, path, V.compared_rules(), gzip_only=True)
    t = F.col("t")
    return r.select("line", "language", "seg", F.explode("tgts").alias("t")).select("line", "language", "seg", text_variant(t, "language").alias("target_language"), T.by_presence(t, T.COMPARED).alias("text"))


def load_pairs(spark: SparkSession, path: str, references: str | None = None, limit: int | None = None, embedded: bool = True) -> DataFrame:
    """(line, language, seg, tgts, pos, target_language, base, human) of post-editing input, one row a target in the record's order.

    human comes from the records of `references` by line and language, else from the record itself (embedded; null where a record has none).
    Both files are checked and aligned as a whole before the limit."""
    own = load_records(spark, path, V.base_rules() | (V.embedded_rules() if references is None and embedded else {}))
    rows = T.explode_targets(own).select("line", "pos", F.col("language").alias("target_language"), "base", T.by_presence(F.col("target"), ("human", "human_reference")).alias("own_human"))
    if references is not None:
        other = load_records(spark, references, V.human_rules())
        sides = [x.select("line", F.struct("language", "seg").alias("seg"), T.language_set(F.col("tgts")).alias("languages")) for x in (own, other)]
        V.raise_first(A.alignment_codes(A.align(*sides)).select("line", F.lit(0).alias("rank"), F.col("code").alias("message")))
        human = T.explode_targets(other).select("line", F.col("language").alias("target_language"), "human")
        rows = rows.join(human, ["line", "target_language"])
    else:
        rows = rows.withColumn("human", F.col("own_human") if embedded else F.lit(None).cast("string"))
    out = own.select("line", "language", "seg", "tgts").join(rows.drop("own_human"), "line")
    return V.not_empty(out if limit is None else out.where(F.col("line") <= limit), "no input records")


def load_tsv(spark: SparkSession, path: str, source_language: str, target_language: str, limit: int | None = None, skip_header: bool = False) -> DataFrame:
    """Records (line, language, seg, tgts) of a file of source and human translation. line is the file's own; a header is line 1 and left out."""
    rows = parse_tsv(read_lines(spark, path), ["seg", "human"])
    rows = V.checked(rows.where("line > 1") if skip_header else rows, V.tsv_rules(["seg", "human"]), path)
    if limit is not None:
        rows = rows.where(F.col("line") <= limit + skip_header)
    target = F.create_map(F.lit("language"), F.lit(target_language).cast("variant"), F.lit("human"), F.col("human").cast("variant"))
    return V.not_empty(rows.select("line", F.lit(source_language).alias("language"), "seg", F.array(target).alias("tgts")), "no input sentence pairs")


def load_json(spark: SparkSession, path: str, source_language: str, target_language: str, output_field: str, limit: int | None = None) -> DataFrame:
    """Records (line, raw, language, seg, tgts) of one JSON document (an object, or an array of them), else of JSON lines, else of plain text lines.

    The target of the language is added where it is missing. Its output field must not be there yet. raw keeps all other fields."""
    kind = sniff_format(spark, path if ".json" in path.rsplit("/", 1)[-1] else path + ".json") if path.removesuffix(".gz").endswith((".json", ".jsonl")) else "text"
    lines = whole_json(spark, path) if kind == "json" else read_lines(spark, path)
    if kind == "text":
        lines = lines.select("line", F.to_json(F.struct(F.lit(source_language).alias("language"), F.col("value").alias("seg"))).alias("value"))
    rows = parse_records(lines)
    own = lambda t: F.coalesce(text_variant(t, "language") == target_language, F.lit(False))
    broken = F.col("tgts").isNull() & F.from_json("raw", "map<string, variant>").getItem("tgts").isNotNull()
    rules = V.object_rules() | {
        "seg": (is_blank(F.col("seg")), "expected a nonempty seg source"),
        "language": (~F.col("language").eqNullSafe(source_language), "source language differs from the declared one"),
        "tgts": (broken, "tgts must be a list of objects"),
        **V.one_target_rules(target_language),
        "output": (F.exists("tgts", lambda t: own(t) & F.map_contains_key(t, output_field)), f"{output_field} already exists"),
    }
    V.checked(rows, rules, path)
    given = F.coalesce("tgts", F.from_json(F.lit("{\"tgts\": []}"), RECORD)["tgts"])
    missing = F.create_map(F.lit("language"), F.lit(target_language).cast("variant"))
    rows = rows.withColumn("tgts", F.when(F.exists(given, own), given).otherwise(F.concat(given, F.array(missing))))
    return V.not_empty(rows if limit is None else rows.where(F.col("line") <= limit), "input contains no source records")


def load_input(spark: SparkSession, path: str) -> DataFrame:
    """(line, src, tgt, has_tgt) of evaluation input: .json, .jsonl, .tsv (one or two fields), .txt or .en, plain or gzip."""
    suffix = "." + path.removesuffix(".gz").rsplit(".", 1)[-1]
    if suffix not in SUFFIXES:
        raise ValueError("input must be .json, .jsonl, .tsv, .txt, or .en, optionally .gz")
    if suffix in (".json", ".jsonl"):
        return read_examples(spark, path, ["src", "tgt"], strict=True)
    lines = read_lines(spark, path)
    if suffix != ".tsv":
        return lines.select("line", F.col("value").alias("src"), F.lit(None).cast("string").alias("tgt"), F.lit(False).alias("has_tgt"))
    parts = F.split("value", "\t", -1)
    V.checked(lines, {"arity": (F.size(parts) > 2, "expected src or src<TAB>tgt")}, path)
    return lines.select("line", F.get(parts, 0).alias("src"), F.get(parts, 1).alias("tgt"), (F.size(parts) == 2).alias("has_tgt"))


def load_examples(spark: SparkSession, path: str, target_language: str | None = None, limit: int | None = None) -> DataFrame:
    """(line, source_language, source, target_language, base, human, corrected): inspection input, exactly one target a record.

    Here rows past the limit are not looked at: the limit goes before the checks."""
    lines = read_lines(spark, path)
    rows = parse_records(lines if limit is None else lines.where(F.col("line") <= limit))
    own = lambda t: F.lit(True) if target_language is None else F.coalesce(text_variant(t, "language") == target_language, F.lit(False))
    chosen = F.filter("tgts", own)
    odd = lambda c: F.exists(chosen, lambda t: F.map_contains_key(t, c) & ~F.schema_of_variant(t[c]).isin("STRING", "VOID"))
    rules = V.object_rules() | {
        "source": (F.col("language").isNull() | is_blank(F.col("seg")) | F.col("tgts").isNull(), "expected source language/seg and tgts list"),
        "target": ((F.size(chosen) != 1) | F.exists(chosen, lambda t: text_variant(t, "language").isNull()), "select exactly one target by its language"),
    } | {c: (odd(c), f"{c} must be a string or null") for c in ("base", "human", "corrected")}
    V.checked(rows, rules, path)
    t = F.col("t")
    rows = rows.select("line", F.col("language").alias("source_language"), F.col("seg").alias("source"), F.get(chosen, 0).alias("t"))
    return V.not_empty(rows.select("line", "source_language", "source", text_variant(t, "language").alias("target_language"), *[text_variant(t, v).alias(v) for v in ("base", "human", "corrected")]), "no input records")


def load_queue(spark: SparkSession, path: str) -> DataFrame:
    """(partition, job_id, priority) of a listing with these three columns between blanks; lines of other shapes are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = read_lines(spark, path).where(F.size(parts) == 3)
    return rows.select(F.get(parts, 0).alias("partition"), F.get(parts, 1).alias("job_id"), F.get(parts, 2).try_cast("double").alias("priority")).where("priority is not null")


def load_template(spark: SparkSession, path: str) -> str:
    """A prompt's text, which must not be blank."""
    from .files import read_text

    text = read_text(spark, path)
    if not text.strip():
        raise ValueError("empty prompt")
    return text
