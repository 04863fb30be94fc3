"""Scans: JSONL records, TSV, JSON, plain text (plain or gzip by suffix), each with 1-based line numbers.

Gzip files are not split; repartition after the scan if they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import is_blank
from .files import stream_digest

RECORD = "language VARIANT, seg VARIANT, tgts ARRAY<MAP<STRING, VARIANT>>"


def number_lines(df: DataFrame, order: list[str], first: str | None = None, rows_per_part: int = 1_000_000) -> DataFrame:
    """Add `line`, 1.. in the order of the columns. Ranges of the first column get offsets from their counts, so no task sorts everything; there
    are as many ranges as the number of rows asks for, 64 at least.

    `first` must be numeric; ties in the whole order are numbered in any order."""
    key = first or order[0]
    parts = max(64, df.count() // rows_per_part)
    bounds = sorted(set(df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts + 10_000)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    dealt = df.withColumn("_part", part)
    offsets, at = [], 0
    for p, n in sorted((r._part, r.n) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets.append((p, at))
        at += n
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _base long").coalesce(1))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(base, "_part").withColumn("line", (number + F.col("_base")).cast("long")).drop("_part", "_base")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of text files; .gz by suffix; line breaks \\n, \\r\\n, \\r. Several files follow each other in the order of their names.

    A split holds its lines in order, so its count and first row number are all that is needed: nothing is sorted or shuffled, and one small row
    a split meets the driver. The files must not change between that count and the reading."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits, done = [], 0
    for r in sorted(raw.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("low")).collect()):
        splits.append((r._file, r._start, done + 1 - r.low))
        done += r.n
    shift = F.broadcast(spark.createDataFrame(splits, "_file string, _start long, _shift long").coalesce(1))
    return raw.join(shift, ["_file", "_start"]).select((F.col("_at") + F.col("_shift")).alias("line"), "value")


def parse_records(lines: DataFrame) -> DataFrame:
    """(line, value) to (line, raw, form, language, seg, tgts); targets keep key presence, JSON type and key order. form: object, other (JSON of
    another kind) or malformed. A key that comes twice counts with its last value at the top and is a violation in a target."""
    parsed = F.from_json("value", RECORD)
    text = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.variant_get(c, "$", "string"))
    form = F.when(F.from_json("value", "map<string, variant>").isNotNull(), "object").when(F.try_parse_json("value").isNotNull(), "other").otherwise("malformed")
    rows = lines.select("line", F.col("value").alias("raw"), form.alias("form"), parsed.alias("r"))
    return rows.select("line", "raw", "form", text(F.col("r.language")).alias("language"), text(F.col("r.seg")).alias("seg"), F.col("r.tgts").alias("tgts"))


def parse_tsv(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Literal TAB fields; rows of another arity have nulls and are violations."""
    parts = F.split("value", "\t", -1)
    ok = F.size(parts) == len(columns)
    return lines.select("line", *[F.when(ok, F.get(parts, i)).alias(c) for i, c in enumerate(columns)], ok.alias("well_formed"))


def sniff_format(spark: SparkSession, path: str) -> str:
    """json, jsonl, tsv or text. By suffix; a .json file is decided as a whole: an object on each of several lines, else one document, else text."""
    name = path.removesuffix(".gz")
    if name.endswith((".jsonl", ".tsv")):
        return name.rsplit(".", 1)[1]
    if not name.endswith(".json"):
        return "text"
    lines = spark.read.text(path).where(~is_blank(F.col("value")))
    objects = F.count_if(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())
    n, good = lines.agg(F.count("*"), objects).first()
    if n > 1 and n == good:  # the parser takes a document and passes over what follows, so lines are tried first
        return "jsonl"
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").isNotNull().alias("ok")).first()
    return "json" if whole and whole.ok else "text"


#: Kinds of evaluation input.
SUFFIXES = (".json", ".jsonl", ".tsv", ".txt", ".en")


def whole_json(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the elements of one JSON array, or the one document that is none, as JSON text."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    is_list = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    items = F.when(is_list, F.variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return v.select(F.posexplode(items).alias("pos", "x")).select((F.col("pos") + 1).cast("long").alias("line"), F.to_json("x").alias("value"))


def read_examples(spark: SparkSession, path: str, fields: list[str], strict: bool = False) -> DataFrame:
    """(line, fields as strings) from .json (array or lines), .jsonl, .tsv or text (first field only), plain or gzip.

    strict, for JSON: each item is an object, or this fails; the last field's presence is told too (has_ and its name)."""
    kind = sniff_format(spark, path)
    if kind == "tsv":
        return parse_tsv(read_lines(spark, path), fields).drop("well_formed")
    if kind == "text" and not strict:
        return read_lines(spark, path).select("line", F.col("value").alias(fields[0]), *[F.lit(None).cast("string").alias(f) for f in fields[1:]])
    lines = whole_json(spark, path) if kind == "json" else read_lines(spark, path)
    parsed = F.from_json("value", "map<string, variant>")
    rows = lines.select("line", "value", parsed.alias("r"))
    if strict:
        from ..operators.validate import checked

        checked(rows, {"object": (F.col("r").isNull(), "expected a JSON object")}, path)
    presence = [F.map_contains_key("r", F.lit(fields[-1])).alias(f"has_{fields[-1]}")] if strict else []
    return rows.select("line", *[text_variant(F.col("r"), f).alias(f) for f in fields], *presence)


def read_scores(lines: DataFrame, name: str = "score", where: str = "scores") -> DataFrame:
    """(pos, src, has_ref, ref, score) of a metric's JSON document: a list of sentence records, or an object with one system's list.

    value: the whole document. Another number of systems, no records, a record without a text src or without a finite score are errors."""
    whole = lines.select(F.try_parse_json("value").alias("v"))
    is_list = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    systems = F.when(is_list, F.array(F.col("v"))).otherwise(F.map_values(F.variant_get("v", "$", "map<string, variant>")))
    one = whole.select(F.when(is_list | F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), systems).alias("systems"))
    count = one.select(F.size("systems")).first()
    if count is None or count[0] != 1:
        raise ValueError(f"{where}: expected exactly one system")
    listed = one.select(F.get("systems", 0).alias("list"))
    if not listed.where(F.startswith(F.schema_of_variant("list"), F.lit("ARRAY"))).count():
        raise ValueError(f"{where}: expected a nonempty list of sentence records")
    rows = listed.select(F.posexplode(F.variant_get("list", "$", "array<variant>")).alias("pos", "x"))
    is_object = F.startswith(F.schema_of_variant("x"), F.lit("OBJECT"))
    field = lambda k: F.when(is_object, F.try_variant_get("x", f"$.{k}", "variant"))
    text = lambda c: F.when(F.schema_of_variant(c) == "STRING", F.variant_get(c, "$", "string"))
    number = F.when(F.schema_of_variant(field("COMET")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get("x", "$.COMET", "double"))
    has_ref = F.coalesce(F.map_contains_key(F.when(is_object, F.variant_get("x", "$", "map<string, variant>")), F.lit("ref")), F.lit(False))
    rows = rows.select(F.col("pos").cast("long").alias("pos"), text(field("src")).alias("src"), has_ref.alias("has_ref"), text(field("ref")).alias("ref"), number.alias(name))
    bad = F.col("src").isNull() | F.col(name).isNull() | F.isnan(name) | (F.abs(name) == float("inf"))
    first = rows.agg(F.min(F.when(bad, F.struct("pos", F.col("src").isNull().alias("no_src")))).alias("bad"), F.count("*").alias("n")).first()
    if not first.n:
        raise ValueError(f"{where}: expected a nonempty list of sentence records")
    if first.bad is not None:
        raise ValueError(f"{where}: sentence {first.bad.pos + 1} must contain " + ("a string 'src'" if first.bad.no_src else "a finite numeric 'COMET' score"))
    return rows


def load_scores(spark: SparkSession, path: str, name: str = "score") -> DataFrame:
    return read_scores(spark.read.text(path, wholetext=True), name, path)


def write_jsonl(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """One JSON object a line, nulls kept, in order of line; fails if the path exists. task commit makes it atomic."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != "line"]), {"ignoreNullFields": "false"})
    df.orderBy("line").select(body.alias("value")).write.mode("errorifexists").option("compression", compression).text(path)


def write_tsv(df: DataFrame, columns: list[str], path: str, compression: str = "none") -> None:
    df.orderBy("line").select(F.concat_ws("\t", *columns).alias("value")).write.mode("errorifexists").option("compression", compression).text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Headered TSV with CSV quoting."""
    df.orderBy("line").write.mode("errorifexists").csv(path, sep="\t", header=True)


def file_digests(spark: SparkSession, path: str, whole: int = 256 << 20) -> DataFrame:
    """(name, length, sha256) of each file. Files of up to `whole` bytes are digested by the tasks, larger ones as a stream, one after another, by the
    driver's JVM, so no file has to fit into a row."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "[^/]+$", 0).alias("name")
    out = files.where(F.col("length") <= whole).select(name, "length", F.sha2("content", 256).alias("sha256"))
    large = [(r.name, r.length, stream_digest(spark, r.path)) for r in files.where(F.col("length") > whole).select("path", name, "length").collect()]
    return out.unionByName(spark.createDataFrame(large, "name string, length long, sha256 string")) if large else out


def text_variant(target: Column, key: str) -> Column:
    """A target's field as text; null where absent, null or not a string."""
    value = target[key]
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))
