"""One query an operator of the reference's inventory, over the driver tables, with its SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Evaluation, Inspection, Selection
from ..functions import metrics, text as X
from ..operators import align as A, compare as C, evaluate as E, inspect as I, prepare as P, targets as T, training as R, validate as V
from ..sources import records as S
from ..streaming import generate as G
from .triples import DISTANCE_SQL, SCORES_SQL, SQL, TOKENS, VARIANTS, WORDS_SQL, char_distances, pair_distances, stand_in_scores, triples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_RT = "rtrim({0}, chr(32) || chr(9) || chr(10) || chr(13))"
_IDS = "list_transform(string_split({0}, ''), lambda c: unicode(c))"
_MD5 = "md5(array_to_string({0}, ','))"


def _md5(c):
    return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))


def w(body: str) -> str:
    return f"WITH {SQL} {body}"


def _record_lines(t: DataFrame) -> DataFrame:
    """Triples as JSON lines: (line, value). Keys of the target vary by line: base or student, human or human_reference, corrected at times."""
    keys = F.map_filter(
        F.create_map(F.lit("language"), F.lit("fr"), F.when(F.col("line") % 3 == 0, "student").otherwise("base"), F.col("base"), F.when(F.col("line") % 5 == 0, "human_reference").otherwise("human"), F.col("human"), F.lit("corrected"), F.col("corrected"), F.lit("seg"), F.lit("bare")),
        lambda k, v: ((k != "corrected") | (F.col("line") % 2 == 0)) & ((k != "seg") | (F.col("line") % 7 == 0)),
    )
    return t.select("line", F.to_json(F.struct(F.lit("en").alias("language"), "seg", F.array(keys).alias("tgts")), {"ignoreNullFields": "false"}).alias("value"))


def _records(spark, sf):
    return S.parse_records(_record_lines(triples(spark, sf)))


@query(w("SELECT line, 'en' AS language, seg, 1 AS n_targets FROM triples"))
def scan_records(spark, sf):
    return _records(spark, sf).select("line", "language", "seg", F.size("tgts").alias("n_targets"))


@query(w("SELECT line, rtrim(base, chr(32) || chr(9) || chr(10) || chr(13)) AS base, 'fr' AS language FROM triples"))
def alias_base(spark, sf):
    return T.explode_targets(_records(spark, sf)).select("line", "base", "language")


@query(w("SELECT line, human FROM triples"))
def alias_human(spark, sf):
    return T.explode_targets(_records(spark, sf)).select("line", "human")


@query(w("SELECT line, CASE WHEN line % 2 = 0 THEN 'corrected' WHEN line % 3 = 0 THEN 'student' ELSE 'base' END AS key, CASE WHEN line % 2 = 0 THEN corrected ELSE base END AS text FROM triples"))
def alias_compare_order(spark, sf):
    t = F.col("tgts")[0]
    return _records(spark, sf).select("line", T.present(t, T.COMPARED).alias("key"), T.by_presence(t, T.COMPARED).alias("text"))


@query(w(f"SELECT line, 'fr' AS language, {_RT.format('base')} AS base, human, CASE WHEN line % 2 = 0 THEN corrected END AS corrected, (CASE WHEN line % 2 = 0 THEN 'base,corrected,human,language' ELSE 'base,human,language' END) AS keys FROM triples"))
def legacy_upgrade(spark, sf):
    up = _records(spark, sf).select("line", T.upgrade_legacy(F.col("tgts")[0]).alias("t"))
    fields = [S.text_variant(F.col("t"), k).alias(k) for k in ("language", "base", "human", "corrected")]
    return up.select("line", *fields, F.array_join(F.array_sort(F.map_keys("t")), ",").alias("keys"))


@query(w("SELECT line, CASE WHEN line % 4 = 0 THEN 'de' ELSE 'fr' END AS language, seg AS model FROM triples"))
def target_upsert(spark, sf):
    r = _records(spark, sf)
    fr, de = T.upsert(F.col("tgts"), "fr", "model", F.col("seg")), T.upsert(F.col("tgts"), "de", "model", F.col("seg"))
    out = r.select("line", F.element_at(F.when(F.col("line") % 4 == 0, de).otherwise(fr), -1).alias("t"))
    return out.select("line", S.text_variant(F.col("t"), "language").alias("language"), S.text_variant(F.col("t"), "model").alias("model"))


@query(w("SELECT line, replace(replace(seg, chr(10), ' '), chr(9), ' ') AS src, replace(replace(human, chr(10), ' '), chr(9), ' ') AS tgt FROM triples"))
def tsv_roundtrip(spark, sf):
    clean = lambda c: F.translate(c, "\n\t", "  ")
    lines = triples(spark, sf).select("line", F.concat_ws("\t", clean("seg"), clean("human")).alias("value"))
    return S.parse_tsv(lines, ["src", "tgt"]).where("well_formed").drop("well_formed")


@query(w(r"""SELECT line, seg || chr(9) || h || chr(9) || b || chr(9) || c AS row FROM (SELECT line, e1 AS seg, e2 AS h, e3 AS b, e4 AS c FROM (SELECT line,
  replace(replace(replace(replace(seg, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS e1, replace(replace(replace(replace(human, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS e2,
  replace(replace(replace(replace(base, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS e3, replace(replace(replace(replace(corrected, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS e4 FROM triples
  WHERE seg <> '' AND human <> '' AND base <> '' AND corrected <> ''))"""))
def export_train4_jq(spark, sf):
    cols = ["seg", "human", "base", "corrected"]
    t = triples(spark, sf).where(" and ".join(f"{c} is not null and {c} <> ''" for c in cols))
    return t.select("line", F.concat_ws("\t", *[X.tsv_escape(F.col(c)) for c in cols]).alias("row"))


def _selected(t, cols):
    return t.where(~F.greatest(*[X.is_blank(F.col(c)).cast("int") for c in cols]).cast("boolean"))


@query(w("SELECT line, seg AS src, human AS tgt FROM triples WHERE trim(seg) <> '' AND trim(human) <> ''"))
def select_sft_pairs(spark, sf):
    return _selected(triples(spark, sf), ["seg", "human"]).select("line", F.col("seg").alias("src"), F.col("human").alias("tgt"))


@query(w("SELECT line, seg AS src, corrected AS tgt, base AS reject FROM triples WHERE trim(seg) <> '' AND trim(corrected) <> '' AND trim(base) <> ''"))
def select_pref_triplets(spark, sf):
    return _selected(triples(spark, sf), ["seg", "corrected", "base"]).select("line", F.col("seg").alias("src"), F.col("corrected").alias("tgt"), F.col("base").alias("reject"))


@query(w("SELECT line, human AS src, seg AS tgt FROM triples WHERE trim(seg) <> '' AND trim(human) <> ''"))
def select_reversed(spark, sf):
    return _selected(triples(spark, sf), ["human", "seg"]).select("line", F.col("human").alias("src"), F.col("seg").alias("tgt"))


@query(w("SELECT count(*) AS read, count(*) FILTER (WHERE NOT m AND NOT c) AS written, count(*) FILTER (WHERE m) AS missing_or_empty, count(*) FILTER (WHERE NOT m AND c) AS tsv_control_characters FROM (SELECT corrected IS NULL OR trim(corrected) = '' OR trim(seg) = '' AS m, regexp_matches(seg || coalesce(corrected, ''), '[\\t\\r\\n]') AS c FROM triples)".replace("\\\\", "\\")))
def prepare_counts(spark, sf):
    t = triples(spark, sf).select((X.is_blank(F.col("corrected")) | X.is_blank(F.col("seg"))).alias("m"), F.concat("seg", F.coalesce("corrected", F.lit(""))).rlike("[\t\r\n]").alias("c"))
    return t.agg(F.count("*").alias("read"), F.count_if(~F.col("m") & ~F.col("c")).alias("written"), F.count_if("m").alias("missing_or_empty"), F.count_if(~F.col("m") & F.col("c")).alias("tsv_control_characters"))


@query(w(r"SELECT line FROM triples WHERE NOT regexp_matches(seg || human, '[\t\r\n]')"))
def tsv_control_filter(spark, sf):
    return triples(spark, sf).where(~F.concat("seg", "human").rlike("[\t\r\n]")).select("line")


def _sides(spark, sf):
    t = triples(spark, sf)
    left = t.where("line % 13 <> 0").select("line", "seg", F.array(F.lit("de"), F.lit("fr")).alias("languages"))
    right = t.where("line % 17 <> 0").select("line", F.when(F.col("line") % 10 == 0, F.concat("seg", F.lit("!"))).otherwise(F.col("seg")).alias("seg"), F.array_sort(F.when(F.col("line") % 9 == 0, F.array(F.lit("fr"))).otherwise(F.array(F.lit("fr"), F.lit("de")))).alias("languages"))
    return A.align(left, right)


@query(w("SELECT line, (line % 13 <> 0) AS has_left, (line % 17 <> 0) AS has_right FROM triples WHERE line % 13 <> 0 OR line % 17 <> 0"))
def align_full_outer(spark, sf):
    return _sides(spark, sf).select("line", F.col("l_present").isNotNull().alias("has_left"), F.col("r_present").isNotNull().alias("has_right"))


@query(w("SELECT * FROM (SELECT line, CASE WHEN line % 13 = 0 OR line % 17 = 0 THEN 'count' WHEN line % 10 = 0 THEN 'source' WHEN line % 9 = 0 THEN 'languages' END AS code FROM triples WHERE line % 13 <> 0 OR line % 17 <> 0) WHERE code IS NOT NULL"))
def align_violations(spark, sf):
    return A.alignment_codes(_sides(spark, sf))


@query(w("SELECT line, (line % 9 <> 0) AS same_languages FROM triples WHERE line % 13 <> 0 AND line % 17 <> 0"))
def lang_set_equality(spark, sf):
    return _sides(spark, sf).where("l_present and r_present").select("line", (F.col("l_languages") == F.col("r_languages")).alias("same_languages"))


@query(w("SELECT line, seg AS src, human AS tgt FROM triples"))
def reference_attach(spark, sf):
    t = triples(spark, sf)
    rows = t.select("line", F.col("seg").alias("src"), F.col("base").alias("tgt"))
    return A.attach_references(rows, t.select("line", F.col("human").alias("text")))


@query(w("SELECT line, 'duplicate_language' AS code FROM triples WHERE line % 23 = 0"))
def duplicate_targets(spark, sf):
    r = _records(spark, sf)
    twice = r.withColumn("tgts", F.when(F.col("line") % 23 == 0, F.concat("tgts", "tgts")).otherwise(F.col("tgts")))
    return V.violations(twice, V.record_rules()).select("line", "code")


@query(w("SELECT line, seg FROM triples WHERE line > 40"))
def resume_antijoin(spark, sf):
    t = triples(spark, sf)
    return A.remaining(t.select("line", "seg"), t.where("line <= 40").select("line"))


@query(w("SELECT min(line) AS first_gap FROM triples WHERE line % 25 = 0"))
def journal_contiguity(spark, sf):
    return spark.createDataFrame([(A.first_gap(triples(spark, sf).where("line % 25 <> 0").select("line")),)], "first_gap long")


@query(w("SELECT line, conv_id FROM triples"))
def line_numbering(spark, sf):
    return triples(spark, sf).select("line", "conv_id")


@query(w("SELECT (line - 1) // 32 AS batch, count(*) AS n, min(line) AS first_line FROM triples GROUP BY 1"))
def batch_slices(spark, sf):
    return triples(spark, sf).groupBy(F.floor((F.col("line") - 1) / 32).alias("batch")).agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query(f"SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents")
def tokenize(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens FROM documents")
def token_counts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(DISTANCE_SQL + " SELECT line, pair, char_distance::BIGINT AS distance, char_length::BIGINT AS longer FROM distances")
def char_distance(spark, sf):
    return char_distances(triples(spark, sf)).select("line", "pair", F.col("char_distance").cast("long").alias("distance"), F.col("char_length").cast("long").alias("longer"))


@query(WORDS_SQL + " SELECT line, pair, word_distance AS distance, word_length::BIGINT AS longer FROM edits")
def word_distance(spark, sf):
    return pair_distances(triples(spark, sf)).select("line", "pair", F.col("word_distance").cast("long").alias("distance"), F.col("word_length").cast("long").alias("longer"))


_FLAT = [f"{a}_vs_{b}" for a, b in (("base", "human"), ("base", "corrected"), ("human", "corrected"))]


@query(WORDS_SQL + " SELECT line, " + ", ".join(f"max({u}_distance) FILTER (WHERE pair = '{p}')::BIGINT AS {p}_{u}" for p in _FLAT for u in ("char", "word")) + " FROM edits GROUP BY line")
def pair_distances_flat(spark, sf):
    d = pair_distances(triples(spark, sf))
    return d.groupBy("line").agg(*[F.max(F.when(F.col("pair") == p, F.col(f"{u}_distance"))).cast("long").alias(f"{p}_{u}") for p in _FLAT for u in ("char", "word")])


_DESC = "round(avg({0}), 9) AS mean, round(quantile_cont({0}, 0.5), 9) AS median, round(quantile_cont({0}, 0.1), 9) AS p10, round(quantile_cont({0}, 0.9), 9) AS p90"


def _described(x):
    d = X.describe(F.col(x))
    return [F.round(d[n], 9).alias(n) for n in ("mean", "median", "p10", "p90")]


_SUMS = ("word_distance", "word_length", "char_distance", "char_length")


@query(WORDS_SQL + " SELECT pair, count(*) AS pairs, count(*) FILTER (WHERE identical) AS identical, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _SUMS) + ", " + _DESC.format("word_normalized") + " FROM edits GROUP BY pair")
def edit_summary(spark, sf):
    d = pair_distances(triples(spark, sf))
    return d.groupBy("pair").agg(F.count("*").alias("pairs"), F.count_if("identical").alias("identical"), *[F.sum(c).cast("long").alias(c) for c in _SUMS], *_described("word_normalized"))


@query(WORDS_SQL + " SELECT pair, " + ", ".join(f"round(sum({u}_distance) / sum({u}_length), 9) AS {u}" for u in ("word", "char")) + " FROM edits GROUP BY pair")
def pooled_distance(spark, sf):
    return pair_distances(triples(spark, sf)).groupBy("pair").agg(*[F.round(F.sum(f"{u}_distance") / F.sum(f"{u}_length"), 9).alias(u) for u in ("word", "char")])


@query(DISTANCE_SQL + " SELECT pair, round(1 - count(*) FILTER (WHERE identical) / count(*), 9) AS changed_fraction FROM distances GROUP BY pair")
def changed_fraction(spark, sf):
    return pair_distances(triples(spark, sf)).groupBy("pair").agg(F.round(1 - F.count_if("identical") / F.count("*"), 9).alias("changed_fraction"))


@query(SCORES_SQL + " SELECT variant, count(*) AS n, " + _DESC.format("nll") + " FROM scores WHERE status = 'ok' GROUP BY variant")
def describe_by_variant(spark, sf):
    return stand_in_scores(triples(spark, sf)).where("status = 'ok'").groupBy("variant").agg(F.count("*").alias("n"), *_described("nll"))


def _groups(spark, sf):
    s = stand_in_scores(triples(spark, sf))
    complete = s.groupBy("line").agg(F.every(F.col("status") == "ok").alias("ok")).where("ok").select("line")
    return s, s.join(complete, "line", "left_semi")


_MICRO = "SELECT '{0}' AS label, variant, sum(tokens)::BIGINT AS tokens, round(-sum(total_logprob) / sum(tokens), 9) AS nll, round(exp(-sum(total_logprob) / sum(tokens)), 9) AS perplexity FROM scores WHERE status = 'ok' {1} GROUP BY variant"


@query(SCORES_SQL + _MICRO.format("all_available", "") + " UNION ALL " + _MICRO.format("complete_triplets", "AND line IN (SELECT line FROM complete)"))
def nll_micro(spark, sf):
    micro = -F.sum("total_logprob") / F.sum("tokens")
    out = [g.where("status = 'ok'").groupBy(F.lit(n).alias("label"), "variant").agg(F.sum("tokens").alias("tokens"), F.round(micro, 9).alias("nll"), F.round(X.safe_exp(micro), 9).alias("perplexity")) for n, g in zip(("all_available", "complete_triplets"), _groups(spark, sf))]
    return out[0].unionByName(out[1])


@query(SCORES_SQL + " SELECT line, variant, round(perplexity, 9) AS perplexity FROM scores")
def perplexity(spark, sf):
    return stand_in_scores(triples(spark, sf)).select("line", "variant", F.round("perplexity", 9).alias("perplexity"))


@query(SCORES_SQL + " SELECT pair, count(*) AS n, " + _DESC.format("delta") + " FROM (SELECT a.variant || '_to_' || b.variant AS pair, b.nll - a.nll AS delta FROM scores a JOIN scores b ON a.line = b.line AND (a.variant, b.variant) IN (('base', 'human'), ('base', 'corrected'), ('human', 'corrected')) WHERE a.line IN (SELECT line FROM complete)) GROUP BY pair")
def nll_deltas(spark, sf):
    wide = _groups(spark, sf)[1].groupBy("line").pivot("variant", list(VARIANTS)).agg(F.first("nll"))
    made = F.array(*[F.struct(F.lit(f"{a}_to_{b}").alias("pair"), (F.col(b) - F.col(a)).alias("delta")) for a, b in (("base", "human"), ("base", "corrected"), ("human", "corrected"))])
    return wide.select(F.explode(made).alias("d")).select("d.*").groupBy("pair").agg(F.count("*").alias("n"), *_described("delta"))


@query(SCORES_SQL + " SELECT variant, status, count(*) AS n FROM scores GROUP BY variant, status")
def status_counts(spark, sf):
    return stand_in_scores(triples(spark, sf)).groupBy("variant", "status").agg(F.count("*").alias("n"))


@query(SCORES_SQL + " SELECT line FROM complete")
def complete_triplets(spark, sf):
    return _groups(spark, sf)[1].select("line").distinct()


@query(SCORES_SQL + " SELECT line, " + ", ".join(f"max(status) FILTER (WHERE variant = '{v}') AS {v}_status, max(tokens) FILTER (WHERE variant = '{v}')::BIGINT AS {v}_tokens, round(max(nll) FILTER (WHERE variant = '{v}'), 9) AS {v}_nll" for v in VARIANTS) + " FROM scores GROUP BY line")
def wide_flatten(spark, sf):
    s = stand_in_scores(triples(spark, sf))
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return s.groupBy("line").agg(*[c for v in VARIANTS for c in (pick(v, "status").alias(f"{v}_status"), pick(v, "tokens").cast("long").alias(f"{v}_tokens"), F.round(pick(v, "nll"), 9).alias(f"{v}_nll"))])


_BUDGET = 2000
_LEN = "(length(seg) + 2 + length(rtrim({0}, chr(32) || chr(9) || chr(10) || chr(13))) + 1)"
_SFT_REASON = f"CASE WHEN corrected IS NULL OR trim(corrected) = '' OR trim(seg) = '' THEN 'missing_or_empty_field' WHEN {_LEN.format('corrected')} > {_BUDGET} THEN 'max_length' END"
_PREF_REASON = f"CASE WHEN corrected IS NULL OR base IS NULL OR trim(corrected) = '' OR trim(base) = '' OR trim(seg) = '' THEN 'missing_or_empty_field' WHEN {_LEN.format('corrected')} > {_BUDGET} OR {_LEN.format('base')} > {_BUDGET} THEN 'max_length' WHEN corrected = base THEN 'identical_preferences' END"


def _reasoned(spark, sf, *answers):
    return R.with_reason(triples(spark, sf), "seg", list(answers), _BUDGET)


@query(w("SELECT line FROM triples WHERE length(seg) + 2 + 64 <= 600"))
def budget_filter(spark, sf):
    return triples(spark, sf).where(F.size(R.prompt_ids(F.col("seg"))) + 64 <= 600).select("line")


@query(w(f"SELECT reason, count(*) AS n FROM (SELECT {_PREF_REASON} AS reason FROM triples) WHERE reason IS NOT NULL GROUP BY reason"))
def exclusion_histogram(spark, sf):
    return _reasoned(spark, sf, "corrected", "base").where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


_PROMPT = f"([1, 2] || {_IDS.format('seg')})"
_END = lambda c: f"({_IDS.format(_RT.format(c))} || [9])"
_MASK = "list_transform(range(length(seg) + 2), lambda x: -100)"
_ONES = "list_transform(range({0}), lambda x: 1)"


@query(w(f"SELECT line, {_MD5.format(_PROMPT + ' || ' + _END('corrected'))} AS input_ids, {_LEN.format('corrected')}::BIGINT AS mask_ones, {_MD5.format(_MASK + ' || ' + _END('corrected'))} AS labels FROM (SELECT *, {_SFT_REASON} AS reason FROM triples) WHERE reason IS NULL"))
def sft_rows(spark, sf):
    rows = R.sft_rows(_reasoned(spark, sf, "corrected").where("reason is null"), "seg", "corrected")
    return rows.select("line", _md5("input_ids").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("mask_ones"), _md5("labels").alias("labels"))


def _preferences(spark, sf):
    return R.preference_rows(_reasoned(spark, sf, "corrected", "base").where("reason is null"), "seg", "corrected", "base")


@query(w(f"SELECT line, {_MD5.format(_PROMPT)} AS prompt, {_MD5.format(_END('corrected'))} AS chosen, {_MD5.format(_END('base'))} AS rejected FROM (SELECT *, {_PREF_REASON} AS reason FROM triples) WHERE reason IS NULL"))
def pref_rows(spark, sf):
    return _preferences(spark, sf).select("line", *[_md5(f"{n}_input_ids").alias(n) for n in ("prompt", "chosen", "rejected")])


@query(w("SELECT line, " + ", ".join(f"{_MD5.format(_PROMPT + ' || ' + _END(c))} AS {n}_input_ids, {_MD5.format(_ONES.format(_LEN.format(c)))} AS {n}_attention_mask, {_MD5.format(_MASK + ' || ' + _END(c))} AS {n}_labels" for n, c in (("chosen", "corrected"), ("rejected", "base"))) + f", {_MD5.format(_PROMPT)} AS prompt_input_ids, {_MD5.format(_ONES.format('length(seg) + 2'))} AS prompt_attention_mask FROM (SELECT *, {_PREF_REASON} AS reason FROM triples) WHERE reason IS NULL"))
def cpo_rows(spark, sf):
    rows = R.cpo_rows(_preferences(spark, sf))
    return rows.select("line", *[_md5(c).alias(c) for c in rows.columns if c != "line"])


_HUMAN = f"{_PROMPT} || {_END('human')}"
_FILL = "list_transform(range(longest - n), lambda x: {0})"


@query(w(f", b AS (SELECT *, (line - 1) // 16 AS batch, {_LEN.format('human')} AS n FROM triples), m AS (SELECT *, max(n) OVER (PARTITION BY batch) AS longest FROM b) SELECT line, batch, {_MD5.format('(' + _HUMAN + ') || ' + _FILL.format('0'))} AS input_ids, {_MD5.format(_ONES.format('n') + ' || ' + _FILL.format('0'))} AS attention_mask, {_MD5.format(_MASK + ' || ' + _END('human') + ' || ' + _FILL.format('-100'))} AS labels, {_MD5.format(_FILL.format('0') + ' || ' + _HUMAN)} AS left_padded FROM m"))
def padded_batch(spark, sf):
    rows = R.sft_rows(triples(spark, sf), "seg", "human")
    right = R.padded(rows, 16, {"input_ids": 0, "attention_mask": 0, "labels": R.IGNORED})
    left = R.padded(rows, 16, {"input_ids": 0}, left=True).select("line", _md5("input_ids").alias("left_padded"))
    return right.select("line", "batch", *[_md5(c).alias(c) for c in ("input_ids", "attention_mask", "labels")]).join(left, "line")


def _jobs(spark, sf):
    return triples(spark, sf).select("line", F.lit("fr").alias("language"), F.col("base").alias("prompt"))


_FINISH = "CASE WHEN base IS NULL OR length(base) + 20 > 1400 THEN 'skipped' WHEN line % 7 = 0 THEN 'length' ELSE 'stop' END"


@query(w(f"SELECT finish, count(*) AS n FROM (SELECT {_FINISH} AS finish FROM triples) GROUP BY finish"))
def finish_reason_counts(spark, sf):
    return G.generate(_jobs(spark, sf), budget=1400, reserved=20).groupBy(F.col("finish_reason").alias("finish")).agg(F.count("*").alias("n"))


@query(w(f"SELECT line, CASE WHEN base IS NULL THEN 'skipped' WHEN length(base) + 20 > 1400 THEN 'context_budget_exceeded' WHEN line % 7 = 0 THEN 'generation_length' END AS skip_reason, CASE WHEN {_FINISH} = 'stop' THEN upper(replace(base, chr(223), 'SS')) END AS text FROM triples"))
def skip_union(spark, sf):
    return G.generate(_jobs(spark, sf), budget=1400, reserved=20).select("line", "skip_reason", "text")


@query(w("SELECT line, CASE WHEN line % 5 = 0 OR line % 7 = 0 THEN NULL ELSE human END AS corrected, CASE WHEN line % 5 = 0 THEN 'invalid_json' WHEN line % 7 = 0 THEN 'missing_string_field' END AS extraction_error FROM triples"))
def extract_response(spark, sf):
    body = F.when(F.col("line") % 5 == 0, F.lit("{broken")).when(F.col("line") % 7 == 0, F.lit('{"corrected_translation": 5}')).otherwise(F.to_json(F.struct(F.col("human").alias("corrected_translation"), F.array().cast("array<string>").alias("edits"))))
    return G.extract_response(triples(spark, sf).select("line", body.alias("raw_response"))).select("line", "corrected", "extraction_error")


@query(w("SELECT line, (line % 3 <> 0) AND base IS NOT NULL AND contains(base, 'e') AND contains(replace(base, 'e', 'E'), 'E') AND base <> replace(base, 'e', 'E') AS valid FROM triples"))
def validate_edits(spark, sf):
    t = triples(spark, sf)
    edit = F.array(F.struct(F.lit("e").alias("before"), F.lit("E").alias("after"), F.when(F.col("line") % 3 == 0, "style").otherwise("grammar").alias("category"), F.lit("r").alias("reason")))
    return t.select("line", V.edits_agree(F.col("base"), F.replace("base", F.lit("e"), F.lit("E")), edit).alias("valid"))


@query(w("SELECT line, seg FROM triples WHERE line <= 25"))
def limit_after_validation(spark, sf):
    """All rows are checked before the first 25 are taken."""
    r = _records(spark, sf)
    V.raise_first(V.violations(r, V.record_rules()))
    return r.where("line <= 25").select("line", "seg")


@query(w("SELECT line, CASE WHEN line % 2 = 0 THEN 'de' ELSE 'fr' END AS language FROM triples"))
def first_target(spark, sf):
    both = F.transform(F.when(F.col("line") % 2 == 0, F.array(F.lit("de"), F.lit("fr"))).otherwise(F.array(F.lit("fr"), F.lit("de"))), lambda x: F.create_map(F.lit("language"), x.cast("variant")))
    return triples(spark, sf).select("line", S.text_variant(F.element_at(both, 1), "language").alias("language"))


@query(w(f", sides AS (SELECT line, {TOKENS.format('base')} AS h, {TOKENS.format('human')} AS r FROM triples WHERE base IS NOT NULL), grams AS (" + " UNION ALL ".join(f"SELECT line, {n} AS n, {l} AS l, {1 - l} AS r, unnest(list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))) AS gram FROM sides" for n in range(1, 5) for c, l in (("h", 1), ("r", 0))) + "), counts AS (SELECT line, n, gram, sum(l) AS l, sum(r) AS r FROM grams GROUP BY line, n, gram) SELECT n, sum(least(l, r))::BIGINT AS matched, sum(l)::BIGINT AS left_total, sum(r)::BIGINT AS right_total FROM counts GROUP BY n"))
def bleu_corpus(spark, sf):
    pairs = triples(spark, sf).where("base is not null").select("line", X.tokens(F.col("base")).alias("h"), X.tokens(F.col("human")).alias("r"))
    return metrics.ngram_matches(pairs, "h", "r", range(1, 5))


@query(w(", sides AS (SELECT line, string_split(replace(replace(base, ' ', ''), chr(10), ''), '') AS h, string_split(replace(replace(human, ' ', ''), chr(10), ''), '') AS r FROM triples WHERE base IS NOT NULL), grams AS (" + " UNION ALL ".join(f"SELECT line, {n} AS n, {l} AS l, {1 - l} AS r, unnest(list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))) AS gram FROM sides" for n in range(1, 7) for c, l in (("h", 1), ("r", 0))) + "), counts AS (SELECT line, n, gram, sum(l) AS l, sum(r) AS r FROM grams GROUP BY line, n, gram) SELECT n, sum(least(l, r))::BIGINT AS matched, sum(l)::BIGINT AS left_total, sum(r)::BIGINT AS right_total FROM counts GROUP BY n"))
def chrf_corpus(spark, sf):
    chars = lambda c: F.filter(F.split(F.translate(c, " \n", ""), ""), lambda x: x != "")
    return metrics.ngram_matches(triples(spark, sf).where("base is not null").select("line", chars("base").alias("h"), chars("human").alias("r")), "h", "r", range(1, 7))


_DIFF = "SELECT line AS pos, (length(corrected) - length(base)) / length(seg) AS diff FROM triples WHERE base IS NOT NULL AND corrected IS NOT NULL AND length(seg) > 0"


def _diffs(spark, sf):
    return triples(spark, sf).where("base is not null and corrected is not null and length(seg) > 0").select(F.col("line").alias("pos"), ((F.length("corrected") - F.length("base")) / F.length("seg")).alias("diff"))


@query(w(f"SELECT count(*) FILTER (WHERE diff > 0) AS wins, count(*) FILTER (WHERE diff < 0) AS losses, count(*) FILTER (WHERE diff = 0) AS ties, round(avg(diff), 9) AS mean_diff FROM ({_DIFF})"))
def win_loss_tie(spark, sf):
    return C.win_loss(_diffs(spark, sf)).withColumn("mean_diff", F.round("mean_diff", 9))


@query()
def bootstrap_ci(spark, sf):
    return C.paired_bootstrap(_diffs(spark, sf), 20_000)


@query()
def bootstrap_poisson(spark, sf):
    return C.poisson_bootstrap(_diffs(spark, sf), 20_000)


_A, _B = "length(seg)::DOUBLE", "(length(human) - length(base) % 7)::DOUBLE"


def _systems(spark, sf):
    t = triples(spark, sf).where("base is not null").select((F.col("line") - 1).alias("pos"), F.col("seg").alias("src"), F.lit(True).alias("has_ref"), F.col("human").alias("ref"), "base")
    scored = lambda c: t.select("pos", "src", "has_ref", "ref", c.cast("double").alias("score"))
    return scored(F.length("src")), scored(F.length("ref") - F.length("base") % 7)


@query(w(f"SELECT line - 1 AS pos, {_A} AS a, {_B} AS b FROM triples WHERE base IS NOT NULL"))
def score_alignment(spark, sf):
    return A.align_scores(*_systems(spark, sf)).select("pos", "a", "b")


@query(w(f"SELECT count(*) AS sentences, round(avg({_A}), 9) AS system_a, round(avg({_B}), 9) AS system_b, round(avg({_B} - {_A}), 9) AS difference, count(*) FILTER (WHERE {_B} > {_A}) AS b_better, count(*) FILTER (WHERE {_B} < {_A}) AS a_better, count(*) FILTER (WHERE {_B} = {_A}) AS ties FROM triples WHERE base IS NOT NULL"))
def compare_systems(spark, sf):
    """Without the interval, whose draws have no SQL; bootstrap_ci has it."""
    c = C.compare_systems(*_systems(spark, sf)).drop("low", "high", "significant")
    return c.select("sentences", "b_better", "a_better", "ties", *[F.round(n, 9).alias(n) for n in ("system_a", "system_b", "difference")])


@query("SELECT p_brand AS run, max(p_size)::INT AS best, arg_min(p_partkey, (-p_size, p_partkey)) AS step FROM part GROUP BY p_brand")
def best_checkpoint(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.groupBy(F.col("p_brand").alias("run")).agg(F.max("p_size").cast("int").alias("best"), F.min_by("p_partkey", F.struct(-F.col("p_size"), F.col("p_partkey"))).alias("step"))


@query("SELECT p_brand AS run, p_partkey AS step, coalesce(p_size > max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improves FROM part")
def running_best(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("step"), F.col("p_size").alias("score"))
    return C.best_checkpoints(p).select("run", "step", "improves")


@query("SELECT s_nationkey AS partition, s_suppkey AS job_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS position FROM supplier")
def queue_rank(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("partition"), F.col("s_suppkey").alias("job_id"), F.col("s_acctbal").alias("priority"))
    return C.queue_ranks(s).select("partition", "job_id", "position")


@query()
def file_digest(spark, sf):
    return S.file_digests(spark, f"{sf}/region.parquet")


_FOLD = r"lower(replace(regexp_replace({0}, '\p{{P}}', ' ', 'g'), chr(223), 'ss'))"


@query(w(f"SELECT line, array_to_string({TOKENS.format(_FOLD.format('seg'))}, ' ') AS tokens FROM triples"))
def tokenize_casefold(spark, sf):
    return triples(spark, sf).select("line", F.array_join(X.folded_tokens(F.col("seg")), " ").alias("tokens"))


@query()  # no SQL: gestalt matching
def edit_fraction(spark, sf):
    return triples(spark, sf).select("line", X.edit_fraction(F.col("base"), F.col("corrected")).alias("fraction"))


@query()
def large_edit_flags(spark, sf):
    return triples(spark, sf).withColumn("fraction", X.edit_fraction(F.col("base"), F.col("corrected"))).select("line", (F.col("fraction") > 0.30).alias("large_edit"))


def _token_pairs(spark, sf):
    t = triples(spark, sf).where("base is not null and corrected is not null")
    return t.select("line", F.lit("fr").alias("language"), X.tokens(F.col("base")).alias("left"), X.tokens(F.col("corrected")).alias("right"))


_SIDES = "(SELECT * FROM triples WHERE base IS NOT NULL AND corrected IS NOT NULL)"


@query(w(f"SELECT count(*) AS sentences, count(*) AS pairs, sum(len(l))::BIGINT AS left_tokens, sum(len(r))::BIGINT AS right_tokens, count(*) FILTER (WHERE l = r) AS equal_lines, round(100 * count(*) FILTER (WHERE l = r) / count(*), 9) AS line_percent FROM (SELECT {TOKENS.format(_FOLD.format('base'))} AS l, {TOKENS.format(_FOLD.format('corrected'))} AS r FROM {_SIDES})"))
def compare_casefold(spark, sf):
    """Agreement without case and punctuation; the tokens in equal stretches have no SQL."""
    t = triples(spark, sf).where("base is not null and corrected is not null")
    side = lambda c: t.select("line", F.lit("en").alias("language"), "seg", F.lit("fr").alias("target_language"), F.col(c).alias("text"))
    c = C.compare_translations(side("base"), side("corrected"), ignore_case_punct=True)
    return c.select("sentences", "pairs", "left_tokens", "right_tokens", "equal_lines", F.round("line_percent", 9).alias("line_percent"))


@query()
def matching_blocks(spark, sf):
    return _token_pairs(spark, sf).select("line", X.alignment(F.col("left"), F.col("right"))["equal"].alias("equal_tokens"))


@query()
def compare_stats(spark, sf):
    return C.agreement(_token_pairs(spark, sf))


@query()
def postedit_stats(spark, sf):
    t = triples(spark, sf).where("base is not null").withColumn("finish_reason", F.when(F.col("line") % 7 == 0, "length").otherwise("stop"))
    return C.post_edit_stats(t)


@query(w("SELECT count(*) AS src, count(human) AS ref, count(base) AS hyp FROM triples"))
def line_parity(spark, sf):
    return triples(spark, sf).agg(F.count("*").alias("src"), F.count("human").alias("ref"), F.count("base").alias("hyp"))


@query(w("SELECT line, trim(regexp_replace(human, '\n', ' ', 'g')) AS hyp FROM triples"))
def hypothesis_lines(spark, sf):
    return triples(spark, sf).select("line", X.one_line(F.col("human")).alias("hyp"))


@query(w("SELECT line, base AS text, length(base) AS n FROM triples"))
def memo_scores(spark, sf):
    scorer = lambda d: d.withColumn("n", F.length("text").cast("long"))
    return A.score_distinct(triples(spark, sf).select("line", F.col("base").alias("text")), "text", scorer).select("line", "text", "n")


@query(w("SELECT count(*) FILTER (WHERE human IS NULL) AS without, (count(*) FILTER (WHERE corrected IS NULL) IN (0, count(*))) AS all_or_none FROM triples"))
def reference_coverage(spark, sf):
    return triples(spark, sf).agg(F.count_if(F.col("human").isNull()).alias("without"), F.count_if(F.col("corrected").isNull()).isin(F.lit(0), F.count("*")).alias("all_or_none"))


@query(w("SELECT count(*) FILTER (WHERE line % 7 = 0 AND base IS NOT NULL) AS token_limit_hits, count(*) FILTER (WHERE base IS NULL) AS skipped FROM triples"))
def generation_counts(spark, sf):
    g = G.generate(_jobs(spark, sf))
    return g.agg(F.count_if(F.col("finish_reason") == "length").alias("token_limit_hits"), F.count_if(F.col("skip_reason") == "skipped").alias("skipped"))


@query(w("SELECT line, 'Translate to French: ' || seg AS prompt FROM triples"))
def prompt_payload(spark, sf):
    template = "Translate to {target_language}: "
    return triples(spark, sf).select("line", F.concat(F.replace(F.lit(template), F.lit("{target_language}"), F.lit("French")), "seg").alias("prompt"))


@query(w("SELECT * FROM (SELECT line, CASE WHEN line % 29 = 0 THEN 'malformed' WHEN line % 31 = 0 THEN 'not_object' WHEN line % 37 = 0 THEN 'language' WHEN line % 41 = 0 THEN 'seg' WHEN line % 43 = 0 THEN 'tgts' END AS code FROM triples) WHERE code IS NOT NULL"))
def record_violations(spark, sf):
    """The first violation of every bad line."""
    k = lambda n: F.col("line") % n == 0
    value = F.when(k(29), F.lit("{broken")).when(k(31), F.lit("[1]")).when(k(37), F.lit('{"language": 5, "seg": "x", "tgts": [{"language": "fr"}]}')).when(k(41), F.lit('{"language": "en", "seg": " ", "tgts": [{"language": "fr"}]}')).when(k(43), F.lit('{"language": "en", "seg": "x", "tgts": []}')).otherwise(F.col("value"))
    r = S.parse_records(_record_lines(triples(spark, sf)).select("line", value.alias("value")))
    return V.violations(r, V.record_rules()).groupBy("line").agg(F.min_by("code", "rank").alias("code"))


@query(w("SELECT * FROM (SELECT line, CASE WHEN base IS NULL AND line % 3 = 0 THEN 'base' WHEN line % 3 <> 0 AND base IS NOT NULL AND trim(base) = '' THEN 'base' WHEN trim(human) = '' THEN 'human' END AS code FROM triples) WHERE code IS NOT NULL"))
def target_violations(spark, sf):
    """A null is allowed under the name base only, so those of lines with the older name are violations."""
    return V.violations(_records(spark, sf), V.base_rules() | V.human_rules() | V.embedded_rules()).groupBy("line").agg(F.min_by("code", "rank").alias("code"))


_MISSING = "line % 3 = 0 OR base IS NULL OR trim(base) = '' OR line % 2 = 1 OR corrected IS NULL OR trim(corrected) = '' OR trim(seg) = ''"


@query(w(f"SELECT line, seg AS src, CASE WHEN line % 2 = 0 THEN corrected END AS tgt, CASE WHEN line % 3 <> 0 THEN base END AS reject, CASE WHEN {_MISSING} THEN 'missing_or_empty' WHEN regexp_matches(seg || corrected || base, '[\\t\\r\\n]') THEN 'tsv_control_characters' END AS reason FROM triples".replace("\\\\", "\\")))
def extract_selected(spark, sf):
    return P.extract(_records(spark, sf), Selection("seg", "tgts.corrected", "tgts.base"), tsv=True)


@query(w("SELECT line, seg AS src, human AS tgt, length(seg) + 2 AS n_ids FROM triples WHERE length(seg) + 2 + 100 <= 600"))
def prepare_input_rows(spark, sf):
    t = triples(spark, sf)
    rows = t.select("line", F.col("seg").alias("src"), F.col("base").alias("tgt"), F.col("base").isNotNull().alias("has_tgt"))
    kept, _, _ = P.input_rows(rows, Evaluation(600, 100), t.select("line", F.col("human").alias("text")))
    return kept.select("line", "src", "tgt", F.size("input_ids").cast("long").alias("n_ids"))


@query(w("SELECT line, 'generation_context_budget' AS reason FROM triples WHERE length(seg) + 2 + 100 > 600"))
def prepare_input_excluded(spark, sf):
    rows = triples(spark, sf).select("line", F.col("seg").alias("src"), F.col("human").alias("tgt"), F.lit(True).alias("has_tgt"))
    return P.input_rows(rows, Evaluation(600, 100))[1]


@query(w("SELECT line, 'fr' AS language, base AS l_text, human AS r_text FROM triples UNION ALL SELECT line, 'de', seg, corrected FROM triples WHERE line % 3 = 0"))
def target_join(spark, sf):
    t = triples(spark, sf)
    side = lambda a, b, extra: t.select("line", F.lit("fr").alias("language"), F.col(a).alias("text")).unionByName(t.where(extra).select("line", F.lit("de").alias("language"), F.col(b).alias("text")))
    return T.join_targets(side("base", "seg", "line % 3 = 0"), side("human", "corrected", "true"))


@query(w("SELECT line, seg AS src, trim(translate(upper(replace(seg, chr(223), 'SS')), chr(10) || chr(13), '  ')) AS mt, human AS ref FROM triples"))
def hypothesis_join(spark, sf):
    """Rows, decoded with the stand-in model, and references, as a metric takes them."""
    rows = triples(spark, sf).select("line", F.regexp_replace("seg", "[\n\r]", " ").alias("src"), F.col("human").alias("tgt"), F.col("seg").alias("own"))
    decoded = E.decode(rows)
    return A.with_hypotheses(rows.withColumn("src", F.col("own")), decoded)


@query(w("SELECT round(avg(1 - abs(length(seg) - length(human)) / greatest(length(seg), length(human), 1)), 9) AS system_score FROM triples"))
def learned_system_score(spark, sf):
    rows = triples(spark, sf).select("line", F.col("base").alias("src"), F.col("seg").alias("mt"), F.col("human").alias("ref"))
    return E.system_score(E.learned_scores(rows)).select(F.round("system_score", 9).alias("system_score"))


_NESTED = "(' ' || coalesce({0}, '') || ' ')"
for _pattern, _by in metrics.RULES_13A:
    _NESTED = f"regexp_replace({_NESTED}, '{_pattern}', '{_by.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
_CUT = lambda c: "regexp_extract_all(" + _NESTED.replace("{0}", c) + r", '[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]+')"
_LETTERS = lambda c: r"regexp_extract_all(coalesce(" + c + r", ''), '[^\x09-\x0d\x1c-\x20\x{85}\p{Z}]')"


def _gram_sql(name: str, cut, top: int) -> str:
    grams = " UNION ALL ".join(f"SELECT line, {n} AS n, {l} AS l, {1 - l} AS r, unnest(list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n - 1}], chr(1)))) AS gram FROM {name}_sides" for n in range(1, top + 1) for c, l in (("h", 1), ("r", 0)))
    return f"{name}_sides AS (SELECT line, {cut('base')} AS h, {cut('human')} AS r FROM triples WHERE base IS NOT NULL), {name}_grams AS ({grams}), {name} AS (SELECT n, sum(least(l, r)) AS m, sum(l) AS h, sum(r) AS t FROM (SELECT line, n, gram, sum(l) AS l, sum(r) AS r FROM {name}_grams GROUP BY ALL) GROUP BY n)"


@query(w(f", {_gram_sql('words', _CUT, 4)}, {_gram_sql('letters', _LETTERS, 6)}, p AS (SELECT avg(m / h) AS p, avg(m / t) AS r FROM letters) SELECT round(100 * (SELECT CASE WHEN h >= t THEN 1 ELSE exp(1 - t / h) END FROM words WHERE n = 1) * (SELECT exp(avg(ln(m / h))) FROM words), 6) AS bleu, (SELECT round(100 * 5 * p * r / (4 * p + r), 6) FROM p) AS chrf"))
def corpus_scores(spark, sf):
    """BLEU over 13a words and chrF. (The SQL has no smoothing: every order has a match here.)"""
    rows = triples(spark, sf).where("base is not null").select(F.col("base").alias("hyp"), F.col("human").alias("ref"))
    return metrics.corpus_scores(rows).select(*[F.round(c, 6).alias(c) for c in ("bleu", "chrf")])


_STATUS = "CASE WHEN {0} IS NULL OR trim({0}) = '' THEN 'missing_or_empty' WHEN length(seg) + 2 + length({0}) > 1400 THEN 'context_budget_exceeded' ELSE 'ok' END"
_NLL = "CASE WHEN {0}_status = 'ok' THEN (0.5 * length({0}) + 0.25 * (length({0}) - length(translate({0}, 'aeiou', '')))) / length({0}) END"


def _inspected(spark, sf):
    t = triples(spark, sf).select("line", F.lit("en").alias("source_language"), F.col("seg").alias("source"), F.lit("fr").alias("target_language"), *VARIANTS)
    return I.inspect(t, Inspection(max_length=1400))


@query(
    WORDS_SQL
    + ", s AS (SELECT *, "
    + ", ".join(f"{_STATUS.format(v)} AS {v}_status" for v in VARIANTS)
    + " FROM triples), n AS (SELECT *, "
    + ", ".join(f"{_NLL.format(v)} AS {v}_nll" for v in VARIANTS)
    + " FROM s), e AS (SELECT line, "
    + ", ".join(f"max({u}_distance) FILTER (WHERE pair = '{p}')::BIGINT AS {p}_{n}_distance" for p in _FLAT for u, n in (("char", "character"), ("word", "word")))
    + " FROM edits GROUP BY line) SELECT line, seg AS source, "
    + ", ".join(f"{v}_status, round({v}_nll, 9) AS {v}_nll" for v in VARIANTS)
    + ", round(human_nll - base_nll, 9) AS nll_human_minus_base, round(corrected_nll - human_nll, 9) AS nll_corrected_minus_human, e.* EXCLUDE (line) FROM n LEFT JOIN e USING (line)"
)
def inspect_flat(spark, sf):
    f = I.flatten(_inspected(spark, sf))
    rounded = [F.round(c, 9).alias(c) for c in (*[f"{v}_nll" for v in VARIANTS], "nll_human_minus_base", "nll_corrected_minus_human")]
    return f.select("line", "source", *[f"{v}_status" for v in VARIANTS], *rounded, *[F.col(f"{p}_{n}_distance").cast("long").alias(f"{p}_{n}_distance") for p in _FLAT for n in I.UNITS])


@query(w("SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_filter([s_nationkey % 5, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 END], lambda x: x IS NOT NULL))), ',') AS stops FROM supplier"))
def stop_ids(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    stops = R.stop_ids(F.col("s_nationkey") % 5, F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 3))
    return s.select("s_suppkey", F.array_join(stops.cast("array<string>"), ",").alias("stops"))


_PAYLOAD = "json_object('source_language', 'en', 'target_language', 'fr', 'source', seg, 'student_translation', base{0})::VARCHAR"


@query(w(f"SELECT line, CASE WHEN line % 2 = 0 THEN {_PAYLOAD.format(', ' + chr(39) + 'human_reference' + chr(39) + ', human')} ELSE {_PAYLOAD.format('')} END AS payload FROM triples WHERE base IS NOT NULL"))
def teacher_payload(spark, sf):
    t = triples(spark, sf).where("base is not null")
    made = G.chat_payload(F.lit("en"), F.lit("fr"), F.col("seg"), F.col("base"), F.when(F.col("line") % 2 == 0, F.col("human")), "Correct it.")
    messages = F.from_json(made, "array<struct<role: string, content: string>>")
    return t.select("line", messages[1]["content"].alias("payload"))


@query(w("SELECT line, CASE WHEN base IS NOT NULL AND line % 5 <> 0 THEN human END AS corrected, CASE WHEN base IS NULL THEN 'base translation unavailable' WHEN line % 5 = 0 THEN 'invalid_json' END AS extraction_error, CASE WHEN base IS NULL THEN 'skipped' ELSE 'stop' END AS finish_reason FROM triples"))
def postedit_audit(spark, sf):
    t = triples(spark, sf)
    answers = t.select("line", F.lit("fr").alias("language"), F.when(F.col("base").isNull(), F.lit(None)).when(F.col("line") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("human").alias("corrected_translation")))).alias("raw_response"), F.when(F.col("base").isNull(), "skipped").otherwise("stop").alias("finish_reason"), F.when(F.col("base").isNull(), "skipped").alias("skip_reason"))
    pairs = t.select("line", F.lit("en").alias("language"), "seg", F.lit(0).alias("pos"), F.lit("fr").alias("target_language"), "base", F.lit(None).cast("string").alias("human"))
    return G.corrections(pairs, answers, 0.3).select("line", "corrected", "extraction_error", "finish_reason")


@query(w("SELECT count(DISTINCT line) AS source_lines, count(*) AS pairs, count(*) FILTER (WHERE base <> corrected) AS changed, count(*) FILTER (WHERE base = corrected) AS unchanged, round(100 * count(*) FILTER (WHERE base <> corrected) / count(corrected), 9) AS changed_percent, count(*) - count(corrected) AS missing, count(*) FILTER (WHERE line % 7 = 0) AS non_stop FROM triples WHERE base IS NOT NULL"))
def postedit_counts(spark, sf):
    """What of postedit_stats has SQL: all but the edit fractions."""
    return postedit_stats(spark, sf).select("source_lines", "pairs", "changed", "unchanged", F.round("changed_percent", 9).alias("changed_percent"), "missing", "non_stop")
