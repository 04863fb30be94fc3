"""A bitext surrogate: user and assistant turns as source, base, human and corrected texts, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import with_char_distances, with_distances
from ..sources.records import number_lines

VARIANTS = ("base", "human", "corrected")
PAIRS = (("base", "human"), ("base", "corrected"), ("human", "corrected"))

SQL = r"""triples AS (
  SELECT row_number() OVER (ORDER BY conv_id, turn) AS line, conv_id, seg, CASE WHEN conv_id % 11 = 0 THEN NULL ELSE b0 END AS base,
         regexp_replace(b0, '\b[tT]h[a-z]*\b', 'zz', 'g') AS human,
         CASE conv_id % 4 WHEN 0 THEN b0 WHEN 1 THEN regexp_replace(b0, '[.]', '!', 'g') WHEN 2 THEN NULL ELSE regexp_replace(b0, '^[A-Za-z]+ ', '', 'g') END AS corrected
  FROM (SELECT u.conv_id, u.turn, u.text AS seg, a.text AS b0 FROM conversations u JOIN conversations a
        ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'))"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, conv_id, seg, base, human, corrected)."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("seg"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b0"))
    t = number_lines(u.join(a, ["conv_id", "turn"]), ["conv_id", "turn"])
    b0, k = F.col("b0"), F.col("conv_id") % 4
    corrected = F.when(k == 0, b0).when(k == 1, F.regexp_replace(b0, "[.]", "!")).when(k == 3, F.regexp_replace(b0, "^[A-Za-z]+ ", ""))
    return t.select("line", "conv_id", "seg", F.when(F.col("conv_id") % 11 != 0, b0).alias("base"), F.regexp_replace(b0, r"\b[tT]h[a-z]*\b", "zz").alias("human"), corrected.alias("corrected"))


def pair_rows(t: DataFrame) -> DataFrame:
    """(line, pair, a, b) of the three pairs."""
    made = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in PAIRS])
    return t.select("line", F.explode(made).alias("p")).select("line", "p.*")


def pair_distances(t: DataFrame, measure=with_distances) -> DataFrame:
    """(line, pair, distances) where both texts are not blank."""
    return measure(pair_rows(t).where("trim(a) <> '' and trim(b) <> ''")).drop("a", "b")


def char_distances(t: DataFrame) -> DataFrame:
    """pair_distances of characters alone."""
    return pair_distances(t, with_char_distances)


TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\x09-\x0d\x1c-\x20\x{{85}}\p{{Z}}]')"
_ENC = "coalesce(list_aggregate(list_transform({0}, lambda z: chr(list_position(abc, z)::int)), 'string_agg', ''), '')"


def _distance(a: str, b: str) -> str:
    return f"levenshtein({_ENC.format(a)}, {_ENC.format(b)})"


DISTANCE_SQL = (
    f"WITH {SQL}, pairs AS ("
    + " UNION ALL ".join(f"SELECT line, '{a}_vs_{b}' AS pair, {a} AS a, {b} AS b FROM triples" for a, b in PAIRS)
    + f"), lists AS (SELECT line, pair, a, b, string_split(a, '') AS ca, string_split(b, '') AS cb, list_sort(list_distinct(string_split(a, '') || string_split(b, ''))) AS abc FROM pairs WHERE trim(a) <> '' AND trim(b) <> ''),"
    + f" measured AS (SELECT line, pair, a = b AS identical, {_distance('ca', 'cb')} AS char_distance, greatest(len(ca), len(cb)) AS char_length FROM lists),"
    + " distances AS (SELECT *, CASE WHEN char_length > 0 THEN char_distance / char_length ELSE 0 END AS char_normalized FROM measured)"
)

#: Word distances by the textbook recurrence, a row of the table a step: `cells` is the row of the first i words of a.
WORDS_SQL = (
    DISTANCE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", words AS (SELECT line, pair, {TOKENS.format('a')} AS wa, {TOKENS.format('b')} AS wb FROM lists),"
    + " steps AS (SELECT line, pair, wa, wb, 0::BIGINT AS i, range(0, len(wb) + 1) AS cells FROM words UNION ALL"
    + " SELECT line, pair, wa, wb, i + 1, list_reduce(range(1, len(wb) + 1), lambda acc, j: list_append(acc, least(acc[j] + 1, cells[j + 1] + 1, cells[j] + CASE WHEN wa[i + 1] = wb[j] THEN 0 ELSE 1 END)), [i + 1]) FROM steps WHERE i < len(wa)),"
    + " ended AS (SELECT line, pair, cells[len(cells)]::BIGINT AS word_distance, greatest(len(wa), len(wb)) AS word_length FROM steps WHERE i = len(wa)),"
    + " edits AS (SELECT d.*, word_distance, word_length, CASE WHEN word_length > 0 THEN word_distance / word_length ELSE 0 END AS word_normalized FROM distances d JOIN ended USING (line, pair))"
)


def stand_in_scores(t: DataFrame) -> DataFrame:
    """(line, variant, status, tokens, total_logprob, nll, perplexity): a scorer without a model, code points as tokens."""
    made = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("text")) for v in VARIANTS])
    rows = t.select("line", F.explode(made).alias("x")).select("line", "x.*")
    n = F.length("text")
    status = F.when(F.col("text").isNull() | (F.trim("text") == ""), "missing_or_empty").when(n > 1400, "context_budget_exceeded").otherwise("ok")
    vowels = n - F.length(F.translate("text", "aeiou", ""))
    ok = F.col("status") == "ok"
    rows = rows.withColumn("status", status).withColumn("tokens", F.when(ok, n)).withColumn("total_logprob", F.when(ok, -(0.5 * n + 0.25 * vowels)))
    rows = rows.withColumn("nll", -F.col("total_logprob") / F.col("tokens"))
    return rows.withColumn("perplexity", F.exp("nll")).drop("text")


SCORES_SQL = (
    f"WITH {SQL}, variants AS ("
    + " UNION ALL ".join(f"SELECT line, '{v}' AS variant, {v} AS text FROM triples" for v in VARIANTS)
    + "), marked AS (SELECT *, CASE WHEN text IS NULL OR trim(text) = '' THEN 'missing_or_empty' WHEN length(text) > 1400 THEN 'context_budget_exceeded' ELSE 'ok' END AS status FROM variants),"
    + " counted AS (SELECT line, variant, status, CASE WHEN status = 'ok' THEN length(text) END AS tokens, CASE WHEN status = 'ok' THEN -(0.5 * length(text) + 0.25 * (length(text) - length(translate(text, 'aeiou', ''))))::DOUBLE END AS total_logprob FROM marked),"
    + " scores AS (SELECT *, -total_logprob / tokens AS nll, exp(-total_logprob / tokens) AS perplexity FROM counted),"
    + " complete AS (SELECT line FROM scores GROUP BY line HAVING bool_and(status = 'ok'))"
)
