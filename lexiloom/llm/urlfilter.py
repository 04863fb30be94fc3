"""URL filter: host and path rules, and below them a ratio of two character language models, in DataFrame functions only.

URLs that a rule decides train the models: one for accepted, one for rejected. Each is a variable-order Markov model over a fixed alphabet of
64 symbols: the probability of a symbol after two others is the Witten-Bell mixture of orders 2, 1 and 0 over a uniform floor. A URL's score is the
mean over its symbols of log(accepted / rejected); it is blocked below a threshold that best separates URLs kept from the models' training, a
fifth of those that a rule decides, by hash (the mean of the two class rates of errors, over a histogram of scores, is least there; ties:
nearest to zero; zero where that fifth lacks a class).

The model is one array of 64^3 log ratios (2 MB at most, whatever the input), made by aggregations of at most 64^3 groups a class and read
as a scalar; scoring is an expression over the URL's own symbols, without a join or shuffle.

Rules: a rule fits its host and all subdomains if the path starts with the rule's path; the longest rule (host and path together) wins.
Null URLs and URLs without "://" have empty host and path, no rule, and the method's verdict on the text that there is. Without URLs of both
kinds to learn from, the ratio is 0 for all and what no rule decides is allowed. Repeated rows are each judged; an empty table gives an empty
result; very long URLs are scored whole. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize

#: Fixed values: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/:.-_?=&%#~+@!,;"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS, START = 64, 63


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string or null, its verdict or null); longer rules are tried first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    """Symbol numbers of a URL: 1.. in ALPHABET, 0 for others; two starts go before."""
    each = F.filter(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), ""), lambda c: c != "")
    return F.concat(F.array(F.lit(START), F.lit(START)), F.transform(each, lambda c: F.instr(F.lit(ALPHABET), c)))


def triples(syms: str) -> Column:
    """Codes (a*64 + b)*64 + c of all three neighbouring symbols."""
    at = F.col(syms)
    code = lambda i: (F.get(at, i - 2) * SYMBOLS + F.get(at, i - 1)) * SYMBOLS + F.get(at, i)
    return F.when(F.size(at) > 2, F.transform(F.sequence(F.lit(2), F.size(at) - 1), code)).otherwise(F.array().cast("array<int>"))


def log_ratios(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """counts: (cls, code, n), cls 1 accepted and 0 rejected. One row: array of 64^3 log ratios, by code. Every table here has at most 2 * 64^3 rows."""
    c = counts.select("cls", "n", F.floor(F.col("code") / SYMBOLS**2).cast("int").alias("a"), F.pmod(F.floor(F.col("code") / SYMBOLS), F.lit(SYMBOLS)).cast("int").alias("b"), F.pmod(F.col("code"), F.lit(SYMBOLS)).cast("int").alias("c"))
    bc = c.groupBy("cls", "b", "c").agg(F.sum("n").alias("n_bc"))
    one = bc.groupBy("cls", "c").agg(F.sum("n_bc").alias("n_c"))
    all_ = one.groupBy("cls").agg(F.sum("n_c").alias("n_0"), F.count("*").alias("t_0"))
    b = bc.groupBy("cls", "b").agg(F.sum("n_bc").alias("n_b"), F.count("*").alias("t_b"))
    ab = c.groupBy("cls", "a", "b").agg(F.sum("n").alias("n_ab"), F.count("*").alias("t_ab"))
    every = spark.range(2 * SYMBOLS**3, numPartitions=1).select(F.floor(F.col("id") / SYMBOLS**3).cast("int").alias("cls"), F.pmod("id", F.lit(SYMBOLS**3)).cast("int").alias("code"))
    every = every.select("cls", "code", F.floor(F.col("code") / SYMBOLS**2).cast("int").alias("a"), F.pmod(F.floor(F.col("code") / SYMBOLS), F.lit(SYMBOLS)).cast("int").alias("b"), F.pmod(F.col("code"), F.lit(SYMBOLS)).cast("int").alias("c"))
    for part, keys in ((all_, ["cls"]), (one, ["cls", "c"]), (b, ["cls", "b"]), (bc, ["cls", "b", "c"]), (ab, ["cls", "a", "b"]), (c.withColumnRenamed("n", "n_abc"), ["cls", "a", "b", "c"])):
        every = every.join(part, keys, "left")
    f = every.fillna(0)

    def mixed(n: str, total: str, kinds: str, below: Column) -> Column:
        return F.when(F.col(total) + F.col(kinds) > 0, (F.col(n) + F.col(kinds) * below) / (F.col(total) + F.col(kinds))).otherwise(below)

    f = f.withColumn("p_1", mixed("n_c", "n_0", "t_0", F.lit(1.0 / SYMBOLS)))
    f = f.withColumn("p_2", mixed("n_bc", "n_b", "t_b", F.col("p_1")))
    f = f.withColumn("p_3", mixed("n_abc", "n_ab", "t_ab", F.col("p_2")))
    ratio = f.groupBy("code").agg(F.sum(F.log("p_3") * F.when(F.col("cls") == 1, 1.0).otherwise(-1.0)).alias("llr"))
    return ratio.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "llr"))), lambda x: x["llr"]).alias("model"))


def with_score(coded: DataFrame, model: DataFrame) -> DataFrame:
    """Add `score`, the mean log ratio of `codes`. The scalar column is named once, so it is folded into the expression and never copied into rows."""
    total = F.aggregate("codes", F.lit(0.0), lambda acc, x: acc + F.get(F.col("model"), x))
    return coded.withColumn("model", model.scalar()).withColumn("score", F.when(F.size("codes") > 0, total / F.size("codes")).otherwise(F.lit(0.0))).drop("model")


def best_threshold(histogram: list[tuple[int, int, int]], width: float) -> float:
    """histogram: (bin, accepted, rejected). The lower edge of a bin below which blocking makes the least mean error rate."""
    accepted, rejected = sum(x[1] for x in histogram), sum(x[2] for x in histogram)
    if not accepted or not rejected:
        return 0.0
    lost, best = [0, 0], []
    for bin_, a, r in sorted(histogram):
        best.append((lost[0] / accepted + 1 - lost[1] / rejected, abs(bin_ * width), bin_ * width))
        lost = [lost[0] + a, lost[1] + r]
    return min(best)[2]


def judge_urls(pages: DataFrame, rules=RULES, bin_width: float = 0.005) -> DataFrame:
    """page_id, host, path, rule, verdict, score (mean log ratio) of every row."""
    spark = pages.sparkSession
    base = pages.select("page_id", "url")
    base = base.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))
    name, ruled = rule_of(F.col("host"), F.col("path"), rules)
    coded = base.select("page_id", "host", "path", name.alias("rule"), ruled.alias("ruled"), symbols(F.col("url")).alias("syms"))
    # Written once: it is read three times, and the scalar model folds only into an expression whose other inputs are stored columns.
    coded = materialize(coded.select("page_id", "host", "path", "rule", "ruled", triples("syms").alias("codes")), "url-codes")
    labelled = coded.where("ruled is not null").select(F.when(F.col("ruled") == "allow", 1).otherwise(0).alias("cls"), "codes")
    kept = F.pmod(F.xxhash64("codes"), F.lit(5)) == 0
    counts = materialize(labelled.where(~kept).select("cls", F.explode("codes").alias("code")).groupBy("cls", "code").agg(F.count("*").alias("n")), "url-counts")
    both = counts.agg(F.countDistinct("cls")).first()[0] == 2
    model = materialize(log_ratios(spark, counts), "url-model")
    bins = with_score(labelled.where(kept), model).select("cls", F.floor(F.col("score") / bin_width).cast("int").alias("bin")).groupBy("bin").agg(F.sum("cls").alias("a"), F.sum(1 - F.col("cls")).alias("r"))
    threshold = best_threshold([tuple(x) for x in bins.collect()], bin_width) if both else float("-inf")
    scored = with_score(coded, model) if both else coded.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
