import gzip
import json
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import metrics, text as X
from lexiloom.operators import align as A, compare as C, targets as T, training as R, validate as V
from lexiloom.sources import records as S
from lexiloom.streaming import generate as G


def lines(spark, *objects):
    return spark.createDataFrame([(i, o if isinstance(o, str) else json.dumps(o, ensure_ascii=False)) for i, o in enumerate(objects, 1)], "line long, value string")


def record(**target):
    return {"language": "en", "seg": "Hello.", "tgts": [{"language": "fr", **target}]}


def test_alias_by_presence(spark):
    rows = T.explode_targets(S.parse_records(lines(spark, record(seg="Bonjour."), record(base=None, human="Trop long."), record(student="  Bonjour\nmonde. \t\r\n", human_reference="R.\n")))).orderBy("line").collect()
    assert [(r.base, r.human) for r in rows] == [("Bonjour.", "Bonjour."), (None, "Trop long."), ("  Bonjour\nmonde.", "R.\n")]


@pytest.mark.parametrize("key", ["seg", "student", "human_reference", "base", "human", "corrected"])
def test_compare_reads_every_alias(spark, key):
    t = F.col("tgts")[0]
    assert S.parse_records(lines(spark, record(**{key: "x"}))).select(T.by_presence(t, T.COMPARED)).first()[0] == "x"


def test_legacy_upgrade_and_upsert(spark):
    r = S.parse_records(lines(spark, record(student="Salut.", human_reference="Bonjour.", corrected="Old.")))
    up = r.select(T.upgrade_legacy(F.col("tgts")[0]).alias("t")).select(F.map_keys("t").alias("k"), S.text_variant(F.col("t"), "human").alias("h")).first()
    assert sorted(up.k) == ["base", "corrected", "human", "language"] and up.h == "Bonjour."
    cases = [(dict(student="Salut. \n", seg="x"), {"language": "fr", "base": "Salut."}), (dict(base=None, human_reference="R.\n"), {"language": "fr", "base": None, "human": "R.\n"}), (dict(seg="S", note=3), {"language": "fr", "base": "S", "note": 3}), (dict(base="B ", human="H", human_reference="old"), {"language": "fr", "base": "B", "human": "H"})]
    for target, want in cases:
        t = S.parse_records(lines(spark, record(**target))).select(F.to_json(T.upgrade_legacy(F.col("tgts")[0]))).first()[0]
        assert json.loads(t) == want
    out = r.select(F.to_json(T.upsert(F.col("tgts"), "de", "base", F.lit(None).cast("string")))).first()[0]
    assert json.loads(out)[1] == {"language": "de", "base": None}


def test_violations_see_rows_past_a_limit(spark):
    bad = S.parse_records(lines(spark, record(base="a"), {"language": "en", "seg": " ", "tgts": [{"language": "fr"}]}, {"language": 5, "seg": "x", "tgts": []}))
    with pytest.raises(V.ValidationError, match="input line 2: missing or empty seg"):
        V.raise_first(V.violations(bad, V.record_rules()))
    assert {r.code for r in V.violations(bad.where("line = 3"), V.record_rules()).collect()} == {"language", "tgts"}


def test_tsv_is_literal(spark):
    rows = S.parse_tsv(lines(spark, '"Hello."\tBonjour.', "Invalid"), ["src", "tgt"]).orderBy("line")
    assert rows.first().src == '"Hello."'
    assert [r.code for r in V.violations(rows, V.tsv_rules(["src", "tgt"])).collect()] == ["arity"]


def test_read_formats(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Hi\tSalut\nYo\tSalut2\n")
    (tmp_path / "b.json").write_text('[{"src": "Hi", "tgt": "Salut"}]')
    (tmp_path / "c.json").write_text('{"src": "Hi", "tgt": "Salut"}\n{"src": "B", "tgt": null}\n')
    (tmp_path / "d.en").write_text("one\ntwo\n")
    read = lambda n: [(r.line, r.src, r.tgt) for r in S.read_examples(spark, str(tmp_path / n), ["src", "tgt"]).orderBy("line").collect()]
    assert read("a.tsv") == [(1, "Hi", "Salut"), (2, "Yo", "Salut2")]
    assert read("b.json") == [(1, "Hi", "Salut")]
    assert read("c.json") == [(1, "Hi", "Salut"), (2, "B", None)]
    assert read("d.en") == [(1, "one", None), (2, "two", None)]


def test_write_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "line long, seg string, base string")
    S.write_jsonl(df, str(tmp_path / "out"))
    back = S.read_lines(spark, str(tmp_path / "out")).orderBy("line").collect()
    assert [json.loads(r.value) for r in back] == [{"seg": "a", "base": "x"}, {"seg": "b", "base": None}]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_jsonl(df, str(tmp_path / "out"))


def test_alignment(spark):
    left = spark.createDataFrame([(1, "a", ["de", "fr"]), (2, "b", ["fr"]), (3, "c", ["fr"])], "line long, seg string, languages array<string>")
    right = spark.createDataFrame([(1, "a", ["de", "fr"]), (2, "X", ["fr"])], "line long, seg string, languages array<string>")
    assert [(r.line, r.code) for r in A.alignment_codes(A.align(left, right)).orderBy("line").collect()] == [(2, "source"), (3, "count")]


def test_first_gap(spark):
    j = lambda *x: A.first_gap(spark.createDataFrame([(i,) for i in x], "line long"))
    assert j(1, 2, 3) is None and j(1, 3) == 2 and j(2, 3) == 1


def test_distances(spark):
    df = spark.createDataFrame([(1, "a b c", "a x c d"), (2, "Hello.", "hello!"), (3, "é", "e"), (4, "", ""), (5, "same text", "same text")], "line long, a string, b string")
    got = {r.line: r for r in X.with_distances(df).collect()}
    assert (got[1].word_distance, got[1].word_normalized, got[1].identical) == (2, 0.5, False)
    assert got[2].word_distance == 2 and got[3].char_distance == 1 and got[4].word_normalized == 0 and (got[5].char_distance, got[5].identical, got[5].word_length) == (0, True, 2)


def peak_mb(call):
    """Python's peak memory in a call."""
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_distances_hold_few_rows_at_a_time(spark):
    """What Python makes of a batch is made of a slice of it (all of these rows: over 40 MB), and batches are bounded in bytes."""
    n, key = 4096, "spark.sql.execution.arrow.maxBytesPerBatch"
    words = [[f"w{i}_{j}" for j in range(100)] for i in range(n)]
    text, cut = pa.array([" ".join(x) for x in words]), pa.array(words)
    assert peak_mb(lambda: X._distances(text, text, cut, cut)) < 5
    got = X._distances(text, pa.array(["x" + t[1:] for t in text.to_pylist()]), cut, cut).to_pylist()
    assert got == [{"char_distance": 1, "char_length": len(" ".join(x)), "word_distance": 0, "word_length": 100} for x in words]

    spark.conf.unset(key)
    df = spark.range(12_000).select(F.repeat(F.lit("abcdefghi "), 200).alias("a"), F.lit("b").alias("b")).coalesce(1)
    X.with_distances(df)
    rows = F.arrow_udf(lambda a: pa.array([len(a)] * len(a), pa.int32()), "int")
    assert df.select(rows("a").alias("n")).agg(F.max("n")).first()[0] <= (8 << 20) / 2000 + 1


def test_alignment_holds_few_rows_at_a_time(spark):
    """As for the distances; lists of more than one slice, and null lists, keep their order."""
    n, key = 4096, "spark.sql.execution.arrow.maxBytesPerBatch"
    words = pa.array([[f"w{i}_{j}" for j in range(100)] for i in range(n)])
    assert peak_mb(lambda: X._aligned(words, pa.array([[]] * n, words.type))) < 5
    rows = [None if i % 7 == 0 else [str(j) for j in range(i % 5)] for i in range(300)]
    got = X._aligned(pa.array(rows), pa.array([["0", "x"]] * 300)).to_pylist()
    assert [(r["equal"], r["changed"]) for r in got] == [(0, 0) if x is None else (0, 2) if not x else (1, max(len(x) - 1, 1)) for x in rows]
    spark.conf.unset(key)
    X.edit_fraction(F.col("a"), F.col("b"))
    assert 0 < int(spark.conf.get(key).rstrip("b")) <= 8 << 20


def test_char_distances_cut_no_words(spark):
    from lexiloom.plans.queries import QUERIES

    out = QUERIES["char_distance"](spark, "/root/testdata/sf0.001")
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    df = spark.createDataFrame([(i, "ab " * (i % 9), "aé 😀" * (i % 7)) for i in range(300)], "line long, a string, b string")
    want = {(r.line, r.char_distance, r.char_length) for r in X.with_distances(df).collect()}
    assert {(r.line, r.char_distance, r.char_length) for r in X.with_char_distances(df).collect()} == want


def test_edit_distance_equals_recurrence():
    rand = random.Random(2)
    for _ in range(3000):
        a, b = (rand.choices("abc", k=rand.randint(0, 14)) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert X.edit_distance(a, b) == row[-1]
    assert X.edit_distance("a" * 5000 + "b" + "c" * 5000, "a" * 5000 + "c" * 5000) == 1


def test_edit_fraction_and_blocks(spark):
    """Worked by hand: in the first pair `a b` and `d` stay, x comes before them, c goes, `e f` come after; 4 of 6 tokens."""
    pairs = [("a b c d", "x a b d e f", 4 / 6), ("un", "deux trois quatre", 1.0), ("", "", 0.0), (None, "x", None), ("Au revoir.", "Bonjour.", 2 / 3), ("a b", "a b", 0.0), ("", "p q", 1.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i long, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(X.edit_fraction(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([w for _, _, w in pairs])
    assert X.blocks("a b c d".split(), "x a b d e f".split()) == [(0, 1, 2), (3, 3, 1), (4, 6, 0)]
    equal = df.where("i = 0").select(X.alignment(X.tokens(F.col("a")), X.tokens(F.col("b")))["equal"]).first()[0]
    assert equal == 3


def test_folding_is_full_case_folding(spark):
    import unicodedata

    texts = ["Straße ﬁne ŉ İI ΣΑΣ ς ſ ꭰ!", "«Ça va?» — Oui… (x)", "a_b #1 €", "".join(chr(c) for c in range(0x21, 0x250)), "ΐΰևẖẗẘẙẚﬀﬃﬓ 𐐀"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(X.folded(F.col("t"))).collect()]
    assert got == ["".join(" " if unicodedata.category(c)[0] == "P" else c for c in t).casefold() for t in texts]


def test_describe(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9)], "x double").agg(X.describe(F.col("x")).alias("d")).first().d
    assert (d["count"], d["mean"], d["median"], round(d["p10"], 9), round(d["p90"], 9)) == (4, 4, 3, 1.3, 7.5)


def test_sft_and_exclusions(spark):
    rows = spark.createDataFrame([(1, "Hi", "Salut ", "y"), (2, "x" * 30, "a", "b"), (3, "Hi", None, "b"), (4, "Hi", "y ", "y"), (5, "Hi", "good", "z" * 30)], "line long, src string, a string, b string")
    got = {r.line: r.reason for r in R.with_reason(rows, "src", ["a", "b"], 20).collect()}
    assert got == {1: None, 2: "max_length", 3: "missing_or_empty_field", 4: "identical_preferences", 5: "max_length"}
    one = R.sft_rows(rows.where("line = 1"), "src", "a").first()
    assert one.labels == [-100] * 4 + [ord(c) for c in "Salut"] + [9] and one.input_ids[:4] == [1, 2, 72, 105]


def test_padding(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, [4])], "line long, input_ids array<int>")
    right = {r.line: r.input_ids for r in R.padded(rows, 2, {"input_ids": 0}).collect()}
    left = {r.line: r.input_ids for r in R.padded(rows, 2, {"input_ids": 0}, left=True).collect()}
    assert right == {1: [1, 2], 2: [3, 0], 3: [4]} and left[2] == [0, 3]


def test_experiment_names():
    assert R.experiment_columns("dpo-corrected-base") == {"chosen": 4, "rejected": 3}
    with pytest.raises(ValueError):
        R.experiment_columns("cpo-human-human")


def test_generate_and_extract(spark):
    jobs = spark.createDataFrame([(1, "fr", "abc"), (2, "fr", None), (3, "fr", "x" * 40), (7, "fr", "cut")], "line long, language string, prompt string")
    got = {r.line: (r.text, r.skip_reason) for r in G.generate(jobs, budget=30).collect()}
    assert got == {1: ("ABC", None), 2: (None, "skipped"), 3: (None, "context_budget_exceeded"), 7: (None, "generation_length")}
    raw = spark.createDataFrame([(1, '{"corrected_translation": ""}'), (2, "{broken"), (3, "{}")], "line long, raw_response string")
    assert [(r.corrected, r.extraction_error) for r in G.extract_response(raw).orderBy("line").collect()] == [("", None), (None, "invalid_json"), (None, "missing_string_field")]


def test_stream_resumes(spark, tmp_path):
    inputs, journal, mark = (str(tmp_path / x) for x in ("in", "journal", "mark"))
    for n in (1, 2):
        spark.createDataFrame([(n, "fr", f"p{n}")], "line long, language string, prompt string").write.mode("append").parquet(inputs)
        for _ in range(2):
            stream = spark.readStream.schema("line long, language string, prompt string").parquet(inputs)
            G.run_stream(stream, journal, mark).awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(journal).collect()) == [1, 2]
    with pytest.raises(ValueError, match="prompt"):
        G.check_manifest({"prompt": "a"}, {"prompt": "b"})


def test_edits_agree(spark):
    def ok(original, corrected, *edits):
        df = spark.createDataFrame([(original, corrected, [tuple(e) for e in edits])], "o string, c string, e array<struct<before: string, after: string, category: string, reason: string>>")
        return df.select(V.edits_agree(F.col("o"), F.col("c"), F.col("e"))).first()[0]

    assert ok("a b", "a c", ("b", "c", "grammar", "r"))
    assert not ok("a b", "a c") and not ok("a b", "a c", ("zz", "c", "grammar", "r")) and not ok("a b", "a c", ("b", "c", "style", "r"))
    assert ok(" a b", "a b ")


def test_bootstrap(spark):
    import numpy as np

    d = [0.5, -0.25, 1.0, 0.0, 0.75]
    df = spark.createDataFrame(list(enumerate(d)), "pos long, diff double")
    got = C.paired_bootstrap(df, 200, 42).first()
    g = np.random.default_rng(42)
    means = [np.array(d)[g.integers(0, 5, 5)].mean() for _ in range(200)]
    assert [got.low, got.high] == pytest.approx(list(np.percentile(means, [2.5, 97.5])))
    p = C.poisson_bootstrap(df, 4000).first()
    assert p.low < 0.4 < p.high and abs(p.low - got.low) < 0.25 and abs(p.high - got.high) < 0.25
    weights = np.searchsorted(C.POISSON, C._uniform(1, np.arange(300), 400), side="right")
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.03
    wins = C.win_loss(df).first()
    assert (wins.wins, wins.losses, wins.ties) == (3, 1, 1)


def test_registered_bootstraps_take_all_resamples(spark, monkeypatch):
    from lexiloom.plans import queries

    seen = []
    for name in ("paired_bootstrap", "poisson_bootstrap"):
        monkeypatch.setattr(queries.C, name, lambda diffs, resamples: seen.append(resamples))
    monkeypatch.setattr(queries, "_diffs", lambda spark, sf: None)
    queries.QUERIES["bootstrap_ci"](spark, "")
    queries.QUERIES["bootstrap_poisson"](spark, "")
    assert seen == [20_000, 20_000]


def test_metrics(spark):
    score = lambda *rows: metrics.corpus_scores(spark.createDataFrame(rows, "hyp string, ref string")).first()
    same = score(("The cat sat on the mat.", "The cat sat on the mat."))
    assert (same.bleu, same.chrf) == pytest.approx((100, 100))
    # 5 of 6 words, 3 of 5, 1 of 4 and 0 of 3 n-grams match; the missing order counts as half a match
    one = score(("the cat sat on a mat", "the cat sat in a mat"))
    assert one.bleu == pytest.approx(100 * (5 / 6 * 3 / 5 * 1 / 4 * (1 / 2) / 3) ** 0.25)
    assert score(("x", "y")).bleu == 0 and score((None, "y"), ("", "z")).chrf == 0
    # "ab" against "abcd": precision 1 and recall 2/4 and 1/3 over two orders; orders without n-grams on a side are left out
    p, r = 1.0, (2 / 4 + 1 / 3) / 2
    assert score(("ab", "a b\ncd")).chrf == pytest.approx(100 * 5 * p * r / (4 * p + r))
    short = score(("a b c d", "a b c d e f g h"))
    assert short.bleu == pytest.approx(100 * math.exp(1 - 2))
    cut = spark.createDataFrame([('He said: "1.5-2, (ok)!" e.g. &quot;x&quot; a-\nb',)], "t string").select(metrics.tokens_13a(F.col("t"))).first()[0]
    assert cut == ["He", "said", ":", '"', "1.5", "-", "2", ",", "(", "ok", ")", "!", '"', "e", ".", "g", ".", '"', "x", '"', "ab"]
