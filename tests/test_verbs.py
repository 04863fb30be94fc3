"""From files to files: loaders, prepared tables, evaluation, inspection and resumable runs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexiloom import config as K
from lexiloom.functions.text import with_distances
from lexiloom.operators import compare as C, evaluate as E, inspect as I, prepare as P, training as R
from lexiloom.operators.validate import ValidationError
from lexiloom.sources import files, loaders as L, records as S
from lexiloom.streaming import generate as G


@pytest.fixture
def put(tmp_path):
    def write(name, *lines):
        text = "".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in lines)
        path = tmp_path / name
        path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
        return str(path)

    return write


def record(seg="Hello.", language="en", **target):
    return {"language": language, "seg": seg, "tgts": [{"language": "fr", **target}]}


def dicts(df, *columns):
    return [r.asDict(recursive=True) if not columns else tuple(r[c] for c in columns) for r in df.orderBy("line").collect()]


def test_lines_follow_file_names(spark, tmp_path):
    for name, n in (("a.txt", 3), ("b.txt", 5000), ("c.txt", 40)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = [r.value for r in S.read_lines(spark, str(tmp_path)).orderBy("line").collect()]
        lines = [r.line for r in S.read_lines(spark, str(tmp_path)).orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{name}{i}" for name, n in (("a.txt", 3), ("b.txt", 5000), ("c.txt", 40)) for i in range(n)]
    assert lines == list(range(1, 5044))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("")
    assert S.read_lines(spark, str(tmp_path / "empty")).count() == 0


def test_strict_records(spark, put):
    assert L.load_records(spark, put("a.jsonl.gz", record(base="x"))).count() == 1
    for bad, message in (("{broken", "invalid JSON"), ("[1]", "expected a JSON object"), ("", "invalid JSON"), ({"seg": "x", "tgts": []}, "language must be a string"), (record(" ", base="x"), "missing or empty seg"), ({**record(), "tgts": []}, "missing or empty tgts")):
        with pytest.raises(ValidationError, match=rf"b\.jsonl line 2: {message}"):
            L.load_records(spark, put("b.jsonl", record(base="x"), bad))
    with pytest.raises(ValueError, match="expected a .gz file"):
        L.load_records(spark, put("c.jsonl", record(base="x")), gzip_only=True)


def test_pairs(spark, put):
    one = put("s.jsonl", {"language": "en", "seg": "S", "tgts": [{"language": "fr", "student": " A \n"}, {"language": "de", "student": "B"}], "id": 7})
    two = put("r.jsonl", {"language": "en", "seg": "S", "tgts": [{"language": "de", "seg": "b"}, {"language": "fr", "human": "a\n"}]})
    rows = L.load_pairs(spark, one, two).orderBy("pos").collect()
    assert [(r.target_language, r.base, r.human) for r in rows] == [("fr", " A", "a\n"), ("de", "B", "b")]
    assert {r.human for r in L.load_pairs(spark, put("e.jsonl", record(base="x", human_reference="h"))).collect()} == {"h"}
    assert {r.human for r in L.load_pairs(spark, put("e.jsonl", record(base="x", human_reference="h")), embedded=False).collect()} == {None}
    with pytest.raises(ValidationError, match="embedded"):
        L.load_pairs(spark, put("e.jsonl", record(base="x", human_reference="")))
    with pytest.raises(ValidationError, match="line 2: source"):
        L.load_pairs(spark, put("p.jsonl", record(base="x"), record("B", base="x")), put("q.jsonl", record(human="x"), record("C", human="x")), limit=1)
    with pytest.raises(ValidationError, match="line 2: count"):
        L.load_pairs(spark, put("p.jsonl", record(base="x"), record("B", base="x")), put("q.jsonl", record(human="x")))
    with pytest.raises(ValidationError, match="target base"):
        L.load_pairs(spark, put("p.jsonl", record(student=None)))
    assert L.load_pairs(spark, put("p.jsonl", record(base=None, human="Trop long."))).first().base is None


def test_tsv_pairs(spark, put):
    path = put("x.tsv.gz", "en\tfr", "  Hello.  \tBonjour.", '"q"\tr')
    rows = L.load_tsv(spark, path, "en", "fr", limit=1, skip_header=True).collect()
    assert [(r.line, r.seg) for r in rows] == [(2, "  Hello.  ")]
    for bad, message in (("Invalid", "exactly 2"), ("a\t ", "blank human"), ("a�\tb", "U\\+FFFD")):
        with pytest.raises(ValidationError, match=message):
            L.load_tsv(spark, put("y.tsv", "a\tb", bad), "en", "fr", limit=1)
    with pytest.raises(ValidationError, match="no input"):
        L.load_tsv(spark, put("z.tsv", "a\tb"), "en", "fr", skip_header=True)


def test_json_of_three_kinds(spark, put):
    load = lambda path, **k: [(r.line, r.seg, json.loads(r.j)) for r in L.load_json(spark, path, "en", "fr", "big", **k).withColumn("j", F.to_json("tgts")).orderBy("line").collect()]
    bare = {"language": "en", "seg": "A"}
    assert load(put("a.json", [bare, record(base="x")])) == [(1, "A", [{"language": "fr"}]), (2, "Hello.", [{"language": "fr", "base": "x"}])]
    assert load(put("b.json", bare)) == [(1, "A", [{"language": "fr"}])]
    assert [x[:2] for x in load(put("c.json", bare, {**bare, "seg": "B"}))] == [(1, "A"), (2, "B")]
    assert [x[:2] for x in load(put("d.json", "plain one", "plain two"), limit=1)] == [(1, "plain one")]
    for bad, message in (({**bare, "language": "de"}, "source language differs"), (record(big="x"), "big already exists"), ({**bare, "tgts": [{"language": "fr"}, {"language": "fr"}]}, "multiple matching"), ({**bare, "seg": 5}, "nonempty seg"), ({**bare, "tgts": 5}, "tgts must be")):
        with pytest.raises(ValidationError, match=message):
            load(put("e.json", [bare, bad]), limit=1)


def test_input_and_references(spark, put):
    config = K.Evaluation(20, 5)
    rows, out, given = P.prepare_input(spark, put("a.tsv", "x" * 30 + "\tlong", "Hi\tSalut"), config)
    assert dicts(rows, "line", "src", "tgt") == [(2, "Hi", "Salut")] and dicts(out) == [{"line": 1, "reason": "generation_context_budget"}] and given
    sources = put("b.txt", "one", "two")
    rows, _, given = P.prepare_input(spark, sources, config)
    assert dicts(rows, "tgt") == [(None,), (None,)] and not given
    assert dicts(P.prepare_input(spark, sources, config, put("r.txt", "un", "deux"))[0], "tgt") == [("un",), ("deux",)]
    with pytest.raises(ValidationError, match="reference count"):
        P.prepare_input(spark, sources, config, put("r1.txt", "un"))
    with pytest.raises(ValidationError, match="reference count"):
        P.prepare_input(spark, sources, config, put("r3.txt", "un", "deux", "trois"))
    assert dicts(P.prepare_input(spark, put("c.en.gz", "one"), config)[0], "src") == [("one",)]
    for name, lines, message in (("d.jsonl", [{"src": "a", "tgt": "b"}, {"src": "c"}], "every input record"), ("e.tsv", ["a\tb\tc"], "expected src or"), ("f.txt", [" "], "nonempty src"), ("g.jsonl", ["[1]"], "JSON object"), ("h.txt", ["x" * 40], "no input sentences fit")):
        with pytest.raises(ValidationError, match=message):
            P.prepare_input(spark, put(name, *lines), config)
    with pytest.raises(ValueError, match="must be .json"):
        P.prepare_input(spark, put("i.csv", "a"), config)


def test_training_and_development_rows(spark, put):
    path = put("t.tsv", "Hi\tSalut \ty\tz", "x" * 30 + "\ta\tb\tc", "Hi\t\tb\tc", "Hi\tgood\ty \ty", "Hi\tgood\tx\ty")
    kept, out = P.training_rows(spark, path, K.Training("sft", tgt_col=2, max_length=20, max_new_tokens=5))
    assert dicts(out) == [{"line": 2, "reason": "max_length"}, {"line": 3, "reason": "missing_or_empty_field"}] and kept.count() == 3
    kept, out = P.training_rows(spark, path, K.Training("cpo", chosen_col=4, rejected_col=3, max_length=20, max_new_tokens=5))
    assert {r.reason for r in out.collect()} == {"max_length", "identical_preferences"} and len(kept.columns) == 9
    row = kept.where("line = 1").first()
    assert row.chosen_labels == [-100] * 4 + [ord("z"), 9] and row.prompt_attention_mask == [1] * 4
    with pytest.raises(ValidationError, match="exactly 4"):
        P.training_rows(spark, put("u.tsv", "a\tb\tc"), K.Training("sft", tgt_col=2))
    rows, out = P.eval_rows(spark, put("d.tsv", "x" * 30 + "\ta", "Hi\tSalut"), K.Evaluation(20, 5))
    assert dicts(rows, "line") == [(2,)] and dicts(out, "line") == [(1,)]
    for lines, message in ((["a\t "], "nonempty src/human"), (["a\tb\tc"], "exactly 2"), (["x" * 30 + "\ta"], "fit the generation budget")):
        with pytest.raises(ValidationError, match=message):
            P.eval_rows(spark, put("e.tsv", *lines), K.Evaluation(20, 5))


def test_prepare(spark, put, tmp_path):
    full = {"seg": "Source", "tgts": [{"language": "fr", "human": "Human", "base": "Base", "corrected": "Corrected"}]}
    part = {"seg": "Source", "tgts": [{"language": "fr", "human": "Human", "base": "Two\nlines", "corrected": None}]}
    run = lambda name, source, *a, **k: (P.prepare(spark, source, str(tmp_path / name), K.Selection(*a, **k)), [r.value for r in S.read_lines(spark, str(tmp_path / name)).orderBy("line").collect()])
    both = put("a.jsonl", full, part)
    counts, rows = run("o1.jsonl", both, "seg", "tgts.corrected", "tgts.base")
    assert counts == {"read": 2, "written": 1, "missing_or_empty": 1, "tsv_control_characters": 0} and [json.loads(x) for x in rows] == [{"src": "Source", "tgt": "Corrected", "reject": "Base"}]
    assert run("o2.tsv.gz", both, "tgts.human", "seg") [1] == ["Human\tSource"] * 2
    counts, rows = run("o3.tsv", put("b.jsonl", part), "seg", "tgts.base")
    assert counts["tsv_control_characters"] == 1 and rows == []
    two = put("c.jsonl", {**full, "tgts": full["tgts"] + [{"language": "de", "human": "Mensch"}]})
    with pytest.raises(ValidationError, match="multiple matching"):
        run("o4.tsv", two, "seg", "tgts.human")
    assert run("o5.tsv", two, "seg", "tgts.human", target_language="de")[1] == ["Source\tMensch"]
    assert run("o6.tsv", two, "seg", "tgts.human", target_language="es")[0]["missing_or_empty"] == 1
    for path, message in ((both, "must differ"), (str(tmp_path / "o1.jsonl"), "output exists"), (str(tmp_path / "o.txt"), "suffix")):
        with pytest.raises(ValueError, match=message):
            P.prepare(spark, both, path, K.Selection("seg", "tgts.human"))


def test_compared_translations(spark, put):
    left = put("l.jsonl.gz", record(base="A b."), record("B", corrected="x y", base="no"))
    right = put("r.jsonl.gz", record(human="a b!"), {**record(), "seg": "B", "tgts": [{"language": "fr", "seg": "x z"}]})
    sides = [L.load_translations(spark, p) for p in (left, right)]
    plain, loose = C.compare_translations(*sides).first(), C.compare_translations(*sides, ignore_case_punct=True).first()
    assert (plain.sentences, plain.pairs, plain.left_tokens, plain.equal_tokens, plain.equal_lines) == (2, 2, 5, 2, 0)
    assert (loose.left_tokens, loose.equal_tokens, loose.equal_lines, loose.line_percent) == (4, 3, 1, 50.0)
    assert "Equal lines: 1 (50.00%)" in C.agreement_report(loose)
    for other, message in ((put("q1.jsonl.gz", record(base="A b.")), "count"), (put("q2.jsonl.gz", record(base="x"), record("C", base="y")), "source"), (put("q.jsonl.gz", record(base="x"), {"language": "en", "seg": "B", "tgts": [{"language": "de", "base": "y"}]}), "languages")):
        with pytest.raises(ValidationError, match=message):
            C.compare_translations(sides[0], L.load_translations(spark, other))
    with pytest.raises(ValidationError, match="invalid translation"):
        L.load_translations(spark, put("n.jsonl.gz", record(base=None, human="h")))


def test_compare_score_files(spark, put):
    rows = [{"src": "a", "ref": "r", "COMET": 0.5}, {"src": "b", "ref": "s", "COMET": 1}]
    a, b = put("a.json", json.dumps(rows)), put("b.json", json.dumps({"sys": [{**rows[0], "COMET": 0.75}, rows[1]]}))
    got = C.compare_systems(S.load_scores(spark, a), S.load_scores(spark, b), 500).first()
    assert (got.sentences, got.system_a, got.system_b, got.difference, got.b_better, got.a_better, got.ties, got.significant) == (2, 0.75, 0.875, 0.125, 1, 0, 1, False)
    assert "B better: 1" in C.comparison_report(got)
    for data, message in (({"x": rows, "y": rows}, "exactly one system"), ([], "nonempty list"), ({"x": 5}, "nonempty list"), ([{"src": "a"}], "finite numeric"), ([{"src": "a", "COMET": True}], "finite numeric"), ([{"COMET": 1}], "string 'src'"), ([5], "string 'src'")):
        with pytest.raises(ValueError, match=message):
            S.load_scores(spark, put("c.json", json.dumps(data)))
    for data, message in (([rows[0]], "different sentence counts"), ([rows[0], {**rows[1], "src": "x"}], "sentence 2: 'src'"), ([rows[0], {"src": "b", "COMET": 1}], "sentence 2: 'ref'")):
        with pytest.raises(ValidationError, match=message):
            C.compare_systems(S.load_scores(spark, a), S.load_scores(spark, put("d.json", json.dumps(data))))


def test_inspection(spark, put, tmp_path):
    path = put("in.jsonl", record("S", base="a b c", human="a x c d", corrected="a b c"), record("T", base="Hello.", human="hello!", corrected=None), "broken past the limit")
    prompt = put("p.txt", "Translate.")
    found = I.run_inspection(spark, path, prompt, K.Inspection(limit=2))
    assert found["sentences"] == 2 and found["complete_triplets"] == 1 and found["status_counts"]["corrected"] == {"missing_or_empty": 1, "ok": 1}
    edits = found["edit_distance"]["base_vs_human"]
    assert edits["pairs"] == 2 and edits["changed_fraction"] == 1 and edits["word"]["pooled_normalized"] == 4 / 6 and edits["word"]["sentence_normalized"]["median"] == 0.75
    assert found["edit_distance"]["base_vs_corrected"]["identical"] == 1 and found["edit_distance"]["base_vs_corrected"]["word"]["pooled_normalized"] == 0
    base = found["likelihood"]["complete_triplets"]["base"]
    assert base["tokens"] == 5 and base["token_weighted_nll"] == pytest.approx((0.5 * 5 + 0.25) / 5)
    wide = spark.read.csv(str(tmp_path / "in.distribution.sentences.tsv"), sep="\t", header=True)
    assert wide.columns[:5] == ["line", "source_language", "target_language", "source", "base"] and wide.count() == 2
    nested = [json.loads(r.value) for r in S.read_lines(spark, str(tmp_path / "in.distribution.sentences.jsonl")).orderBy("line").collect()]
    assert set(nested[1]["distances"]) == {"base_vs_human"} and set(nested[1]["nll_deltas"]) == {"human_minus_base"}
    assert json.loads((tmp_path / "in.distribution.summary.json").read_text())["configuration"]["limit"] == 2
    with pytest.raises(ValueError, match="new paths"):
        I.run_inspection(spark, path, prompt, K.Inspection(limit=2))
    dry = I.run_inspection(spark, path, prompt, K.Inspection(limit=2, dry_run=True), str(tmp_path / "dry"))
    assert dry["status_counts"]["corrected"] == {"missing_or_empty": 1, "not_scored_dry_run": 1} and dry["complete_triplets"] == 0
    for bad, message in ((record("S", base=5), "base must be a string"), ({**record(), "tgts": [{"language": "fr"}, {"language": "de"}]}, "exactly one target"), ({"seg": "x"}, "source language/seg")):
        with pytest.raises(ValidationError, match=message):
            L.load_examples(spark, put("bad.jsonl", bad))
    assert L.load_examples(spark, put("two.jsonl", {**record(), "tgts": [{"language": "fr"}, {"language": "de", "base": "x"}]}), "de").first().base == "x"


def test_equal_texts_are_scored_once_a_line(spark):
    rows = spark.createDataFrame([(1, "s", "same", "same", "other")], "line long, source string, base string, human string, corrected string")
    with pytest.raises(Exception, match="unexpected number"):
        I.score_candidates(rows, K.Inspection(), lambda pdf: I.vowel_likelihood(pdf).head(0)).collect()
    seen = I.score_candidates(rows, K.Inspection(), lambda pdf: I.vowel_likelihood(pdf).assign(total_logprob=-float(len(pdf)))).collect()
    assert {r.variant: r.status for r in seen} == dict.fromkeys(I.VARIANTS, "ok") and sum(-r.total_logprob for r in seen if r.variant != "human") <= 4
    over = I.score_candidates(rows, K.Inspection(max_length=7)).collect()
    assert {r.variant: (r.status, r.tokens, r.nll) for r in over}["corrected"] == ("context_budget_exceeded", 5, None)
    none = I.score_candidates(rows, K.Inspection(), tokenize=lambda c: F.array().cast("array<int>")).first()
    assert none.status == "empty_tokenization"


def test_evaluation_writes_a_run(spark, put, tmp_path):
    rows, out, given = P.prepare_input(spark, put("a.tsv", "hi\tHI", "x" * 90 + "\tlong", "a b\tA C"), K.Evaluation(60, 10))
    folder = str(tmp_path / "run")
    found = E.evaluate(spark, rows, out, folder, given, metric=E.length_metric)
    assert found["sentences"] == 2 and found["token_limit_hits"] == 0 and found["system_score"] == 1.0 and 0 < found["chrf"] < 100
    read = lambda name: [json.loads(r.value) for r in S.read_lines(spark, f"{folder}/{name}").orderBy("line").collect()]
    assert read("hyps") == [{"line": 1, "hyp": "HI", "hit_token_limit": False}, {"line": 3, "hyp": "A B", "hit_token_limit": False}]
    assert read("sources")[1] == {"line": 3, "text": "a b"} and read("references")[0]["text"] == "HI" and read("scores")[0] == {"line": 1, "score": 1.0} and read("excluded") == [{"line": 2, "reason": "generation_context_budget"}]
    assert [r.value for r in S.read_lines(spark, f"{folder}/hyps_text").orderBy("line").collect()] == ["HI", "A B"]
    assert json.loads((tmp_path / "run" / "metrics.json").read_text()) == found
    with pytest.raises(ValueError, match="new or empty"):
        E.evaluate(spark, rows, out, folder, given)
    with pytest.raises(Exception, match="unexpected number of scores"):
        E.learned_scores(spark.createDataFrame([(1, "a", "b", "c")], "line long, src string, mt string, ref string"), lambda pdf: E.length_metric(pdf).head(0)).collect()
    E.parity({"src": 2, "ref": 2})
    for bad in ({"src": 2, "hyp": 3}, {"src": 0, "hyp": 0}):
        with pytest.raises(ValidationError):
            E.parity(bad)
    assert E.ready(spark, f"{folder}/metrics.json", [f"{folder}/hyps", f"{folder}/none"], ".comet") == [f"{folder}/hyps"]


def test_translation_resumes_and_refuses(spark, put, tmp_path):
    records = L.load_tsv(spark, put("a.tsv", *[f"s{i}\th{i}" for i in range(1, 10)]), "en", "fr")
    config, output = K.Generation("m", "Translate."), str(tmp_path / "out.jsonl.gz")
    failing = lambda pdf: G.echo_model(pdf) if pdf["line"].max() <= 4 else 1 / 0
    with pytest.raises(Exception, match="ZeroDivision"):
        G.translate(spark, records, output, config, failing, lines=4)
    assert files.children(spark, output + ".audit")[0] == "batch=000000000001" and not files.exists(spark, output + ".lock")
    with pytest.raises(ValueError, match="exists; resume"):
        G.translate(spark, records, output, config)
    with pytest.raises(ValueError, match="configuration changed"):
        G.translate(spark, records, output, K.Generation("other", "Translate."), resume=True)
    with pytest.raises(ValidationError, match="checkpoint differs"):
        G.translate(spark, records.withColumn("seg", F.concat("seg", F.lit("!"))), output, config, resume=True)
    asked = lambda pdf: G.echo_model(pdf) if pdf["line"].min() > 4 else 1 / 0
    assert G.translate(spark, records, output, config, asked, resume=True, lines=4, references=str(tmp_path / "refs.jsonl.gz")) == {"translations": 9, "skipped": 1}
    rows = [json.loads(r.value) for r in S.read_lines(spark, output).orderBy("line").collect()]
    assert [r["seg"] for r in rows] == [f"s{i}" for i in range(1, 10)] and rows[6]["tgts"][0]["base"] is None and rows[0]["tgts"][0]["human"] == "h1" and "S1" in rows[0]["tgts"][0]["base"]
    assert G.translate(spark, records, output, config, lambda pdf: 1 / 0, resume=True)["translations"] == 9  # complete: no model call
    with files.Lock(spark, output + ".lock"):
        with pytest.raises(ValueError, match="another job"):
            G.translate(spark, records, output, config, resume=True)
    with pytest.raises(ValueError, match="existing manifest"):
        G.translate(spark, records, str(tmp_path / "new"), config, resume=True)


def test_post_editing(spark, put, tmp_path):
    path = put("s.jsonl", {"language": "en", "seg": "A", "tgts": [{"language": "fr", "student": "Bon", "human_reference": "Bonjour.", "note": 1}, {"language": "de", "base": None, "human": "Lang."}]}, record("B", base="Fin.", human="F.", corrected="old"))
    out = str(tmp_path / "post.jsonl.gz")
    stats = G.post_edit(spark, L.load_pairs(spark, path), out, K.PostEdit("t", "Correct."))
    rows = [json.loads(r.value) for r in S.read_lines(spark, out).orderBy("line").collect()]
    assert rows[0]["tgts"] == [{"language": "fr", "base": "Bon", "human": "Bonjour.", "note": 1, "corrected": "Bon."}, {"language": "de", "base": None, "human": "Lang.", "corrected": None}]
    assert rows[1]["tgts"] == [{"language": "fr", "base": "Fin.", "human": "F.", "corrected": "Fin."}]
    assert (stats["source_lines"], stats["pairs"], stats["changed"], stats["unchanged"], stats["missing"], stats["non_stop"], stats["large_edits"]) == (2, 3, 1, 1, 1, 1, 1)
    assert json.loads((tmp_path / "post.jsonl.gz.stats.json").read_text()) == stats
    payload = json.loads(json.loads(spark.read.parquet(out + ".audit").where("line = 2").first().prompt)[1]["content"])
    assert payload == {"source_language": "en", "target_language": "fr", "source": "B", "student_translation": "Fin.", "human_reference": "F."}


def test_answers_match_prompts(spark):
    jobs = spark.createDataFrame([(1, "fr", "a"), (2, "fr", "b")], "line long, language string, prompt string")
    for model in (lambda pdf: G.echo_model(pdf).head(0), lambda pdf: G.echo_model(pdf).assign(line=9)):
        with pytest.raises(Exception, match="answers to"):
            G.generate(jobs, model).collect()


def test_journal_with_a_torn_tail(spark, tmp_path):
    path = tmp_path / "audit.jsonl"
    path.write_text('{"line": 1}\n{"line": 2}\n{"line": 3')
    assert dicts(G.read_journal(spark, str(path)), "line") == [(1,), (2,)]
    path.write_text('{"line": 1}\n{"line": 3}\n')
    with pytest.raises(ValidationError, match="line 2"):
        G.read_journal(spark, str(path))
    path.write_text("")
    assert G.read_journal(spark, str(path)).count() == 0


def test_queue(spark, put):
    jobs = L.load_queue(spark, put("q.txt", "gpu 11 5", "gpu 12 9", "cpu 13 7", "odd line"))
    assert C.queue_position(jobs, "11", "gpu") == 2 and C.queue_position(jobs, "13", "cpu") == 1
    with pytest.raises(ValueError, match="not pending"):
        C.queue_position(jobs, "13", "gpu")


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "a" / "m.json")
    (tmp_path / "a").mkdir()
    for value in ({"é": 1}, {"b": None}):
        files.atomic_json(spark, path, value)
        assert json.loads(files.read_text(spark, path)) == value and files.read_text(spark, path).endswith("\n")
    assert [n for n in files.children(spark, str(tmp_path / "a")) if not n.startswith(".")] == ["m.json"]
    assert files.output_prefix("x/a.jsonl.gz") == "x/a" and files.output_prefix("b.json") == "b"
    digest = S.file_digests(spark, path, whole=3).first()
    import hashlib

    assert digest.sha256 == hashlib.sha256((tmp_path / "a" / "m.json").read_bytes()).hexdigest() == S.file_digests(spark, path).first().sha256
    assert L.load_template(spark, path)
    with pytest.raises(ValueError, match="empty prompt"):
        (tmp_path / "e.txt").write_text(" \n")
        L.load_template(spark, str(tmp_path / "e.txt"))


@pytest.mark.parametrize(
    "make",
    [
        lambda: K.Generation("m", "p", source_language="fr"),
        lambda: K.Generation("m", " "),
        lambda: K.Generation("m", "p", max_new_tokens=2048),
        lambda: K.Generation("m", "p", limit=0),
        lambda: K.Generation("m", "p", gpu_memory_utilization=1.0),
        lambda: K.PostEdit("m", "p", review_edit_fraction=1.5),
        lambda: K.Selection("seg", "tgts.student"),
        lambda: K.Selection("seg", "seg", format="csv"),
        lambda: K.Inspection(max_length=0),
        lambda: K.Training("sft"),
        lambda: K.Training("dpo", chosen_col=2, rejected_col=2),
        lambda: K.Training("cpo", chosen_col=2, rejected_col=5),
        lambda: K.Training("sft", tgt_col=2, lora_dropout=1.0),
        lambda: K.Evaluation(10, 10),
    ],
)
def test_arguments_out_of_range(make):
    with pytest.raises(ValueError):
        make()


def test_learning_rates_and_stops(spark):
    assert K.Training("sft", tgt_col=2).learning_rate == 1e-4 and K.Training("dpo", chosen_col=4, rejected_col=3).learning_rate == 5e-6
    row = spark.range(1).select(R.stop_ids(F.lit(1), F.lit(1)).alias("s"), R.hit_limit(F.array(F.lit(5)), F.array(F.lit(1))).alias("h")).first()
    assert row.s == [1] and row.h
    scores = spark.createDataFrame([("a", 100, 1.0), ("a", 200, 3.0), ("a", 300, 3.0)], "run string, step long, score double")
    assert C.best_step(scores).first().step == 200
    steps = spark.createDataFrame([("a", 300), ("a", 400)], "run string, step long")
    assert [r.step for r in C.scores_to_evaluate(steps, scores).collect()] == [400]
    assert with_distances(spark.createDataFrame([], "line long, a string, b string")).count() == 0
