import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lexiloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "part supplier documents conversations labels benchmark pages".split()


def rows(df):
    text = lambda v: "~" if pd.isna(v) else str(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_word_distances_equal_brute_force(spark):
    """Word distances have no SQL; every pair of the smallest tables is measured here by the textbook recurrence."""
    import regex

    from lexiloom.plans.triples import TOKENS, pair_rows, triples

    small = SF.replace("sf0.01", "sf0.001")
    pattern = regex.compile(TOKENS.split("'")[1].replace("{{", "{").replace("}}", "}").replace(r"\x{85}", r"\x85").replace(r"\x{", r"\x"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    pairs = [r for r in pair_rows(triples(spark, small)).collect() if (r.a or "").strip() and (r.b or "").strip()]
    want = {(r.line, r.pair): (distance(a := pattern.findall(r.a), b := pattern.findall(r.b)), max(len(a), len(b))) for r in pairs}
    got = {(r.line, r.pair): (r.distance, r.longer) for r in QUERIES["word_distance"](spark, small).collect()}
    assert got == want and got
    for r in QUERIES["edit_summary"](spark, small).collect():
        own = [v for (_, p), v in want.items() if p == r.pair]
        assert (r.pairs, r.word_distance, r.word_length) == (len(own), sum(d for d, _ in own), sum(n for _, n in own))
    for r in QUERIES["pooled_distance"](spark, small).collect():
        own = [v for (_, p), v in want.items() if p == r.pair]
        assert abs(r.word - sum(d for d, _ in own) / sum(n for _, n in own)) < 1e-8
    flat = {r.line: r for r in QUERIES["pair_distances_flat"](spark, small).collect()}
    assert all(flat[line][f"{p}_word"] == d for (line, p), (d, _) in want.items())
