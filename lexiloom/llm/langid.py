"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of the `top` most frequent character n-grams (one to three letters, words padded with a blank, case folded) of a
language's training rows. A text's own list is compared with each profile: an n-gram at rank r in the text and p in the profile is |r - p|
out of place, one that is missing counts `top`. The language with the least sum wins (ties: the smaller name).

Letters are numbered by a hash into 63 classes, so one rule serves every script; n-gram counts then need no dictionary.

Training rows: for each language a sample by hash of doc_id of about `sample_per_lang` documents (all, where there are fewer), which bounds
the cost of fitting; their whole texts count. Scores: 1 - least / second least distance, scaled to 0..1.

Nulls: a text that is null or has no letter gets `und` and score 0. Rows with null lang are not learned from. No training rows: all `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, id_fold, pieces

UND = "und"


class Letters:
    """Code point to class: 0 for what is no letter, else 1..63. Filled as code points are met."""

    def __init__(self):
        self.table = np.full(0x110000, 255, np.uint8)

    def classes(self, points: np.ndarray) -> np.ndarray:
        got = self.table[points]
        if (got == 255).any():
            for p in np.unique(points[got == 255]).tolist():
                c = chr(p)
                low = ord(c.lower()[0])
                self.table[p] = 0 if not c.isalpha() else 1 + low - 97 if 97 <= low <= 122 else 27 + low * 2654435761 % (1 << 32) % 37
            got = self.table[points]
        return got


def grams(texts: list[str], letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of every n-gram of every text, sorted by row and gram. A gram is 20 bits: order and up to three classes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join("\0" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = letters.classes(points).astype(np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths + 1)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0) | (row[1:] != row[:-1])  # runs of what is no letter become one blank
    c, row = c[keep], row[keep]
    c = np.concatenate([[0], c, [0]])
    base = row << 20
    mid = c[1:-1]
    letter = mid > 0
    one = base[letter] | mid[letter]
    nxt = c[2:]
    pair_ok = letter | (nxt > 0)
    two = base[pair_ok] | (1 << 18) | (mid[pair_ok] << 6) | nxt[pair_ok]
    three = base[letter] | (2 << 18) | (c[:-2][letter] << 12) | (mid[letter] << 6) | nxt[letter]
    keys = np.concatenate([one, two, three])
    keys.sort()
    if not len(keys):
        return keys, keys, keys
    cut = np.flatnonzero(np.diff(keys)) + 1
    start = np.concatenate([[0], cut])
    return keys[start] >> 20, keys[start] & 0xFFFFF, np.diff(np.concatenate([start, [len(keys)]]))


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank) of the `top` most frequent grams of each row; ties by gram."""
    key = (row << 42) | (((1 << 22) - 1 - np.minimum(count, (1 << 22) - 1)) << 20) | gram
    key.sort()
    row = key >> 42
    first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1]) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
    ok = rank < top
    return row[ok], key[ok] & 0xFFFFF, rank[ok]


def distances(texts: list[str], profiles: np.ndarray, top: int, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """profiles: languages x 2^20 ranks (top where missing). Returns distances (texts x languages) and the number of grams compared."""
    row, gram, rank = ranked(*grams(texts, letters), top)
    used = np.bincount(row, minlength=len(texts))
    out = np.stack([np.bincount(row, np.where(p[gram] < top, np.abs(p[gram] - rank), top), minlength=len(texts)) for p in profiles], axis=1) if len(profiles) else np.zeros((len(texts), 0))
    return out, used


def _chunks(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def train_profiles(train: DataFrame, top: int = 300, sample_per_lang: int = 4000) -> list[tuple[str, list[int]]]:
    """train: (doc_id, text, lang), lang not null. Profiles in order of language name."""
    bound_batches(train.sparkSession)
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, sample_per_lang / n)))])
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in pieces(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = np.array([t or "" for t in batch.column("text").to_pylist()], object)
            for lang in sorted(set(langs)):
                own = texts[langs == lang].tolist()
                for s, e in _chunks(own):
                    _, gram, count = grams(own[s:e], letters)
                    total = np.bincount(gram, count)
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int64)), pa.array(total[at].astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    lists = counts.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "gram"))), 1, top).alias("best"))  # at most 2^20 grams a language
    return sorted((r.lang, [x.gram for x in r.best]) for r in lists.collect())


def _table(profiles: list[tuple[str, list[int]]], top: int) -> np.ndarray:
    table = np.full((len(profiles), 1 << 20), top, np.int32)
    for i, (_, best) in enumerate(profiles):
        table[i, best] = np.arange(len(best))
    return table


def _judge(texts: list[str | None], profiles, table: np.ndarray, top: int, letters: Letters) -> tuple[list[str], list[float]]:
    names, scores = [], []
    plain = [t or "" for t in texts]
    for s, e in _chunks(plain):
        dist, used = distances(plain[s:e], table, top, letters)
        for d, n in zip(dist, used):
            if not n or not len(profiles):
                names.append(UND)
                scores.append(0.0)
                continue
            best = int(d.argmin())
            rest = np.delete(d, best).min() if len(d) > 1 else n * top
            names.append(profiles[best][0])
            scores.append(float(1 - d[best] / rest) if rest > 0 else 0.0)
    return names, scores


def predict(docs: DataFrame, profiles: list[tuple[str, list[int]]], top: int = 300) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table = Letters(), _table(profiles, top)
        for batch in pieces(batches):
            names, scores = _judge(batch.column("text").to_pylist(), profiles, table, top, letters)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def learned_rows(docs: DataFrame, folds: int = 5) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & (id_fold("doc_id", folds) != 0)).select("doc_id", "text", "lang")


def drop_unknown(docs: DataFrame, profiles: list[tuple[str, list[int]]], top: int = 300, min_score: float = 0.0) -> DataFrame:
    """Rows of docs that get a language with at least min_score; nothing is shuffled. With min_score 0 only `und` goes. Columns unchanged, but for
    a text column lang: where it is null it takes the language found."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # Arrow functions look columns up by name, and these have no dots
    at_text, at_lang = names.index("text"), names.index("lang") if dict(docs.dtypes).get("lang") == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, table = Letters(), _table(profiles, top)
        for batch in pieces(batches):
            langs, scores = _judge(batch.column(at_text).to_pylist(), profiles, table, top, letters)
            if at_lang is not None:
                own = batch.column(at_lang).to_pylist()
                batch = batch.set_column(at_lang, batch.schema.field(at_lang), pa.array([x if y is None else y for x, y in zip(langs, own)], batch.column(at_lang).type))
            yield batch.filter(pa.array([x != UND and s >= min_score for x, s in zip(langs, scores)], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
