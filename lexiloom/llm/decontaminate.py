"""Benchmark decontamination by Wu-Manber search for many test strings at once.

The alphabet is the word. Each benchmark item gives windows of 10 consecutive words (an item of fewer words is one window). Windows of one
length m form a search: a shift table over blocks of two words says how far the scan may jump when a block ends at the present word (m-1
words when the block is in no window); a block with shift zero selects the bucket of windows that end in it, and a direct comparison
confirms. Long stretches of a document are passed over at one look in m-1 words.

The windows are read in pieces of at most `block_windows`; each piece is broadcast (about 0.5 KB a window) and searched by a pass of its own
over the rows, chained without a shuffle, so a benchmark of any size is searched whole.

Nulls: a null text has no words (n_words 0, not contaminated). A null item text has no windows; a null item_id is written as "null".
Repeated rows are each judged. Empty benchmark: nothing is hit; empty docs: an empty result. Very long texts are searched whole. Columns other
than those named are passed over, or kept by drop_contaminated, whatever their names: they travel in one struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import batch_bytes, bound_batches, pieces

#: Bytes to words: A-Z become a-z; bytes outside 0-9, a-z and 0x80-0xFF become separators.
WORDS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def windows_of(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class WuManber:
    """Search for windows of m words each."""

    def __init__(self, windows: dict[bytes, list[str]]):
        first = next(iter(windows))
        self.m = first.count(b" ") + 1
        self.block = min(2, self.m)
        self.reach = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[str]]] = {}
        for window, items in windows.items():
            words = window.split(b" ")
            for end in range(self.block, self.m + 1):
                block = b" ".join(words[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.reach), self.m - end)
            self.bucket.setdefault(b" ".join(words[-self.block :]), {})[window] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word's index, items) of every occurrence."""
        m, shift, reach, bucket, n = self.m, self.shift, self.reach, self.bucket, len(words)
        at = m - 1
        if self.block == 1:
            for i, w in enumerate(words):
                if w in bucket:
                    yield i, bucket[w][w]
            return
        while at < n:
            block = words[at - 1] + b" " + words[at]
            jump = shift.get(block, reach)
            if jump:
                at += jump
                continue
            items = bucket[block].get(b" ".join(words[at - m + 1 : at + 1]))
            if items is not None:
                yield at - m + 1, items
            at += 1


def build(windows: dict[bytes, list[str]]) -> list[WuManber]:
    by_length: dict[int, dict[bytes, list[str]]] = {}
    for w, items in windows.items():
        by_length.setdefault(w.count(b" ") + 1, {})[w] = items
    return [WuManber(x) for _, x in sorted(by_length.items())]


def window_pieces(benchmark: DataFrame, width: int, block_windows: int) -> Iterator[dict[bytes, list[str]]]:
    """Distinct windows with their items, in pieces; an item's windows may lie in two pieces."""
    piece: dict[bytes, list[str]] = {}
    for item, text in benchmark.select(benchmark.item_id.cast("string"), "text").toLocalIterator():
        for w in dict.fromkeys(windows_of(words_of((text or "").encode()), width)):
            piece.setdefault(w, []).append("null" if item is None else item)
            if len(piece) >= block_windows:
                yield piece
                piece = {}
    if piece:
        yield piece


def _covered(spans: list[int], lengths: list[int]) -> int:
    total, end = 0, 0
    for s, n in sorted(zip(spans, lengths)):
        total += max(0, s + n - max(s, end))
        end = max(end, s + n)
    return total


_STATE = {"at": (ArrayType(IntegerType()), pa.list_(pa.int32())), "len": (ArrayType(IntegerType()), pa.list_(pa.int32())), "item": (ArrayType(StringType()), pa.list_(pa.string()))}


def _search_pass(rows: DataFrame, searches) -> DataFrame:
    """rows: (text, own) and, from the second pass on, at, len and item; one piece's hits are added to these three."""
    fresh = "at" not in rows.columns
    schema = StructType([rows.schema["text"], rows.schema["own"]])
    for name, (kind, _) in _STATE.items():
        schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = build(searches.value) if searches.value else []
        for batch in pieces(batches):
            texts = batch_bytes(batch.column("text"))
            empty = [[] for _ in texts]
            state = [empty, empty, empty] if fresh else [batch.column(c).to_pylist() for c in _STATE]
            out: tuple[list, list, list] = ([], [], [])
            for i, text in enumerate(texts):
                at, length, item = (list(s[i]) for s in state)
                words = words_of(text)
                found = set(item)
                for machine in machines:
                    for where, items in machine.search(words):
                        at.append(where)
                        length.append(machine.m)
                        found.update(items)
                for o, x in zip(out, (at, length, sorted(found))):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("own"), *(pa.array(o, t) for o, (_, t) in zip(out, _STATE.values()))], ["text", "own", *_STATE])

    return rows.select("text", "own", *([] if fresh else _STATE)).mapInArrow(run, schema)


def _hits(rows: DataFrame, benchmark: DataFrame, width: int, block_windows: int) -> DataFrame:
    """rows: (text, own), own being whatever the caller wants to see again."""
    spark: SparkSession = rows.sparkSession
    bound_batches(spark)
    searched = None
    for piece in window_pieces(benchmark, width, block_windows):
        searched = _search_pass(rows if searched is None else searched, spark.sparkContext.broadcast(piece))
    return searched if searched is not None else _search_pass(rows, spark.sparkContext.broadcast({}))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 100_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted), items_sha256, contaminated of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at, length, item = (batch.column(c).to_pylist() for c in _STATE)
            hit = [_covered(a, n) for a, n in zip(at, length)]
            cols = [
                batch.column("own"),
                pa.array([len(words_of(t)) for t in batch_bytes(batch.column("text"))], pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in item], pa.int64()),
                pa.array(item, pa.list_(pa.string())),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in item]),
                pa.array([h > 0 for h in hit]),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    return _hits(docs.select("text", F.col("doc_id").alias("own")), benchmark, width, block_windows).mapInArrow(finish, f"doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 100_000) -> DataFrame:
    """Rows of docs in which no window occurs; columns unchanged, nothing is shuffled."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    found = _hits(docs.select("text", F.struct(*others).alias("own")), benchmark, width, block_windows)
    return found.where("size(at) = 0").select(*["text" if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns])
