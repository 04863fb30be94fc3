"""Packing in space-filling-curve order.

Each document's token ids are hashed to signs in a few dimensions and summed (a random projection of its token counts); the scaled sums are
cut into a grid and numbered along a Hilbert curve, so documents with like tokens get near keys. Documents are range-sorted by key and laid
end to end; every `capacity` tokens end a sequence. Only the last sequence can have padding.

Range sorting deals only (row, key, length); ties in the key are split by row, so a key that a third of the rows hold spreads over tasks.
Each range partition numbers its tokens from 0; the partitions' sums (one number each) give the offsets. Token ids move once, by row.

Tokens: tiktoken with the ranks of the byte-level BPE vocabulary, which gives the ids of tokenizers' file of that vocabulary. Without two
neighbouring white-space characters no token crosses a blank, so such texts are looked up blank by blank in a cache; others go whole. A
special token's string in a text becomes its id, and the text before and after it is encoded by itself. Each document ends with id 0.

Nulls: a null text is an empty one (one piece with the end id). A null doc_id is kept. Repeated rows are packed each. Empty table: no pieces.
Very long texts are tokenized whole and cut into as many pieces as they fill. Other columns of docs are not read, so names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, materialize, partitions, pieces
from .secrets import load_encoder

DIMENSIONS, GRID_BITS = 4, 8
_DOUBLE = re.compile(r"\s\s")
#: The vocabulary's added tokens.
SPECIAL = {"<|endoftext|>": 50256}


class Tokens:
    """Text to little-endian 16-bit ids."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] = SPECIAL, cache_size: int = 400_000):
        encode = load_encoder(ranks_path, pattern).encode_ordinary
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.special_ids = {t: np.array([i], "<u2").tobytes() for t, i in special.items()}

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.array(encode(piece), "<u2").tobytes()
                if len(piece) <= 64:
                    if len(self) >= cache_size:
                        self.clear()
                    self[piece] = ids
                return ids

        self.cache = Cache()
        self.encode = encode

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special_ids):
            return b"".join(self.special_ids[x] if x in self.special_ids else self.ordinary(x) for x in self.special.split(text))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if _DOUBLE.search(text):
            return np.array(self.encode(text), "<u2").tobytes()
        first, *rest = text.split(" ")
        cache = self.cache
        return cache[first] + b"".join([cache[" " + p] for p in rest]) if text else b""


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows x dimensions, 0 <= x < 2^bits), after Skilling's transposed form."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def projection(vocabulary: int, seed: int = 7) -> np.ndarray:
    """Signs by dimension and token."""
    signs = np.random.default_rng(seed).integers(0, 2, (vocabulary, DIMENSIONS), dtype=np.int8)
    return np.ascontiguousarray((2 * signs - 1).astype(np.float32).T)


def curve_keys(ids: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    lengths = np.array([len(x) for x in ids])
    sums = np.zeros((len(ids), DIMENSIONS))
    full = np.flatnonzero(lengths)
    if len(full):
        joined = np.concatenate([ids[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        for d in range(DIMENSIONS):
            sums[full, d] = np.add.reduceat(signs[d].take(joined), starts)  # whole numbers, exact up to 2^24 tokens
    share = sums / np.maximum(lengths, 1)[:, None]  # the mean direction does not depend on the length
    cells = np.clip(((share + 0.5) * (1 << GRID_BITS)).astype(np.int64), 0, (1 << GRID_BITS) - 1)
    return hilbert_key(cells, GRID_BITS)


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 0, special: dict[str, int] = SPECIAL) -> DataFrame:
    """Pieces of all rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (array<int>)."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, signs, end = Tokens(ranks_path, pattern, special), projection(1 << 16), np.array([end_id], "<u2").tobytes()
        for batch in pieces(batches):
            ids, start = [], 0
            texts = batch.column("text").to_pylist()
            while start < len(texts):  # in parts of some MB, whatever the texts' lengths
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < 2_000_000):
                    size += len(texts[stop] or "")
                    stop += 1
                ids = [tokens.ids(t or "") for t in texts[start:stop]]
                keys = curve_keys([np.frombuffer(x, "<u2") for x in ids], signs)
                cols = [batch.column("row").slice(start, stop - start), batch.column("doc_id").slice(start, stop - start), pa.array([len(x) // 2 + 1 for x in ids], pa.int64()), pa.array(keys), pa.array([x + end for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n", "curve", "ids"])
                start = stop

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = materialize(source.mapInArrow(tokenize, f"row long, doc_id {kind}, n long, curve long, ids binary"), "tokens")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = np.cumsum(n) + total
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ends - n), pa.array(np.full(len(n), part, np.int64)), batch.column("n")], ["at_row", "local", "part", "n"])
            total = int(ends[-1]) if len(n) else total

    ordered = rows.select("row", "curve", "n").repartitionByRange(partitions(spark), "curve", "row").sortWithinPartitions("curve", "row")
    places = materialize(ordered.mapInArrow(number, "at_row long, local long, part long, n long"), "places")
    totals = sorted((r.part, r.n) for r in places.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one number a partition
    base, at = [], 0
    for part, n in totals:
        base.append((part, at))
        at += n
    bases = F.broadcast(spark.createDataFrame(base, "part long, base long").coalesce(1))
    placed = places.join(bases, "part").select("at_row", (F.col("local") + F.col("base")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            out: list[list] = [[] for _ in range(8)]
            for doc, at, data in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(data, "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    piece = ids[start : start + capacity - (at + start) % capacity]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), (at + start) // capacity, (at + start) % capacity, piece.astype(np.int32))
                    for o, x in zip(out, row):
                        o.append(x)
                    start += len(piece)
            types = [batch.column("doc_id").type, *[pa.int64()] * 6, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    joined = rows.join(placed, rows.row == placed.at_row).select("doc_id", "at", "ids")
    return joined.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
