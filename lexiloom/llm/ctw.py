"""Language-model scoring by context-tree weighting.

Text is a byte sequence: lower-cased (A-Z) words joined by a blank, closed by one newline, which stands for the end. Each byte is eight
binary decisions; each decision (the bits before it in its byte) has a context tree over the `DEPTH` bytes before, with a Krichevsky-Trofimov
estimator in every node. A node's weighted probability is the mean of its own estimate and the product of its children's, so the prediction
mixes the estimates of all depths with their posterior weights. The estimates depend on counts alone, so counting the corpus in any order
gives the exact weighted tree of the training text.

Tokens are known by 64-bit hashes. Fitting: tasks count (DEPTH+1)-byte strings and send them, packed, to the part that owns their two nearest context bytes. There the subtree is
weighted from the leaves up; depths 0 and 1 (at most 256 * 255 nodes) are closed on the driver; a second pass pushes the mixture down, so that
each node holds the final probability of its bit if it is the deepest known one, and each known string its final log probability.
Scoring: rows are taken in chunks of about `chunk_bytes` of text. A chunk sends each part of the model the distinct strings and tokens that the
part owns; the part answers with their log probabilities and counts, many chunks at once; answers and rows meet again by chunk. So the model never leaves
its parts: the driver holds depths 0 and 1 only, a task one part or one chunk's answers, and what is shuffled grows with the input alone.
docs is read twice and must give its rows in the same partitions and order each time, as a table does; where it does not, the run fails.

Nulls: a null text is an empty one (just the end). Rows whose id has remainder 0 (null ids among them) are not learned from. Without
training rows every bit has probability 1/2 and base_score is that of an empty table. Repeated rows each count and are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batch_bytes, bound_batches, id_fold, materialize, partitions, pieces

DEPTH = 5
#: Training text for each part of the model, where that is more than 64 parts and no more than 4096.
PART_BYTES = 16_000_000
_PAD = b"\n" * DEPTH
#: Words of up to so many bytes are hashed all at once (the sum of a random number for each byte times one for its place), longer ones by XXH3.
WIDE = 64
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([i]), 1) for i in range(256)], np.uint64)
_PLACE = np.array([xxhash.xxh3_64_intdigest(bytes([i]), 2) | 1 for i in range(WIDE + 1)], np.uint64)
#: Hash of the end token's byte, which no word holds.
END = np.int64(xxhash.xxh3_64_intdigest(b"\n", 3) >> 1)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the (DEPTH+1)-byte strings that end at each byte of each normal text, and each text's first place among them."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(_PAD + b"".join(texts), np.uint8)
    two = data[:-1].astype(np.uint16)
    two <<= 8
    two |= data[1:]
    key = two[: len(data) - DEPTH].astype(np.int64)
    for j in range(2, DEPTH + 1, 2):
        key <<= 16
        key |= two[j : len(data) - DEPTH + j]
    for j in range(DEPTH):  # what stands before a text is no part of it
        at = starts[lengths > j] + j
        key[at] = key[at] & ((1 << 8 * (j + 1)) - 1) | int.from_bytes(_PAD[j:], "big") << 8 * (j + 1)
    return key, starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of normal texts in turn, and how many each text has."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    last = data == 10
    ends = np.flatnonzero(last | (data == 32))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    sizes = ends - starts
    place = np.arange(len(data))
    place -= np.repeat(starts, sizes + 1)
    mixed = _BYTE.take(data)
    mixed *= _PLACE.take(place, mode="clip")
    mixed[ends] = 0
    out = np.add.reduceat(mixed, starts) if len(starts) else mixed
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(sizes > WIDE):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    full = sizes > 0
    closed = np.cumsum(full)[last[ends]]
    return out[full].view(np.int64), np.diff(closed, prepend=0)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted. np.unique hashes, which takes several times as long here."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))] if len(keys) else keys


def parts_of(texts: list[bytes], most: int = 500_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1]) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([start, [len(keys)]])) if counts is None else np.add.reduceat(counts, start) if len(keys) else counts
    return keys[start], n.astype(np.int64)


def owner(keys: np.ndarray, spread: int) -> np.ndarray:
    pair = ((keys >> 8) & 0xFFFF).astype(np.uint64)
    return (((pair * np.uint64(2654435761)) >> np.uint64(7)) % np.uint64(spread)).astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8.0
    s = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    product = np.ones_like(y)
    for i in range(8):
        product *= x + i
    return s - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 1.1447298858494002


def leaves(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node key, zeros, ones) at the full depth. A node key is the context's bytes, then the bits so far behind a leading 1."""
    context, symbol = grams >> 8, grams & 0xFF
    keys = np.concatenate([(context << 8) | (1 << j) | (symbol >> (8 - j)) for j in range(8)])
    bits = np.concatenate([(symbol >> (7 - j)) & 1 for j in range(8)])
    keys, at = np.unique(keys, return_inverse=True)
    every = np.tile(counts, 8)
    ones = np.bincount(at, every * bits, len(keys))
    return keys, np.bincount(at, every, len(keys)) - ones, ones


def weigh(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, depth: int, until: int) -> list[dict]:
    """Levels from `depth` up to `until`: dicts of key, zeros, ones, logw (weighted), below (children's product), up (index of the parent)."""
    own = log_kt(zeros, ones)
    levels = [{"key": keys, "zeros": zeros, "ones": ones, "own": own, "logw": own, "stop": np.ones(len(keys))}]
    for d in range(depth - 1, until - 1, -1):
        child = levels[-1]
        parent, up = np.unique(child["key"] & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        child["up"] = up
        z, o, below = (np.bincount(up, child[c], len(parent)) for c in ("zeros", "ones", "logw"))
        levels.append(_close(parent, z, o, below))
    return levels


def _close(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> dict:
    own = log_kt(zeros, ones)
    logw = np.log(0.5) + np.logaddexp(own, below)
    return {"key": key, "zeros": zeros, "ones": ones, "own": own, "logw": logw, "stop": np.exp(np.log(0.5) + own - logw)}


def descend(level: dict, mixed: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """mixed, rest: of each node's parent. The probability of a one gathered so far, and the weight left for deeper nodes."""
    p = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1.0)
    return mixed + rest * level["stop"] * p, rest * (1 - level["stop"])


def _logit(p: np.ndarray) -> np.ndarray:
    return (np.log(p) - np.log1p(-p)).astype(np.float32)


def top_model(pairs: dict) -> dict:
    """pairs: depth-1 sums (key, zeros, ones, below). Closes depths 1 and 0; returns their nodes and what depth 2 starts from."""
    one = _close(*(pairs[c] for c in ("key", "zeros", "ones", "below")))
    parent, up = np.unique(one["key"] & 0xFF, return_inverse=True)
    root = _close(parent, *(np.bincount(up, one[c], len(parent)) for c in ("zeros", "ones", "logw")))
    mixed0, rest0 = descend(root, np.zeros(len(parent)), np.ones(len(parent)))
    mixed1, rest1 = descend(one, mixed0[up], rest0[up])
    nodes = np.concatenate([root["key"], one["key"] | (1 << 56)])
    return {"key": one["key"], "mixed": mixed1, "rest": rest1, "nodes": nodes, "logits": _logit(np.concatenate([mixed0 + rest0 / 2, mixed1 + rest1 / 2]))}


def part_model(grams: np.ndarray, counts: np.ndarray, top: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(strings, log10 probabilities, node keys with their depth on top, logits) of a part."""
    levels = weigh(*leaves(grams, counts), DEPTH, 2)[::-1]
    at = np.searchsorted(top["key"], levels[0]["key"] & 0xFFFF)
    mixed, rest = top["mixed"][at], top["rest"][at]
    nodes, logits, deep = [], [], None
    for d, level in enumerate(levels, 2):
        mixed, rest = descend(level, mixed, rest)
        nodes.append(level["key"] | (d << 56))
        logits.append(_logit(mixed + rest / 2))
        deep = mixed
        if d < DEPTH:
            below = levels[d - 1]
            mixed, rest = mixed[below["up"]], rest[below["up"]]
    context, symbol = grams >> 8, grams & 0xFF
    total = np.zeros(len(grams))
    for j in range(8):
        p = deep[np.searchsorted(levels[-1]["key"], (context << 8) | (1 << j) | (symbol >> (8 - j)))]
        total += np.log10(np.where((symbol >> (7 - j)) & 1, p, 1 - p))
    return grams, total.astype(np.float32), np.concatenate(nodes), np.concatenate(logits)


class Lookup:
    """Open-addressing table from distinct int64 keys to float values, keys and values side by side in the slots; free slots hold key 0 and no value."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, np.nan, values.dtype)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = np.isnan(self.values[at])
            self.keys[at[free]] = keys[left[free]]  # of several for a slot the last stays
            self.values[at[free]] = values[left[free]]
            off = (self.keys[at] != keys[left]) | np.isnan(self.values[at])
            left, at = left[off], (at[off] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        home = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        home >>= np.uint64(64 - self.bits)
        return home.view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Not a number where a key is missing."""
        at = self._home(keys)
        out = self.values.take(at)
        left = np.flatnonzero(self.keys.take(at) != keys)
        taken = ~np.isnan(out[left])
        out[left] = np.nan
        left = left[taken]
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            value = self.values[at]
            hit = self.keys[at] == keys[left]
            out[left[hit]] = value[hit]
            go = ~hit & ~np.isnan(value)
            left, at = left[go], at[go]
        return out


class Model:
    """A part of the tree: known strings with their log10 probabilities, and nodes (with those of depths 0 and 1) for the others."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray, nodes: np.ndarray, logits: np.ndarray):
        self.known = Lookup(grams, logs)
        order = np.argsort(nodes)
        self.nodes, self.logits = nodes[order], logits[order]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out = self.known.get(keys).astype(np.float64)
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            out[new] = self._unknown(keys[new])
        return out

    def _node(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.nodes):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.nodes, keys), len(self.nodes) - 1)
        return np.where(self.nodes[at] == keys, self.logits[at], np.nan)

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        context, symbol = keys >> 8, keys & 0xFF
        total = np.zeros(len(keys))
        for j in range(8):
            node = (context << 8) | (1 << j) | (symbol >> (8 - j))
            logit, left = np.zeros(len(keys)), np.arange(len(keys))
            for d in range(DEPTH, -1, -1):
                got = self._node((node[left] & ((1 << 8 * (d + 1)) - 1)) | (d << 56))
                known = ~np.isnan(got)
                logit[left[known]] = got[known]
                left = left[~known]
                if not len(left):
                    break
            total -= np.logaddexp(0, np.where((symbol >> (7 - j)) & 1, -logit, logit)) / np.log(10)
        return total


def word_owner(hashes: np.ndarray, spread: int) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(spread)).astype(np.int64)


_COUNTS = "kind int, part long, keys binary, counts binary"


def _binaries(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The values between each two places of cut, packed."""
    offsets = (cut * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all rows of a packed column, end to end."""
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), kind)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of rows with equal values starts and ends."""
    n = len(columns[0])
    cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if n else []
    return list(zip([0, *cut], [*cut, n])) if n else []


def _rows(kind: int, part: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part met: (kind, part) and its values of the columns, packed."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    cut = np.append(first, len(part))
    packed = [_binaries(c[order], cut) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind, np.int32)), pa.array(part[first]), *packed], ["kind", "part", *columns])


def _pooled(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def _count(train: DataFrame, spread: int) -> DataFrame:
    """(kind, part, keys, counts): packed counts of each task, of byte strings (kind 0) and of tokens (kind 1)."""

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return _rows(kind, (owner, word_owner)[kind](keys, spread), keys=keys, counts=counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for batch in pieces(batches):
            texts = [normal(t) for t in batch_bytes(batch.column("text"))]
            for s, e in parts_of(texts):
                tokens = np.concatenate([word_hashes(texts[s:e])[0], np.full(e - s, END)])
                for kind, keys in enumerate((strings(texts[s:e])[0], tokens)):
                    held[kind].append(tally(keys))
                    if sum(len(k) for k, _ in held[kind]) > 3_000_000:
                        held[kind] = [_pooled(held[kind])]
                        if len(held[kind][0][0]) > 2_000_000:
                            yield rows(kind, *held[kind].pop())
        for kind in (0, 1):
            if held[kind]:
                yield rows(kind, *_pooled(held[kind]))

    return train.select("text").mapInArrow(run, _COUNTS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, kind): one row for each."""

    def close(now, held):
        keys, counts = _pooled(held)
        return pa.RecordBatch.from_arrays([pa.array([now[1]], pa.int32()), pa.array([now[0]], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["kind", "part", "keys", "counts", "n_keys", "total"])

    now, held, size, most = None, [], 0, 4_000_000
    for batch in batches:
        for kind, part, k, c in zip(*(batch.column(n).to_pylist() for n in ("kind", "part", "keys", "counts"))):
            if (part, kind) != now and held:
                yield close(now, held)
                held, size, most = [], 0, 4_000_000
            now = (part, kind)
            held.append((np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)))
            size += len(held[-1][0])
            if size > most:  # after a merge, not before as much again has come
                held = [_pooled(held)]
                size = len(held[0][0])
                most = max(most, 2 * size)
    if held:
        yield close(now, held)


_MODEL = "kind int, part long, a binary, b binary, c binary, d binary"


def fit(train: DataFrame) -> tuple[DataFrame, dict, int, int, int]:
    """The model table, depths 0 and 1 (see top_model), the number of parts, and the number of tokens and of distinct tokens.

    Rows of the table: a part of the tree (kind 0: strings, logs, nodes, logits) or of the tokens (kind 1: hashes, counts)."""
    spark = train.sparkSession
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spread = max(64, partitions(spark), min(4096, size // PART_BYTES))
    counted = _count(train, spread).repartition(partitions(spark), "part").sortWithinPartitions("part", "kind")
    parts = materialize(counted.mapInArrow(_merged, _COUNTS + ", n_keys long, total long"), "ctw-counts")
    tree = parts.where("kind = 0").select("part", "keys", "counts")

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            g, c = (np.frombuffer(batch.column(n)[0].as_py(), np.int64) for n in ("keys", "counts"))
            two = weigh(*leaves(g, c), DEPTH, 2)[-1]
            one, up = np.unique(two["key"] & 0xFFFF, return_inverse=True)
            cols = [one, *(np.bincount(up, two[n], len(one)) for n in ("zeros", "ones", "logw"))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "zeros", "ones", "below"])

    sums = tree.mapInArrow(upward, "key long, zeros double, ones double, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).orderBy("key").collect()  # at most 256 * 255 rows
    top = top_model({c: np.array([r[c] for r in sums], np.int64 if c == "key" else np.float64) for c in ("key", "zeros", "ones", "below")})
    shared = spark.sparkContext.broadcast(top)

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            g, c = (np.frombuffer(batch.column(n)[0].as_py(), np.int64) for n in ("keys", "counts"))
            blobs = [x.tobytes() for x in part_model(g, c, shared.value)]
            cols = [pa.array([0], pa.int32()), batch.column("part"), *(pa.array([b], pa.binary()) for b in blobs)]
            yield pa.RecordBatch.from_arrays(cols, ["kind", "part", "a", "b", "c", "d"])

    none = F.lit(b"")
    words = parts.where("kind = 1").select("kind", "part", F.col("keys").alias("a"), F.col("counts").alias("b"), none.alias("c"), none.alias("d"))
    model = materialize(tree.mapInArrow(downward, _MODEL).unionByName(words), "ctw-model")
    totals = parts.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
    return model, top, spread, totals[0], totals[1]


def _numbered(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Slices of a partition and the chunk of each row: the rows in order, cut into chunks of about so many bytes of text."""
    number = size = 0
    for batch in pieces(batches):
        out = []
        for task, n in zip(batch.column("task").to_pylist(), batch.column("n").to_pylist()):
            if size and size + n > chunk_bytes:
                number, size = number + 1, 0
            size += n
            out.append(task << 32 | number)
        yield np.array(out, np.int64), batch


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.spark_partition_id().alias("task"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "doc_id", "text")


def _chunked(docs: DataFrame, kind: str, chunk_bytes: int) -> DataFrame:
    """(chunk, doc_id, text) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks, batch in _numbered(batches, chunk_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(chunks), batch.column("doc_id"), batch.column("text")], ["chunk", "doc_id", "text"])

    return _sized(docs).mapInArrow(run, f"chunk long, doc_id {kind}, text string")


def _asked(docs: DataFrame, spread: int, chunk_bytes: int) -> DataFrame:
    """(kind, part, chunk, keys): the distinct strings (kind 0) and token hashes (kind 1) of a chunk, packed, by the part that owns them."""

    def ask(chunk: int, held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, own in enumerate((owner, word_owner)):
            keys = distinct(np.concatenate(held[kind]))
            rows = _rows(kind, own(keys, spread), keys=keys)
            yield rows.append_column("chunk", pa.array(np.full(rows.num_rows, chunk))).select(["kind", "part", "chunk", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [[], []]
        for chunks, batch in _numbered(batches, chunk_bytes):
            texts = [normal(t) for t in batch_bytes(batch.column("text"))]
            for a, b in _runs(chunks):
                if int(chunks[a]) != now:
                    if now is not None:
                        yield from ask(now, held)
                    now, held = int(chunks[a]), [[], [np.array([END])]]
                for s, e in parts_of(texts[a:b]):
                    for kind, keys in enumerate((strings(texts[a + s : a + e])[0], word_hashes(texts[a + s : a + e])[0])):
                        held[kind].append(distinct(keys))
                        if sum(map(len, held[kind][1:])) > max(1_000_000, len(held[kind][0])):
                            held[kind] = [distinct(np.concatenate(held[kind]))]
        if now is not None:
            yield from ask(now, held)

    return _sized(docs).select("task", "n", "text").mapInArrow(run, "kind int, part long, chunk long, keys binary")


def _answers(batches: Iterator[pa.RecordBatch], head: dict) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, part), each part's model before its questions: the questions of all chunks in a slice are answered at once."""
    now, machine = None, None
    for batch in pieces(batches):
        kinds, parts, chunks = (batch.column(c).to_numpy() for c in ("kind", "part", "chunk"))
        out = []
        for s, e in _runs(kinds, parts):
            if (kinds[s], parts[s]) != now:
                now = kinds[s], parts[s]
                known = batch.slice(s, int(chunks[s] < 0))
                fields = lambda *types: [_unpacked(known.column(c), t) for c, t in zip("abcd", types)]  # noqa: B023,E731
                if kinds[s] == 0:
                    grams, logs, nodes, logits = fields(np.int64, np.float32, np.int64, np.float32)
                    machine = Model(grams, logs, np.concatenate([head["nodes"], nodes]), np.concatenate([head["logits"], logits]))
                else:
                    hashes, counts = fields(np.int64, np.int64)
                    machine = Lookup(hashes, counts.astype(np.float64))
            s += int(chunks[s] < 0)
            if s < e:
                column = batch.column("a").slice(s, e - s)
                keys = _unpacked(column, np.int64)
                values = machine.log10(keys).astype(np.float32) if kinds[s] == 0 else np.nan_to_num(machine.get(keys)).astype(np.int64)
                cut = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64) // 8])
                out.append(pa.RecordBatch.from_arrays([batch.column("chunk").slice(s, e - s), batch.column("kind").slice(s, e - s), column, _binaries(values, cut)], ["chunk", "kind", "keys", "values"]))
        yield from out


def _answered(model: DataFrame, asked: DataFrame, top: dict) -> DataFrame:
    """(chunk, kind, keys, values): log10 probabilities (float32) of strings, counts (int64) of tokens."""
    spark = model.sparkSession
    blank = F.lit(None).cast("binary")
    questions = asked.select("kind", "part", "chunk", F.col("keys").alias("a"), *[blank.alias(c) for c in "bcd"])
    both = model.select("kind", "part", F.lit(-1).cast("long").alias("chunk"), "a", "b", "c", "d").unionByName(questions)
    shared = spark.sparkContext.broadcast({n: top[n] for n in ("nodes", "logits")})  # at most 257 * 255 nodes

    dealt = both.repartition(partitions(spark), "kind", "part").sortWithinPartitions("kind", "part", "chunk")
    return dealt.mapInArrow(lambda batches: _answers(batches, shared.value), "chunk long, kind int, keys binary, values binary")


def score_documents(docs: DataFrame, folds: int = 10, chunk_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row; rows with remainder 0 are held
    out of fitting. bits_per_byte: the code length of the lower-cased words, the blanks between them and the end, over their n_bytes."""
    spark = docs.sparkSession
    bound_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    model, top, spread, tokens, known_tokens = fit(docs.where(id_fold("doc_id", folds) != 0))
    chunked = _chunked(docs, id_type, chunk_bytes)
    answers = _answered(model, _asked(docs, spread, chunk_bytes), top)
    rows = chunked.select("chunk", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("values"), "doc_id", "text")
    both = answers.select("*", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("string").alias("text")).unionByName(rows)
    base = np.log10(tokens + 0.1 * (known_tokens + 1))

    def found(table: Lookup, keys: np.ndarray) -> np.ndarray:
        values = table.get(keys)
        if np.isnan(values).any():
            raise ValueError("docs gave other rows when it was read again; score a stored table")
        return values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, tables = None, [[], []], None
        for batch in pieces(batches, 256):
            kinds, chunks = (batch.column(c).to_numpy() for c in ("kind", "chunk"))
            for start, end in _runs(kinds, chunks):
                if chunks[start] != now:
                    now, answers, tables = chunks[start], [[], []], None
                kind, own = kinds[start], batch.slice(start, end - start)
                if kind < 2:
                    answers[kind].append([_unpacked(own.column(c), t) for c, t in (("keys", np.int64), ("values", (np.float32, np.int64)[kind]))])
                    continue
                if tables is None:
                    tables = []
                    for t in (np.float32, np.float64):
                        mine = answers.pop(0)
                        tables.append(Lookup(np.concatenate([k for k, _ in mine] or [np.zeros(0, np.int64)]), np.concatenate([v for _, v in mine] or [np.zeros(0)]).astype(t)))
                        del mine
                    answers = [[], []]
                texts = [normal(t) for t in batch_bytes(own.column("text"))]
                n = len(texts)
                end_count = found(tables[1], np.array([END]))[0]
                counted, known, plain, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                for s, e in parts_of(texts):
                    keys, starts = strings(texts[s:e])
                    score[s:e] = np.add.reduceat(found(tables[0], keys), starts, dtype=np.float64)
                    hashes, lengths = word_hashes(texts[s:e])
                    counts, row = found(tables[1], hashes), np.repeat(np.arange(e - s), lengths)
                    counted[s:e] = lengths + 1
                    known[s:e] = np.bincount(row, counts > 0, e - s) + (end_count > 0)
                    plain[s:e] = np.bincount(row, np.log10(counts + 0.1), e - s) + np.log10(end_count + 0.1) - counted[s:e] * base
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(counted), pa.array(known), pa.array(plain), pa.array(score), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    dealt = both.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "kind")
    out = dealt.mapInArrow(run, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = -F.col("score") * float(np.log2(10)) / F.col("n_bytes")
    return out.select("doc_id", (id_fold("doc_id", folds) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
