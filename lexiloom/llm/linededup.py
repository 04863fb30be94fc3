"""Line dedup with a segment-partition edit join.

Lines (split at \\n, trimmed, A-Z lower-cased) of at least `min_chars` characters that are equal, or within edit distance `distance` through a chain
of such lines, form a class; the first occurrence of a class (smallest doc_id, then line number) stays and all others go. Shorter lines stay.
With min_chars=1, as in the queries, every line that is not blank counts. Lines of at most `distance` characters, which are all within the distance
of each other, form a class only where they are equal; all other lines are joined, short ones too.

The join: a line is cut into distance+1 segments, of which a line within the distance must hold one unchanged, at a place the length
difference narrows down. Each line is indexed under (its length, segment number, segment) and probes for its own and each shorter length.
Keys travel as packed 64-bit arrays, sorted by task; only keys that two different lines share go on, and only for those lines is the text
looked up. Candidates are verified by a banded bit-parallel edit distance. Inside a key only a spanning forest of links is emitted; keys of more
than `bucket` lines are cut into blocks, each pair of blocks a task.

Equal lines are merged before the join by a 128-bit hash, with map-side aggregation, so a line that every document holds is one row.
Lengths and distances count characters (code points); a line of ASCII is handled as bytes.

Nulls: a null text has no lines and stays null. A null doc_id sorts first. Rows with equal doc_id and text are one document and get
equal results; rows of one doc_id with different texts come in order of a hash of the text. An empty table gives an empty result. Very long
texts and lines are taken whole. A document that loses all its lines keeps an empty text here (drop_empty=True drops it). Other columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_bytes, bound_batches, materialize, partitions, pieces
from .graph import connected_components


def lines_of(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, normal form) of the lines long enough to count."""
    return [(i, x) for i, line in enumerate(text.split(b"\n")) if len(line) >= min_chars and len(x := line.strip().lower()) >= min_chars and (min_chars == 1 or len(characters(x)) >= min_chars)]


def characters(line: bytes) -> bytes | str:
    """A line with one element a character: bytes of ASCII as they are, others decoded."""
    return line if line.isascii() else line.decode("utf-8", "surrogateescape")


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the parts; the last ones are longer by one where it does not divide."""
    short, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = short + (i >= parts - more)
        out.append((at, n))
        at += n
    return out


def probe_places(own: int, other: int, distance: int) -> list[tuple[int, int, int]]:
    """(segment, start, length): substrings of a line of length `own` that can equal a segment of a line of length `other` (not longer).

    Start positions as the multi-match rule narrows them from the left and from the right."""
    gap, out = own - other, []
    for i, (at, n) in enumerate(segments(other, distance + 1)):
        low = max(0, at - i, at + gap - (distance - i))
        high = min(own - n, at + i, at + gap + (distance - i))
        out += [(i, s, n) for s in range(low, high + 1)]
    return out


def within(a: bytes | str, b: bytes | str, distance: int) -> bool:
    """Whether the edit distance is at most `distance`: common ends go, then diagonals within the distance are kept as bits, one word an error count."""
    if abs(len(a) - len(b)) > distance:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= distance
    full = (1 << (2 * distance + 1)) - 1
    rows = [((1 << (e + 1)) - 1) << distance & full for e in range(distance + 1)]
    for i, x in enumerate(a):
        match = 0
        for d in range(2 * distance + 1):
            j = i + d - distance
            if 0 <= j < len(b) and b[j] == x:
                match |= 1 << d
        now = [rows[0] & match]
        for e in range(1, distance + 1):
            now.append((rows[e] & match | rows[e - 1] | rows[e - 1] >> 1 | now[e - 1] << 1) & full)
        rows = now
        if not rows[-1]:
            return False
    return bool(rows[distance] >> (len(b) - len(a) + distance) & 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash128(line: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line)
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def row_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, dk, line) of each line that counts; dk is the hash of the document's text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h1, h2, at, line = [], [], [], []
            for i, text in enumerate(batch_bytes(batch.column("text"))):
                for n, x in lines_of(text, min_chars):
                    a, b = _hash128(x)
                    h1.append(a)
                    h2.append(b)
                    at.append(i)
                    line.append(n)
            at_ = pa.array(at, pa.int64())
            cols = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), batch.column("doc_id").take(at_), batch.column("dk").take(at_), pa.array(line, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "doc_id", "dk", "line"])

    return docs.select("doc_id", "text", row_key().alias("dk")).mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, dk long, line int")


def _key_blobs(docs: DataFrame, distance: int, min_chars: int, spread: int) -> DataFrame:
    """(part, keys, ids): packed keys and line ids, dealt by key. The key's lowest bit is 1 for a probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, seen, keys, ids, plans = xxhash.xxh3_64_intdigest, set(), [], [], {}

        def flush():
            k, i = np.array(keys, np.uint64), np.array(ids, np.int64)
            part = ((k >> np.uint64(1)) % np.uint64(spread)).astype(np.int64)
            order = np.lexsort((k, part))
            k, i, part = k[order], i[order], part[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            for s, e in zip(cut[:-1], cut[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[s])], pa.int64()), pa.array([k[s:e].tobytes()], pa.binary()), pa.array([i[s:e].tobytes()], pa.binary())], ["part", "keys", "ids"])

        for batch in pieces(batches):
            for text in batch_bytes(batch.column("text")):
                for _, x in lines_of(text, min_chars):
                    a, _ = _hash128(x)
                    if a in seen:
                        continue
                    seen.add(a)
                    x = characters(x)
                    n, encode = len(x), isinstance(x, str)
                    if n <= distance:
                        continue
                    plan = plans.get(n)
                    if plan is None:
                        plan = [(s, s + m, (n << 8) + i, 0) for i, (s, m) in enumerate(segments(n, distance + 1))]
                        plan += [(s, s + m, (o << 8) + i, 1) for o in range(max(min_chars, distance + 1, n - distance), n + 1) for i, s, m in probe_places(n, o, distance)]
                        plans[n] = plan
                    for s, e, seed, role in plan:
                        keys.append(digest(x[s:e].encode("utf-8", "surrogateescape") if encode else x[s:e], seed) >> 1 << 1 | role)
                        ids.append(a)
                if len(keys) > 3_000_000:
                    yield from flush()
                    keys, ids, seen = [], [], set()
        if keys:
            yield from flush()

    return docs.select("text").mapInArrow(run, "part long, keys binary, ids binary")


def _shared_keys(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Keys that an index entry and another line share: rows (key, block_a, block_b, id). Input sorted by part."""

    def solve(keys: list[bytes], ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        k, i = np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(ids), np.int64)
        order = np.argsort(k, kind="stable")
        k, i = k[order], i[order]
        whole = k >> np.uint64(1)
        start = np.concatenate([[0], np.flatnonzero(whole[1:] != whole[:-1]) + 1, [len(k)]])
        first = np.repeat(i[start[:-1]], np.diff(start))
        mixed = np.add.reduceat((i != first).astype(np.int64), start[:-1]) > 0
        index = np.add.reduceat((k & np.uint64(1) == 0).astype(np.int64), start[:-1]) > 0
        out: list[list] = [[], [], [], []]
        for g in np.flatnonzero(mixed & index):
            members = np.unique(i[start[g] : start[g + 1]])
            key = int(whole[start[g]].astype(np.int64))
            blocks = [members[s : s + bucket] for s in range(0, len(members), bucket)]
            for a in range(len(blocks)):
                for b in range(a, len(blocks)):
                    if a == b and len(blocks) > 1 and len(blocks[a]) < 2:
                        continue
                    rows = blocks[a] if a == b else np.concatenate([blocks[a], blocks[b]])
                    out[0] += [key] * len(rows)
                    out[1] += [a] * len(rows)
                    out[2] += [b] * len(rows)
                    out[3] += rows.tolist()
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["key", "a", "b", "id"])
                out = [[], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["key", "a", "b", "id"])

    part, keys, ids = None, [], []
    for batch in batches:
        for p, k, i in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "ids"))):
            if p != part and keys:
                yield from solve(keys, ids)
                keys, ids = [], []
            part = p
            keys.append(k)
            ids.append(i)
    if keys:
        yield from solve(keys, ids)


def forest(lines: list[str], distance: int) -> list[tuple[int, int]]:
    """Links that connect whatever pairs within the distance connect; a line is compared with no more of a group once it is linked to it."""
    root, links, groups = list(range(len(lines))), [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, x in enumerate(lines):
        joined = []
        for g in groups:
            if (j := next((j for j in g if within(lines[j], x, distance)), None)) is not None:
                links.append((j, i))
                root[find(i)] = find(j)
                joined.append(g)
        kept = [g for g in groups if not any(g is h for h in joined)]
        merged = [j for g in joined for j in g] + [i]
        groups = [*kept, merged]
    return links


def _verify(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, id, line) sorted by (key, a, b): links (u, v)."""
    now, ids, lines = None, [], []

    def links():
        found = forest(lines, distance) if len(lines) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["u", "v"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("key", "a", "b", "id", "text")]
        for k, a, b, i, x in zip(*cols):
            if (k, a, b) != now:
                if lines:
                    yield links()
                now, ids, lines = (k, a, b), [], []
            if not ids or ids[-1] != i:
                ids.append(i)
                lines.append(x.decode("utf-8", "surrogateescape"))
    if lines:
        yield links()


def near_line_links(docs: DataFrame, distance: int = 2, min_chars: int = 30, bucket: int = 2000, broadcast_ids: int = 2_000_000) -> DataFrame:
    """Links (u, v) between the 64-bit ids of different lines within the distance."""
    spark = docs.sparkSession
    spread = 4 * partitions(spark)
    blobs = _key_blobs(docs, distance, min_chars, spread).repartition(partitions(spark), "part").sortWithinPartitions("part")
    shared = materialize(blobs.mapInArrow(lambda b: _shared_keys(b, bucket), "key long, a long, b long, id long"), "line-keys")
    wanted = shared.select("id").distinct()
    known = None
    if wanted.count() <= broadcast_ids:  # 8 bytes an id: 16 MB at most; above that the lines are joined by id
        known = spark.sparkContext.broadcast(np.sort(np.array([r.id for r in wanted.toLocalIterator()], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            out: dict[int, bytes] = {}
            for text in batch_bytes(batch.column("text")):
                for _, x in lines_of(text, min_chars):
                    out[_hash128(x)[0]] = x
            ids = np.fromiter(out, np.int64, len(out))
            if known is not None:
                at = np.searchsorted(known.value, ids)
                ids = ids[known.value[np.minimum(at, len(known.value) - 1)] == ids] if len(known.value) else ids[:0]
            new = [i for i in ids.tolist() if i not in seen]
            if len(seen) > 500_000:
                seen = set()
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([out[i] for i in new], pa.binary())], ["id", "text"])

    texts = docs.select("text").mapInArrow(run, "id long, text binary")
    if known is None:
        texts = texts.join(wanted, "id", "left_semi")
    bucketed = shared.join(texts, "id").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "id")
    return bucketed.mapInArrow(lambda b: _verify(b, distance), "u long, v long")


def removed_lines(docs: DataFrame, distance: int = 2, min_chars: int = 30) -> DataFrame:
    """(doc_id, dk, removed): the numbers of the lines to remove from each document that loses any."""
    bound_batches(docs.sparkSession)
    seen = materialize(_occurrences(docs, min_chars), "lines")
    parts = connected_components(near_line_links(docs, distance, min_chars))
    first = F.min(F.struct("doc_id", "dk", "line"))
    classes = seen.groupBy("h1", "h2").agg(first.alias("first"), F.count("*").alias("n"))
    named = classes.join(parts, classes.h1 == parts.node, "left").drop("node")
    linked = named.where("component is not null").groupBy("component").agg(F.min("first").alias("group_first"))
    plain = named.where("component is null and n > 1").select("h1", "h2", "first")
    near = named.where("component is not null").join(linked, "component").select("h1", "h2", F.col("group_first").alias("first"))
    repeats = plain.unionByName(near)
    gone = seen.join(repeats, ["h1", "h2"]).where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.dk") == F.col("dk")) & (F.col("first.line") == F.col("line"))))
    return gone.groupBy("doc_id", "dk").agg(F.array_sort(F.collect_set("line")).alias("removed"))  # at most a document's own lines


def _joined(docs: DataFrame, distance: int, min_chars: int) -> DataFrame:
    gone = removed_lines(docs, distance, min_chars).select(F.col("doc_id").alias("_lx_id"), F.col("dk").alias("_lx_dk"), F.col("removed").alias("_lx_removed"))
    packed = docs.select(F.struct("*").alias("_lx"))
    return packed.join(gone, F.col("_lx.doc_id").eqNullSafe(F.col("_lx_id")) & (row_key("_lx.text") == F.col("_lx_dk")), "left")


def _kept_text() -> Column:
    keep = F.filter(F.split("_lx.text", "\n", -1), lambda x, i: ~F.array_contains("_lx_removed", i))
    return F.when(F.col("_lx_removed").isNull(), F.col("_lx.text")).otherwise(F.array_join(keep, "\n"))


def dedup_lines(docs: DataFrame, distance: int = 2, min_chars: int = 30) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers), text (what stays) of every row."""
    none = F.array().cast("array<int>")
    text = F.col("_lx.text")
    lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    return _joined(docs, distance, min_chars).select(F.col("_lx.doc_id").alias("doc_id"), lines.cast("long").alias("n_lines"), F.size(F.coalesce("_lx_removed", none)).cast("long").alias("n_removed"), F.coalesce("_lx_removed", none).alias("removed"), _kept_text().alias("text"))


def without_repeated_lines(docs: DataFrame, distance: int = 2, min_chars: int = 30, drop_empty: bool = True) -> DataFrame:
    """docs with the repeated lines taken out of text (and n_chars, where it is a column, set anew); columns unchanged.

    drop_empty: a document that had text and loses all but blank lines goes."""
    joined = _joined(docs, distance, min_chars).withColumn("_lx_text", _kept_text())
    if drop_empty:
        joined = joined.where(F.col("_lx_removed").isNull() | (F.trim(F.regexp_replace("_lx_text", r"\s+", " ")) != ""))
    types = dict(docs.dtypes)
    new = {"text": F.col("_lx_text")} | ({"n_chars": F.when(F.col("_lx_removed").isNull(), F.col("_lx.n_chars")).otherwise(F.length("_lx_text")).cast(types["n_chars"])} if "n_chars" in types else {})
    return joined.select(*[new.get(c, F.col(f"_lx.`{c}`")).alias(c) for c in docs.columns])
