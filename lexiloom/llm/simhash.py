"""SimHash near-duplicate components by covering locality-sensitive hashing.

Fingerprints: 64 majority bits over XXH64 hashes of word shingles. Candidate search: every bit position i gets a nonzero vector m(i) of
radius+1 bits; table v (one for each nonzero v) keeps the positions with <m(i), v> = 1. The vectors of at most `radius` differing positions
span less than the whole space, so some v is orthogonal to all of them, and in that table the two fingerprints have equal masked values:
every pair within the radius meets in a bucket, without exception.

Equal fingerprints are merged before the search, so a group of copies of any size is one row. Inside a bucket only a spanning forest of the
links is emitted, never all pairs. Buckets above `bucket_limit` distinct fingerprints are dealt once more, by a second covering family with
other vectors, and those above it again by a third, whose buckets are solved whatever their size; each level adds some 32 bits to the key.

A Jaccard index of 0.8 is about ten bits of 64 apart, for which a covering family would need thousands of tables. Where a similarity is
asked for, minwise sketches of the same shingle hashes give further links: texts that agree in a band of six places of 120 (all but
0.2 % of pairs at 0.8) are compared by their whole shingle sets. Each band gives a spanning forest of
its links, so no group is expanded into pairs; the sets of a band's texts are held in one task.

Nulls: a null text is an empty one, which has fingerprint zero and links like any other; an empty table gives an empty result. Very long texts
are fingerprinted whole. A null doc_id is kept as a row; it is never a
component's id unless no row of the component has an id. Repeated rows are kept and share a component. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import batch_bytes, bound_batches, materialize, pieces
from .graph import connected_components

BITS = 64
BANDS, BAND_ROWS = 20, 6


def shingle_hashes(text: bytes, width: int = 4) -> np.ndarray:
    """XXH64 of each word shingle of UTF-8 text, repeats included; words are split at ASCII white space after lower-casing A-Z."""
    words = text.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n, initial=-1))
    starts = [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[width:])), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes, width: int = 4) -> int:
    """The SimHash of UTF-8 text."""
    return majority(shingle_hashes(text, width))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * BAND_ROWS multiply-add hashes: two sets agree in a share of places near their Jaccard index."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
    low = np.full(BANDS * BAND_ROWS, (1 << 32) - 1, np.uint64)
    for part in range(0, len(hashes), 4096):
        low = np.minimum(low, ((hashes[part : part + 4096, None] * factors + terms) >> np.uint64(32)).min(axis=0))
    return low.astype("<u4")


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def covering_masks(radius: int, salt: int = 0) -> list[int]:
    """2^(radius+1)-1 masks of 64 bits such that any `radius` positions are outside one of them."""
    top = 1 << (radius + 1)
    order = np.random.default_rng(1000 + salt).permutation(BITS)
    vectors = np.empty(BITS, np.int64)
    vectors[order] = 1 + np.arange(BITS) % (top - 1)
    return [sum(1 << i for i in range(BITS) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect whatever the links within the radius connect among values (distinct, uint64)."""
    n = len(values)
    if n < 2:
        return []
    if n == 2:
        return [(0, 1)] if int(np.bitwise_count(values[0] ^ values[1])) <= radius else []
    group = np.full(n, -1, np.int64)
    links, hubs = [], []
    while (free := np.flatnonzero(group < 0)).size:  # greedy cover: each hub takes what is within the radius of it
        hub = free[0]
        near = free[np.bitwise_count(values[free] ^ values[hub]) <= radius]
        group[near] = len(hubs)
        links += [(int(hub), int(x)) for x in near if x != hub]
        hubs.append(hub)
    root = list(range(len(hubs)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    if len(hubs) > 1:
        order = np.argsort(group, kind="stable")
        at = np.searchsorted(group[order], np.arange(len(hubs) + 1))
        hub_values = values[np.array(hubs)]
        for a in range(len(hubs)):
            for b in np.flatnonzero(np.bitwise_count(hub_values[a + 1 :] ^ hub_values[a]) <= 3 * radius) + a + 1:
                if find(a) == find(int(b)):
                    continue
                left, right = order[at[a] : at[a + 1]], order[at[b] : at[b + 1]]
                for i in left:  # stops at the first link between the two groups
                    hit = np.flatnonzero(np.bitwise_count(values[right] ^ values[i]) <= radius)
                    if hit.size:
                        links.append((int(i), int(right[hit[0]])))
                        root[find(a)] = find(int(b))
                        break
    return links


_BUCKETS = "table long, key long, fp long, rep long"
_LINKS = "u long, v long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def _deal(masks: list[int], keyed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of every table of a covering family. keyed: the rows already have (table, key), which go on into the new table number and key."""
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        bits = fp.view(np.uint64)
        old_table = batch.column("table").to_numpy() if keyed else None
        old_key = batch.column("key").to_numpy() if keyed else None
        for n, mask in enumerate(masks):
            key = (bits & np.uint64(mask)).view(np.int64)
            number = np.full(len(fp), n, np.int64)
            if keyed:  # a hash of both: equal old keys and masked bits stay together, and hardly any others
                number = number + (old_table + 1) * 64
                key = _mixed(_mixed(old_key.view(np.uint64)) + (bits & np.uint64(mask))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(key), batch.column("fp"), batch.column("rep")], ["table", "key", "fp", "rep"])


def _forests(radius: int, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (table, key): links of each bucket; a bucket above the limit comes back as rows to be dealt again."""
    carry = None

    def solve(table, key, fp, rep):
        change = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate([[0], change, [len(table)]])
        sizes = np.diff(bounds)
        u, v, again = [], [], []
        for b in np.flatnonzero(sizes > 1):
            s, e = bounds[b], bounds[b + 1]
            if e - s > limit:
                again.append(np.arange(s, e))
                continue
            for i, j in bucket_forest(fp[s:e].view(np.uint64), radius):
                u.append(int(rep[s + i]))
                v.append(int(rep[s + j]))
        if u:
            blank = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), blank, blank, blank, blank], ["u", "v", "table", "key", "fp", "rep"])
        if again:
            take = np.concatenate(again)
            blank = pa.nulls(len(take), pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, pa.array(table[take]), pa.array(key[take]), pa.array(fp[take]), pa.array(rep[take])], ["u", "v", "table", "key", "fp", "rep"])

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "key", "fp", "rep")]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        table, key = cols[0], cols[1]
        if not len(table):
            continue
        last = int(np.flatnonzero((table != table[-1]) | (key != key[-1]))[-1]) + 1 if ((table != table[-1]) | (key != key[-1])).any() else 0
        carry = [x[last:] for x in cols]
        if last:
            yield from solve(*[x[:last] for x in cols])
    if carry is not None and len(carry[0]):
        yield from solve(*carry)


def near_links(distinct: DataFrame, radius: int = 4, bucket_limit: int = 20000) -> DataFrame:
    """distinct: (fp long, rep long), fingerprints distinct. Returns links (u, v) of reps, enough to connect all within the radius."""
    links, rows, keyed = None, distinct, False
    for level in range(3):
        masks, cap = covering_masks(radius, level), bucket_limit if level < 2 else 1 << 62
        dealt = rows.mapInArrow(lambda b, m=masks, k=keyed: _deal(m, k, b), _BUCKETS)
        shuffled = dealt.repartition("table", "key").sortWithinPartitions("table", "key")
        found = materialize(shuffled.mapInArrow(lambda b, r=radius, c=cap: _forests(r, c, b), _LINKS + ", " + _BUCKETS), "simhash-links")
        part = found.where("u is not null").select("u", "v")
        links = part if links is None else links.unionByName(part)
        rows, keyed = found.where("u is null").select("table", "key", "fp", "rep"), True
        if level < 2 and rows.isEmpty():
            break
    return links


def fingerprints(docs: DataFrame, width: int = 4, sketches: bool = False) -> DataFrame:
    """(row long, doc_id, h, fp long) of each row; h is a hash of the text. With sketches also sketch (binary) and sid (a hash of the shingle set),
    both null for no words. row numbers are those of monotonically_increasing_id over docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps, mins, sids = [], [], []
            for text in batch_bytes(batch.column("text")):
                hashes = shingle_hashes(text, width)
                fps.append(_signed(majority(hashes)))
                if sketches:
                    mins.append(sketch(hashes).tobytes() if len(hashes) else None)
                    sids.append(_signed(xxhash.xxh3_64_intdigest(np.unique(hashes).tobytes())) if len(hashes) else None)
            cols = [batch.column("row"), batch.column("doc_id"), batch.column("h"), pa.array(fps, pa.int64())] + ([pa.array(mins, pa.binary()), pa.array(sids, pa.int64())] if sketches else [])
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "h", "fp", "sketch", "sid"][: len(cols)])

    return _numbered(docs, "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, h long, fp long" + (", sketch binary, sid long" if sketches else ""))


def _numbered(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"), *columns)


def _same(h: str, again: str, value: Column) -> Column:
    """The value, or an error where a row's text is not the one that had its number before."""
    return F.when(F.col(h).eqNullSafe(F.col(again)), value).otherwise(F.raise_error(F.lit("docs gave other rows when it was read again; give a stored table")))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard index of two sets, given as ascending distinct values."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared / (len(both) - shared)


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, shingles) sorted by key: links (u, v) that connect whatever pairs of a key as alike as that connect.

    A row is compared with the hubs of its key, and with the members of a hub (rows like it) where the triangle inequality of the Jaccard
    distance leaves room for one like the row. It gets one link to each group it is like, so links are a forest: fewer than the key has rows.
    A row like no hub becomes one."""
    room = 1 - similarity + 1e-9
    now, names, sets, group, members, best = None, [], [], [], [], 0
    for batch in batches:
        u, v = [], []
        for key, fp, data in zip(*(batch.column(c).to_pylist() for c in ("key", "fp", "shingles"))):
            if key != now:
                now, names, sets, group, members, best = key, [], [], [], [], 0
            own, met, far, hub = np.frombuffer(data, "<u8"), [], [], None
            groups = len(set(group))
            for h in itertools.chain(range(best, len(sets)), range(best)):  # the hub met last comes first
                if group[h] in met:
                    continue
                like = alike(own, sets[h])
                if like >= similarity:
                    u.append(fp)
                    v.append(names[h])
                    met.append(group[h])
                    hub = (h, like) if hub is None else hub
                    if len(met) == groups:
                        break
                elif 1 - like <= 2 * room:
                    far.append((h, 1 - like))
            for h, gap in far:
                if group[h] in met:
                    continue
                for distance, name, other in members[h]:
                    if gap - distance <= room and alike(own, other) >= similarity:
                        u.append(fp)
                        v.append(name)
                        met.append(group[h])
                        break
            if hub is not None:
                best = hub[0]
                members[best].append((1 - hub[1], fp, own))
            else:
                group.append(met[0] if met else len(sets))
                names.append(fp)
                sets.append(own)
                members.append([])
            if len(met) > 1:
                group = [met[0] if g in met else g for g in group]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def similar_links(docs: DataFrame, rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """rows: fingerprints of docs, with sketches. Links (u, v) between fingerprints: of shingle sets whose sketches share a band and whose Jaccard
    index is at least `similarity`, and of texts with one shingle set.

    A shingle set moves as (key, sid) for each band; it is made again only where two sets share a key. Its name is its smallest fingerprint."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            whole = batch.filter(batch.column("sketch").is_valid())
            mins = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), "<u4").reshape(-1, BANDS, BAND_ROWS)
            keys = [xxhash.xxh3_64_intdigest(row[n].tobytes(), n) for row in mins for n in range(BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(whole.column("sid").to_numpy(), BANDS))], ["key", "sid"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [np.unique(shingle_hashes(text, width)).astype("<u8").tobytes() for text in batch_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("fp"), pa.array(sets, pa.binary())], ["sid", "fp", "shingles"])

    keyed = rows.select("sid", "sketch").mapInArrow(bands, "key long, sid long").distinct()
    order = Window.partitionBy("key").orderBy("sid")
    shared = materialize(keyed.withColumn("before", F.lag("sid").over(order)).withColumn("after", F.lead("sid").over(order)).where("before is not null or after is not null").select("key", "sid"), "simhash-bands")
    named = materialize(rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct("fp", "row", "h")).alias("x"), F.max("fp").alias("last")).select("sid", "x.*", "last"), "simhash-sets")
    alike_in_all = rows.join(named.where("fp <> last").select("sid", F.col("fp").alias("v")), "sid").select(F.col("fp").alias("u"), "v").where("u <> v").distinct()
    wanted = named.join(shared.select("sid").distinct(), "sid", "left_semi").select("row", "sid", "fp", F.col("h").alias("was"))
    texts = _numbered(docs, "text").join(wanted, "row").select("sid", "fp", _same("h", "was", F.col("text")).alias("text")).mapInArrow(shingles, "sid long, fp long, shingles binary")
    dealt = shared.join(texts, "sid").withColumn("turn", F.xxhash64("key", "sid")).repartition("key").sortWithinPartitions("key", "turn", "sid")  # each key has other hubs
    return dealt.select("key", "fp", "shingles").mapInArrow(lambda b: _similar(b, similarity), "u long, v long").unionByName(alike_in_all)


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, bucket_limit: int = 20000, similarity: float | None = None) -> DataFrame:
    """(row, doc_id, h, fp long, fingerprint, component_id) of every row of docs. similarity: also link texts whose shingle sets are as alike as that;
    docs is then read twice and must give its rows in the same partitions both times, as a table does; where it does not, the run fails."""
    bound_batches(docs.sparkSession)
    rows = materialize(fingerprints(docs, width, similarity is not None), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    links = near_links(classes.select("fp", F.col("fp").alias("rep")), radius, bucket_limit)
    if similarity is not None:
        links = links.unionByName(similar_links(docs, rows, similarity, width))
    parts = connected_components(links)
    joined = classes.join(parts, classes.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("part"))
    smallest = joined.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = joined.join(smallest, "part").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select("row", "doc_id", "h", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """Rows of docs, one of each component: that with the smallest doc_id (null last), among repeats the first in row order. Columns unchanged.

    docs is read more than once and must give its rows in the same partitions each time, as a table does; where it does not, the run fails."""
    found = simhash_components(docs, width, radius, similarity=similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("first")
    kept = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(first).select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
    flagged = found.select("row", F.col("h").alias("was")).join(kept, "row", "left")
    packed = _numbered(docs, F.struct("*").alias("own"))
    return packed.join(flagged, "row", "left").where(_same("h", "was", F.coalesce("stays", F.lit(False)))).select("own.*")
