"""Toxicity scoring by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each step of a window is a word; its input is a word vector (hashed vocabulary) joined with the mean of its character-trigram vectors. A
forward and a backward gated recurrent layer read the window, attention weighs the steps, and a linear layer gives the window's logit. Every
text is cut into overlapping windows over its whole length, all are scored, and the highest window decides, calibrated to a probability.

Fitting: documents come from a sample of at most `max_train` labelled rows (half of each label, as far as there are, in order of the hash of
doc_id), with all windows of each. After the first quarter of the epochs only the windows of a toxic document near its
highest stay (the document is labelled, not the window). Every fifth document of the sample is kept for the calibration. Training is seeded. The model (about 1 MB) is broadcast.

Labels are read only for rows whose id has remainder other than 0. Conflicting labels of one doc_id count as toxic. A null toxic label is no
label. Null texts, texts without words and, if there are no labels of both kinds, all texts get the base rate of the training labels
(0 without labels). Repeated rows are each scored; an empty table gives an empty result; very long texts are scored whole. Other columns
are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_bytes, bound_batches, id_fold, pieces

WINDOW, STRIDE = 24, 16
WORDS, TRIGRAMS, WIDTH, HIDDEN = 16384, 4096, 12, 8


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words: the last one ends at the last word."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket of each word, trigram buckets of all words in a row, each word's first trigram)."""
    ids = np.fromiter((zlib.crc32(w) % WORDS for w in words), np.int64, len(words))
    data = np.frombuffer(b"".join(b"\1" + w + b"\2" for w in words), np.uint8).astype(np.int64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    data = np.concatenate([data, [0, 0]])
    tri = (data[:-2] * 7919 + data[1:-1] * 104729 + data[2:] * 1299709) % TRIGRAMS
    inside = np.ones(len(tri), bool)
    inside[ends - 1] = inside[ends - 2] = False
    starts = ends - lengths - 2 * np.arange(len(words))
    return ids, tri[inside], starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_parameters(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    e, h = 2 * WIDTH, HIDDEN
    draw = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    p = {"word": np.zeros((WORDS, WIDTH), np.float32), "tri": r.normal(0, 0.1, (TRIGRAMS, WIDTH)).astype(np.float32)}  # an unseen word's vector stays 0
    for d in "fb":
        p |= {f"x{d}": draw(e, 3 * h), f"h{d}": draw(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32), f"a{d}": draw(h, 1)[:, 0], f"y{d}": draw(h, 1)[:, 0]}
    p["bias"] = np.zeros(1, np.float32)
    return p


def step(gx: np.ndarray, state: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One gated recurrent step. gx: input part of the three gates."""
    h = HIDDEN
    gh = state @ u
    zr = _sigmoid(gx[:, : 2 * h] + gh[:, : 2 * h])
    n = np.tanh(gx[:, 2 * h :] + zr[:, h:] * gh[:, 2 * h :])
    return n + zr[:, :h] * (state - n), zr, n, gh


def forward(p: dict, inputs: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Window logits. inputs: gate inputs of each distinct word, by direction; index: windows x WINDOW word numbers; mask: 1 where there is a word."""
    n = len(index)
    a = np.zeros((n, WINDOW), np.float32)
    y = np.zeros((n, WINDOW), np.float32)
    for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        state = np.zeros((n, HIDDEN), np.float32)
        for t in order:
            state = step(inputs[d][index[:, t]], state, p[f"h{d}"])[0]
            if mask is not None:
                state *= mask[:, t : t + 1]
            a[:, t] += state @ p[f"a{d}"]
            y[:, t] += state @ p[f"y{d}"]
    if mask is not None:
        a = np.where(mask > 0, a, -1e9)
    a = np.exp(a - a.max(axis=1, keepdims=True))
    return (a * y).sum(axis=1) / a.sum(axis=1) + p["bias"][0]


def gate_inputs(p: dict, words: list[bytes]) -> dict[str, np.ndarray]:
    ids, tri, starts = word_codes(words)
    counts = np.diff(np.concatenate([starts, [len(tri)]]))[:, None]
    x = np.concatenate([p["word"][ids], np.add.reduceat(p["tri"][tri], starts, axis=0) / counts], axis=1)
    return {d: x @ p[f"x{d}"] + p[f"c{d}"] for d in "fb"}


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows with equal `at`."""
    order = np.argsort(at, kind="stable")
    start = np.concatenate([[0], np.flatnonzero(np.diff(at[order])) + 1])
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[at[order[start]]] = np.add.reduceat(rows[order], start, axis=0)
    return out


def gradients(p: dict, codes: tuple, index: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weighted logistic loss over windows, by back-propagation through time, and the logits."""
    ids, tri, starts = codes
    counts = np.diff(np.concatenate([starts, [len(tri)]]))[:, None]
    x = np.concatenate([p["word"][ids], np.add.reduceat(p["tri"][tri], starts, axis=0) / counts], axis=1)
    n, h = len(index), HIDDEN
    g = {k: np.zeros_like(v) for k, v in p.items()}
    a, y = np.zeros((n, WINDOW), np.float32), np.zeros((n, WINDOW), np.float32)
    kept = {}
    for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        gx = x @ p[f"x{d}"] + p[f"c{d}"]
        state = np.zeros((n, h), np.float32)
        for t in order:
            before = state
            new, zr, cand, gh = step(gx[index[:, t]], before, p[f"h{d}"])
            state = new * mask[:, t : t + 1]
            kept[d, t] = (before, zr, cand, gh, state)
            a[:, t] += state @ p[f"a{d}"]
            y[:, t] += state @ p[f"y{d}"]
    a = np.where(mask > 0, a, -1e9)
    soft = np.exp(a - a.max(axis=1, keepdims=True))
    soft /= soft.sum(axis=1, keepdims=True)
    pooled = (soft * y).sum(axis=1)
    logit = pooled + p["bias"][0]
    dl = ((_sigmoid(logit) - label) * weight / max(weight.sum(), 1e-6)).astype(np.float32)
    g["bias"][0] = dl.sum()
    dy = dl[:, None] * soft
    da = dl[:, None] * soft * (y - pooled[:, None])
    dx = np.zeros_like(x)
    for d, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
        dg = np.empty((n, WINDOW, 3 * h), np.float32)
        back = np.zeros((n, h), np.float32)
        for t in order:
            before, zr, cand, gh, state = kept[d, t]
            g[f"a{d}"] += da[:, t] @ state
            g[f"y{d}"] += dy[:, t] @ state
            ds = (back + da[:, t : t + 1] * p[f"a{d}"] + dy[:, t : t + 1] * p[f"y{d}"]) * mask[:, t : t + 1]
            z, r = zr[:, :h], zr[:, h:]
            dn = ds * (1 - z) * (1 - cand * cand)
            dz = ds * (before - cand) * z * (1 - z)
            dr = dn * gh[:, 2 * h :] * r * (1 - r)
            dgh = np.concatenate([dz, dr, dn * r], axis=1)
            g[f"h{d}"] += before.T @ dgh
            dg[:, t, : 2 * h] = dgh[:, : 2 * h]
            dg[:, t, 2 * h :] = dn
            back = ds * z + dgh @ p[f"h{d}"].T
        dgx = summed(index.ravel(), dg.reshape(-1, 3 * h), len(x))
        g[f"x{d}"] += x.T @ dgx
        g[f"c{d}"] += dgx.sum(axis=0)
        dx += dgx @ p[f"x{d}"].T
    g["word"] = summed(ids, dx[:, :WIDTH], WORDS)
    g["tri"] = summed(tri, np.repeat(dx[:, WIDTH:] / counts, counts[:, 0], axis=0), TRIGRAMS)
    return g, logit


def indexed(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, and windows x WINDOW of their numbers with a mask."""
    number: dict[bytes, int] = {}
    index, mask = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.float32)
    for i, w in enumerate(windows):
        index[i, : len(w)] = [number.setdefault(x, len(number)) for x in w]
        mask[i, : len(w)] = 1
    return list(number), index, mask


class Windows:
    """All windows of some texts (lists of words), cut when they are read."""

    def __init__(self, texts: list[list[bytes]]):
        self.texts = texts
        starts = [window_starts(len(x)) for x in texts]
        self.owner = np.repeat(np.arange(len(texts)), [len(x) for x in starts])
        self.starts = np.array([s for x in starts for s in x], np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def at(self, rows: np.ndarray) -> list[list[bytes]]:
        return [self.texts[i][s : s + WINDOW] for i, s in zip(self.owner[rows], self.starts[rows])]


def train(documents: list[tuple[list[bytes], int]], epochs: int = 6, batch: int = 256, min_steps: int = 500, rate: float = 0.006, decay: float = 0.02, seed: int = 5) -> dict:
    """documents: (words, label). Every fifth document is kept for the calibration (scale, shift) of a document's highest logit.

    In the first quarter of the epochs all windows carry their document's label; before each later one, a toxic document keeps only the windows near its highest."""
    p = new_parameters(seed)
    fitted, checked = [x for i, x in enumerate(documents) if i % 5 != 4], documents[4::5]
    windows = Windows([x for x, _ in fitted])
    owner = windows.owner
    label = np.array([y for _, y in fitted], np.float32)[owner]
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    r, logits = np.random.default_rng(seed), np.zeros(len(windows), np.float32)
    batch = min(batch, max(32, len(windows) // 40))  # a small sample gets smaller batches and more epochs, so that it is fitted as long
    epochs = max(epochs, -(-min_steps * batch // max(1, len(windows))))
    for epoch in range(epochs):
        keep = (label == 0) | (epoch < epochs // 4) | (logits >= highest(logits, owner, len(fitted))[owner] - 1)
        order = np.flatnonzero(keep)[r.permutation(int(keep.sum()))]
        weight = np.where(label == 1, max(1.0, 0.3 * (label[order] == 0).sum() / max(1, (label[order] == 1).sum())), 1.0).astype(np.float32)
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            words, index, mask = indexed(windows.at(rows))
            g, _ = gradients(p, word_codes(words), index, mask, label[rows], weight[rows])
            t += 1
            now = rate * (0.3 if epoch >= epochs - 2 else 1.0)
            for k, x in p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                x -= now * ((m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + decay * x)
        logits = logits_of(p, windows)
    windows = Windows([x for x, _ in checked])
    top = highest(logits_of(p, windows), windows.owner, len(checked))
    return p | {"calibration": calibrate(top, np.array([y for _, y in checked]))}


def highest(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, logits)
    return top


def logits_of(p: dict, windows: Windows) -> np.ndarray:
    out = np.zeros(len(windows), np.float32)
    for s in range(0, len(windows), 4096):
        words, index, mask = indexed(windows.at(np.arange(s, min(s + 4096, len(windows)))))
        out[s : s + 4096] = forward(p, gate_inputs(p, words), index, mask)
    return out


def calibrate(top: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Scale and shift with the least logistic loss on a grid, the classes weighted alike (a grid stays finite where the classes are separable)."""
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    x, sign = np.clip(top, -30, 30), 1 - 2 * label
    grid = [(a, -a * b) for a in (0.25, 0.5, 1.0, 2.0) for b in np.arange(-12, 12.05, 0.1)]
    losses = [(weight * np.logaddexp(0, sign * (a * x + b))).sum() for a, b in grid]
    return np.array(grid[int(np.argmin(losses))])


def sample(docs: DataFrame, labels: DataFrame, max_train: int, folds: int) -> list[tuple[list[bytes], int]]:
    """The training documents, as words; equal words are one object."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_fold("doc_id", folds) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    half = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2) for y in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]))  # at most max_train rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), "toxic")
    known_words: dict[bytes, bytes] = {}
    out = []
    for r in rows.orderBy("doc_id").limit(2 * max_train).toLocalIterator():
        if words := [known_words.setdefault(w, w) for w in words_of(bytes(r.text or b""))]:
            out.append((words, int(r.toxic)))
    return out


class Scorer:
    """Highest window logits of texts; gate inputs of words are kept from one slice to the next."""

    def __init__(self, p: dict, cache: int = 120_000):
        self.p, self.limit, self.number = p, cache, {}
        self.inputs = {d: np.zeros((cache, 3 * HIDDEN), np.float32) for d in "fb"}

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        new = list(dict.fromkeys(w for w in words if w not in number))
        if len(number) + len(new) > self.limit:
            number.clear()
            new = list(dict.fromkeys(words))
            if len(new) > self.limit:
                self.limit = len(new)
                self.inputs = {d: np.zeros((self.limit, 3 * HIDDEN), np.float32) for d in "fb"}
        if new:
            at = len(number)
            for d, x in gate_inputs(self.p, new).items():
                self.inputs[d][at : at + len(new)] = x
            number.update(zip(new, range(at, at + len(new))))
        return np.array([number[w] for w in words], np.int64)

    def top(self, texts: list[bytes]) -> np.ndarray:
        """-inf for texts without words."""
        best = np.full(len(texts), -np.inf)
        ids, starts, sizes, owner, at = [], [], [], [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            for s in window_starts(len(words)):
                starts.append(at + s)
                sizes.append(min(WINDOW, len(words) - s))
                owner.append(i)
            ids += words
            at += len(words)
        if not starts:
            return best
        numbers = np.concatenate([self._numbers(ids), np.zeros(WINDOW, np.int64)])
        starts, sizes, owner = np.array(starts), np.array(sizes), np.array(owner)
        for full in (True, False):
            rows = np.flatnonzero((sizes == WINDOW) == full)
            for s in range(0, len(rows), 8192):
                some = rows[s : s + 8192]
                index = numbers[starts[some, None] + np.arange(WINDOW)]
                mask = None if full else (np.arange(WINDOW) < sizes[some, None]).astype(np.float32)
                np.maximum.at(best, owner[some], forward(self.p, self.inputs, index, mask))
        return best


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, max_train: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    documents = sample(docs, labels, max_train, folds)
    classes = [y for _, y in documents]
    rate = sum(classes) / len(classes) if classes else 0.0
    shared = spark.sparkContext.broadcast(train(documents) if 0 < rate < 1 else None)
    rate = min(rate, 0.49)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        scorer = Scorer(p) if p else None
        for batch in pieces(batches):
            texts = batch_bytes(batch.column("text"))
            top = scorer.top(texts) if scorer else np.full(len(texts), -np.inf)
            score = np.where(np.isfinite(top), _sigmoid(p["calibration"][0] * np.clip(top, -30, 30) + p["calibration"][1]), rate) if p else np.full(len(texts), rate)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score.astype(np.float64)), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (id_fold("doc_id", folds) == 0).alias("held_out"), "score", "predicted")
