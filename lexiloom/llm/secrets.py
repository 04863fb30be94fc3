"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A tokenizer's vocabulary holds the pieces of ordinary text, so random strings fall apart into short tokens. Candidates are maximal runs of
base64 and URL-safe characters with at least `min_length` characters that hold a letter; those with fewer than `max_ratio` characters a token
(`letter_ratio` for runs without a digit, as long words of prose come nearer to random letters) are reported, unless they overlap a span of
the fixed patterns, look like a known digest (hex of a usual digest length, or a UUID), or like an identifier: two or more parts between
separators, each of at most 15 letters or of digits only.

Offsets are code points, end exclusive. A null text is an empty one and has no spans; an empty table gives an empty result. Very long texts are
scanned whole. Repeated rows are each scanned; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, pieces

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A maximal run is matched whole by the greedy form, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: Hex lengths of CRC-32 to SHA-512 digests.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
PART = re.compile(r"[A-Za-z]{1,15}|[0-9]+|")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def is_identifier(run: str) -> bool:
    parts = re.split(r"[_/=+-]", run)
    return sum(map(bool, parts)) > 1 and all(PART.fullmatch(p) for p in parts)


def is_digest(run: str) -> bool:
    return bool(UUID.fullmatch(run)) or len(run) in DIGEST_LENGTHS and bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run))


def random_spans(text: str, taken: list[tuple[str, int, int]], encode, min_length: int, max_ratio: float, letter_ratio: float) -> list[tuple[str, int, int]]:
    found = []
    for m in RUN.finditer(text):
        s, e = m.span()
        run = m[0]
        if e - s < min_length or not any(c.isalpha() for c in run):
            continue
        if any(a < e and s < b for _, a, b in taken) or is_digest(run) or is_identifier(run):
            continue
        if (e - s) / len(encode(run)) < (max_ratio if any(c.isdigit() for c in run) else letter_ratio):
            found.append(("random", s, e))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def load_encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str, min_length: int = 20, max_ratio: float = 2.2, letter_ratio: float = 2.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row. The vocabulary file must be installed on every executor."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(ranks_path, pattern).encode_ordinary
        for batch in pieces(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, base, encode, min_length, max_ratio, letter_ratio)
                n = [sum(k == kind_ for k, _, _ in base) for kind_ in KINDS[:3]]
                rows.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
