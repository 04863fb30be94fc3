"""A training-corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared folder and rereads
them as the next one's docs. All but the last return the columns of documents. ORACLE_SQL is None: edit distances over all lines,
XXH64 fingerprints and the tokenizer have no SQL form here; the tests hold the stages and the run against brute force.

In every stage: an empty table gives an empty result; columns beyond those of documents are carried through whatever their names (but for
packing, which returns its own); texts of any length are taken whole; lang, source, n_chars and doc_id may be null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.common import materialize, table
from lexiloom.llm.decontaminate import drop_contaminated
from lexiloom.llm.langid import drop_unknown, learned_rows, train_profiles
from lexiloom.llm.linededup import without_repeated_lines
from lexiloom.llm.packing import pack
from lexiloom.llm.simhash import keep_one

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; profiles are learned from the rows of docs that have lang.

    Null texts, empty ones and those without a letter are rejected, and all documents where no row has lang. A null lang takes the language
    found. Repeated rows are each judged; a tie between languages goes to the smaller name."""
    return drop_unknown(docs, train_profiles(learned_rows(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has, or has within two edits; those that lose all but blank lines go.

    Earlier: smaller doc_id (null first), then line number; rows of one doc_id with different texts by a hash of the text; equal rows are one
    document and all stay. Null and empty texts have no lines and stay. n_chars is set anew where lines went."""
    return without_repeated_lines(docs, min_chars=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints within four bits, or shingles of five words alike by 0.8.

    The smallest doc_id of a group stays (null only where no other id is there); of repeated rows the first read. Null, empty and blank texts
    are one group."""
    return keep_one(docs, width=5, radius=4, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ten words of the benchmark (of a shorter item: the item).

    Null texts have no words and stay. Repeated rows are each judged."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, ids included. A null or empty text is one piece with the end id; ties of the curve's key go by row."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
