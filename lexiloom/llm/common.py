"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and everything runs in one process (tests), one below /tmp is set; a cluster must
    name a folder that all executors see."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("/tmp/checkpoints/lexiloom")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_lexiloom_path", None)
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let no Arrow batch that goes to Python exceed `most` bytes, where the session allows more. Rows of packed arrays are large, and a batch
    is held on both sides of the socket. The setting stays for the session: it is read when the result is computed."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_fold(col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text (remainder 0, so it is never learned from)."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")).cast("binary")) % folds


def batch_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def pieces(batches, rows: int = 512):
    """Arrow batches in slices of so many rows, so that what Python makes of a slice stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
