"""Small files of the driver (manifests, summaries, locks) through Hadoop's file system, so local and remote paths work alike."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def is_empty_folder(spark: SparkSession, path: str) -> bool:
    """True where there is nothing, or a folder with nothing in it."""
    fs, target = _at(spark, path)
    return not fs.exists(target) or (fs.getFileStatus(target).isDirectory() and not len(fs.listStatus(target)))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where it does not exist."""
    fs, target = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    size = fs.getFileStatus(target).getLen()
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode("utf-8") if size else ""
    finally:
        stream.close()


def stream_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, in lowercase hex."""
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """Not atomic: a reader may meet half a file."""
    fs, target = _at(spark, path)
    stream = fs.create(target, overwrite)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def as_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n"


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """Pretty JSON, written in place."""
    write_text(spark, path, as_json(value))


def atomic_json(spark: SparkSession, path: str, value: Any) -> None:
    """Pretty JSON beside its place, then renamed: readers meet the old file or the new one."""
    fs, target = _at(spark, path)
    beside = target.getParent().suffix(f"/.{target.getName()}.writing")
    write_text(spark, beside.toString(), as_json(value))
    if not fs.rename(beside, target):
        fs.delete(target, False)
        if not fs.rename(beside, target):
            raise OSError(f"cannot write {path}")


def output_prefix(path: str) -> str:
    """A path without .gz and then .jsonl or .json, for outputs named after an input."""
    for suffix in (".gz", ".jsonl", ".json"):
        path = path.removesuffix(suffix)
    return path


class Lock:
    """A file that only one writer can create; the owner removes it at the end. One left by a lost driver is removed by hand."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __enter__(self) -> Lock:
        try:
            write_text(self.spark, self.path, self.spark.sparkContext.applicationId, overwrite=False)
        except Exception as error:
            if exists(self.spark, self.path):
                raise ValueError(f"another job is using this checkpoint ({self.path})") from error
            raise
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)
