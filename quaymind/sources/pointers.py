"""Numbered pointers to the current version of a stored table.

A version is written under a new name first and named by a pointer last.
Pointers are small numbered files that are created once and never written
again: a reader takes the highest complete one, so a write that fails at any
moment leaves the version before it current.  Two writers that start from the
same version want the same number; the second fails and loses nothing in
silence.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

_END = "\n"


class ConcurrentWrite(RuntimeError):
    """Another writer has named its version since this one read the table."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _file(folder: str, number: int) -> str:
    return f"{folder}/{number:012d}.json"


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    at, fs = _fs(spark, folder)
    if not fs.exists(at):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(at)]
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def latest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The number that the next pointer follows, and what the highest complete pointer says (None: there is none).

    An incomplete pointer is a write that broke off while it was named: the
    one before it holds, and its number stays taken.
    """
    numbers = _numbers(spark, folder)
    for number in numbers:
        rows = spark.read.text(_file(folder, number), wholetext=True).head(1)
        if rows and rows[0][0].endswith(_END):
            return numbers[0], json.loads(rows[0][0])
    return (numbers[0] if numbers else 0), None


def publish(spark: SparkSession, folder: str, after: int, value: dict) -> str:
    """Create the pointer that follows number ``after``; returns its path."""
    path = _file(folder, after + 1)
    at, fs = _fs(spark, path)
    if fs.exists(at):
        raise ConcurrentWrite(f"{folder} has a pointer {after + 1} already")
    fs.mkdirs(at.getParent())
    try:
        out = fs.create(at, False)
    except Exception as taken:  # the gateway's error carries the file system's own
        if fs.exists(at):
            raise ConcurrentWrite(f"{folder} has a pointer {after + 1} already") from taken
        raise
    try:
        out.write(bytearray((json.dumps(value) + _END).encode()))
    finally:
        out.close()
    return path


__all__ = ["ConcurrentWrite", "latest", "publish"]
