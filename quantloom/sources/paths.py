"""Folders and files wherever the session's file system finds them; without a session, on this machine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None, None
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(path: str) -> bool:
    fs, there = _at(path)
    return os.path.exists(path) if fs is None else fs.exists(there)


def is_dir(path: str) -> bool:
    fs, there = _at(path)
    return os.path.isdir(path) if fs is None else fs.exists(there) and fs.getFileStatus(there).isDirectory()


def names(path: str) -> list[str]:
    """What lies in a folder, by name."""
    fs, there = _at(path)
    return sorted(os.listdir(path)) if fs is None else sorted(s.getPath().getName() for s in fs.listStatus(there))


def head(path: str, n: int = 16) -> bytes:
    """The first bytes of a file."""
    fs, there = _at(path)
    if fs is None:
        with open(path, "rb") as f:
            return f.read(n)
    stream = fs.open(there)
    try:
        found = []
        while len(found) < n and (b := stream.read()) >= 0:
            found.append(b)
        return bytes(found)
    finally:
        stream.close()
