"""Sinks: stores, score tables, exports. Nothing is overwritten in place while it is read."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.relational import scores_back
from quantloom.sources.readers import PRECURSORS, TRANSITIONS


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_split(precursors: DataFrame, transitions: DataFrame, path: str, by_run: bool = True) -> None:
    """A split store; by run the files are partitioned by ``run_id``, transitions without run in a partition of their own."""
    keys = ["run_id"] if by_run else []
    write_parquet(precursors, f"{path}/{PRECURSORS}", keys)
    write_parquet(transitions, f"{path}/{TRANSITIONS}", keys)


def write_context(scores: DataFrame, path: str) -> None:
    """Score rows of some contexts; rows of the same contexts that are there already are replaced, others stay."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("context").parquet(path)


def write_scores_back(table_path: str, scores: DataFrame, keys: Sequence[str], prefix: str) -> str:
    """A new version of a table with its score columns replaced: written beside the old one, counted, then put in its place.

    Returns the path of the old version, which is kept.
    """
    spark = scores.sparkSession
    before = spark.read.parquet(table_path)
    fresh = f"{table_path}.{uuid.uuid4().hex[:8]}"
    write_parquet(scores_back(before, scores, keys, prefix), fresh)
    if spark.read.parquet(fresh).count() != before.count():
        raise ValueError("joining the scores changed the number of rows")
    fs, path = _files(spark, table_path)
    old = f"{table_path}.old-{uuid.uuid4().hex[:8]}"
    fs.rename(path(table_path), path(old))
    fs.rename(path(fresh), path(table_path))
    return old


def _files(spark, sample: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(sample).getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_text(df: DataFrame, path: str, sep: str = "\t", by: str | None = None) -> None:
    """Delimited text, in one folder or one folder per value of ``by``."""
    writer = df.write.mode("overwrite").option("sep", sep).option("header", "true")
    (writer.partitionBy(by) if by else writer).csv(path)


def write_scoring(base: str, scored: DataFrame, summary: DataFrame, full: DataFrame, weights: DataFrame) -> dict[str, str]:
    """The four artefacts of a scoring run."""
    paths = {"scored": f"{base}_scored.tsv", "summary": f"{base}_summary_stat.csv", "full": f"{base}_full_stat.csv", "weights": f"{base}_weights.csv"}
    write_text(scored, paths["scored"])
    for name, df in (("summary", summary), ("full", full), ("weights", weights)):
        write_text(df, paths[name], ",")
    return paths


def write_sqlite(df: DataFrame, path: str, table: str, replace: bool = True) -> int:
    """A score table into a SQLite file, streamed through the driver partition by partition; for files that fit one machine by nature."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    columns = ", ".join(f'"{c.upper()}" {kinds.get(t, "TEXT")}' for c, t in df.dtypes)
    count = 0
    with sqlite3.connect(path) as db:
        if replace:
            db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({columns})')
        batch: list[tuple] = []
        insert = f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})'
        for row in df.toLocalIterator(prefetchPartitions=True):
            batch.append(tuple(row))
            if len(batch) >= 10_000:
                db.executemany(insert, batch)
                count += len(batch)
                batch = []
        if batch:
            db.executemany(insert, batch)
            count += len(batch)
    return count


def export_sqlite(path: str, tables: Mapping[str, DataFrame]) -> None:
    if os.path.exists(path):
        raise FileExistsError(path)
    for name, df in tables.items():
        write_sqlite(df, path, name.upper())


def without_run(transitions: DataFrame, run: int) -> DataFrame:
    """The transitions of a run's file: its own and those without run."""
    return transitions.where((F.col("run_id") == run) | F.col("run_id").isNull())
