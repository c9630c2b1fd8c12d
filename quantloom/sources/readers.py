"""Readers: every file type of a feature store as DataFrames."""

from __future__ import annotations

import sqlite3
import zlib
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources import paths

#: Names of the files of a split store.
PRECURSORS, TRANSITIONS, ALIGNMENT = "precursors_features.parquet", "transition_features.parquet", "feature_alignment.parquet"
_SQLITE_MAGIC = b"SQLite format 3\x00"


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name")]


def file_type(path: str) -> str:
    """One of osw, sqmass, parquet, parquet_split, parquet_split_multi, tsv; judged by content where names leave doubt."""
    if paths.is_dir(path):
        inside = paths.names(path)
        if PRECURSORS in inside and TRANSITIONS in inside:
            return "parquet_split"
        if any(paths.is_dir(f"{path}/{d}") and PRECURSORS in paths.names(f"{path}/{d}") for d in inside):
            return "parquet_split_multi"
        if any(f.endswith(".parquet") for f in inside):
            return "parquet"
        raise ValueError(f"no known store in {path}")
    head = paths.head(path)
    if head == _SQLITE_MAGIC:
        names = {t.upper() for t in sqlite_tables(path)}
        return "sqmass" if "CHROMATOGRAM" in names and "FEATURE" not in names else "osw"
    if head[:4] == b"PAR1":
        return "parquet"
    if path.lower().endswith((".tsv", ".txt", ".csv")):
        return "tsv"
    raise ValueError(f"unknown type of file: {path}")


_KINDS = {"INT": "long", "REAL": "double", "FLOA": "double", "DOUB": "double", "TEXT": "string", "CHAR": "string", "CLOB": "string", "BLOB": "binary"}


def _kind(declared: str) -> str:
    return next((k for part, k in _KINDS.items() if part in declared.upper()), "string")


def read_sqlite(spark: SparkSession, path: str, table: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """A table or view of a SQLite file that all executors can read, columns in lower case and in their declared types.

    Tasks read ranges of row ids; what has none (views, tables WITHOUT ROWID) is read by one task, batch by batch. A value that is not of
    its column's type becomes null.
    """
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        columns = [(r[1], _kind(r[2] or "")) for r in db.execute(f'PRAGMA table_info("{table}")')]
        if not columns:
            raise ValueError(f"{path} has no table {table}")
        is_table = db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'table' AND lower(name) = lower(?)", (table,)).fetchone()[0]
        try:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone() if is_table else (None, None)
            ranged = bool(is_table)
        except sqlite3.OperationalError:  # no row ids
            low, high, ranged = None, None, False
    schema = ", ".join(f"`{c.lower()}` {k}" for c, k in columns)
    if ranged and low is None:
        return spark.createDataFrame([], schema)
    names = ", ".join(f'"{c}"' for c, _ in columns)
    casts: dict[str, Callable] = {"long": int, "double": float, "string": str, "binary": bytes}

    def cast(kind: str, value):
        try:
            return None if value is None else casts[kind](value)
        except (TypeError, ValueError):
            return None

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as source:
                    if ranged:
                        start = low + part * rows_per_task
                        found = source.execute(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (start, start + rows_per_task))
                    else:
                        found = source.execute(f'SELECT {names} FROM "{table}"')
                    while chunk := found.fetchmany(50_000):
                        arrays = [pa.array([cast(k, v) for v in column], types[k]) for column, (_, k) in zip(zip(*chunk), columns)]
                        yield pa.RecordBatch.from_arrays(arrays, names=[c.lower() for c, _ in columns])

    parts = (high - low) // rows_per_task + 1 if ranged else 1
    return spark.range(0, parts, 1, numPartitions=parts).mapInArrow(read, schema)


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a store by lower-case name, whatever its type."""
    kind = file_type(path)
    if kind in ("osw", "sqmass"):
        return {t.lower(): read_sqlite(spark, path, t) for t in sqlite_tables(path)}
    if kind == "tsv":
        return {"features": read_tsv(spark, path)}
    if kind == "parquet":
        return {"features": read_parquet(spark, path)}
    base = path if kind == "parquet_split" else f"{path}/*"
    found = {"precursors": read_parquet(spark, f"{base}/{PRECURSORS}"), "transitions": read_parquet(spark, f"{base}/{TRANSITIONS}")}
    if paths.exists(f"{path}/{ALIGNMENT}"):
        found["alignment"] = read_parquet(spark, f"{path}/{ALIGNMENT}")
    return found


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files as one frame: all columns of all files, in lower case."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return df.toDF(*[c.lower() for c in df.columns])


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def read_trafo_xml(spark: SparkSession, path: str) -> DataFrame:
    """``source, from, to`` of the pairs of retention time transformations."""
    pairs = spark.read.format("xml").option("rowTag", "Pair").schema("_from double, _to double").load(path)
    return pairs.select(F.input_file_name().alias("source"), F.col("_from").alias("from"), F.col("_to").alias("to"))


def runs_in(df: DataFrame, run: str = "run_id") -> int:
    return df.agg(F.count_distinct(run).alias("n")).first()["n"]


def decoded(blob: Column, compression: Column) -> Column:
    """The numbers of a chromatogram blob: 0 and 1 are plain and zlib doubles (little endian); other codes give null."""

    @F.pandas_udf("array<double>")
    def numbers(blobs, codes):
        import numpy as np
        import pandas as pd

        def one(b, c):
            if b is None or c not in (0, 1):
                return None
            try:
                raw = bytes(b) if c == 0 else zlib.decompress(bytes(b))
                return np.frombuffer(raw[: len(raw) // 8 * 8], "<f8")
            except zlib.error:
                return None

        return pd.Series([one(b, c) for b, c in zip(blobs, codes)], dtype=object)

    return numbers(blob, compression)


def chromatograms(chromatogram: DataFrame, data: DataFrame) -> DataFrame:
    """One row per chromatogram with its precursor and transition ids (read from the native id), ``rt`` and ``intensity`` arrays."""
    pick = lambda kind, c: F.max(F.when(F.col("data_type") == kind, F.col(c)))
    wide = data.groupBy("chromatogram_id").agg(pick(2, "data").alias("_rt"), pick(2, "compression").alias("_rc"), pick(1, "data").alias("_in"), pick(1, "compression").alias("_ic"))
    met = chromatogram.join(wide, F.col("id") == F.col("chromatogram_id"), "left")
    precursor = F.nullif(F.regexp_extract("native_id", r"(\d+)_Precursor_i\d+", 1), F.lit("")).try_cast("long")
    transition = F.when(F.col("native_id").rlike(r"^\d+$"), F.col("native_id").try_cast("long"))
    return met.select("id", "native_id", precursor.alias("precursor_id"), transition.alias("transition_id"), decoded(F.col("_rt"), F.col("_rc")).alias("rt"), decoded(F.col("_in"), F.col("_ic")).alias("intensity"))


READERS: Mapping[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {k: read_store for k in ("osw", "sqmass", "parquet", "parquet_split", "parquet_split_multi", "tsv")}
