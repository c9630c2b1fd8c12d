"""Scoring of a stream of run files with a frozen model.

The scorer keeps no state, so every file is read once, scored in generated code and appended; a stopped stream goes
on where its checkpoint says.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantloom.operators.learn import LinearModel
from quantloom.runtime import own_dir


def score_stream(files: DataFrame, model: LinearModel, keys: Sequence[str]) -> DataFrame:
    """A streaming (or static) frame's keys with ``score``; rows that lack a feature are left out."""
    return files.dropna(subset=list(model.weights)).select(*keys, model.score().alias("score"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def start(spark: SparkSession, folder: str, model: LinearModel, keys: Sequence[str], out: str, checkpoint: str, files_per_batch: int = 100, once: bool = False) -> StreamingQuery:
    """Start scoring the parquet files that are in ``folder`` and come into it; with ``once`` stop when all present files are done."""
    schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if not _is_folder(spark, folder):  # a single file: its folder, narrowed to its name
        folder, _, name = folder.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    files = reader.parquet(folder)
    writer = score_stream(files, model, keys).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_files(spark: SparkSession, folder: str, model: LinearModel, keys: Sequence[str]) -> DataFrame:
    """Score all present files as a stream and read the result."""
    base = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    start(spark, folder, model, keys, f"{base}/out", f"{base}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per time window and kind of a stream with late rows; static frames work alike."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    told = timed.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))
    return told.select(F.col("window.start").alias("start"), kind, "n")
