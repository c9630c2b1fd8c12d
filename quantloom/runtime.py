"""Session, table access and durable intermediate results.

Lineage is cut only through files that every executor can read: the folder comes
from ``spark.checkpoint.dir`` and a folder of our own is set only where the session
names none (tests, notebooks).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a join side that may be broadcast once counted (about 60 bytes a row in a hashed relation).
MAX_BROADCAST_ROWS = 300_000


def session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "quantloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUANTLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="quantloom-")
    sc.setCheckpointDir(folder)
    return folder


_cleaned: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's folder within the shared one; it is removed when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/quantloom-{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone already, and with it the way to delete
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, but columnar: for wide results of which later steps read some columns only."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name`` or a variant of it that is not among ``taken`` (Spark compares without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
