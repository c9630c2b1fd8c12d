"""Running sums, minima and maxima over one global order without putting all rows into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.runtime import written

#: Up to this size, by the optimizer's upper estimate, a window in one task is the cheaper plan.
ONE_TASK_BYTES = 128 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    rows: DataFrame,
    order: str,
    columns: Mapping[str, tuple[str, str]],
    keys: Sequence[str] = (),
    descending: bool = False,
    one_task_bytes: int | None = None,
) -> DataFrame:
    """``rows`` with running aggregates ``name: (sum|min|max, column)`` from the first row in order to this one.

    ``rows`` must hold each (keys, order) once, so aggregate to distinct values first; nulls in
    ``order`` come first ascending and last descending. Small inputs use one window; large ones are range partitioned, written,
    and each partition gets the combined totals of those before it.
    """
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    so_far = lambda *p: Window.partitionBy(*p).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if plan_bytes(rows) <= (ONE_TASK_BYTES if one_task_bytes is None else one_task_bytes):
        return rows.select("*", *[_COMBINE[kind](c).over(so_far(*keys)).alias(name) for name, (kind, c) in columns.items()])
    parted = written(rows.repartitionByRange(*[F.col(k) for k in keys], by).withColumn("_part", F.spark_partition_id()))
    totals = parted.groupBy(*keys, "_part").agg(*[_COMBINE[kind](c).alias(f"__before_{name}") for name, (kind, c) in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), *[_COMBINE[kind](f"__before_{name}").over(earlier).alias(f"__before_{name}") for name, (kind, c) in columns.items()])

    def joined(name: str, kind: str, c: str) -> Column:
        here = _COMBINE[kind](c).over(so_far(*keys, "_part"))
        before = F.col(f"__before_{name}")
        return (F.coalesce(before, F.lit(0)) + here if kind == "sum" else {"min": F.least, "max": F.greatest}[kind](before, here)).alias(name)

    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = parted.join(offsets, same)
    return met.select(*rows.columns, *[joined(name, kind, c) for name, (kind, c) in columns.items()])


def quantiles(rows: DataFrame, value: str, keys: Sequence[str], points: Mapping[str, float]) -> DataFrame:
    """``keys`` and a column for each of ``points`` (name: share): the exact quantile of the values, between two ranks on a straight line.

    Values are counted, the counts summed in order, and the ranks looked up, so no key's values are gathered; nulls and NaN don't count.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_n").alias("_all"))  # a row a key
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = running(counts, "_v", {"_to": ("sum", "_n")}, keys).join(totals, same)

    def at(share: float) -> Column:
        place = (F.col("_all") - 1) * share
        reached = lambda k: F.min(F.when(F.col("_to") > k, F.col("_v")))
        low = reached(F.floor(place))
        return low + (reached(F.ceil(place)) - low) * F.first(place - F.floor(place))

    return met.groupBy(*keys).agg(*[at(share).alias(name) for name, share in points.items()])
