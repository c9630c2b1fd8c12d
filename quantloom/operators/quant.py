"""Quantification matrices, their normalisation, spectral libraries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.scan import quantiles, running
from quantloom.runtime import written


def pivoted(rows: DataFrame, entity: Sequence[str], run: str, value: str, runs: Sequence[str]) -> DataFrame:
    """Mean ``value`` per entity in one column per run; the runs are given, so no scan looks for them."""
    return rows.groupBy(*entity).pivot(run, list(runs)).agg(F.avg(value))


def best_peak_groups(rows: DataFrame, keys: Sequence[str], qvalue: str, ties: Sequence[str]) -> DataFrame:
    """The row with the least q-value per key."""
    order = Window.partitionBy(*keys).orderBy(F.col(qvalue).asc_nulls_last(), *[F.col(t) for t in ties])
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top_items(rows: DataFrame, parent: str, item: str, run: str, value: str, n: int, consistent: bool = True) -> DataFrame:
    """Rows of each parent's ``n`` strongest items: by their median over runs (the same items everywhere), or run by run."""
    if not consistent:
        order = Window.partitionBy(parent, run).orderBy(F.col(value).desc_nulls_last(), item)
        return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    medians = rows.groupBy(parent, item).agg(F.median(value).alias("_m"))
    order = Window.partitionBy(parent).orderBy(F.col("_m").desc_nulls_last(), item)
    chosen = medians.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select(parent, item)
    return rows.join(chosen, [parent, item], "left_semi").select(*rows.columns)


def summarised(rows: DataFrame, parent: str, item: str, part: str, run: str, value: str, n: int, consistent: bool = True) -> DataFrame:
    """``parent, item, run, value``: items (peptides) of each parent (protein, gene) by run, from their ``n`` strongest parts (precursors).

    First items are the means of their top parts. Then every item goes to all its parents (``parent`` holds one id or an array of them); if
    ``consistent``, a parent keeps the ``n`` items with the highest median over runs. The mean over a parent's rows of a run is its value.
    """
    means = top_items(rows, item, part, run, value, n, consistent).groupBy(item, run).agg(F.avg(value).alias(value))
    several = dict(rows.dtypes)[parent].startswith("array")
    owners = rows.where(F.col(parent).isNotNull()).select(item, (F.explode(parent) if several else F.col(parent)).alias(parent)).distinct()
    of_parent = means.join(owners, item)
    return top_items(of_parent, parent, item, run, value, n) if consistent else of_parent


def median_normalised(rows: DataFrame, run: str, value: str, level_to_median: bool = True) -> DataFrame:
    """Values divided by their run's median, times the median of the runs' medians (``level_to_median``)."""
    medians = quantiles(rows, value, [run], {"_m": 0.5})
    overall = medians.agg(F.median("_m").alias("_mm"))
    met = rows.join(F.broadcast(medians.join(F.broadcast(overall))), run)  # one row a run
    scaled = F.try_divide(F.col(value), F.col("_m"))
    return met.withColumn(value, scaled * F.col("_mm") if level_to_median else scaled).select(*rows.columns)


def quantile_normalised(rows: DataFrame, run: str, value: str, ties: Sequence[str]) -> DataFrame:
    """Each value replaced by the mean over runs of the value at the same rank (classical quantile normalisation). Nulls stay null.

    The reference has as many ranks as the longest run; ranks of shorter runs lie between these, and values between two ranks on a
    straight line. Ranks come from a scan over distinct values, and all joins are by rank, so that no run must fit into one task.
    """
    rows = written(rows)
    known = rows.where(F.col(value).isNotNull())
    counts = known.groupBy(F.col(run).alias("_run"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_same"))
    sizes = counts.groupBy(F.col("_run").alias("_of")).agg(F.sum("_same").alias("_n"))
    sizes = sizes.join(F.broadcast(sizes.agg(F.max("_n").alias("_most"))))  # one row a run
    levels = running(counts, "_value", {"_to": ("sum", "_same")}, ("_run",)).withColumn("_from", F.col("_to") - F.col("_same"))
    levels = written(levels.join(F.broadcast(sizes), F.col("_run").eqNullSafe(F.col("_of"))).drop("_of"))
    # A step of a run of n is (longest - 1) / (n - 1) steps of the longest; whole numbers keep this exact.
    wide, steps = F.col("_most") - 1, F.greatest(F.col("_n") - 1, F.lit(1))
    following = levels.select(F.col("_run").alias("_of"), F.col("_from").alias("_at"), F.col("_value").alias("_next"))
    met = levels.join(following, F.col("_run").eqNullSafe(F.col("_of")) & (F.col("_to") == F.col("_at")), "left")
    first = lambda rank: F.call_function("div", F.col(rank) * wide + steps - 1, steps)
    spread = met.withColumn("_j", F.explode(F.sequence(first("_from"), F.when(F.col("_to") == F.col("_n"), wide).otherwise(first("_to") - 1))))
    past = F.col("_j") * (F.col("_n") - 1) / F.greatest(wide, F.lit(1)) - (F.col("_to") - 1)
    profile = spread.select("_j", F.when((past > 0) & F.col("_next").isNotNull(), F.col("_value") + (F.col("_next") - F.col("_value")) * past).otherwise(F.col("_value")).alias("_v"))
    means = written(profile.groupBy("_j").agg(F.avg("_v").alias("_v")))
    reference = means.join(means.select((F.col("_j") - 1).alias("_j"), F.col("_v").alias("_w")), "_j", "left")
    nth = F.row_number().over(Window.partitionBy(run, value).orderBy(*ties)) - 1
    ranked = known.withColumn("_nth", nth).join(levels, F.col(run).eqNullSafe(F.col("_run")) & (F.col(value) == F.col("_value")))
    place = (F.col("_from") + F.col("_nth")) * wide
    told = ranked.withColumn("_j", F.call_function("div", place, steps)).withColumn("_part", place % steps / steps).join(reference, "_j")
    told = told.withColumn(value, F.when(F.col("_part") > 0, F.col("_v") + (F.col("_w") - F.col("_v")) * F.col("_part")).otherwise(F.col("_v")))
    return told.select(*rows.columns).unionByName(rows.where(F.col(value).isNull()).withColumn(value, F.col(value).cast("double")).select(*rows.columns))


def spectral_library(rows: DataFrame, precursor: str, fragment: str, intensity: str, order: Sequence[Column], min_fragments: int = 4, rt: str | None = None) -> DataFrame:
    """One row per precursor and fragment (the first in ``order``), intensities relative to the precursor's strongest (10 000), retention
    time scaled to 0..100 over the library; precursors with fewer than ``min_fragments`` are left out."""
    nth = Window.partitionBy(precursor, fragment).orderBy(*order)
    once = rows.where(F.col(intensity).isNotNull()).withColumn("_n", F.row_number().over(nth)).where("_n = 1").drop("_n")
    own = Window.partitionBy(precursor)
    told = once.withColumn("_k", F.count(F.lit(1)).over(own)).where(F.col("_k") >= min_fragments).drop("_k")
    told = told.withColumn("relative_intensity", F.try_divide(F.col(intensity), F.max(intensity).over(own)) * 10000)
    if rt is None:
        return told
    ends = told.agg(F.min(rt).alias("_lo"), F.max(rt).alias("_hi"))
    return told.join(F.broadcast(ends)).withColumn("irt", F.try_divide(F.col(rt) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 100).drop("_lo", "_hi")
