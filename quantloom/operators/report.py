"""The tables behind reports: counts, variation, overlap and correlation of runs, curves, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_counts(rows: DataFrame, run: str, ident: str, qvalue: str, thresholds: Sequence[float] = (0.01, 0.05, 0.1)) -> DataFrame:
    """Distinct identifications below each threshold, per run and in all (run null)."""
    counts = [F.count_distinct(F.when(F.col(qvalue) < t, F.col(ident))).alias(f"n_{str(t).replace('0.', '')}") for t in thresholds]
    return rows.groupBy(run).agg(*counts).unionByName(rows.agg(*counts).withColumn(run, F.lit(None).cast(dict(rows.dtypes)[run])))


def run_summary(rows: DataFrame, run: str, ident: str, value: str) -> DataFrame:
    """Rows, distinct identifications, and mean, exact median, deviation and range of the values, per run."""
    from quantloom.operators.scan import quantiles

    plain = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(ident).alias("n_ids"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    middle = quantiles(rows, value, [run], {"median": 0.5}).withColumnRenamed(run, "_run")  # a row a run
    return plain.join(F.broadcast(middle), F.col(run).eqNullSafe(F.col("_run")), "left").select(run, "n", "n_ids", "mean", "median", "std", "min", "max")


def variation(rows: DataFrame, ident: str, run: str, value: str, min_runs: int = 2) -> DataFrame:
    """Coefficient of variation over runs of each identification seen in at least ``min_runs``."""
    per_run = rows.groupBy(ident, run).agg(F.max(value).alias("_v"))
    told = per_run.groupBy(ident).agg(F.count(F.lit(1)).alias("n_runs"), F.try_divide(F.stddev_samp("_v"), F.avg("_v")).alias("cv"))
    return told.where(F.col("n_runs") >= min_runs)


def _pairs(per_run: DataFrame, ident: str, run: str, values: Sequence[str]) -> DataFrame:
    """Ordered pairs of runs that share an identification; an identification has at most one row per run, so pairs grow with runs squared only."""
    a = per_run.select(ident, F.col(run).alias("run_a"), *[F.col(v).alias(f"{v}_a") for v in values])
    b = per_run.select(ident, F.col(run).alias("run_b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, ident).where("run_a < run_b")


def jaccard(rows: DataFrame, ident: str, run: str) -> DataFrame:
    """Shared over all identifications of every pair of runs that share any.

    Identifications with the same set of runs are counted together, so a set's pairs of runs are formed once, not once for each
    identification; counts add up before the shuffle.
    """
    once = rows.where(F.col(ident).isNotNull() & F.col(run).isNotNull()).select(ident, run).distinct()
    sizes = once.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    sets = once.groupBy(ident).agg(F.sort_array(F.collect_list(run)).alias("_own")).groupBy("_own").agg(F.count(F.lit(1)).alias("n"))
    firsts = sets.select("n", "_own", F.posexplode("_own").alias("_i", "run_a"))
    common = firsts.select("n", "run_a", F.explode(F.slice("_own", F.col("_i") + 2, F.size("_own"))).alias("run_b")).groupBy("run_a", "run_b").agg(F.sum("n").alias("common"))
    a, b = sizes.select(F.col(run).alias("run_a"), F.col("n").alias("na")), sizes.select(F.col(run).alias("run_b"), F.col("n").alias("nb"))
    return common.join(F.broadcast(a), "run_a").join(F.broadcast(b), "run_b").select("run_a", "run_b", "common", F.try_divide("common", F.col("na") + F.col("nb") - F.col("common")).alias("jaccard"))


def spearman(rows: DataFrame, ident: str, run: str, value: str) -> DataFrame:
    """Rank correlation of every pair of runs over the identifications both have (average ranks among them)."""
    once = rows.groupBy(ident, run).agg(F.max(value).alias("v")).where("v IS NOT NULL")
    met = _pairs(once, ident, run, ["v"])
    ranks = met
    for side in ("a", "b"):
        by = Window.partitionBy("run_a", "run_b").orderBy(f"v_{side}")
        peers = Window.partitionBy("run_a", "run_b", f"v_{side}")
        ranks = ranks.withColumn(f"r_{side}", F.rank().over(by) + (F.count(F.lit(1)).over(peers) - 1) / 2)
    return ranks.groupBy("run_a", "run_b").agg(F.count(F.lit(1)).alias("n"), F.corr("r_a", "r_b").alias("rho"))


def in_all_runs(rows: DataFrame, ident: str, run: str) -> DataFrame:
    """How many identifications are seen in exactly 1, 2, .. runs."""
    return rows.groupBy(ident).agg(F.count_distinct(run).alias("n_runs")).groupBy("n_runs").agg(F.count(F.lit(1)).alias("n_ids"))


def consistency_curve(rows: DataFrame, ident: str, run: str, draws: int = 100, seed: int = 7) -> DataFrame:
    """For k = 1..runs: mean over random orders of the runs of the identifications common to the first k, and of those in any.

    An identification's first place and the first place it lacks decide both. Identifications are counted by their set of runs,
    and the draws, an array of places each, are broadcast, so that no draw shuffles the identifications.
    """
    once = rows.select(ident, run).distinct()
    runs = once.select(run).distinct()
    order = Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("-", F.col(run).cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))), run)
    numbered = runs.withColumn("_i", F.row_number().over(Window.orderBy(run)) - 1)
    places = numbered.select(run, "_i", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("place", F.row_number().over(order))
    drawn = places.groupBy("draw").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "place"))), lambda x: x["place"]).alias("_places"))
    sets = once.join(F.broadcast(numbered), run).groupBy(ident).agg(F.sort_array(F.collect_list("_i")).alias("_own")).groupBy("_own").agg(F.count(F.lit(1)).alias("n"))
    sets = sets.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but many draws of each
    seen = sets.join(F.broadcast(drawn)).select("draw", "n", F.sort_array(F.transform("_own", lambda i: F.get("_places", i))).alias("all"))
    # Common to the first k: the places 1..k are all there, so k < first missing place.
    gap = F.aggregate("all", F.lit(0), lambda reached, x: F.when(x == reached + 1, x).otherwise(reached))
    told = seen.select("draw", "n", F.get("all", F.lit(0)).alias("first"), gap.alias("until"))
    ks = runs.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    spans = told.groupBy("draw", "first", "until").agg(F.sum("n").alias("n"))
    per_draw = spans.join(F.broadcast(ks), (F.col("first") <= F.col("k"))).groupBy("draw", "k").agg(F.sum("n").alias("any"), F.sum(F.when(F.col("until") >= F.col("k"), F.col("n")).otherwise(0)).alias("common"))
    return per_draw.groupBy("k").agg((F.sum("any") / draws).alias("mean_any"), (F.sum("common") / draws).alias("mean_common"))


def ecdf(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the share of rows at or below them."""
    from quantloom.operators.scan import running

    levels = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    scanned = running(levels, value, {"_cum": ("sum", "_n")}, keys)
    totals = levels.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    met = scanned.join(totals, list(keys)) if keys else scanned.join(F.broadcast(totals))
    return met.select(*keys, value, (F.col("_cum") / F.col("_all")).alias("ecdf"))


def linear_bins(rows: DataFrame, value: str, low: float | None = None, high: float | None = None, bins: int = 512) -> DataFrame:
    """Weights on ``bins`` + 1 grid points, each value shared between its two neighbours: the first step of a density estimate.

    The grid spans the values unless its ends are given; values beyond given ends go to the end points. Nulls and NaN don't count.
    """
    known = rows.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    ends = known.agg(*[F.lit(float(x)).alias(n) if x is not None else f("_v").alias(n) for n, x, f in (("_lo", low, F.min), ("_hi", high, F.max))])
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.greatest(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), step), F.lit(0.0)), F.lit(0.0)), F.lit(float(bins)))
    placed = known.join(F.broadcast(ends)).select(at.alias("_at")).select("_at", F.least(F.floor("_at"), F.lit(bins - 1)).cast("int").alias("_b"))  # one row
    u = F.col("_at") - F.col("_b")
    both = placed.select(F.inline(F.array(F.struct(F.col("_b").alias("bin"), (1 - u).alias("w")), F.struct((F.col("_b") + 1).alias("bin"), u.alias("w")))))
    return both.groupBy("bin").agg(F.sum("w").alias("weight"))


def density_curve(rows: DataFrame, value: str, points: int = 512, factor: float = 0.25) -> DataFrame:
    """``x, density`` of a Gaussian density with bandwidth ``factor`` times the standard deviation, on a fixed grid of ``points``.

    Only grid weights (``points`` numbers) reach the driver.
    """
    import numpy as np

    low, high, sd, n = rows.agg(F.min(value), F.max(value), F.stddev_samp(value), F.count(value)).first()
    spark = rows.sparkSession
    if not n or not sd:
        return spark.createDataFrame([], "x double, density double")
    band = factor * sd
    low, high = low - 3 * band, high + 3 * band
    grid = np.zeros(points)
    for r in linear_bins(rows, value, low, high, points - 1).collect():
        grid[r["bin"]] = r["weight"]
    x = np.linspace(low, high, points)
    reach = np.arange(-points + 1, points) * (x[1] - x[0])
    kernel = np.exp(-0.5 * (reach / band) ** 2) / (band * np.sqrt(2 * np.pi))
    size = 1 << int(np.ceil(np.log2(3 * points)))
    dens = np.fft.irfft(np.fft.rfft(grid, size) * np.fft.rfft(kernel, size), size)[points - 1 : 2 * points - 1] / n
    return spark.createDataFrame([(float(a), float(max(b, 0.0))) for a, b in zip(x, dens)], "x double, density double")


def coelution_bins(rows: DataFrame, keys: Sequence[str], rt: Column, intensity: str, width: float = 35.0) -> DataFrame:
    """Points summed in bins of ``width`` from each key's first point: the apex bin of each key."""
    firsts = rows.groupBy(*keys).agg(F.min(rt).alias("_first"))
    binned = rows.join(firsts, list(keys)).groupBy(*keys, F.floor((rt - F.col("_first") + 1) / width).cast("int").alias("bin")).agg(F.sum(intensity).alias("intensity"))
    return binned.groupBy(*keys).agg(F.max_by("bin", F.struct("intensity", -F.col("bin"))).alias("apex_bin"), F.count(F.lit(1)).alias("n_bins"))


def local_peaks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, reach: int) -> DataFrame:
    """Points that are the maximum of the ``reach`` points on both sides."""
    around = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach)
    return rows.withColumn("_top", F.max(value).over(around)).where(F.col(value) == F.col("_top")).drop("_top")


def linear_fit(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))
