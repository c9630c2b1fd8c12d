"""Error statistics of target scores against decoy scores.

All statistics are functions of a score's rank among decoys, so they are computed on tables of distinct
values (never on rows), in running scans that need no single task, and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import normal
from quantloom.operators.scan import ONE_TASK_BYTES, plan_bytes, running
from quantloom.runtime import written

#: Default lambdas, and the q-values of the summary table.
LAMBDAS = tuple(round(0.1 + 0.05 * i, 2) for i in range(8))
SUMMARY_QVALUES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)


def best_per_group(rows: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row with the highest score of each group (null and NaN scores don't count), ties by ``ties`` ascending."""
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc(), *[F.col(t).asc_nulls_first() for t in ties])
    valid = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return valid.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def score_values(rows: DataFrame, score: str, decoy: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with their numbers of targets and decoys; null and NaN scores are left out."""
    valid = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return valid.groupBy(*keys, F.col(score).alias("score")).agg(F.count(F.when(F.col(decoy) == 0, 1)).alias("t"), F.count(F.when(F.col(decoy) == 1, 1)).alias("d"))


def _with_totals(values: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    if keys:
        return values.join(values.groupBy(*keys).agg(*aggregates), list(keys))
    return values.join(F.broadcast(values.agg(*aggregates)))  # one row


def decoy_ranks(values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per score: ``above`` = decoys strictly above (at least 1), ``t_up`` = targets at or above, ``m`` targets and ``m0`` decoys in all."""
    scanned = running(values, "score", {"_d": ("sum", "d"), "t_up": ("sum", "t")}, keys, descending=True)
    ranked = scanned.withColumn("above", F.greatest(F.col("_d") - F.col("d"), F.lit(1))).drop("_d")
    return _with_totals(ranked, keys, [F.sum("t").alias("m"), F.sum("d").alias("m0")])


def p_levels(ranked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct p-values: ``pvalue``, ``n`` targets with it, ``n_pos`` targets at or below it."""
    levels = ranked.where("t > 0").groupBy(*keys, "above").agg(F.sum("t").alias("n"), F.max("t_up").alias("n_pos"), F.first("m").alias("m"), F.first("m0").alias("m0"))
    return levels.withColumn("pvalue", F.try_divide(F.col("above").cast("double"), F.col("m0").cast("double")))


def pi0_at(levels: DataFrame, lambdas: Sequence[float]) -> list[Column]:
    share = lambda at: F.sum(F.when(F.col("pvalue") >= at, F.col("n")).otherwise(0)) / F.sum("n") / (1 - at)
    return [share(at) for at in lambdas]


def pi0(levels: DataFrame, keys: Sequence[str] = (), lambdas: Sequence[float] | float = LAMBDAS, method: str = "bootstrap", smooth_df: int = 3, log: bool = False) -> DataFrame:
    """``keys, pi0``: the share of true nulls. A single lambda needs no method; else four or more are needed.

    ``bootstrap`` minimises the mean squared error against the 0.1th percentile; ``smoother`` takes the value at the last
    lambda of a least-squares polynomial of degree ``smooth_df``, which is a fixed weighting of the lambdas' estimates.
    """
    if isinstance(lambdas, (int, float)):
        return levels.groupBy(*keys).agg(F.least(pi0_at(levels, [lambdas])[0], F.lit(1.0)).alias("pi0"))
    _check_lambdas(lambdas)
    each = levels.groupBy(*keys).agg(F.array(*pi0_at(levels, lambdas)).alias("est"), F.array(*[F.sum(F.when(F.col("pvalue") >= at, F.col("n")).otherwise(0)) for at in lambdas]).alias("w"), F.sum("n").alias("m"))
    return each.select(*keys, _pi0_of([F.col("est")[i] for i in range(len(lambdas))], [F.col("w")[i] for i in range(len(lambdas))], F.col("m"), lambdas, method, smooth_df, log).alias("pi0"))


def _pi0_of(est: Sequence[Column], w: Sequence[Column], m: Column, lambdas: Sequence[float], method: str, smooth_df: int = 3, log: bool = False) -> Column:
    """The null share from the lambdas' estimates, their numbers of targets and the number of all targets."""
    if method == "smoother":
        import numpy as np

        x = np.vander(np.asarray(lambdas, float), smooth_df + 1)
        weights = (x @ np.linalg.pinv(x))[-1]
        values = [F.log(e) for e in est] if log else est
        smooth = reduce(Column.__add__, [float(c) * v for c, v in zip(weights, values)])
        return F.least(F.exp(smooth) if log else smooth, F.lit(1.0))
    if method != "bootstrap":
        raise ValueError("method must be bootstrap or smoother")
    ordered = F.array_sort(F.array(*est))
    least = ordered[0] + (ordered[1] - ordered[0]) * (0.001 * (len(lambdas) - 1))
    mse = [(w[i] / (m * m * (1 - at) ** 2)) * (1 - w[i] / m) + F.pow(est[i] - least, F.lit(2.0)) for i, at in enumerate(lambdas)]
    best = F.array_min(F.array(*[F.struct(e.alias("mse"), F.lit(i).alias("i"), est[i].alias("pi0")) for i, e in enumerate(mse)]))
    return F.least(best["pi0"], F.lit(1.0))


def _check_lambdas(lambdas: Sequence[float]) -> None:
    if len(lambdas) < 4:
        raise ValueError("at least four lambdas are needed")
    if min(lambdas) < 0 or max(lambdas) >= 1:
        raise ValueError("lambda must be within [0, 1)")


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _measured(joined: DataFrame, pfdr: bool) -> DataFrame:
    """Confusion numbers and rates from ``pvalue``, ``pi0``, ``m`` and ``n_pos``, with ``_q1`` and ``_sens`` before they are made monotone."""
    p, m, pos = F.col("pvalue"), F.col("m").cast("double"), F.col("n_pos").cast("double")
    null = F.col("pi0") * m
    positive_fdr = lambda x, of: F.try_divide(x, 1 - F.pow(of, m)) if pfdr else x
    base = joined.select(
        "*",
        positive_fdr(null * p / pos, 1 - p).alias("_q"),
        (pos - null * p).alias("tp"), (null * p).alias("fp"), (null * (1 - p)).alias("tn"), (m - pos - null * (1 - p)).alias("fn"),
    )
    base = base.select(
        "*",
        F.coalesce(F.try_divide("fp", null), F.lit(0.0)).alias("fpr"),
        _clamp(positive_fdr(F.col("fp") / pos, 1 - p)).alias("fdr"),
        _clamp(positive_fdr(F.coalesce(F.try_divide(F.col("fn"), m - pos), F.lit(0.0)), p)).alias("fnr"),
        _clamp(F.coalesce(F.try_divide("tp", m - null), F.lit(1.0))).alias("_sens"),
        F.least(F.col("_q"), F.lit(1.0)).alias("_q1"),
    )
    return base


def level_metrics(levels: DataFrame, null_share: DataFrame, keys: Sequence[str] = (), pfdr: bool = False) -> DataFrame:
    """q-value, s-value and confusion numbers of every distinct p-value."""
    joined = levels.join(null_share, list(keys)) if keys else levels.join(F.broadcast(null_share))
    base = _measured(joined, pfdr)
    up = running(base, "above", {"svalue": ("max", "_sens")}, keys)
    down = running(up, "above", {"qvalue": ("min", "_q1")}, keys, descending=True)
    return down.drop("_q", "_q1", "_sens")


METRICS = ("pvalue", "qvalue", "svalue", "tp", "fp", "tn", "fn", "fpr", "fdr", "fnr")


def error_table(rows: DataFrame, score: str, decoy: str, keys: Sequence[str] = (), lambdas: Sequence[float] | float = LAMBDAS, method: str = "bootstrap", pfdr: bool = False, local_fdr: bool = False, parametric: bool = False, one_task_bytes: int | None = None) -> DataFrame:
    """``keys, cutoff, n_targets`` and all metrics (with ``local_fdr`` also ``pep``): one row per distinct target score.

    Without decoys there are no p-values and the metrics are null; without targets there is no row. Nulls and
    NaN don't count. Each key has a model of its own. ``parametric`` takes p-values from a normal distribution fitted to the decoys
    instead of their ranks. Where the optimizer's upper estimate of the distinct values is below ``one_task_bytes``, one plan of windows gives the same without any
    job of its own.
    """
    values = score_values(rows, score, decoy, keys)
    if not (local_fdr or parametric) and plan_bytes(values) <= (ONE_TASK_BYTES if one_task_bytes is None else one_task_bytes):
        return _small_error_table(values, keys, lambdas, method, pfdr)
    # Written once: the distinct values are read by several scans, whose plans then know their true size.
    ranked = decoy_ranks(written(values), keys)
    if parametric:
        ranked, levels = parametric_levels(ranked, keys)
    else:
        levels = p_levels(ranked, keys)
    null_share = pi0(levels, keys, lambdas, method)
    told = level_metrics(levels, null_share, keys, pfdr)
    names = list(METRICS)
    if local_fdr:
        told = with_local_fdr(told, keys)
        names.append("pep")
    scores = ranked.where("t > 0").select(*keys, F.col("score").alias("cutoff"), F.col("t").alias("n_targets"), "above")
    return scores.join(told.select(*keys, "above", *names), [*keys, "above"]).select(*keys, "cutoff", "n_targets", *names)


def _small_error_table(values: DataFrame, keys: Sequence[str], lambdas: Sequence[float] | float, method: str, pfdr: bool) -> DataFrame:
    """The error table as windows over the distinct values of a key: one shuffle, no join and nothing written."""
    whole = Window.partitionBy(*keys)
    falling = whole.orderBy(F.col("score").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.select("*", F.greatest(F.sum("d").over(falling) - F.col("d"), F.lit(1)).alias("above"), F.sum("t").over(falling).alias("t_up"), F.sum("t").over(whole).alias("m"), F.sum("d").over(whole).alias("m0"))
    levels = ranked.where("t > 0").withColumn("pvalue", F.try_divide(F.col("above").cast("double"), F.col("m0").cast("double")))
    up_to = whole.orderBy("above")
    levels = levels.withColumn("n_pos", F.max("t_up").over(up_to.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    if isinstance(lambdas, (int, float)):
        null_share = F.least(F.sum(F.when(F.col("pvalue") >= lambdas, F.col("t")).otherwise(0)).over(whole) / F.sum("t").over(whole) / (1 - lambdas), F.lit(1.0))
    else:
        _check_lambdas(lambdas)
        w = [F.sum(F.when(F.col("pvalue") >= at, F.col("t")).otherwise(0)).over(whole) for at in lambdas]
        levels = levels.withColumns({f"_w{i}": c for i, c in enumerate(w)})
        counts = [F.col(f"_w{i}") for i in range(len(lambdas))]
        null_share = _pi0_of([c / F.col("m") / (1 - at) for c, at in zip(counts, lambdas)], counts, F.col("m"), lambdas, method)
    told = _measured(levels.withColumn("pi0", null_share), pfdr)
    so_far = lambda order: whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = told.withColumn("svalue", F.max("_sens").over(so_far(F.col("above").asc()))).withColumn("qvalue", F.min("_q1").over(so_far(F.col("above").desc())))
    return told.select(*keys, F.col("score").alias("cutoff"), F.col("t").alias("n_targets"), *METRICS)


def parametric_levels(ranked: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``ranked`` with a place in the order of scores for ``above``, and the level of each target score: its upper tail of the decoys' normal distribution."""
    n, total, squares = F.sum("d"), F.sum(F.col("d") * F.col("score")), F.sum(F.col("d") * F.col("score") * F.col("score"))
    fit = ranked.groupBy(*keys).agg(F.try_divide(total, n).alias("_mu"), F.sqrt(F.greatest(F.try_divide(squares - F.try_divide(total * total, n), n - 1), F.lit(0.0))).alias("_sd"))
    met = ranked.drop("above").join(fit, list(keys)) if keys else ranked.drop("above").join(F.broadcast(fit))
    placed = running(met.withColumn("_one", F.lit(1)), "score", {"above": ("sum", "_one")}, keys, descending=True).drop("_one")
    levels = placed.where("t > 0").select(*keys, "above", F.col("t").alias("n"), F.col("t_up").alias("n_pos"), "m", "m0", normal.upper_tail(F.try_divide(F.col("score") - F.col("_mu"), F.col("_sd"))).alias("pvalue"))
    return placed.drop("_mu", "_sd"), written(levels)


def normal_pvalues(rows: DataFrame, score: str, decoy: str) -> DataFrame:
    """Distinct target scores with the upper tail of a normal distribution fitted to the decoys."""
    fit = rows.where(F.col(decoy) == 1).agg(F.avg(score).alias("mu"), F.stddev_samp(score).alias("sd"))
    values = rows.where((F.col(decoy) == 0) & F.col(score).isNotNull()).groupBy(F.col(score).alias("cutoff")).agg(F.count(F.lit(1)).alias("n_targets"))
    return values.join(F.broadcast(fit)).select("cutoff", "n_targets", normal.upper_tail(F.try_divide(F.col("cutoff") - F.col("mu"), F.col("sd"))).alias("pvalue"))


#: The finest grid of the density estimate: as many points as the next power of two above the targets, up to this. Beyond a million
#: targets the bandwidth spans hundreds of points, and a finer grid changes no PEP by more than 1e-6.
MAX_GRID = 1 << 20


def _spline(x, y):
    """Second derivatives of the not-a-knot cubic spline through equally spaced points."""
    import numpy as np

    n, h = len(x), x[1] - x[0]
    rhs = 6 * (y[2:] - 2 * y[1:-1] + y[:-2]) / h**2
    # Not-a-knot on equal spacing: m0 = 2 m1 - m2 and the same at the end.
    low, diagonal, high = np.ones(n - 2), np.full(n - 2, 4.0), np.ones(n - 2)
    diagonal[0] = diagonal[-1] = 6.0
    high[0] = low[-1] = 0.0
    for i in range(1, n - 2):
        w = low[i] / diagonal[i - 1]
        diagonal[i] -= w * high[i - 1]
        rhs[i] -= w * rhs[i - 1]
    inner = np.empty(n - 2)
    inner[-1] = rhs[-1] / diagonal[-1]
    for i in range(n - 4, -1, -1):
        inner[i] = (rhs[i] - high[i] * inner[i + 1]) / diagonal[i]
    return np.concatenate([[2 * inner[0] - inner[1]], inner, [2 * inner[-1] - inner[-2]]])


def density_pieces(weights, low: float, high: float, n: float, bandwidth: float):
    """Cubic pieces (constant to cubic, in units of the bin) of a Gaussian density on a grid of linearly binned weights."""
    import numpy as np

    size = len(weights)
    delta = (high - low) / (size - 1)
    span = high - low
    transformed = np.fft.rfft(weights / (delta * n))
    k = np.arange(len(transformed))
    kernel = np.exp(-0.5 * (2 * np.pi * bandwidth * k / span) ** 2)
    ends = 1 - (np.pi * k / size) ** 2 / 3
    with np.errstate(divide="ignore", invalid="ignore"):
        kernel = np.where(ends > 0, kernel / np.maximum(ends, 1e-12), kernel)
    dens = np.fft.irfft(transformed * np.where(kernel < 1e-17, 0, kernel), size)
    dens /= dens.sum() * delta
    m = _spline(low + delta * np.arange(size), dens) * delta**2
    return np.stack([dens[:-1], dens[1:] - dens[:-1] - (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, (m[1:] - m[:-1]) / 6], axis=1)


def with_local_fdr(levels: DataFrame, keys: Sequence[str] = (), transform: str = "probit", adjust: float = 1.5, eps: float = 1e-8, truncate: bool = True, monotone: bool = True) -> DataFrame:
    """``levels`` with ``pep``, the local false discovery rate of each distinct p-value.

    The density of the transformed p-values is binned by an aggregate, smoothed on a grid of
    at most ``MAX_GRID`` points, and comes back as one cubic piece per bin, which levels look up by an equi join.
    """
    levels = written(levels)
    p = F.least(F.greatest("pvalue", F.lit(eps)), F.lit(1 - eps))
    x = normal.quantile(p) if transform == "probit" else F.log((F.col("pvalue") + eps) / (1 - F.col("pvalue") + eps))
    placed = levels.withColumn("_x", x)

    def quarter(q: float) -> Column:
        """The quantile over all targets: levels are in order and know how many targets come up to them, so no group is gathered."""
        place = (F.col("m") - 1) * q
        reached = lambda k: F.min(F.when(F.col("n_pos") > k, F.col("_x")))
        low, high, part = reached(F.floor(place)), reached(F.ceil(place)), F.first(place - F.floor(place))
        return low + (high - low) * part

    count, mean_sq, mean = F.sum("n"), F.sum(F.col("_x") * F.col("_x") * F.col("n")), F.sum(F.col("_x") * F.col("n"))
    shape = placed.groupBy(*keys).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), count.alias("_n"), mean_sq.alias("_ss"), mean.alias("_s"), (quarter(0.75) - quarter(0.25)).alias("_iqr"), F.first("_x").alias("_any"))
    sd = F.sqrt(F.greatest(F.try_divide(F.col("_ss") - F.try_divide(F.col("_s") * F.col("_s"), F.col("_n")), F.col("_n") - 1), F.lit(0.0)))
    spread = F.least(sd, F.col("_iqr") / 1.34)
    spread = F.coalesce(F.nullif(spread, F.lit(0.0)), F.nullif(sd, F.lit(0.0)), F.nullif(F.abs("_any"), F.lit(0.0)), F.lit(1.0))
    size = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("_n"), F.lit(512))))), F.lit(float(MAX_GRID)))
    shape = shape.withColumn("_bw", 0.9 * spread * F.pow("_n", F.lit(-0.2)) * adjust).withColumn("_size", size.cast("int"))
    shape = shape.select(*keys, "_n", "_bw", "_size", (F.col("_a") - 3 * F.col("_bw")).alias("_low"), (F.col("_b") + 3 * F.col("_bw")).alias("_high"))
    placed = placed.join(shape, list(keys)) if keys else placed.join(F.broadcast(shape))
    at = (F.col("_x") - F.col("_low")) / ((F.col("_high") - F.col("_low")) / (F.col("_size") - 1))
    placed = placed.withColumn("_at", at).withColumn("_bin", F.least(F.floor("_at"), F.col("_size") - 2).cast("int")).withColumn("_u", F.col("_at") - F.col("_bin"))
    halves = placed.select(*keys, F.inline(F.array(F.struct(F.col("_bin").alias("_g"), (F.col("n") * (1 - F.col("_u"))).alias("_w")), F.struct((F.col("_bin") + 1).alias("_g"), (F.col("n") * F.col("_u")).alias("_w")))))
    binned = halves.groupBy(*keys, "_g").agg(F.sum("_w").alias("_w")).groupBy(*keys).agg(F.collect_list(F.struct("_g", "_w")).alias("_bins"))
    grid = binned.join(shape, list(keys)) if keys else binned.join(F.broadcast(shape))

    @F.pandas_udf("array<struct<g:int,c0:double,c1:double,c2:double,c3:double>>")
    def pieces(bins, size, low, high, n, bw):
        import numpy as np
        import pandas as pd

        out = []
        for b, s, lo, hi, count_, w in zip(bins, size, low, high, n, bw):
            weights = np.zeros(s)
            for e in b:
                weights[e["_g"]] = e["_w"]
            cubic = density_pieces(weights, lo, hi, count_, w)
            used = sorted({g for e in b for g in (e["_g"] - 1, e["_g"]) if 0 <= g < s - 1})
            out.append([{"g": int(g), "c0": c[0], "c1": c[1], "c2": c[2], "c3": c[3]} for g in used for c in [cubic[g]]])
        return pd.Series(out)

    curve = grid.select(*keys, F.inline(pieces("_bins", "_size", "_low", "_high", "_n", "_bw"))).withColumnRenamed("g", "_bin")
    met = placed.join(curve, [*keys, "_bin"])
    u = F.col("_u")
    density = F.col("c0") + u * (F.col("c1") + u * (F.col("c2") + u * F.col("c3")))
    f0 = normal.density(F.col("_x")) if transform == "probit" else F.exp("_x") / F.pow(1 + F.exp("_x"), F.lit(2.0))
    raw = F.try_divide(F.col("pi0") * f0, density)
    met = written(met.withColumn("_pep", F.least(raw, F.lit(1.0)) if truncate else raw).select(*levels.columns, "_pep"))
    if not monotone:
        return met.withColumnRenamed("_pep", "pep")
    return running(met, "above", {"pep": ("max", "_pep")}, keys).drop("_pep")


def nearest(values: DataFrame, value: str, basis: DataFrame, at: str, keys: Sequence[str] = ()) -> DataFrame:
    """``values`` joined to the nearest row of ``basis`` (half-way: the upper one), within each key; both sides ordered by one scan.

    Values are compared as floats of 32 bits; of several basis rows that are equal then, the least is met. Rows with a null value, or
    whose key has no basis row, get nulls.
    """
    columns = [c for c in basis.columns if c not in (at, *keys)]
    small = plan_bytes(basis) <= ONE_TASK_BYTES and plan_bytes(values) <= ONE_TASK_BYTES
    basis = basis if small else written(basis)  # distinct values, read twice
    one = basis.where(F.col(at).isNotNull()).groupBy(*keys, F.col(at).cast("float").alias("_v")).agg(F.min(F.struct(F.col(at), *columns)).alias("_row"))
    wanted = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("float").alias("_v")).distinct()
    if small:  # one window each way carries the rows themselves
        both = one.select(*keys, "_v", "_row").unionByName(wanted.select(*keys, "_v", F.lit(None).cast(dict(one.dtypes)["_row"]).alias("_row")))
        way = lambda o: Window.partitionBy(*keys).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.last(F.when(F.col("_row").isNotNull(), F.struct("_v", "_row")), ignorenulls=True)
        near = both.select(*keys, "_v", F.col("_row").isNull().alias("_asked"), last.over(way(F.col("_v").asc())).alias("_lo"), last.over(way(F.col("_v").desc())).alias("_hi")).where("_asked")
        nearer = (F.col("_v") - F.col("_lo._v")) < (F.col("_hi._v") - F.col("_v"))
        pick = F.when(F.col("_lo").isNull(), F.col("_hi")).when(F.col("_hi").isNull(), F.col("_lo")).when(nearer, F.col("_lo")).otherwise(F.col("_hi"))
        found = near.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_v").alias("_want"), pick.alias("_met")).select(*[f"_k{i}" for i in range(len(keys))], "_want", "_met._row.*")
        return _met(values, value, found, keys)
    both = one.select(*keys, "_v", F.lit(1).alias("_is")).unionByName(wanted.select(*keys, "_v", F.lit(0).alias("_is"))).groupBy(*keys, "_v").agg(F.max("_is").alias("_is"))
    marked = both.withColumn("_b", F.when(F.col("_is") == 1, F.col("_v")))
    near = running(running(marked, "_v", {"_lo": ("max", "_b")}, keys), "_v", {"_hi": ("min", "_b")}, keys, descending=True)
    lower_is_nearer = (F.col("_v") - F.col("_lo")) < (F.col("_hi") - F.col("_v"))
    pick = F.when(F.col("_lo").isNull(), F.col("_hi")).when(F.col("_hi").isNull(), F.col("_lo")).when(lower_is_nearer, F.col("_lo")).otherwise(F.col("_hi"))
    found = near.select(*keys, F.col("_v").alias("_want"), pick.alias("_v")).join(one, [*keys, "_v"])
    found = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_want", "_row.*")
    return _met(values, value, found, keys)


def _met(values: DataFrame, value: str, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``values`` with what was found for them."""
    same = F.col(value).cast("float") == F.col("_want")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return values.join(found, same, "left").drop("_want", *[f"_k{i}" for i in range(len(keys))])


def final_error_table(table: DataFrame, points: int = 51) -> DataFrame:
    """``points`` evenly spaced cutoffs over the range of cutoffs and 5 % beyond, each with the nearest row's statistics."""
    ends = table.agg(F.min("cutoff").alias("lo"), F.max("cutoff").alias("hi")).where("lo IS NOT NULL")
    margin = (F.col("hi") - F.col("lo")) * 0.05
    low, high = F.col("lo") - margin, F.col("hi") + margin
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), low.alias("low"), high.alias("high"))
    grid = grid.select("i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (points - 1)).cast("float").alias("sampled"))
    return nearest(grid, "sampled", table, "cutoff").drop("cutoff").withColumnRenamed("sampled", "cutoff")


def summary_error_table(table: DataFrame, qvalues: Sequence[float] = SUMMARY_QVALUES) -> DataFrame:
    """The row nearest to each of the given q-values; rows hit again are blank but for the q-value. Ties: the lowest cutoff."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(i, float(q)) for i, q in enumerate(qvalues)], "i int, asked double")
    first = table.groupBy("qvalue").agg(F.min_by(F.struct(*[c for c in table.columns if c != "qvalue"]), "cutoff").alias("_r")).select("qvalue", "_r.*")
    met = nearest(asked, "asked", first, "qvalue")
    before = F.lag("qvalue").over(Window.orderBy("i"))  # as many rows as q-values asked for
    again = F.coalesce(before == F.col("qvalue"), F.lit(False))
    others = [c for c in table.columns if c != "qvalue"]
    return met.withColumn("_again", again).select(F.col("asked").alias("qvalue"), *[F.when(~F.col("_again"), F.col(c)).alias(c) for c in others])


def find_cutoff(table: DataFrame, fdr: float) -> DataFrame:
    """The lowest cutoff whose q-value is nearest to ``fdr``, as one row."""
    return table.agg(F.min_by("cutoff", F.struct(F.abs(F.col("qvalue") - fdr), F.col("cutoff"))).alias("cutoff"))


def model_fdr(rows: DataFrame, pep: str, keys: Sequence[str] = (), name: str = "model_fdr") -> DataFrame:
    """``rows`` with the mean of all error probabilities up to their own (peers included), per key."""
    levels = rows.where(F.col(pep).isNotNull()).groupBy(*keys, F.col(pep).alias("_pep")).agg(F.count(F.lit(1)).alias("_n"))
    levels = levels.withColumn("_mass", F.col("_pep") * F.col("_n"))
    scanned = running(levels, "_pep", {"_cum": ("sum", "_mass"), "_cn": ("sum", "_n")}, keys)
    told = scanned.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_pep", (F.col("_cum") / F.col("_cn")).alias(name))
    same = F.col(pep) == F.col("_pep")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(told, same, "left").select(*rows.columns, name)


def d_scores(rows: DataFrame, score: str, decoy: str, keys: Sequence[str] = (), name: str = "d_score") -> DataFrame:
    """Scores shifted and scaled so that the decoys have mean 0 and standard deviation 1."""
    fit = rows.where(F.col(decoy) == 1).groupBy(*keys).agg(F.avg(score).alias("_mu"), F.stddev_samp(score).alias("_sd"))
    joined = rows.join(F.broadcast(fit), list(keys), "left") if keys else rows.join(F.broadcast(fit))
    return joined.withColumn(name, F.try_divide(F.col(score) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")


#: Numerator and denominator of the hypotheses are kept at this scale, so that odds of the least positive number don't overflow.
_SCALE = 1e-290


def chromatogram_hypotheses(rows: DataFrame, groups: Sequence[str], pep: str, prior_null: float = 0.2) -> DataFrame:
    """``rows`` with ``h_score`` (this peak is right, all others wrong) and ``h0_score`` (all are wrong) of their group.

    The product of all error probabilities cancels, so only odds are added up and nothing underflows. With one zero among them that peak is
    right; with several no hypothesis is possible and both are null. A peak with null ``pep`` gets nulls and counts only in the prior.
    """
    odds = F.when(F.col(pep) > 0, (1 - F.col(pep)) * (F.lit(_SCALE) / F.col(pep)))
    facts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(pep) == 0, 1)).alias("_zeros"), F.coalesce(F.sum(odds), F.lit(0.0)).alias("_odds"))
    met = rows.join(facts, list(groups))
    prior = (1 - F.lit(prior_null)) / F.col("_n")
    nil = F.lit(prior_null * _SCALE)
    total = prior * F.col("_odds") + nil
    own = F.when(F.col("_zeros") == 0, F.try_divide(prior * odds, total)).when((F.col("_zeros") == 1) & F.col(pep).isNotNull(), (F.col(pep) == 0).cast("double"))
    null = F.when(F.col(pep).isNull(), None).when(F.col("_zeros") == 0, F.try_divide(nil, total)).when(F.col("_zeros") == 1, 0.0)
    return met.select(*rows.columns, own.alias("h_score"), null.alias("h0_score"))
