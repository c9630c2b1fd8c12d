"""Glycopeptide scoring: combined ranks, mass windows, compositions, and the two-dimensional density error model of both parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combined_rank(rows: DataFrame, groups: Sequence[str], weights: Mapping[str, float], ties: Sequence[str]) -> DataFrame:
    """``rows`` with ``combined``, the weighted sum of the part scores, and its ``rank`` within the group from 1."""
    total = reduce(Column.__add__, [F.col(c) * float(w) for c, w in weights.items()])
    scored = rows.withColumn("combined", F.round(total, 9))
    order = Window.partitionBy(*groups).orderBy(F.col("combined").desc_nulls_last(), *[F.col(t) for t in ties])
    return scored.withColumn("rank", F.row_number().over(order))


def normalised_weights(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if total == 0:
        raise ValueError("weights sum to zero")
    return {k: w / total for k, w in weights.items()}


def mass_matches(features: DataFrame, glycans: DataFrame, key: str, mass: str, glycan_mass: str, charge: str, mz: str, ppm: float) -> DataFrame:
    """Pairs of a feature and a candidate glycan of the same ``key`` whose mass difference is within ``ppm`` of the feature's m/z."""
    met = features.join(glycans, key)
    return met.where(F.abs(F.col(mass) - F.col(glycan_mass)) / (F.col(charge) * F.col(mz)) * 1e6 <= ppm)


def composition_posterior(rows: DataFrame) -> DataFrame:
    """``feature_id, composition, hypothesis, posterior``: structures' posteriors summed by composition, with the likeliest structure of each."""
    sums = rows.groupBy("feature_id", "composition").agg(F.sum("posterior").alias("posterior"), F.max_by("hypothesis", F.struct("posterior", "hypothesis")).alias("hypothesis"))
    return sums


def weighted_fdr(rows: DataFrame, pep: str, weight: str, name: str = "fdr") -> DataFrame:
    """``rows`` with the weighted mean of all error probabilities up to their own (peers included): the FDR of a region of a density."""
    from quantloom.operators.scan import running

    levels = rows.where(F.col(pep).isNotNull()).groupBy(F.col(pep).alias("_pep")).agg(F.sum(weight).alias("_w")).withColumn("_mass", F.col("_pep") * F.col("_w"))
    told = running(levels, "_pep", {"_cum": ("sum", "_mass"), "_cw": ("sum", "_w")}).select("_pep", F.coalesce(F.try_divide("_cum", "_cw"), F.lit(0.0)).alias(name))
    return rows.join(told, F.col(pep) == F.col("_pep"), "left").drop("_pep")


#: Points of the score grid on each side, and components of the mixtures of targets, of decoys in one part, and of decoys in both.
GRID, COMPONENTS = 256, {"target": 4, "decoy_peptide": 2, "decoy_glycan": 2, "decoy_both": 1}
ERRORS = ("pep", "pep_peptide", "pep_glycan", "pep_both", "qvalue")
_KINDS = {"target": (0, 0), "decoy_peptide": (1, 0), "decoy_glycan": (0, 1), "decoy_both": (1, 1)}


def _mixture(rows: DataFrame, x: str, y: str, components: int, seed: int):
    """The density of a Gaussian mixture (MLlib), as a function of points; only its parameters reach the driver."""
    import numpy as np
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    if components == 1:
        m = rows.agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.covar_pop(x, x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.covar_pop(y, y).alias("yy")).first()
        parts = [(1.0, np.array([m["x"], m["y"]]), np.array([[m["xx"], m["xy"]], [m["xy"], m["yy"]]]))]
    else:
        model = GaussianMixture(featuresCol="_xy", k=components, seed=seed, maxIter=100).fit(VectorAssembler(inputCols=[x, y], outputCol="_xy").transform(rows.select(x, y)))
        parts = [(w, np.array(g.mean.toArray()), np.array(g.cov.toArray())) for w, g in zip(model.weights, model.gaussians)]

    def density(points):
        total = np.zeros(len(points))
        for w, mean, cov in parts:
            cov = cov + np.eye(2) * 1e-9
            d = points - mean
            total += w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)) / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
        return total

    return density


def _kernel_density(rows: DataFrame, x: str, y: str, gx, gy):
    """The density of a Gaussian kernel (Scott's rule, the rows' covariance) on the grid; values are shared among the four grid points around them, so
    only grid weights and moments reach the driver."""
    import numpy as np

    step = (gx[1] - gx[0], gy[1] - gy[0])
    at = [F.least(F.greatest((F.col(c) - float(g[0])) / float(h), F.lit(0.0)), F.lit(float(len(g) - 1))) for c, g, h in ((x, gx, step[0]), (y, gy, step[1]))]
    placed = rows.select(at[0].alias("_u"), at[1].alias("_v")).select("_u", "_v", F.least(F.floor("_u"), F.lit(len(gx) - 2)).cast("int").alias("_i"), F.least(F.floor("_v"), F.lit(len(gy) - 2)).cast("int").alias("_j"))
    u, v = F.col("_u") - F.col("_i"), F.col("_v") - F.col("_j")
    corners = F.array(*[F.struct((F.col("_i") + di).alias("i"), (F.col("_j") + dj).alias("j"), ((u if di else 1 - u) * (v if dj else 1 - v)).alias("w")) for di in (0, 1) for dj in (0, 1)])
    weights = np.zeros((len(gx), len(gy)))
    for r in placed.select(F.inline(corners)).groupBy("i", "j").agg(F.sum("w").alias("w")).collect():  # at most the grid's points
        weights[r["i"], r["j"]] = r["w"]
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.covar_samp(x, x).alias("xx"), F.covar_samp(x, y).alias("xy"), F.covar_samp(y, y).alias("yy")).first()
    cov = np.array([[m["xx"], m["xy"]], [m["xy"], m["yy"]]]) * m["n"] ** (-1 / 3) + np.eye(2) * 1e-12
    a, b = np.meshgrid(np.arange(-len(gx) + 1, len(gx)) * step[0], np.arange(-len(gy) + 1, len(gy)) * step[1], indexing="ij")
    inv = np.linalg.inv(cov)
    kernel = np.exp(-0.5 * (inv[0, 0] * a * a + 2 * inv[0, 1] * a * b + inv[1, 1] * b * b)) / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
    size = [n + k - 1 for n, k in zip(weights.shape, kernel.shape)]
    full = np.fft.irfft2(np.fft.rfft2(weights, size) * np.fft.rfft2(kernel, size), size)
    return np.maximum(full[len(gx) - 1 : 2 * len(gx) - 1, len(gy) - 1 : 2 * len(gy) - 1], 0) / m["n"]


def mixture_errors(densities: Mapping, pi0: Mapping[str, float], monotone: bool = True) -> dict:
    """Error probabilities at the points of a grid from the densities of targets and the three kinds of decoys (arrays) and the null shares of
    ``peptide``, ``glycan`` and ``both``.

    A target is wrong in both parts (share ``both``), in one of them, or right. What decoys of one part show is a mixture with what
    decoys of both show, and taking that off gives the density of the part that is wrong alone. From the point where right ones are densest, no
    error falls with the distance on either axis below it or rises above it (``monotone``).
    """
    import numpy as np

    both = pi0["both"]
    peptide, glycan = max(0.0, pi0["peptide"] - both), max(0.0, pi0["glycan"] - both)
    right = max(0.0, 1 - both - peptide - glycan)
    safe = lambda top, by: np.maximum(top / by, 0) if by > 0 else np.zeros_like(top)
    all_wrong, target = densities["decoy_both"], densities["target"]
    peptide_wrong = safe(densities["decoy_peptide"] - (both + glycan) * all_wrong, peptide + right)
    glycan_wrong = safe(densities["decoy_glycan"] - (both + peptide) * all_wrong, glycan + right)
    correct = safe(target - both * all_wrong - peptide * peptide_wrong - glycan * glycan_wrong, right)
    part = lambda top: np.divide(top, target, out=np.zeros_like(target), where=target > 0)
    out = {"pep_both": part(both * all_wrong), "pep_peptide": part(both * all_wrong + peptide * peptide_wrong), "pep_glycan": part(both * all_wrong + glycan * glycan_wrong)}
    out["pep"] = out["pep_peptide"] + out["pep_glycan"] - out["pep_both"]
    i, j = np.unravel_index(np.argmax(correct), correct.shape)
    for name, values in out.items():
        values = np.minimum(values, 1)
        if monotone:  # away from the densest point towards low scores errors only rise, towards high scores they only fall
            for axis, k in ((0, i), (1, j)):
                v = np.moveaxis(values, axis, 0).copy()
                v[: k + 1] = np.maximum.accumulate(v[k::-1], axis=0)[::-1]
                v[k:] = np.minimum.accumulate(v[k:], axis=0)
                values = np.moveaxis(v, 0, axis)
        out[name] = values
    order = np.argsort(out["pep"], axis=None, kind="stable")
    pep, mass = out["pep"].ravel()[order], target.ravel()[order]
    wrong, every = np.cumsum(pep * mass), np.cumsum(mass)
    mean = np.divide(wrong, every, out=np.zeros_like(wrong), where=every > 0)
    last = np.searchsorted(pep, pep, side="right") - 1  # peers share the mean of the last of them
    q = np.empty(out["pep"].size)
    q[order] = mean[last]
    return out | {"qvalue": q.reshape(out["pep"].shape)}


def part_null_shares(rows: DataFrame, x: str, y: str, combined: str, lambdas=0.4) -> dict[str, float]:
    """The null shares of targets in the peptide part, the glycan part and both, each against the decoys of that part alone."""
    from quantloom.operators import stats

    out = {}
    for name, column, (p, g) in (("peptide", x, (1, 0)), ("glycan", y, (0, 1)), ("both", combined, (1, 1))):
        mine = rows.where(f"(decoy_peptide = 0 AND decoy_glycan = 0) OR (decoy_peptide = {p} AND decoy_glycan = {g})")
        own = mine.select(F.col(column).alias("s"), F.greatest("decoy_peptide", "decoy_glycan").alias("d"))
        found = stats.pi0(stats.p_levels(stats.decoy_ranks(stats.score_values(own, "s", "d"))), lambdas=lambdas).first()
        out[name] = 1.0 if found is None or found["pi0"] is None else found["pi0"]
    return out


def density_errors(rows: DataFrame, x: str = "d_score_peptide", y: str = "d_score_glycan", combined: str = "d_score", estimator: str = "gmm", pi0: Mapping[str, float] | None = None, grid: int = GRID, seed: int = 1) -> DataFrame:
    """``rows`` with ``ERRORS``: two-dimensional local error rates of the peptide part, the glycan part, both and any, and the q-value.

    ``rows``: part scores, a combined score, ``decoy_peptide`` and ``decoy_glycan``. Densities of the four kinds are estimated by Gaussian mixtures (``gmm``)
    or by a kernel (``kde``) over a grid from the least to the greatest scores; a row's values lie between its four grid points (bilinear). Rows with
    a null or NaN part score get nulls; each kind of decoy must be there.
    """
    import numpy as np

    if estimator not in ("gmm", "kde"):
        raise ValueError(f"unknown estimator {estimator}")
    known = rows.where(f"{x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({x}) AND NOT isnan({y})")
    ends = known.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if ends[0] is None:
        return rows.select("*", *[F.lit(None).cast("double").alias(e) for e in ERRORS])
    gx, gy = (np.linspace(lo, hi if hi > lo else lo + 1, grid) for lo, hi in ((ends[0], ends[1]), (ends[2], ends[3])))
    points = np.stack([g.ravel() for g in np.meshgrid(gx, gy, indexing="ij")], axis=1)
    densities = {}
    for kind, (p, g) in _KINDS.items():
        mine = known.where(f"decoy_peptide = {p} AND decoy_glycan = {g}")
        densities[kind] = _kernel_density(mine, x, y, gx, gy) if estimator == "kde" else _mixture(mine, x, y, COMPONENTS[kind], seed)(points).reshape(grid, grid)
    errors = mixture_errors(densities, pi0 or part_null_shares(known, x, y, combined))
    table = np.stack([errors[e] for e in ERRORS], axis=-1)  # of a fixed size

    @F.pandas_udf(", ".join(f"{e} double" for e in ERRORS))
    def between(a, b):
        import pandas as pd

        u, v = ((c.to_numpy(float, na_value=np.nan) - g[0]) / (g[1] - g[0]) for c, g in ((a, gx), (b, gy)))
        good = ~(np.isnan(u) | np.isnan(v))
        i, j = (np.clip(np.floor(np.where(good, w, 0)), 0, grid - 2).astype(int) for w in (u, v))
        s, t = (np.where(good, w, 0) - k for w, k in ((u, i), (v, j)))
        s, t = s[:, None], t[:, None]
        value = table[i, j] * (1 - s) * (1 - t) + table[i + 1, j] * s * (1 - t) + table[i, j + 1] * (1 - s) * t + table[i + 1, j + 1] * s * t
        return pd.DataFrame(np.where(good[:, None], value, np.nan), columns=list(ERRORS))

    told = rows.withColumn("_e", between(F.col(x).cast("double"), F.col(y).cast("double")))
    return told.select(*rows.columns, *[F.nanvl(F.col(f"_e.{e}"), F.lit(None).cast("double")).alias(e) for e in ERRORS])
