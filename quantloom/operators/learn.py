"""Semi-supervised learning of a score that tells targets from decoys.

A model is fitted from one aggregate of moments per round (linear discriminants) or by MLlib; scoring is a
column expression, so the learned score runs in generated code. Training frames are written once and
scanned per round; only moments, cutoffs and weights reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import stats
from quantloom.runtime import cut, written


@dataclass(frozen=True)
class LinearModel:
    """A weight per feature column."""

    weights: dict[str, float]

    def score(self) -> Column:
        return reduce(Column.__add__, [F.col(f"`{c}`") * float(w) for c, w in self.weights.items()]).cast("float").cast("double")

    def scored(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, self.score())

    def table(self, spark: SparkSession, level: str) -> DataFrame:
        return spark.createDataFrame([(c, float(w), level) for c, w in self.weights.items()], "score string, weight double, level string")

    @staticmethod
    def from_table(weights: DataFrame, level: str, columns: Sequence[str] | None = None, max_columns: int = 10_000) -> LinearModel:
        """The model of a level; refuses a table whose features are not just those asked for."""
        rows = weights.where(F.col("level") == level).limit(max_columns + 1).collect()
        if len(rows) > max_columns:
            raise ValueError(f"more than {max_columns} weights at level {level}")
        found = {r["score"]: r["weight"] for r in rows}
        if columns is not None and set(columns) != set(found):
            raise ValueError(f"weights are for other columns: {sorted(set(found) ^ set(columns))}")
        return LinearModel({c: found[c] for c in (columns or sorted(found))})


@dataclass(frozen=True)
class TreeModel:
    """Boosted trees (an MLlib pipeline); the margin is the score."""

    pipeline: object

    def scored(self, df: DataFrame, name: str = "score") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.pipeline.transform(df)
        return out.withColumn(name, vector_to_array("rawPrediction")[1]).select(*df.columns, name)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> TreeModel:
        from pyspark.ml import PipelineModel

        return TreeModel(PipelineModel.load(path))


Model = LinearModel | TreeModel
#: Fits rows with a label (0 target, 1 decoy) over columns.
Fit = Callable[[DataFrame, Sequence[str]], Model]


@dataclass(frozen=True)
class Prepared:
    """A validated training table: ``group``, ``decoy``, feature columns without nulls, the main score among them."""

    rows: DataFrame
    columns: list[str]
    main: str
    ties: list[str] = field(default_factory=list)


def prepare(table: DataFrame, group: str, decoy: str, ties: Sequence[str], main: str | None = None, columns: Sequence[str] | None = None, min_groups: int = 10, meta: Sequence[str] = ()) -> Prepared:
    """Pick the score columns (``main_*`` and ``var_*`` unless given), drop those without any value and rows with a null in one.

    At least ``min_groups`` target and decoy groups are needed. Columns ``meta`` are carried along for the choice of training targets.
    """
    named = [c for c in table.columns if c.lower().startswith(("main_", "var_"))] if columns is None else list(columns)
    counts = table.agg(*[F.count(c).alias(c) for c in named]).first()
    named = [c for c in named if counts[c]]
    mains = [main] if main else [c for c in named if c.lower().startswith("main_")]
    if len(mains) != 1:
        raise ValueError(f"exactly one main score is needed, found {mains}")
    kept = [F.col(f"`{c}`").cast("double").alias(c) for c in named]
    rows = table.select(F.col(group).cast("string").alias("group"), F.col(decoy).cast("int").alias("decoy"), *ties, *kept, *[F.col(c).cast("double") for c in meta])
    rows = rows.dropna(subset=named).where(reduce(Column.__and__, [~F.isnan(f"`{c}`") for c in named]))
    # Rows of a group lie together, so maxima per group are mostly found before any shuffle; a range also splits groups that are very large.
    rows = written(rows.repartitionByRange("group", *ties).sortWithinPartitions("group", "decoy"))
    groups = {r["decoy"]: r["n"] for r in rows.groupBy("decoy").agg(F.count_distinct("group").alias("n")).collect()}
    if min(groups.get(0, 0), groups.get(1, 0)) < min_groups:
        raise ValueError(f"too few groups of targets or decoys: {groups}")
    return Prepared(rows, named, mains[0], list(ties))


def standardised(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns shifted and scaled to mean 0 and (population) standard deviation 1; constant columns become 0."""
    sums = rows.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}"))])
    met = rows.join(F.broadcast(sums))
    return met.withColumns({c: F.coalesce((F.col(c) - F.col(f"_m{i}")) / F.nullif(F.col(f"_s{i}"), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(columns)}).select(*rows.columns)


def fit_lda(rows: DataFrame, columns: Sequence[str], label: str = "decoy") -> LinearModel:
    """Two-class linear discriminant from one pass of moments: pooled covariance against the difference of means (label 0 minus 1)."""
    sums = rows.groupBy(label).agg(*_moments(columns))
    return _lda({r[label]: r for r in sums.collect()}, columns)


def _moments(columns: Sequence[str]) -> list[Column]:
    k = len(columns)
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.sum(F.col(f"`{columns[i]}`") * F.col(f"`{columns[j]}`")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)],
    ]


def _lda(by: Mapping, columns: Sequence[str]) -> LinearModel:
    """The discriminant from the moments of both classes."""
    import numpy as np

    k = len(columns)
    if set(by) < {0, 1}:
        raise ValueError("both classes are needed")
    means, scatter, total = {}, np.zeros((k, k)), 0
    for y in (0, 1):
        n = by[y]["n"]
        total += n
        mean = np.array([by[y][f"s{i}"] for i in range(k)]) / n
        means[y] = mean
        for i in range(k):
            for j in range(i, k):
                v = by[y][f"p{i}_{j}"] - n * mean[i] * mean[j]
                scatter[i, j] += v
                if i != j:
                    scatter[j, i] += v
    pooled = scatter / max(1, total - 2)
    direction = np.linalg.pinv(pooled, rcond=1e-10) @ (means[0] - means[1])
    norm = np.sqrt(max(direction @ pooled @ direction, 1e-300))
    return LinearModel({c: float(w) for c, w in zip(columns, direction / norm)})


def _assembled(rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="_x").transform(rows).withColumn("_y", (1 - F.col(label)).cast("double"))


def fit_svm(rows: DataFrame, columns: Sequence[str], label: str = "decoy", reg: float = 0.01, max_iter: int = 50, weights: tuple[float, float] | None = None) -> LinearModel:
    """Linear support vectors (MLlib); targets score high. ``weights``: of targets and decoys."""
    from pyspark.ml.classification import LinearSVC

    data = _assembled(rows, columns, label)
    learner = LinearSVC(featuresCol="_x", labelCol="_y", regParam=reg, maxIter=max_iter)
    if weights is not None:
        data = data.withColumn("_w", F.when(F.col("_y") == 1, F.lit(float(weights[0]))).otherwise(F.lit(float(weights[1]))))
        learner = learner.setWeightCol("_w")
    model = learner.fit(data)
    return LinearModel({c: float(w) for c, w in zip(columns, model.coefficients.toArray())})


def _searched(rows: DataFrame, columns: Sequence[str], label: str, settings: Sequence[dict], fit: Callable[..., Model], splits: int, parallel: int) -> dict:
    """The settings whose models rank held-out rows best (area under the ROC curve, mean over ``splits`` parts); ties: the earlier one. Settings are tried in parallel."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    parts = written(rows.select(*columns, label).withColumn("_part", F.pmod(F.xxhash64(*columns, label), F.lit(splits))))
    judge = BinaryClassificationEvaluator(rawPredictionCol="_s", labelCol="_y", metricName="areaUnderROC")

    def tried(setting: dict) -> float:
        areas = []
        for k in range(splits):
            model = fit(parts.where(F.col("_part") != k), columns, label, **setting)
            areas.append(judge.evaluate(model.scored(parts.where(F.col("_part") == k), "_s").withColumn("_y", (1 - F.col(label)).cast("double"))))
        return sum(areas) / splits

    found = _threads(rows.sparkSession, tried, settings, parallel)
    return dict(settings[max(range(len(settings)), key=lambda i: (found[i], -i))])


def _threads(spark: SparkSession, work: Callable, items: Sequence, parallel: int) -> list:
    """``work`` on each item, some at a time; every thread starts jobs of its own."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(work), x) for x in items]]


def tune_svm(rows: DataFrame, columns: Sequence[str], label: str = "decoy", regs: Sequence[float] = (0.001, 0.01, 0.1), iterations: Sequence[int] = (50, 100, 200), class_weights: Sequence[tuple[float, float] | None] | None = None, splits: int = 3, parallel: int = 4) -> dict:
    """The best settings for ``fit_svm`` on a grid of regularisation, iterations and class weights (each of 0.1, 1, 10 for targets and decoys, and balanced)."""
    if class_weights is None:
        n = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(n.values())
        class_weights = [(a, b) for a in (0.1, 1.0, 10.0) for b in (0.1, 1.0, 10.0)] + [(total / (2 * max(1, n.get(0, 0))), total / (2 * max(1, n.get(1, 0))))]
    grid = [{"reg": r, "max_iter": m, "weights": w} for r in regs for m in iterations for w in class_weights]
    return _searched(rows, columns, label, grid, fit_svm, splits, parallel)


def fit_boosted(rows: DataFrame, columns: Sequence[str], label: str = "decoy", trees: int = 20, depth: int = 4, step: float = 0.1, subsample: float = 1.0, min_rows: int = 1, seed: int = 1) -> TreeModel:
    """Gradient-boosted trees (MLlib)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    boosted = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, minInstancesPerNode=min_rows, seed=seed)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_x"), boosted])
    return TreeModel(pipeline.fit(rows.withColumn("_y", (1 - F.col(label)).cast("double"))))


def tune_trees(rows: DataFrame, columns: Sequence[str], label: str = "decoy", tries: int = 20, splits: int = 3, parallel: int = 4, seed: int = 1) -> dict:
    """The best of ``tries`` settings for ``fit_boosted``, drawn at random with a fixed seed."""
    import random

    draw = random.Random(seed)
    settings = [
        {"trees": draw.choice([10, 20, 50, 100]), "depth": draw.randint(2, 8), "step": round(10 ** draw.uniform(-2, -0.5), 4), "subsample": round(draw.uniform(0.5, 1.0), 2), "min_rows": draw.choice([1, 5, 10, 20])}
        for _ in range(tries)
    ]
    return _searched(rows, columns, label, settings, fit_boosted, splits, parallel)


def fit_trees(rows: DataFrame, columns: Sequence[str], label: str = "decoy", trees: int = 20, depth: int = 4, seed: int = 1):
    """The pipeline of ``fit_boosted`` and a function that adds its margin as ``score``."""
    model = fit_boosted(rows, columns, label, trees, depth, seed=seed)
    return model.pipeline, model.scored


def fold(rows: DataFrame, k: int, share: float = 0.5, group: str = "group") -> DataFrame:
    """Training rows of fold ``k``: a fixed share of the groups by hash, targets and decoys alike."""
    return rows.where(F.pmod(F.xxhash64(group, F.lit(k)), F.lit(10_000)) < int(share * 10_000))


def top_peaks(scored: DataFrame, ties: Sequence[str]) -> DataFrame:
    order = Window.partitionBy("group").orderBy(F.col("score").desc(), *ties)
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def training_set(scored: DataFrame, ties: Sequence[str], fdr: float, lambdas=0.4, meta: Sequence[str] = ()) -> DataFrame:
    """Top decoys, and top targets whose score reaches the cutoff nearest to ``fdr``.

    With ``meta`` only those of these targets are taken that have at least 0.5 in each of the named columns (null counts as 0); none left is an error.
    """
    top = cut(top_peaks(scored, ties))
    cutoff = stats.find_cutoff(stats.error_table(top, "score", "decoy", (), lambdas), fdr).first()["cutoff"]
    limit = F.lit(cutoff).cast("double")
    target = F.col("score") >= limit
    for c in meta:
        target = target & (F.coalesce(F.col(c), F.lit(0.0)) >= 0.5)
    if meta and top.where((F.col("decoy") == 0) & target).isEmpty():
        raise ValueError(f"no training target has all of {list(meta)}")
    return top.where((F.col("decoy") == 1) | target)


def learn(data: Prepared, folds: int = 10, rounds: int = 10, share: float = 0.5, first_fdr: float = 0.15, fdr: float = 0.05, fit: Fit = fit_lda) -> LinearModel:
    """Weights averaged over folds. Each fold starts from the main score, fits without it, then refits with all columns ``rounds`` times.

    Linear discriminants of all folds go through each round together; other linear fits run fold by fold, some at a time.
    """
    if fit is fit_lda:
        found = _lda_folds(data, folds, rounds, share, first_fdr, fdr)
    else:
        found = _folds(data, fit, folds, rounds, share, first_fdr, fdr)
    return LinearModel({c: sum(m.weights.get(c, 0.0) for m in found) / len(found) for c in data.columns})


def _folds(data: Prepared, fit: Fit, folds: int, rounds: int, share: float, first_fdr: float, fdr: float, meta: Sequence[str] = (), parallel: int = 4) -> list[Model]:
    others = [c for c in data.columns if c != data.main] or data.columns

    def one(k: int) -> Model:
        mine = fold(data.rows, k, share)
        model = fit(training_set(mine.withColumn("score", F.col(f"`{data.main}`")), data.ties, first_fdr, meta=meta), others)
        for _ in range(rounds):
            model = fit(training_set(model.scored(mine), data.ties, fdr, meta=meta), data.columns)
        return model

    return _threads(data.rows.sparkSession, one, range(folds), parallel)


def _lda_folds(data: Prepared, folds: int, rounds: int, share: float, first_fdr: float, fdr: float, lambdas=0.4) -> list[LinearModel]:
    """The discriminants of all folds: a round is one pass that finds every fold's top row per group, one error table by fold, one pass of moments by fold."""
    others = [c for c in data.columns if c != data.main] or data.columns
    models = [LinearModel({data.main: 1.0})] * folds
    cells = F.struct(*[F.col(f"`{c}`") for c in data.columns])

    def best(k: int, model: LinearModel) -> Column:
        score = F.col(f"`{data.main}`") if list(model.weights) == [data.main] else model.score()
        member = F.pmod(F.xxhash64("group", F.lit(k)), F.lit(10_000)) < int(share * 10_000)
        return F.min_by(F.struct(score.alias("score"), cells.alias("cells")), F.when(member, F.struct(-score, *[F.col(t) for t in data.ties])))

    for nth in range(rounds + 1):
        each = data.rows.groupBy("group", "decoy").agg(F.array(*[best(k, m) for k, m in enumerate(models)]).alias("_top"))
        top = written(each.select("decoy", F.posexplode("_top").alias("fold", "_t")).where("_t IS NOT NULL").select("fold", "decoy", "_t.score", "_t.cells.*"))
        table = stats.error_table(top, "score", "decoy", ("fold",), lambdas)
        level = first_fdr if nth == 0 else fdr
        cutoffs = {r["fold"]: r["cutoff"] for r in table.groupBy("fold").agg(F.min_by("cutoff", F.struct(F.abs(F.col("qvalue") - level), F.col("cutoff"))).alias("cutoff")).collect()}
        limit = F.get(F.array(*[F.lit(cutoffs.get(k)).cast("double") for k in range(folds)]), F.col("fold"))
        columns = others if nth == 0 else data.columns
        sums: dict[int, dict] = {}
        for r in top.where((F.col("decoy") == 1) | (F.col("score") >= limit)).groupBy("fold", "decoy").agg(*_moments(columns)).collect():
            sums.setdefault(r["fold"], {})[r["decoy"]] = r
        models = [_lda(sums.get(k, {}), columns) for k in range(folds)]
    return models


def learn_final(data: Prepared, fit: Fit, folds: int = 10, rounds: int = 10, share: float = 0.5, first_fdr: float = 0.15, fdr: float = 0.05, meta: Sequence[str] = (), parallel: int = 4) -> Model:
    """A model of any kind, fitted on the scores that the folds' models give to groups they have not seen.

    A fold's scores of its held-out rows are scaled so that their best decoys have mean 0 and deviation 1; a row's score is the
    mean over the folds that held it out. From these the training set of the final fit is chosen; rows that no fold held out are left out of it.
    """
    models = _folds(data, fit, folds, rounds, share, first_fdr, fdr, meta, parallel)
    key = ["group", *data.ties]
    parts = []
    for k, model in enumerate(models):
        unseen = model.scored(data.rows.where(F.pmod(F.xxhash64("group", F.lit(k)), F.lit(10_000)) >= int(share * 10_000)))
        scale = top_peaks(unseen, data.ties).where("decoy = 1").agg(F.avg("score").alias("_mu"), F.stddev_samp("score").alias("_sd"))
        parts.append(unseen.join(F.broadcast(scale)).select(*key, F.try_divide(F.col("score") - F.col("_mu"), F.col("_sd")).alias("score")))
    averaged = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.avg("score").alias("score"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key])
    scored = data.rows.join(averaged.withColumnsRenamed({c: f"_k_{c}" for c in key}), same).drop(*[f"_k_{c}" for c in key])
    return fit(training_set(scored.where("score IS NOT NULL"), data.ties, fdr, meta=meta), data.columns)


def apply(data: Prepared, model: Model, lambdas=0.4, local_fdr: bool = False, chromatograms: bool = False) -> DataFrame:
    """All rows with the score, its normalised form, the statistics of the nearest error-table row and the rank in the group."""
    scored = model.scored(data.rows, "r_score")
    top = top_peaks(scored.withColumn("score", F.col("r_score")), data.ties)
    fit = top.where("decoy = 1").agg(F.avg("score").alias("_mu"), F.stddev_samp("score").alias("_sd"))
    normal = lambda c: F.try_divide(F.col(c) - F.col("_mu"), F.col("_sd"))
    scored = scored.join(F.broadcast(fit)).withColumn("d_score", normal("r_score").cast("float").cast("double")).drop("_mu", "_sd")
    best = top.join(F.broadcast(fit)).withColumn("score", normal("score").cast("float").cast("double")).drop("_mu", "_sd")
    table = stats.error_table(best, "score", "decoy", (), lambdas, local_fdr=local_fdr)
    names = ["pvalue", "qvalue", *(["pep"] if local_fdr else [])]
    told = stats.nearest(scored, "d_score", table.select("cutoff", *names), "cutoff").drop("cutoff")
    order = Window.partitionBy("group").orderBy(F.col("d_score").desc(), *data.ties)
    told = told.withColumn("peak_group_rank", F.row_number().over(order))
    return stats.chromatogram_hypotheses(told, ["group"], "pep") if chromatograms and local_fdr else told
