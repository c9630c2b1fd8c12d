"""Queries of learning: standardising, folds, discriminants, trees, scoring, scoring of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import learn
from quantloom.plans.proxies import OBSERVATIONS_SQL, TIES, observations, rounded
from quantloom.plans.registry import Registry
from quantloom.runtime import table

QUERIES = Registry()
COLUMNS = ("main_score", "var_quantity", "var_pep", "var_pep1")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf)
    return rows.select(
        "obs", F.concat_ws("_", "entity", "decoy").alias("group_id"), "decoy", *TIES, F.col("score").alias("main_score"), F.col("quantity").cast("double").alias("var_quantity"),
        (1 - F.col("pep") + F.when(F.col("decoy") == 0, 0.5).otherwise(0.0)).alias("var_pep"), F.col("pep1").alias("var_pep1"),
    )


def _prepared(spark: SparkSession, sf: str) -> learn.Prepared:
    return learn.prepare(_scores(spark, sf), "group_id", "decoy", TIES)


@QUERIES.add(
    "standard_scale",
    f"""WITH o AS (SELECT obs, quantity, pep, pep1 FROM ({OBSERVATIONS_SQL})), s AS (SELECT avg(quantity) AS a, stddev_pop(quantity) AS b, avg(pep) AS c, stddev_pop(pep) AS d, avg(pep1) AS e, stddev_pop(pep1) AS f FROM o)
SELECT obs, round((quantity - a) / b, 9) AS quantity, round((pep - c) / d, 9) AS pep, round((pep1 - e) / f, 9) AS pep1 FROM o, s""",
)
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf).select("obs", F.col("quantity").cast("double").alias("quantity"), "pep", "pep1")
    return rounded(learn.standardised(rows, ["quantity", "pep", "pep1"]))


@QUERIES.add(
    "xval_split",
    f"""WITH g AS (SELECT DISTINCT entity, decoy FROM ({OBSERVATIONS_SQL})) SELECT entity, decoy, (row_number() OVER (PARTITION BY decoy ORDER BY entity)
 <= floor(count(*) OVER (PARTITION BY decoy) * 0.5) + 1)::int AS is_train FROM g""",
)
def xval_split(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.operators.scan import running

    groups = observations(spark, sf).select("entity", "decoy").distinct().withColumn("one", F.lit(1))
    placed = running(groups, "entity", {"place": ("sum", "one")}, ("decoy",))
    sizes = groups.groupBy("decoy").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(F.broadcast(sizes), "decoy").select("entity", "decoy", (F.col("place") <= F.floor(F.col("n") * 0.5) + 1).cast("int").alias("is_train"))


@QUERIES.add(
    "pretrained_score",
    "SELECT feature_id, transition_id, round(0.4 * var_xcorr_shape - 0.2 * var_massdev_score + 0.3 * var_log_sn_score + 0.1 * var_intensity_score, 9) AS score FROM feature_transition",
)
def pretrained_score(spark: SparkSession, sf: str) -> DataFrame:
    fixed = {"var_xcorr_shape": 0.4, "var_massdev_score": -0.2, "var_log_sn_score": 0.3, "var_intensity_score": 0.1}
    total = 0.4 * F.col("var_xcorr_shape") - 0.2 * F.col("var_massdev_score") + 0.3 * F.col("var_log_sn_score") + 0.1 * F.col("var_intensity_score")
    return table(spark, sf, "feature_transition").select("feature_id", "transition_id", *fixed).select("feature_id", "transition_id", F.round(total, 9).alias("score"))


@QUERIES.add("lda_scores")
def lda_scores(spark: SparkSession, sf: str) -> DataFrame:
    data = _prepared(spark, sf)
    model = learn.fit_lda(data.rows, data.columns)
    return data.rows.select("group", "decoy", *TIES, F.round(model.score(), 4).alias("score"))


@QUERIES.add("semi_supervised_scores")
def semi_supervised_scores(spark: SparkSession, sf: str) -> DataFrame:
    data = _prepared(spark, sf)
    model = learn.learn(data)
    return rounded(learn.apply(data, model), 4)


@QUERIES.add("svm_scores")
def svm_scores(spark: SparkSession, sf: str) -> DataFrame:
    data = _prepared(spark, sf)
    scaled = learn.standardised(data.rows, data.columns)
    model = learn.fit_svm(scaled, data.columns)
    return scaled.select("group", "decoy", *TIES, F.round(model.score(), 4).alias("score"))


@QUERIES.add("boosted_tree_scores")
def boosted_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    data = _prepared(spark, sf)
    _, scored = learn.fit_trees(data.rows, data.columns)
    return scored(data.rows).select("group", "decoy", *TIES, F.round("score", 4).alias("score"))


@QUERIES.add("stored_weights_apply", f"SELECT obs, round((score * 0.25::float + quantity * 2)::float::double, 4) AS score FROM ({OBSERVATIONS_SQL})")
def stored_weights_apply(spark: SparkSession, sf: str) -> DataFrame:
    weights = learn.LinearModel({"score": 0.25, "quantity": 2.0}).table(spark, "ms2")
    model = learn.LinearModel.from_table(weights, "ms2", ["score", "quantity"])
    rows = observations(spark, sf)
    return rows.select("obs", F.round(model.score(), 4).alias("score"))


@QUERIES.add("stream_apply_scores", "SELECT feature_id, transition_id, round((var_xcorr_shape * 0.4 + var_log_sn_score * 0.3)::float::double, 4) AS score FROM feature_transition WHERE var_xcorr_shape IS NOT NULL AND var_log_sn_score IS NOT NULL")
def stream_apply_scores(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.streaming.apply import score_files

    model = learn.LinearModel({"var_xcorr_shape": 0.4, "var_log_sn_score": 0.3})
    done = score_files(spark, f"{sf}/feature_transition.parquet", model, ["feature_id", "transition_id"])
    return done.select("feature_id", "transition_id", F.round("score", 4).alias("score"))
