import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import learn
from quantloom.streaming import apply as streaming

SCHEMA = "group_id string, decoy int, i int, main_score double, var_a double, var_b double, var_none double"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    out = []
    for g in range(240):
        decoy, true = int(g >= 120), g < 90
        for i in range(3):
            hit = true and i == 0
            out.append((f"g{g}", decoy, i, rng.gauss(1.5 if hit else 0, 1), rng.gauss(2 if hit else 0, 1), rng.gauss(1 if hit else 0, 1), None))
    return spark.createDataFrame(out, SCHEMA)


def test_prepare(data, rows):
    got = learn.prepare(data, "group_id", "decoy", ["i"])
    assert got.columns == ["main_score", "var_a", "var_b"] and got.main == "main_score" and got.rows.count() == 720
    with pytest.raises(ValueError):
        learn.prepare(data.where("decoy = 0"), "group_id", "decoy", ["i"])
    with pytest.raises(ValueError):
        learn.prepare(data.withColumn("main_other", F.lit(1.0)), "group_id", "decoy", ["i"])
    holes = learn.prepare(data.withColumn("var_b", F.when(F.col("i") > 0, F.col("var_b"))), "group_id", "decoy", ["i"])
    assert holes.rows.count() == 480


def test_lda_direction(data):
    rows = data.where("i = 0").select("decoy", "var_a", "var_b")
    w = learn.fit_lda(rows, ["var_a", "var_b"]).weights
    x = rows.toPandas()
    a, b = (x[x.decoy == y][["var_a", "var_b"]].to_numpy() for y in (0, 1))
    pooled = ((a - a.mean(0)).T @ (a - a.mean(0)) + (b - b.mean(0)).T @ (b - b.mean(0))) / (len(x) - 2)
    want = np.linalg.solve(pooled, a.mean(0) - b.mean(0))
    assert np.allclose(np.array([w["var_a"], w["var_b"]]) / w["var_a"], want / want[0])


def test_learned_score_beats_the_main_score(data):
    prepared = learn.prepare(data, "group_id", "decoy", ["i"])
    model = learn.learn(prepared, folds=2, rounds=2)
    told = learn.apply(prepared, model, local_fdr=True, chromatograms=True)
    assert told.count() == 720 and {"r_score", "d_score", "pvalue", "qvalue", "pep", "peak_group_rank", "h_score", "h0_score"} <= set(told.columns)
    found = told.where("decoy = 0 AND peak_group_rank = 1 AND qvalue < 0.1").count()
    plain = learn.apply(prepared, learn.LinearModel({"main_score": 1.0})).where("decoy = 0 AND peak_group_rank = 1 AND qvalue < 0.1").count()
    assert found > plain and found > 50


def test_other_learners(data):
    prepared = learn.prepare(data, "group_id", "decoy", ["i"])
    svm = learn.fit_svm(prepared.rows.where("i = 0"), prepared.columns, max_iter=10)
    assert svm.weights["var_a"] > 0
    _, scored = learn.fit_trees(prepared.rows.where("i = 0"), prepared.columns, trees=3, depth=2)
    means = {r.decoy: r.m for r in scored(prepared.rows.where("i = 0")).groupBy("decoy").agg(F.avg("score").alias("m")).collect()}
    assert means[0] > means[1]


def test_weights_table(spark):
    model = learn.LinearModel({"a": 1.0, "b": -2.0})
    table = model.table(spark, "ms2")
    assert learn.LinearModel.from_table(table, "ms2", ["a", "b"]) == model
    with pytest.raises(ValueError):
        learn.LinearModel.from_table(table, "ms2", ["a"])


def test_standardised(rows):
    got = learn.standardised(rows("x double, y double", [(1.0, 5.0), (3.0, 5.0)]), ["x", "y"]).collect()
    assert sorted(tuple(r) for r in got) == [(-1.0, 0.0), (1.0, 0.0)]


def test_stream_goes_on_where_it_stopped(spark, rows, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    model = learn.LinearModel({"a": 2.0})
    rows("id int, a double", [(1, 1.0), (2, None)]).write.parquet(folder)
    run = lambda: streaming.start(spark, folder, model, ["id"], out, state, once=True).awaitTermination()
    run()
    rows("id int, a double", [(3, 4.0)]).write.mode("append").parquet(folder)
    run()
    assert sorted((r.id, r.score) for r in spark.read.parquet(out).collect()) == [(1, 2.0), (3, 8.0)]


@pytest.mark.parametrize("query, learner", [("semi_supervised_scores", "learn"), ("svm_scores", "fit_svm"), ("boosted_tree_scores", "fit_trees")])
def test_queries_learn_with_the_defaults(data, monkeypatch, query, learner):
    from quantloom.plans import learning

    class Seen(Exception):
        pass

    def record(*args, **settings):
        raise Seen(settings)

    prepared = learn.prepare(data, "group_id", "decoy", ["i"])
    monkeypatch.setattr(learning, "_prepared", lambda spark, sf: prepared)
    monkeypatch.setattr(learn, learner, record)
    with pytest.raises(Seen) as seen:
        learning.QUERIES[query].run(None, "")
    assert seen.value.args == ({},)


def test_folds_together_equal_folds_one_by_one(data):
    prepared = learn.prepare(data, "group_id", "decoy", ["i"])
    together = learn._lda_folds(prepared, 3, 2, 0.5, 0.15, 0.05)
    one_by_one = learn._folds(prepared, lambda rows, columns: learn.fit_lda(rows, columns), 3, 2, 0.5, 0.15, 0.05)
    for a, b in zip(together, one_by_one):
        assert a.weights.keys() == b.weights.keys() and np.allclose(list(a.weights.values()), [b.weights[c] for c in a.weights])


def test_final_learner_of_trees_and_its_file(data, tmp_path):
    prepared = learn.prepare(data, "group_id", "decoy", ["i"])
    model = learn.learn_final(prepared, lambda rows, columns: learn.fit_boosted(rows, columns, trees=3, depth=2), folds=2, rounds=1, first_fdr=0.3, fdr=0.3)
    means = {r.decoy: r.m for r in model.scored(prepared.rows.where("i = 0")).groupBy("decoy").agg(F.avg("score").alias("m")).collect()}
    assert means[0] > means[1]
    model.save(str(tmp_path / "trees"))
    again = learn.TreeModel.load(str(tmp_path / "trees")).scored(prepared.rows)
    assert again.join(model.scored(prepared.rows).withColumnRenamed("score", "other"), ["group", "i"]).where("abs(score - other) > 1e-12").count() == 0


def test_searches(data):
    rows = learn.prepare(data, "group_id", "decoy", ["i"]).rows.where("i = 0")
    best = learn.tune_svm(rows, ["var_a", "var_b"], regs=(0.01, 1e6), iterations=(10,), class_weights=(None, (1.0, 10.0)), splits=2)
    assert set(best) == {"reg", "max_iter", "weights"} and best["reg"] == 0.01
    assert set(learn.tune_trees(rows, ["var_a"], tries=2, splits=2)) == {"trees", "depth", "step", "subsample", "min_rows"}


def test_training_targets_by_meta_columns(data):
    marked = data.withColumn("meta_is_unique_mapping", F.when(F.col("i") == 0, 1.0))
    prepared = learn.prepare(marked, "group_id", "decoy", ["i"], meta=["meta_is_unique_mapping"])
    scored = prepared.rows.withColumn("score", F.col("main_score"))
    plain, chosen = learn.training_set(scored, ["i"], 0.3), learn.training_set(scored, ["i"], 0.3, meta=["meta_is_unique_mapping"])
    assert chosen.where("decoy = 0 AND i > 0").count() == 0 < chosen.where("decoy = 0").count() < plain.where("decoy = 0").count() and chosen.where("decoy = 1").count() == 120
    with pytest.raises(ValueError):
        learn.training_set(scored.withColumn("meta_is_unique_mapping", F.lit(None).cast("double")), ["i"], 0.3, meta=["meta_is_unique_mapping"])


def test_too_many_weights_are_an_error(spark):
    table = spark.range(10_001).selectExpr("concat('c', id) AS score", "1.0D AS weight", "'ms2' AS level")
    with pytest.raises(ValueError):
        learn.LinearModel.from_table(table, "ms2")
