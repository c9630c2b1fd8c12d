import os
import random

import pytest

from quantloom import __main__ as cli
from quantloom import api
from quantloom.operators import learn

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no data here")


@pytest.fixture
def scored(rows):
    rng = random.Random(2)
    data = [(i, i % 40, i % 2, int(i % 40 >= 25), rng.gauss(2 if i % 40 < 15 else 0, 1)) for i in range(400)]
    return rows("feature_id int, peptide_id int, run_id int, decoy int, score double", data)


@pytest.mark.parametrize(("context", "n"), [("global", 40), ("experiment-wide", 40), ("run-specific", 40)])
def test_contexts(scored, context, n):
    got = api.infer_entities(scored, "peptide_id", context, local_fdr=False).collect()
    assert len(got) == n and all((r.run_id is None) == (context == "global") for r in got)
    good = [r.qvalue for r in got if r.peptide_id < 15]
    assert sum(good) / len(good) < 0.2
    with pytest.raises(ValueError):
        api.infer_entities(scored, "peptide_id", "nowhere")


def test_score_and_reapply(rows):
    rng = random.Random(3)
    data = [(f"g{g}", int(g >= 60), i, rng.gauss(2.0 * (g < 40 and i == 0), 1), rng.gauss(2.0 * (g < 40 and i == 0), 1)) for g in range(120) for i in range(2)]
    df = rows("group_id string, decoy int, i int, main_x double, var_y double", data)
    out, weights = api.score(df, ties=["i"], folds=1, rounds=1, local_fdr=False)
    again, _ = api.score(df, ties=["i"], weights=weights, local_fdr=False)
    key = lambda r: (r.group, r.i)
    assert {key(r): r.d_score for r in out.collect()} == {key(r): r.d_score for r in again.collect()}
    assert api.choose_main_score(learn.prepare(df, "group_id", "decoy", ["i"])) in ("main_x", "var_y")


def test_matrix(rows):
    df = rows("feature_id int, run_id int, precursor_id int, peptide_id int, qvalue double, intensity double", [(1, 1, 10, 5, 0.1, 4.0), (2, 1, 10, 5, 0.01, 6.0), (3, 2, 10, 5, 0.1, 8.0), (4, 1, 11, 5, 0.1, 2.0)])
    assert {r.precursor_id: (r["1"], r["2"]) for r in api.export_matrix(df, "precursor", [1, 2]).collect()} == {10: (6.0, 8.0), 11: (2.0, None)}
    assert api.export_matrix(df, "peptide", [1, 2], top=1).first()["1"] == 6.0
    for how in ("median", "quantile"):
        assert api.export_matrix(df, "peptide", [1, 2], normalise=how).count() == 1


@needs_data
def test_commands(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    cmd = lambda *a: cli.run(spark, cli.parser().parse_args(list(a)))
    cmd("subsample", SMALL, at("sub"), "--share", "0.3")
    whole, sub = api.load(spark, SMALL), api.load(spark, at("sub"))
    assert 0 < sub["feature"].count() < whole["feature"].count()
    assert sub["feature_transition"].join(sub["feature"], sub["feature_transition"].feature_id == sub["feature"].id, "left_anti").count() == 0
    cmd("merge", at("merged"), at("sub"), at("sub"))
    assert api.load(spark, at("merged"))["feature"].count() == 2 * sub["feature"].count()
    assert api.load(spark, at("merged"))["precursor"].count() == sub["precursor"].distinct().count()
    cmd("reduce", at("sub"), at("red"))
    cmd("filter", at("sub"), at("kept"), "--ms2-qvalue", "0.1", "--no-decoys")
    assert 0 < api.load(spark, at("kept"))["feature"].count() < sub["feature"].count()
    cmd("split", at("kept"), at("runs"))
    assert any(d.startswith("run_id=") for d in os.listdir(at("runs/feature_transition.parquet")))
    cmd("backpropagate", at("kept"), SMALL, at("back"))
    cmd("export", SMALL, at("long.tsv"), "--qvalue", "1.1", "--peptide-qvalue", "1.1")
    assert "aggr_fragment_annotation" in spark.read.option("sep", "\t").option("header", True).csv(at("long.tsv")).columns
    cmd("statistics", SMALL)


def test_decoys_look_up_their_own_run(scored):
    got = api.infer_entities(scored, "peptide_id", "run-specific", local_fdr=False).collect()
    decoys = [r for r in got if r.decoy == 1]
    assert decoys and all(r.pvalue is not None and r.qvalue is not None and r.svalue is not None for r in decoys)


def test_merged_into_one_run(rows):
    store = lambda run: {
        "run": rows("id long, filename string", [(run, f"f{run}")]), "feature": rows("id long, run_id long", [(run * 10, run)]),
        "score_peptide": rows("run_id long, context string", [(run, "run-specific"), (None, "global")]), "precursor": rows("id long", [(5,)]),
    }
    out = api.merge([store(1), store(2)], same_run=9)
    assert [r.id for r in out["run"].collect()] == [9] and {r.run_id for r in out["feature"].collect()} == {9}
    assert sorted(str(r.run_id) for r in out["score_peptide"].collect()) == ["9", "9", "None", "None"] and out["precursor"].count() == 1


def test_protein_matrix_goes_through_peptides(rows):
    data = [(i, run, precursor, peptide, proteins, 0.01, v) for i, (run, precursor, peptide, proteins, v) in enumerate([
        (1, 10, "a", ["P", "Q"], 4.0), (1, 11, "a", ["P", "Q"], 2.0), (1, 12, "b", ["P"], 30.0), (2, 12, "b", ["P"], 50.0),
    ])]
    df = rows("feature_id int, run_id int, precursor_id int, peptide_id string, protein_id array<string>, qvalue double, intensity double", data)
    got = {r.protein_id: (r["1"], r["2"]) for r in api.export_matrix(df, "protein", [1, 2], top=2).collect()}
    assert got == {"P": ((3.0 + 30.0) / 2, 50.0), "Q": (3.0, None)}
