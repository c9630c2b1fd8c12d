import pytest

from pyspark.sql import functions as F

from quantloom.operators import export, files, glyco, quant, relational, report


def test_columns(rows):
    df = rows("A int, VAR_x int, var_y int", [(1, None, 3)])
    assert relational.with_prefix(df, "VAR_", "var_ms1_").columns == ["A", "var_ms1_x", "var_ms1_y"]
    assert relational.drop_empty_columns(df, ["VAR_x", "var_y"]).columns == ["A", "var_y"]
    r = df.select(relational.column_or_null(df, "a", "long"), relational.column_or_null(df, "b", "double")).first()
    assert (r.a, r.b) == (1, None) and relational.first_available(df, ["q", "A"]) == "A" and relational.first_available(df, ["q"]) is None


def test_unique_partner(rows):
    df = rows("i int, p int", [(1, 5), (1, 5), (2, 5), (2, 6), (3, None), (None, 7)])
    assert [tuple(r) for r in relational.unique_partner(df, "i", "p").collect()] == [(1, 5)]


def test_run_or_global_join_keeps_every_row(rows):
    data = rows("f int, e int, run_id int", [(1, 10, 1), (2, 10, 2), (3, 11, 1), (4, None, 1)])
    view = rows("e int, run_id int, q double", [(10, 1, 0.1), (11, None, 0.2)])
    assert sorted((r.f, r.q) for r in relational.join_runs_or_global(data, view, "e").collect()) == [(1, 0.1), (2, None), (3, 0.2), (4, None)]


def test_context_columns(rows):
    df = rows("context string, e int, run_id int, q double", [("run-specific", 1, 1, 0.2), ("run-specific", 1, 1, 0.1), ("global", 1, None, 0.5), ("global", 2, None, 0.6)])
    got = {(r.e, r.run_id): (r.q_rs, r.q_g) for r in relational.context_columns(df, "e", {"run-specific": "rs", "global": "g"}, ["q"]).collect()}
    assert got == {(1, 1): (0.1, 0.5), (2, None): (None, 0.6)}


def test_scores_back(rows):
    table = rows("k int, x int, score_q double", [(1, 1, 9.0), (2, 2, 9.0), (2, 3, 9.0)])
    got = relational.scores_back(table, rows("k int, q double", [(2, 0.5)]), ["k"], "SCORE_")
    assert sorted((r.k, r.x, r.SCORE_q) for r in got.collect()) == [(1, 1, None), (2, 2, 0.5), (2, 3, 0.5)]
    with pytest.raises(ValueError):
        relational.scores_back(table, rows("k int, q double", [(2, 0.5), (2, 0.6)]), ["k"], "score_")


def test_dense_ids_recovery_propagation(rows):
    df = rows("a int, b string, c int", [(2, "x", 0), (1, "y", 0), (1, "y", 1), (1, None, 0)])
    assert sorted((r.a, r.b or "", r.g) for r in relational.dense_ids(df, ["a", "b"], "g").collect()) == [(1, "", 1), (1, "y", 2), (1, "y", 2), (2, "x", 3)]
    base, more = rows("k int, v int", [(1, 1)]), rows("k int, w int", [(1, 5), (2, 6)])
    assert sorted((r.k, r.v, r.w, r.from_alignment) for r in relational.aligned_recovery(base, more, "k").collect()) == [(1, 1, None, 0), (2, None, 6, 1)]
    ev = rows("g int, feature_id int, t int, pep double", [(1, 1, 7, 0.4), (1, 2, 7, 0.05), (1, 2, 8, 0.6), (2, 3, 7, 0.9)])
    assert sorted(tuple(r) for r in relational.propagate(ev, "g", "t", "pep", 0.1).collect()) == [(1, 1, 7, 0.05), (1, 2, 7, 0.05), (1, 2, 8, 0.6), (2, 3, 7, 0.9)]


def test_files(rows):
    a, b = rows("run_id int, x int", [(1, 1), (None, 2)]), rows("run_id int, y int", [(2, 3)])
    assert {r.run_id for r in files.merge_runs([a, b], 9).collect()} == {9} and files.merge_runs([a, b]).columns == ["run_id", "x", "y"]
    assert files.run_part(a, "run_id", 1).count() == 2 and files.run_part(b, "run_id", 1).count() == 0
    scores = rows("run_id int, s int", [(1, 1), (3, 2), (None, 3)])
    assert sorted(r.s for r in files.backpropagate(a.where("x = 1"), scores).collect()) == [1, 3]
    tables = {
        "feature": rows("id int, precursor_id int", [(1, 10), (2, 11)]), "feature_transition": rows("feature_id int, transition_id int", [(1, 5), (2, 6)]),
        "precursor": rows("id int", [(10,), (11,)]), "precursor_peptide_mapping": rows("precursor_id int, peptide_id int", [(10, 1), (11, 2)]), "transition": rows("id int", [(5,), (6,)]),
    }
    cut = files.subset(tables, tables["feature"].where("id = 1"))
    assert {n: cut[n].count() for n in tables} == dict.fromkeys(tables, 1)
    kept, first = files.reduced(tables["feature"], rows("feature_id int, rank int", [(1, 1), (2, 2)]))
    assert kept.count() == first.count() == 1


def test_matrices(rows):
    df = rows("e string, i string, run string, v double", [("p", "a", "1", 10.0), ("p", "a", "2", 20.0), ("p", "b", "1", 30.0), ("p", "c", "2", 50.0), ("q", "d", "1", None)])
    m = {r.e: (r["1"], r["2"]) for r in quant.pivoted(df, ["e"], "run", "v", ["1", "2"]).collect()}
    assert m == {"p": (20.0, 35.0), "q": (None, None)}
    assert sorted(r.i for r in quant.top_items(df, "e", "i", "run", "v", 1).collect()) == ["c", "d"]
    assert sorted((r.run, r.i) for r in quant.top_items(df.where("e = 'p'"), "e", "i", "run", "v", 1, False).collect()) == [("1", "b"), ("2", "c")]
    norm = {(r.i, r.run): r.v for r in quant.median_normalised(df, "run", "v").collect()}
    assert norm[("a", "1")] == 10 / 20 * 27.5 and norm[("d", "1")] is None
    q = {(r.i, r.run): r.v for r in quant.quantile_normalised(df, "run", "v", ["i"]).collect()}
    assert abs(q[("a", "1")] - q[("a", "2")]) < 1e-9 and abs(q[("b", "1")] - 40) < 1e-9 and q[("d", "1")] is None
    lib = rows("p string, f string, v double, rt double", [("x", f"y{i}", float(i), 5.0) for i in range(1, 5)] + [("z", "y1", 1.0, 9.0)])
    got = quant.spectral_library(lib, "p", "f", "v", [lib.v.desc()], 4, "rt").collect()
    assert len(got) == 4 and max(r.relative_intensity for r in got) == 10000


def test_reports(rows):
    df = rows("id int, run int, v double", [(1, 1, 1.0), (1, 2, 3.0), (2, 1, 2.0), (2, 2, 4.0), (3, 1, 3.0), (3, 2, 5.0), (4, 1, 9.0)])
    assert [tuple(r) for r in report.jaccard(df, "id", "run").collect()] == [(1, 2, 3, 0.75)]
    assert abs(report.spearman(df, "id", "run", "v").first().rho - 1) < 1e-12
    assert sorted(tuple(r) for r in report.in_all_runs(df, "id", "run").collect()) == [(1, 1), (2, 3)]
    curve = {r.k: (r.mean_any, r.mean_common) for r in report.consistency_curve(df, "id", "run").collect()}
    assert curve[2] == (4.0, 3.0) and 3 <= curve[1][0] <= 4 and curve[1][0] == curve[1][1]
    assert abs(sum(r.weight for r in report.linear_bins(df, "v", 0.0, 10.0, 5).collect()) - 7) < 1e-9
    d = report.density_curve(df, "v", 256).toPandas()
    assert abs(d.density.sum() * (d.x[1] - d.x[0]) - 1) < 0.01
    assert report.density_curve(df.limit(0), "v").count() == 0
    assert [r.ecdf for r in report.ecdf(df, "v").orderBy("v").collect()][-1] == 1.0


def test_glyco(rows):
    assert glyco.normalised_weights({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75}
    df = rows("g int, i int, a double, b double", [(1, 1, 1.0, 0.0), (1, 2, 0.0, 1.0)])
    assert {r.i: r["rank"] for r in glyco.combined_rank(df, ["g"], {"a": 0.3, "b": 0.7}, ["i"]).collect()} == {1: 2, 2: 1}
    f = rows("k int, m double, z int, mz double", [(1, 1000.0, 2, 500.0)])
    c = rows("k int, gm double", [(1, 1000.005), (1, 1001.0)])
    assert glyco.mass_matches(f, c, "k", "m", "gm", "z", "mz", 10).count() == 1


@pytest.mark.parametrize("estimator", ["gmm", "kde"])
def test_density_errors_tell_right_from_wrong_parts(rows, estimator):
    """Targets of known kinds: right, wrong in one part, wrong in both; decoys score as what is wrong in their part."""
    import random

    rng = random.Random(3)
    data, good, bad = [], lambda: rng.gauss(4, 1), lambda: rng.gauss(0, 1)
    for kind, n, dp, dg, x, y in (("right", 500, 0, 0, good, good), ("peptide", 150, 0, 0, bad, good), ("glycan", 150, 0, 0, good, bad), ("both", 200, 0, 0, bad, bad), ("dp", 500, 1, 0, bad, good), ("dp", 200, 1, 0, bad, bad), ("dg", 500, 0, 1, good, bad), ("dg", 200, 0, 1, bad, bad), ("db", 800, 1, 1, bad, bad)):
        data += [(kind, dp, dg, x(), y(), None) for _ in range(n)]
    data.append(("none", 0, 0, None, 1.0, None))
    df = rows("kind string, decoy_peptide int, decoy_glycan int, d_score_peptide double, d_score_glycan double, pep_x string", data).withColumn("d_score", F.col("d_score_peptide") + F.col("d_score_glycan"))
    told = glyco.density_errors(df, estimator=estimator, pi0={"peptide": 0.35, "glycan": 0.35, "both": 0.2}, grid=64).toPandas()
    mean = told.groupby("kind")[list(glyco.ERRORS)].mean()
    assert mean.pep["right"] < 0.15 and mean.pep["both"] > 0.8 and mean.pep_peptide["peptide"] > 0.6 > 0.4 > mean.pep_glycan["peptide"]
    targets = told[told.kind.isin(["right", "peptide", "glycan", "both"])]
    chosen = targets[targets.qvalue < 0.05]
    assert len(chosen) > 300 and (chosen.kind != "right").mean() < 0.12
    assert told[told.kind == "none"].pep.isna().all() and ((told.pep.dropna() >= 0) & (told.pep.dropna() <= 1)).all()


def test_density_errors_of_nothing_and_null_shares(rows):
    df = rows("decoy_peptide int, decoy_glycan int, d_score_peptide double, d_score_glycan double, d_score double", [(0, 0, None, 1.0, 1.0)])
    assert glyco.density_errors(df).first().pep is None
    with pytest.raises(ValueError):
        glyco.density_errors(df, estimator="other")
    some = [(p, g, float(5 * (1 - p)), float(5 * (1 - g)), float(10 - 5 * p - 5 * g)) for p in (0, 1) for g in (0, 1) for _ in range(20)]
    assert glyco.part_null_shares(rows("decoy_peptide int, decoy_glycan int, d_score_peptide double, d_score_glycan double, d_score double", some), "d_score_peptide", "d_score_glycan", "d_score") == {"peptide": 0.0, "glycan": 0.0, "both": 0.0}

def test_exports(rows):
    features = rows("feature_id int, qvalue double", [(1, 0.01)])
    alignment = rows("feature_id int, reference_feature_id int, pep double, qvalue double", [(2, 1, 0.1, 0.1), (3, 1, 0.9, 0.1), (4, 9, 0.1, 0.1)])
    base = rows("feature_id int, qvalue double", [(1, 0.01), (2, 0.5), (3, 0.5), (4, 0.5)])
    assert sorted((r.feature_id, r.from_alignment) for r in export.with_aligned(features, alignment, base).collect()) == [(1, 0), (2, 1)]
    mapping, proteins = rows("peptide_id int, protein_id int", [(1, 8), (1, 7), (2, 7)]), rows("id int, protein_accession string", [(7, "A"), (8, "B")])
    assert {r.peptide_id: r.protein_accession for r in export.protein_lists(mapping, proteins).collect()} == {1: "A;B", 2: "A"}
    assert export.protein_lists(mapping, proteins, only_unique=True).count() == 1


def test_quantile_normalisation_uses_all_ranks(rows):
    """Runs of more rows than any grid of a thousand steps, with a long tail, ties, and one run shorter than the others."""
    import numpy as np

    rng = np.random.default_rng(3)
    runs = {"a": np.exp(rng.normal(0, 3, 2500)), "b": np.exp(rng.normal(1, 2, 2500)), "c": np.round(np.exp(rng.normal(2, 1, 700))), "d": np.array([7.0])}
    df = rows("run string, i int, v double", [(r, i, float(x)) for r, v in runs.items() for i, x in enumerate(v)] + [("a", 9999, None), (None, 0, 4.0)])
    runs[None] = np.array([4.0])
    at = lambda v, n: np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(v)), np.sort(v)) if len(v) > 1 else np.full(n, v[0])
    reference = np.mean([at(v, 2500) for v in runs.values()], axis=0)
    got = {(r.run, r.i): r.v for r in quant.quantile_normalised(df, "run", "v", ["i"]).collect()}
    assert len(got) == 5703 and got.pop(("a", 9999)) is None
    for r, v in runs.items():
        order = np.argsort(v, kind="stable")
        want = at(reference, len(v)) if len(v) > 1 else reference[:1]
        assert np.allclose([got[r, int(i)] for i in order], want, rtol=1e-9)


def test_consistency_curve_query_takes_all_rows(spark, rows, tmp_path):
    from quantloom.plans.quantification import QUERIES

    rows("s_suppkey int, s_nationkey int", [(1, 1), (2, 2)]).write.parquet(str(tmp_path / "supplier.parquet"))
    items = [(1, 10, 1.0, "N", 5.0), (2, 10, 1.0, "N", 50.0), (1, 11, 1.0, "R", 40.0), (2, 12, 1.0, "A", 9.0)]
    rows("l_suppkey int, l_partkey int, l_extendedprice double, l_returnflag string, l_quantity double", items).write.parquet(str(tmp_path / "lineitem.parquet"))
    curve = {r.k: (r.mean_any, r.mean_common) for r in QUERIES["consistency_curve"].run(spark, str(tmp_path)).collect()}
    assert curve == {1: (2.0, 2.0), 2: (3.0, 1.0)}
