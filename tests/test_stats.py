import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.functions import normal
from quantloom.operators import scan, stats

# Vectors of scores and their known p-values, bandwidth and model FDR.
TARGETS = [0, 1, 3, 2, 0.1, 0.5, 0.6, 0.3, 0.5, 0.6, 0.2, 0.5]
DECOYS = [0.4, 0.2, 0.5, 1, 0.5, 0.7, 0.2, 0.4]
EMPIRICAL = [1.0, 0.125, 0.125, 0.125, 1.0, 0.25, 0.25, 0.75, 0.25, 0.25, 0.75, 0.25]
NORMAL = [9.674763e-01, 2.621760e-02, 0.0, 5.201675e-09, 9.287418e-01, 4.811347e-01, 3.351438e-01, 7.610205e-01, 4.811347e-01, 3.351438e-01, 8.617105e-01, 4.811347e-01]


def scores(rows, targets, decoys):
    return rows("score double, decoy int", [(float(x), 0) for x in targets] + [(float(x), 1) for x in decoys])


def test_empirical_p_values(rows):
    levels = stats.decoy_ranks(stats.score_values(scores(rows, TARGETS, DECOYS), "score", "decoy"))
    got = {r.score: r.above / r.m0 for r in levels.collect()}
    assert [got[float(x)] for x in TARGETS] == EMPIRICAL


def test_normal_p_values(rows):
    got = {r.cutoff: r.pvalue for r in stats.normal_pvalues(scores(rows, TARGETS, DECOYS), "score", "decoy").collect()}
    np.testing.assert_allclose([got[float(x)] for x in TARGETS], NORMAL, atol=1e-7)


def naive_table(targets, decoys, pi0):
    m0, m = len(decoys), len(targets)
    p = {x: max(sum(d > x for d in decoys), 1) / m0 for x in set(targets)}
    pos = {x: sum(p[t] <= p[x] for t in targets) for x in p}
    q = {x: min(min(1.0, pi0 * m * p[y] / pos[y]) for y in p if p[y] >= p[x]) for x in p}
    sens = {x: min(1.0, max(0.0, (pos[x] - pi0 * m * p[x]) / (m - pi0 * m))) if m != pi0 * m else 1.0 for x in p}
    s = {x: max(sens[y] for y in p if p[y] <= p[x]) for x in p}
    return {x: (p[x], q[x], s[x]) for x in p}


@pytest.mark.parametrize("one_task", [1 << 30, 0])
def test_error_table_against_brute_force(rows, monkeypatch, one_task):
    monkeypatch.setattr(stats, "running", lambda *a, **k: scan.running(*a, **k, one_task_bytes=one_task))
    monkeypatch.setattr(stats, "ONE_TASK_BYTES", one_task)
    rng = random.Random(5)
    targets = [round(rng.gauss(1.5, 1), 1) for _ in range(150)]
    decoys = [round(rng.gauss(0, 1), 1) for _ in range(90)]
    got = {r.cutoff: r for r in stats.error_table(scores(rows, targets, decoys), "score", "decoy", lambdas=0.4).collect()}
    p = [max(sum(d > x for d in decoys), 1) / 90 for x in targets]
    pi0 = min(1.0, sum(x >= 0.4 for x in p) / 150 / 0.6)
    want = naive_table(targets, decoys, pi0)
    assert set(got) == set(want)
    for x, (pv, q, s) in want.items():
        np.testing.assert_allclose([got[x].pvalue, got[x].qvalue, got[x].svalue], [pv, q, s], atol=1e-12)
        assert abs(got[x].tp + got[x].fp + got[x].tn + got[x].fn - 150) < 1e-9


def test_edges_of_the_error_table(rows):
    assert stats.error_table(scores(rows, [], [1]), "score", "decoy", lambdas=0.4).count() == 0
    assert stats.error_table(scores(rows, [], []), "score", "decoy", lambdas=0.4).count() == 0
    r = stats.error_table(scores(rows, [2, float("nan")], []), "score", "decoy", lambdas=0.4).collect()
    assert len(r) == 1 and r[0].pvalue is None
    keyed = rows("score double, decoy int, run string, m string", [(1.0, 0, "a", "x"), (0.5, 1, "a", "x"), (9.0, 0, "b", "x"), (10.0, 1, "b", "x"), (11.0, 1, "b", "x")])
    got = {r.run: r.pvalue for r in stats.error_table(keyed, "score", "decoy", ("run",), 0.4).collect()}
    assert got == {"a": 1.0, "b": 1.0}


def levels_of(rows, p, n=None):
    data = [(i, float(x), 1 if n is None else n[i]) for i, x in enumerate(p)]
    return rows("above long, pvalue double, n long", data)


def test_pi0(rows):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(size=700), rng.beta(0.3, 6, size=300)])
    df = levels_of(rows, p)
    at = lambda lam: np.mean(p >= lam) / (1 - lam)
    assert abs(stats.pi0(df, lambdas=0.4).first().pi0 - at(0.4)) < 1e-12
    lam = np.array(stats.LAMBDAS)
    est = np.array([at(x) for x in lam])
    w = np.array([(p >= x).sum() for x in lam])
    mse = w / (1000**2 * (1 - lam) ** 2) * (1 - w / 1000) + (est - np.percentile(est, 0.1)) ** 2
    assert abs(stats.pi0(df).first().pi0 - min(1, est[mse.argmin()])) < 1e-12
    fitted = np.polyval(np.polyfit(lam, est, 3), lam[-1])
    assert abs(stats.pi0(df, method="smoother").first().pi0 - min(1, fitted)) < 1e-9
    fitted = np.exp(np.polyval(np.polyfit(lam, np.log(est), 3), lam[-1]))
    assert abs(stats.pi0(df, method="smoother", log=True).first().pi0 - min(1, fitted)) < 1e-9
    with pytest.raises(ValueError):
        stats.pi0(df, lambdas=[0.1, 0.2])
    with pytest.raises(ValueError):
        stats.pi0(df, lambdas=[0.1, 0.2, 0.3, 1.0])


def test_spline_and_density_pieces():
    x = np.linspace(0, 1, 40)
    y = x**3 - 2 * x**2 + x
    np.testing.assert_allclose(stats._spline(x, y), 6 * x - 4, atol=1e-8)  # a cubic is its own not-a-knot spline
    rng = np.random.default_rng(2)
    data = rng.normal(size=4000)
    low, high, bw = data.min() - 3 * 0.3, data.max() + 3 * 0.3, 0.3
    weights = np.zeros(512)
    place = (data - low) / ((high - low) / 511)
    np.add.at(weights, place.astype(int), 1 - place % 1)
    np.add.at(weights, place.astype(int) + 1, place % 1)
    pieces = stats.density_pieces(weights, low, high, 4000, bw)
    mid = 256
    at = low + (mid + 0.5) * (high - low) / 511
    exact = np.exp(-0.5 * ((at - data) / bw) ** 2).mean() / (bw * math.sqrt(2 * math.pi))
    assert abs(pieces[mid] @ [1, 0.5, 0.25, 0.125] - exact) < 2e-3


def test_local_fdr_by_run_is_monotone_and_bounded(rows):
    rng = random.Random(8)
    data = [(rng.gauss(2 if i % 2 else 0, 1), 0, f"r{i % 2}") for i in range(600)] + [(rng.gauss(0, 1), 1, f"r{i % 2}") for i in range(400)]
    got = stats.error_table(rows("score double, decoy int, run string", data), "score", "decoy", ("run",), local_fdr=True).toPandas()
    for _, run in got.groupby("run"):
        pep = run.sort_values("cutoff", ascending=False).pep.to_numpy()
        assert (np.diff(pep) >= -1e-12).all() and 0 <= pep.min() and pep.max() <= 1
    good = got[got.run == "r1"]
    assert good.pep.min() < 0.05


@pytest.mark.parametrize(
    ("pep", "fdr"),
    [([0.5, 0.4, 0.2, 0.1, 0.001, 0.9, 0.7], [0.2402, 0.17525, 0.1003333, 0.0505, 0.001, 0.4001429, 0.3168333]), ([0.1, 0.1, 0.4], [0.1, 0.1, 0.2])],
)
def test_model_fdr(rows, pep, fdr):
    df = rows("i int, pep double, model string", [(i, x, "clash") for i, x in enumerate(pep)])
    np.testing.assert_allclose([r.model_fdr for r in stats.model_fdr(df, "pep").orderBy("i").collect()], fdr, atol=1e-7)


def test_chromatogram_hypotheses(rows):
    one = stats.chromatogram_hypotheses(rows("g int, pep double", [(1, 0.7)]), ["g"], "pep", 0.2)
    assert abs(one.first().h_score - 0.8 * 0.3 / (0.8 * 0.3 + 0.2 * 0.7)) < 1e-12
    got = stats.chromatogram_hypotheses(rows("g int, pep double", [(1, 0.0), (1, 0.5), (2, 0.0), (2, 0.0)]), ["g"], "pep").collect()
    assert sorted((r.g, r.pep, r.h_score, r.h0_score) for r in got if r.g == 1) == [(1, 0.0, 1.0, 0.0), (1, 0.5, 0.0, 0.0)]
    assert all(r.h_score is None for r in got if r.g == 2)


@pytest.mark.parametrize("one_task", [1 << 30, 0])
def test_nearest(rows, monkeypatch, one_task):
    monkeypatch.setattr(stats, "running", lambda *a, **k: scan.running(*a, **k, one_task_bytes=one_task))
    monkeypatch.setattr(stats, "ONE_TASK_BYTES", one_task)
    basis = rows("at double, name string", [(1.0, "a"), (2.0, "b"), (4.0, "c"), (4.0, "c")])
    values = rows("v double, name2 string", [(0.0, "x"), (1.5, "x"), (1.4, "x"), (3.1, "x"), (9.0, "x"), (4.0, "x"), (None, "x")])
    got = {r.v: r.name for r in stats.nearest(values, "v", basis, "at").collect()}
    assert got == {0.0: "a", 1.5: "b", 1.4: "a", 3.1: "c", 9.0: "c", 4.0: "c", None: None}


def test_tables_and_cutoff(rows):
    table = stats.error_table(scores(rows, TARGETS, DECOYS), "score", "decoy", lambdas=0.4)
    assert stats.final_error_table(table).count() == 51
    summary = stats.summary_error_table(table).orderBy("qvalue").collect()
    assert [r.qvalue for r in summary] == list(stats.SUMMARY_QVALUES) and any(r.pvalue is None for r in summary[1:])
    best = table.orderBy(F.abs(F.col("qvalue") - 0.1), "cutoff").first().cutoff
    assert stats.find_cutoff(table, 0.1).first().cutoff == best


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-20, 20)), min_size=1, max_size=40, unique=True))
def test_running_in_parts_equals_one_window(spark, data):
    df = spark.createDataFrame([(k, v, v % 5 - 1) for k, v in data], "k int, v int, x int")
    want = {"s": ("sum", "x"), "lo": ("min", "x"), "hi": ("max", "x")}
    for keys, down in ((("k",), False), (("k",), True)):
        a = scan.running(df, "v", want, keys, down).collect()
        b = scan.running(df, "v", want, keys, down, one_task_bytes=0).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_normal_functions(rows):
    df = rows("x double", [(0.0,), (1.959963984540054,), (None,), (float("nan"),)])
    got = [r.p for r in df.select(normal.upper_tail(F.col("x")).alias("p")).collect()]
    assert abs(got[0] - 0.5) < 1e-15 and abs(got[1] - 0.025) < 1e-12 and got[2:] == [None, None]
    assert rows("p double", [(0.0,), (0.975,)]).select(normal.quantile(F.col("p")).alias("z")).collect()[0].z is None


def test_top_and_d_scores(rows):
    df = rows("g int, i int, score double, decoy int", [(1, 2, 5.0, 0), (1, 1, 5.0, 0), (1, 3, None, 0), (2, 1, float("nan"), 1), (3, 1, 1.0, 1), (4, 1, 3.0, 1)])
    assert sorted((r.g, r.i) for r in stats.best_per_group(df, ["g"], "score", ["i"]).collect()) == [(1, 1), (3, 1), (4, 1)]
    d = {r.g: r.d_score for r in stats.d_scores(df.where("g > 2"), "score", "decoy").collect()}
    assert abs(d[3] + d[4]) < 1e-12


def test_hypotheses_of_tiny_certain_and_missing_peps(rows):
    data = [("many", i, 1e-8) for i in range(100)] + [("least", 0, 5e-324), ("least", 1, 0.5), ("one", 0, 0.0), ("one", 1, 0.3), ("two", 0, 0.0), ("two", 1, 0.0), ("sure", 0, 1.0), ("gap", 0, None), ("gap", 1, 0.5)]
    got = {(r.g, r.i): (r.h_score, r.h0_score) for r in stats.chromatogram_hypotheses(rows("g string, i int, pep double", data), ["g"], "pep").collect()}
    assert all(abs(got["many", i][0] - 0.01) < 1e-6 and got["many", i][1] < 1e-8 for i in range(100))
    assert abs(got["least", 0][0] - 1) < 1e-9 and got["one", 0] == (1.0, 0.0) and got["one", 1] == (0.0, 0.0)
    assert got["two", 0] == (None, None) and got["sure", 0] == (0.0, 1.0) and got["gap", 0] == (None, None) and got["gap", 1][0] > 0.4


def test_normal_tail_and_quantile_to_the_last_digits(spark):
    import math
    from statistics import NormalDist

    import numpy as np

    from quantloom.functions import normal

    z = np.linspace(-12, 12, 4001)
    want = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
    assert (np.abs(normal.tail(z) - want) <= 1e-12 * want).all() and np.isnan(normal.tail([np.nan]))[0] and list(normal.tail([np.inf, -np.inf])) == [0, 1]
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 2001), [1e-300, 1e-16, 0.5]])
    assert np.abs(normal.inverse(p) - [NormalDist().inv_cdf(x) for x in p]).max() < 1e-9 and np.isnan(normal.inverse([0.0, 1.0, -1.0, np.nan])).all()


def test_quantiles_are_exact_in_one_task_and_in_many(rows, monkeypatch):
    import numpy as np

    from quantloom.operators import scan

    rng = random.Random(8)
    data = [(k, rng.choice([rng.random(), 0.5, None, float("nan")])) for k in ("a", "b", None) for _ in range(150)]
    df = rows("k string, v double", data)
    for size in (1 << 27, 0):
        monkeypatch.setattr(scan, "ONE_TASK_BYTES", size)
        for r in scan.quantiles(df, "v", ["k"], {"q1": 0.25, "q2": 0.5, "top": 1.0}).collect():
            own = [v for k, v in data if k == r.k and v is not None and v == v]
            assert np.allclose([r.q1, r.q2, r.top], np.quantile(own, [0.25, 0.5, 1.0]))


def test_parametric_error_table(rows):
    rng = random.Random(4)
    data = [(rng.gauss(3, 1), 0) for _ in range(60)] + [(rng.gauss(0, 1), i % 2) for i in range(120)]
    got = stats.error_table(rows("score double, decoy int", data), "score", "decoy", parametric=True).orderBy("cutoff").collect()
    alone = {r.cutoff: r.pvalue for r in stats.normal_pvalues(rows("score double, decoy int", data), "score", "decoy").collect()}
    assert len(got) == len({s for s, d in data if d == 0}) and all(abs(r.pvalue - alone[r.cutoff]) < 1e-9 for r in got)
    assert all(a.qvalue >= b.qvalue and a.svalue >= b.svalue for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("how", [{"lambdas": 0.4}, {}, {"method": "smoother"}, {"pfdr": True}])
def test_small_and_large_error_tables_agree(rows, how):
    rng = random.Random(12)
    data = [(round(rng.gauss(1.5 * (i % 3 > 0), 1), 1), int(i % 3 == 0), rng.choice("ab")) for i in range(400)]
    df = rows("score double, decoy int, run string", data)
    small, large = (stats.error_table(df, "score", "decoy", ("run",), one_task_bytes=b, **how).orderBy("run", "cutoff").toPandas() for b in (1 << 30, 0))
    np.testing.assert_allclose(small[["cutoff", "n_targets", *stats.METRICS]].astype(float), large[["cutoff", "n_targets", *stats.METRICS]].astype(float), atol=1e-12)
    assert list(small.run) == list(large.run)
