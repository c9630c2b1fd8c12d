import numpy as np
import pytest

from quantloom.operators import bayes

MODEL = "feature_id string, prior double, evidence double, hypothesis int"
EVIDENCE = [0.1, 0.1, 0.9, 0.9, 0.2, 0.8, 0.8, 0.2, 0.4, 0.4, 0.6, 0.4]


def test_precursor_model(rows):
    df = rows("feature_id long, ms1_precursor_pep double, ms2_peakgroup_pep double, ms2_precursor_pep double", [(0, 0.4, 0.2, 0.5), (1, None, 0.2, 0.5), (2, None, 0.2, None)])
    got = sorted((r.feature_id, round(r.prior, 9), round(r.evidence, 9), r.hypothesis) for r in bayes.precursor_model(df).collect())
    assert got[:4] == sorted([(0, 0.8, 0.6, True), (0, 0.2, 0.4, False), (0, 0.8, 0.5, True), (0, 0.2, 0.5, False)])
    assert [x for x in got if x[0] == 1] == [(1, 0.2, 0.5, False), (1, 0.8, 0.5, True)]
    assert [x for x in got if x[0] == 2] == [(2, 0.2, 1.0, False), (2, 0.8, 0.0, True)]
    inferred = {r.feature_id: r.precursor_peakgroup_pep for r in bayes.precursor_inference(df, 1.1).collect()}
    assert abs(inferred[0] - (1 - 0.24 / (0.24 + 0.04))) < 1e-12 and inferred[2] == 1.0


def posteriors(rows, data, **how):
    return {(r.feature_id, r.hypothesis): r for r in bayes.posteriors(rows(MODEL, data), **how).collect()}


@pytest.mark.parametrize("log_space", [False, True])
def test_posteriors(rows, log_space):
    data = [("id0", p, e, h) for e, h, p in zip(EVIDENCE, [1, 2, 3, -1] * 3, [0.2, 0.2, 0.2, 0.4] * 3)]
    got = posteriors(rows, data, log_space=log_space)
    want = {-1: (0.0288, 0.233766), 1: (0.0016, 0.012987), 2: (0.0064, 0.051948), 3: (0.0864, 0.701299)}
    for h, (likelihood, posterior) in want.items():
        r = got[("id0", h)]
        np.testing.assert_allclose([r.likelihood_prior, r.likelihood_sum, r.posterior], [likelihood, 0.1232, posterior], atol=1e-6)


def test_underflow_and_clipping(rows):
    many = [("a", 0.5, e, h) for h, e in ((1, 0.1), (2, 0.2)) for _ in range(1000)]
    assert sum(r.posterior for r in posteriors(rows, many).values()) == 0
    logs = posteriors(rows, many, log_space=True)
    assert logs[("a", 2)].posterior > 0.999999 and abs(sum(r.posterior for r in logs.values()) - 1) < 1e-12
    sharp = [("a", 0.5, 1.0, 1), ("a", 0.5, 1.0, 1), ("a", 0.5, 0.0, 2), ("a", 0.5, 0.0, 2)]
    for log_space in (False, True):
        assert posteriors(rows, sharp, log_space=log_space)[("a", 1)].posterior == 1
        p = posteriors(rows, sharp, eps=1e-6, log_space=log_space)[("a", 1)].posterior
        assert 0 < p < 1
        assert {r.posterior for r in posteriors(rows, [("z", 0.5, 0.0, 1), ("z", 0.5, 0.0, 2)], log_space=log_space).values()} == {0.0}


TRANSITIONS = "feature_id int, peptide_id int, transition_id int, bmask int, n_mapped_peptides int, has_phospho_loss int, isotope_overlap_score double"


def test_support_metrics(rows):
    data = [(1, 10, 100, 1, 1, 1, 0.01), (1, 10, 101, 0, 2, 0, 0.05), (1, 11, 102, 1, 1, 0, 0.02), (2, 20, 200, 1, 2, 1, 0.03), (2, -1, 201, 1, 2, 0, 0.04), (3, 30, 300, 1, 1, 0, 0.01), (3, 31, 300, 0, 1, 0, 0.01)]
    intensity = rows("feature_id int, feature_ms2_intensity double", [(1, 1000.0), (2, 200.0), (3, 50.0)])
    got = sorted(tuple(r) for r in bayes.support_metrics(rows(TRANSITIONS, data), intensity).select("feature_id", "peptide_id", "supporting_transitions", "unique_supporting_transitions", "phospho_loss_supporting_transitions", "median_supporting_isotope_overlap", "feature_ms2_intensity").collect())
    assert got == [(1, 10, 1, 1, 1, 0.01, 1000.0), (1, 11, 1, 1, 0, 0.02, 1000.0), (2, 20, 1, 0, 1, 0.03, 200.0), (3, 30, 1, 1, 0, 0.01, 50.0), (3, 31, 0, 0, 0, None, 50.0)]


METRICS = "feature_id int, peptide_id int, supporting_transitions int, unique_supporting_transitions int, phospho_loss_supporting_transitions int, feature_ms2_intensity double"


def test_support_filter(rows):
    data = [(1, 10, 1, 1, 1, 1000.0), (1, 11, 2, 2, 0, 1000.0), (2, 20, 2, 0, 1, 200.0), (3, 30, 3, 3, 0, 50.0), (4, 40, 1, 1, 0, 1000.0)]
    kept = bayes.support_filter(rows(METRICS, data), 1, 1, 2, 100.0)
    assert sorted((r.feature_id, r.peptide_id) for r in kept.collect()) == [(1, 10), (1, 11)]
    data = [(1, 10, 1, 1, 0, 5000.0), (2, 20, 1, 1, 1, 5000.0), (3, 30, 2, 2, 0, 5000.0), (4, 40, 3, 3, 0, 5000.0)]
    kept = bayes.support_filter(rows(METRICS, data), conditional_intensity=10000.0, conditional_max_supporting=2, conditional_no_loss_only=True)
    assert sorted(r.feature_id for r in kept.collect()) == [2, 4]
    assert bayes.support_filter(rows(METRICS, data)).count() == 4
    with pytest.raises(ValueError):
        bayes.support_filter(rows(METRICS, data), conditional_intensity=1.0)


def test_peptidoforms(rows):
    transitions = rows("feature_id int, peptide_id int, pep double, bmask int, num_peptidoforms int", [(1, p, e, m, 2) for p, e, m in [(7, 0.1, 1), (7, 0.2, 1), (8, 0.1, 0), (8, 0.2, 1), (-1, 0.1, 0), (-1, 0.2, 0)]])
    precursors = rows("feature_id int, precursor_peakgroup_pep double", [(1, 0.2), (2, 0.1)])
    got = {r.peptide_id: r for r in bayes.peptidoform_inference(transitions, precursors).collect()}
    like = {7: 0.9 * 0.8 * 0.4, 8: 0.1 * 0.8 * 0.4, -1: 0.1 * 0.2 * 0.2}
    total = sum(like.values())
    assert set(got) == {7, 8} and abs(got[7].pep - (1 - like[7] / total)) < 1e-12 and abs(got[7].qvalue - got[7].pep) < 1e-12
    assert abs(got[8].qvalue - (got[7].pep + got[8].pep) / 2) < 1e-12
    assert bayes.peptidoform_inference(transitions.limit(0), precursors).count() == 0


def test_propagated_rows_are_not_shuffled(rows):
    """What the features of a group get is a multiple of their rows; it has to leave the join as it is, with the results of the plain definition."""
    draw = np.random.default_rng(5)
    some = lambda *given: given[draw.integers(len(given))]
    kinds = [(t, p, 1, n, x) for t in (1, 2, 3) for p in (7, None) for n in (1, 2) for x in ("a", None)]
    data = [(some(1, 2, 3, None), some(*range(12)), some(True, True, True, False, None), *some(*kinds), some(0.05, 0.1, 0.10001, 0.3, None), some(0.2, 0.4, None)) for _ in range(400)]
    schema = "alignment_group_id long, feature_id long, is_aligned boolean, transition_id int, peptide_id int, bmask int, num_peptidoforms int, extra string, pep double, precursor_peakgroup_pep double"
    aligned = [r for r in data if r[2]]
    want = [(*r[:2], *r[3:]) for r in data if r[2] is False]
    for group, feature in {r[:2] for r in aligned}:
        met = {}
        for r in aligned:
            if r[0] == group and (r[1] == feature or group is not None and r[8] is not None and r[8] <= 0.1):
                met.setdefault(r[3:8], []).append(r[8:])
        want += [(group, feature, *item, *[min((x for x in v if x is not None), default=None) for v in zip(*values)]) for item, values in met.items()]
    got = bayes.propagated(rows(schema, data), 0.1, ["extra"])
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert len(want) > len(data)
    above = got._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above and "Sort [" not in above
