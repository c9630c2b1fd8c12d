import random

import pytest

from quantloom.llm.topn import best_scored, top_n

SCHEMA = "run long, prec long, id long, score double, g0 string, bound string"


def naive(data, n):
    groups = {}
    for run, prec, i, s, *_ in data:
        if s is not None and s == s:
            groups.setdefault((run, prec), []).append((-s, i is not None, i))
    return sorted((g, [x[2] for x in sorted(v)[:n]]) for g, v in groups.items())


def got(df, n, **how):
    groups = {}
    for r in top_n(df, ["run", "prec"], "score", ["id"], n, **how).collect():
        groups.setdefault((r.run, r.prec), []).append((r.pos, r.id))
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in groups.values())
    return sorted((g, [i for _, i in sorted(v)]) for g, v in groups.items())


@pytest.mark.parametrize("heavy", [1, 4096])
def test_against_brute_force(rows, heavy):
    rng = random.Random(3)
    data = [(rng.randrange(3), rng.choice([1, rng.randrange(60)]), i, rng.choice([float("nan"), None, rng.randrange(12) / 4, rng.random()]), "a", "b") for i in range(6000)]
    df = rows(SCHEMA, data).repartition(5)
    for n in (1, 3, 7):
        assert got(df, n, heavy=heavy) == naive(data, n)


def test_ties_follow_the_tie_rule_whatever_the_partitions(rows):
    data = [(1, 1, i, 5.0, "a", "b") for i in range(500)]
    for parts in (1, 7):
        assert got(rows(SCHEMA, data).repartition(parts), 3) == [((1, 1), [0, 1, 2])]


def test_null_groups_few_rows_and_empty(rows):
    assert got(rows("run long, prec long, id long, score double", [(1, 1, 9, 1.0)]), 3) == [((1, 1), [9])]
    df = rows("run long, prec long, id long, score double", [(None, 1, i, float(i)) for i in range(40)])
    assert got(df, 2) == [((None, 1), [39, 38])]
    assert top_n(df.limit(0), ["run", "prec"], "score", ["id"], 2).count() == 0
    with pytest.raises(ValueError):
        top_n(df, ["run"], "score", ["id"], 2, pos="PREC")


def test_best_scored(rows):
    features = rows("id long, run_id long, precursor_id long, score string", [(1, 5, 7, "x"), (1, 5, 7, "x"), (2, 5, None, "x"), (None, 5, 7, "x"), (3, 5, 8, "x")])
    scores = rows("feature_id long, score double, rank double", [(1, 1.0, 1.0), (1, 3.0, 2.0), (1, float("nan"), 1.0), (2, 9.0, 1.0), (None, 1.0, 1.0)])
    assert [tuple(r) for r in best_scored(features, scores).collect()] == [(5, 7, 1, 3.0)]
