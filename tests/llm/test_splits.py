import random

import pytest

from quantloom.llm import splits


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_components(rows, monkeypatch, few):
    monkeypatch.setattr(splits, "FEW_EDGES", few)
    rng = random.Random(2)
    edges = [(rng.randrange(-50, 150), rng.randrange(-50, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5200)]
    df = rows("a long, b long", edges + [(7, 7), (None, 3), (4, None)] + edges[:20])
    want = union_find([(a, b) for a, b in edges if a != b])
    assert {r.node: r.component for r in splits.components(df).collect()} == want
    assert splits.components(df.limit(0)).count() == 0


P = "id long, traml_id string, decoy int, set_id string"


def test_precursor_sets(rows):
    precursors = rows(
        P,
        [
            (1, "PEP_2", 0, ""), (2, "DECOY_PEP_2", 1, ""), (3, "AAA_2", 0, ""), (4, "AAA_2.decoy", 1, ""), (5, "BBB_3", 0, ""), (6, "rev_CCC_3", 1, ""), (7, "DECOY_DDD", 0, ""), (8, "DDD", 0, ""),
            (9, "##shuffled##BBB_3", 1, ""), (10, None, 1, ""), (11, "EEE", None, ""), (12, "FFF", 0, ""), (3, "AAA_2", 0, ""), (13, "DECOY_DECOY_DDD", 1, ""),
        ],
    )
    mapping = rows("precursor_id long, peptide_id long", [(2, 50), (3, 50), (5, None), (8, None), (12, 60), (12, 60), (99, 70), (11, 70)])
    got = {r.precursor_id: r.set_id for r in splits.precursor_sets(precursors, mapping).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 9: 5, 7: 7, 13: 7, 11: 11}
    assert splits.precursor_sets(precursors.limit(0), mapping.limit(0)).count() == 0


def test_stratify_places_rare_labels_first():
    vectors = {f"c{i}": {"common": 10, **({"rare": 1} if i % 10 == 0 else {})} for i in range(100)}
    placed = splits.stratify(vectors, [0.8, 0.1, 0.1])
    rare = [placed[c] for c in vectors if "rare" in vectors[c]]
    assert sorted(rare) == [0] * 8 + [1, 2]
    sizes = [sum(1 for s in placed.values() if s == k) for k in range(3)]
    assert sizes == [80, 10, 10]
    assert splits.stratify({}, [0.5, 0.5]) == {}


def test_shares_labels_and_no_parted_entity(rows):
    rng = random.Random(6)
    data = [(i, rng.choice([None, 1, rng.randrange(2, 900)]), rng.choice([100, 100, 200]), rng.randrange(2)) for i in range(6000)]
    df = rows("id long, entity long, run long, decoy int", data)
    got = splits.grouped_splits(df, "entity", "id", ["run", "decoy"], splits.SHARES, max_cells=256).collect()
    assert len(got) == 6000
    by = {}
    for r in got:
        if r.entity is not None:
            by.setdefault(r.entity, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    for run in (100, 200):
        for decoy in (0, 1):
            own = [r.split for r in got if (r.run, r.decoy) == (run, decoy)]
            for name, share in splits.SHARES.items():
                assert abs(own.count(name) / len(own) - share) < 0.04
    assert splits.grouped_splits(df.limit(0), "entity", "id", ["run"], splits.SHARES).count() == 0


def test_many_labels_are_folded(rows):
    df = rows("id long, entity long, run long", [(i, i // 2, i % 500) for i in range(2000)])
    got = splits.grouped_splits(df, "entity", "id", ["run"], splits.SHARES, max_cells=64, max_labels=16).collect()
    assert len(got) == 2000 and 0.7 < sum(r.split == "train" for r in got) / 2000 < 0.9


def test_every_run_and_decoy_value_is_in_every_split(rows):
    """300 (run, decoy) labels, more than are placed in one pass; the decoys of a run are few and have entities of their own."""
    data = [(f"{run}-{i}", run * 1000 + 500 + i if i < 20 else run // 3 * 1000 + i, run, int(i < 20)) for run in range(150) for i in range(80)]
    df = rows("id string, entity long, run long, decoy int", data)
    got = splits.grouped_splits(df, "entity", "id", ["run", "decoy"], splits.SHARES).collect()
    assert len(got) == len(data)
    by, of = {}, {}
    for r in got:
        by.setdefault((r.run, r.decoy), []).append(r.split)
        of.setdefault(r.entity, set()).add(r.split)
    assert all(len(s) == 1 for s in of.values())
    assert len(by) == 300 and all(set(s) == set(splits.SHARES) for s in by.values())
    for decoy in (0, 1):
        own = [r.split for r in got if r.decoy == decoy]
        assert all(abs(own.count(name) / len(own) - share) < 0.04 for name, share in splits.SHARES.items())


def test_shares_are_met_closely_unless_one_entity_forbids(rows):
    """One entity holds a third of run 3; entities span runs. All rows within half a point, labels of over 1000 rows within one."""
    rng = random.Random(9)
    data = [(i, 1 if i % 12 == 3 else rng.randrange(2, 4000), i % 4, rng.randrange(2)) for i in range(20_000)]
    df = rows("id long, entity long, run long, decoy int", data)
    told = splits.reached_shares(splits.grouped_splits(df, "entity", "id", ["run", "decoy"], splits.SHARES), ["run", "decoy"], splits.SHARES).collect()
    assert len(told) == 3 * 9 and sum(r.n_rows for r in told if r.level == "all") == 20_000
    assert all(abs(r.deviation) <= 0.005 for r in told if r.level == "all")
    assert all(abs(r.deviation) <= 0.01 for r in told if r.level == "label")


def test_reached_shares_of_nothing_and_absent_splits(rows):
    df = rows("run long, split string", [(1, "train"), (1, "train"), (None, "test")])
    told = {(r.level, r.run, r.split): (r.n_rows, r.share) for r in splits.reached_shares(df, ["run"], splits.SHARES).collect()}
    assert told["label", 1, "train"] == (2, 1.0) and told["label", 1, "test"] == (0, 0.0) and told["label", None, "test"] == (1, 1.0)
    assert splits.reached_shares(df.limit(0), ["run"], splits.SHARES).where("level = 'label'").count() == 0
