import datetime as dt
import random

from quantloom.operators.orphans import MAX_BLOCKS, Reference, _probe, bits_set, block_count, bloom_blocks, find_orphans, orphan_report

REF = Reference("child", "key", "ref", "parent")
CHILD, PARENT = "key long, ref long, loaded_at timestamp, id string", "id long, loaded_at timestamp, deleted_at timestamp, ref string"
T = dt.datetime


def found(child, parent, **how):
    return sorted((r.child_key, r.ref_id, r.period, r.status) for r in find_orphans(child, parent, REF, **how).collect())


def naive(child, parent):
    out = set()
    for key, ref, at, _ in child:
        if ref is None:
            continue
        own = [(a, b) for i, a, b, _ in parent if i == ref]
        if not own:
            out.add((key, ref, at.strftime("%Y-%m"), "missing"))
        elif not any(a <= at and (b is None or at < b) for a, b in own):
            out.add((key, ref, at.strftime("%Y-%m"), "late" if all(a > at for a, _ in own) else "deleted"))
    return sorted(out)


def test_statuses_and_edges(rows):
    parent = rows(PARENT, [(1, T(2024, 1, 1), None, "x"), (2, T(2024, 1, 1), T(2024, 2, 1), "x"), (2, T(2024, 3, 1), None, "x"), (None, T(2024, 1, 1), None, "x")])
    child = rows(
        CHILD,
        [
            (10, 1, T(2024, 1, 1), "a"), (11, 1, T(2023, 12, 31), "a"), (12, 2, T(2024, 2, 1), "a"), (13, 2, T(2024, 3, 1), "a"), (14, 3, T(2024, 1, 5), "a"),
            (14, 3, T(2024, 1, 9), "again"), (15, None, T(2024, 1, 1), "a"), (None, 3, T(2024, 1, 5), "a"),
        ],
    )
    got = set(found(child.where("key IS NOT NULL"), parent))
    assert got == {(11, 1, "2023-12", "late"), (12, 2, "2024-02", "deleted"), (14, 3, "2024-01", "missing")}
    assert find_orphans(child, parent, REF).where("child_key IS NULL").count() == 1
    report = {(r.period, r.status): (r.orphan_rows, r.orphan_refs) for r in orphan_report(find_orphans(child, parent, REF)).collect()}
    assert report[("2024-01", "missing")] == (2, 1)


def test_child_without_time(rows):
    parent = rows(PARENT, [(1, T(2024, 1, 1), T(2024, 1, 2), "x")])
    child = rows(CHILD, [(10, 1, None, "a"), (11, 9, None, "a")])
    assert found(child, parent) == [(11, 9, None, "missing")]


def test_empty_tables(rows):
    parent, child = rows(PARENT, []), rows(CHILD, [(1, 5, T(2024, 1, 1), "a")])
    assert found(child, parent) == [(1, 5, "2024-01", "missing")]
    assert found(rows(CHILD, []), parent) == []


def test_all_ways_agree_with_brute_force(rows):
    rng = random.Random(4)
    day = lambda: T(2024, 1, 1) + dt.timedelta(days=rng.randrange(90))
    parent = [(i % 80 * 7919 - 300_000, a := day(), rng.choice([None, a + dt.timedelta(days=rng.randrange(1, 30))]), "p") for i in range(160)]
    child = [(k, rng.choice([5, rng.randrange(120) * 7919 - 300_000, None]), day(), "c") for k in range(1500)]
    child += [(k, 0 * 7919 - 300_000, day(), "hot") for k in range(2000, 3000)]
    want = naive(child, parent)
    c, p = rows(CHILD, child), rows(PARENT, parent)
    assert found(c, p) == want
    assert found(c, p, max_broadcast_rows=20) == want  # shuffled, the hot reference by broadcast
    assert found(c, p, max_broadcast_rows=0) == want
    assert found(c, p, max_blocks=1) == want  # a filter that lets nearly everything pass


def test_filter_size_is_bounded():
    assert block_count(0) == 8 and block_count(10**12) == MAX_BLOCKS
    assert block_count(1_000_000) * 512 >= 10_000_000
    assert [bits_set(keys, block_count(keys)) for keys in (10, 10**8, 2 * 10**8, 4 * 10**8)] == [8, 4, 2, 1]


def test_filter_has_no_false_negatives_and_proves_most(spark):
    """With room for ten bits a key, and with the bound so tight that four, two or one bit is set."""
    from pyspark.sql import functions as F

    keys, other = spark.range(20_000).select(F.xxhash64("id").alias("_id")), spark.range(50_000, 60_000).select(F.xxhash64("id").alias("k"))
    for blocks, bits, most in ((block_count(20_000), 8, 0.03), (200, 4, 0.2), (100, 2, 0.4), (50, 1, 0.6)):
        filter_ = bloom_blocks(keys, "_id", blocks, bits)
        assert bits_set(20_000, blocks) == bits
        assert _probe(keys, "_id", filter_, blocks, bits).where("NOT _may").count() == 0
        assert _probe(other, "k", filter_, blocks, bits).where("_may").count() < most * 10_000
