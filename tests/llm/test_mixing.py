import pytest
from pyspark.sql import functions as F

from quantloom.llm.mixing import SPACE, mix, place

TARGETS = "source string, target_share double, max_repeats int"


def run(rows, docs, targets, **how):
    df = rows("doc_id long, source string, n long, tokens string, uses string", [(*d, "x", "y") for d in docs])
    used, report = mix(df, rows(TARGETS, targets), F.col("n"), **how)
    return {r.doc_id: r for r in used.collect()}, {r.source: r for r in report.collect()}


def test_budgets_and_caps(rows):
    docs = [(i, "big", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "small", 5) for i in range(100)] + [(20_000, "other", 9), (20_001, None, 9)]
    used, report = run(rows, docs, [("big", 0.5, 1), ("small", 0.3, 4), ("absent", 0.2, 3)])
    total = sum(n for _, s, n in docs if s in ("big", "small"))
    assert 20_000 not in used and 20_001 not in used
    big = sum(r.tokens * r.uses for r in used.values() if r.source == "big")
    assert total * 0.5 - 17 < big <= total * 0.5 and report["big"].used_tokens == big and report["big"].max_uses == 1
    assert report["small"].used_tokens == 4 * 500 and report["small"].max_uses == 4
    assert report["absent"].used_tokens == 0 and report["absent"].actual_share == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_whole_passes_and_a_part(rows):
    used, report = run(rows, [(i, "a", 1) for i in range(1000)], [("a", 1.0, 5)], total=2345)
    assert report["a"].used_tokens == 2345 and {r.uses for r in used.values()} == {2, 3} and len(used) == 1000


def test_thresholds_are_nested(rows):
    docs = [(i, "a", 1 + i % 5) for i in range(2000)]
    less, _ = run(rows, docs, [("a", 1.0, 1)], total=1000)
    more, _ = run(rows, docs, [("a", 1.0, 1)], total=2500)
    assert set(less) < set(more)


@pytest.mark.parametrize("docs", [[], [(1, "a", None)], [(1, "a", 0), (2, "a", 0)]])
def test_nothing_to_mix(rows, docs):
    _, report = run(rows, docs, [("a", 1.0, 2), ("b", None, None)])
    assert report["a"].used_tokens == 0 and report["b"].actual_share == 0


def test_one_huge_document_and_no_targets(rows):
    used, report = run(rows, [(1, "a", 10**9), (2, "a", 3)], [("a", 0.5, 1)])
    assert report["a"].used_tokens <= (10**9 + 3) // 2
    assert run(rows, [(1, "a", 5)], [])[0] == {}


def test_places_fill_the_space(spark):
    r = spark.range(10_000).select(place(F.col("id"), 1).alias("p")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg("p").alias("mean")).first()
    assert 0 <= r.lo < SPACE * 0.01 and SPACE * 0.99 < r.hi < SPACE and abs(r.mean / SPACE - 0.5) < 0.02
