import importlib.util
import os
import re

import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and all(re.fullmatch(r"[a-z0-9_]+", n) for n in names)
    assert {"p1_found", "p2_found", "p4_found", "p6_found"} <= names
    if importlib.util.find_spec("quantloom.llm"):
        assert {"p3_found", "p5_found", "p7_ids", "p8_mix", "p9_found"} <= names


def test_nothing_else_imports_the_llm_package():
    for folder, _, names in os.walk(f"{HERE}/quantloom"):
        for n in names:
            if n.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(f"{folder}/{n}") as f:
                    assert "quantloom.llm" not in f.read(), n


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no data here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"entity", "qvalue", "svalue"} <= set(df.columns)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no data here")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "full_outer_context_scores", "spectral_library", "proteotypic_best_score"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    mine = entry.queries()[name](spark, SMALL)
    columns = sorted(mine.columns)
    theirs = db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda r: tuple("" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(plain, (tuple(r) for r in mine.select(*columns).collect()))) == sorted(map(plain, theirs))
