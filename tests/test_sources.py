import sqlite3
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quantloom.sources import readers, writers


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "a.osw")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE FEATURE (ID INTEGER, RUN_ID INT, EXP_RT REAL, NAME TEXT)")
        db.executemany("INSERT INTO FEATURE VALUES (?,?,?,?)", [(9223372036854775807 - i, i % 3, i / 2, None if i == 4 else f"n{i}") for i in range(25)])
        db.execute("CREATE TABLE EMPTY (ID INTEGER)")
    return path


def test_sqlite(spark, store):
    assert readers.file_type(store) == "osw" and readers.sqlite_tables(store) == ["EMPTY", "FEATURE"]
    df = readers.read_sqlite(spark, store, "FEATURE", rows_per_task=7)
    assert dict(df.dtypes) == {"id": "bigint", "run_id": "bigint", "exp_rt": "double", "name": "string"} and df.rdd.getNumPartitions() == 4
    assert df.count() == 25 and df.agg(F.max("id")).first()[0] == 9223372036854775807 and df.where("name IS NULL").count() == 1
    assert readers.read_sqlite(spark, store, "EMPTY").count() == 0 and readers.runs_in(df) == 3
    with pytest.raises(ValueError):
        readers.read_sqlite(spark, store, "ABSENT")
    assert set(readers.read_store(spark, store)) == {"feature", "empty"}


def test_sqlite_sink(rows, tmp_path):
    path = str(tmp_path / "b.osw")
    df = rows("feature_id long, score double, name string", [(1, 0.5, "x"), (2, None, None)])
    assert writers.write_sqlite(df, path, "SCORE_MS2") == 2 and writers.write_sqlite(df, path, "SCORE_MS2") == 2
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*), sum(FEATURE_ID) FROM SCORE_MS2").fetchone() == (2, 3)


def test_chromatograms(rows):
    pack = lambda *v: struct.pack(f"<{len(v)}d", *v)
    chrom = rows("id long, native_id string", [(1, "77_Precursor_i0"), (2, "123"), (3, "x")])
    data = rows("chromatogram_id long, data_type int, compression int, data binary", [(1, 1, 1, zlib.compress(pack(5.0, 6.0))), (1, 2, 0, pack(0.1, 0.2)), (2, 2, 5, b"abc"), (2, 1, 1, b"broken")])
    got = {r.id: r for r in readers.chromatograms(chrom, data).collect()}
    assert (got[1].precursor_id, got[1].rt, got[1].intensity) == (77, [0.1, 0.2], [5.0, 6.0])
    assert got[2].transition_id == 123 and got[2].rt is None and got[2].intensity is None and got[3].precursor_id is None


def test_split_stores_and_text(spark, rows, tmp_path):
    p, t = rows("run_id long, FEATURE_ID long", [(1, 10), (2, 20)]), rows("run_id long, feature_id long", [(1, 10), (None, 5)])
    base = str(tmp_path / "s.oswpq")
    writers.write_split(p, t, base)
    assert readers.file_type(base) == "parquet_split"
    got = readers.read_store(spark, base)
    assert got["precursors"].count() == 2 and "feature_id" in got["precursors"].columns and got["transitions"].where("run_id IS NULL").count() == 1
    assert readers.file_type(str(tmp_path)) == "parquet_split_multi" and readers.read_store(spark, str(tmp_path))["precursors"].count() == 2
    writers.write_text(p, str(tmp_path / "x.tsv"))
    assert readers.read_tsv(spark, str(tmp_path / "x.tsv")).count() == 2
    with pytest.raises(ValueError):
        (tmp_path / "odd.bin").write_bytes(b"??")
        readers.file_type(str(tmp_path / "odd.bin"))


def test_context_sink_replaces_only_its_contexts(spark, rows, tmp_path):
    path = str(tmp_path / "scores")
    writers.write_context(rows("context string, x int", [("global", 1), ("run-specific", 2)]), path)
    writers.write_context(rows("context string, x int", [("global", 3)]), path)
    assert sorted((r.context, r.x) for r in spark.read.parquet(path).collect()) == [("global", 3), ("run-specific", 2)]


def test_scores_written_back(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    writers.write_parquet(rows("k int, score_ms2_q double", [(1, 9.0), (2, 9.0)]), path)
    old = writers.write_scores_back(path, rows("k int, q double", [(1, 0.5)]), ["k"], "score_ms2_")
    assert sorted((r.k, r.score_ms2_q) for r in spark.read.parquet(path).collect()) == [(1, 0.5), (2, None)]
    assert spark.read.parquet(old).where("score_ms2_q = 9").count() == 2


def test_trafo_xml(spark, tmp_path):
    (tmp_path / "a.trafoXML").write_text('<T><Pairs count="2"><Pair from="1.5" to="2.5"/><Pair from="3" to="4"/></Pairs></T>')
    assert sorted((r["from"], r.to) for r in readers.read_trafo_xml(spark, str(tmp_path / "a.trafoXML")).collect()) == [(1.5, 2.5), (3.0, 4.0)]


def test_views_and_tables_without_row_ids(spark, tmp_path):
    path = str(tmp_path / "v.osw")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE A (ID INTEGER, X REAL)")
        db.executemany("INSERT INTO A VALUES (?, ?)", [(i, i / 2) for i in range(9)])
        db.execute("CREATE VIEW V AS SELECT ID, X FROM A WHERE ID > 3")
        db.execute("CREATE VIEW NONE AS SELECT ID FROM A WHERE ID > 100")
        db.execute("CREATE TABLE W (K TEXT PRIMARY KEY, N INTEGER) WITHOUT ROWID")
        db.executemany("INSERT INTO W VALUES (?, ?)", [("a", 1), ("b", "odd")])
    assert sorted(r.id for r in readers.read_sqlite(spark, path, "V").collect()) == [4, 5, 6, 7, 8]
    assert readers.read_sqlite(spark, path, "NONE").count() == 0
    assert sorted((r.k, r.n) for r in readers.read_sqlite(spark, path, "W").collect()) == [("a", 1), ("b", None)]
    assert readers.read_store(spark, path)["v"].count() == 5
