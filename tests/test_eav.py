import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import eav

SCHEMA = "row_id long, context string, run_id long, peptide_id long, score double, qvalue double, loaded_at timestamp, entity_id string"
T = dt.datetime(2024, 1, 1)


def wide(rows, data):
    df = rows(SCHEMA, [(*r, "clash") for r in data])
    return {(r.entity_id, r.run_id): r.asDict() for r in eav.wide_context_scores(df, "peptide_id").collect()}


@pytest.mark.parametrize(
    ("text", "context"),
    [("GLOBAL", "global"), (" gloabl", "global"), ("glob", "global"), ("context=global", "global"), ("run‑specific", "run-specific"), ("Run_Spec", "run-specific"), ("runspecific\t", "run-specific"),
     ("exp-wide", "experiment-wide"), ("experiment–wide", "experiment-wide"), ("unknown", None), ("", None), ("n/a", None), (None, None)],
)
def test_contexts(rows, text, context):
    assert rows("c string", [(text,)]).select(eav.read_context(eav.context_letters(F.col("c"))).alias("c")).first().c == context


def test_cells_winners_and_nothing(rows):
    later = T + dt.timedelta(days=1)
    got = wide(
        rows,
        [
            (1, "global", None, 7, 1.0, 0.1, T), (2, "Global", 99, 7, 2.0, 0.2, later), (3, "run-specific", 5, 7, 3.0, 0.3, T), (4, "run-spec", 5, 7, 4.0, 0.4, T),
            (5, "exp-wide", 5, 7, 5.0, None, T), (6, "exp-wide", None, 7, 5.0, 0.5, T), (7, "n/a", 5, 7, 6.0, 0.6, T), (8, "global", None, None, 1.0, 0.1, T),
            (9, "global", None, 8, float("nan"), 0.1, T), (10, "run-specific", 6, 8, None, 0.1, T), (11, "run-specific", 6, 9, 1.5, 0.1, None), (12, "run-specific", 6, 9, 1.7, 0.1, T),
        ],
    )
    assert set(got) == {(7, 0), (7, 5), (9, 6)}
    assert got[(7, 0)]["global_row_id"] == 2 and got[(7, 0)]["run_specific_row_id"] is None
    assert got[(7, 5)]["run_specific_score"] == 4.0 and got[(7, 5)]["experiment_wide_row_id"] == 5 and got[(7, 5)]["experiment_wide_qvalue"] is None
    assert got[(9, 6)]["run_specific_row_id"] == 12


def test_empty_has_all_columns(rows):
    df = eav.wide_context_scores(rows(SCHEMA, []), "peptide_id")
    assert df.count() == 0 and len(df.columns) == 2 + 3 * 3


def test_many_attributes_and_misfits(rows):
    df = rows("e long, a string, v string, o long", [(1, "a", "1", 1), (1, "b", "x", 1), (2, "c", "3", 1), (2, "e", "5", 1), (2, "e", "6", 2), (3, "z", "1", 1)])
    attributes = [eav.Attribute(x, x) for x in "abcde"]
    got = {r.e: r.asDict() for r in eav.to_wide(df, ["e"], "a", attributes, {"v": "int"}, ["o", "v"]).collect()}
    assert got == {1: {"e": 1, "a_v": 1, "b_v": None, "c_v": None, "d_v": None, "e_v": None}, 2: {"e": 2, "a_v": None, "b_v": None, "c_v": 3, "d_v": None, "e_v": 6}}
    cells = eav.filled_cells(eav.to_wide(df, ["e"], "a", attributes, {"v": "int"}, ["o", "v"]), ["e"], attributes, "v")
    assert sorted(tuple(r) for r in cells.collect()) == [(1, "a", 1), (2, "c", 3), (2, "e", 6)]
