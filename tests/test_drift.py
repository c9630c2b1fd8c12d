import datetime as dt
import json

from quantloom.operators import drift

SCHEMA = "feed_id long, file_id long, level string, written_at timestamp, line_no int, payload string, extra string"


def feed(files, feed_id=1, order=None):
    out = []
    for n, lines in enumerate(files):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=(order or list(range(len(files))))[n])
        out += [(feed_id, 100 + n, "feature_ms2", at, i, x if isinstance(x, str) or x is None else json.dumps(x), "e") for i, x in enumerate(lines)]
    return out


def changes(rows, data):
    return sorted((r.feed_id, r.file_id, r.field, r.change, r.old_field) for r in drift.schema_changes(rows(SCHEMA, data)).collect())


def line(i, **more):
    return {"ID": i, "shape": round(0.1234 + i * 0.0371, 4), "mass": round(3.21 + i * 0.773, 3), **more}


def test_every_change(rows):
    a = [line(i) for i in range(20)]
    b = [{"id": x["ID"], "xcorr": str(x["shape"]), "mass": x["mass"], "new": i * 0.17} for i, x in enumerate(a[10:] + [line(i) for i in range(20, 30)])]
    c = [{"id": x["id"], "xcorr": x["xcorr"], "new": [x["new"]]} for x in b]
    assert changes(rows, feed([a, b, c])) == [
        (1, 101, "new", "added", ""), (1, 101, "xcorr", "renamed", "shape"), (1, 101, "xcorr", "retyped", ""),
        (1, 102, "mass", "removed", ""), (1, 102, "new", "retyped", ""),
    ]


def test_time_orders_files_and_repeats_do_not_count(rows):
    a, b = [line(i) for i in range(12)], [line(i, late=1.5 + i) for i in range(12)]
    data = feed([b, a], order=[1, 0])
    assert changes(rows, data + data) == [(1, 100, "late", "added", "")]


def test_single_lines_and_missing_marks_change_nothing(rows):
    a = [line(i) for i in range(12)]
    b = [line(i) for i in range(6, 18)]
    b[3]["_note"] = "once"
    del b[4]["mass"]
    b[5]["mass"] = "NaN"
    assert changes(rows, feed([a, b + [None, "not json", ""]])) == []


def test_unrelated_fields_are_no_renaming(rows):
    a = [line(i, gone=i * 0.311 + 0.01) for i in range(20)]
    b = [line(i, came=900.5 + i * 1.7) for i in range(10, 30)]
    assert changes(rows, feed([a, b])) == [(1, 101, "came", "added", ""), (1, 101, "gone", "removed", "")]


def test_empty_and_single(rows):
    assert changes(rows, []) == []
    assert changes(rows, feed([[line(1), line(2)]])) == []


def test_unified(rows):
    a = [line(i) for i in range(20)]
    b = [{"ID": x["ID"], "form": f"{x['shape']} u".replace(".", ","), "mass": [x["mass"]], "odd": "k"} for x in a[8:]]
    wide = drift.unified(rows(SCHEMA, feed([a, b])), {"id": "long", "shape": "double", "mass": "double"})
    got = {(r.file_id, r.id): r for r in wide.collect()}
    assert len(got) == 32
    assert got[(101, 12)].shape == got[(100, 12)].shape == a[12]["shape"] and got[(101, 12)].mass == a[12]["mass"]
    assert got[(101, 12)].others == {"odd": "k"} and got[(100, 12)].others == {}


def test_flood_settles():
    score = drift.flood({"a_x": "number", "b_y": "text"}, {"x_a": "number", "b_z": "text"}, {})
    assert score["a_x", "x_a"] > score["a_x", "b_z"]


def test_the_flooded_scores_decide(rows, monkeypatch):
    old, new = {"id": "number", "shape": "number"}, {"id": "number", "xcorr": "number"}
    common, sizes = {("id", "id"): 10, ("shape", "xcorr"): 10}, ({"id": 20, "shape": 20}, {"id": 20, "xcorr": 20})
    assert drift.correspondences(old, new, common, sizes) == {"shape": "xcorr"}
    monkeypatch.setattr(drift, "flood", lambda a, b, first: {(x, y): 0.0 for x in a for y in b})
    assert drift.correspondences(old, new, common, sizes) == {}


def test_neighbours_tip_the_scales():
    """The same pair with the same first score is taken where parts and parents agree and left where they don't."""
    old, new = {"keep": "number", "m.exp_im": "number"}, {"keep": "number", "m.exp_mob": "number"}
    inside = drift.flood(old, new, {("m.exp_im", "m.exp_mob"): 0.4, ("keep", "keep"): 1.0})["m.exp_im", "m.exp_mob"]
    apart = drift.flood({"keep": "number", "m.exp_im": "number"}, {"keep": "number", "z.q": "text"}, {("m.exp_im", "z.q"): 0.4, ("keep", "keep"): 1.0})["m.exp_im", "z.q"]
    assert inside > apart + 0.1


def test_renamed_by_name_alone(rows):
    a = [{"ID": i, "var_xcorr_shape": 0.1 + i * 0.013, "mass": i * 1.7} for i in range(12)]
    b = [{"ID": 100 + i, "xcorr_shape_v2": 0.7 + i * 0.017, "mass": 200 + i * 1.3} for i in range(12)]
    assert changes(rows, feed([a, b])) == [(1, 101, "xcorr_shape_v2", "renamed", "var_xcorr_shape")]


def test_a_nested_object_is_renamed(rows):
    a = [{"ID": i, "scores": {"shape": 0.1 + i * 0.0137, "mass": {"dev": i * 0.77 + 0.3}}} for i in range(20)]
    b = [{"ID": x["ID"], "measures": x["scores"]} for x in a[8:]]
    assert changes(rows, feed([a, b])) == [(1, 101, "measures.mass.dev", "renamed", "scores.mass.dev"), (1, 101, "measures.shape", "renamed", "scores.shape")]


def test_flood_reaches_one_fixpoint():
    old, new = {"a_x": "number", "b.c": "text", "d": None}, {"a_z": "number", "e.c": "list"}
    fine, coarse = (drift.flood(old, new, {("a_x", "a_z"): 0.7}, eps=e) for e in (1e-12, 1e-4))
    assert set(fine) == {(x, y) for x in old for y in new} and all(0 <= v <= 1 for v in fine.values())
    assert all(abs(fine[k] - coarse[k]) < 1e-3 for k in fine)


def test_unified_keeps_lines_and_values_whole(rows):
    a = [line(i, several=[1.5, 2.5], text="A, b]", deep={"er": i}) for i in range(4)]
    data = feed([a + [None, "not json"]])
    wide = {r.line_no: r for r in drift.unified(rows(SCHEMA, data), {"id": "long", "shape": "double", "several": "double"}).collect()}
    assert len(wide) == 6 and wide[4].id is None and wide[5].others == {}
    assert wide[0].several is None and wide[0].others == {"several": "[1.5,2.5]", "text": "A, b]", "deep.er": "0", "mass": "3.21"}
