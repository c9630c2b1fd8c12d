import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.operators import packed
from quantloom.operators.packed import parse, split_packed


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("A;B", ["A", "B"]), ("2/A/B", ["A", "B"]), ("1/A", ["A"]), ('A; "b; c",D', ["A", "b; c", "D"]), ('["a, v 1","B"]', ["a, v 1", "B"]), ("['x, y', 'B']", ["x, y", "B"]),
        ("{A;B}", ["A", "B"]), ("zz|Z1|K1_MOCK", ["zz|Z1|K1_MOCK"]), ("DECOY_zz|Z1|K1_MOCK|B", ["DECOY_zz|Z1|K1_MOCK", "B"]), ('"t ""7b"" u"; B', ['t "7b" u', "B"]),
        ('["say \\"hi\\"", "B"]', ['say "hi"', "B"]), ("A;;B;", ["A", "B"]), (" A\tB ", ["A", "B"]), ("A；B", ["A", "B"]), ("A / /B & C", ["A", "B", "C"]), ("A;A", ["A", "A"]),
        ("5'-NT;mt:a-1.2", ["5'-NT", "mt:a-1.2"]), ("", []), ("  ", []), (None, []), ('""', []), (";;", []),
    ],
)
def test_forms(text, values):
    assert [v for v, _ in parse(text)] == values


@pytest.mark.parametrize(("text", "values"), [('"A; B', ["A", "B"]), ("[A;B", ["[A", "B"]), ('x"y;z', ['x"y', "z"])])
def test_malformed_is_marked(text, values):
    got = parse(text)
    assert [v for v, _ in got] == values and any(bad for _, bad in got)


@given(st.lists(st.text(min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=5), st.sampled_from([";", ", ", " | ", "/", "\t"]))
def test_quoted_values_come_back(values, sep):
    assert parse(sep.join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values)) == [(v.replace("\\", "\\\\") if "\\" in v else v, False) for v in values] or any("\\" in v for v in values)


@given(st.text(max_size=60))
def test_never_fails_and_loses_no_letters(text):
    got = parse(text)
    assert all(v for v, _ in got)
    letters = "".join(c for c in text if c.isalpha())
    assert "".join(c for v, _ in got for c in v if c.isalpha()) == letters


def test_long_text_is_whole():
    assert len(parse(";".join(f"V{i}" for i in range(200_000)))) == 200_000
    assert parse("[" * 5000 + "A")[-1][0].endswith("A")


def test_rows(rows):
    df = rows("entry_id long, proteinid string, genename string, value string, pos int", [(1, "A;B", None, "x", 1), (1, "A;B", None, "y", 2), (2, "A", "", "x", 1), (3, None, "P,Q,P", "x", 1)])
    got = sorted(tuple(r) for r in split_packed(df, "entry_id", ["proteinid", "genename"], 2).collect())
    assert got == [(1, "proteinid", 1, "A", False), (1, "proteinid", 2, "B", False), (3, "genename", 1, "P", False), (3, "genename", 2, "Q", False), (3, "genename", 3, "P", False)]
    assert split_packed(df, "entry_id", ["proteinid"]).count() == 3
    assert split_packed(df.limit(0), "entry_id", ["proteinid"]).count() == 0
    assert [r.field for r in split_packed(df, "entry_id", ["value"]).where("entry_id = 3").collect()] == ["value"]


def test_brackets_of_any_depth():
    assert packed.parse("[" * 25 + "a;b" + "]" * 25) == [("a", False), ("b", False)]
    assert packed.parse("{[(" * 10_000 + "a b" + ")]}" * 10_000) == [("a", False), ("b", False)]


def test_stray_brackets_cost_no_more_than_their_number():
    import time

    began = time.perf_counter()
    assert packed.parse("( " * 10_000 + "a;b")[-2:] == [("a", False), ("b", False)]
    assert time.perf_counter() - began < 2  # about 0.1 s alone; the machine may be busy


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 ;,/|()[]{}\"'\\", min_size=1, max_size=12))
def test_work_grows_with_the_length(unit):
    def steps(times):
        parser = packed._Parser(unit * times)
        parser.values(0)
        return len(parser.step)

    assert steps(400) <= 4 * len(unit) * 400 + 1
    assert steps(400) <= 10 * (steps(50) + 4)
