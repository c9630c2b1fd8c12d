from pyspark.sql import functions as F

from quantloom.functions import peptides as P


def one(rows, text, expr):
    return rows("s string", [(text,)]).select(expr(F.col("s")).alias("v")).first().v


def test_masses(rows):
    assert abs(one(rows, "PEPTIDE", P.peptide_mass) - 799.35996) < 1e-4
    assert abs(one(rows, "PEPC(UniMod:4)", P.modified_mass) - one(rows, "PEPC", P.peptide_mass) - 57.02146374) < 1e-9
    assert one(rows, "PEPX", P.peptide_mass) is None and one(rows, "", P.peptide_mass) is None and one(rows, None, P.peptide_mass) is None
    assert one(rows, "P(UniMod:999)", P.modified_mass) is None
    assert abs(rows("m double, z int", [(1000.0, 2)]).select(P.mz(F.col("m"), F.col("z"), True).alias("v")).first().v - 501.00727646688) < 1e-9


def test_glycans(rows):
    tree = "(N(N(H(H)(H))))"
    assert one(rows, tree, P.glycan_composition) == {"H": 3, "N": 2} and one(rows, tree, P.composition_text) == "H3N2"
    assert abs(one(rows, tree, P.glycan_mass) - (3 * 162.0528234 + 2 * 203.0793725 + 18.0105646863)) < 1e-6
    assert one(rows, "(N(N", P.glycan_mass) is None


def test_names_and_fragments(rows):
    text = "AC(UniMod:4)M(UniMod:35)K"
    assert one(rows, text, P.codename) == "AC(Carbamidomethyl)M(Oxidation)K" and one(rows, text, lambda c: P.to_unimod(P.codename(c))) == text
    ions = one(rows, "PEK", P.fragments)
    assert [(i.type, i.ordinal) for i in ions] == [("b", 1), ("b", 2), ("y", 1), ("y", 2)]
    assert abs(ions[0].mz - (97.05276385 + 1.00727646688)) < 1e-6 and abs(ions[2].mz - (128.09496302 + 18.0105646863 + 1.00727646688)) < 1e-6
    assert one(rows, "K", P.fragments) == []


def test_ion_series(rows):
    h, c, n, o = (P.ELEMENTS[e] for e in "HCNO")
    ions = {(i.type, i.ordinal, i.loss, i.charge): i.mz for i in one(rows, "AC(UniMod:4)K", lambda s: P.ion_series(s, tuple(P.ION_ATOMS), (1, 2), ("", "H2O", "NH3")))}
    assert len(ions) == 6 * 2 * 3 * 2
    b2, y1 = 71.03711379 + 103.00918448 + 57.02146374, 128.09496302
    assert abs(ions["b", 2, "", 1] - (b2 + P.PROTON)) < 1e-9 and abs(ions["a", 2, "", 1] - (b2 - c - o + P.PROTON)) < 1e-9 and abs(ions["c", 2, "", 2] - (b2 + n + 3 * h + 2 * P.PROTON) / 2) < 1e-9
    assert abs(ions["y", 1, "", 1] - (y1 + 2 * h + o + P.PROTON)) < 1e-9 and abs(ions["x", 1, "H2O", 1] - (y1 + c + 2 * o - 2 * h - o + P.PROTON)) < 1e-9 and abs(ions["z", 1, "", 1] - (y1 - h - n + o + P.PROTON)) < 1e-9
    start = one(rows, ".(UniMod:1)AK", P.residue_masses)
    assert abs(start[0] - 71.03711379 - 42.01056469) < 1e-9 and len(start) == 2
    assert one(rows, "AXK", lambda s: P.ion_series(s, ("b",)))[1].mz is None and one(rows, "K", P.ion_series) == [] and one(rows, None, P.ion_series) is None
    assert one(rows, "AC(Mine)K", lambda s: P.residue_masses(s, {"(Mine)": 1.0}))[1] == 104.00918448


def test_oxonium_ions(rows):
    ions = {(i.kind, i.loss): i.mz for i in one(rows, "(N(H))", P.oxonium_ions)}
    assert set(ions) == {("H", ""), ("H", "H2O"), ("N", ""), ("N", "H2O")} and abs(ions["N", ""] - 204.08664897) < 1e-5
