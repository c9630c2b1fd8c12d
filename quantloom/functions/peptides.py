"""Peptide and glycan strings: modification names, compositions, masses, m/z.

Masses are sums over the letters of a string against a literal map, so they stay in generated code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modification codes and names.
UNIMOD = {"(UniMod:1)": "(Acetyl)", "(UniMod:4)": "(Carbamidomethyl)", "(UniMod:21)": "(Phospho)", "(UniMod:35)": "(Oxidation)"}
#: Monoisotopic masses of amino acid residues.
RESIDUES = {
    "G": 57.02146372, "A": 71.03711379, "S": 87.03202841, "P": 97.05276385, "V": 99.06841391, "T": 101.04767847, "C": 103.00918448, "L": 113.08406398,
    "I": 113.08406398, "N": 114.04292744, "D": 115.02694303, "Q": 128.05857751, "K": 128.09496302, "E": 129.04259309, "M": 131.04048461, "H": 137.05891186,
    "F": 147.06841391, "R": 156.10111103, "Y": 163.06332853, "W": 186.07931295,
}
#: Mass shifts of modifications, monosaccharide masses, and elements.
MODIFICATIONS = {"(UniMod:1)": 42.01056469, "(UniMod:4)": 57.02146374, "(UniMod:21)": 79.96633052, "(UniMod:35)": 15.99491462}
MONOSACCHARIDES = {"H": 162.0528234, "N": 203.0793725, "A": 291.0954165, "G": 307.0903311, "F": 146.0579088}
HYDROGEN, PROTON, WATER = 1.00782503207, 1.00727646688, 18.0105646863


def codename(sequence: Column) -> Column:
    """The sequence with modification names instead of codes."""
    for code, name in UNIMOD.items():
        sequence = F.replace(sequence, F.lit(code), F.lit(name))
    return sequence


def to_unimod(sequence: Column) -> Column:
    for code, name in UNIMOD.items():
        sequence = F.replace(sequence, F.lit(name), F.lit(code))
    return sequence


def _sum_over(letters: Column, masses: Mapping[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in masses.items() for x in pair])
    return F.aggregate(letters, F.lit(0.0), lambda total, x: total + F.try_element_at(table, x))


def peptide_mass(sequence: Column) -> Column:
    """Monoisotopic mass of an unmodified sequence; null with an unknown letter, null or empty text."""
    return F.when(F.length(sequence) > 0, _sum_over(F.split(sequence, ""), RESIDUES) + WATER)


def modified_mass(sequence: Column) -> Column:
    """Mass of a sequence with modification codes in brackets; null with an unknown code or letter."""
    codes = F.regexp_extract_all(sequence, F.lit(r"(\([^)]*\))"), F.lit(1))
    bare = F.regexp_replace(sequence, r"\([^)]*\)", "")
    return peptide_mass(bare) + _sum_over(codes, MODIFICATIONS)


def mz(mass: Column, charge: Column, by_proton: bool = False) -> Column:
    """Mass to charge; by default each charge adds a hydrogen atom, optionally a proton."""
    return F.try_divide(mass + charge * (PROTON if by_proton else HYDROGEN), charge.cast("double"))


def glycan_composition(struct: Column) -> Column:
    """Counts of monosaccharides in a parenthesised tree such as ``(N(N(H(H)(H))))``, as a map."""
    letters = F.regexp_extract_all(struct, F.lit(r"([A-Z])"), F.lit(1))
    kinds = F.array_sort(F.array_distinct(letters))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(letters, lambda x: x == k))))


def composition_text(struct: Column) -> Column:
    """The composition as text, ``H2N2``; letters in alphabetical order."""
    return F.array_join(F.transform(F.map_entries(glycan_composition(struct)), lambda e: F.concat(e["key"], e["value"].cast("string"))), "")


def glycan_mass(struct: Column) -> Column:
    """Mass of a free glycan; null with an unknown letter or unbalanced brackets."""
    letters = F.regexp_extract_all(struct, F.lit(r"([A-Z])"), F.lit(1))
    balanced = F.length(F.replace(struct, F.lit("("), F.lit(""))) == F.length(F.replace(struct, F.lit(")"), F.lit("")))
    return F.when(balanced & (F.size(letters) > 0), _sum_over(letters, MONOSACCHARIDES) + WATER)


def fragments(sequence: Column, charge: int = 1) -> Column:
    """b and y ions of an unmodified sequence as ``array<struct<type, ordinal, mz>>``."""
    n = F.length(sequence)
    ion = lambda kind, i, part, extra: F.struct(F.lit(kind).alias("type"), i.alias("ordinal"), ((_sum_over(F.split(part, ""), RESIDUES) + extra + charge * PROTON) / charge).alias("mz"))
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    b = F.transform(steps, lambda i: ion("b", i, F.substr(sequence, F.lit(1), i), 0.0))
    y = F.transform(steps, lambda i: ion("y", i, F.substr(sequence, n - i + 1, i), WATER))
    return F.concat(b, y)


#: Monoisotopic masses of elements, the atoms by which a fragment differs from the sum of its residues, and neutral losses.
ELEMENTS = {"H": HYDROGEN, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956}
ION_ATOMS = {"a": {"C": -1, "O": -1}, "b": {}, "c": {"N": 1, "H": 3}, "x": {"C": 1, "O": 2}, "y": {"H": 2, "O": 1}, "z": {"H": -1, "N": -1, "O": 1}}
FROM_START = ("a", "b", "c")
LOSSES = {"": {}, "NH3": {"N": 1, "H": 3}, "H2O": {"H": 2, "O": 1}}


def atoms_mass(atoms: Mapping[str, int]) -> float:
    return sum(ELEMENTS[e] * n for e, n in atoms.items())


def residue_masses(sequence: Column, modifications: Mapping[str, float] = MODIFICATIONS) -> Column:
    """The masses of the residues of a sequence with modification codes in brackets behind them; codes before the first letter belong to it.

    ``modifications`` maps codes (with brackets) to masses, as few or as many as a project uses. A residue with an unknown letter or code is null.
    """
    first = F.regexp_extract(sequence, r"^[.]?((?:\([^)]*\))*)", 1)
    tokens = F.regexp_extract_all(F.regexp_replace(sequence, r"^[.]?(?:\([^)]*\))*", ""), F.lit(r"([A-Z](?:\([^)]*\))*)"), F.lit(1))
    codes = lambda text: F.regexp_extract_all(text, F.lit(r"(\([^)]*\))"), F.lit(1))
    mass = lambda t: _sum_over(F.array(F.substring(t, 1, 1)), RESIDUES) + _sum_over(codes(t), modifications)
    return F.transform(tokens, lambda t, i: mass(t) + F.when(i == 0, _sum_over(codes(first), modifications)).otherwise(0.0))


def ion_series(sequence: Column, kinds: tuple[str, ...] = ("b", "y"), charges: tuple[int, ...] = (1,), losses: tuple[str, ...] = ("",), modifications: Mapping[str, float] = MODIFICATIONS) -> Column:
    """Fragments of a (modified) sequence as ``array<struct<type, ordinal, loss, charge, mz>>``; fragments with an unknown residue have null ``mz``."""
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)

    def series(masses: Column, kind: str, loss: str, z: int) -> Column:
        n = F.size(masses)
        steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        extra = atoms_mass(ION_ATOMS[kind]) - atoms_mass(LOSSES[loss]) + z * PROTON
        part = lambda i: F.slice(masses, F.lit(1) if kind in FROM_START else n - i + 1, i)
        return F.transform(steps, lambda i: F.struct(F.lit(kind).alias("type"), i.alias("ordinal"), F.lit(loss).alias("loss"), F.lit(z).alias("charge"), ((total(part(i)) + extra) / z).alias("mz")))

    # The masses are bound to a variable, so that they are made once and not for each fragment.
    every = lambda masses: F.concat(*[series(masses, kind, loss, z) for kind in kinds for loss in losses for z in charges])
    return F.when(sequence.isNotNull(), F.get(F.transform(F.array(residue_masses(sequence, modifications)), every), F.lit(0)))


def oxonium_ions(struct: Column, losses: tuple[str, ...] = ("", "H2O")) -> Column:
    """Singly charged ions of the kinds of monosaccharides in a glycan, as ``array<struct<kind, loss, mz>>``."""
    kinds = F.array_sort(F.array_distinct(F.regexp_extract_all(struct, F.lit(r"([A-Z])"), F.lit(1))))

    def ions(loss: str) -> Column:
        return F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.lit(loss).alias("loss"), (_sum_over(F.array(k), MONOSACCHARIDES) - atoms_mass(LOSSES[loss]) + PROTON).alias("mz")))

    return F.concat(*[ions(loss) for loss in losses])
