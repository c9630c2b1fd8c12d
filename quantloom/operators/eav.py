"""Attribute-value rows into wide tables.

The winning row of each key and attribute is found in one scan and one shuffle of rows that were reduced
before it. The winners are partitioned by attribute into narrow, typed tables, co-partitioned by
key, and combined by outer joins in a balanced tree, so a column passes through log2(attributes)
joins instead of one per attribute and none of the joins shuffles again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attribute:
    """One attribute: the value that selects its rows and the prefix of its columns."""

    value: str
    prefix: str


def winners(rows: DataFrame, keys: Sequence[str], selector: str, attributes: Sequence[Attribute], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``keys, _attr, _cell``: of the rows of each key and attribute (by its place in ``attributes``) the one that is last by ``order``.

    Winners are found by a maximum, which is combined before the shuffle; a key with very
    many rows costs no task more than its own share.
    """
    place = F.lit(None).cast("int")
    for i, a in reversed(list(enumerate(attributes))):
        place = F.when(F.col(selector) == a.value, i).otherwise(place)
    mine = rows.select(*[F.col(k) for k in keys], place.alias("_which"), F.struct(*[F.col(o) for o in order]).alias("_order"), F.struct(*[F.col(v) for v in values]).alias("_values"))
    for k in keys:  # said here, so that the optimizer has nothing to add on some branches only, and all share one shuffle
        mine = mine.where(F.col(k).isNotNull())
    return mine.where("_which IS NOT NULL").groupBy(*keys, F.col("_which").alias("_attr")).agg(F.max_by("_values", "_order").alias("_cell"))


def narrow(won: DataFrame, keys: Sequence[str], which: int, columns: Sequence[Column]) -> DataFrame:
    """The winners of one attribute. They are picked from a generator, which no filter passes, so that all narrow tables read the same shuffle."""
    picked = won.select(*keys, F.inline_outer(F.array(F.struct("_attr", "_cell")))).where(F.col("_attr") == which)
    return picked.select(*keys, *columns)


def to_wide(rows: DataFrame, keys: Sequence[str], selector: str, attributes: Sequence[Attribute], values: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """One row per key with the columns ``<prefix>_<value>`` of every attribute.

    Rows with a null in ``keys`` fill nothing (a null entity is no entity), nor do rows whose
    selector is null or names no attribute; a key with none of the attributes
    has no row. Of several rows for a cell the last by ``order`` wins, so ``order`` should end in
    something unique; values that don't fit their type become null. An empty table gives an
    empty table with all columns. Other columns of ``rows`` are not read.
    """
    won = winners(rows, keys, selector, attributes, list(values), order).repartition(*[F.col(k) for k in keys])
    # All keys, partitioned as the narrow tables are. Left joins keep a partitioning, full ones don't, so each table is first joined to these.
    spine = won.groupBy(*keys).agg(F.bit_or("_attr").alias("_a"), F.count("_cell").alias("_c")).where("_a >= 0 AND _c > 0").select(*keys)
    typed = lambda a: [F.col(f"_cell.{v}").try_cast(t).alias(f"{a.prefix}_{v}") for v, t in values.items()]
    tables = [spine.join(narrow(won, keys, i, typed(a)), list(keys), "left") for i, a in enumerate(attributes)]
    while len(tables) > 1:  # balanced: neighbours in pairs, level by level
        paired = [tables[i].join(tables[i + 1], list(keys), "left") for i in range(0, len(tables) - 1, 2)]
        tables = paired + tables[len(paired) * 2 :]
    return tables[0]


def filled_cells(wide: DataFrame, keys: Sequence[str], attributes: Sequence[Attribute], value: str, name: str = "attribute") -> DataFrame:
    """The wide table's filled cells back as rows: keys, attribute, value."""
    cells = F.array(*[F.struct(F.lit(a.value).alias(name), F.col(f"{a.prefix}_{value}").alias(value)) for a in attributes])
    return wide.select(*keys, F.inline(F.filter(cells, lambda c: c[value].isNotNull())))


#: The contexts of error control, as attributes of the wide tables.
GLOBAL = Attribute("global", "global")
RUN_SPECIFIC = Attribute("run-specific", "run_specific")
EXPERIMENT_WIDE = Attribute("experiment-wide", "experiment_wide")


def context_letters(raw: Column) -> Column:
    """What is left of a spelling: its letters in lower case, without a leading ``context``."""
    return F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z]", ""), "^context", "")


def read_context(letters: Column) -> Column:
    """The context that ``context_letters`` stand for, or null.

    So case, blanks, dashes and other signs between the letters don't matter, nor does a leading
    ``context=``. Words may be cut short (``glob``, ``run-spec``, ``exp-wide``) and hold up to two
    slips of the pen (``gloabl``).
    """
    spelt = {GLOBAL: "^glob(a|al)?$", RUN_SPECIFIC: "^runspec[a-z]{0,5}$", EXPERIMENT_WIDE: "^exp[a-z]{0,7}wide$"}
    found = F.lit(None).cast("string")
    for a, name in ((EXPERIMENT_WIDE, "experimentwide"), (RUN_SPECIFIC, "runspecific"), (GLOBAL, "global")):
        found = F.when(F.levenshtein(letters, F.lit(name)) <= 2, a.value).otherwise(found)
    for a, pattern in spelt.items():  # tried before the slips, which cost more
        found = F.when(letters.rlike(pattern), a.value).otherwise(found)
    return found


def context_rows(scores: DataFrame, entity: str) -> DataFrame:
    """Score rows that fill a cell, with ``entity_id``, ``run_id`` (0 for global) and a readable ``context``.

    Rows with null entity, null or NaN score, an unreadable context or a run-bound context
    without run fill nothing.
    """
    known = scores.where(F.col(entity).isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    # Spellings pass through generators, so that no filter or projection above copies the reading and evaluates it again.
    lettered = known.select("*", F.explode_outer(F.array(context_letters(F.col("context")))).alias("_letters"))
    return (
        lettered.select("*", F.explode_outer(F.array(read_context(F.col("_letters")))).alias("_context"))
        .where(F.col("_context").isNotNull() & ((F.col("_context") == GLOBAL.value) | F.col("run_id").isNotNull()))
        .select(
            F.col(entity).alias("entity_id"),
            F.when(F.col("_context") == GLOBAL.value, F.lit(0).cast("long")).otherwise(F.col("run_id")).alias("run_id"),
            F.col("_context").alias("context"),
            "score", "qvalue", "row_id", "loaded_at",
        )
    )


CONTEXTS = (GLOBAL, RUN_SPECIFIC, EXPERIMENT_WIDE)
CELL_TYPES = {"score": "double", "qvalue": "double", "row_id": "long"}


def wide_context_scores(scores: DataFrame, entity: str) -> DataFrame:
    """One row per entity and run (run 0: global) with score, q-value and source row of each context."""
    return to_wide(context_rows(scores, entity), ["entity_id", "run_id"], "context", CONTEXTS, CELL_TYPES, ["loaded_at", "row_id"])
