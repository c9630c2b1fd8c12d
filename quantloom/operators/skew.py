"""Joins that stay even when one key holds a third of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.runtime import MAX_BROADCAST_ROWS


def frequent_keys(df: DataFrame, key: str, support: float = 0.01) -> list:
    """Every value of ``key`` on more than ``support`` of the rows, and maybe a few others.

    One pass with a summary of at most 1/support counters per task (Karp, Schenker and
    Papadimitriou's counting), so neither the data nor the number of keys matters.
    """
    rows = df.select(F.col(key).alias("k")).where("k IS NOT NULL").stat.freqItems(["k"], support).collect()
    return sorted(k for k in (rows[0][0] or []) if k is not None) if rows else []


def join_by_key(
    big: DataFrame,
    other: DataFrame,
    key: str,
    other_key: str,
    how: str,
    condition: Callable[[], Column] | None = None,
    hot: list | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``big`` joined to ``other`` by key (``how``: inner, left, left_anti or left_semi).

    Rows of hot keys meet the few rows of ``other`` for those keys in a broadcast join, so
    they are never shuffled; all others meet in a shuffled join. The broadcast is made only
    after counting; should even the hot keys' rows of ``other`` be many, all rows take the
    shuffled join, whose skewed partitions adaptive execution splits. Column names of both
    sides must differ.
    """
    on = F.col(key) == F.col(other_key)
    if condition is not None:
        on = on & condition()
    if hot:
        few = other.where(F.col(other_key).isin(hot))
        if few.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
            is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
            rest = big.where(~is_hot).join(other, on, how)
            return rest.unionByName(big.where(is_hot).join(F.broadcast(few), on, how))
    return big.join(other, on, how)
