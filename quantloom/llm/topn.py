"""The best n items of every group, however large some groups are.

Every partition's local n-th best score of a group is a lower bound of the group's n-th
best. The largest bounds of the heaviest groups are sent to all rows, which drops nearly all
rows of these groups before anything is shuffled by group; the survivors are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups for which a bound is sent out: any group with more than a 4096th of the rows is among them.
HEAVY_GROUPS = 4096


def _local_bounds(n: int, heavy: int, n_groups: int):
    """Arrow batches of (groups.., score) to one batch of (groups.., bound, rows) of the partition's largest groups."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [f"g{i}" for i in range(n_groups)]
        best = counts = None

        def fold(pending: list) -> None:
            nonlocal best, counts
            new = pa.Table.from_batches(pending)
            sizes = new.group_by(names).aggregate([([], "count_all")]).rename_columns([*names, "rows"])
            counts = sizes if counts is None else pa.concat_tables([counts, sizes]).group_by(names).aggregate([("rows", "sum")]).rename_columns([*names, "rows"])
            both = new if best is None else pa.concat_tables([best, new])
            both = both.take(pc.sort_indices(both, sort_keys=[*[(g, "ascending") for g in names], ("score", "descending")])).combine_chunks()
            first = np.zeros(len(both), bool)
            first[:1] = True
            for g in names:
                column = both.column(g).combine_chunks()
                a, b = column.slice(1), column.slice(0, len(column) - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                first[1:] |= ~same.to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(first, np.arange(len(both)), 0))
            rank = np.arange(len(both)) - start
            best = both.append_column("rank", pa.array(rank, pa.int64())).filter(pa.array(rank < n)).select([*names, "score", "rank"])
            last.clear()
            last.append(best)
            best = best.select([*names, "score"])

        last: list = []
        pending, held = [], 0
        for batch in batches:
            pending.append(batch)
            held += batch.num_rows
            if held >= 200_000:
                fold(pending)
                pending, held = [], 0
        if pending:
            fold(pending)
        if best is None:
            return
        nth = last[0].filter(pc.equal(last[0].column("rank"), n - 1))
        large = counts.filter(pc.greater(counts.column("rows"), 4 * n)).sort_by([("rows", "descending")]).slice(0, heavy)
        # a join on nullable keys: by text of the key, which is only a label here
        label = lambda t: [tuple(r) for r in zip(*[t.column(g).to_pylist() for g in names])]
        bound = dict(zip(label(nth), nth.column("score").to_pylist()))
        found = pa.array([bound.get(k) for k in label(large)], pa.float64())
        out = large.select(names).append_column("bound", found).append_column("rows", large.column("rows").cast(pa.int64()))
        yield from out.filter(pc.is_valid(found)).to_batches()

    return run


def top_n(rows: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str], n: int, heavy: int = HEAVY_GROUPS, pos: str = "pos") -> DataFrame:
    """``rows`` cut to the ``n`` first of each group by ``score`` descending, then ``ties`` ascending, with ``pos`` from 1.

    Null and NaN scores don't count. Null is a group of its own in every group column and comes first
    among ties. Rows that are equal in score and all ties are kept in an arbitrary but
    complete order, so ``ties`` should end in something unique. Groups with fewer rows come
    out whole; an empty table gives an empty one. Other columns are carried along; ``pos`` must not be one of them.
    """
    named = {c.lower() for c in rows.columns}
    if pos.lower() in named:
        raise ValueError(f"{pos} is a column already")
    valid = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    keys = valid.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.col(score).cast("double").alias("score"))
    kinds = dict(keys.dtypes)
    schema = ", ".join([*(f"g{i} {kinds[f'g{i}']}" for i in range(len(groups))), "bound double", "rows long"])
    marks = [f"__g{i}" for i in range(len(groups))]
    bounds = (
        keys.mapInArrow(_local_bounds(n, heavy, len(groups)), schema)
        .toDF(*marks, "bound", "rows")
        .groupBy(*marks)
        .agg(F.max("bound").alias("__bound"), F.sum("rows").alias("__rows"))
        .orderBy(F.desc("__rows"), *marks)
        .limit(heavy)  # only which bounds are sent; rows without bound are all ranked
        .drop("__rows")
    )
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(m)) for g, m in zip(groups, marks)])
    alive = valid.join(F.broadcast(bounds), same, "left").where("__bound IS NULL OR CAST(`%s` AS double) >= __bound" % score).drop("__bound", *marks)
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc(), *[F.col(t).asc_nulls_first() for t in ties])
    return alive.withColumn(pos, F.row_number().over(order)).where(F.col(pos) <= n)


def best_scored(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Distinct features of a precursor with their highest score: ``run_id, precursor_id, feature_id, score``."""
    known = features.where("id IS NOT NULL AND precursor_id IS NOT NULL").select("id", "run_id", "precursor_id").distinct()
    best = scores.where("feature_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").groupBy("feature_id").agg(F.max("score").alias("score"))
    return known.join(best, F.col("id") == F.col("feature_id")).select("run_id", "precursor_id", "feature_id", "score")
