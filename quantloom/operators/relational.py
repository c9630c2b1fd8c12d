"""Relational patterns of feature stores: reads, filters by mapping, recovery of aligned rows, score views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column in its type, or nulls where the table lacks it."""
    found = {c.lower(): c for c in df.columns}.get(name.lower())
    return (F.col(f"`{found}`") if found else F.lit(None)).cast(kind).alias(name)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def with_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    """Columns that begin with ``old`` (in any case) begin with ``new`` instead."""
    return df.toDF(*[new + c[len(old) :] if c.lower().startswith(old.lower()) else c for c in df.columns])


def drop_empty_columns(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Without those candidate columns that hold no value; one aggregate over all of them."""
    counts = df.agg(*[F.count(c).alias(c) for c in candidates]).first()
    return df.drop(*[c for c in candidates if counts[c] == 0])


def first_available(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def unique_partner(mapping: DataFrame, item: str, partner: str) -> DataFrame:
    """``item`` and ``partner`` of items with exactly one distinct non-null partner."""
    counted = mapping.where(F.col(partner).isNotNull() & F.col(item).isNotNull()).groupBy(item)
    return counted.agg(F.count_distinct(partner).alias("_n"), F.min(partner).alias(partner)).where("_n = 1").drop("_n")


def feature_table(features: DataFrame, precursors: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Features of known precursors with charge, decoy flag and group id; ``counts`` adds ``transition_count`` (0 where absent)."""
    known = precursors.select(F.col("id").alias("precursor_id"), F.col("charge").alias("precursor_charge"), "decoy").where("precursor_id IS NOT NULL")
    known = known.groupBy("precursor_id").agg(F.max("precursor_charge").alias("precursor_charge"), F.max("decoy").alias("decoy"))
    rows = features.where("precursor_id IS NOT NULL").select(F.col("id").alias("feature_id"), "run_id", "precursor_id", "exp_rt", "norm_rt", "delta_rt").distinct().join(known, "precursor_id")
    if counts is not None:
        rows = rows.join(counts, "precursor_id", "left").withColumn("transition_count", F.coalesce("transition_count", F.lit(0)))
    return rows.withColumn("group_id", F.concat_ws("_", "run_id", "precursor_id"))


def aligned_recovery(base: DataFrame, aligned: DataFrame, key: str, flag: str = "from_alignment") -> DataFrame:
    """``base`` (flag 0) and those rows of ``aligned`` whose key it lacks (flag 1); columns by name."""
    extra = aligned.join(base.select(key).distinct(), key, "left_anti")
    return base.withColumn(flag, F.lit(0)).unionByName(extra.withColumn(flag, F.lit(1)), allowMissingColumns=True)


def dense_ids(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``df`` with the dense rank (from 1) of its key; distinct keys are ranked by a distributed scan, not all rows in one task."""
    from quantloom.operators.scan import running

    # Struct order: one sortable column of the distinct keys.
    keys = df.select(*columns).distinct().select(F.struct(*columns).alias("_key"), F.lit(1).alias("_one"))
    ranked = running(keys, "_key", {name: ("sum", "_one")})
    ids = ranked.select(*[F.col(f"_key.{c}").alias(f"_{c}") for c in columns], name)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(ids, same).select(*df.columns, name)


def context_columns(scores: DataFrame, entity: str, contexts: Mapping[str, str], values: Sequence[str]) -> DataFrame:
    """Score rows by context as columns ``<value>_<name>``: run-bound contexts by entity and run, joined in full to the global one (run null)."""
    pick = lambda context, v, name: F.min(F.when(F.col("context") == context, F.col(v))).alias(f"{v}_{name}")
    bound = {c: n for c, n in contexts.items() if c != "global"}
    by_run = scores.where(F.col("context").isin(list(bound))).groupBy(entity, "run_id").agg(*[pick(c, v, n) for c, n in bound.items() for v in values])
    if "global" not in contexts:
        return by_run
    overall = scores.where("context = 'global'").groupBy(F.col(entity).alias("_g")).agg(*[pick("global", v, contexts["global"]) for v in values])
    met = by_run.join(overall, F.col(entity) == F.col("_g"), "full_outer")
    return met.withColumn(entity, F.coalesce(entity, "_g")).drop("_g")


def join_runs_or_global(rows: DataFrame, view: DataFrame, entity: str, run: str = "run_id") -> DataFrame:
    """``rows`` left joined to a score view on entity and run, a view row without run matching every run; no row of ``rows`` is lost."""
    names = {c: f"_v_{c}" for c in (entity, run)}
    other = view.withColumnsRenamed(names)
    on = (F.col(entity) == F.col(f"_v_{entity}")) & ((F.col(run) == F.col(f"_v_{run}")) | F.col(f"_v_{run}").isNull())
    return rows.join(other, on, "left").drop(*names.values())


def scores_back(table: DataFrame, scores: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """``table`` with its score columns (``prefix``) replaced by those of ``scores``; refuses scores that would multiply rows."""
    repeated = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeated:
        raise ValueError(f"scores hold a key of {list(keys)} more than once")
    fresh = scores.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in scores.columns if c not in keys])
    return table.drop(*[c for c in table.columns if c.lower().startswith(prefix.lower())]).join(fresh, list(keys), "left")


def collapsed(df: DataFrame, keys: Sequence[str], ids: str, name: str) -> DataFrame:
    """One row per key with the sorted distinct ids; ids of a key must be few (peptides of a feature)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(ids)).alias(name))


def one_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, name: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    nth = name or "_nth"
    ranked = df.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(nth) <= n)
    return ranked if name else ranked.drop(nth)


def propagate(evidence: DataFrame, group: str, item: str, pep: str, threshold: float) -> DataFrame:
    """For each feature of a group and each item: the least ``pep`` among its own rows and confident rows (``pep`` <= threshold) of its group.

    Confident evidence is reduced to one row per group and item before it meets the features, so rows grow with
    features, not with pairs of rows.
    """
    confident = evidence.where(F.col(pep) <= threshold).groupBy(group, item).agg(F.min(pep).alias("_best"))
    members = evidence.select(group, "feature_id").distinct()
    offered = members.join(confident, group).select(group, "feature_id", item, F.col("_best").alias(pep))
    return evidence.select(group, "feature_id", item, pep).unionByName(offered).groupBy(group, "feature_id", item).agg(F.min(pep).alias(pep))


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """All rows of a fixed share of the keys, the same keys in every table (and in every engine: the first 32 bits of an MD5 sum decide)."""
    if share >= 1:
        return df.where(F.col(key).isNotNull())
    limit = f"{int(share * 2**32):08x}"
    return df.where(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8) < limit)
