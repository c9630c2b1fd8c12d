"""Operators on whole tables: merging, splitting by run, back-propagation, cascaded subsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_runs(parts: Sequence[DataFrame], same_run: int | None = None, run: str = "run_id") -> DataFrame:
    """All rows of all parts by column name (missing columns are null); with ``same_run`` all get that run."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged if same_run is None else merged.withColumn(run, F.lit(same_run))


def in_one_run(df: DataFrame, run_id: int, table: str) -> DataFrame:
    """The rows of a merged table in one run: every run it names becomes ``run_id`` (null, the global context, stays), and table ``run`` has that row only."""
    if table == "run":
        kinds = dict(df.dtypes)
        others = [F.min(c).alias(c) for c in df.columns if c.lower() != "id"]
        return df.groupBy(F.lit(run_id).cast(kinds[next(c for c in df.columns if c.lower() == "id")]).alias("id")).agg(*others) if others else df.limit(1).select(F.lit(run_id).cast("long").alias("id"))
    name = next((c for c in df.columns if c.lower() == "run_id"), None)
    return df if name is None else df.withColumn(name, F.when(F.col(name).isNotNull(), F.lit(run_id).cast(dict(df.dtypes)[name])))


def run_part(df: DataFrame, run: str, which: DataFrame | int) -> DataFrame:
    """The rows of one run together with those of no run (global scores), as a per-run file holds them."""
    if isinstance(which, int):
        return df.where((F.col(run) == which) | F.col(run).isNull())
    only = which.toDF("_run")  # one row
    return df.join(F.broadcast(only), (F.col(run) == F.col("_run")) | F.col(run).isNull(), "left_semi")


def subset(tables: Mapping[str, DataFrame], features: DataFrame, keep: Mapping[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """The tables cut to the given features: dependants by feature, then precursors, mappings and transitions that are still referred to."""
    ids = features.select(F.col("id").alias("feature_id")).distinct()
    out = dict(tables) | {"feature": features}
    for name in ("feature_ms1", "feature_ms2", "feature_transition", "score_ms1", "score_ms2", "score_transition"):
        if name in tables:
            out[name] = tables[name].join(ids, "feature_id", "left_semi")
    used = features.select("precursor_id").distinct()
    if "precursor" in tables:
        out["precursor"] = tables["precursor"].join(used, F.col("id") == F.col("precursor_id"), "left_semi")
    for name in ("precursor_peptide_mapping", "transition_precursor_mapping"):
        if name in tables:
            out[name] = tables[name].join(used, "precursor_id", "left_semi")
    if "transition" in tables and "feature_transition" in out:
        out["transition"] = tables["transition"].join(out["feature_transition"].select("transition_id").distinct(), F.col("id") == F.col("transition_id"), "left_semi")
    return out


def reduced(features: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and scores of the first rank only."""
    first = scores.where("rank = 1")
    return features.join(first.select(F.col("feature_id").alias("id")).distinct(), "id", "left_semi"), first


def backpropagate(own: DataFrame, merged_scores: DataFrame, run: str = "run_id") -> DataFrame:
    """Context scores of a merged experiment for the runs of one file, and those of no run."""
    runs = own.select(run).distinct()
    return merged_scores.where(F.col(run).isNull()).unionByName(merged_scores.join(runs, run, "left_semi").select(*merged_scores.columns))
