"""Mix sources to target shares of the total size, repeating small sources up to a cap.

Sizes are summed by source and bucket of a document hash; the budget's threshold falls into one
bucket, which alone is looked at again in finer buckets, until the threshold is exact. Documents are then
chosen by comparing their hash with the threshold: nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.runtime import written

#: Bits of the hash that each histogram level resolves, and the levels: 4 * 12 = 48 bits in all.
BITS, LEVELS = 12, 4
SPACE = 1 << (BITS * LEVELS)


def place(key: Column, seed: int) -> Column:
    """A document's place in [0, 2**48)."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 64 - BITS * LEVELS)


def _plan(targets: list[dict], sizes: dict[str, int], total: int) -> dict[str, dict]:
    """Whole passes over each source and the rest of its budget in tokens."""
    plan = {}
    for t in targets:
        size, budget = sizes.get(t["source"], 0), int(t["target_share"] * total)
        cap = max(0, int(t["max_repeats"] or 0))
        passes = min(cap, budget // size) if size else 0
        plan[t["source"]] = {"budget": budget, "passes": passes, "rest": budget - passes * size if size and passes < cap else 0}
    return plan


def thresholds(sized: DataFrame, plan: dict[str, dict]) -> dict[str, int]:
    """For each source the place below which documents are used once more than the whole passes."""
    found = {s: {"low": 0, "rest": p["rest"]} for s, p in plan.items() if p["rest"] > 0}
    for level in range(LEVELS):
        if not found:
            break
        width = 1 << (BITS * (LEVELS - level - 1))
        spark = sized.sparkSession
        now = spark.createDataFrame([(s, v["low"]) for s, v in found.items()], "_source string, _low long")
        inside = sized.join(F.broadcast(now), (F.col("source") == F.col("_source")) & (F.col("_place") >= F.col("_low")) & (F.col("_place") < F.col("_low") + width * (1 << BITS)))
        bucket = F.expr(f"(_place - _low) div {width}").cast("int")
        histogram: dict[str, dict[int, int]] = {}
        for r in inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("n")).collect():  # at most 4096 rows a source
            histogram.setdefault(r["source"], {})[r["bucket"]] = r["n"]
        for s, v in found.items():
            own = histogram.get(s, {})
            for b in sorted(own):
                if own[b] > v["rest"]:
                    v["low"] += b * width
                    break
                v["rest"] -= own[b]
            else:  # the whole range fits
                v["low"] += width * (1 << BITS)
                v["rest"] = 0
    return {s: v["low"] for s, v in found.items()}


def mix(documents: DataFrame, targets: DataFrame, size: Column, id_col: str = "doc_id", total: int | None = None, seed: int = 17, max_sources: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, tokens, uses`` of every document that is used, and the shares reached.

    Every source of ``targets`` gets ``target_share`` of ``total`` tokens (default: all tokens of the
    documents of these sources); a document is used at most ``max_repeats`` times. A source that is too small even so gives all it has,
    ``max_repeats`` times. The last document that would pass a budget is left out, so a source may stay below its
    budget by less than one document. Documents of other or null sources are not used; null and empty texts
    have no tokens and count for nothing (they may be used). A null ``max_repeats`` or ``target_share`` gives nothing.
    The second frame has ``source, target_share, available_tokens, used_tokens, actual_share, documents, max_uses``, one row per
    target, also for those without documents. ``targets`` is a setting of at most ``max_sources`` rows.
    """
    goals = [r.asDict() for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").limit(max_sources + 1).collect()]
    if len(goals) > max_sources:
        raise ValueError(f"more than {max_sources} targets")
    goals = [g | {"target_share": g["target_share"] or 0.0} for g in goals]
    names = [g["source"] for g in goals]
    chosen = documents.where(F.col("source").isin(names)) if names else documents.where("false")
    sized = written(chosen.select(F.col(id_col).alias("doc_id"), "source", size.cast("long").alias("tokens"), place(F.col(id_col), seed).alias("_place")))
    sizes = {r["source"]: r["n"] or 0 for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    plan = _plan(goals, sizes, sum(sizes.values()) if total is None else total)
    limits = thresholds(sized, plan)
    spark = documents.sparkSession
    rule = spark.createDataFrame([(s, p["passes"], limits.get(s, 0)) for s, p in plan.items()] or [("", 0, 0)], "_source string, _passes int, _limit long")
    uses = F.col("_passes") + (F.col("_place") < F.col("_limit")).cast("int")
    used = sized.join(F.broadcast(rule), F.col("source") == F.col("_source")).select("doc_id", "source", "tokens", uses.alias("uses")).where("uses > 0")
    sums = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("max_uses"))
    goal = spark.createDataFrame([(g["source"], float(g["target_share"]), sizes.get(g["source"], 0)) for g in goals] or [("", 0.0, 0)], "source string, target_share double, available_tokens long")
    told = goal.where("source <> ''").join(F.broadcast(sums), "source", "left").na.fill(0, ["used_tokens", "documents", "max_uses"])
    all_used = told.agg(F.sum("used_tokens").alias("_all"))
    report = told.join(F.broadcast(all_used)).select("*", F.coalesce(F.try_divide("used_tokens", "_all"), F.lit(0.0)).alias("actual_share")).drop("_all")
    return used, report
