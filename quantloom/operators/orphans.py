"""References to records that do not exist when the referring row arrives.

A blocked Bloom filter of the parent keys, built as an aggregate and broadcast at a size that is
counted and bounded, proves most dangling references; the others are verified against the
parents' periods by an exact join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.skew import frequent_keys, join_by_key
from quantloom.runtime import MAX_BROADCAST_ROWS

#: Words of 64 bits in a block.
WORDS = 8
#: Bits of the filter a key gets where there is room.
BITS_PER_KEY = 10
#: Blocks at most: 2**20 rows of nine numbers, about 100 MB broadcast; ten bits a key up to 53 million keys, one bit up to 536 million.
MAX_BLOCKS = 1 << 20


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``child.ref`` should name ``parent.parent_id``."""

    child: str
    child_key: str
    ref: str
    parent: str
    parent_id: str = "id"


def block_count(keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    """Blocks of 512 bits for ``BITS_PER_KEY`` bits a key, within the bound."""
    return max(8, min(max_blocks, -(-keys * BITS_PER_KEY // (64 * WORDS))))


def bits_set(keys: int, blocks: int) -> int:
    """How many bits a key sets: 8, 4, 2 or 1, whichever is nearest to the best number for the bits there are a key.

    So the filter still proves something where there is less than the wished room: about 39 % false positives at two bits a key.
    """
    best = 0.69 * blocks * 64 * WORDS / max(1, keys)
    return 8 if best > 5.7 else 4 if best > 2.8 else 2 if best > 1.4 else 1


def _place(key: Column, blocks: int, bits: int) -> tuple[Column, list[Column]]:
    """A key's block and its mask for each word: bit ``i`` of the key lies in one of the words ``i, i + bits, ..``."""
    second = F.xxhash64(key, F.lit(1))
    spread = WORDS // bits
    masks = []
    for j in range(WORDS):
        i = j % bits
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        chosen = F.pmod(F.shiftrightunsigned(second, 48 + 3 * i), F.lit(spread)) == j // bits  # only where a bit has several words: i < 5
        masks.append(bit if spread == 1 else F.when(chosen, bit).otherwise(F.lit(0).cast("long")))
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), masks


def bloom_blocks(keys: DataFrame, key: str, blocks: int, bits: int = WORDS) -> DataFrame:
    """The filter as a table ``_block, _w0.._w7`` of at most ``blocks`` rows; partial aggregation makes the shuffle as small."""
    block, masks = _place(F.col(key), blocks, bits)
    marked = keys.where(F.col(key).isNotNull()).select(block.alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(masks)])
    return marked.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])


def _probe(child: DataFrame, key: str, filter_: DataFrame, blocks: int, bits: int = WORDS) -> DataFrame:
    """``child`` with ``_may``: false proves that no parent has the key."""
    block, masks = _place(F.col(key), blocks, bits)
    hit = reduce(Column.__and__, [F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(masks)])
    joined = child.withColumn("_at", block).join(F.broadcast(filter_), F.col("_at") == F.col("_block"), "left")
    return joined.select(*child.columns, F.coalesce(hit, F.lit(False)).alias("_may"))


def find_orphans(
    child: DataFrame,
    parent: DataFrame,
    reference: Reference,
    loaded_at: str = "loaded_at",
    deleted_at: str = "deleted_at",
    max_blocks: int = MAX_BLOCKS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Distinct rows ``child_table, child_key, ref_id, period, status`` of references to nothing.

    A parent stands from ``loaded_at`` (inclusive) to ``deleted_at`` (exclusive, null = for
    ever; a parent without ``loaded_at`` has always stood). ``status``: ``missing`` if no
    parent row has the id, ``late`` if all of them are loaded after the child, else
    ``deleted``. ``period`` is the child's month (yyyy-MM).

    Null references are no references. A child without ``loaded_at`` has no period and is an
    orphan only if no parent has the id. An empty parent table makes every reference
    ``missing``; an empty child table gives no row. Repeated rows count once; parents
    without ``deleted_at`` column are never withdrawn; further columns are ignored.
    """
    kind = dict(parent.dtypes)[loaded_at]
    past, far = F.lit("0001-01-01 00:00:00").cast(kind), F.lit("9999-12-31 00:00:00").cast(kind)
    end = F.col(deleted_at) if deleted_at in parent.columns else F.lit(None).cast(kind)
    periods = (
        parent.where(F.col(reference.parent_id).isNotNull())
        .select(F.col(reference.parent_id).alias("_id"), F.coalesce(F.col(loaded_at), past).alias("_from"), F.coalesce(end, far).alias("_to"))
        .distinct()
    )
    rows = child.where(F.col(reference.ref).isNotNull()).select(
        F.col(reference.child_key).alias("child_key"), F.col(reference.ref).alias("ref_id"), F.col(loaded_at).alias("_loaded")
    )
    parents = parent.count()  # an upper bound of the distinct keys and periods, from the files' footers
    blocks = block_count(parents, max_blocks)
    bits = bits_set(parents, blocks)
    filter_ = bloom_blocks(parent.select(F.col(reference.parent_id).alias("_id")), "_id", blocks, bits)
    probed = _probe(rows, "ref_id", filter_, blocks, bits)
    status = F.when(F.col("_first_id").isNull(), "missing").when(F.col("_first") > F.col("_loaded"), "late").otherwise("deleted").alias("status")
    out = ["child_key", "ref_id", "_loaded"]
    if parents <= max_broadcast_rows:
        # One pass over the child: what the filter lets through meets the few parents' periods, all others go by.
        facts = periods.groupBy(F.col("_id").alias("_first_id")).agg(F.min("_from").alias("_first"), F.collect_list(F.struct("_from", "_to")).alias("_spans"))
        met = probed.withColumn("_key", F.when(F.col("_may"), F.col("ref_id"))).join(F.broadcast(facts), F.col("_key") == F.col("_first_id"), "left")
        stood = F.col("_first_id").isNotNull() & (F.col("_loaded").isNull() | F.exists("_spans", lambda p: (p["_from"] <= F.col("_loaded")) & (F.col("_loaded") < p["_to"])))
        found = met.where(~stood).select(*out, status)
    else:
        missing = probed.where(~F.col("_may")).select(*out, F.lit("missing").alias("status"))
        doubtful = probed.where("_may").drop("_may")
        stands = lambda: F.col("_loaded").isNull() | ((F.col("_from") <= F.col("_loaded")) & (F.col("_loaded") < F.col("_to")))
        by_id = periods.repartition("_id")  # read by both joins; the exchange is made once
        firsts = by_id.groupBy(F.col("_id").alias("_first_id")).agg(F.min("_from").alias("_first"))
        hot = frequent_keys(rows, "ref_id")
        bare = join_by_key(doubtful, by_id, "ref_id", "_id", "left_anti", stands, hot, max_broadcast_rows)
        told = join_by_key(bare, firsts, "ref_id", "_first_id", "left", None, hot, max_broadcast_rows)
        found = missing.unionByName(told.select(*out, status))
    return (
        found.select(F.lit(reference.child).alias("child_table"), "child_key", "ref_id", F.date_format("_loaded", "yyyy-MM").alias("period"), "status")
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, period and status: distinct rows and distinct absent ids."""
    per_ref = orphans.groupBy("child_table", "period", "status", "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return per_ref.groupBy("child_table", "period", "status").agg(F.sum("n").alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_refs"))
