"""Schemas that drift between the files of a feed: every change, and one table with fixed names and types.

Each file is profiled by an aggregate (which fields most lines carry, their types); the values that
fields of consecutive files share are counted by one more. Consecutive files are then matched by
similarity flooding over the graphs of their schemas, whose nodes are fields, objects, name parts and
types. Names and shared values give the first scores; the scores at the fixpoint decide which fields are
one quantity under two names. Only profiles, whose size is that of a schema, ever meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.runtime import written

#: Texts that mark a missing value.
MISSING = ("", "nan", "na", "n/a", "null", "none", "nil", "-", "--", "?", "inf", "-inf", "missing")
#: A pair of fields is one quantity if its flooded score reaches this part of the score that unchanged fields have with themselves.
MIN_SIMILARITY = 0.5
#: Part of a pair's score that flows in from its neighbours, and how that divides among name parts, types and nesting.
INFLOW, BY_PARTS, BY_TYPE, BY_NESTING = 0.3, 0.5, 0.2, 0.3
#: Weight of shared values beside names where a file exports records of the file before again.
BY_VALUES = 0.7


def _kind(json: Column) -> Column:
    first = F.substring(json, 1, 1)
    plain = F.lower(F.trim(F.regexp_replace(json, '^"|"$', "")))
    return (
        F.when(json.isNull() | (first == "n"), None)
        .when((first >= "-") & (first <= "9"), "number")  # texts begin with a quote, so no other sign lies between
        .when(first == "[", "list")
        .when((first == '"') & plain.isin(*MISSING), None)
        .otherwise("text")
    )


def _comparable(json: Column) -> Column:
    """A value without its dress: brackets of a list of one, quotes, unit, decimal comma, trailing zeros."""
    first = F.substring(json, 1, 1)
    plain_number = (first >= "-") & (first <= "9")
    as_number = lambda n: F.when(F.length(n) > 15, n).otherwise(F.coalesce(n.try_cast("double").cast("string"), n))
    bare = F.regexp_replace(F.regexp_extract(json, r'^\s*\[?\s*"?([^"\],]*(?:,[0-9]+)?)', 1), r"\s+$", "")
    number = F.regexp_replace(F.regexp_extract(bare, r"^([+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?)(?:\s.*)?$", 1), ",", ".")
    return F.when(plain_number, as_number(json)).when(number == "", F.lower(bare)).otherwise(as_number(number))


_LINE = ("feed_id", "file_id", "level", "written_at", "line_no")


def line_fields(raw: DataFrame) -> DataFrame:
    """One row per distinct line and field: name in lower case, kind, comparable value and the value as it stands (``raw``).

    Objects are flattened, whatever their depth: the field ``b`` of an object ``a`` is ``a.b``. A line without fields (null,
    unreadable or empty payload) has one row with a null field; an empty object is a field without value. The result is written.
    """
    level = F.col("level") if "level" in raw.columns else F.lit(None).cast("string").alias("level")
    lines = raw.select("feed_id", "file_id", "written_at", "line_no", "payload", level).distinct()
    entries = lambda v, at: F.try_variant_get(v, at, "map<string,variant>")
    long = lines.select(*_LINE, F.explode_outer(entries(F.try_parse_json("payload"), "$")).alias("field", "_v"))
    json, value, is_object = F.col("_json"), _comparable(F.col("_json")), F.coalesce(F.startswith("_json", F.lit("{")), F.lit(False))

    def told(df: DataFrame) -> DataFrame:
        """Read one level; the text passes through a generator, so that it is made once, and stands in ``raw`` only where it differs from the value."""
        texts = df.select(*_LINE, F.lower("field").alias("field"), F.explode_outer(F.array(F.to_json("_v"))).alias("_json"))
        seen = texts.select("*", F.explode_outer(F.array(F.when(~is_object, value))).alias("value"))
        return written(seen.select(*_LINE, "field", F.when(~is_object, _kind(json)).alias("kind"), "value", F.when(~json.eqNullSafe(F.col("value")), json).alias("raw"), is_object.alias("_object")))

    done = told(long)
    nested = "_object AND raw <> '{}'"
    parts = [done.where(f"NOT ({nested})")]
    while not done.where(nested).isEmpty():  # one level of nesting a round, over the objects only
        inner = done.where(nested).select(*_LINE, "field", F.explode(entries(F.try_parse_json("raw"), "$")).alias("_key", "_v"))
        inner = inner.select(*_LINE, F.concat("field", F.lit("."), "_key").alias("field"), "_v")
        done = told(inner)
        parts.append(done.where(f"NOT ({nested})"))
    flat = parts[0]
    for more in parts[1:]:
        flat = flat.unionByName(more)
    return flat.drop("_object").withColumn("raw", F.coalesce("raw", "value"))


def file_order(long: DataFrame) -> DataFrame:
    """Each file with its number of lines and the file before it in its feed (by writing time, then id)."""
    lines = long.groupBy("feed_id", "file_id", "line_no").agg(F.min("written_at").alias("written_at"))
    files = lines.groupBy("feed_id", "file_id").agg(F.min("written_at").alias("written_at"), F.count(F.lit(1)).alias("n_lines"))
    in_feed = Window.partitionBy("feed_id").orderBy(F.col("written_at").asc_nulls_first(), "file_id")
    return files.withColumn("before", F.lag("file_id").over(in_feed)).withColumn("nth", F.row_number().over(in_feed))


def profiles(long: DataFrame, files: DataFrame) -> DataFrame:
    """The fields that more than half of a file's lines carry, each with its usual type (null if it has no value)."""
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    counted = long.where("field IS NOT NULL").groupBy("feed_id", "file_id", "field").agg(F.count(F.lit(1)).alias("n"), count("number"), count("text"), count("list"))
    most = F.greatest("number", "text", "list")
    usual = F.when(most == 0, None).when(F.col("number") == most, "number").when(F.col("text") == most, "text").otherwise("list")
    lengths = files.select("feed_id", "file_id", "n_lines")
    return counted.join(lengths, ["feed_id", "file_id"]).where("n * 2 > n_lines").select("feed_id", "file_id", "field", usual.alias("kind"))


def _parts(name: str) -> list[str]:
    return [p for p in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", name) if p] or [name]


@lru_cache(maxsize=100_000)
def _likeness(a: str, b: str) -> float:
    """Dice coefficient of the names' letter triples."""
    grams = [{f"  {x} "[i : i + 3] for i in range(len(x) + 1)} for x in (a, b)]
    return 2 * len(grams[0] & grams[1]) / (len(grams[0]) + len(grams[1]))


#: Parts of names that say nothing about the quantity.
EMPTY_PARTS = ("var", "main", "score", "x", "feature", "v")


@lru_cache(maxsize=100_000)
def _affinity(name: str, target: str) -> float:
    """Likeness of two names in letters or in parts, without parts that say nothing (``EMPTY_PARTS`` and a number after ``v``)."""
    parts = [{p for p in _parts(re.sub(r"(?<![a-z])v[0-9]+$", "", x)) if p not in EMPTY_PARTS} for x in (name, target)]
    shared = 2 * len(parts[0] & parts[1]) / max(1, len(parts[0]) + len(parts[1]))
    return max(_likeness(name, target), shared)


class _Graph:
    """The graph of a file's schema: fields and the objects around them (the root is ``""``), joined to name parts, types and parents."""

    def __init__(self, kinds: Mapping[str, str | None]):
        inside = lambda f: f.rpartition(".")[0]
        nodes = set(kinds) | {""}
        for f in list(kinds):
            while f := inside(f):
                nodes.add(f)
        self.nodes = sorted(nodes)
        at = {n: i for i, n in enumerate(self.nodes)}
        self.at = at
        own = [_parts(n.rpartition(".")[2]) if n else [] for n in self.nodes]
        self.parts = sorted({p for parts in own for p in parts})
        part_at = {p: i for i, p in enumerate(self.parts)}
        self.has_part = [[part_at[p] for p in parts] for parts in own]
        self.type_of = [kinds.get(n) or ("object" if n not in kinds else "none") for n in self.nodes]
        self.parent = [at[inside(n)] if n else -1 for n in self.nodes]
        self.children = [[j for j, p in enumerate(self.parent) if p == i] for i in range(len(self.nodes))]


def flood(old: Mapping[str, str | None], new: Mapping[str, str | None], first: Mapping[tuple[str, str], float], eps: float = 1e-6) -> dict[tuple[str, str], float]:
    """The score of every old with every new field at the fixpoint of the flooding, given the first scores (0 to 1).

    Nodes of the pairwise connectivity graph are pairs of fields (or objects), of name parts and of types; a pair is linked to the pairs of
    its parts, its types, its parents and its children. Each round a pair keeps ``1 - INFLOW`` of its first score and takes the rest
    from its neighbours, by kind of link; of all partners that a part or child has on the other side only the best one counts. Such a
    round brings any two states closer by the factor ``INFLOW``, so there is one fixpoint and it is reached from anywhere; rounds go on
    until no score moves by more than ``eps``.
    """
    import numpy as np

    a, b = _Graph(old), _Graph(new)
    rows, cols = len(a.nodes), len(b.nodes)
    types = sorted({*a.type_of, *b.type_of})
    s0 = np.array([[first.get((x, y), _affinity(x, y) ** 2) if x and y else float(x == y) for y in b.nodes] for x in a.nodes])
    w0 = np.array([[_likeness(p, q) for q in b.parts] for p in a.parts]).reshape(len(a.parts), len(b.parts))
    same_type = {(t, u): 1.0 if t == u else 0.0 if "object" in (t, u) else 0.5 for t in types for u in types}
    kind0 = np.array([[same_type[t, u] for u in b.type_of] for t in a.type_of])
    members = lambda lists, n: np.array([[j in own for j in range(n)] for own in lists], bool).reshape(len(lists), n)
    pa, pb = members(a.has_part, len(a.parts)), members(b.has_part, len(b.parts))
    ca, cb = members(a.children, rows), members(b.children, cols)

    def best(scores, left, right):
        """For all pairs of sets (rows of ``left``, ``right``): how well their members find a partner in the other set, on average."""
        if not scores.size:
            return np.zeros((len(left), len(right)))
        to_right = np.where(right[None, :, :], scores[:, None, :], -1.0).max(axis=2, initial=-1.0)  # member of the left x set on the right
        to_left = np.where(left[:, :, None], scores[None, :, :], -1.0).max(axis=1, initial=-1.0)  # set on the left x member of the right
        total = left.astype(float) @ np.maximum(to_right, 0) + np.maximum(to_left, 0) @ right.T.astype(float)
        return total / np.maximum(left.sum(axis=1)[:, None] + right.sum(axis=1)[None, :], 1)

    up_a, up_b = np.maximum(a.parent, 0), np.maximum(b.parent, 0)
    has_children = ca.any(axis=1)[:, None] | cb.any(axis=1)[None, :]
    s, w, k = s0, w0, kind0
    while True:
        nesting = s[up_a][:, up_b]
        nesting = np.where(has_children, (nesting + best(s, ca, cb)) / 2, nesting)
        s1 = (1 - INFLOW) * s0 + INFLOW * (BY_PARTS * best(w, pa, pb) + BY_TYPE * k + BY_NESTING * nesting)
        w1 = (1 - INFLOW) * w0 + INFLOW * best(s, pa.T, pb.T)
        k1 = (1 - INFLOW) * kind0 + INFLOW * s
        moved = max(np.abs(s1 - s).max(initial=0), np.abs(w1 - w).max(initial=0), np.abs(k1 - k).max(initial=0))
        s, w, k = s1, w1, k1
        if moved <= eps:
            return {(x, y): float(s[a.at[x], b.at[y]]) for x in old for y in new}


def first_scores(old: Mapping[str, str | None], new: Mapping[str, str | None], common: Mapping[tuple[str, str], int], sizes: tuple[Mapping[str, int], Mapping[str, int]]) -> dict[tuple[str, str], float]:
    """First scores of all pairs from names and, where records are exported again, from shared values.

    ``common`` counts the values two fields share, ``sizes`` the distinct values of each. What fields under an unchanged name share tells
    how much of a file is exported again; a pair's part of that, up to 1, is what its values say.
    """
    rate = lambda a, b: common.get((a, b), 0) / max(1, min(sizes[0].get(a, 0), sizes[1].get(b, 0)))
    kept = sorted(rate(f, f) for f in old if f in new)
    usual = kept[len(kept) // 2] if kept else 0.0
    if usual == 0:
        usual = max((rate(a, b) for a in old for b in new if a not in new and b not in old), default=0.0)
    names = {(a, b): _affinity(a, b) for a in old for b in new}
    if usual == 0:
        return {pair: name**2 for pair, name in names.items()}  # where names alone decide, half alike is little
    by_values = lambda a, b: min(1.0, rate(a, b) / usual) if common.get((a, b), 0) >= 2 else 0.0  # noqa: E731  one shared value may be chance
    return {(a, b): BY_VALUES * by_values(a, b) + (1 - BY_VALUES) * name for (a, b), name in names.items()}


def correspondences(old: Mapping[str, str | None], new: Mapping[str, str | None], common: Mapping[tuple[str, str], int], sizes: tuple[Mapping[str, int], Mapping[str, int]]) -> dict[str, str]:
    """New name of each renamed field: a stable one-to-one selection by flooded scores.

    A pair must reach ``MIN_SIMILARITY`` of the score that unchanged fields have with themselves in the same flood (their
    median; 1 where every field changed). Pairs are taken by falling score, so none of two chosen pairs could both do better by a swap.
    """
    gone, come = [f for f in old if f not in new], [f for f in new if f not in old]
    if not gone or not come:
        return {}
    score = flood(old, new, first_scores(old, new, common, sizes))
    kept = sorted(score[f, f] for f in old if f in new)
    least = MIN_SIMILARITY * (kept[len(kept) // 2] if kept else 1.0)
    chosen: dict[str, str] = {}
    taken: set[str] = set()
    for worth, a, b in sorted((-score[a, b], a, b) for a in gone for b in come):
        if -worth >= least > 0 and a not in chosen and b not in taken:
            chosen[a] = b
            taken.add(b)
    return chosen


def _compare(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            old = {x["field"]: x["kind"] for x in r["old"] or []}
            new = {x["field"]: x["kind"] for x in r["new"] or []}
            common = {(x["old_field"], x["field"]): x["n"] for x in r["common"] or []}
            sizes = tuple({x["field"]: x["n"] for x in r[s] or []} for s in ("old_sizes", "new_sizes"))
            renamed = correspondences(old, new, common, sizes)
            back = {b: a for a, b in renamed.items()}
            here = (r["feed_id"], r["file_id"])
            for f in new:
                was = back.get(f, f)
                if f in back:
                    out.append((*here, f, "renamed", was))
                elif f not in old:
                    out.append((*here, f, "added", ""))
                    continue
                if old[was] and new[f] and old[was] != new[f]:
                    out.append((*here, f, "retyped", ""))
            out += [(*here, f, "removed", "") for f in old if f not in new and f not in renamed]
        columns = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]],
            names=["feed_id", "file_id", "field", "change", "old_field"],
        )


def schema_changes(raw: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """``feed_id, file_id, field, change, old_field`` for every change from a file to the next of its feed.

    ``raw`` has one JSON object per line: ``feed_id, file_id, written_at, line_no, payload``.
    A field belongs to a file if more than half of its distinct lines carry it (null and
    unreadable payloads are lines without fields); names are compared without case. Fields without any
    value have no type and are never retyped. Feeds with one file, and empty tables, give no row.
    """
    long = line_fields(raw) if long is None else long
    ordered = written(file_order(long))
    files = ordered.where("before IS NOT NULL").select("feed_id", "file_id", "before")
    prof = written(profiles(long, ordered))
    links = files.select(F.col("feed_id").alias("_feed"), F.col("before").alias("_before"), F.col("file_id").alias("_next"))
    follows = (F.col("feed_id") == F.col("_feed")) & (F.col("file_id") == F.col("_before"))
    old = prof.join(links, follows).select("feed_id", F.col("_next").alias("file_id"), "field", "kind")
    new = prof.join(files.drop("before"), ["feed_id", "file_id"], "left_semi")
    gathered = lambda df, name: df.groupBy("feed_id", "file_id").agg(F.collect_list(F.struct("field", "kind")).alias(name))

    # Only where fields both came and went can one be renamed. There values are compared, also of the fields that stayed, as a yardstick.
    here = ["feed_id", "file_id"]
    gone = old.join(new, [*here, "field"], "left_anti").select(*here).distinct()
    came = new.join(old, [*here, "field"], "left_anti").select(*here).distinct()
    nth = ordered.select("feed_id", "file_id", "nth")
    open_files = came.join(gone, here, "left_semi").join(nth, here).select("feed_id", F.col("nth").alias("_open"))
    wanted = open_files.union(open_files.select("feed_id", F.col("_open") - 1)).distinct().withColumnRenamed("_open", "nth")
    fields = written(prof.join(nth, here).join(wanted, ["feed_id", "nth"], "left_semi").select(*here, "nth", "field"))
    # Distinct values as hashes, brought together by feed and value once: a value has at most as many rows as its feed has files times fields.
    cells = long.where("kind IS NOT NULL").select(*here, "field", F.xxhash64("value").alias("_h")).join(fields, [*here, "field"])
    cells = cells.groupBy("feed_id", "_h", "nth", "field").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    seen = cells.groupBy("feed_id", "_h").agg(F.collect_list(F.struct("nth", "field")).alias("_at"))
    none = F.lit(None).cast("string").alias("old_field")
    itself = F.transform("_at", lambda x: F.struct(x["nth"].alias("nth"), none, x["field"].alias("field")))
    follows_in = F.flatten(F.transform("_at", lambda x: F.transform(F.filter("_at", lambda y: y["nth"] == x["nth"] + 1), lambda y: F.struct(y["nth"].alias("nth"), x["field"].alias("old_field"), y["field"].alias("field")))))
    both = seen.select("feed_id", F.inline(F.concat(itself, F.when(F.size("_at") > 1, follows_in).otherwise(F.slice(itself, 1, 0)))))
    counts = written(both.groupBy("feed_id", "nth", "old_field", "field").agg(F.count(F.lit(1)).alias("n")))  # of a schema's size
    common = counts.where("old_field IS NOT NULL").groupBy("feed_id", "nth").agg(F.collect_list(F.struct("old_field", "field", "n")).alias("common"))
    sizes = counts.where("old_field IS NULL")
    sized = lambda name, shift: sizes.groupBy("feed_id", (F.col("nth") + shift).alias("nth")).agg(F.collect_list(F.struct("field", "n")).alias(name))
    pair = (
        files.drop("before")
        .join(nth, here)
        .join(gathered(old, "old"), here, "left")
        .join(gathered(new, "new"), here, "left")
        .join(common, ["feed_id", "nth"], "left")
        .join(sized("old_sizes", 1), ["feed_id", "nth"], "left")
        .join(sized("new_sizes", 0), ["feed_id", "nth"], "left")
    )
    pair = pair.select(F.col("feed_id").cast("long"), F.col("file_id").cast("long"), "old", "new", "common", "old_sizes", "new_sizes")
    # Few bytes but a flood each, so spread by number, not by size.
    return pair.repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(
        _compare, "feed_id long, file_id long, field string, change string, old_field string"
    )


def _origins(batches: Iterator) -> Iterator:
    """Per feed, over its renamings in file order: under which first name each new name goes on."""
    import pyarrow as pa

    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            first: dict[str, str] = {}
            for e in sorted(r["events"], key=lambda e: (e["nth"], e["field"])):
                origin = first.pop(e["old_field"], e["old_field"])
                first[e["field"]] = origin
                out.append((r["feed_id"], e["nth"], e["field"], origin))
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
            names=["feed_id", "since", "field", "origin"],
        )


def unified(raw: DataFrame, targets: Mapping[str, str], min_likeness: float = 0.6) -> DataFrame:
    """One row per line with the columns of ``targets`` (name: type), whatever its file called them.

    A field keeps its identity through all renamings of its feed; it fills the target that its
    first name, or else its present one, equals or is closest to (in letter triples or parts, at least
    ``min_likeness``). Values lose the brackets of a list of one, unit and decimal comma and become null where they
    don't fit. Fields that fit no target, and lists of several values, are kept as they stand in the map ``others``. Lines
    without any field have a row of nulls.
    """
    long = line_fields(raw)
    files = file_order(long).select("feed_id", "file_id", "nth")
    renames = schema_changes(raw, long).where("change = 'renamed'").join(files, ["feed_id", "file_id"])
    events = renames.groupBy(F.col("feed_id").cast("long").alias("feed_id")).agg(F.collect_list(F.struct("nth", "field", "old_field")).alias("events"))
    origins = events.mapInArrow(_origins, "feed_id long, since int, field string, origin string")

    names = list(targets)

    @F.pandas_udf("string")
    def target_of(origin, field):
        import pandas as pd

        known: dict[tuple, str | None] = {}

        def find(o, f):
            for x in (o, f):
                if x in targets:
                    return x
            score, best = max((_affinity(x, t), t) for x in (o, f) if x for t in names)
            return best if score >= min_likeness else None

        return pd.Series([known[k] if k in known else known.setdefault(k, find(*k)) for k in zip(origin, field)], dtype=object)

    # The identity of a file's field: that of the latest renaming to this name up to the file.
    present = long.where("field IS NOT NULL").select("feed_id", "file_id", "field").distinct().join(files, ["feed_id", "file_id"])
    named = present.join(origins.withColumnRenamed("feed_id", "_feed").withColumnRenamed("field", "_field"), (F.col("feed_id") == F.col("_feed")) & (F.col("field") == F.col("_field")) & (F.col("since") <= F.col("nth")), "left")
    named = named.groupBy("feed_id", "file_id", "field").agg(F.max_by("origin", F.coalesce("since", F.lit(0))).alias("origin"))
    named = named.select("feed_id", "file_id", "field", target_of(F.coalesce("origin", "field"), F.col("field")).alias("target"))
    cells = long.join(named, ["feed_id", "file_id", "field"], "left")
    lines = cells.groupBy("feed_id", "file_id", "level", "line_no")
    typed = lambda c, kind: c.try_cast("decimal(38,6)").try_cast(kind) if kind in ("long", "bigint", "int") else c.try_cast(kind)
    several = (F.col("kind") == "list") & (F.size(F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>")) > 1)
    text = F.regexp_replace("raw", '^"|"$', "")
    fits = lambda t, kind: (F.col("target") == t) & F.col("kind").isNotNull() & ~several
    wide = [typed(F.max(F.when(fits(t, kind), text if kind == "string" else F.col("value"))), kind).alias(t) for t, kind in targets.items()]
    apart = F.col("field").isNotNull() & F.col("kind").isNotNull() & (F.col("target").isNull() | several)
    others = F.map_from_entries(F.array_distinct(F.collect_list(F.when(apart, F.struct("field", text)))))
    return lines.agg(*wide, others.alias("others"))
