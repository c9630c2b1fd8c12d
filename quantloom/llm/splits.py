"""Training, validation and test splits that never part records which belong together.

Components are found by alternating large-star and small-star steps; their label vectors are
added up over cells of entities, which grouped iterative stratification places, the
rarest outstanding label first, and refines until no move of a cell brings the shares closer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.skew import frequent_keys, join_by_key
from quantloom.runtime import MAX_BROADCAST_ROWS, cut

#: Edges below which no key can be large enough to matter, so hot keys aren't looked for.
FEW_EDGES = 1_000_000


def _stars(edges: DataFrame, many: bool, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b: every neighbour (large: only larger ones) goes to the least of the neighbourhood."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        move = F.col("v") > F.col("u")
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        move = F.lit(True)
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    hot = frequent_keys(both, "u") if many else None
    met = join_by_key(both.where(move), least, "u", "w", "inner", hot=hot)
    pairs = met.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        pairs = pairs.union(least.select("w", "m"))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component`` of all nodes of the undirected edges ``a, b``; a component is named by its least node.

    Self-loops, repeated edges and nulls don't count; nodes without any other edge don't come out.
    The rounds needed grow with the logarithm of the nodes.
    """
    now = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = state(now)
    for _ in range(max_rounds):
        many = seen[0] > FEW_EDGES
        now = cut(_stars(_stars(now, many, True), many, False))
        before, seen = seen, state(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def ties(rows: DataFrame, member: str, key: str) -> DataFrame:
    """Edges that tie all members of one key together: each to the least of them."""
    rows = rows.where(F.col(member).isNotNull() & F.col(key).isNotNull()).select(F.col(member).alias("a"), F.col(key).alias("_key")).distinct()
    least = rows.groupBy(F.col("_key").alias("_hub")).agg(F.min("a").alias("b"))
    return join_by_key(rows, least, "_key", "_hub", "inner", hot=frequent_keys(rows, "_key")).select("a", "b").where("a <> b")


#: Words that mark a decoy at the start or end of a name, and the signs that set them off.
DECOY_WORDS = "decoy|reversed|reverse|rev|shuffled|shuffle|random|rand|rnd|pseudo|xxx|dec"
START = rf"(?i)^(#+|[^A-Za-z0-9]*)({DECOY_WORDS})(#+|[^A-Za-z0-9]+)"
END = rf"(?i)(#+|[^A-Za-z0-9]+)({DECOY_WORDS})[^A-Za-z0-9]*$"


def precursor_ties(precursors: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between precursors of one peptide, and between a decoy and the target its name is made from."""
    named = precursors.where("id IS NOT NULL AND traml_id IS NOT NULL").select("id", "traml_id", "decoy").distinct()
    targets = named.where("decoy = 0").select("id", F.col("traml_id").alias("name"))
    bases = F.array(*[F.regexp_replace("traml_id", p, "") for p in (START, END)])
    decoys = named.where("decoy = 1").select("id", "traml_id", F.explode(bases).alias("name")).where("name <> traml_id").select("id", "name").distinct()
    pairs = decoys.join(targets.select("name").distinct(), "name", "left_semi").unionByName(targets.join(decoys.select("name").distinct(), "name", "left_semi"))
    return ties(mapping, "precursor_id", "peptide_id").union(ties(pairs, "id", "name"))


def precursor_sets(precursors: DataFrame, mapping: DataFrame) -> DataFrame:
    """``precursor_id, set_id``: precursors of the table in a set of two or more, named by its least precursor."""
    found = components(precursor_ties(precursors, mapping)).select(F.col("node").alias("precursor_id"), F.col("component").alias("set_id"))
    return found.join(precursors.select(F.col("id").alias("precursor_id")).distinct(), "precursor_id", "left_semi")


def _stratified(cell, label, n, size, labels: int, shares: Sequence[float], before=None, need_all=None):
    """Splits of cells from their rows by label, grouped iterative stratification and refinement.

    ``cell``, ``label`` and ``n`` are the numbers above 0 of the matrix of cells and labels, ``size`` all rows of each cell. The label with the
    fewest outstanding rows comes first; its cells, largest first, go each to the split that needs this
    label most (then: most rows at all, then the earlier split). Then cells are moved, one at a time, as long as a move brings the rows by
    label and split closer to the wished shares (by the chi-square of all labels, and all rows as a label of ten times the weight).
    ``before``: rows by split and label placed earlier; ``need_all``: rows each split still needs.
    """
    import numpy as np

    k, cells = len(shares), len(size)
    by_cell = np.lexsort((label, cell))
    cell, label, n = cell[by_cell], label[by_cell], n[by_cell].astype(float)
    bounds = np.searchsorted(cell, np.arange(cells + 1))
    own = [slice(bounds[i], bounds[i + 1]) for i in range(cells)]
    by_label = np.lexsort((cell, -n, label))
    label_bounds = np.searchsorted(label[by_label], np.arange(labels + 1))
    share = np.asarray(shares, float)[:, None]
    before = np.zeros((k, labels)) if before is None else before
    need_all = share[:, 0] * size.sum() if need_all is None else np.array(need_all, float)
    left = np.bincount(label, n, labels)
    want = share * (left + before.sum(axis=0))
    need, wished = want - before, need_all.copy()
    out = np.ones(cells, bool)
    place = np.zeros(cells, int)

    def put(i: int, wish) -> None:
        place[i] = s = max(range(k), key=lambda x: (wish[x], need_all[x], -x))
        need[s, label[own[i]]] -= n[own[i]]
        need_all[s] -= size[i]
        left[label[own[i]]] -= n[own[i]]
        out[i] = False

    while (open_labels := np.flatnonzero(left > 0.5)).size:
        x = open_labels[np.argmin(left[open_labels])]
        for i in cell[by_label[label_bounds[x] : label_bounds[x + 1]]]:
            if out[i]:
                put(i, need[:, x])
    for i in np.flatnonzero(out):
        put(i, need_all)
    # Refinement: excess over the wish by split, of every label and of all rows.
    weight, weight_all = 1 / np.maximum(want, 1), 10 / np.maximum(share[:, 0] * max(size.sum(), 1), 1)
    excess, excess_all = -need, np.bincount(place, size, k) - wished
    # Where one cell alone holds more of a label than any split's share, only the label's other rows are wished by shares: they cannot make up for it.
    total = want.sum(axis=0)
    for e in np.flatnonzero(n > max(shares) * total[label]):
        x = label[e]
        fair = share[:, 0] * (total[x] - n[e])
        fair[place[cell[e]]] += n[e]
        excess[:, x] += want[:, x] - fair
        weight[:, x] = 1 / np.maximum(fair, 1)
    moved = True
    while moved:
        moved = False
        for i in np.argsort(-size, kind="stable"):
            at, v, here = label[own[i]], n[own[i]], place[i]
            w = weight[:, at]
            pull = (excess[:, at] * w) @ v + excess_all * weight_all * size[i]
            square = w @ (v * v) + weight_all * size[i] ** 2
            gain = 2 * (pull - pull[here]) + square + square[here]  # change of the chi-square by moving to each split
            gain[here] = 0.0
            to = int(np.argmin(gain))
            if gain[to] < -1e-6:
                excess[here, at] -= v
                excess[to, at] += v
                excess_all[here] -= size[i]
                excess_all[to] += size[i]
                place[i] = to
                moved = True
    return place


def stratify(vectors: dict[str, dict[str, float]], shares: Sequence[float]) -> dict[str, int]:
    """The split of every cell (name: rows by label), as ``_stratified`` places them."""
    import numpy as np

    cells = sorted(vectors)
    labels = {label: i for i, label in enumerate(sorted({x for v in vectors.values() for x in v}))}
    entries = [(i, labels[x], n) for i, c in enumerate(cells) for x, n in vectors[c].items() if n]
    cell, label, n = (np.array([e[j] for e in entries], kind) for j, kind in enumerate((np.int64, np.int64, float)))
    size = np.bincount(cell, n, len(cells)) if len(cells) else np.zeros(0)
    return dict(zip(cells, _stratified(cell, label, n, size, len(labels), shares).tolist()))


#: Cells of a label at the least, so that a cell is a small part of even a small share of its rows.
LABEL_CELLS = 32
#: Numbers (rows of a cell with a label) that reach the driver at once, about 100 MB.
MAX_NUMBERS = 4_000_000


def _placed(vectors: DataFrame, labels: int, max_labels: int, total: int, shares: Sequence[float]) -> dict[int, int]:
    """Splits of all cells from their vectors ``_cell, _l, n``; labels are numbered by rarity.

    One pass takes all labels, as long as there are at most ``max_labels`` and ``MAX_NUMBERS`` numbers; else each takes as many as fit.
    """
    import numpy as np

    spark = vectors.sparkSession
    vectors = cut(vectors)
    sizes = vectors.groupBy("_cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).toArrow().sort_by("_cell")  # a row a cell
    all_cells, all_sizes = sizes["_cell"].to_numpy(), sizes["n"].to_numpy().astype(float)
    passes = max(-(-labels // max_labels), -(-int(sizes["k"].to_numpy().sum()) // MAX_NUMBERS), 1)
    step = -(-labels // passes) if labels else 1
    placed: dict[int, int] = {}
    need_all = np.array([share * total for share in shares])
    for low in range(0, labels, step):
        width = min(step, labels - low)
        here = vectors.where(F.col("_l").between(low, low + width - 1))
        before = np.zeros((len(shares), width))
        if placed:
            known = F.broadcast(spark.createDataFrame(list(placed.items()), "_cell long, _split int"))
            met = here.join(known, "_cell", "left")
            for r in met.where("_split IS NOT NULL").groupBy("_split", "_l").agg(F.sum("n").alias("n")).collect():  # a row a split and label
                before[r["_split"], r["_l"] - low] = r["n"]
            here = met.where("_split IS NULL")
        frame = here.select("_cell", "_l", "n").toArrow()
        cells, at = np.unique(frame["_cell"].to_numpy(), return_inverse=True)
        if not len(cells):
            continue
        size = all_sizes[np.searchsorted(all_cells, cells)]
        place = _stratified(at, frame["_l"].to_numpy() - low, frame["n"].to_numpy(), size, width, shares, before, need_all)
        placed |= dict(zip(cells.tolist(), place.tolist()))
        need_all = need_all - np.bincount(place, size, len(shares))
    return placed


def grouped_splits(
    records: DataFrame,
    entity: str,
    record: str,
    labels: Sequence[str],
    shares: dict[str, float],
    max_cells: int = 1 << 14,
    max_labels: int = 2048,
) -> DataFrame:
    """``records`` with a column ``split`` such that all records of an entity share it and ``shares`` hold for all labels.

    A record without entity is an entity of its own. An entity with more than a ``max_cells``-th of the
    rows is a cell for itself; all others are put into cells by their rarest label and a hash of
    the entity, at least ``LABEL_CELLS`` for each label. Labels are never folded: with more than ``max_labels`` of them, or more than
    ``MAX_NUMBERS`` numbers in the vectors, they are taken rarest first, in several passes, and a cell is placed in the pass of its rarest label. Of a pass only the
    vectors of its own cells over its own labels reach the driver; beside these it holds the totals of the labels and the places of the cells. With one
    pass all labels are met to about a cell, unless an entity is larger; with several, frequent labels depend on cells that were placed for rarer ones.
    """
    names, spark = list(shares), records.sparkSession
    label = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in labels]))
    rows = records.withColumn("_label", label)
    by_rarity = sorted((r["n"], r["_label"]) for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a label
    total = sum(n for n, _ in by_rarity)
    numbered = F.broadcast(spark.createDataFrame([(name, i) for i, (_, name) in enumerate(by_rarity)], "_label string, _l int"))
    rows = rows.join(numbered, "_label").drop("_label")
    per_label = max(LABEL_CELLS, max_cells // max(1, len(by_rarity)))
    cell = lambda key, rarest: F.col(rarest).cast("long") * per_label + F.pmod(F.xxhash64(key, F.lit(7)), F.lit(per_label))
    counted = cut(rows.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("_of"), "_l").agg(F.count(F.lit(1)).alias("n")))
    # A record without entity has one label, so its cell follows from the row alone and needs no join.
    alone = rows.where(F.col(entity).isNull()).withColumn("_cell", cell(record, "_l"))
    entities = cut(counted.groupBy("_of").agg(F.sum("n").alias("_size"), F.min("_l").alias("_rarest")))
    large = entities.where(F.col("_size") * max_cells > total).select("_of").orderBy("_of").collect()  # fewer than max_cells
    own = F.broadcast(spark.createDataFrame([(r["_of"], -1 - i) for i, r in enumerate(large)], entities.select("_of", F.lit(0).cast("long").alias("_own")).schema))
    entities = entities.join(own, "_of", "left").select("_of", F.coalesce("_own", cell("_of", "_rarest")).alias("_cell"))
    vectors = counted.join(entities, "_of").select("_cell", "_l", "n").union(alone.groupBy("_cell", "_l").agg(F.count(F.lit(1)).alias("n"))).groupBy("_cell", "_l").agg(F.sum("n").alias("n"))
    placed = _placed(vectors, len(by_rarity), max_labels, total, [shares[k] for k in names])
    where = F.broadcast(spark.createDataFrame([(c, names[s]) for c, s in placed.items()] or [(0, names[0])], "_cell long, split string"))
    decided = entities.join(where, "_cell").select("_of", "split")
    out = [*records.columns, "split"]
    mine = join_small(rows.where(F.col(entity).isNotNull()), decided, entity, "_of", "inner", entities.count())
    return mine.select(*out).unionByName(alone.join(where, "_cell").select(*out))


def reached_shares(placed: DataFrame, labels: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Per label and split: rows, the share of the label's rows that was reached, and by how much it misses the wish; a row with ``level``
    ``all`` a split for all rows. Splits without any row of a label have a row too."""
    counts = placed.groupBy(*labels, "split").agg(F.count(F.lit(1)).alias("n_rows"))  # everything below is a row a label and split

    def told(level: str, keys: list[str]) -> DataFrame:
        own = counts.groupBy(*[F.struct(*keys).alias("_k") if keys else F.lit(0).alias("_k")]).agg(F.sum("n_rows").alias("_all"), *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n_rows"))), F.lit(0)).alias(f"_n{i}") for i, s in enumerate(shares)])
        each = own.select("_k", "_all", F.array(*[f"_n{i}" for i in range(len(shares))]).alias("_ns"), F.posexplode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(float(x)).alias("wish")) for s, x in shares.items()])).alias("_i", "_s"))
        share = F.get("_ns", F.col("_i")) / F.col("_all")
        named = [F.col(f"_k.{c}") if keys else F.lit(None).cast(dict(placed.dtypes)[c]).alias(c) for c in labels]
        return each.select(F.lit(level).alias("level"), *named, F.col("_s.split").alias("split"), F.get("_ns", F.col("_i")).alias("n_rows"), F.round(share, 6).alias("share"), F.round(share - F.col("_s.wish"), 6).alias("deviation"))

    return told("label", list(labels)).unionByName(told("all", []))


def join_small(rows: DataFrame, other: DataFrame, key: str, other_key: str, how: str, other_rows: int) -> DataFrame:
    """A broadcast join where ``other`` is known to be small, else a shuffled one that spares hot keys."""
    if other_rows <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(other), F.col(key) == F.col(other_key), how)
    return join_by_key(rows, other, key, other_key, how, hot=frequent_keys(rows, key))


#: The shares of the splits.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def feature_splits(features: DataFrame, precursors: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct features with ``decoy`` (null where the precursor is unknown) and ``split``; sets of precursors stay together."""
    sets = precursor_sets(precursors, mapping).select(F.col("precursor_id").alias("_p"), "set_id")
    kinds = precursors.where("id IS NOT NULL").groupBy(F.col("id").alias("_q")).agg(F.max("decoy").alias("decoy"))
    known = kinds.join(sets, F.col("_q") == F.col("_p"), "left").select(F.col("_q").alias("_precursor"), "decoy", F.coalesce("set_id", "_q").alias("_set"))
    rows = features.where("id IS NOT NULL").select("id", "run_id", "precursor_id").distinct()
    rows = join_small(rows, known, "precursor_id", "_precursor", "left", precursors.count())
    rows = rows.select(F.col("id").alias("feature_id"), "run_id", "precursor_id", "decoy", F.coalesce("_set", "precursor_id").alias("_set"))
    return grouped_splits(rows, "_set", "feature_id", ["run_id", "decoy"], SHARES).drop("_set")
