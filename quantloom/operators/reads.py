"""Input tables of scoring, inference and export, joined from the tables of a feature store.

Deliveries repeat, so library rows are reduced to one per id and measured rows to distinct ones before they are
joined; every join is on equal keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.relational import collapsed, dense_ids, feature_table, unique_partner

#: The score columns of the metabolomics profile.
METABOLOMICS = (
    "var_ms1_isotope_overlap_score", "var_ms1_xcorr_coelution_contrast", "var_ms1_massdev_score", "var_ms1_xcorr_coelution", "var_ms1_isotope_correlation_score",
    "var_isotope_overlap_score", "var_isotope_correlation_score", "var_intensity_score", "var_massdev_score", "var_library_corr", "var_norm_rt_score",
)
#: Weights of the pretrained main score.
PRETRAINED = {
    "var_library_corr": 0.19011762, "var_library_rmsd": -2.47298914, "var_norm_rt_score": -5.63906731, "var_isotope_correlation_score": 0.62640133, "var_isotope_overlap_score": -0.36006925,
    "var_massdev_score": -0.08814003, "var_xcorr_coelution": -0.13978311, "var_xcorr_shape": 1.16475032, "var_yseries_score": 0.19267813, "var_log_sn_score": 0.61712054,
}
#: Columns that tree learners take as features.
COUNTS = ("precursor_charge", "product_charge", "transition_count")
#: Fixed value: the neutral loss of a phospho group in fragment annotations.
PHOSPHO_LOSS = "-H3O4P1"


def designate_main(table: DataFrame, name: str) -> DataFrame:
    """``table`` in lower case with ``name`` as its main score (``main_<name>``); ``swath_pretrained`` adds the weighted sum ``PRETRAINED`` as one."""
    low = table.toDF(*[c.lower() for c in table.columns])
    if name.lower() in low.columns:
        return low.withColumnRenamed(name.lower(), f"main_{name.lower()}")
    if name.lower() != "swath_pretrained":
        raise ValueError(f"no column {name} for the main score")
    total = F.lit(0.0)
    for c, w in PRETRAINED.items():
        total = total + F.col(c) * w
    return low.withColumn("main_var_pretrained", total)


def promote_counts(table: DataFrame) -> DataFrame:
    """Charges and counts as features (``var_``), for learners that can use them."""
    return table.withColumnsRenamed({c: f"var_{c}" for c in COUNTS if c in table.columns})


def score_columns(columns: Sequence[str], main: str, wanted: Sequence[str] | str | None = None) -> list[str]:
    """The main score and the feature columns to learn from: all ``var_*``, those ``wanted``, or those of the profile ``metabolomics``."""
    there = [c for c in columns if c.startswith("var_")]
    names = METABOLOMICS if wanted == "metabolomics" else [wanted] if isinstance(wanted, str) else wanted
    chosen = there if names is None else [n for n in names if n != main and f"main_{n}" != main]
    if missing := sorted(set(chosen) - set(there)):
        raise ValueError(f"no such score columns: {missing}")
    return [main, *chosen]


def ms1_table(features: DataFrame, measures: DataFrame, precursors: DataFrame, glycopeptides: DataFrame | None = None, scores: DataFrame | None = None, max_rank: int | None = None) -> DataFrame:
    """MS1 measures of features with precursor facts and group id.

    For glycopeptides (``precursor_id, decoy_peptide, decoy_glycan``) only features are read that have a rank up to ``max_rank`` in ``scores``.
    """
    rows = measures.distinct().join(feature_table(features, precursors), "feature_id")
    if glycopeptides is None:
        return rows
    if scores is None or max_rank is None:
        raise ValueError("glycopeptides are read by the ranks of scored peak groups")
    ranked = scores.where(F.col("rank") <= max_rank).select("feature_id").distinct()
    return rows.join(ranked, "feature_id", "left_semi").join(glycopeptides.distinct(), "precursor_id")


def transition_table(transitions: DataFrame, precursors: DataFrame, max_rank: int, max_pep: float) -> DataFrame:
    """Rows of a split store's transition file with those of its precursor file, on precursor and feature, that pass rank and PEP of the peak group."""
    good = precursors.where((F.col("rank") <= max_rank) & (F.col("pep") <= max_pep)).select("precursor_id", "feature_id", "run_id", "decoy").distinct()
    return transitions.distinct().join(good, ["precursor_id", "feature_id"])


def ipf_precursors(features: DataFrame, precursors: DataFrame, score_ms2: DataFrame, max_pep: float, score_ms1: DataFrame | None = None, score_transition: DataFrame | None = None, transitions: DataFrame | None = None, intensities: DataFrame | None = None) -> DataFrame:
    """``feature_id, ms2_peakgroup_pep, ms1_precursor_pep, ms2_precursor_pep`` of target features with a peak group PEP below ``max_pep``.

    MS1 evidence is used if ``score_ms1`` is given, MS2 precursor evidence if ``score_transition`` and ``transitions`` are (that of transitions of the
    precursor itself: empty type, no decoy); each that is used must be there for a feature, each that is not is null. ``intensities`` adds
    ``feature_ms2_intensity``.
    """
    targets = precursors.groupBy(F.col("id").alias("precursor_id")).agg(F.max("decoy").alias("decoy")).where("decoy = 0").select("precursor_id")
    ids = features.where("id IS NOT NULL").select(F.col("id").alias("feature_id"), "precursor_id").distinct().join(targets, "precursor_id", "left_semi").select("feature_id").distinct()
    rows = ids.join(score_ms2.where(F.col("pep") < max_pep).select("feature_id", F.col("pep").alias("ms2_peakgroup_pep")).distinct(), "feature_id")
    null = F.lit(None).cast("double")
    rows = rows.withColumn("ms1_precursor_pep", null) if score_ms1 is None else rows.join(score_ms1.select("feature_id", F.col("pep").alias("ms1_precursor_pep")).distinct(), "feature_id")
    if score_transition is None or transitions is None:
        rows = rows.withColumn("ms2_precursor_pep", null)
    else:
        own = transitions.where("type = '' AND decoy = 0").select(F.col("id").alias("transition_id")).distinct()
        of_precursor = score_transition.join(own, "transition_id", "left_semi").select("feature_id", F.col("pep").alias("ms2_precursor_pep")).distinct()
        rows = rows.join(of_precursor, "feature_id")
    if intensities is not None:
        rows = rows.join(intensities.select("feature_id", F.col("area_intensity").alias("feature_ms2_intensity")).distinct(), "feature_id")
    return rows


def outer_peps(ms1: DataFrame, ms2: DataFrame, peakgroup: DataFrame) -> DataFrame:
    """One row per feature of any of three tables ``feature_id, <pep>``, with nulls where one lacks it."""
    return ms2.join(ms1, "feature_id", "full_outer").join(peakgroup, "feature_id", "full_outer")


def alignment_groups(alignment: DataFrame, scores: DataFrame, max_pep: float) -> DataFrame:
    """``alignment_group_id, alignment_id, precursor_id, feature_id, feature_type, place, pep``: references and what is aligned to them.

    Only alignments of targets (label 1) between different features count, and of these features with a least alignment PEP below
    ``max_pep``. ``place`` orders a group: references first, then by feature.
    """
    real = alignment.where("label = 1 AND reference_feature_id <> aligned_feature_id")
    side = lambda c, kind: real.select("alignment_id", F.col(c).alias("feature_id"), "precursor_id", F.lit(kind).alias("feature_type"))
    merged = side("reference_feature_id", "REFERENCE").unionByName(side("aligned_feature_id", "QUERY")).distinct()
    best = scores.where(F.col("pep") < max_pep).groupBy("feature_id").agg(F.min("pep").alias("pep"))
    told = dense_ids(merged.join(best, "feature_id"), ["precursor_id", "alignment_id"], "alignment_group_id")
    order = Window.partitionBy("alignment_group_id").orderBy(F.when(F.col("feature_type") == "REFERENCE", 0).otherwise(1), "feature_id")  # as many rows as runs
    return told.withColumn("place", F.row_number().over(order))


def alignment_features(alignment: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Alignment rows with ``decoy`` 0 or 1 (of labels 1 and -1, else null) and the scores of the least q-value of each aligned feature."""
    rows = alignment.withColumnRenamed("aligned_feature_id", "feature_id").withColumn("decoy", F.when(F.col("label") == 1, 0).when(F.col("label") == -1, 1)).drop("label")
    if scores is None:
        return rows
    best = scores.groupBy("feature_id").agg(F.min_by(F.struct("score", "pep", "qvalue"), F.struct(F.col("qvalue").isNull(), "qvalue", "pep", "score")).alias("_s")).select("feature_id", "_s.*")
    return rows.join(best, "feature_id", "left")


def phospho_loss_flags(transitions: DataFrame) -> DataFrame:
    """``transition_id, has_phospho_loss``: 1 if any annotation of the transition names the loss."""
    return transitions.groupBy(F.col("id").alias("transition_id")).agg(F.max(F.coalesce(F.col("annotation").contains(PHOSPHO_LOSS), F.lit(False)).cast("int")).alias("has_phospho_loss"))


def context_entities(features: DataFrame, precursors: DataFrame, scores: DataFrame, chain: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """``run_id, <entity>, decoy, feature_id, score``: the best feature of each entity and run.

    ``chain`` leads from precursors to the entity in steps ``(mapping, from, to)``; at each step only items with exactly one partner go on, so
    an entity is judged by what is proteotypic for it. Ties go to the least feature.
    """
    facts = precursors.groupBy(F.col("id").alias("precursor_id")).agg(F.max("decoy").alias("decoy"))
    best = scores.where("score IS NOT NULL AND NOT isnan(score)").groupBy("feature_id").agg(F.max("score").alias("score"))
    rows = features.where("id IS NOT NULL").select(F.col("id").alias("feature_id"), "run_id", "precursor_id").distinct().join(facts, "precursor_id").join(best, "feature_id")
    for mapping, item, partner in chain:
        rows = rows.join(unique_partner(mapping, item, partner), item)
    entity = chain[-1][2]
    top = rows.groupBy("run_id", entity, "decoy").agg(F.max_by("feature_id", F.struct("score", -F.col("feature_id").cast("decimal(20,0)"))).alias("feature_id"), F.max("score").alias("score"))
    return top.select("run_id", entity, "decoy", "feature_id", "score")


def wide_precursors(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The precursor file of a split store: features with precursor facts, the ids of their peptides and their scores (``score_ms2_*``)."""
    rows = feature_table(tables["feature"], tables["precursor"]).drop("group_id")
    mapping = tables["precursor_peptide_mapping"].where("peptide_id IS NOT NULL")
    rows = rows.join(collapsed(mapping, ["precursor_id"], "peptide_id", "peptide_ids"), "precursor_id", "left")
    if "score_ms2" in tables:
        from quantloom.operators.export import best_scores

        scores = best_scores(tables["score_ms2"])
        rows = rows.join(scores.withColumnsRenamed({c: f"score_ms2_{c}" for c in scores.columns if c != "feature_id"}), "feature_id", "left")
    return rows


def wide_transitions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The transition file of a split store: fragments with transition facts and the run of their feature; transitions never measured have no run."""
    facts = tables["transition"].groupBy(F.col("id").alias("transition_id")).agg(*[F.max(c).alias(c) for c in ("product_mz", "charge", "type", "ordinal", "annotation", "decoy") if c in tables["transition"].columns])
    runs = tables["feature"].where("id IS NOT NULL").select(F.col("id").alias("feature_id"), "run_id").distinct()
    measured = tables["feature_transition"].where("transition_id IS NOT NULL").drop("loaded_at").distinct().join(runs, "feature_id")
    return measured.join(facts, "transition_id", "full_outer")


def chromatogram_library(chromatograms: DataFrame, precursors: DataFrame, transitions: DataFrame) -> DataFrame:
    """``chromatogram_id, kind, item_id, mz, charge`` of chromatograms ``id, native_id``: a precursor's are named ``<id>_Precursor_i<n>``, a transition's by its id."""
    of_precursor = chromatograms.select(F.col("id").alias("chromatogram_id"), F.nullif(F.regexp_extract("native_id", r"^(-?\d+)_Precursor_i\d+$", 1), F.lit("")).try_cast("long").alias("item_id")).where("item_id IS NOT NULL")
    of_transition = chromatograms.where(F.col("native_id").rlike(r"^-?\d+$")).select(F.col("id").alias("chromatogram_id"), F.col("native_id").try_cast("long").alias("item_id"))
    facts = lambda df, mz: df.groupBy(F.col("id").alias("item_id")).agg(F.max(mz).alias("mz"), F.max("charge").alias("charge"))
    parts = [(of_precursor, facts(precursors, "precursor_mz"), "precursor"), (of_transition, facts(transitions, "product_mz"), "transition")]
    told = [c.join(f, "item_id").select("chromatogram_id", F.lit(kind).alias("kind"), "item_id", "mz", "charge") for c, f, kind in parts]
    return told[0].unionByName(told[1])


def with_peptidoforms(rows: DataFrame, inferred: DataFrame, sequences: DataFrame) -> DataFrame:
    """``rows`` with the likeliest peptidoforms of their feature: sequences of least PEP joined by ``;`` and that PEP; rows without any stay."""
    named = inferred.join(sequences, "peptide_id")
    least = named.groupBy("feature_id").agg(F.min("pep").alias("pep"))
    ties = named.join(least, ["feature_id", "pep"]).groupBy("feature_id").agg(F.array_join(F.array_sort(F.collect_set("modified_sequence")), ";").alias("ipf_full_peptide_name"), F.first("pep").alias("ipf_pep"))
    return rows.join(ties, "feature_id", "left")


def part_scores(peptide: DataFrame, glycan: DataFrame, keys: Sequence[str], values: Sequence[str] = ("d_score", "decoy")) -> DataFrame:
    """Scores of the peptide and the glycan part of the same rows side by side, ``<value>_peptide`` and ``<value>_glycan``."""
    side = lambda df, name: df.select(*keys, *[F.col(v).alias(f"{v}_{name}") for v in values])
    return side(peptide, "peptide").join(side(glycan, "glycan"), list(keys))


def base_name(path: Column) -> Column:
    """A file's name without folders and its last extension; names that only begin with a dot stay."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def first_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of a fixed pseudo-random order of the keys (an MD5 sum, the same in every engine), then by key; sampling is the feature."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def stratified_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows, of each label (0 and 1) its share rounded down and in fixed pseudo-random order; smaller tables come whole."""
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if total <= n:
        return df.where(F.col(label).isin(0, 1))
    parts = [first_by_hash(df.where(F.col(label) == y), key, n * counts.get(y, 0) // total, seed) for y in (0, 1)]
    return parts[0].unionByName(parts[1])
