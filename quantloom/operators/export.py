"""Exports: long tables of identified features with entity error rates, minimal score reports, compounds, glycopeptides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.relational import aligned_recovery, column_or_null, unique_partner


@dataclass(frozen=True)
class Thresholds:
    """Cutoffs of the long export; None leaves a filter out."""

    qvalue: float | None = 0.05
    pep: float | None = None
    rank: int | None = 1
    transition_pep: float | None = 0.7
    peptide_qvalue: float | None = 0.01
    protein_qvalue: float | None = 0.01
    decoys: bool = False


def best_scores(scores: DataFrame) -> DataFrame:
    """One row per feature: that of its highest score (null and NaN scores don't count)."""
    valid = scores.where("feature_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    return valid.groupBy("feature_id").agg(F.max_by(F.struct("score", "rank", "pvalue", "qvalue", "pep"), F.struct("score", "loaded_at") if "loaded_at" in scores.columns else F.col("score")).alias("_s")).select("feature_id", "_s.*")


def identified(features: DataFrame, precursors: DataFrame, scores: DataFrame | None, limits: Thresholds = Thresholds(), recompute_rank: bool = True) -> DataFrame:
    """Features with precursor facts and scores below the thresholds; without ``scores`` the unscored export.

    The rank within run and precursor is computed from the scores unless ``recompute_rank`` is off.
    """
    facts = precursors.where("id IS NOT NULL").groupBy(F.col("id").alias("precursor_id")).agg(
        *[F.max_by(c, "loaded_at").alias(c) if "loaded_at" in precursors.columns else F.max(c).alias(c) for c in ("charge", "precursor_mz", "decoy", "group_label", "library_rt") if c in precursors.columns]
    )
    rows = features.where("id IS NOT NULL AND precursor_id IS NOT NULL").select(
        F.col("id").alias("feature_id"), "run_id", "precursor_id", *[column_or_null(features, c, "double") for c in ("exp_rt", "norm_rt", "delta_rt", "exp_im", "left_width", "right_width")]
    )
    rows = rows.groupBy("feature_id", "run_id", "precursor_id").agg(*[F.max(c).alias(c) for c in ("exp_rt", "norm_rt", "delta_rt", "exp_im", "left_width", "right_width")])
    rows = rows.join(facts, "precursor_id").withColumn("assay_rt", F.col("exp_rt") - F.col("delta_rt"))
    if "library_rt" in rows.columns:
        rows = rows.withColumn("delta_irt", F.col("norm_rt") - F.col("library_rt"))
    if not limits.decoys:
        rows = rows.where("decoy = 0")
    if scores is None:
        return rows
    told = rows.join(best_scores(scores), "feature_id")
    if recompute_rank:
        order = Window.partitionBy("run_id", "precursor_id").orderBy(F.col("score").desc(), "feature_id")
        told = told.withColumn("rank", F.row_number().over(order))
    for column, limit in (("qvalue", limits.qvalue), ("pep", limits.pep)):
        if limit is not None:
            told = told.where(F.col(column) < limit)
    return told if limits.rank is None else told.where(F.col("rank") <= limits.rank)


def fragment_strings(fragments: DataFrame, transitions: DataFrame | None = None, scores: DataFrame | None = None, max_pep: float | None = None) -> DataFrame:
    """Per feature the areas, apexes and annotations of its fragments as lists joined by ``;`` in the order of transition ids."""
    rows = fragments.where("transition_id IS NOT NULL AND feature_id IS NOT NULL").groupBy("feature_id", "transition_id").agg(F.max("area_intensity").alias("area"), F.max("apex_intensity").alias("apex"))
    if scores is not None and max_pep is not None:
        good = scores.where(F.col("pep") < max_pep).select("feature_id", "transition_id").distinct()
        rows = rows.join(good, ["feature_id", "transition_id"], "left_semi")
    if transitions is not None:
        names = transitions.groupBy(F.col("id").alias("transition_id")).agg(F.max(F.coalesce("annotation", F.concat("type", "ordinal"))).alias("annotation"))
        rows = rows.join(names, "transition_id", "left")
    else:
        rows = rows.withColumn("annotation", F.col("transition_id").cast("string"))
    # A feature has as many fragments as its assay; the list is bounded by it.
    ordered = rows.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("transition_id", "area", "apex", "annotation"))).alias("_f"))
    text = lambda c: F.array_join(F.transform("_f", lambda x: F.coalesce(x[c].cast("string"), F.lit("NA"))), ";")
    return ordered.select("feature_id", text("area").alias("aggr_peak_area"), text("apex").alias("aggr_peak_apex"), text("annotation").alias("aggr_fragment_annotation"))


def entity_qvalues(rows: DataFrame, context_scores: DataFrame, entity: str, name: str, limit: float | None, inner: bool = True) -> DataFrame:
    """``rows`` with the least run-bound and global q-value of an entity as ``<name>_run_specific``, ``_experiment_wide``, ``_global``.

    With ``limit`` only rows whose global q-value is below it stay; ``inner=False`` keeps rows that have none. ``context_scores`` has
    readable contexts (``entity_id, run_id`` 0 for global, ``context, qvalue``).
    """
    least = lambda c: F.min(F.when(F.col("context") == c, F.col("qvalue")))
    by_run = context_scores.where("context <> 'global'").groupBy(F.col("entity_id").alias("_e"), F.col("run_id").alias("_r")).agg(least("run-specific").alias(f"{name}_run_specific"), least("experiment-wide").alias(f"{name}_experiment_wide"))
    overall = context_scores.where("context = 'global'").groupBy(F.col("entity_id").alias("_g")).agg(F.min("qvalue").alias(f"{name}_global"))
    if limit is not None:
        overall = overall.where(F.col(f"{name}_global") < limit)
    met = rows.join(by_run, (F.col(entity) == F.col("_e")) & (F.col("run_id") == F.col("_r")), "left").drop("_e", "_r")
    return met.join(overall, F.col(entity) == F.col("_g"), "inner" if inner else "left").drop("_g")


def long_export(tables: Mapping[str, DataFrame], limits: Thresholds = Thresholds(), inner: bool = True) -> DataFrame:
    """The standard long table: identified features of peptides with fragments and peptide error rates.

    ``tables``: feature, precursor, score_ms2, precursor_peptide_mapping, peptide, and where present feature_transition, transition, run (``filename``),
    feature_ms1 (``aggr_prec_*``), peptide_protein_mapping and protein (accessions joined by ``;``), peptide_gene_mapping and gene (names likewise),
    ``ipf`` (feature_id, peptide_id, pep, joined to the sequences) and, as ``operators.eav.context_rows`` gives them, ``peptide_contexts`` and
    ``protein_contexts``. Of a peptide's proteins the one with the least q-value speaks for it. ``tables`` with ``alignment`` add features aligned
    to identified ones.
    """
    rows = identified(tables["feature"], tables["precursor"], tables["score_ms2"], limits)
    mapping = tables["precursor_peptide_mapping"].where("peptide_id IS NOT NULL").select("precursor_id", "peptide_id").distinct()
    peptides = tables["peptide"].groupBy(F.col("id").alias("peptide_id")).agg(F.max("unmodified_sequence").alias("sequence"), F.max("modified_sequence").alias("full_peptide_name"))
    rows = rows.join(mapping, "precursor_id").join(peptides, "peptide_id")
    if "feature_transition" in tables:
        rows = rows.join(fragment_strings(tables["feature_transition"], tables.get("transition")), "feature_id", "left")
    if "run" in tables:
        rows = rows.join(tables["run"].select(F.col("id").alias("run_id"), "filename").distinct(), "run_id", "left")
    if "feature_ms1" in tables:
        ms1 = tables["feature_ms1"].groupBy("feature_id").agg(F.max("area_intensity").alias("aggr_prec_peak_area"), F.max("apex_intensity").alias("aggr_prec_peak_apex"))
        rows = rows.join(ms1, "feature_id", "left")
    for entity, text in (("protein", "protein_accession"), ("gene", "gene_name")):
        if f"peptide_{entity}_mapping" in tables and entity in tables:
            rows = rows.join(entity_lists(tables[f"peptide_{entity}_mapping"], tables[entity], entity, text), "peptide_id", "left")
    if "ipf" in tables:
        from quantloom.operators.reads import with_peptidoforms

        named = tables["peptide"].groupBy(F.col("id").alias("peptide_id")).agg(F.max("modified_sequence").alias("modified_sequence")).where("modified_sequence IS NOT NULL")
        rows = with_peptidoforms(rows, tables["ipf"], named)
    if "alignment" in tables:
        rows = with_aligned(rows, tables["alignment"], _unfiltered(tables, limits))
    if "peptide_contexts" in tables:
        rows = entity_qvalues(rows, tables["peptide_contexts"], "peptide_id", "m_score_peptide", limits.peptide_qvalue, inner)
    if "protein_contexts" in tables and "peptide_protein_mapping" in tables:
        rows = entity_qvalues(rows, per_item(tables["protein_contexts"], tables["peptide_protein_mapping"], "peptide_id", "protein_id"), "peptide_id", "m_score_protein", limits.protein_qvalue, inner)
    return rows


def _unfiltered(tables: Mapping[str, DataFrame], limits: Thresholds) -> DataFrame:
    """All scored features with their peptides, without cutoffs: the candidates of the alignment."""
    free = Thresholds(qvalue=None, pep=None, rank=None, decoys=limits.decoys)
    mapping = tables["precursor_peptide_mapping"].where("peptide_id IS NOT NULL").select("precursor_id", "peptide_id").distinct()
    peptides = tables["peptide"].groupBy(F.col("id").alias("peptide_id")).agg(F.max("unmodified_sequence").alias("sequence"), F.max("modified_sequence").alias("full_peptide_name"))
    return identified(tables["feature"], tables["precursor"], tables["score_ms2"], free).join(mapping, "precursor_id").join(peptides, "peptide_id")


def per_item(contexts: DataFrame, mapping: DataFrame, item: str, entity: str) -> DataFrame:
    """Context rows of entities as those of their items: of an item's entities the least q-value per run and context."""
    pairs = mapping.where(F.col(item).isNotNull() & F.col(entity).isNotNull()).select(F.col(item).alias("_item"), F.col(entity).alias("entity_id")).distinct()
    return contexts.join(pairs, "entity_id").groupBy(F.col("_item").alias("entity_id"), "run_id", "context").agg(F.min("qvalue").alias("qvalue"))


def entity_lists(mapping: DataFrame, entities: DataFrame, entity: str, text: str) -> DataFrame:
    """``peptide_id`` and the names of its proteins or genes joined by ``;`` in alphabetical order (a peptide has few)."""
    pairs = mapping.where(F.col("peptide_id").isNotNull()).select("peptide_id", f"{entity}_id").distinct()
    named = pairs.join(entities.select(F.col("id").alias(f"{entity}_id"), text).where(F.col(text).isNotNull()).distinct(), f"{entity}_id")
    return named.groupBy("peptide_id").agg(F.array_join(F.array_sort(F.collect_set(text)), ";").alias(text))


def with_aligned(rows: DataFrame, alignment: DataFrame, base: DataFrame, max_pep: float = 0.7) -> DataFrame:
    """``rows`` and, flagged ``from_alignment``, features of ``base`` that the alignment ties to an identified one with ``pep`` below the limit."""
    good = alignment.where(F.col("pep") < max_pep)
    order = Window.partitionBy("feature_id").orderBy("qvalue", "reference_feature_id")
    best = good.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("feature_id", "reference_feature_id")
    anchored = best.join(rows.select(F.col("feature_id").alias("reference_feature_id")).distinct(), "reference_feature_id", "left_semi")
    extra = base.join(anchored, "feature_id")
    return aligned_recovery(rows.join(best, "feature_id", "left"), extra, "feature_id")


def score_report(rows: DataFrame, contexts: DataFrame, entity: str) -> DataFrame:
    """The minimal projection behind scored reports: per run, entity and context the scores and q-values."""
    known = rows.select("run_id", entity).distinct()
    told = contexts.select(F.col("entity_id").alias(entity), "run_id", "context", "score", "qvalue")
    bound = told.where("context <> 'global'").join(known, ["run_id", entity], "left_semi")
    return bound.unionByName(told.where("context = 'global'").join(known.select(entity).distinct(), entity, "left_semi").select(*bound.columns))


def feature_scores(features: DataFrame, measures: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Feature id, run, decoy-free score columns of the best-ranked features: the input of score plots."""
    columns = [c for c in measures.columns if c.lower().startswith(("var_", "main_"))]
    rows = features.select(F.col("id").alias("feature_id"), "run_id", "precursor_id").distinct().join(measures.select("feature_id", *columns).distinct(), "feature_id")
    if scores is not None:
        rows = rows.join(scores.where("rank = 1").select("feature_id").distinct(), "feature_id", "left_semi")
    return rows


def compounds(features: DataFrame, compound_map: DataFrame, compound: DataFrame, scores: DataFrame | None, max_qvalue: float = 0.05) -> DataFrame:
    """Long table of small molecules: feature, compound name, formula and adduct; q-values below the limit where there are scores."""
    names = compound.select(F.col("id").alias("compound_id"), "compound_name", "sum_formula", "adducts")
    rows = features.join(compound_map.select("precursor_id", "compound_id").distinct(), "precursor_id").join(names, "compound_id")
    return rows if scores is None else rows.join(scores.where(F.col("qvalue") < max_qvalue).select(F.col("feature_id").alias("id"), "qvalue", "rank"), "id")


def glycoforms(features: DataFrame, candidates: DataFrame, match: str = "composition") -> DataFrame:
    """Feature and candidate glycopeptides of one peptide whose glycans agree: ``exact`` structure, ``composition``, or ``any``.

    ``features``: feature_id, peptide_id, glycan_struct, glycan_composition; ``candidates``: peptide_id, candidate_id, candidate_struct, candidate_composition.
    """
    met = features.join(candidates, "peptide_id")
    rules = {"exact": F.col("glycan_struct") == F.col("candidate_struct"), "composition": F.col("glycan_composition") == F.col("candidate_composition"), "any": F.lit(True)}
    return met.where(rules[match])


def protein_lists(mapping: DataFrame, proteins: DataFrame, item: str = "peptide_id", only_unique: bool = False) -> DataFrame:
    """Accessions of each item joined by ``;`` in the order of ids (mappings of an item are few)."""
    pairs = unique_partner(mapping, item, "protein_id") if only_unique else mapping.where("protein_id IS NOT NULL").select(item, "protein_id").distinct()
    named = pairs.join(proteins.select(F.col("id").alias("protein_id"), "protein_accession").distinct(), "protein_id")
    return named.groupBy(item).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("protein_id", "protein_accession"))), lambda x: x["protein_accession"]), ";").alias("protein_accession"))


def filter_chromatograms(chromatograms: DataFrame, precursors: DataFrame, keep: Sequence[str] | None = None, scores: DataFrame | None = None, max_pep: float | None = None) -> DataFrame:
    """Chromatograms of given peptides (by group label) or of precursors with an error probability below the limit."""
    ids = precursors.select(F.col("id").alias("precursor_id"), "group_label").distinct()
    if keep is not None:
        ids = ids.where(F.col("group_label").isin(list(keep)))
    if scores is not None and max_pep is not None:
        ids = ids.join(scores.where(F.col("pep") <= max_pep).select("precursor_id").distinct(), "precursor_id", "left_semi")
    return chromatograms.join(ids.select("precursor_id").distinct(), "precursor_id", "left_semi")
