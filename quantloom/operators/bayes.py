"""Bayesian inference over hypotheses: priors times products of evidence, normalised within each feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.runtime import written


def precursor_model(rows: DataFrame) -> DataFrame:
    """Rows ``feature_id, prior, evidence, hypothesis`` (true and false) for MS1 and MS2 precursor evidence.

    The prior is the peak group's; a missing error probability gives no evidence row, and a feature without
    any gives evidence 0 for true and 1 for false.
    """
    peps = F.array("ms1_precursor_pep", "ms2_precursor_pep")
    known = F.filter(peps, lambda x: x.isNotNull())
    known = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(1.0)))
    long = rows.select("feature_id", "ms2_peakgroup_pep", F.explode(known).alias("pep"))
    sides = F.array(
        F.struct((1 - F.col("ms2_peakgroup_pep")).alias("prior"), (1 - F.col("pep")).alias("evidence"), F.lit(True).alias("hypothesis")),
        F.struct(F.col("ms2_peakgroup_pep").alias("prior"), F.col("pep").alias("evidence"), F.lit(False).alias("hypothesis")),
    )
    return long.select("feature_id", F.inline(sides))


def transition_model(rows: DataFrame) -> DataFrame:
    """Rows ``feature_id, prior, evidence, hypothesis`` of peptidoform hypotheses (``peptide_id``; -1 = none of them).

    ``rows``: feature_id, peptide_id, pep (of the transition), bmask (1 if the peptidoform explains it), num_peptidoforms,
    precursor_peakgroup_pep.
    """
    prior = F.when(F.col("peptide_id") == -1, F.col("precursor_peakgroup_pep")).otherwise((1 - F.col("precursor_peakgroup_pep")) / F.col("num_peptidoforms"))
    evidence = F.when(F.col("bmask") == 1, 1 - F.col("pep")).otherwise(F.col("pep"))
    return rows.select("feature_id", prior.alias("prior"), evidence.alias("evidence"), F.col("peptide_id").alias("hypothesis"))


def clipped(evidence: Column, eps: float | None) -> Column:
    return F.least(F.greatest(evidence, F.lit(eps)), F.lit(1 - eps)) if eps else evidence


def posteriors(model: DataFrame, keys: Sequence[str] = ("feature_id",), log_space: bool = False, eps: float | None = None) -> DataFrame:
    """``keys, hypothesis, likelihood_prior, likelihood_sum, posterior``: product of evidence times the least prior, normalised per key.

    Raw products may underflow to 0, which gives posterior 0; ``log_space`` keeps them apart. Null evidence is skipped.
    """
    evidence = clipped(F.col("evidence"), eps)
    own = Window.partitionBy(*keys)  # as many rows as a feature has hypotheses
    if not log_space:
        each = model.groupBy(*keys, "hypothesis").agg((F.product(evidence) * F.min("prior")).alias("likelihood_prior"))
        told = each.withColumn("likelihood_sum", F.sum("likelihood_prior").over(own))
        return told.withColumn("posterior", F.coalesce(F.try_divide("likelihood_prior", "likelihood_sum"), F.lit(0.0)))
    log_sum = F.sum(F.when(evidence > 0, F.log(evidence)).otherwise(0.0))
    zero = F.max((evidence <= 0).cast("int")) == 1
    each = model.groupBy(*keys, "hypothesis").agg(F.when(zero | (F.min("prior") <= 0), F.lit(None)).otherwise(log_sum + F.log(F.min("prior"))).alias("_log"))
    shifted = each.withColumn("_top", F.max("_log").over(own)).withColumn("_w", F.coalesce(F.exp(F.col("_log") - F.col("_top")), F.lit(0.0)))
    told = shifted.withColumn("_sum", F.sum("_w").over(own))
    return told.select(
        *keys,
        "hypothesis",
        F.coalesce(F.exp("_log"), F.lit(0.0)).alias("likelihood_prior"),
        F.coalesce(F.exp("_top") * F.col("_sum"), F.lit(0.0)).alias("likelihood_sum"),
        F.coalesce(F.try_divide("_w", "_sum"), F.lit(0.0)).alias("posterior"),
    )


def precursor_inference(rows: DataFrame, max_pep: float = 0.4) -> DataFrame:
    """``feature_id, precursor_peakgroup_pep`` below ``max_pep``: one minus the posterior of the true hypothesis."""
    found = posteriors(precursor_model(rows)).where("hypothesis").select("feature_id", (1 - F.col("posterior")).alias("precursor_peakgroup_pep"))
    return found.where(F.col("precursor_peakgroup_pep") < max_pep)


def peptidoform_inference(transitions: DataFrame, precursors: DataFrame, grouped_fdr: bool = False, log_space: bool = False, eps: float | None = None) -> DataFrame:
    """``feature_id, peptide_id, precursor_peakgroup_pep, qvalue, pep`` of every peptidoform hypothesis but the null one.

    ``transitions`` may bring their own ``precursor_peakgroup_pep`` (after evidence was shared between runs); else that of ``precursors`` is taken.
    """
    from quantloom.operators.stats import model_fdr

    met = transitions if "precursor_peakgroup_pep" in transitions.columns else transitions.join(precursors, "feature_id")
    found = posteriors(transition_model(met), log_space=log_space, eps=eps)
    forms = met.groupBy("feature_id").agg(F.min("num_peptidoforms").alias("num_peptidoforms"))
    told = found.join(forms, "feature_id").join(precursors.select("feature_id", "precursor_peakgroup_pep"), "feature_id").withColumn("pep", 1 - F.col("posterior"))
    told = told.where("hypothesis <> -1")
    told = model_fdr(told, "pep", ("num_peptidoforms",) if grouped_fdr else (), "qvalue")
    return told.select("feature_id", F.col("hypothesis").alias("peptide_id"), "precursor_peakgroup_pep", "qvalue", "pep")


def support_metrics(transitions: DataFrame, intensities: DataFrame | None = None) -> DataFrame:
    """Per feature and peptidoform: how many transitions support it, alone and with phospho loss, and their median isotope overlap."""
    forms = transitions.where("peptide_id <> -1")
    has = lambda c: F.col(c) if c in transitions.columns else F.lit(None)
    support = F.col("bmask") == 1
    flag = lambda cond: F.coalesce((support & cond).cast("int"), F.lit(0))
    once = forms.select("feature_id", "peptide_id", "transition_id", "bmask", *[c for c in ("n_mapped_peptides", "has_phospho_loss", "isotope_overlap_score") if c in transitions.columns]).distinct()
    # One row per transition first: plain sums then count distinct transitions, without a copy of the rows per count.
    per = once.groupBy("feature_id", "peptide_id", "transition_id").agg(
        F.max(flag(F.lit(True))).alias("_s"),
        F.max(flag(has("n_mapped_peptides") == 1)).alias("_u"),
        F.max(flag(has("has_phospho_loss") == 1)).alias("_l"),
        F.collect_list(F.when(support, has("isotope_overlap_score").cast("double"))).alias("_o"),
    )
    told = per.groupBy("feature_id", "peptide_id").agg(
        F.sum("_s").alias("supporting_transitions"),
        F.sum("_u").alias("unique_supporting_transitions"),
        F.sum("_l").alias("phospho_loss_supporting_transitions"),
        F.flatten(F.collect_list("_o")).alias("_all"),
    )
    ordered, n = F.array_sort("_all"), F.size("_all")
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    told = told.withColumn("median_supporting_isotope_overlap", F.when(n > 0, median)).drop("_all")
    return told if intensities is None else told.join(intensities.select("feature_id", "feature_ms2_intensity").distinct(), "feature_id", "left")


def support_filter(
    metrics: DataFrame,
    min_supporting: int = 0,
    min_unique: int = 0,
    phospho_loss_below: int = 0,
    min_intensity: float = 0.0,
    conditional_intensity: float = 0.0,
    conditional_max_supporting: int = 0,
    conditional_no_loss_only: bool = False,
) -> DataFrame:
    """Rows of ``support_metrics`` that pass all thresholds in use (0: not in use); few transitions may be made up for by phospho loss or intensity."""
    n, loss = F.coalesce("supporting_transitions", F.lit(0)), F.coalesce("phospho_loss_supporting_transitions", F.lit(0))
    keep = F.lit(True)
    if min_supporting > 0:
        keep = keep & (n >= min_supporting)
    if min_unique > 0:
        keep = keep & (F.coalesce("unique_supporting_transitions", F.lit(0)) >= min_unique)
    if phospho_loss_below > 0:
        keep = keep & ((n >= phospho_loss_below) | (loss > 0))
    if min_intensity > 0:
        keep = keep & F.coalesce(F.col("feature_ms2_intensity") >= min_intensity, F.lit(False))
    if conditional_intensity > 0:
        if conditional_max_supporting <= 0:
            raise ValueError("a conditional intensity needs a number of transitions that counts as weak support")
        weak = (n <= conditional_max_supporting) & ((loss == 0) if conditional_no_loss_only else F.lit(True))
        keep = keep & (~weak | F.coalesce(F.col("feature_ms2_intensity") >= conditional_intensity, F.lit(False)))
    return metrics.where(keep)


def propagated(evidence: DataFrame, threshold: float, columns: Sequence[str] = (), values: Sequence[str] = ("pep", "precursor_peakgroup_pep")) -> DataFrame:
    """Transition evidence in which aligned features share confident evidence.

    A feature gets, beside its own rows, the rows of its alignment group with ``pep`` up to ``threshold``, their number of
    peptidoforms included; rows of one feature that agree in transition, peptidoform, mask, number of peptidoforms and ``columns`` become one with
    the least of each of ``values``. ``evidence`` has feature_id, alignment_group_id, is_aligned (a flag of its own) and all these;
    features that are not aligned pass unchanged. Confident rows are reduced to one per group and item before they meet the features.
    What a feature gets is a multiple of its own rows and is never shuffled, sorted or aggregated: confident items of a group are numbered,
    own rows take over the number and the least values of theirs, and a feature that knows its numbers gets all others straight from the join.
    """
    item = ["transition_id", "peptide_id", "bmask", "num_peptidoforms", *columns]
    values = [v for v in values if v in evidence.columns]
    least = [F.min(v).alias(v) for v in values]
    key = ["alignment_group_id", "_item"]  # as one field, so that missing parts of an item are equal and the join's partitions serve the aggregate after it
    aligned = evidence.where("is_aligned").withColumn("_item", F.struct(*item))
    best = aligned.where((F.col("pep") <= threshold) & F.col("alignment_group_id").isNotNull()).groupBy(*key).agg(*least)
    best = written(best.withColumn("_id", F.row_number().over(Window.partitionBy("alignment_group_id").orderBy("_item"))))
    theirs = best.select(*key, "_id", *[F.col(v).alias(f"_best_{v}") for v in values])
    same_type = F.col("_item").cast(best.schema["_item"].dataType).alias("_item")  # else the join casts its keys, and the aggregate shuffles once more
    met = aligned.select("alignment_group_id", same_type, "feature_id", *values).join(theirs, key, "left").groupBy(*key, "feature_id")
    own = written(met.agg(F.min("_id").alias("_id"), *[F.least(F.min(v), F.min(f"_best_{v}")).alias(v) for v in values]))
    members = own.repartition("alignment_group_id", "feature_id").groupBy("alignment_group_id", "feature_id").agg(F.collect_list("_id").alias("_own"))
    others = members.join(best, "alignment_group_id").where(~F.array_contains("_own", F.col("_id")))
    told = ["alignment_group_id", "feature_id", *[F.col(f"_item.{c}").alias(c) for c in item], *values]
    return evidence.where("NOT is_aligned").select("alignment_group_id", "feature_id", *item, *values).unionByName(own.select(*told)).unionByName(others.select(*told))
