"""The steps of an analysis over a feature store of parquet tables: score, infer, export, and operations on whole stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import bayes, eav, export, files, learn, quant, relational, report, stats
from quantloom.sources import paths, readers, writers

TABLES = ("run", "feature", "feature_ms1", "feature_ms2", "feature_transition", "precursor", "precursor_peptide_mapping", "peptide", "peptide_protein_mapping", "protein", "peptide_gene_mapping", "gene", "transition", "score_ms2", "score_peptide", "score_protein", "score_gene", "score_transition")


def load(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The tables of a store: a folder with one ``<name>.parquet`` per table, or any file the readers know."""
    if paths.is_dir(store):
        found = {n: readers.read_parquet(spark, f"{store}/{n}.parquet") for n in TABLES if paths.exists(f"{store}/{n}.parquet")}
        if found:
            return found
    return readers.read_store(spark, store)


def save(tables: dict[str, DataFrame], store: str) -> None:
    for name, df in tables.items():
        writers.write_parquet(df, f"{store}/{name}.parquet")


def score(table: DataFrame, group: str = "group_id", decoy: str = "decoy", ties: Sequence[str] = (), main: str | None = None, classifier: str = "lda", folds: int = 10, rounds: int = 10, fraction: float = 1.0, weights: DataFrame | None = None, level: str = "ms2", local_fdr: bool = True, tune: bool = False, columns: Sequence[str] | None = None, meta: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Scored rows and weights. With ``weights`` the stored model is applied; with ``fraction`` below 1 it is learnt on
    the groups of that share (by hash) and applied to all rows. ``classifier``: ``lda``, ``svm`` or ``trees`` (see ``learn_model``)."""
    data = learn.prepare(table, group, decoy, ties, main, columns, meta=meta)
    if weights is not None:
        model = learn.LinearModel.from_table(weights, level, data.columns)
    else:
        model = learn_model(data, classifier, folds, rounds, fraction, tune, meta)
    importance = model.table(table.sparkSession, level) if isinstance(model, learn.LinearModel) else tree_importance(model, data.columns, table.sparkSession, level)
    return learn.apply(data, model, local_fdr=local_fdr), importance


def learn_model(data: learn.Prepared, classifier: str = "lda", folds: int = 10, rounds: int = 10, fraction: float = 1.0, tune: bool = False, meta: Sequence[str] = ()) -> learn.Model:
    """The semi-supervised model: averaged discriminants, or support vectors or trees fitted on cross-validated scores; with ``tune`` their settings
    are searched first, on the training set that the main score chooses."""
    sample = data if fraction >= 1 else learn.Prepared(relational.hash_sample(data.rows, "group", fraction), data.columns, data.main, data.ties)
    if classifier == "lda" and not meta:
        return learn.learn(sample, folds, rounds)
    fits = {"lda": (learn.fit_lda, None), "svm": (learn.fit_svm, learn.tune_svm), "trees": (learn.fit_boosted, learn.tune_trees)}
    if classifier not in fits:
        raise ValueError(f"unknown classifier {classifier}")
    fit, search = fits[classifier]
    if tune and search is not None:
        first = learn.training_set(sample.rows.withColumn("score", F.col(f"`{data.main}`")), data.ties, 0.15, meta=meta)
        settings = search(first, data.columns)
        plain, fit = fit, lambda rows, names: plain(rows, names, **settings)
    return learn.learn_final(sample, fit, folds, rounds, meta=meta)


def tree_importance(model: learn.TreeModel, columns: Sequence[str], spark: SparkSession, level: str) -> DataFrame:
    """The part each column has in the trees' gain, in the form of a table of weights."""
    gains = model.pipeline.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(g), level) for c, g in zip(columns, gains)], "score string, weight double, level string")


def choose_main_score(data: learn.Prepared, candidates: Sequence[str] | None = None, fdr: float = 0.15) -> str:
    """The candidate column by itself whose numbers of best targets at ``fdr`` and of best decoys are closest."""
    gaps = {}
    for c in candidates or data.columns:
        chosen = learn.training_set(data.rows.withColumn("score", F.col(f"`{c}`")), data.ties, fdr)
        counts = {r["decoy"]: r["count"] for r in chosen.groupBy("decoy").count().collect()}
        gaps[c] = abs(counts.get(1, 0) - counts.get(0, 0))
    return min(gaps, key=lambda c: (gaps[c], c))


def infer_entities(rows: DataFrame, entity: str, context: str, score_column: str = "score", run: str = "run_id", ties: Sequence[str] = ("feature_id",), lambdas=0.4, local_fdr: bool = True, parametric: bool = False, pfdr: bool = False, method: str = "bootstrap") -> DataFrame:
    """Error control of entities in one context: ``global`` (best of all runs), ``experiment-wide`` (best per run, one model), ``run-specific`` (a model per run).

    Returns ``context, run_id, <entity>, decoy, score`` and p-, s-, q-value and PEP, for decoys as for targets those of the nearest score in the table.
    """
    if context not in ("global", "experiment-wide", "run-specific"):
        raise ValueError(f"unknown context {context}")
    groups = [entity] if context == "global" else [entity, run]
    keys = (run,) if context == "run-specific" else ()
    best = stats.best_per_group(rows, groups, score_column, ties)
    table = stats.error_table(best, score_column, "decoy", keys, lambdas, method, pfdr, local_fdr, parametric)
    names = ["pvalue", "svalue", "qvalue", *(["pep"] if local_fdr else [])]
    told = stats.nearest(best, score_column, table.select(*keys, "cutoff", *names), "cutoff", keys).drop("cutoff")
    run_column = F.lit(None).cast("long") if context == "global" else F.col(run)
    return told.select(F.lit(context).alias("context"), run_column.alias("run_id"), entity, "decoy", F.col(score_column).alias("score"), *names)


def infer_peptidoforms(precursors: DataFrame, transitions: DataFrame, max_precursor_pep: float = 0.4, alignment: DataFrame | None = None, propagate_pep: float = 0.5, grouped_fdr: bool = False, log_space: bool = False, eps: float | None = None, **filters) -> DataFrame:
    """Peptidoform error rates per feature. ``alignment`` (feature_id, alignment_group_id) lets aligned features share confident evidence;
    ``filters`` are those of ``bayes.support_filter``."""
    prepared = bayes.precursor_inference(precursors, max_precursor_pep)
    if alignment is not None:  # priors of the precursors are shared along with the evidence
        grouped = transitions.join(prepared, "feature_id").join(alignment.select("feature_id", "alignment_group_id"), "feature_id", "left").withColumn("is_aligned", F.col("alignment_group_id").isNotNull())
        extra = [c for c in ("n_mapped_peptides", "has_phospho_loss", "isotope_overlap_score") if c in transitions.columns]
        transitions = bayes.propagated(grouped, propagate_pep, extra).drop("alignment_group_id")
    found = bayes.peptidoform_inference(transitions, prepared, grouped_fdr, log_space, eps)
    if not filters:
        return found
    kept = bayes.support_filter(bayes.support_metrics(transitions, precursors if "feature_ms2_intensity" in precursors.columns else None), **filters)
    return found.join(kept.select("feature_id", "peptide_id"), ["feature_id", "peptide_id"], "left_semi")


def export_tsv(tables: dict[str, DataFrame], limits: export.Thresholds = export.Thresholds()) -> DataFrame:
    contexts = {f"{e}_contexts": eav.context_rows(tables[f"score_{e}"], f"{e}_id") for e in ("peptide", "protein") if f"score_{e}" in tables}
    return export.long_export(tables | contexts, limits)


def export_matrix(rows: DataFrame, level: str, runs: Sequence, top: int = 3, consistent: bool = True, normalise: str = "none") -> DataFrame:
    """A matrix of ``precursor``, ``peptide``, ``protein`` or ``gene`` by run from rows (feature_id, run_id, precursor_id, qvalue, intensity, from the
    peptide level on peptide_id, and <level>_id as one id or an array of ids)."""
    best = quant.best_peak_groups(rows, ["run_id", "precursor_id"], "qvalue", ["feature_id"])
    if normalise == "median":
        best = quant.median_normalised(best, "run_id", "intensity")
    elif normalise == "quantile":
        best = quant.quantile_normalised(best, "run_id", "intensity", ["precursor_id"])
    elif normalise != "none":
        raise ValueError(f"unknown normalisation {normalise}")
    if level == "precursor":
        return quant.pivoted(best, ["precursor_id"], "run_id", "intensity", runs)
    key = f"{level}_id"
    if level == "peptide":
        chosen = quant.top_items(best, key, "precursor_id", "run_id", "intensity", top, consistent)
        return quant.pivoted(chosen, [key], "run_id", "intensity", runs)
    return quant.pivoted(quant.summarised(best, key, "peptide_id", "precursor_id", "run_id", "intensity", top, consistent), [key], "run_id", "intensity", runs)


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Identifications below 1, 5 and 10 % per run and in all."""
    rows = tables["feature"].select(F.col("id").alias("feature_id"), "run_id", "precursor_id").distinct().join(export.best_scores(tables["score_ms2"]), "feature_id")
    return report.id_counts(rows, "run_id", "precursor_id", "qvalue")


def subsample(tables: dict[str, DataFrame], share: float, seed: int = 42) -> dict[str, DataFrame]:
    """All rows of a share of the precursors (by hash, the same in every store)."""
    return files.subset(tables, relational.hash_sample(tables["feature"].where("precursor_id IS NOT NULL"), "precursor_id", share, seed))


def reduce(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    features, scores = files.reduced(tables["feature"], tables["score_ms2"])
    return {"feature": features, "score_ms2": scores}


def merge(stores: Sequence[dict[str, DataFrame]], same_run: int | None = None) -> dict[str, DataFrame]:
    """One store of all rows; library tables, which repeat, are kept once. With ``same_run`` all rows that name a run name that one, in every table."""
    library = ("precursor", "precursor_peptide_mapping", "peptide", "peptide_protein_mapping", "protein", "peptide_gene_mapping", "gene", "transition")
    out = {}
    for name in dict.fromkeys(n for s in stores for n in s):
        parts = [s[name] for s in stores if name in s]
        merged = files.merge_runs(parts)
        if same_run is not None:
            merged = files.in_one_run(merged, same_run, name)
        out[name] = merged.distinct() if name in library else merged
    return out


def split(tables: dict[str, DataFrame], folder: str) -> None:
    """The features of each run, and all that hangs on them, in a partition of its own; one job per table."""
    runs = tables["feature"].select(F.col("id").alias("feature_id"), F.col("run_id").alias("_run")).distinct()
    for name, df in tables.items():
        if "run_id" in df.columns:
            writers.write_parquet(df, f"{folder}/{name}.parquet", ["run_id"])
        elif "feature_id" in df.columns:
            writers.write_parquet(df.join(runs, "feature_id").withColumnRenamed("_run", "run_id"), f"{folder}/{name}.parquet", ["run_id"])
        else:
            writers.write_parquet(df, f"{folder}/{name}.parquet")


def keep(tables: dict[str, DataFrame], runs: Sequence[int] | None = None, peptides: Sequence[str] | None = None, peptide_qvalue: float | None = None, ms2_qvalue: float | None = None, decoys: bool = True, protein_qvalue: float | None = None, gene_qvalue: float | None = None) -> dict[str, DataFrame]:
    """A store cut to features that pass all filters in use, with its dependants."""
    features = tables["feature"]
    if runs is not None:
        features = features.where(F.col("run_id").isin(list(runs)))
    if not decoys:
        features = features.join(tables["precursor"].where("decoy = 0").select(F.col("id").alias("precursor_id")).distinct(), "precursor_id", "left_semi")
    if ms2_qvalue is not None:
        good = tables["score_ms2"].where(F.col("qvalue") < ms2_qvalue).select(F.col("feature_id").alias("id")).distinct()
        features = features.join(good, "id", "left_semi")
    wanted = None
    if peptides is not None:
        wanted = tables["peptide"].where(F.col("unmodified_sequence").isin(list(peptides)) | F.col("modified_sequence").isin(list(peptides))).select(F.col("id").alias("peptide_id"))
    if peptide_qvalue is not None:
        good = tables["score_peptide"].where(F.col("qvalue") < peptide_qvalue).select("peptide_id").distinct()
        wanted = good if wanted is None else wanted.join(good, "peptide_id", "left_semi")
    for entity, limit in (("protein", protein_qvalue), ("gene", gene_qvalue)):
        if limit is not None:
            good = tables[f"score_{entity}"].where(F.col("qvalue") < limit).select(f"{entity}_id").distinct()
            of = tables[f"peptide_{entity}_mapping"].join(good, f"{entity}_id", "left_semi").select("peptide_id").distinct()
            wanted = of if wanted is None else wanted.join(of, "peptide_id", "left_semi")
    if wanted is not None:
        mapped = tables["precursor_peptide_mapping"].join(wanted.distinct(), "peptide_id", "left_semi").select("precursor_id").distinct()
        features = features.join(mapped, "precursor_id", "left_semi")
    return files.subset(tables, features)
