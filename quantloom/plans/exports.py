"""Queries of exports over the feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import eav, export
from quantloom.plans.records import _CELLS_SQL
from quantloom.plans.registry import Registry
from quantloom.runtime import table

QUERIES = Registry()

_FACTS = "SELECT id AS precursor_id, arg_max(charge, loaded_at) AS charge, arg_max(decoy, loaded_at) AS decoy FROM precursor GROUP BY id"
_SCORED = "SELECT feature_id, max(score) AS score, arg_max(qvalue, struct_pack(a := score, b := loaded_at)) AS qvalue FROM score_ms2 WHERE feature_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1"
_IDENTIFIED = f"""SELECT * FROM (SELECT feature_id, f.run_id, f.precursor_id, charge, score, qvalue, row_number() OVER (PARTITION BY run_id, precursor_id ORDER BY score DESC, feature_id)::int AS rank
 FROM (SELECT DISTINCT id AS feature_id, run_id, precursor_id FROM feature WHERE id IS NOT NULL AND precursor_id IS NOT NULL) f JOIN ({_FACTS}) p USING (precursor_id) JOIN ({_SCORED}) s USING (feature_id) WHERE decoy = 0)
WHERE qvalue < 0.05 AND rank <= 1"""


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in ("feature", "precursor", "score_ms2", "precursor_peptide_mapping", "peptide", "feature_transition", "transition")}


@QUERIES.add("identified_features", _IDENTIFIED)
def identified_features(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return export.identified(t["feature"], t["precursor"], t["score_ms2"]).select("feature_id", "run_id", "precursor_id", "charge", "score", "qvalue", "rank")


_PEPTIDE_GLOBAL = f"SELECT entity_id AS peptide_id, min(qvalue) AS m_score_peptide_global FROM ({_CELLS_SQL}) WHERE level = 'peptide' AND context = 'global' GROUP BY 1 HAVING min(qvalue) < 0.3"
_PEPTIDE_RUN = f"""SELECT entity_id AS peptide_id, run_id, min(qvalue) FILTER (context = 'run-specific') AS m_score_peptide_run_specific,
 min(qvalue) FILTER (context = 'experiment-wide') AS m_score_peptide_experiment_wide FROM ({_CELLS_SQL}) WHERE level = 'peptide' AND context <> 'global' GROUP BY 1, 2"""


@QUERIES.add(
    "long_export",
    f"""SELECT i.feature_id, i.run_id, i.precursor_id, m.peptide_id, sequence, score, i.qvalue, aggr_fragment_annotation, m_score_peptide_run_specific, m_score_peptide_experiment_wide, m_score_peptide_global
FROM ({_IDENTIFIED}) i JOIN (SELECT DISTINCT precursor_id, peptide_id FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL) m USING (precursor_id)
JOIN (SELECT id AS peptide_id, max(unmodified_sequence) AS sequence FROM peptide GROUP BY 1) p USING (peptide_id)
LEFT JOIN (SELECT feature_id, string_agg(coalesce(a, 'NA'), ';' ORDER BY transition_id) AS aggr_fragment_annotation FROM (SELECT DISTINCT feature_id, transition_id FROM feature_transition WHERE transition_id IS NOT NULL AND feature_id IS NOT NULL)
 LEFT JOIN (SELECT id AS transition_id, max(coalesce(annotation, type || ordinal)) AS a FROM transition GROUP BY 1) USING (transition_id) GROUP BY 1) t USING (feature_id)
LEFT JOIN ({_PEPTIDE_RUN}) r ON r.peptide_id = m.peptide_id AND r.run_id = i.run_id JOIN ({_PEPTIDE_GLOBAL}) g ON g.peptide_id = m.peptide_id""",
)
def long_export(spark: SparkSession, sf: str) -> DataFrame:
    contexts = eav.context_rows(table(spark, sf, "score_peptide"), "peptide_id")
    told = export.long_export(_tables(spark, sf) | {"peptide_contexts": contexts}, export.Thresholds(peptide_qvalue=0.3))
    return told.select(
        "feature_id", "run_id", "precursor_id", "peptide_id", "sequence", "score", "qvalue", "aggr_fragment_annotation",
        "m_score_peptide_run_specific", "m_score_peptide_experiment_wide", "m_score_peptide_global",
    )


@QUERIES.add(
    "score_report",
    f"""WITH k AS (SELECT DISTINCT run_id, peptide_id FROM ({_IDENTIFIED}) JOIN precursor_peptide_mapping USING (precursor_id) WHERE peptide_id IS NOT NULL)
SELECT entity_id AS peptide_id, run_id, context, score, qvalue FROM ({_CELLS_SQL}) WHERE level = 'peptide' AND (context = 'global' AND entity_id IN (SELECT peptide_id FROM k)
 OR context <> 'global' AND (run_id, entity_id) IN (SELECT (run_id, peptide_id) FROM k))""",
)
def score_report(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    rows = export.identified(t["feature"], t["precursor"], t["score_ms2"]).join(t["precursor_peptide_mapping"].where("peptide_id IS NOT NULL").select("precursor_id", "peptide_id").distinct(), "precursor_id")
    return export.score_report(rows, eav.context_rows(table(spark, sf, "score_peptide"), "peptide_id"), "peptide_id")


@QUERIES.add(
    "feature_scores_rank1",
    """SELECT DISTINCT f.feature_id, run_id, precursor_id, var_xcorr_shape, var_log_sn_score FROM (SELECT DISTINCT id AS feature_id, run_id, precursor_id FROM feature) f
JOIN feature_transition t USING (feature_id) WHERE feature_id IN (SELECT feature_id FROM score_ms2 WHERE rank = 1)""",
)
def feature_scores_rank1(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return export.feature_scores(t["feature"], t["feature_transition"].select("feature_id", "var_xcorr_shape", "var_log_sn_score"), t["score_ms2"]).distinct()


@QUERIES.add(
    "glycoform_candidates",
    """WITH g AS (SELECT DISTINCT id, group_label, charge, decoy FROM precursor), m AS (SELECT DISTINCT precursor_id, peptide_id FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL)
SELECT a.id AS feature_id, m.peptide_id, b.id AS candidate_id FROM g a JOIN m ON m.precursor_id = a.id JOIN m n ON n.peptide_id = m.peptide_id JOIN g b ON b.id = n.precursor_id WHERE a.charge = b.charge""",
)
def glycoform_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    pairs = t["precursor_peptide_mapping"].where("peptide_id IS NOT NULL").select("precursor_id", "peptide_id").distinct()
    known = t["precursor"].select("id", "group_label", F.col("charge").cast("string").alias("c"), "decoy").distinct().join(pairs, F.col("id") == F.col("precursor_id"))
    a = known.select(F.col("id").alias("feature_id"), "peptide_id", F.col("group_label").alias("glycan_struct"), F.col("c").alias("glycan_composition"))
    b = known.select(F.col("id").alias("candidate_id"), "peptide_id", F.col("group_label").alias("candidate_struct"), F.col("c").alias("candidate_composition"))
    return export.glycoforms(a, b, "composition").select("feature_id", "peptide_id", "candidate_id")


_PROTEIN_OF = "SELECT DISTINCT m.peptide_id, s.protein_id FROM (SELECT DISTINCT peptide_id, abs(peptide_id) % 97 AS h FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL) m JOIN (SELECT DISTINCT protein_id, abs(protein_id) % 97 AS h FROM score_protein WHERE protein_id IS NOT NULL) s USING (h)"


@QUERIES.add(
    "long_export_proteins",
    f"""WITH own AS ({_PROTEIN_OF}), c AS (SELECT peptide_id, run_id, context, min(qvalue) AS q FROM ({_CELLS_SQL}) x JOIN own ON own.protein_id = x.entity_id WHERE level = 'protein' GROUP BY ALL),
l AS (SELECT peptide_id, string_agg(DISTINCT 'P' || protein_id, ';' ORDER BY 'P' || protein_id) AS protein_accession FROM own GROUP BY 1)
SELECT i.feature_id, i.run_id, m.peptide_id, protein_accession, r.q AS m_score_protein_run_specific, e.q AS m_score_protein_experiment_wide, g.q AS m_score_protein_global
FROM ({_IDENTIFIED}) i JOIN (SELECT DISTINCT precursor_id, peptide_id FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL) m USING (precursor_id) SEMI JOIN peptide p ON p.id = m.peptide_id LEFT JOIN l USING (peptide_id)
LEFT JOIN c r ON r.peptide_id = m.peptide_id AND r.run_id = i.run_id AND r.context = 'run-specific' LEFT JOIN c e ON e.peptide_id = m.peptide_id AND e.run_id = i.run_id AND e.context = 'experiment-wide'
JOIN (SELECT * FROM c WHERE context = 'global' AND q < 0.3) g ON g.peptide_id = m.peptide_id""",
)
def long_export_proteins(spark: SparkSession, sf: str) -> DataFrame:
    """Proteins stand in for themselves: a peptide belongs to those whose id has its remainder by 97."""
    t = _tables(spark, sf)
    del t["feature_transition"], t["transition"]
    scores = table(spark, sf, "score_protein")
    rest = lambda c: (F.abs(c) % 97).alias("h")
    ids = scores.where("protein_id IS NOT NULL").select("protein_id", rest("protein_id")).distinct()
    own = t["precursor_peptide_mapping"].where("peptide_id IS NOT NULL").select("peptide_id", rest("peptide_id")).distinct().join(ids, "h").select("peptide_id", "protein_id")
    proteins = ids.select(F.col("protein_id").alias("id"), F.concat(F.lit("P"), F.col("protein_id").cast("string")).alias("protein_accession"))
    told = export.long_export(t | {"peptide_protein_mapping": own, "protein": proteins, "protein_contexts": eav.context_rows(scores, "protein_id")}, export.Thresholds(protein_qvalue=0.3))
    return told.select("feature_id", "run_id", "peptide_id", "protein_accession", "m_score_protein_run_specific", "m_score_protein_experiment_wide", "m_score_protein_global")


@QUERIES.add(
    "long_export_aligned",
    f"""WITH a AS (SELECT feature_id, reference_feature_id FROM (SELECT f.id AS feature_id, b.id AS reference_feature_id, round(abs(f.id % 1000) / 1000.0, 6) AS pep, round(abs(b.id % 1000) / 1000.0, 6) AS qvalue FROM (SELECT DISTINCT id, precursor_id FROM feature WHERE id IS NOT NULL) f JOIN (SELECT precursor_id, min(id) AS id FROM feature WHERE precursor_id IS NOT NULL GROUP BY 1) b USING (precursor_id))
 WHERE pep < 0.7 QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY qvalue, reference_feature_id) = 1),
b AS (SELECT feature_id, f.run_id, f.precursor_id, score FROM (SELECT DISTINCT id AS feature_id, run_id, precursor_id FROM feature WHERE id IS NOT NULL AND precursor_id IS NOT NULL) f JOIN ({_FACTS}) p USING (precursor_id) JOIN ({_SCORED}) s USING (feature_id) WHERE decoy = 0),
m AS (SELECT DISTINCT precursor_id, peptide_id FROM precursor_peptide_mapping WHERE peptide_id IN (SELECT id FROM peptide))
SELECT i.feature_id, i.run_id, peptide_id, score, reference_feature_id, 0 AS from_alignment FROM ({_IDENTIFIED}) i JOIN m USING (precursor_id) LEFT JOIN a USING (feature_id)
UNION ALL SELECT b.feature_id, b.run_id, peptide_id, score, reference_feature_id, 1 FROM b JOIN m USING (precursor_id) JOIN a USING (feature_id) WHERE reference_feature_id IN (SELECT feature_id FROM ({_IDENTIFIED}) JOIN m USING (precursor_id)) AND feature_id NOT IN (SELECT feature_id FROM ({_IDENTIFIED}) JOIN m USING (precursor_id))""",
)
def long_export_aligned(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    del t["feature_transition"], t["transition"]
    firsts = t["feature"].where("precursor_id IS NOT NULL").groupBy("precursor_id").agg(F.min("id").alias("reference_feature_id"))
    every = t["feature"].where("id IS NOT NULL").select(F.col("id").alias("feature_id"), "precursor_id").distinct().join(firsts, "precursor_id")
    share = lambda c: F.round(F.abs(F.col(c) % 1000) / 1000.0, 6)
    alignment = every.select("feature_id", "reference_feature_id", share("feature_id").alias("pep"), share("reference_feature_id").alias("qvalue"))
    return export.long_export(t | {"alignment": alignment}).select("feature_id", "run_id", "peptide_id", "score", "reference_feature_id", "from_alignment")


@QUERIES.add(
    "compound_export",
    f"""SELECT f.id, f.run_id, f.precursor_id, c.peptide_id AS compound_id, compound_name, s.qvalue, s.rank FROM (SELECT DISTINCT id, run_id, precursor_id FROM feature WHERE id IS NOT NULL) f JOIN (SELECT DISTINCT precursor_id, peptide_id FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL) c USING (precursor_id)
JOIN (SELECT id AS compound_id, max(unmodified_sequence) AS compound_name FROM peptide WHERE id IS NOT NULL GROUP BY 1) n ON n.compound_id = c.peptide_id JOIN (SELECT feature_id, min(qvalue) AS qvalue, min(rank) AS rank FROM score_ms2 GROUP BY 1) s ON s.feature_id = f.id WHERE s.qvalue < 0.05""",
)
def compound_export(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    features = t["feature"].where("id IS NOT NULL").select("id", "run_id", "precursor_id").distinct()
    compound_map = t["precursor_peptide_mapping"].where("peptide_id IS NOT NULL").select("precursor_id", F.col("peptide_id").alias("compound_id"))
    names = t["peptide"].where("id IS NOT NULL").groupBy("id").agg(F.max("unmodified_sequence").alias("compound_name")).withColumn("sum_formula", F.lit("")).withColumn("adducts", F.lit(""))
    scores = t["score_ms2"].groupBy("feature_id").agg(F.min("qvalue").alias("qvalue"), F.min("rank").alias("rank"))
    return export.compounds(features, compound_map, names, scores).select("id", "run_id", "precursor_id", "compound_id", "compound_name", "qvalue", "rank")


@QUERIES.add("glyco_density_errors")
def glyco_density_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Two-dimensional error rates by kernel densities over part scores; odd lines count as decoys of the glycan part."""
    from quantloom.operators import glyco
    from quantloom.plans.proxies import observations, rounded

    o = observations(spark, sf).select("obs", F.col("decoy").alias("decoy_peptide"), (F.col("l_linenumber") % 2).alias("decoy_glycan"), (F.col("score") / 10000).alias("d_score_peptide"), (F.col("quantity") / 10 + F.when(F.col("l_linenumber") % 2 == 0, 2.0).otherwise(0.0)).alias("d_score_glycan"))
    told = glyco.density_errors(o.withColumn("d_score", F.col("d_score_peptide") + F.col("d_score_glycan")), estimator="kde")
    return rounded(told.select("obs", *glyco.ERRORS), 6)
