"""Queries of the input tables of scoring, inference and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import glyco, reads
from quantloom.plans.proxies import OBSERVATIONS_SQL, observations, rounded
from quantloom.plans.registry import Registry
from quantloom.runtime import table

QUERIES = Registry()

_FACTS = "SELECT id AS precursor_id, max(charge) AS precursor_charge, max(decoy) AS decoy FROM precursor WHERE id IS NOT NULL GROUP BY id"
_FEATURES = "SELECT DISTINCT id AS feature_id, run_id, precursor_id, exp_rt, norm_rt, delta_rt FROM feature WHERE precursor_id IS NOT NULL"
_MEASURES = "SELECT DISTINCT feature_id, var_xcorr_shape, var_massdev_score FROM feature_transition"
_TARGETS = f"SELECT DISTINCT id AS feature_id FROM feature WHERE id IS NOT NULL AND precursor_id IN (SELECT precursor_id FROM ({_FACTS}) WHERE decoy = 0)"
_PEPS = "SELECT DISTINCT feature_id, pep FROM score_ms2 WHERE feature_id IS NOT NULL"


def _t(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in names]


@QUERIES.add("ms1_feature_read", f"SELECT m.*, run_id, precursor_id, exp_rt, norm_rt, delta_rt, precursor_charge, decoy, run_id || '_' || precursor_id AS group_id FROM ({_MEASURES}) m JOIN ({_FEATURES}) f USING (feature_id) JOIN ({_FACTS}) p USING (precursor_id)")
def ms1_feature_read(spark: SparkSession, sf: str) -> DataFrame:
    features, fragments, precursors = _t(spark, sf, "feature", "feature_transition", "precursor")
    return reads.ms1_table(features, fragments.select("feature_id", "var_xcorr_shape", "var_massdev_score"), precursors)


@QUERIES.add(
    "ms1_feature_read_glyco",
    f"""SELECT m.*, run_id, precursor_id, exp_rt, norm_rt, delta_rt, precursor_charge, p.decoy, run_id || '_' || precursor_id AS group_id, decoy_peptide, decoy_glycan
FROM ({_MEASURES}) m JOIN ({_FEATURES}) f USING (feature_id) JOIN ({_FACTS}) p USING (precursor_id)
JOIN (SELECT DISTINCT id AS precursor_id, decoy AS decoy_peptide, charge % 2 AS decoy_glycan FROM precursor WHERE id IS NOT NULL) g USING (precursor_id) WHERE feature_id IN (SELECT feature_id FROM score_ms2 WHERE rank <= 1)""",
)
def ms1_feature_read_glyco(spark: SparkSession, sf: str) -> DataFrame:
    features, fragments, precursors, scores = _t(spark, sf, "feature", "feature_transition", "precursor", "score_ms2")
    glycopeptides = precursors.where("id IS NOT NULL").select(F.col("id").alias("precursor_id"), F.col("decoy").alias("decoy_peptide"), (F.col("charge") % 2).alias("decoy_glycan"))
    return reads.ms1_table(features, fragments.select("feature_id", "var_xcorr_shape", "var_massdev_score"), precursors, glycopeptides, scores, 1)


@QUERIES.add(
    "split_transition_read",
    f"""WITH p AS (SELECT DISTINCT f.precursor_id, f.feature_id, f.run_id, x.decoy FROM ({_FEATURES}) f JOIN ({_FACTS}) x USING (precursor_id) JOIN score_ms2 s ON s.feature_id = f.feature_id WHERE s.rank <= 2 AND s.pep <= 0.3),
t AS (SELECT DISTINCT f.precursor_id, t.feature_id, t.transition_id, t.var_intensity_score FROM feature_transition t JOIN (SELECT DISTINCT feature_id, precursor_id FROM ({_FEATURES})) f USING (feature_id))
SELECT t.*, run_id, decoy FROM t JOIN p USING (precursor_id, feature_id)""",
)
def split_transition_read(spark: SparkSession, sf: str) -> DataFrame:
    features, fragments, precursors, scores = _t(spark, sf, "feature", "feature_transition", "precursor", "score_ms2")
    facts = precursors.groupBy(F.col("id").alias("precursor_id")).agg(F.max("decoy").alias("decoy"))
    ids = features.where("precursor_id IS NOT NULL").select(F.col("id").alias("feature_id"), "precursor_id", "run_id").distinct()
    of_precursors = ids.join(facts, "precursor_id").join(scores.select("feature_id", "rank", "pep"), "feature_id")
    of_transitions = fragments.select("feature_id", "transition_id", "var_intensity_score").join(ids.select("feature_id", "precursor_id").distinct(), "feature_id")
    return reads.transition_table(of_transitions, of_precursors, 2, 0.3)


_PART = "SELECT DISTINCT feature_id, pep FROM (SELECT feature_id, transition_id, round(var_xcorr_shape, 6) AS pep FROM feature_transition) JOIN (SELECT DISTINCT id AS transition_id FROM (SELECT id, CASE WHEN ordinal = 1 THEN '' ELSE type END AS type, decoy FROM transition) WHERE type = '' AND decoy = 0) USING (transition_id)"
_MS1 = "SELECT DISTINCT feature_id, round(var_massdev_score, 6) AS pep FROM feature_transition WHERE feature_id IS NOT NULL"


def _ipf_sql(ms1: bool, ms2: bool) -> str:
    return f"""SELECT feature_id, s.pep AS ms2_peakgroup_pep, {"a.pep" if ms1 else "NULL::double"} AS ms1_precursor_pep, {"b.pep" if ms2 else "NULL::double"} AS ms2_precursor_pep
FROM ({_TARGETS}) JOIN (SELECT * FROM ({_PEPS}) WHERE pep < 0.4) s USING (feature_id) {f"JOIN ({_MS1}) a USING (feature_id)" if ms1 else ""} {f"JOIN ({_PART}) b USING (feature_id)" if ms2 else ""}"""


def _ipf(spark: SparkSession, sf: str, ms1: bool, ms2: bool) -> DataFrame:
    features, precursors, scores, fragments, transitions = _t(spark, sf, "feature", "precursor", "score_ms2", "feature_transition", "transition")
    by_transition = fragments.select("feature_id", "transition_id", F.round("var_xcorr_shape", 6).alias("pep"))
    by_ms1 = fragments.select("feature_id", F.round("var_massdev_score", 6).alias("pep"))
    own = transitions.withColumn("type", F.when(F.col("ordinal") == 1, "").otherwise(F.col("type")))
    return reads.ipf_precursors(features, precursors, scores, 0.4, by_ms1 if ms1 else None, by_transition if ms2 else None, own if ms2 else None)


for _name, _ms1, _ms2 in (("none", False, False), ("ms1", True, False), ("ms2", False, True), ("both", True, True)):
    QUERIES.add(f"ipf_precursor_read_{_name}", _ipf_sql(_ms1, _ms2))(lambda spark, sf, a=_ms1, b=_ms2: _ipf(spark, sf, a, b))


@QUERIES.add(
    "outer_pep_merge",
    f"""WITH o AS (SELECT obs AS feature_id, pep, pep1, quantity FROM ({OBSERVATIONS_SQL})), a AS (SELECT feature_id, pep AS ms1 FROM o WHERE pep < 0.5), b AS (SELECT feature_id, pep1 AS ms2 FROM o WHERE pep1 > 0.3), c AS (SELECT feature_id, quantity / 51 AS pg FROM o WHERE quantity > 20)
SELECT coalesce(b.feature_id, a.feature_id, c.feature_id) AS feature_id, round(ms1, 9) AS ms1, round(ms2, 9) AS ms2, round(pg, 9) AS pg FROM b FULL JOIN a ON a.feature_id = b.feature_id FULL JOIN c ON c.feature_id = coalesce(b.feature_id, a.feature_id)""",
)
def outer_pep_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf).withColumnRenamed("obs", "feature_id")
    return rounded(reads.outer_peps(o.where("pep < 0.5").select("feature_id", F.col("pep").alias("ms1")), o.where("pep1 > 0.3").select("feature_id", F.col("pep1").alias("ms2")), o.where("quantity > 20").select("feature_id", (F.col("quantity") / 51).alias("pg")))).select("feature_id", "ms1", "ms2", "pg")


_ALIGNMENT = "SELECT l_suppkey AS alignment_id, l_partkey AS precursor_id, l_orderkey AS reference_feature_id, l_orderkey + l_linenumber % 3 AS aligned_feature_id, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS label FROM lineitem"
_ALIGNED = "SELECT l_orderkey AS feature_id, l_extendedprice AS score, round(l_tax * 10, 4) AS pep, round(l_discount * 10, 4) AS qvalue FROM lineitem"


def _alignment(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("label")
    rows = items.select(F.col("l_suppkey").alias("alignment_id"), F.col("l_partkey").alias("precursor_id"), F.col("l_orderkey").alias("reference_feature_id"), (F.col("l_orderkey") + F.col("l_linenumber") % 3).alias("aligned_feature_id"), label)
    return rows, items.select(F.col("l_orderkey").alias("feature_id"), F.col("l_extendedprice").alias("score"), F.round(F.col("l_tax") * 10, 4).alias("pep"), F.round(F.col("l_discount") * 10, 4).alias("qvalue"))


@QUERIES.add(
    "alignment_groups",
    f"""WITH a AS (SELECT * FROM ({_ALIGNMENT}) WHERE label = 1 AND reference_feature_id <> aligned_feature_id), m AS (SELECT alignment_id, reference_feature_id AS feature_id, precursor_id, 'REFERENCE' AS feature_type FROM a UNION SELECT alignment_id, aligned_feature_id, precursor_id, 'QUERY' FROM a),
g AS (SELECT dense_rank() OVER (ORDER BY precursor_id, alignment_id) AS alignment_group_id, m.*, pep FROM m JOIN (SELECT feature_id, min(pep) AS pep FROM ({_ALIGNED}) WHERE pep < 0.3 GROUP BY 1) USING (feature_id))
SELECT *, row_number() OVER (PARTITION BY alignment_group_id ORDER BY CASE feature_type WHEN 'REFERENCE' THEN 0 ELSE 1 END, feature_id) AS place FROM g""",
)
def alignment_groups(spark: SparkSession, sf: str) -> DataFrame:
    return reads.alignment_groups(*_alignment(spark, sf), 0.3).select("alignment_group_id", "alignment_id", "feature_id", "precursor_id", "feature_type", "pep", "place")


@QUERIES.add(
    "alignment_features",
    f"""SELECT alignment_id, precursor_id, reference_feature_id, aligned_feature_id AS feature_id, CASE label WHEN 1 THEN 0 WHEN -1 THEN 1 END AS decoy, score, pep, qvalue FROM ({_ALIGNMENT}) a
LEFT JOIN (SELECT * FROM ({_ALIGNED}) QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY qvalue, pep, score) = 1) s ON s.feature_id = a.aligned_feature_id""",
)
def alignment_features(spark: SparkSession, sf: str) -> DataFrame:
    return reads.alignment_features(*_alignment(spark, sf))


@QUERIES.add("phospho_loss_flags", "SELECT id AS transition_id, max(CASE WHEN coalesce(annotation, '') LIKE '%-H3O4P1%' THEN 1 ELSE 0 END) AS has_phospho_loss FROM (SELECT id, CASE WHEN ordinal % 3 = 0 THEN annotation || '-H3O4P1^1' ELSE annotation END AS annotation FROM transition) GROUP BY 1")
def phospho_loss_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "transition").select("id", F.when(F.col("ordinal") % 3 == 0, F.concat("annotation", F.lit("-H3O4P1^1"))).otherwise(F.col("annotation")).alias("annotation"))
    return reads.phospho_loss_flags(rows)


@QUERIES.add(
    "context_entities_protein",
    f"""WITH a AS (SELECT precursor_id, min(peptide_id) AS peptide_id FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL AND precursor_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT peptide_id) = 1),
b AS (SELECT DISTINCT id AS peptide_id, coalesce(decoy, 2) * 1000 + len(unmodified_sequence) AS protein_id FROM peptide WHERE unmodified_sequence IS NOT NULL AND id IS NOT NULL), c AS (SELECT peptide_id, min(protein_id) AS protein_id FROM b GROUP BY 1 HAVING count(DISTINCT protein_id) = 1),
s AS (SELECT feature_id, max(score) AS score FROM score_ms2 WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1)
SELECT run_id, protein_id, decoy, feature_id, score FROM (SELECT DISTINCT id AS feature_id, run_id, precursor_id FROM feature WHERE id IS NOT NULL) f JOIN ({_FACTS}) p USING (precursor_id) JOIN s USING (feature_id) JOIN a USING (precursor_id) JOIN c USING (peptide_id)
QUALIFY row_number() OVER (PARTITION BY run_id, protein_id, decoy ORDER BY score DESC, feature_id) = 1""",
)
def context_entities_protein(spark: SparkSession, sf: str) -> DataFrame:
    features, precursors, scores, mapping, peptides = _t(spark, sf, "feature", "precursor", "score_ms2", "precursor_peptide_mapping", "peptide")
    proteins = peptides.where("unmodified_sequence IS NOT NULL").select(F.col("id").alias("peptide_id"), (F.coalesce("decoy", F.lit(2)) * 1000 + F.length("unmodified_sequence")).alias("protein_id"))
    return reads.context_entities(features, precursors, scores, [(mapping, "precursor_id", "peptide_id"), (proteins, "peptide_id", "protein_id")])


_BEST = "SELECT feature_id, arg_max(struct_pack(s := score, q := qvalue), struct_pack(a := score, b := loaded_at)) AS v FROM score_ms2 WHERE feature_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1"


@QUERIES.add(
    "wide_precursors",
    f"""SELECT f.feature_id, run_id, f.precursor_id, exp_rt, precursor_charge, decoy, n_peptides, v.s AS score_ms2_score, v.q AS score_ms2_qvalue FROM ({_FEATURES}) f JOIN ({_FACTS}) p USING (precursor_id)
LEFT JOIN (SELECT precursor_id, count(DISTINCT peptide_id)::int AS n_peptides FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL GROUP BY 1) m USING (precursor_id) LEFT JOIN ({_BEST}) s USING (feature_id)""",
)
def wide_precursors(spark: SparkSession, sf: str) -> DataFrame:
    tables = {n: table(spark, sf, n) for n in ("feature", "precursor", "precursor_peptide_mapping", "score_ms2")}
    rows = reads.wide_precursors(tables)
    return rows.select("feature_id", "run_id", "precursor_id", "exp_rt", "precursor_charge", "decoy", F.size("peptide_ids").alias("n_peptides"), "score_ms2_score", "score_ms2_qvalue")


@QUERIES.add(
    "wide_transitions",
    """SELECT coalesce(m.transition_id, t.id) AS transition_id, feature_id, run_id, area_intensity, product_mz, charge, type FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM feature_transition JOIN (SELECT DISTINCT id AS feature_id, run_id FROM feature WHERE id IS NOT NULL) USING (feature_id) WHERE transition_id IS NOT NULL) m
FULL JOIN (SELECT id, max(product_mz) AS product_mz, max(charge) AS charge, max(type) AS type FROM transition GROUP BY id) t ON t.id = m.transition_id""",
)
def wide_transitions(spark: SparkSession, sf: str) -> DataFrame:
    tables = {n: table(spark, sf, n) for n in ("feature", "feature_transition", "transition")}
    return reads.wide_transitions(tables).select("transition_id", "feature_id", "run_id", "area_intensity", "product_mz", "charge", "type")


@QUERIES.add(
    "chromatogram_library",
    """SELECT c.chromatogram_id, 'precursor' AS kind, c.item_id, p.mz, p.charge FROM (SELECT DISTINCT -id AS chromatogram_id, id AS item_id FROM precursor WHERE id IS NOT NULL) c JOIN (SELECT id, max(precursor_mz) AS mz, max(charge) AS charge FROM precursor GROUP BY id) p ON p.id = c.item_id
UNION ALL SELECT c.item_id, 'transition', c.item_id, t.mz, t.charge FROM (SELECT DISTINCT id AS item_id FROM transition WHERE id IS NOT NULL) c JOIN (SELECT id, max(product_mz) AS mz, max(charge) AS charge FROM transition GROUP BY id) t ON t.id = c.item_id""",
)
def chromatogram_library(spark: SparkSession, sf: str) -> DataFrame:
    precursors, transitions = _t(spark, sf, "precursor", "transition")
    named = precursors.where("id IS NOT NULL").select((-F.col("id")).alias("id"), F.concat(F.col("id").cast("string"), F.lit("_Precursor_i0")).alias("native_id")).distinct()
    named = named.unionByName(transitions.where("id IS NOT NULL").select("id", F.col("id").cast("string").alias("native_id")).distinct())
    return reads.chromatogram_library(named, precursors, transitions)


@QUERIES.add(
    "peptidoform_columns",
    """WITH i AS (SELECT DISTINCT f.id AS feature_id, m.peptide_id, round((abs(m.peptide_id) % 7) / 7.0, 6) AS pep FROM feature f JOIN precursor_peptide_mapping m USING (precursor_id) WHERE f.id IS NOT NULL AND m.peptide_id IS NOT NULL),
n AS (SELECT feature_id, pep, modified_sequence FROM i JOIN (SELECT id AS peptide_id, max(modified_sequence) AS modified_sequence FROM peptide WHERE modified_sequence IS NOT NULL GROUP BY 1) USING (peptide_id)),
b AS (SELECT feature_id, string_agg(DISTINCT modified_sequence, ';' ORDER BY modified_sequence) AS ipf_full_peptide_name, any_value(pep) AS ipf_pep FROM (SELECT * FROM n QUALIFY pep = min(pep) OVER (PARTITION BY feature_id)) GROUP BY 1)
SELECT feature_id, run_id, ipf_full_peptide_name, ipf_pep FROM (SELECT DISTINCT id AS feature_id, run_id FROM feature WHERE id IS NOT NULL) LEFT JOIN b USING (feature_id)""",
)
def peptidoform_columns(spark: SparkSession, sf: str) -> DataFrame:
    features, mapping, peptides = _t(spark, sf, "feature", "precursor_peptide_mapping", "peptide")
    rows = features.where("id IS NOT NULL").select(F.col("id").alias("feature_id"), "run_id", "precursor_id").distinct()
    pairs = rows.join(mapping.where("peptide_id IS NOT NULL").select("precursor_id", "peptide_id").distinct(), "precursor_id")
    inferred = pairs.select("feature_id", "peptide_id", F.round((F.abs("peptide_id") % 7) / 7.0, 6).alias("pep")).distinct()
    sequences = peptides.where("modified_sequence IS NOT NULL").groupBy(F.col("id").alias("peptide_id")).agg(F.max("modified_sequence").alias("modified_sequence"))
    return reads.with_peptidoforms(rows.select("feature_id", "run_id").distinct(), inferred, sequences)


@QUERIES.add(
    "part_scores",
    f"WITH o AS (SELECT obs AS feature_id, run AS run_id, entity AS precursor_id, score, quantity, decoy FROM ({OBSERVATIONS_SQL})) SELECT a.feature_id, a.run_id, a.precursor_id, round(a.score, 9) AS d_score_peptide, a.decoy AS decoy_peptide, b.quantity AS d_score_glycan, b.decoy AS decoy_glycan FROM o a JOIN o b USING (feature_id, run_id, precursor_id) WHERE a.quantity > 10 AND b.score > 20000",
)
def part_scores(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf).select(F.col("obs").alias("feature_id"), F.col("run").alias("run_id"), F.col("entity").alias("precursor_id"), "score", "quantity", "decoy")
    return rounded(reads.part_scores(o.where("quantity > 10").withColumnRenamed("score", "d_score"), o.where("score > 20000").withColumnRenamed("quantity", "d_score"), ["feature_id", "run_id", "precursor_id"]))


@QUERIES.add("weighted_density_fdr", "SELECT event_id, round(sum(pep * w) OVER (ORDER BY pep RANGE UNBOUNDED PRECEDING) / sum(w) OVER (ORDER BY pep RANGE UNBOUNDED PRECEDING), 9) AS qvalue FROM (SELECT event_id, least(value / 500, 1.0) AS pep, 1.0 + user_id % 7 AS w FROM events WHERE value IS NOT NULL)")
def weighted_density_fdr(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("value IS NOT NULL").select("event_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("pep"), (F.col("user_id") % 7 + 1.0).alias("w"))
    return rounded(glyco.weighted_fdr(rows, "pep", "w", "qvalue").select("event_id", "qvalue"))


@QUERIES.add("hash_sample_rows", "SELECT id, group_label FROM (SELECT DISTINCT id, group_label FROM precursor WHERE id IS NOT NULL) ORDER BY md5(concat_ws('-', id, 42)), id LIMIT 200")
def hash_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed number of rows in an order that looks random; sampling is the feature."""
    return reads.first_by_hash(table(spark, sf, "precursor").where("id IS NOT NULL").select("id", "group_label").groupBy("id").agg(F.min("group_label").alias("group_label")), "id", 200)


@QUERIES.add(
    "stratified_plot_sample",
    f"""WITH o AS (SELECT obs, decoy, row_number() OVER (PARTITION BY decoy ORDER BY md5(concat_ws('-', obs, 42)), obs) AS n, count(*) OVER (PARTITION BY decoy) AS own, count(*) OVER () AS total FROM ({OBSERVATIONS_SQL}))
SELECT obs, decoy FROM o WHERE n <= 1000 * own // total""",
)
def stratified_plot_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand rows for a plot, targets and decoys in their shares; sampling is the feature."""
    return reads.stratified_sample(observations(spark, sf).select("obs", "decoy"), "decoy", "obs", 1000)
