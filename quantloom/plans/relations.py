"""Queries of the relational core: reads, joins, recovery, score views, unions, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import eav, relational, stats
from quantloom.plans.proxies import OBSERVATIONS_SQL, TIES, observations, rounded
from quantloom.plans.records import _CELLS_SQL, _WINNERS_SQL
from quantloom.plans.registry import Registry
from quantloom.runtime import table

QUERIES = Registry()


def _tables(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in names]


_KNOWN = "SELECT id AS precursor_id, max(charge) AS precursor_charge, max(decoy) AS decoy FROM precursor GROUP BY id"
_FEATURES = "SELECT DISTINCT id AS feature_id, run_id, precursor_id, exp_rt, norm_rt, delta_rt FROM feature WHERE precursor_id IS NOT NULL"
_COUNTS = "SELECT f.precursor_id, count(DISTINCT t.transition_id) AS transition_count FROM feature f JOIN feature_transition t ON t.feature_id = f.id WHERE f.precursor_id IS NOT NULL GROUP BY 1"


def _counts(features: DataFrame, transitions: DataFrame) -> DataFrame:
    ids = features.where("precursor_id IS NOT NULL").select("id", "precursor_id").distinct()
    return transitions.select("feature_id", "transition_id").join(ids, F.col("feature_id") == F.col("id")).groupBy("precursor_id").agg(F.count_distinct("transition_id").alias("transition_count"))


@QUERIES.add(
    "ms2_feature_read",
    f"""SELECT feature_id, run_id, f.precursor_id, exp_rt, norm_rt, delta_rt, precursor_charge, decoy, coalesce(transition_count, 0) AS transition_count,
 run_id || '_' || f.precursor_id AS group_id FROM ({_FEATURES}) f JOIN ({_KNOWN}) p USING (precursor_id) LEFT JOIN ({_COUNTS}) c USING (precursor_id)""",
)
def ms2_feature_read(spark: SparkSession, sf: str) -> DataFrame:
    features, precursors, transitions = _tables(spark, sf, "feature", "precursor", "feature_transition")
    return relational.feature_table(features, precursors, _counts(features, transitions))


@QUERIES.add(
    "ms1ms2_merge",
    f"""SELECT obs, entity, quantity AS var_ms2_quantity, p_size AS var_ms1_size, round(p_retailprice, 9) AS var_ms1_retailprice
FROM ({OBSERVATIONS_SQL}) o LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = entity""",
)
def ms1ms2_merge(spark: SparkSession, sf: str) -> DataFrame:
    first = relational.with_prefix(table(spark, sf, "part").where("p_size > 10").select("p_partkey", F.col("p_size").alias("var_size"), F.col("p_retailprice").alias("var_retailprice")), "var_", "var_ms1_")
    second = observations(spark, sf).select("obs", "entity", F.col("quantity").alias("var_ms2_quantity"))
    return rounded(second.join(first, F.col("entity") == F.col("p_partkey"), "left").drop("p_partkey"))


@QUERIES.add(
    "transition_feature_read",
    f"""SELECT DISTINCT f.run_id || '_' || f.feature_id || '_' || f.precursor_id || '_' || t.transition_id AS group_id, f.run_id, f.feature_id, f.precursor_id, t.transition_id,
 p.decoy, tr.charge AS product_charge, t.var_intensity_score, t.var_xcorr_shape, coalesce(n.n_peptides, 0) AS n_peptides
FROM ({_FEATURES}) f JOIN ({_KNOWN}) p USING (precursor_id) JOIN feature_transition t ON t.feature_id = f.feature_id
JOIN (SELECT id, max(charge) AS charge, max(detecting) AS detecting FROM transition GROUP BY id) tr ON tr.id = t.transition_id
JOIN (SELECT feature_id, min(rank) AS rank, min(pep) AS pep FROM score_ms2 WHERE rank IS NOT NULL GROUP BY feature_id) s ON s.feature_id = f.feature_id
LEFT JOIN (SELECT precursor_id, count(DISTINCT peptide_id) AS n_peptides FROM precursor_peptide_mapping GROUP BY 1) n USING (precursor_id)
WHERE s.rank <= 2 AND s.pep <= 0.7 AND tr.detecting = 1 AND t.var_intensity_score IS NOT NULL""",
)
def transition_feature_read(spark: SparkSession, sf: str) -> DataFrame:
    features, precursors, fragments, transitions, scores, mapping = _tables(spark, sf, "feature", "precursor", "feature_transition", "transition", "score_ms2", "precursor_peptide_mapping")
    kept = scores.where("rank IS NOT NULL").groupBy("feature_id").agg(F.min("rank").alias("rank"), F.min("pep").alias("pep")).where("rank <= 2 AND pep <= 0.7").select("feature_id")
    detecting = transitions.groupBy(F.col("id").alias("transition_id")).agg(F.max("charge").alias("product_charge"), F.max("detecting").alias("detecting")).where("detecting = 1").drop("detecting")
    peptides = mapping.groupBy("precursor_id").agg(F.count_distinct("peptide_id").alias("n_peptides"))
    base = relational.feature_table(features, precursors).join(kept, "feature_id", "left_semi")
    rows = fragments.where("var_intensity_score IS NOT NULL").select("feature_id", "transition_id", "var_intensity_score", "var_xcorr_shape").distinct()
    met = rows.join(base, "feature_id").join(detecting, "transition_id").join(peptides, "precursor_id", "left")
    return met.select(
        F.concat_ws("_", "run_id", "feature_id", "precursor_id", "transition_id").alias("group_id"), "run_id", "feature_id", "precursor_id", "transition_id",
        "decoy", "product_charge", "var_intensity_score", "var_xcorr_shape", F.coalesce("n_peptides", F.lit(0)).alias("n_peptides"),
    )


@QUERIES.add(
    "proteotypic_best_score",
    f"""WITH map AS (SELECT precursor_id, min(peptide_id) AS peptide_id FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT peptide_id) = 1),
s AS (SELECT feature_id, max(score) AS score FROM score_ms2 WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1)
SELECT peptide_id, run_id, f.feature_id, score FROM ({_FEATURES}) f JOIN map USING (precursor_id) JOIN s ON s.feature_id = f.feature_id
QUALIFY row_number() OVER (PARTITION BY peptide_id, run_id ORDER BY score DESC, f.feature_id) = 1""",
)
def proteotypic_best_score(spark: SparkSession, sf: str) -> DataFrame:
    features, scores, mapping = _tables(spark, sf, "feature", "score_ms2", "precursor_peptide_mapping")
    single = relational.unique_partner(mapping, "precursor_id", "peptide_id")
    best = scores.where("score IS NOT NULL AND NOT isnan(score)").groupBy("feature_id").agg(F.max("score").alias("score"))
    rows = features.select(F.col("id").alias("feature_id"), "run_id", "precursor_id").distinct().join(single, "precursor_id").join(best, "feature_id")
    return stats.best_per_group(rows, ["peptide_id", "run_id"], "score", ["feature_id"]).select("peptide_id", "run_id", "feature_id", "score")


@QUERIES.add("collapse_then_explode_ids", "SELECT DISTINCT precursor_id, peptide_id FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL")
def collapse_then_explode_ids(spark: SparkSession, sf: str) -> DataFrame:
    return relational.collapsed(table(spark, sf, "precursor_peptide_mapping"), ["precursor_id"], "peptide_id", "ids").select("precursor_id", F.explode("ids").alias("peptide_id"))


@QUERIES.add(
    "score_join_back",
    f"""SELECT obs, entity, score AS score_old_kept, round(s.q, 9) AS score_ms2_q, s.n AS score_ms2_n FROM ({OBSERVATIONS_SQL}) o
LEFT JOIN (SELECT entity, run, avg(score) AS q, count(*) AS n FROM ({OBSERVATIONS_SQL}) WHERE decoy = 0 GROUP BY ALL) s USING (entity, run)""",
)
def score_join_back(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf)
    scores = rows.where("decoy = 0").groupBy("entity", "run").agg(F.avg("score").alias("q"), F.count(F.lit(1)).alias("n"))
    old = rows.select("obs", "entity", "run", F.col("score").alias("score_old_kept"), F.lit(1.0).alias("score_ms2_q"))
    return rounded(relational.scores_back(old, scores, ["entity", "run"], "score_ms2_").drop("run"))


_NAMES = {a.value: a.prefix for a in eav.CONTEXTS}


def _context_view(spark: SparkSession, sf: str) -> DataFrame:
    rows = eav.context_rows(table(spark, sf, "score_peptide"), "peptide_id").withColumn("run_id", F.when(F.col("context") != "global", F.col("run_id")))
    return relational.context_columns(rows, "entity_id", _NAMES, ["qvalue"])


_VIEW_SQL = f"""SELECT coalesce(b.entity_id, g.entity_id) AS entity_id, run_id, qvalue_run_specific, qvalue_experiment_wide, qvalue_global FROM
 (SELECT entity_id, run_id, min(qvalue) FILTER (context = 'run-specific') AS qvalue_run_specific, min(qvalue) FILTER (context = 'experiment-wide') AS qvalue_experiment_wide
  FROM ({_CELLS_SQL}) WHERE level = 'peptide' AND context <> 'global' GROUP BY 1, 2) b
 FULL JOIN (SELECT entity_id, min(qvalue) AS qvalue_global FROM ({_CELLS_SQL}) WHERE level = 'peptide' AND context = 'global' GROUP BY 1) g ON g.entity_id = b.entity_id"""


@QUERIES.add("full_outer_context_scores", _VIEW_SQL)
def full_outer_context_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _context_view(spark, sf).select("entity_id", "run_id", "qvalue_run_specific", "qvalue_experiment_wide", "qvalue_global")


@QUERIES.add(
    "join_runs_or_global",
    f"""SELECT f.feature_id, m.peptide_id AS entity_id, f.run_id, v.qvalue_run_specific, v.qvalue_global FROM (SELECT DISTINCT id AS feature_id, run_id, precursor_id FROM feature) f
JOIN (SELECT DISTINCT precursor_id, peptide_id FROM precursor_peptide_mapping WHERE peptide_id IS NOT NULL) m USING (precursor_id)
LEFT JOIN ({_VIEW_SQL}) v ON v.entity_id = m.peptide_id AND (v.run_id = f.run_id OR v.run_id IS NULL)""",
)
def join_runs_or_global(spark: SparkSession, sf: str) -> DataFrame:
    features, mapping = _tables(spark, sf, "feature", "precursor_peptide_mapping")
    pairs = mapping.where("peptide_id IS NOT NULL").select("precursor_id", F.col("peptide_id").alias("entity_id")).distinct()
    rows = features.select(F.col("id").alias("feature_id"), "run_id", "precursor_id").distinct().join(pairs, "precursor_id")
    view = _context_view(spark, sf).select("entity_id", "run_id", "qvalue_run_specific", "qvalue_global")
    return relational.join_runs_or_global(rows, view, "entity_id").select("feature_id", "entity_id", "run_id", "qvalue_run_specific", "qvalue_global")


@QUERIES.add(
    "context_pivot",
    """SELECT user_id, round(min(value) FILTER (event_type = 'click'), 9) AS value_click, round(min(value) FILTER (event_type = 'view'), 9) AS value_view,
 round(min(value) FILTER (event_type = 'purchase'), 9) AS value_purchase FROM events GROUP BY user_id""",
)
def context_pivot(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("click", "view", "purchase")
    return rounded(table(spark, sf, "events").groupBy("user_id").agg(*[F.min(F.when(F.col("event_type") == k, F.col("value"))).alias(f"value_{k}") for k in kinds]))


_BEST_Q = "SELECT peptide_id, run_id, min(qvalue) AS peptide_q FROM score_peptide WHERE peptide_id IS NOT NULL AND run_id IS NOT NULL GROUP BY 1, 2"
_PAIRS = "SELECT DISTINCT f.id AS feature_id, f.run_id, m.peptide_id FROM feature f JOIN precursor_peptide_mapping m USING (precursor_id) WHERE m.peptide_id IS NOT NULL"


def _feature_peptides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    features, mapping, scores = _tables(spark, sf, "feature", "precursor_peptide_mapping", "score_peptide")
    pairs = features.select("id", "run_id", "precursor_id").distinct().join(mapping.where("peptide_id IS NOT NULL").select("precursor_id", "peptide_id").distinct(), "precursor_id")
    q = scores.where("peptide_id IS NOT NULL AND run_id IS NOT NULL").groupBy("peptide_id", "run_id").agg(F.min("qvalue").alias("peptide_q"))
    return pairs.select(F.col("id").alias("feature_id"), "run_id", "peptide_id").distinct(), q


@QUERIES.add("augment_entity_qvalues_inner", f"SELECT feature_id, run_id, peptide_id, peptide_q FROM ({_PAIRS}) JOIN ({_BEST_Q}) USING (peptide_id, run_id) WHERE peptide_q < 0.2")
def augment_entity_qvalues_inner(spark: SparkSession, sf: str) -> DataFrame:
    pairs, q = _feature_peptides(spark, sf)
    return pairs.join(q.where("peptide_q < 0.2"), ["peptide_id", "run_id"])


@QUERIES.add("augment_entity_qvalues_left", f"SELECT feature_id, run_id, peptide_id, peptide_q FROM ({_PAIRS}) LEFT JOIN ({_BEST_Q}) USING (peptide_id, run_id)")
def augment_entity_qvalues_left(spark: SparkSession, sf: str) -> DataFrame:
    pairs, q = _feature_peptides(spark, sf)
    return pairs.join(q, ["peptide_id", "run_id"], "left")


@QUERIES.add(
    "aligned_feature_recovery",
    f"""WITH o AS (SELECT obs, entity, run, score, pep1 FROM ({OBSERVATIONS_SQL})), base AS (SELECT obs, entity, score FROM o WHERE score > 60000),
al AS (SELECT obs, entity, score, min(obs) OVER (PARTITION BY entity, run) AS reference FROM o WHERE pep1 < 0.3)
SELECT b.obs, b.entity, round(b.score, 9) AS score, 0 AS from_alignment, al.reference FROM base b LEFT JOIN al USING (obs)
UNION ALL SELECT obs, entity, round(score, 9), 1, reference FROM al WHERE obs NOT IN (SELECT obs FROM base)""",
)
def aligned_feature_recovery(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf)
    aligned = rows.where("pep1 < 0.3")
    references = aligned.groupBy("entity", "run").agg(F.min("obs").alias("reference"))
    aligned = aligned.join(references, ["entity", "run"]).select("obs", "entity", "score", "reference")
    base = rows.where("score > 60000").select("obs", "entity", "score")
    told = base.join(aligned.select("obs", "reference"), "obs", "left")
    return rounded(relational.aligned_recovery(told, aligned, "obs"))


@QUERIES.add(
    "reference_query_union_groups",
    """WITH u AS (SELECT l_partkey AS precursor, l_suppkey AS alignment, l_orderkey AS feature FROM lineitem WHERE l_linenumber = 1
 UNION SELECT l_partkey, l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT precursor, alignment, feature, dense_rank() OVER (ORDER BY precursor, alignment) AS alignment_group_id FROM u""",
)
def reference_query_union_groups(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("precursor"), F.col("l_suppkey").alias("alignment"), F.col("l_orderkey").alias("feature"), "l_linenumber", "l_returnflag")
    both = items.where("l_linenumber = 1").unionByName(items.where("l_returnflag = 'A'")).drop("l_linenumber", "l_returnflag").distinct()
    return relational.dense_ids(both, ["precursor", "alignment"], "alignment_group_id")


@QUERIES.add(
    "propagate_confident_evidence",
    f"""WITH e AS (SELECT entity AS alignment_group, l_suppkey AS feature_id, l_linenumber AS transition_id, pep FROM ({OBSERVATIONS_SQL}))
SELECT a.alignment_group, a.feature_id, b.transition_id, min(b.pep) AS pep FROM (SELECT DISTINCT alignment_group, feature_id FROM e) a
JOIN e b ON a.alignment_group = b.alignment_group AND (b.feature_id = a.feature_id OR b.pep <= 0.3) GROUP BY 1, 2, 3""",
)
def propagate_confident_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf).select(F.col("entity").alias("alignment_group"), F.col("l_suppkey").alias("feature_id"), F.col("l_linenumber").alias("transition_id"), "pep")
    return relational.propagate(rows, "alignment_group", "transition_id", "pep", 0.3)


@QUERIES.add("transition_string_agg", "SELECT feature_id, string_agg(transition_id::varchar, ';' ORDER BY transition_id) AS ids, string_agg(area::varchar, ';' ORDER BY transition_id) AS areas FROM (SELECT feature_id, transition_id, max(area_intensity)::bigint AS area FROM feature_transition WHERE transition_id IS NOT NULL AND area_intensity IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def transition_string_agg(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "feature_transition").where("transition_id IS NOT NULL AND area_intensity IS NOT NULL").groupBy("feature_id", "transition_id").agg(F.round(F.max("area_intensity")).cast("long").alias("area"))
    ordered = rows.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("transition_id", "area"))).alias("_f"))  # a feature has the fragments of its assay
    text = lambda c: F.array_join(F.transform("_f", lambda x: x[c].cast("string")), ";")
    return ordered.select("feature_id", text("transition_id").alias("ids"), text("area").alias("areas"))


@QUERIES.add(
    "augmented_best_hypothesis",
    f"""WITH t AS (SELECT l_orderkey AS feature_id, entity AS hypothesis, pep, min(pep) OVER (PARTITION BY l_orderkey) AS best FROM ({OBSERVATIONS_SQL}))
SELECT feature_id, string_agg(DISTINCT hypothesis::varchar, ';' ORDER BY hypothesis::varchar) AS hypotheses, any_value(best) AS pep FROM t WHERE pep = best GROUP BY 1""",
)
def augmented_best_hypothesis(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf).select(F.col("l_orderkey").alias("feature_id"), F.col("entity").cast("string").alias("hypothesis"), "pep")
    best = rows.groupBy("feature_id").agg(F.min("pep").alias("pep"))
    ties = rows.join(best, ["feature_id", "pep"]).select("feature_id", "hypothesis", "pep").distinct()
    return ties.groupBy("feature_id").agg(F.array_join(F.array_sort(F.collect_list("hypothesis")), ";").alias("hypotheses"), F.first("pep").alias("pep"))


@QUERIES.add(
    "chromatogram_pivot",
    r"""SELECT regexp_extract(annotation || '_Precursor_i' || ordinal, '([a-z]\d+)_Precursor_i\d+', 1) AS native, charge, max(CASE WHEN type = 'b' THEN product_mz END) AS mz_b,
 max(CASE WHEN type = 'y' THEN product_mz END) AS mz_y, count(DISTINCT id) AS n FROM transition WHERE annotation IS NOT NULL GROUP BY 1, 2""",
)
def chromatogram_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "transition").where("annotation IS NOT NULL")
    native = F.regexp_extract(F.concat("annotation", F.lit("_Precursor_i"), "ordinal"), r"([a-z]\d+)_Precursor_i\d+", 1)
    pick = lambda k: F.max(F.when(F.col("type") == k, F.col("product_mz"))).alias(f"mz_{k}")
    return rows.groupBy(native.alias("native"), "charge").agg(pick("b"), pick("y"), F.count_distinct("id").alias("n"))


@QUERIES.add(
    "mass_window_match",
    """SELECT a.id AS precursor_id, b.id AS other_id, round(abs(a.precursor_mz - b.precursor_mz) / a.precursor_mz * 1e6, 6) AS ppm
FROM (SELECT DISTINCT id, group_label, precursor_mz, charge FROM precursor WHERE decoy = 0) a JOIN (SELECT DISTINCT id, group_label, precursor_mz, charge FROM precursor WHERE decoy = 1) b
ON a.group_label = b.group_label AND a.charge = b.charge WHERE abs(a.precursor_mz - b.precursor_mz) / a.precursor_mz * 1e6 <= 200000""",
)
def mass_window_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "precursor").select("id", "group_label", "precursor_mz", "charge", "decoy").distinct()
    a = rows.where("decoy = 0").select(F.col("id").alias("precursor_id"), "group_label", F.col("precursor_mz").alias("mz"), "charge").distinct()
    b = rows.where("decoy = 1").select(F.col("id").alias("other_id"), "group_label", F.col("precursor_mz").alias("other_mz"), "charge").distinct()
    ppm = F.abs(F.col("mz") - F.col("other_mz")) / F.col("mz") * 1e6
    return a.join(b, ["group_label", "charge"]).where(ppm <= 200000).select("precursor_id", "other_id", F.round(ppm, 6).alias("ppm"))


@QUERIES.add(
    "modification_map",
    """WITH p AS (SELECT DISTINCT id, modified_sequence AS m, replace(replace(replace(replace(modified_sequence, '(UniMod:4)', '(Carbamidomethyl)'), '(UniMod:35)', '(Oxidation)'),
 '(UniMod:21)', '(Phospho)'), '(UniMod:1)', '(Acetyl)') AS codename FROM peptide WHERE modified_sequence IS NOT NULL)
SELECT coalesce(a.codename, b.codename) AS codename, coalesce(a.id, b.id) AS unimod_id, coalesce(b.id, a.id) AS codename_id FROM (SELECT * FROM p WHERE m LIKE '%UniMod%') a
FULL JOIN (SELECT * FROM p WHERE m NOT LIKE '%UniMod%') b ON a.codename = b.codename""",
)
def modification_map(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.functions.peptides import codename

    rows = table(spark, sf, "peptide").where("modified_sequence IS NOT NULL").select("id", "modified_sequence").distinct().withColumn("codename", codename(F.col("modified_sequence")))
    has = F.col("modified_sequence").contains("UniMod")
    a = rows.where(has).select(F.col("id").alias("a"), F.col("codename").alias("ca"))
    b = rows.where(~has).select(F.col("id").alias("b"), F.col("codename").alias("cb"))
    met = a.join(b, F.col("ca") == F.col("cb"), "full_outer")
    return met.select(F.coalesce("ca", "cb").alias("codename"), F.coalesce("a", "b").alias("unimod_id"), F.coalesce("b", "a").alias("codename_id"))


@QUERIES.add(
    "cascade_filter",
    """WITH good AS (SELECT DISTINCT precursor_id FROM precursor_peptide_mapping WHERE peptide_id IN (SELECT peptide_id FROM score_peptide WHERE qvalue < 0.05 AND peptide_id IS NOT NULL)),
f AS (SELECT DISTINCT id, run_id, precursor_id FROM feature WHERE precursor_id IN (SELECT precursor_id FROM good))
SELECT 'feature' AS name, count(*) AS n FROM f UNION ALL SELECT 'score_ms2', count(*) FROM score_ms2 WHERE feature_id IN (SELECT id FROM f)
UNION ALL SELECT 'feature_transition', count(*) FROM feature_transition WHERE feature_id IN (SELECT id FROM f)""",
)
def cascade_filter(spark: SparkSession, sf: str) -> DataFrame:
    features, mapping, scores, ms2, fragments = _tables(spark, sf, "feature", "precursor_peptide_mapping", "score_peptide", "score_ms2", "feature_transition")
    good = mapping.join(scores.where("qvalue < 0.05 AND peptide_id IS NOT NULL").select("peptide_id"), "peptide_id", "left_semi").select("precursor_id").distinct()
    f = features.select("id", "run_id", "precursor_id").distinct().join(good, "precursor_id", "left_semi")
    ids = f.select(F.col("id").alias("feature_id")).distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [count(f, "feature"), count(ms2.join(ids, "feature_id", "left_semi"), "score_ms2"), count(fragments.join(ids, "feature_id", "left_semi"), "feature_transition")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@QUERIES.add(
    "cascade_subsample",
    """WITH f AS (SELECT DISTINCT id, run_id, precursor_id FROM feature WHERE precursor_id IS NOT NULL AND substr(md5(concat_ws('-', precursor_id, 42)), 1, 8) < '19999999')
SELECT DISTINCT t.feature_id, t.transition_id, f.run_id, f.precursor_id FROM feature_transition t JOIN f ON f.id = t.feature_id""",
)
def cascade_subsample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the precursors by hash, with all their features and fragments; sampling is the feature here."""
    features, fragments = _tables(spark, sf, "feature", "feature_transition")
    f = relational.hash_sample(features.where("precursor_id IS NOT NULL"), "precursor_id", 0.1).select("id", "run_id", "precursor_id").distinct()
    return fragments.select("feature_id", "transition_id").distinct().join(f, F.col("feature_id") == F.col("id")).drop("id")


@QUERIES.add(
    "reduce_rank1",
    f"SELECT entity, run, obs, round(score, 9) AS score FROM ({OBSERVATIONS_SQL}) QUALIFY row_number() OVER (PARTITION BY entity, run ORDER BY score DESC, {', '.join(TIES)}) = 1",
)
def reduce_rank1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.best_per_group(observations(spark, sf), ["entity", "run"], "score", TIES).select("entity", "run", "obs", "score"))


@QUERIES.add("merge_same_run", "SELECT l_orderkey, l_linenumber, l_partkey, 1 AS run_id FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1 FROM lineitem WHERE l_linestatus = 'F'")
def merge_same_run(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.operators.files import merge_runs

    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linestatus").alias("run_id"))
    return merge_runs([items.where("run_id = 'O'"), items.where("run_id = 'F'")], same_run=1)


@QUERIES.add("merge_into_one_run", "SELECT row_id, context, CASE WHEN run_id IS NOT NULL THEN 7 END AS run_id FROM score_peptide UNION ALL SELECT row_id, context, CASE WHEN run_id IS NOT NULL THEN 7 END FROM score_protein")
def merge_into_one_run(spark: SparkSession, sf: str) -> DataFrame:
    """Score rows follow their run; rows of the global context have none."""
    from quantloom.operators.files import in_one_run, merge_runs

    parts = [t.select("row_id", "context", "run_id") for t in _tables(spark, sf, "score_peptide", "score_protein")]
    return in_one_run(merge_runs(parts), 7, "score")


@QUERIES.add("split_null_semantics", "SELECT row_id, context, run_id FROM score_peptide WHERE run_id = (SELECT min(run_id) FROM score_peptide) OR run_id IS NULL")
def split_null_semantics(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.operators.files import run_part

    scores = table(spark, sf, "score_peptide").select("row_id", "context", "run_id")
    first = scores.agg(F.min("run_id").alias("_first"))
    return run_part(scores, "run_id", first)


@QUERIES.add("orphan_scores_not_in", "SELECT feature_id, count(*) AS n FROM score_ms2 WHERE feature_id IS NOT NULL AND feature_id NOT IN (SELECT id FROM feature WHERE id IS NOT NULL) GROUP BY 1")
def orphan_scores_not_in(spark: SparkSession, sf: str) -> DataFrame:
    scores, features = _tables(spark, sf, "score_ms2", "feature")
    return scores.where("feature_id IS NOT NULL").groupBy("feature_id").agg(F.count(F.lit(1)).alias("n")).join(features.select(F.col("id").alias("feature_id")), "feature_id", "left_anti")


@QUERIES.add(
    "wide_block_union",
    "SELECT id AS precursor_id, NULL::bigint AS transition_id, precursor_mz AS mz, 'precursor' AS kind FROM precursor UNION ALL SELECT NULL, id, product_mz, 'transition' FROM transition",
)
def wide_block_union(spark: SparkSession, sf: str) -> DataFrame:
    precursors, transitions = _tables(spark, sf, "precursor", "transition")
    a = precursors.select(F.col("id").alias("precursor_id"), F.col("precursor_mz").alias("mz"), F.lit("precursor").alias("kind"))
    b = transitions.select(F.col("id").alias("transition_id"), F.col("product_mz").alias("mz"), F.lit("transition").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@QUERIES.add(
    "full_join_chain",
    """SELECT coalesce(t.id, ft.transition_id) AS transition_id, t.n_types, ft.n_rows, ft.n_features FROM (SELECT id, count(DISTINCT type) AS n_types FROM transition GROUP BY id) t
FULL JOIN (SELECT transition_id, count(*) AS n_rows, count(DISTINCT feature_id) AS n_features FROM feature_transition WHERE transition_id IS NOT NULL GROUP BY 1) ft ON ft.transition_id = t.id""",
)
def full_join_chain(spark: SparkSession, sf: str) -> DataFrame:
    transitions, fragments = _tables(spark, sf, "transition", "feature_transition")
    a = transitions.groupBy(F.col("id").alias("transition_id")).agg(F.count_distinct("type").alias("n_types"))
    b = fragments.where("transition_id IS NOT NULL").groupBy("transition_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("feature_id").alias("n_features"))
    return a.join(b, "transition_id", "full_outer")


@QUERIES.add("best_context_rows", f"SELECT entity_id, run_id, context, round(score, 9) AS score FROM ({_WINNERS_SQL}) WHERE level = 'protein'")
def best_context_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = eav.context_rows(table(spark, sf, "score_protein"), "protein_id")
    order = Window.partitionBy("entity_id", "run_id", "context").orderBy(F.col("loaded_at").desc(), F.col("row_id").desc())
    return rounded(rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("entity_id", "run_id", "context", "score"))
