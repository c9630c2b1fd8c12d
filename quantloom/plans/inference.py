"""Queries of Bayesian inference: precursors, peptidoforms, support filters, propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import bayes
from quantloom.plans.proxies import OBSERVATIONS_SQL, observations, rounded
from quantloom.plans.registry import Registry

QUERIES = Registry()


def _peps(spark: SparkSession, sf: str) -> DataFrame:
    """A feature per observation: MS1 evidence missing for the first line of an order, MS2 for the second."""
    rows = observations(spark, sf)
    return rows.select(
        F.col("obs").alias("feature_id"),
        F.when(F.col("l_linenumber") != 1, F.col("pep")).alias("ms1_precursor_pep"),
        F.when(~F.col("l_linenumber").isin(1, 2), F.col("pep1")).alias("ms2_precursor_pep"),
        F.round(F.col("quantity") / 51, 4).alias("ms2_peakgroup_pep"),
    )


_PEPS_SQL = f"""SELECT obs AS feature_id, CASE WHEN l_linenumber <> 1 THEN pep END AS ms1, CASE WHEN l_linenumber NOT IN (1, 2) THEN pep1 END AS ms2,
 round(quantity / 51, 4) AS pg FROM ({OBSERVATIONS_SQL})"""
_POSTERIOR_SQL = f"""WITH f AS ({_PEPS_SQL}), l AS (SELECT feature_id, pg,
 (1 - pg) * CASE WHEN ms1 IS NULL AND ms2 IS NULL THEN 0.0 ELSE (1 - coalesce(ms1, 0)) * (1 - coalesce(ms2, 0)) END AS t,
 pg * CASE WHEN ms1 IS NULL AND ms2 IS NULL THEN 1.0 ELSE coalesce(ms1, 1) * coalesce(ms2, 1) END AS f FROM f)
SELECT feature_id, round(1 - coalesce(t / nullif(t + f, 0), 0.0), 9) AS precursor_peakgroup_pep FROM l"""


@QUERIES.add("precursor_posterior", f"SELECT * FROM ({_POSTERIOR_SQL}) WHERE precursor_peakgroup_pep < 0.4")
def precursor_posterior(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bayes.precursor_inference(_peps(spark, sf), max_pep=1.1)).where("precursor_peakgroup_pep < 0.4")


def _transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as features, their lines as transitions, up to three peptidoforms per order and the null one."""
    rows = observations(spark, sf).select(F.col("l_orderkey").alias("feature_id"), F.concat_ws("-", "l_linenumber", "entity", "l_suppkey").alias("transition_id"), "pep", "entity")
    forms = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1), F.lit(2))).alias("peptide_id")
    rows = rows.select("*", forms).where("peptide_id <= feature_id % 3")
    mask = ((F.col("peptide_id") >= 0) & (F.pmod("entity", F.lit(3)) == F.col("peptide_id"))).cast("int")
    return rows.select("feature_id", "transition_id", "pep", "peptide_id", mask.alias("bmask"), (F.col("feature_id") % 3 + 1).cast("int").alias("num_peptidoforms"))


_TRANSITIONS_SQL = f"""SELECT l_orderkey AS feature_id, concat_ws('-', l_linenumber, entity, l_suppkey) AS transition_id, pep, peptide_id,
 (peptide_id >= 0 AND entity % 3 = peptide_id)::int AS bmask, (l_orderkey % 3 + 1)::int AS num_peptidoforms
FROM ({OBSERVATIONS_SQL}), (SELECT unnest([-1, 0, 1, 2]) AS peptide_id) WHERE peptide_id <= l_orderkey % 3"""


def _precursors(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf).groupBy(F.col("l_orderkey").alias("feature_id")).agg(F.min("pep1").alias("precursor_peakgroup_pep"))
    return rows.where("precursor_peakgroup_pep < 0.4")


_PRECURSORS_SQL = f"SELECT l_orderkey AS feature_id, min(pep1) AS ppep FROM ({OBSERVATIONS_SQL}) GROUP BY 1 HAVING min(pep1) < 0.4"
_FORMS_SQL = f"""WITH m AS (SELECT * FROM ({_TRANSITIONS_SQL}) JOIN ({_PRECURSORS_SQL}) USING (feature_id)),
e AS (SELECT feature_id, peptide_id, any_value(num_peptidoforms) AS nf, any_value(ppep) AS ppep, product(CASE WHEN bmask = 1 THEN 1 - pep ELSE pep END)
 * min(CASE WHEN peptide_id = -1 THEN ppep ELSE (1 - ppep) / num_peptidoforms END) AS l FROM m GROUP BY 1, 2),
p AS (SELECT *, coalesce(l / nullif(sum(l) OVER (PARTITION BY feature_id), 0), 0.0) AS post, round(1 - post, 9) AS pep FROM e)"""


@QUERIES.add(
    "peptidoform_posterior",
    f"""{_FORMS_SQL} SELECT feature_id, peptide_id, round(ppep, 9) AS precursor_peakgroup_pep, pep, round(avg(pep) OVER (ORDER BY pep RANGE UNBOUNDED PRECEDING), 7) AS qvalue
FROM p WHERE peptide_id <> -1""",
)
def peptidoform_posterior(spark: SparkSession, sf: str) -> DataFrame:
    return _inferred(spark, sf, False)


@QUERIES.add(
    "peptidoform_posterior_grouped",
    f"""{_FORMS_SQL} SELECT feature_id, peptide_id, round(ppep, 9) AS precursor_peakgroup_pep, pep, round(avg(pep) OVER (PARTITION BY nf ORDER BY pep RANGE UNBOUNDED PRECEDING), 7) AS qvalue
FROM p WHERE peptide_id <> -1""",
)
def peptidoform_posterior_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return _inferred(spark, sf, True)


def _inferred(spark: SparkSession, sf: str, grouped: bool) -> DataFrame:
    from quantloom.operators.stats import model_fdr

    # Error probabilities are rounded before they are ranked, so that ties don't hang on the order of multiplication.
    found = bayes.peptidoform_inference(_transitions(spark, sf), _precursors(spark, sf)).drop("qvalue")
    found = found.withColumn("pep", F.round("pep", 9)).withColumn("nf", F.col("feature_id") % 3)
    found = model_fdr(found, "pep", ("nf",) if grouped else (), "qvalue").drop("nf")
    return found.select("feature_id", "peptide_id", F.round("precursor_peakgroup_pep", 9).alias("precursor_peakgroup_pep"), "pep", F.round("qvalue", 7).alias("qvalue"))


@QUERIES.add("bayes_log_space", f"{_FORMS_SQL} SELECT feature_id, peptide_id AS hypothesis, round(post, 12) AS posterior FROM p")
def bayes_log_space(spark: SparkSession, sf: str) -> DataFrame:
    model = bayes.transition_model(_transitions(spark, sf).join(_precursors(spark, sf), "feature_id"))
    return bayes.posteriors(model, log_space=True).select("feature_id", "hypothesis", F.round("posterior", 12).alias("posterior"))


_SUPPORT_SQL = f"""SELECT feature_id, peptide_id, count(DISTINCT CASE WHEN bmask = 1 THEN transition_id END) AS supporting_transitions,
 count(DISTINCT CASE WHEN bmask = 1 AND num_peptidoforms = 1 THEN transition_id END) AS unique_supporting_transitions,
 count(DISTINCT CASE WHEN bmask = 1 AND pep < 0.2 THEN transition_id END) AS phospho_loss_supporting_transitions,
 median(CASE WHEN bmask = 1 THEN pep END) AS median_supporting_isotope_overlap FROM (SELECT DISTINCT feature_id, peptide_id, transition_id, bmask, num_peptidoforms, pep FROM ({_TRANSITIONS_SQL}))
 WHERE peptide_id <> -1 GROUP BY 1, 2"""


def _support(spark: SparkSession, sf: str) -> DataFrame:
    rows = _transitions(spark, sf).select(
        "feature_id", "peptide_id", "transition_id", "bmask",
        F.col("num_peptidoforms").alias("n_mapped_peptides"), (F.col("pep") < 0.2).cast("int").alias("has_phospho_loss"), F.col("pep").alias("isotope_overlap_score"),
    )
    return bayes.support_metrics(rows)


@QUERIES.add("support_metrics", f"SELECT feature_id, peptide_id, supporting_transitions, unique_supporting_transitions, phospho_loss_supporting_transitions, round(median_supporting_isotope_overlap, 9) AS median_supporting_isotope_overlap FROM ({_SUPPORT_SQL})")
def support_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_support(spark, sf))


@QUERIES.add("post_inference_filters", f"SELECT feature_id, peptide_id FROM ({_SUPPORT_SQL}) WHERE supporting_transitions >= 1 AND (supporting_transitions >= 2 OR phospho_loss_supporting_transitions > 0)")
def post_inference_filters(spark: SparkSession, sf: str) -> DataFrame:
    return bayes.support_filter(_support(spark, sf), min_supporting=1, phospho_loss_below=2).select("feature_id", "peptide_id")


@QUERIES.add(
    "evidence_peptidoform_space",
    f"""WITH ev AS (SELECT l_orderkey AS feature_id, l_linenumber AS transition_id, min(pep) AS pep FROM ({OBSERVATIONS_SQL}) WHERE pep < 0.6 GROUP BY 1, 2),
sp AS (SELECT DISTINCT l_orderkey AS feature_id, p_brand AS peptide FROM lineitem JOIN part ON p_partkey = l_partkey UNION SELECT DISTINCT l_orderkey, 'none' FROM lineitem),
mask AS (SELECT DISTINCT l_linenumber AS transition_id, p_brand AS peptide, 1 AS bmask FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 3),
n AS (SELECT feature_id, count(*) AS num_peptidoforms FROM sp WHERE peptide <> 'none' GROUP BY 1)
SELECT sp.feature_id, transition_id, peptide, coalesce(round(pep, 9), 0) AS pep, coalesce(bmask, 0) AS bmask, num_peptidoforms FROM ev FULL JOIN sp USING (feature_id)
LEFT JOIN mask USING (transition_id, peptide) JOIN n ON n.feature_id = sp.feature_id""",
)
def evidence_peptidoform_space(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.runtime import table

    rows = observations(spark, sf)
    evidence = rows.where("pep < 0.6").groupBy(F.col("l_orderkey").alias("feature_id"), F.col("l_linenumber").alias("transition_id")).agg(F.min("pep").alias("pep"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("peptide"), "p_size")
    met = rows.select(F.col("l_orderkey").alias("feature_id"), F.col("l_linenumber").alias("transition_id"), "entity").join(parts, "entity")
    space = met.select("feature_id", "peptide").distinct()
    counts = space.groupBy("feature_id").agg(F.count(F.lit(1)).alias("num_peptidoforms"))
    space = space.unionByName(rows.select(F.col("l_orderkey").alias("feature_id"), F.lit("none").alias("peptide")).distinct())
    mask = met.where("p_size <= 3").select("transition_id", "peptide", F.lit(1).alias("bmask")).distinct()
    told = evidence.join(space, "feature_id", "full_outer").join(mask, ["transition_id", "peptide"], "left").join(counts, "feature_id")
    return rounded(told.na.fill(0, ["pep", "bmask"]))


@QUERIES.add(
    "propagated_peptidoforms",
    f"""WITH e AS (SELECT l_suppkey AS alignment_group_id, l_orderkey AS feature_id, l_orderkey % 5 <> 0 AS is_aligned, l_linenumber AS transition_id, (entity % 3)::int AS peptide_id, 1 AS bmask,
 (l_orderkey % 3 + 1)::int AS num_peptidoforms, pep, pep1 AS precursor_peakgroup_pep FROM ({OBSERVATIONS_SQL})),
f AS (SELECT DISTINCT alignment_group_id, feature_id FROM e WHERE is_aligned)
SELECT alignment_group_id, feature_id, num_peptidoforms, transition_id, peptide_id, bmask, round(pep, 9) AS pep, round(precursor_peakgroup_pep, 9) AS precursor_peakgroup_pep FROM e WHERE NOT is_aligned
UNION ALL SELECT f.alignment_group_id, f.feature_id, o.num_peptidoforms, o.transition_id, o.peptide_id, o.bmask, round(min(o.pep), 9), round(min(o.precursor_peakgroup_pep), 9)
FROM f JOIN e o ON o.alignment_group_id = f.alignment_group_id AND o.is_aligned AND (o.feature_id = f.feature_id OR o.pep <= 0.1) GROUP BY ALL""",
)
def propagated_peptidoforms(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf).select(
        F.col("l_suppkey").alias("alignment_group_id"), F.col("l_orderkey").alias("feature_id"), (F.col("l_orderkey") % 5 != 0).alias("is_aligned"), F.col("l_linenumber").alias("transition_id"),
        (F.col("entity") % 3).cast("int").alias("peptide_id"), F.lit(1).alias("bmask"), (F.col("l_orderkey") % 3 + 1).cast("int").alias("num_peptidoforms"), "pep", F.col("pep1").alias("precursor_peakgroup_pep"),
    )
    return bayes.propagated(rows, 0.1)  # observations round both values to 4 digits, so 9 digits of the many rows that come out are the same
