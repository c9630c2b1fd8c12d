"""Queries of this package and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import mixing, splits, subjects, tokens, topn
from quantloom.plans.registry import Registry
from quantloom.runtime import table

QUERIES = Registry()


@QUERIES.add(
    "p3_found",
    """SELECT run_id, precursor_id, id AS feature_id, row_number() OVER (PARTITION BY run_id, precursor_id ORDER BY score DESC, id) AS pos
FROM (SELECT DISTINCT id, run_id, precursor_id FROM feature WHERE precursor_id IS NOT NULL AND id IS NOT NULL) f
JOIN (SELECT feature_id, max(score) AS score FROM score_ms2 WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY feature_id) s ON s.feature_id = f.id
QUALIFY pos <= 3""",
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    scored = topn.best_scored(table(spark, sf, "feature"), table(spark, sf, "score_ms2"))
    return topn.top_n(scored, ["run_id", "precursor_id"], "score", ["feature_id"], 3).select("run_id", "precursor_id", "feature_id", "pos")


_NAMED = "SELECT DISTINCT id, traml_id, decoy FROM precursor WHERE id IS NOT NULL AND traml_id IS NOT NULL"
_EDGES_SQL = f"""SELECT DISTINCT x.precursor_id AS a, y.precursor_id AS b FROM precursor_peptide_mapping x JOIN precursor_peptide_mapping y USING (peptide_id)
UNION SELECT d.id, t.id FROM (SELECT id, traml_id, unnest([regexp_replace(traml_id, '{splits.START}', ''), regexp_replace(traml_id, '{splits.END}', '')]) AS name FROM ({_NAMED}) WHERE decoy = 1) d
JOIN ({_NAMED}) t ON t.traml_id = d.name AND t.decoy = 0 AND d.name <> d.traml_id"""


@QUERIES.add(
    "p5_found",
    f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_EDGES_SQL}) UNION SELECT b, a FROM ({_EDGES_SQL})),
r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT node AS precursor_id, min(seen) AS set_id FROM r WHERE node IN (SELECT id FROM precursor) GROUP BY node HAVING count(DISTINCT seen) > 1""",
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.precursor_sets(table(spark, sf, "precursor"), table(spark, sf, "precursor_peptide_mapping"))


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.feature_splits(table(spark, sf, "feature"), table(spark, sf, "precursor"), table(spark, sf, "precursor_peptide_mapping"))


@QUERIES.add("p5_splits")
def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _splits(spark, sf)


@QUERIES.add("p5_shares")
def p5_shares(spark: SparkSession, sf: str) -> DataFrame:
    return splits.reached_shares(_splits(spark, sf), ["run_id", "decoy"], splits.SHARES)


@QUERIES.add("p7_ids")
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), tokens.token_count(F.col("text")))


@QUERIES.add("p8_mix")
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


@QUERIES.add("p8_shares")
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects.document_subjects(table(spark, sf, "documents"), table(spark, sf, "subject_labels"), table(spark, sf, "subjects"))


@QUERIES.add("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf)


@QUERIES.add("p9_composition")
def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    found = _subjects(spark, sf)
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
