"""Queries of the general record operators: dangling references, wide tables, packed fields, drifting schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import drift, eav, orphans, packed
from quantloom.plans.registry import Registry
from quantloom.runtime import table

QUERIES = Registry()

#: The references of the feature store.
REFERENCES = (
    orphans.Reference("feature", "id", "precursor_id", "precursor"),
    orphans.Reference("precursor_peptide_mapping", "precursor_id", "peptide_id", "peptide"),
    orphans.Reference("score_ms2", "feature_id", "feature_id", "feature"),
    orphans.Reference("feature_transition", "feature_id", "transition_id", "transition"),
)

_ORPHANS_SQL = " UNION ALL ".join(
    f"""SELECT DISTINCT '{r.child}' AS child_table, c.{r.child_key} AS child_key, c.{r.ref} AS ref_id, strftime(c.loaded_at, '%Y-%m') AS period,
       CASE WHEN p.id IS NULL THEN 'missing' WHEN p.first_loaded > c.loaded_at THEN 'late' ELSE 'deleted' END AS status
FROM {r.child} c LEFT JOIN (SELECT id, min(loaded_at) AS first_loaded FROM {r.parent} GROUP BY id) p ON p.id = c.{r.ref}
WHERE c.{r.ref} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {r.parent} s WHERE s.id = c.{r.ref}
      AND s.loaded_at <= c.loaded_at AND (s.deleted_at IS NULL OR c.loaded_at < s.deleted_at))"""
    for r in REFERENCES
)


def all_orphans(spark: SparkSession, sf: str) -> DataFrame:
    found = [orphans.find_orphans(table(spark, sf, r.child), table(spark, sf, r.parent), r) for r in REFERENCES]
    return reduce(DataFrame.unionByName, found)


@QUERIES.add("p1_found", _ORPHANS_SQL)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return all_orphans(spark, sf)


@QUERIES.add(
    "p1_report",
    f"SELECT child_table, period, status, count(*) AS orphan_rows, count(DISTINCT ref_id) AS orphan_refs FROM ({_ORPHANS_SQL}) GROUP BY ALL",
)
def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(all_orphans(spark, sf))


_LEVELS = (("peptide", "score_peptide", "peptide_id"), ("protein", "score_protein", "protein_id"))
_LETTERS = "regexp_replace(regexp_replace(lower(context), '[^a-z]', '', 'g'), '^context', '')"
_CONTEXT_SQL = f"""CASE WHEN regexp_matches({_LETTERS}, '^glob(a|al)?$') OR levenshtein({_LETTERS}, 'global') <= 2 THEN 'global'
 WHEN regexp_matches({_LETTERS}, '^runspec[a-z]{{0,5}}$') OR levenshtein({_LETTERS}, 'runspecific') <= 2 THEN 'run-specific'
 WHEN regexp_matches({_LETTERS}, '^exp[a-z]{{0,7}}wide$') OR levenshtein({_LETTERS}, 'experimentwide') <= 2 THEN 'experiment-wide' END"""
_CELLS_SQL = " UNION ALL ".join(
    f"""SELECT '{level}' AS level, {entity} AS entity_id, CASE WHEN ctx = 'global' THEN 0 ELSE run_id END AS run_id, ctx AS context, row_id, score, qvalue, loaded_at
FROM (SELECT *, {_CONTEXT_SQL} AS ctx FROM {name}) WHERE {entity} IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
 AND ctx IS NOT NULL AND (ctx = 'global' OR run_id IS NOT NULL)"""
    for level, name, entity in _LEVELS
)
_WINNERS_SQL = f"SELECT * FROM ({_CELLS_SQL}) QUALIFY row_number() OVER (PARTITION BY level, entity_id, run_id, context ORDER BY loaded_at DESC, row_id DESC) = 1"


@QUERIES.add("p2_found", f"SELECT level, entity_id, run_id, context, row_id FROM ({_WINNERS_SQL})")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["entity_id", "run_id"]
    cells = [
        eav.filled_cells(eav.wide_context_scores(table(spark, sf, name), entity), keys, eav.CONTEXTS, "row_id", "context").select(F.lit(level).alias("level"), *keys, "context", "row_id")
        for level, name, entity in _LEVELS
    ]
    return cells[0].unionByName(cells[1])


def _wide_sql(level: str) -> str:
    cells = ", ".join(f"max(CASE WHEN context = '{a.value}' THEN {v} END) AS {a.prefix}_{v}" for a in eav.CONTEXTS for v in eav.CELL_TYPES)
    return f"SELECT entity_id, run_id, {cells} FROM ({_WINNERS_SQL}) WHERE level = '{level}' GROUP BY entity_id, run_id"


for _level, _name, _entity in _LEVELS:
    QUERIES.add(f"p2_wide_{_level}", _wide_sql(_level))(lambda spark, sf, n=_name, e=_entity: eav.wide_context_scores(table(spark, sf, n), e))


@QUERIES.add("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.split_packed(table(spark, sf, "fakelib"), "entry_id", ["proteinid", "genename"], min_values=2).drop("malformed")


@QUERIES.add("p4_values")
def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    return packed.split_packed(table(spark, sf, "fakelib"), "entry_id", ["proteinid", "genename"])


#: The columns of the feature score exports.
FEATURE_COLUMNS = {"feature_id": "long"} | {
    c: "double"
    for c in """area_intensity apex_intensity total_area_intensity total_mi exp_im delta_im var_bseries_score var_dotprod_score var_im_ms1_delta_score
    var_isotope_correlation_score var_isotope_overlap_score var_library_corr var_log_sn_score var_massdev_score var_mi_score var_norm_rt_score
    var_xcorr_coelution var_xcorr_shape var_yseries_score""".split()
}


@QUERIES.add("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf, "feature_ms_raw"))


@QUERIES.add("p6_unified")
def p6_unified(spark: SparkSession, sf: str) -> DataFrame:
    wide = drift.unified(table(spark, sf, "feature_ms_raw"), FEATURE_COLUMNS)
    return wide.withColumn("others", F.to_json("others"))
