"""Queries of matrices, libraries and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import peptides
from quantloom.operators import quant, report, stats
from quantloom.plans.proxies import OBSERVATIONS_SQL, TIES, observations, rounded
from quantloom.plans.registry import Registry
from quantloom.runtime import table

QUERIES = Registry()
RUNS = ("F", "O")

_BEST = f"SELECT * FROM ({OBSERVATIONS_SQL}) WHERE decoy = 0 QUALIFY row_number() OVER (PARTITION BY entity, run ORDER BY pep, {', '.join(TIES)}) = 1"
_PIVOT = ", ".join(f"""round(avg(intensity) FILTER (run = '{r}'), 9) AS "{r}\"""" for r in RUNS)


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return quant.best_peak_groups(observations(spark, sf).where("decoy = 0"), ["entity", "run"], "pep", TIES)


@QUERIES.add("precursor_matrix", f"SELECT entity, {_PIVOT} FROM ({_BEST}) GROUP BY entity")
def precursor_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quant.pivoted(_best(spark, sf), ["entity"], "run", "intensity", RUNS))


_PARTS = f"SELECT b.*, p_brand AS peptide, p_type AS protein FROM ({_BEST}) b JOIN part ON p_partkey = entity"
_TOP3 = f"""SELECT x.* FROM ({_PARTS}) x JOIN (SELECT peptide, entity FROM (SELECT peptide, entity, median(intensity) AS m FROM ({_PARTS}) GROUP BY 1, 2)
 QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY m DESC, entity) <= 3) USING (peptide, entity)"""


def _with_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("peptide"), F.col("p_type").alias("protein"))
    return _best(spark, sf).join(parts, "entity")


@QUERIES.add("peptide_matrix", f"SELECT peptide, {_PIVOT} FROM ({_TOP3}) GROUP BY peptide")
def peptide_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quant.pivoted(quant.top_items(_with_parts(spark, sf), "peptide", "entity", "run", "intensity", 3), ["peptide"], "run", "intensity", RUNS))


@QUERIES.add(
    "peptide_matrix_per_run",
    f"SELECT peptide, {_PIVOT} FROM (SELECT * FROM ({_PARTS}) QUALIFY row_number() OVER (PARTITION BY peptide, run ORDER BY intensity DESC, entity) <= 3) GROUP BY peptide",
)
def peptide_matrix_per_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = quant.top_items(_with_parts(spark, sf), "peptide", "entity", "run", "intensity", 3, consistent=False)
    return rounded(quant.pivoted(rows, ["peptide"], "run", "intensity", RUNS))


def _summary_sql(parent: str, owners: str) -> str:
    """Means of the top precursors of a peptide, then of the top peptides of a parent, by run."""
    return f"""WITH pep AS (SELECT peptide, run, avg(intensity) AS intensity FROM ({_TOP3}) GROUP BY 1, 2), own AS (SELECT DISTINCT peptide, {parent} FROM ({owners})), x AS (SELECT * FROM pep JOIN own USING (peptide)),
t AS (SELECT {parent}, peptide FROM (SELECT {parent}, peptide, median(intensity) AS m FROM x GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY {parent} ORDER BY m DESC, peptide) <= 3)
SELECT {parent}, {_PIVOT} FROM x JOIN t USING ({parent}, peptide) GROUP BY {parent}"""


@QUERIES.add("protein_matrix", _summary_sql("protein", _PARTS))
def protein_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = quant.summarised(_with_parts(spark, sf), "protein", "peptide", "entity", "run", "intensity", 3)
    return rounded(quant.pivoted(rows, ["protein"], "run", "intensity", RUNS))


@QUERIES.add("gene_matrix", _summary_sql("gene", f"SELECT peptide, unnest([p_size % 5, p_size % 7 + 10]) AS gene FROM ({_PARTS}) JOIN part ON p_partkey = entity"))
def gene_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Two genes per part, as an array."""
    genes = table(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.array(F.col("p_size") % 5, F.col("p_size") % 7 + 10).alias("gene"))
    rows = quant.summarised(_with_parts(spark, sf).join(genes, "entity"), "gene", "peptide", "entity", "run", "intensity", 3)
    return rounded(quant.pivoted(rows, ["gene"], "run", "intensity", RUNS))


@QUERIES.add(
    "matrix_median_normalised",
    f"""WITH b AS ({_BEST}), m AS (SELECT run, median(intensity) AS m FROM b GROUP BY run), n AS (SELECT entity, run, intensity / m * (SELECT median(m) FROM m) AS intensity FROM b JOIN m USING (run))
SELECT entity, {_PIVOT} FROM n GROUP BY entity""",
)
def matrix_median_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quant.pivoted(quant.median_normalised(_best(spark, sf), "run", "intensity"), ["entity"], "run", "intensity", RUNS))


@QUERIES.add(
    "matrix_quantile_normalised",
    f"""WITH b AS (SELECT entity, run, intensity, row_number() OVER (PARTITION BY run ORDER BY intensity, entity) - 1 AS r, count(*) OVER (PARTITION BY run) AS n FROM ({_BEST})),
w AS (SELECT max(n) AS n FROM b), j AS (SELECT run, j, j::double * (max(b.n) - 1) / greatest(max(w.n) - 1, 1) AS pos FROM b, w, unnest(range((SELECT max(n) FROM b))) AS g(j) WHERE r = 0 GROUP BY run, j),
v AS (SELECT j.run, j.j, lo.intensity + coalesce(hi.intensity - lo.intensity, 0) * (pos - floor(pos)) AS v FROM j JOIN b lo ON lo.run = j.run AND lo.r = floor(pos) LEFT JOIN b hi ON hi.run = j.run AND hi.r = floor(pos) + 1),
m AS (SELECT j, avg(v) AS v FROM v GROUP BY j),
q AS (SELECT entity, run, r::double * (w.n - 1) / greatest(b.n - 1, 1) AS pos FROM b, w),
t AS (SELECT entity, run, lo.v + coalesce(hi.v - lo.v, 0) * (pos - floor(pos)) AS intensity FROM q JOIN m lo ON lo.j = floor(pos) LEFT JOIN m hi ON hi.j = floor(pos) + 1)
SELECT entity, {_PIVOT.replace("9)", "6)")} FROM t GROUP BY entity""",
)
def matrix_quantile_normalised(spark: SparkSession, sf: str) -> DataFrame:
    rows = quant.quantile_normalised(_best(spark, sf), "run", "intensity", ["entity"])
    return rounded(quant.pivoted(rows, ["entity"], "run", "intensity", RUNS), 6)


@QUERIES.add(
    "spectral_library",
    """WITH f AS (SELECT *, fragmenttype || fragmentseriesnumber || '^' || productcharge AS fragment, modifiedpeptidesequence || '/' || precursorcharge || '/' || decoy AS precursor FROM fakelib WHERE libraryintensity IS NOT NULL),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY precursor, fragment ORDER BY libraryintensity DESC, entry_id) = 1),
k AS (SELECT * FROM o QUALIFY count(*) OVER (PARTITION BY precursor) >= 3),
e AS (SELECT min(normalizedretentiontime) AS lo, max(normalizedretentiontime) AS hi FROM k)
SELECT precursor, fragment, entry_id, round(libraryintensity / max(libraryintensity) OVER (PARTITION BY precursor) * 10000, 9) AS relative_intensity,
 round((normalizedretentiontime - lo) / (hi - lo) * 100, 9) AS irt FROM k, e""",
)
def spectral_library(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fakelib").select(
        "entry_id", "libraryintensity", "normalizedretentiontime",
        F.concat(F.col("fragmenttype"), F.col("fragmentseriesnumber"), F.lit("^"), F.col("productcharge")).alias("fragment"),
        F.concat(F.col("modifiedpeptidesequence"), F.lit("/"), F.col("precursorcharge"), F.lit("/"), F.col("decoy")).alias("precursor"),
    )
    told = quant.spectral_library(rows, "precursor", "fragment", "libraryintensity", [F.col("libraryintensity").desc(), F.col("entry_id")], 3, "normalizedretentiontime")
    return rounded(told.select("precursor", "fragment", "entry_id", "relative_intensity", "irt"))


@QUERIES.add(
    "fragment_count_histogram",
    "SELECT n_fragments, count(*) AS n FROM (SELECT modifiedpeptidesequence, precursorcharge, count(DISTINCT fragmenttype || fragmentseriesnumber) AS n_fragments FROM fakelib GROUP BY 1, 2) GROUP BY 1",
)
def fragment_count_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fakelib").groupBy("modifiedpeptidesequence", "precursorcharge")
    return rows.agg(F.count_distinct(F.concat("fragmenttype", "fragmentseriesnumber")).alias("n_fragments")).groupBy("n_fragments").agg(F.count(F.lit(1)).alias("n"))


_MASS_CASE = " ".join(f"WHEN '{a}' THEN {m}" for a, m in peptides.RESIDUES.items())


@QUERIES.add(
    "peptide_masses",
    f"""SELECT id, unmodified_sequence, round(18.0105646863 + sum(CASE aa {_MASS_CASE} END), 6) AS mass FROM
 (SELECT id, unmodified_sequence, unnest(string_split(unmodified_sequence, '')) AS aa FROM (SELECT DISTINCT id, unmodified_sequence FROM peptide WHERE unmodified_sequence <> '')) GROUP BY 1, 2""",
)
def peptide_masses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "peptide").select("id", "unmodified_sequence").distinct().where("unmodified_sequence <> ''")
    return rows.withColumn("mass", F.round(peptides.peptide_mass(F.col("unmodified_sequence")), 6))


_MASS_MAP = "MAP {" + ", ".join(f"'{a}': {m}" for a, m in peptides.RESIDUES.items()) + "}"


@QUERIES.add(
    "peptide_fragments",
    f"""WITH p AS (SELECT DISTINCT id, unmodified_sequence AS s FROM peptide WHERE unmodified_sequence <> ''), i AS (SELECT id, s, unnest(generate_series(1, len(s) - 1)) AS i FROM p),
m AS (SELECT *, list_transform(string_split(s, ''), lambda a: {_MASS_MAP}[a]) AS m FROM i)
SELECT id, 'b' AS type, i::int AS ordinal, round(list_sum(m[1:i]) + {peptides.PROTON}, 6) AS mz FROM m UNION ALL SELECT id, 'y', i::int, round(list_sum(m[len(s) - i + 1:]) + {peptides.WATER} + {peptides.PROTON}, 6) FROM m""",
)
def peptide_fragments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "peptide").select("id", "unmodified_sequence").distinct().where("unmodified_sequence <> ''")
    return rows.select("id", F.inline(peptides.fragments(F.col("unmodified_sequence")))).withColumn("mz", F.round("mz", 6))


_SERIES = " UNION ALL ".join(
    f"SELECT id, '{kind}' AS type, i::int AS ordinal, '{loss}' AS loss, {z} AS charge, round((list_sum({'m[1:i]' if kind in peptides.FROM_START else 'm[len(m) - i + 1:]'}) + {peptides.atoms_mass(peptides.ION_ATOMS[kind]) - peptides.atoms_mass(peptides.LOSSES[loss]) + z * peptides.PROTON!r}) / {z}, 6) AS mz FROM x"
    for kind in peptides.ION_ATOMS for loss in ("", "H2O") for z in (1, 2)
)


@QUERIES.add(
    "fragment_series",
    rf"""WITH p AS (SELECT DISTINCT id, modified_sequence AS s FROM peptide WHERE modified_sequence IS NOT NULL), r AS (SELECT id, s, regexp_extract_all(regexp_replace(s, '^[.]?((\([^)]*\))*)([A-Z])', '\3\1'), '[A-Z](\([^)]*\))*') AS tokens FROM p),
m AS (SELECT id, s, list_transform(tokens, lambda t: {_MASS_MAP}[t[1]] + coalesce(list_sum(list_transform(regexp_extract_all(t, '\([^)]*\)'), lambda c: MAP {{{", ".join(f"'{c}': {v}" for c, v in peptides.MODIFICATIONS.items())}}}[c])), 0)) AS m FROM r),
x AS (SELECT id, m, unnest(generate_series(1, len(m) - 1)) AS i FROM m) {_SERIES}""",
)
def fragment_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "peptide").where("modified_sequence IS NOT NULL").select("id", "modified_sequence").distinct()
    series = peptides.ion_series(F.col("modified_sequence"), tuple(peptides.ION_ATOMS), (1, 2), ("", "H2O"))
    return rows.select("id", F.inline(series)).withColumn("mz", F.round("mz", 6))


# Reports. An identification is a part, a run a line status or a supplier's nation.


@QUERIES.add(
    "id_statistics",
    f"""WITH o AS (SELECT run, entity, pep1 FROM ({OBSERVATIONS_SQL}) WHERE decoy = 0)
SELECT run, count(DISTINCT entity) FILTER (pep1 < 0.01) AS n_01, count(DISTINCT entity) FILTER (pep1 < 0.05) AS n_05, count(DISTINCT entity) FILTER (pep1 < 0.1) AS n_1 FROM o GROUP BY run
UNION ALL SELECT NULL, count(DISTINCT entity) FILTER (pep1 < 0.01), count(DISTINCT entity) FILTER (pep1 < 0.05), count(DISTINCT entity) FILTER (pep1 < 0.1) FROM o""",
)
def id_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return report.id_counts(observations(spark, sf).where("decoy = 0"), "run", "entity", "pep1")


@QUERIES.add(
    "run_summary",
    f"""SELECT run, count(*) AS n, count(DISTINCT entity) AS n_ids, round(avg(intensity), 6) AS mean, round(median(intensity), 6) AS median, round(stddev_samp(intensity), 6) AS std,
 round(min(intensity), 6) AS min, round(max(intensity), 6) AS max FROM ({OBSERVATIONS_SQL}) GROUP BY run""",
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.run_summary(observations(spark, sf), "run", "entity", "intensity"), 6)


_BY_NATION = "SELECT l_partkey AS entity, s_nationkey AS run, l_extendedprice AS intensity, l_returnflag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"


def _by_nation(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("run"))
    items = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("entity"), F.col("l_extendedprice").alias("intensity"), "l_returnflag")
    return items.join(suppliers, "l_suppkey").drop("l_suppkey")


@QUERIES.add(
    "run_cv",
    f"SELECT entity, count(*) AS n_runs, round(stddev_samp(v) / avg(v), 9) AS cv FROM (SELECT entity, run, max(intensity) AS v FROM ({_BY_NATION}) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2",
)
def run_cv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.variation(_by_nation(spark, sf), "entity", "run", "intensity"))


@QUERIES.add(
    "run_jaccard",
    f"""WITH o AS (SELECT DISTINCT entity, run FROM ({_BY_NATION})), s AS (SELECT run, count(*) AS n FROM o GROUP BY run),
c AS (SELECT a.run AS run_a, b.run AS run_b, count(*) AS common FROM o a JOIN o b ON a.entity = b.entity AND a.run < b.run GROUP BY 1, 2)
SELECT run_a, run_b, common, round(common / (x.n + y.n - common), 9) AS jaccard FROM c JOIN s x ON x.run = run_a JOIN s y ON y.run = run_b""",
)
def run_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.jaccard(_by_nation(spark, sf), "entity", "run"))


@QUERIES.add(
    "run_spearman",
    f"""WITH o AS (SELECT entity, run, max(intensity) AS v FROM ({_BY_NATION}) GROUP BY 1, 2),
p AS (SELECT a.run AS run_a, b.run AS run_b, a.v AS va, b.v AS vb FROM o a JOIN o b ON a.entity = b.entity AND a.run < b.run),
r AS (SELECT run_a, run_b, rank() OVER (PARTITION BY run_a, run_b ORDER BY va) + (count(*) OVER (PARTITION BY run_a, run_b, va) - 1) / 2 AS ra,
 rank() OVER (PARTITION BY run_a, run_b ORDER BY vb) + (count(*) OVER (PARTITION BY run_a, run_b, vb) - 1) / 2 AS rb FROM p)
SELECT run_a, run_b, count(*) AS n, round(corr(ra, rb), 9) AS rho FROM r GROUP BY 1, 2""",
)
def run_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.spearman(_by_nation(spark, sf), "entity", "run", "intensity"))


@QUERIES.add("run_intersection", f"SELECT n_runs, count(*) AS n_ids FROM (SELECT entity, count(DISTINCT run) AS n_runs FROM ({_BY_NATION}) GROUP BY 1) GROUP BY 1")
def run_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return report.in_all_runs(_by_nation(spark, sf), "entity", "run")


@QUERIES.add(
    "consistency_curve",
    f"""WITH o AS (SELECT DISTINCT entity, run FROM ({_BY_NATION})), u AS (SELECT DISTINCT run FROM o), d AS (SELECT unnest(generate_series(1, 100)) AS draw),
p AS (SELECT run, draw, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('-', run, draw, 7)), run) AS place FROM u, d),
n AS (SELECT count(*) AS runs FROM u), s AS (SELECT entity, draw, list_sort(list(place)) AS places FROM o JOIN p USING (run) GROUP BY 1, 2),
t AS (SELECT draw, places[1] AS first, coalesce(list_max(list_filter(range(1, len(places) + 1), lambda i: places[i] = i)), 0) AS until, count(*) AS c FROM s GROUP BY 1, 2, 3)
SELECT k::int AS k, sum(c) FILTER (first <= k) / 100 AS mean_any, coalesce(sum(c) FILTER (until >= k), 0) / 100 AS mean_common FROM t, (SELECT unnest(generate_series(1, (SELECT runs FROM n))) AS k) GROUP BY k""",
)
def consistency_curve(spark: SparkSession, sf: str) -> DataFrame:
    return report.consistency_curve(_by_nation(spark, sf), "entity", "run")


@QUERIES.add(
    "ecdf_pp",
    f"SELECT decoy, score, round(n / max(n) OVER (PARTITION BY decoy), 9) AS ecdf FROM (SELECT DISTINCT decoy, round(score, 2) AS score, count(*) OVER (PARTITION BY decoy ORDER BY round(score, 2)) AS n FROM ({OBSERVATIONS_SQL}))",
)
def ecdf_pp(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.ecdf(observations(spark, sf).select("decoy", F.round("score", 2).alias("score")), "score", ("decoy",)))


@QUERIES.add(
    "kde_binning",
    f"""WITH e AS (SELECT min(intensity) AS lo, (max(intensity) - min(intensity)) / 200 AS step FROM ({OBSERVATIONS_SQL})),
x AS (SELECT (intensity - lo) / step AS place, least(floor((intensity - lo) / step), 199)::int AS b FROM ({OBSERVATIONS_SQL}), e)
SELECT bin, round(sum(w), 6) AS weight FROM (SELECT b AS bin, 1 - (place - b) AS w FROM x UNION ALL SELECT b + 1, place - b FROM x) GROUP BY bin""",
)
def kde_binning(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.linear_bins(observations(spark, sf), "intensity", bins=200), 6)


@QUERIES.add("kde_curve")
def kde_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.density_curve(observations(spark, sf), "score"))


@QUERIES.add(
    "coelution_bins",
    """WITH e AS (SELECT user_id, event_type, epoch(ts) AS rt, value FROM events), f AS (SELECT user_id, event_type, min(rt) AS first FROM e GROUP BY 1, 2),
b AS (SELECT user_id, event_type, floor((rt - first + 1) / 86400)::int AS bin, sum(value) AS intensity FROM e JOIN f USING (user_id, event_type) GROUP BY 1, 2, 3)
SELECT user_id, event_type, arg_max(bin, struct_pack(a := round(intensity, 6), b := -bin)) AS apex_bin, count(*) AS n_bins FROM b GROUP BY 1, 2""",
)
def coelution_bins(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return report.coelution_bins(table(spark, sf, "events").withColumn("rt", seconds), ["user_id", "event_type"], F.col("rt"), "value", 86400.0)


@QUERIES.add(
    "rolling_peaks",
    "SELECT event_id, user_id, round(value, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM events) WHERE value = top",
)
def rolling_peaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return rounded(report.local_peaks(rows, ["user_id"], ["ts", "event_id"], "value", 3).drop("ts"), 6)


@QUERIES.add(
    "linear_calibration",
    "SELECT run_id, round(regr_slope(norm_rt, exp_rt), 6) AS slope, round(regr_intercept(norm_rt, exp_rt), 6) AS intercept, round(corr(exp_rt, norm_rt), 6) AS r FROM feature GROUP BY run_id",
)
def linear_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.linear_fit(table(spark, sf, "feature"), ["run_id"], "exp_rt", "norm_rt"), 6)


@QUERIES.add(
    "glyco_combined_rank",
    f"""SELECT obs, round(0.7 * score / 100000 + 0.3 * quantity / 50, 9) AS combined, row_number() OVER (PARTITION BY entity, run ORDER BY round(0.7 * score / 100000 + 0.3 * quantity / 50, 9) DESC, {', '.join(TIES)})::int AS rank FROM ({OBSERVATIONS_SQL})""",
)
def glyco_combined_rank(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.operators.glyco import combined_rank

    return combined_rank(observations(spark, sf), ["entity", "run"], {"score": 0.7 / 100000, "quantity": 0.3 / 50}, TIES).select("obs", "combined", "rank")


@QUERIES.add(
    "top_score_per_entity_struct",
    f"SELECT entity, round(min(pep1), 9) AS pep, arg_min(obs, struct_pack(a := pep1, b := obs)) AS obs FROM ({OBSERVATIONS_SQL}) GROUP BY entity",
)
def top_score_per_entity_struct(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf)
    return rounded(rows.groupBy("entity").agg(F.min("pep1").alias("pep"), F.min_by("obs", F.struct("pep1", "obs")).alias("obs")))


@QUERIES.add(
    "global_error_at_matrix",
    f"SELECT entity, round(max(score), 9) AS best FROM ({OBSERVATIONS_SQL}) WHERE decoy = 0 GROUP BY entity HAVING count(DISTINCT run) = 2",
)
def global_error_at_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf).where("decoy = 0").groupBy("entity").agg(F.max("score").alias("best"), F.count_distinct("run").alias("n")).where("n = 2").drop("n")
    return rounded(rows)
