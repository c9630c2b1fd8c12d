"""Queries of error control: p-values, null shares, q-values, error tables, look-ups, model FDR."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import stats
from quantloom.plans.proxies import OBSERVATIONS_SQL, TIES, observations, rounded, rounded_sql
from quantloom.plans.registry import Registry
from quantloom.runtime import table

QUERIES = Registry()
LAMBDA = 0.4


def top(spark: SparkSession, sf: str, groups: tuple[str, ...]) -> DataFrame:
    return stats.best_per_group(observations(spark, sf), groups, "score", TIES)


def top_sql(groups: tuple[str, ...]) -> str:
    return f"SELECT * FROM ({OBSERVATIONS_SQL}) QUALIFY row_number() OVER (PARTITION BY {', '.join(groups)} ORDER BY score DESC, {', '.join(TIES)}) = 1"


def table_sql(groups: tuple[str, ...], keys: tuple[str, ...] = (), pi0: str | None = None, pfdr: bool = False) -> str:
    """The error table of the best observations as CTEs ``v, r, lv, nul, met, tab``."""
    sure = (lambda x, of: f"({x}) / nullif(1 - power({of}, m), 0)") if pfdr else (lambda x, of: x)
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    by_p = f"PARTITION BY {k}above" if keys else "PARTITION BY above"
    on = " AND ".join(["true", *(f"a.{x} = b.{x}" for x in keys)])
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    pi0 = pi0 or f"least(sum(CASE WHEN pvalue >= {LAMBDA} THEN n ELSE 0 END)::double / sum(n) / (1 - {LAMBDA}), 1.0)"
    clamp = lambda x: f"least(greatest({x}, 0.0), 1.0)"
    return f"""top AS ({top_sql(groups)}),
v AS (SELECT {k}score, count(*) FILTER (decoy = 0) AS t, count(*) FILTER (decoy = 1) AS d FROM top GROUP BY {k}score),
r AS (SELECT *, greatest(sum(d) OVER ({part} ORDER BY score DESC) - d, 1)::bigint AS above, sum(t) OVER ({part} ORDER BY score DESC) AS t_up,
 sum(t) OVER ({part}) AS m, sum(d) OVER ({part}) AS m0 FROM v),
lv AS (SELECT {k}above, sum(t) AS n, max(t_up) AS n_pos, any_value(m)::double AS m, above::double / any_value(m0) AS pvalue FROM r WHERE t > 0 GROUP BY {k}above),
nul AS (SELECT {k}{pi0} AS pi0 FROM lv {group}),
raw AS (SELECT a.*, pi0, n_pos - pi0 * m * pvalue AS tp, pi0 * m * pvalue AS fp, pi0 * m * (1 - pvalue) AS tn, m - n_pos - pi0 * m * (1 - pvalue) AS fn FROM lv a JOIN nul b ON {on}),
met AS (SELECT *, coalesce(fp / nullif(pi0 * m, 0), 0.0) AS fpr, {clamp(sure("fp / n_pos", "1 - pvalue"))} AS fdr, {clamp(sure("coalesce(fn / nullif(m - n_pos, 0), 0.0)", "pvalue"))} AS fnr,
 max({clamp("coalesce(tp / nullif(m - pi0 * m, 0), 1.0)")}) OVER ({part} ORDER BY above) AS svalue,
 min(least({sure("fp / n_pos", "1 - pvalue")}, 1.0)) OVER ({part} ORDER BY above DESC) AS qvalue FROM raw),
tab AS (SELECT {"".join(f"b.{x}, " for x in keys)}b.score AS cutoff, b.t AS n_targets, {", ".join(stats.METRICS)} FROM r b JOIN met a ON a.above = b.above AND {on} WHERE b.t > 0)"""


def control(spark: SparkSession, sf: str, groups: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    return stats.error_table(top(spark, sf, groups), "score", "decoy", keys, LAMBDA)


def _entities(spark: SparkSession, sf: str, groups: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Every target entity with the statistics of its score."""
    best = top(spark, sf, groups).where("decoy = 0").select(*groups, "score")
    told = control(spark, sf, groups, keys).withColumnRenamed("cutoff", "score").drop("n_targets")
    return rounded(best.join(told, [*keys, "score"]))


def _entities_sql(groups: tuple[str, ...], keys: tuple[str, ...] = ()) -> str:
    on = " AND ".join(["x.score = y.cutoff", *(f"x.{k} = y.{k}" for k in keys)])
    names = ", ".join(f"x.{g}" for g in groups)
    return f"WITH {table_sql(groups, keys)} SELECT {names}, {rounded_sql(['score', *stats.METRICS])} FROM top x JOIN tab y ON {on} WHERE x.decoy = 0"


for _name, _groups, _keys in (
    ("entity_error_control_global", ("entity",), ()),
    ("entity_error_control_run_specific", ("entity", "run"), ("run",)),
    ("entity_error_control_experiment_wide", ("entity", "run"), ()),
):
    QUERIES.add(_name, _entities_sql(_groups, _keys))(lambda spark, sf, g=_groups, k=_keys: _entities(spark, sf, g, k))

_MSE = f"""(SELECT least(e, 1.0) FROM (SELECT l, e, w, mm, list_sort(list(e) OVER ()) AS o FROM
 (SELECT l, sum(CASE WHEN pvalue >= l THEN n ELSE 0 END)::double / sum(n) / (1 - l) AS e, sum(CASE WHEN pvalue >= l THEN n ELSE 0 END)::double AS w, sum(n)::double AS mm
  FROM lv, (SELECT unnest({list(stats.LAMBDAS)}::double[]) AS l) GROUP BY l))
 ORDER BY w / (mm * mm * (1 - l) ** 2) * (1 - w / mm) + (e - (o[1] + (o[2] - o[1]) * 0.001 * {len(stats.LAMBDAS) - 1})) ** 2, l LIMIT 1)"""


@QUERIES.add("pi0_bootstrap", f"WITH {table_sql(('entity',))} SELECT round({_MSE}, 9) AS pi0")
def pi0_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    ranked = stats.decoy_ranks(stats.score_values(top(spark, sf, ("entity",)), "score", "decoy"))
    return rounded(stats.pi0(stats.p_levels(ranked)))


def _smoother_sql() -> str:
    """The value at the last lambda of the least-squares polynomial of degree 3: its normal equations give fixed weights of the estimates."""
    import numpy as np

    x = np.vander(np.asarray(stats.LAMBDAS), 4)
    weights = x[-1] @ np.linalg.solve(x.T @ x, x.T)
    cases = " ".join(f"WHEN l = {at} THEN {w!r}" for at, w in zip(stats.LAMBDAS, weights.tolist()))
    return f"""SELECT round(least(sum(e * CASE {cases} END), 1.0), 6) AS pi0 FROM (SELECT l, sum(CASE WHEN pvalue >= l THEN n ELSE 0 END)::double / sum(n) / (1 - l) AS e
 FROM lv, (SELECT unnest({list(stats.LAMBDAS)}::double[]) AS l) GROUP BY l)"""


@QUERIES.add("pi0_smoother", f"WITH {table_sql(('entity',))} {_smoother_sql()}")
def pi0_smoother(spark: SparkSession, sf: str) -> DataFrame:
    ranked = stats.decoy_ranks(stats.score_values(top(spark, sf, ("entity",)), "score", "decoy"))
    return rounded(stats.pi0(stats.p_levels(ranked), method="smoother"), 6)


@QUERIES.add(
    "normal_pvalue",
    f"""WITH RECURSIVE top AS ({top_sql(("entity",))}), f AS (SELECT avg(score) AS mu, stddev_samp(score) AS sd FROM top WHERE decoy = 1),
t AS (SELECT score AS cutoff, count(*) AS n_targets, any_value((score - mu) / sd) AS z FROM top, f WHERE decoy = 0 GROUP BY score),
s AS (SELECT cutoff, z, 0 AS k, z AS term, z AS total FROM t UNION ALL SELECT cutoff, z, k + 1, term * z * z / (2 * k + 3), total + term * z * z / (2 * k + 3) FROM s WHERE k < 150)
SELECT round(cutoff, 9) AS cutoff, n_targets, round(0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * total, 9) AS pvalue FROM s JOIN t USING (cutoff, z) WHERE k = 150""",
)
def normal_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.normal_pvalues(top(spark, sf, ("entity",)), "score", "decoy"))


@QUERIES.add("local_fdr")
def local_fdr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.error_table(top(spark, sf, ("entity",)), "score", "decoy", local_fdr=True))


@QUERIES.add("local_fdr_by_run")
def local_fdr_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.error_table(top(spark, sf, ("entity", "run")), "score", "decoy", ("run",), local_fdr=True))


@QUERIES.add("pfdr_error_table", f"WITH {table_sql(('entity',), pfdr=True)} SELECT {rounded_sql(['cutoff', *stats.METRICS])}, n_targets FROM tab")
def pfdr_error_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.error_table(top(spark, sf, ("entity",)), "score", "decoy", (), LAMBDA, pfdr=True))




@QUERIES.add(
    "nearest_error_lookup",
    f"""WITH {table_sql(("entity",))}, f AS (SELECT DISTINCT cutoff::float AS c, first_value(qvalue) OVER (PARTITION BY cutoff::float ORDER BY cutoff) AS q FROM tab),
x AS (SELECT DISTINCT score::float AS s FROM ({OBSERVATIONS_SQL})),
n AS (SELECT s, lo.c AS lc, lo.q AS lq, hi.c AS hc, hi.q AS hq FROM x ASOF LEFT JOIN f lo ON x.s >= lo.c ASOF LEFT JOIN f hi ON x.s <= hi.c)
SELECT obs, round(score, 9) AS score, round(CASE WHEN lc IS NULL THEN hq WHEN hc IS NULL THEN lq WHEN s - lc < hc - s THEN lq ELSE hq END, 9) AS qvalue
FROM ({OBSERVATIONS_SQL}) o JOIN n ON o.score::float = n.s""",
)
def nearest_error_lookup(spark: SparkSession, sf: str) -> DataFrame:
    basis = control(spark, sf, ("entity",)).groupBy(F.col("cutoff").cast("float").alias("cutoff")).agg(F.min_by("qvalue", "cutoff").alias("qvalue"))
    return rounded(stats.nearest(observations(spark, sf).select("obs", "score"), "score", basis, "cutoff").drop("cutoff"))


@QUERIES.add(
    "context_statistics_run_specific",
    f"""WITH {table_sql(("entity", "run"), ("run",))}, f AS (SELECT run, cutoff::float AS c, arg_min(struct_pack(p := pvalue, s := svalue, q := qvalue), cutoff) AS v FROM tab GROUP BY 1, 2),
n AS (SELECT x.*, lo.c AS lc, lo.v AS lv, hi.c AS hc, hi.v AS hv FROM (SELECT *, score::float AS s FROM top) x ASOF LEFT JOIN f lo ON x.run = lo.run AND x.s >= lo.c ASOF LEFT JOIN f hi ON x.run = hi.run AND x.s <= hi.c),
w AS (SELECT *, CASE WHEN lc IS NULL THEN hv WHEN hc IS NULL THEN lv WHEN s - lc < hc - s THEN lv ELSE hv END AS v FROM n)
SELECT 'run-specific' AS context, run AS run_id, entity, decoy, round(score, 9) AS score, round(v.p, 9) AS pvalue, round(v.s, 9) AS svalue, round(v.q, 9) AS qvalue FROM w""",
)
def context_statistics_run_specific(spark: SparkSession, sf: str) -> DataFrame:
    """Targets and decoys alike look up the table of their own run."""
    from quantloom import api

    return rounded(api.infer_entities(observations(spark, sf), "entity", "run-specific", run="run", ties=TIES, lambdas=LAMBDA, local_fdr=False))


@QUERIES.add(
    "find_cutoff",
    f"WITH {table_sql(('entity',))} SELECT round(arg_min(cutoff, struct_pack(a := round(abs(qvalue - 0.05), 9), b := cutoff)), 9) AS cutoff FROM tab",
)
def find_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.find_cutoff(control(spark, sf, ("entity",)).withColumn("qvalue", F.round(F.col("qvalue"), 9)), 0.05))


_ROW = "struct_pack(" + ", ".join(f"{c} := {c}" for c in ("cutoff", "n_targets", *[m for m in stats.METRICS])) + ")"


@QUERIES.add(
    "final_error_table",
    f"""WITH {table_sql(("entity",))}, f AS (SELECT cutoff::float AS c, arg_min({_ROW}, cutoff) AS v FROM tab GROUP BY 1), e AS (SELECT min(cutoff) AS lo, max(cutoff) AS hi, (max(cutoff) - min(cutoff)) * 0.05 AS margin FROM tab),
g AS (SELECT i::int AS i, ((lo - margin) + ((hi + margin) - (lo - margin)) * i / 50)::float AS s FROM e, (SELECT unnest(range(51)) AS i)),
n AS (SELECT i, s, CASE WHEN a.c IS NULL THEN b.v WHEN b.c IS NULL THEN a.v WHEN s - a.c < b.c - s THEN a.v ELSE b.v END AS v FROM g ASOF LEFT JOIN f a ON s >= a.c ASOF LEFT JOIN f b ON s <= b.c)
SELECT i, round(s::double, 9) AS cutoff, v.n_targets AS n_targets, {", ".join(f"round(v.{m}, 9) AS {m}" for m in stats.METRICS)} FROM n""",
)
def final_error_table(spark: SparkSession, sf: str) -> DataFrame:
    told = stats.final_error_table(control(spark, sf, ("entity",)))
    return rounded(told.withColumn("cutoff", F.col("cutoff").cast("double")))


@QUERIES.add(
    "summary_error_table",
    f"""WITH {table_sql(("entity",))}, one AS (SELECT qvalue, arg_min({_ROW}, cutoff) AS v FROM tab GROUP BY 1), f AS (SELECT qvalue::float AS c, arg_min(v, qvalue) AS v FROM one GROUP BY 1),
g AS (SELECT i, q, q::float AS s FROM (SELECT unnest(range({len(stats.SUMMARY_QVALUES)})) AS i, unnest({list(stats.SUMMARY_QVALUES)}::double[]) AS q)),
n AS (SELECT i, q, CASE WHEN a.c IS NULL THEN b.v WHEN b.c IS NULL THEN a.v WHEN s - a.c < b.c - s THEN a.v ELSE b.v END AS v FROM g ASOF LEFT JOIN f a ON s >= a.c ASOF LEFT JOIN f b ON s <= b.c),
o AS (SELECT *, coalesce(lag(v.qvalue) OVER (ORDER BY i) = v.qvalue, false) AS again FROM n)
SELECT q AS qvalue, CASE WHEN NOT again THEN v.n_targets END AS n_targets, {", ".join(f"CASE WHEN NOT again THEN round(v.{m}, 9) END AS {m}" for m in ("cutoff", *stats.METRICS) if m != "qvalue")} FROM o""",
)
def summary_error_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.summary_error_table(control(spark, sf, ("entity",))))


@QUERIES.add(
    "d_score_normalise",
    f"""WITH top AS ({top_sql(("entity",))}), f AS (SELECT avg(score) AS mu, stddev_samp(score) AS sd FROM top WHERE decoy = 1)
SELECT entity, decoy, round(score, 9) AS score, round((score - mu) / sd, 9) AS d_score FROM top, f""",
)
def d_score_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.d_scores(top(spark, sf, ("entity",)), "score", "decoy").select("entity", "decoy", "score", "d_score"))


@QUERIES.add(
    "model_fdr",
    "SELECT event_id, round(avg(least(value / 500, 1.0)) OVER (ORDER BY least(value / 500, 1.0) RANGE UNBOUNDED PRECEDING), 9) AS model_fdr FROM events WHERE value IS NOT NULL",
)
def model_fdr(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("value IS NOT NULL").select("event_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("pep"))
    return rounded(stats.model_fdr(rows, "pep").drop("pep"))


@QUERIES.add(
    "grouped_model_fdr",
    "SELECT event_id, event_type, round(avg(least(value / 500, 1.0)) OVER (PARTITION BY event_type ORDER BY least(value / 500, 1.0) RANGE UNBOUNDED PRECEDING), 9) AS model_fdr FROM events WHERE value IS NOT NULL",
)
def grouped_model_fdr(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("value IS NOT NULL").select("event_id", "event_type", F.least(F.col("value") / 500, F.lit(1.0)).alias("pep"))
    return rounded(stats.model_fdr(rows, "pep", ("event_type",)).drop("pep"))


@QUERIES.add(
    "chromatogram_hypotheses",
    f"""WITH o AS (SELECT obs, entity, run, pep FROM ({OBSERVATIONS_SQL})),
g AS (SELECT entity, run, count(*) AS n, count(*) FILTER (pep = 0) AS z, product(CASE WHEN pep > 0 THEN pep ELSE 1 END) AS p FROM o GROUP BY ALL),
e AS (SELECT obs, entity, run, 0.8 / n * (1 - pep) * CASE WHEN z > (pep = 0)::int THEN 0 WHEN pep = 0 THEN p ELSE p / pep END AS own, CASE WHEN z > 0 THEN 0 ELSE 0.2 * p END AS nil FROM o JOIN g USING (entity, run))
SELECT obs, round(own / nullif(sum(own) OVER w + nil, 0), 9) AS h_score, round(nil / nullif(sum(own) OVER w + nil, 0), 9) AS h0_score FROM e WINDOW w AS (PARTITION BY entity, run)""",
)
def chromatogram_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    rows = observations(spark, sf).select("obs", "entity", "run", "pep")
    return rounded(stats.chromatogram_hypotheses(rows, ["entity", "run"], "pep").select("obs", "h_score", "h0_score"))


@QUERIES.add(
    "top_peak_flags_and_ranks",
    f"""SELECT obs, (row_number() OVER w = 1)::int AS is_top_peak, (row_number() OVER w)::int AS peak_rank FROM ({OBSERVATIONS_SQL})
WINDOW w AS (PARTITION BY entity, run ORDER BY score::float DESC, {", ".join(TIES)})""",
)
def top_peak_flags_and_ranks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("entity", "run").orderBy(F.col("score").cast("float").desc(), *TIES)
    ranked = observations(spark, sf).withColumn("peak_rank", F.row_number().over(order))
    return ranked.select("obs", (F.col("peak_rank") == 1).cast("int").alias("is_top_peak"), "peak_rank")
