"""Queries: ensembles, optimisation, earned curves and predictions, clusters; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.functions import stats
from slackline.operators import calendar, community, cpm, ensemble, evm, grouping, montecarlo, paths, sanitise, solver
from slackline.plans.core_queries import DW, PASSES, rounded, schedule
from slackline.plans.extra_queries import PATH_CTE
from slackline.plans.more_queries import CAL_DAY, CAL_SQL, FULL_ENSEMBLE, mc_sql, work_calendar
from slackline.sources.star import ACT_SQL, STATUS_DATE, activities

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ENS = f"""{mc_sql(FULL_ENSEMBLE)}, du AS (SELECT ml.project_id, ml.seq, ml.s, mult, duration * mult AS d FROM ml JOIN act USING (project_id, seq)),
lw AS (SELECT l.project_id, l.src, l.dst, a.s, CASE rel WHEN 'FS' THEN a.d + lag WHEN 'SS' THEN lag WHEN 'FF' THEN a.d + lag - b.d ELSE lag - b.d END AS w FROM lnk l JOIN du a ON a.project_id = l.project_id AND a.seq = l.src JOIN du b ON b.project_id = l.project_id AND b.seq = l.dst AND b.s = a.s),
fw AS (SELECT project_id, s, seq, 0.0::DOUBLE AS t FROM du UNION SELECT f.project_id, f.s, l.dst, greatest(0, f.t + l.w) FROM fw f JOIN lw l ON l.project_id = f.project_id AND l.src = f.seq AND l.s = f.s),
ea AS (SELECT project_id, s, seq, max(t) AS es FROM fw GROUP BY 1, 2, 3), sp AS (SELECT project_id, s, max(es + d) AS span FROM ea JOIN du USING (project_id, s, seq) GROUP BY 1, 2),
bw AS (SELECT project_id, s, seq, span - d AS t FROM du JOIN sp USING (project_id, s) UNION SELECT b.project_id, b.s, l.src, b.t - l.w FROM bw b JOIN lw l ON l.project_id = b.project_id AND l.dst = b.seq AND l.s = b.s),
la AS (SELECT project_id, s, seq, min(t) AS ls FROM bw GROUP BY 1, 2, 3), al AS (SELECT * FROM du JOIN ea USING (project_id, s, seq) JOIN la USING (project_id, s, seq) JOIN sp USING (project_id, s))"""


@query(f"{ENS} SELECT project_id, project_id || '-' || seq AS id, avg((abs(ls - es) < 1e-9)::INT) AS criticality, round(CASE WHEN var_pop(mult) * {FULL_ENSEMBLE} > 1e-12 AND var_pop(span) * {FULL_ENSEMBLE} > 1e-12 THEN covar_pop(mult, span) / sqrt(var_pop(mult) * var_pop(span)) ELSE 0 END, 6) + 0.0 AS cruciality FROM al GROUP BY project_id, seq")
def risk_indices(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    return rounded(ensemble.risk_indices_sampled(montecarlo.with_scope(a, STATUS_DATE), e, FULL_ENSEMBLE), 6, "cruciality")


CAP = stats.cap("risk", "(remaining / 8e0)")


@query(f"{mc_sql(FULL_ENSEMBLE)}, g AS (SELECT project_id, id, avg(mult) AS mean, stddev_pop(mult) AS sd, max(mult) AS top, avg((mult >= 0.95 * {CAP})::INT) AS cap_share FROM ml JOIN (SELECT id, risk FROM act) USING (id) GROUP BY 1, 2), f AS (SELECT project_id, id, cap_share, cap_share >= 0.1 AS black_swan, top > mean + 4 * sd AND top > 2 * mean AS dragon_king FROM g) SELECT * FROM f WHERE black_swan OR dragon_king")
def extreme_activities(spark, sf_dir):
    return ensemble.extremes(montecarlo.with_scope(activities(spark, sf_dir), STATUS_DATE), FULL_ENSEMBLE, CAP)


@query()
def risk_indices_full(spark, sf_dir):
    return risk_indices(spark, sf_dir)


@query()
def extreme_activities_full(spark, sf_dir):
    return extreme_activities(spark, sf_dir)


@query()
def optimised_durations(spark, sf_dir):
    return ensemble.optimise(*schedule(spark, sf_dir), {"schedule": 0.6, "risk": 0.2, "quality": 0.2})


@query()
def pareto_sweep(spark, sf_dir):
    return ensemble.pareto_sweep(*schedule(spark, sf_dir), solver.weight_vectors(["schedule", "quality"], 30))


PRED = f"""{DW}, dl AS (SELECT project_id, greatest(0.5, least(2.0, CASE WHEN dw_spi > 0 THEN greatest(0.5, least(3.0, 1 / dw_spi)) ELSE 1.25 END / 1.25)) AS k, greatest(0, date_diff('day', sdt::DATE, pe::DATE)) AS lft FROM dx),
sl AS (SELECT project_id, k, greatest(-180, least(365, round_even(lft * greatest(0.6, least(2.0, k)) - lft, 0)))::INTEGER AS slip FROM dl),
pr AS (SELECT v.*, CASE WHEN actual_finish IS NOT NULL THEN duration WHEN p > 0 AND p < 1 THEN duration * p + duration * (1 - p) * k ELSE duration * k END AS predicted_hours, CASE WHEN actual_start IS NOT NULL THEN actual_start ELSE greatest(start, sdt) + to_days(slip) END AS predicted_start FROM v JOIN sl USING (project_id)),
{CAL_SQL}, pe AS (SELECT pr.*, predicted_start + to_days(date_diff('day', predicted_start::DATE, t.day)::INTEGER) AS predicted_end FROM pr LEFT JOIN cal c ON c.day = predicted_start::DATE LEFT JOIN cal t ON t.is_working AND t.days_before + 1 = c.days_before + c.is_working::INT + ceil(predicted_hours / 8)::INTEGER)"""


def predictions(spark, sf_dir) -> DataFrame:
    """Sums are in order of seq: the SQL numbers activities by a window, and adds rows as that leaves them."""
    a = activities(spark, sf_dir).withColumn("row", F.col("seq"))
    delay = evm.delay(evm.duration_weighted(a, STATUS_DATE), a, STATUS_DATE).select("project_id", "performance_delta", "slip_days")
    first = evm.initial_predictions(a.join(delay, "project_id"), STATUS_DATE)
    return calendar.add_days(first, work_calendar(spark), "predicted_start", "predicted_hours", CAL_DAY, "predicted_end")


@query(f"{PRED} SELECT project_id, id, round(predicted_hours, 7) AS predicted_hours, predicted_start, predicted_end FROM pe")
def predicted_dates(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select("project_id", "id", "predicted_hours", "predicted_start", "predicted_end"), 7, "predicted_hours")


_SHARE = lambda frm, to: f"least(1.0, greatest(0, date_diff('day', {frm}::DATE, day::DATE)) / greatest(1, date_diff('day', {frm}::DATE, {to}::DATE))::DOUBLE)"


@query(
    f"""{PRED}, dd AS (SELECT project_id, start AS day FROM act UNION SELECT project_id, finish FROM act), x AS (SELECT pe.project_id, day, CASE WHEN actual_finish <= day THEN duration WHEN actual_start <= day THEN CASE WHEN actual_finish IS NOT NULL THEN duration * {_SHARE('actual_start', 'actual_finish')} WHEN p > 0 THEN duration * p * {_SHARE('actual_start', 'sdt')} ELSE 0 END
 WHEN p > 0 AND day <= sdt THEN CASE WHEN finish <= day THEN duration * p WHEN start <= day THEN duration * least({_SHARE('start', 'finish')}, p) ELSE 0 END WHEN day > sdt THEN CASE WHEN predicted_end <= day THEN duration WHEN predicted_start <= day AND day < predicted_end THEN duration * {_SHARE('predicted_start', 'predicted_end')} ELSE 0 END ELSE 0 END AS e FROM pe JOIN dd USING (project_id)),
y AS (SELECT project_id, day, sum(e) AS e FROM x GROUP BY 1, 2) SELECT project_id, day, round(max(e) OVER (PARTITION BY project_id ORDER BY day), 6) AS earned FROM y"""
)
def evm_earned_curve(spark, sf_dir):
    a = activities(spark, sf_dir)
    dates = a.select("project_id", F.explode(F.array("start", "finish")).alias("day")).distinct()
    return rounded(evm.earned_curve(predictions(spark, sf_dir), dates, STATUS_DATE), 6, "earned")


@query()
def risk_clusters(spark, sf_dir):
    return grouping.risk_groups(activities(spark, sf_dir))


@query(f"WITH {ACT_SQL} SELECT project_id, task_type, count(*) AS n, round(avg(risk), 8) AS mean_risk, round(max(risk), 8) AS max_risk, round(sum(pct * duration) / sum(duration), 6) AS progress, count_if(pct >= 100) AS finished, count_if(pct > 0 AND pct < 100) AS running FROM act GROUP BY 1, 2")
def group_health(spark, sf_dir):
    g = activities(spark, sf_dir).groupBy("project_id", "task_type")
    out = g.agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"), (F.sum(F.col("pct") * F.col("duration")) / F.sum("duration")).alias("progress"), F.count_if(F.col("pct") >= 100).alias("finished"), F.count_if((F.col("pct") > 0) & (F.col("pct") < 100)).alias("running"))
    return rounded(rounded(out, 8, "mean_risk", "max_risk"), 6, "progress")


@query(
    f"""{PASSES}, c AS (SELECT l.*, e.es + l.w AS c, max(e.es + l.w) OVER (PARTITION BY l.project_id, l.dst) AS top FROM lnk l JOIN early e ON e.project_id = l.project_id AND e.seq = l.src), dr AS (SELECT project_id, src, dst FROM c WHERE top - c <= 1e-6),
en AS (SELECT project_id, arg_min(seq, (-ef, seq)) AS seq FROM dates GROUP BY 1), ch AS (SELECT a.project_id, a.seq, a.id AS chain, a.duration AS hours FROM en JOIN act a USING (project_id, seq) UNION ALL SELECT h.project_id, d.src, a.id || '>' || h.chain, h.hours + a.duration FROM ch h JOIN dr d ON d.project_id = h.project_id AND d.dst = h.seq JOIN act a ON a.project_id = d.project_id AND a.seq = d.src)
SELECT project_id, chain, hours FROM ch WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.project_id = ch.project_id AND dr.dst = ch.seq)"""
)
def driving_chains(spark, sf_dir):
    return paths.driving_chains(*schedule(spark, sf_dir)).drop("selected")


@query()
def novel_chains(spark, sf_dir):
    return paths.driving_chains(*schedule(spark, sf_dir)).where("selected").drop("selected")


@query(
    f"""{PATH_CTE}, sg AS (SELECT project_id, path, duration, array_to_string(x[1:2], '>') AS branch, array_to_string(x[greatest(1, len(x) // 2):greatest(1, len(x) // 2) + 1], '>') AS midpoint FROM (SELECT *, string_split(path, '>') AS x FROM pt)),
ag AS (SELECT *, row_number() OVER (PARTITION BY project_id, branch, midpoint ORDER BY duration DESC, path) AS again FROM sg), tn AS (SELECT *, row_number() OVER (PARTITION BY project_id, branch ORDER BY again, duration DESC, path) AS turn FROM ag),
pl AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY turn, duration DESC, path) AS place FROM tn WHERE turn <= 5) SELECT project_id, path, duration, branch, midpoint, place FROM pl WHERE place <= 20"""
)
def diverse_paths(spark, sf_dir):
    return paths.diverse(cpm.path_durations(*schedule(spark, sf_dir)))


def by(spark, sf_dir, column: str) -> DataFrame:
    return activities(spark, sf_dir).select("project_id", "id", F.col(column).alias("community"))


@query(f"WITH {ACT_SQL}, k AS (SELECT project_id, resources AS child, task_type AS parent, count(*) AS k FROM act GROUP BY ALL), n AS (SELECT project_id, child, sum(k) AS n FROM k GROUP BY 1, 2) SELECT project_id, parent, child, round_even(k / n, 3) AS overlap FROM k JOIN n USING (project_id, child) WHERE k / n >= 0.7")
def community_hierarchy(spark, sf_dir):
    return community.hierarchy(by(spark, sf_dir, "task_type"), by(spark, sf_dir, "resources"))


@query(f"WITH {ACT_SQL}, g AS (SELECT project_id, resources FROM act GROUP BY 1, 2 HAVING count(*) >= 2 AND min(task_type) = max(task_type) AND min(resource_count) = max(resource_count)) SELECT project_id, resources AS community, id FROM act JOIN g USING (project_id, resources)")
def stable_cores(spark, sf_dir):
    return community.stable_cores(by(spark, sf_dir, "resources"), [by(spark, sf_dir, "task_type"), by(spark, sf_dir, "resource_count")])


@query()
def multi_resolution(spark, sf_dir):
    return community.multi_resolution(*schedule(spark, sf_dir))


@query()
def sanitised_links(spark, sf_dir):
    """The derived links with one that leads back from each third activity to its project's first; milestones are the first and the last."""
    a, e = schedule(spark, sf_dir)
    back = a.where("seq = 3").select("project_id", F.col("id").alias("source"), F.concat_ws("-", F.col("project_id"), F.lit(1)).alias("target"), F.lit("FS").alias("rel"), F.lit(0.0).alias("lag"), F.lit(3).alias("ord"))
    marked = a.withColumn("milestone", (F.col("seq") == 1) | (F.col("duration") >= 45))
    return sanitise.sanitised(marked, e.unionByName(back))
