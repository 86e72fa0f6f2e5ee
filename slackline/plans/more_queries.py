"""Queries over the derived schedules: units, calendars, health, simulation, recovery, solver; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.functions import stats, units
from slackline.operators import calendar, cpm, health, montecarlo, recovery, solver
from slackline.plans.core_queries import BASE, PASSES, rounded, schedule
from slackline.sources.star import ACT_SQL, STATUS_DATE, activities, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SPELLINGS = ["Hours", "hr", " DAYS ", "d", "weeks", "mo", "months", "m", "min", "secs", "years", "y", "hourly", "wks.", "mth", "?"]
_SIZE = """CASE WHEN u IN ('h','hr','hrs','hour','hours') THEN 1 WHEN u IN ('s','sec','secs','second','seconds') THEN 1/3600.0::DOUBLE WHEN u IN ('min','mins','minute','minutes','m') THEN 1/60.0::DOUBLE WHEN u IN ('d','day','days') THEN 8 WHEN u IN ('w','wk','wks','week','weeks') THEN 40
 WHEN u IN ('mo','mon','mons','month','months') THEN 4.345*40 WHEN u IN ('y','yr','yrs','year','years') THEN 52.14*40 WHEN u LIKE 'h%' THEN 1 WHEN u LIKE 'd%' THEN 8 WHEN u LIKE 'w%' THEN 40 WHEN u LIKE 'y%' THEN 52.14*40 WHEN u LIKE 'mo%' THEN 4.345*40 WHEN u LIKE 'm%' THEN 1/60.0::DOUBLE ELSE 1 END"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, u AS unit, round(l_quantity * {_SIZE}, 8) AS hours, round(l_quantity / {_SIZE}, 8) AS units FROM (SELECT *, lower(trim([{', '.join(repr(s) for s in SPELLINGS)}][(l_partkey % {len(SPELLINGS)}) + 1])) AS u FROM lineitem)")
def unit_conversion(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("l_partkey") % len(SPELLINGS) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").withColumn("unit", unit)
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", F.lower(F.trim("unit")).alias("unit"), units.to_hours(F.col("l_quantity"), F.col("unit")).alias("hours"), units.from_hours(F.col("l_quantity"), F.col("unit")).alias("units"))
    return rounded(rows, 8, "hours", "units")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN least(p_size / 100.0, 1.0) WHEN 1 THEN least(p_size / 100.0, 1.0) WHEN 2 THEN 0 ELSE least(p_retailprice / 100.0, 1) END::DOUBLE AS pct FROM part")
def percent_normalise(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.concat("p_size", F.lit(" %"))).when(k == 2, F.col("p_name")).otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", units.percent(raw).alias("pct"))


@query(
    "SELECT c_custkey, CASE c_mktsegment "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in (("AUTOMOBILE", 0.25), ("BUILDING", 0.20), ("FURNITURE", 0.28), ("HOUSEHOLD", 0.25), ("MACHINERY", 0.25)))
    + " ELSE 0.25 END::DOUBLE AS overrun FROM customer"
)
def sector_overruns(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", units.sector_overrun(F.col("c_mktsegment")).alias("overrun"))


CAL_DAY, CAL_DAYS, HOLIDAYS = "1995-01-01", 3650, ("1995-07-04", "1996-01-01", "1997-12-25", "1998-01-01", "1999-05-03")
CAL_SQL = f"""dy AS (SELECT i::INTEGER AS day_idx, (DATE '{CAL_DAY}' + i::INTEGER) AS day FROM range({CAL_DAYS}) t(i)),
wk AS (SELECT *, isodow(day) <= 5 AS is_weekday, isodow(day) <= 5 AND day NOT IN ({', '.join(f"DATE '{h}'" for h in HOLIDAYS)}) AS is_working FROM dy),
cal AS (SELECT *, (coalesce(sum(is_working::INT) OVER (ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS days_before, coalesce(min(CASE WHEN is_weekday THEN day_idx END) OVER f, {CAL_DAYS - 1}) AS next_weekday, coalesce(min(CASE WHEN is_working THEN day_idx END) OVER f, {CAL_DAYS - 1}) AS next_working FROM wk WINDOW f AS (ORDER BY day_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def work_calendar(spark) -> DataFrame:
    return calendar.calendar(spark, CAL_DAY, CAL_DAYS, holidays=HOLIDAYS)


@query(f"WITH {CAL_SQL} SELECT day_idx, strftime(day, '%Y-%m-%d') AS day, is_weekday, is_working, days_before, (days_before * 8)::DOUBLE AS hours_before, next_weekday, next_working FROM cal")
def calendar_days(spark, sf_dir):
    return work_calendar(spark).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    f"""WITH {ACT_SQL}, {CAL_SQL}, mx AS (SELECT max(days_before + is_working::INT) AS most FROM cal), ar AS (SELECT days_before, max(day_idx) AS arrive FROM cal GROUP BY 1),
r1 AS (SELECT a.project_id, a.id, a.start, a.duration, floor(a.duration / 8)::INTEGER AS whole, CASE WHEN a.duration < 8 THEN c.next_weekday ELSE c.next_working END AS frm FROM act a JOIN cal c ON c.day = a.start::DATE),
r2 AS (SELECT r1.*, CASE WHEN whole = 0 THEN frm ELSE coalesce(arrive, {CAL_DAYS - 1}) END * 24 + duration - whole * 8 AS h FROM r1 JOIN cal f ON f.day_idx = frm CROSS JOIN mx LEFT JOIN ar ON ar.days_before = least(f.days_before + whole, most)),
r3 AS (SELECT r2.*, c.next_working - c.day_idx AS shift FROM r2 JOIN cal c ON c.day_idx = floor(h / 24)::INTEGER)
SELECT project_id, id, TIMESTAMP '{CAL_DAY} 00:00:00' + to_hours((h + shift * 24)::INTEGER) AS finished FROM r3"""
)
def calendar_advance(spark, sf_dir):
    rows = activities(spark, sf_dir).select("project_id", "id", "start", "duration")
    return calendar.advance(rows, work_calendar(spark), "start", "duration", CAL_DAY, CAL_DAYS).select("project_id", "id", "finished")


@query(
    f"""{PASSES}, cl AS (SELECT l.project_id, l.src, l.dst, l.ord FROM lnk l JOIN dates a ON a.project_id = l.project_id AND a.seq = l.src AND a.critical JOIN dates b ON b.project_id = l.project_id AND b.seq = l.dst AND b.critical),
nx AS (SELECT project_id, src, arg_min(dst, ord) AS dst FROM cl GROUP BY 1, 2), lvl AS (SELECT seq, project_id, 0 AS k FROM act WHERE seq = 1 UNION SELECT l.dst, l.project_id, v.k + 1 FROM lvl v JOIN lnk l ON l.project_id = v.project_id AND l.src = v.seq),
st AS (SELECT d.project_id, arg_min(d.seq, (v.k, d.seq)) AS seq FROM dates d JOIN (SELECT project_id, seq, max(k) AS k FROM lvl GROUP BY ALL) v USING (project_id, seq) WHERE critical AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.project_id = d.project_id AND cl.dst = d.seq) GROUP BY 1),
walk AS (SELECT project_id, seq FROM st UNION ALL SELECT w.project_id, nx.dst FROM walk w JOIN nx ON nx.project_id = w.project_id AND nx.src = w.seq),
cp AS (SELECT project_id, count(*) AS cp_length FROM walk GROUP BY 1),
a AS (SELECT project_id, count(*) AS n, count_if(duration > 44) AS high_duration, count_if(trim(resources) = '') AS resource_gaps, count_if(tf > 44) AS high_float, count_if(NOT EXISTS (SELECT 1 FROM lnk l WHERE l.target = dates.id)) - 1 AS no_pred, count_if(NOT EXISTS (SELECT 1 FROM lnk l WHERE l.source = dates.id)) - 1 AS no_succ FROM dates GROUP BY 1),
r AS (SELECT project_id, count(*) AS n_links, count_if(abs(lag) > 1e-9) AS n_lags, count_if(lag < -1e-9) AS n_leads, count_if(rel = 'SS') AS n_ss, count_if(rel = 'FF') AS n_ff, count_if(rel = 'SF') AS n_sf FROM lnk GROUP BY 1),
x AS (SELECT project_id, n, coalesce(n_links, 0) AS n_links, coalesce(n_lags, 0) AS n_lags, coalesce(n_leads, 0) AS n_leads, coalesce(n_ss, 0) AS n_ss, coalesce(n_ff, 0) AS n_ff, coalesce(n_sf, 0) AS n_sf, no_pred, no_succ, high_float, high_duration, resource_gaps, coalesce(cp_length, 0) AS cp_length, floor(n * 0.05) AS few FROM a LEFT JOIN r USING (project_id) LEFT JOIN cp USING (project_id)),
y AS (SELECT *, (round_even(n_links / n, 2) BETWEEN 1.5 AND 2.5)::INT + (no_pred <= greatest(1, few))::INT + (no_succ <= greatest(1, few))::INT + (n_leads = 0)::INT + (high_float <= few)::INT + (high_duration <= few)::INT + (resource_gaps <= few)::INT + (cp_length > 0)::INT AS passed FROM x)
SELECT * EXCLUDE (few), passed / 8.0::DOUBLE AS score FROM y"""
)
def schedule_health(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    return health.health(a, e, cpm.cpm(a, e), cpm.critical_path(a, e))


@query(f"WITH {ACT_SQL} SELECT task_type, resources, round(duration * 10)::BIGINT AS tenths, count(*) AS n, avg(duration) AS average_duration, var_samp(duration) AS duration_variance FROM act GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, task_type, resources, tenths LIMIT 10")
def repeating_patterns(spark, sf_dir):
    return health.patterns(activities(spark, sf_dir))


@query(f"WITH {ACT_SQL} SELECT project_id, task_type, count(*) AS tasks, sum(duration) AS hours, min(start) AS first_start, max(finish) AS last_finish FROM act GROUP BY ALL")
def work_packages(spark, sf_dir):
    return health.work_packages(activities(spark, sf_dir))


@query(
    f"""WITH {ACT_SQL}, s AS (SELECT project_id, avg(importance) AS ma, avg(risk) AS mb, covar_samp(importance, importance) AS va, covar_samp(risk, risk) AS vb, covar_samp(importance, risk) AS c FROM act GROUP BY 1),
t AS (SELECT *, (va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + c * c) AS l1 FROM s), d AS (SELECT *, CASE WHEN abs(c) > 1e-15 THEN c WHEN va >= vb THEN 1 ELSE 0 END AS x0, CASE WHEN abs(c) > 1e-15 THEN l1 - va WHEN va >= vb THEN 0 ELSE 1 END AS y0 FROM t),
v AS (SELECT *, CASE WHEN x0 < 0 OR (x0 = 0 AND y0 < 0) THEN -1 ELSE 1 END / sqrt(x0 * x0 + y0 * y0) AS k FROM d)
SELECT project_id, id, round(CASE WHEN l1 > 1e-15 THEN ((importance - ma) * x0 + (risk - mb) * y0) * k ELSE 0 END, 6) + 0.0 AS pca1, round(CASE WHEN l1 > 1e-15 THEN ((risk - mb) * x0 - (importance - ma) * y0) * k ELSE 0 END, 6) + 0.0 AS pca2 FROM act JOIN v USING (project_id)"""
)
def pca_risk_importance(spark, sf_dir):
    return rounded(health.pca2(activities(spark, sf_dir)), 6, "pca1", "pca2")


@query(
    f"""WITH {ACT_SQL}, m AS (SELECT *, median(duration) OVER w AS md, avg(duration) OVER w AS mean, stddev_pop(duration) OVER w AS sd FROM act WINDOW w AS (PARTITION BY project_id)), n AS (SELECT *, median(abs(duration - md)) OVER (PARTITION BY project_id) AS mad FROM m)
SELECT project_id, id, round(CASE WHEN mad > 0 THEN (duration - md) / (1.4826 * mad) WHEN sd > 1e-12 THEN (duration - mean) / sd ELSE 0 END, 8) AS z FROM n"""
)
def mad_scores(spark, sf_dir):
    return rounded(health.scaled(activities(spark, sf_dir), "duration", "project_id").select("project_id", "id", "z"), 8, "z")


@query(
    f"""{BASE}, u AS (SELECT project_id, src AS a, dst AS b FROM lnk UNION SELECT project_id, dst, src FROM lnk), k AS (SELECT project_id, a, count(*) AS k FROM u GROUP BY 1, 2),
t AS (SELECT x.project_id, x.a, count(*) AS t FROM u x JOIN u y ON y.project_id = x.project_id AND y.a = x.b JOIN u z ON z.project_id = y.project_id AND z.a = y.b AND z.b = x.a GROUP BY 1, 2), sz AS (SELECT project_id, count(*) AS n FROM act GROUP BY 1)
SELECT a.project_id, a.id, CASE WHEN n = 1 THEN 1.0 ELSE coalesce(k, 0) / (n - 1)::DOUBLE END AS degree, round(CASE WHEN k > 1 THEN coalesce(t, 0) / (k * (k - 1))::DOUBLE ELSE 0 END, 9) AS clustering FROM act a JOIN sz USING (project_id) LEFT JOIN k ON k.project_id = a.project_id AND k.a = a.seq LEFT JOIN t ON t.project_id = a.project_id AND t.a = a.seq"""
)
def degree_clustering(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    return rounded(health.centralities(a, e.withColumn("duration", F.lit(1.0))).select("project_id", "id", "degree", "clustering"), 9, "clustering")


@query()
def pagerank_closeness(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    return health.centralities(a, e.withColumn("duration", F.lit(1.0))).select("project_id", "id", "pagerank", "closeness")


#: Samples of mc_multipliers and mc_spread; all others draw the reference's 500, or 100 in ensembles.
SAMPLES = 4
FULL, FULL_ENSEMBLE = 500, 100
_U0 = f"greatest(1e-10, least(1e0 - 1e-10, ('0x' || substr(md5('{montecarlo.SEED}|' || (s // 2) || '|' || id), 1, 13))::BIGINT / 4503599627370496e0))"


def mc_sql(samples: int) -> str:
    return f"""{BASE}, sc AS (SELECT *, duration * (1 - pct / 100) AS remaining, CASE WHEN actual_start IS NULL THEN greatest(0, (epoch(start) - epoch(TIMESTAMP '{STATUS_DATE}')) / 3600) ELSE 0 END AS base, CASE task_type WHEN 'A' THEN 0.35e0 WHEN 'R' THEN 0.4e0 ELSE 0.55e0 END AS fat FROM act),
us AS (SELECT sc.*, s, CASE WHEN s % 2 = 0 THEN {_U0} ELSE 1e0 - {_U0} END AS u FROM sc, range({samples}) r(s)), zs AS (SELECT *, {stats.ndtri('u')} AS z FROM us),
ml AS (SELECT project_id, id, seq, base, remaining, s, {stats.multiplier('u', 'z', 'risk', 'fat', '(remaining / 8e0)')} AS mult FROM zs)"""


MC = mc_sql(SAMPLES)


@query(f"{MC} SELECT project_id, id, s::INTEGER AS sample, round(mult, 7) AS mult FROM ml")
def mc_multipliers(spark, sf_dir):
    rows = montecarlo.multipliers(montecarlo.with_scope(activities(spark, sf_dir), STATUS_DATE), SAMPLES)
    return rounded(rows.select("project_id", "id", F.posexplode("mult").alias("sample", "mult")), 7, "mult")


@query()
def mc_multipliers_full(spark, sf_dir):
    rows = montecarlo.multipliers_sampled(montecarlo.with_scope(activities(spark, sf_dir), STATUS_DATE), FULL, 7)
    return rows.select("project_id", "id", F.posexplode("mult").alias("sample", "mult"))


def mcf_sql(samples: int) -> str:
    return f"""{mc_sql(samples)}, du AS (SELECT project_id, seq, base, remaining, s, remaining * mult AS d FROM ml UNION ALL SELECT project_id, seq, base, remaining, -1, remaining FROM sc),
fl AS (SELECT project_id, seq, s, 's' AS kind, base AS t FROM du UNION SELECT q.project_id, q.nseq, q.s, q.nkind, q.nt FROM (
 SELECT f.project_id, f.seq AS nseq, f.s, 'f' AS nkind, f.t + du.d AS nt FROM fl f JOIN du ON du.project_id = f.project_id AND du.seq = f.seq AND du.s = f.s WHERE f.kind = 's'
 UNION ALL SELECT f.project_id, l.dst, f.s, CASE WHEN rel IN ('FF', 'SF') THEN 'f' ELSE 's' END, f.t + l.lag FROM fl f JOIN lnk l ON l.project_id = f.project_id AND l.src = f.seq AND ((l.rel IN ('FS', 'FF')) = (f.kind = 'f'))) q),
pf AS (SELECT f.project_id, f.s, max(f.t) AS t FROM fl f JOIN sc ON sc.project_id = f.project_id AND sc.seq = f.seq AND sc.remaining > 0 WHERE f.kind = 'f' GROUP BY 1, 2),
ps AS (SELECT project_id, max(CASE WHEN s = -1 THEN t END) AS expected, list_sort(list(t) FILTER (s >= 0)) AS v FROM pf GROUP BY 1),
sm AS (SELECT project_id, expected, {', '.join(f"v[floor({p / 100} * (len(v) - 1))::INT + 1] AS p{p}" for p in (20, 50, 80, 95))}, list_avg(v) AS mean, list_stddev_pop(v) AS sd FROM ps)"""


MCF, MCF_FULL = mcf_sql(SAMPLES), mcf_sql(FULL)


@query(f"{MCF_FULL} SELECT project_id, round(expected, 6) AS expected, round(p20, 6) AS p20, round(p50, 6) AS p50, round(p80, 6) AS p80, round(p95, 6) AS p95, round(mean, 6) AS mean, round(sd, 5) AS sd FROM sm")
def mc_forecast(spark, sf_dir):
    return rounded(rounded(summary_full(spark, sf_dir), 6, "expected", "p20", "p50", "p80", "p95", "mean"), 5, "sd")


@query(
    f"""{MCF_FULL}, w AS (SELECT project_id, min(start) AS st, max(finish) AS fi FROM act GROUP BY 1), t AS (SELECT project_id, (epoch(fi) - epoch(st)) / 86400 AS pd_days, {', '.join(f"(epoch(TIMESTAMP '{STATUS_DATE}') - epoch(st)) / 86400 + {c} / 24 AS teac_{c}" for c in ('expected', 'p50', 'p80', 'p95'))} FROM sm JOIN w USING (project_id))
SELECT project_id, pd_days, round(teac_expected, 6) AS teac_expected, round(teac_p50, 6) AS teac_p50, round(teac_p80, 6) AS teac_p80, round(teac_p95, 6) AS teac_p95, round(CASE WHEN teac_p80 > 0 THEN pd_days / teac_p80 END, 8) AS spi_t_p80 FROM t"""
)
def mc_teac(spark, sf_dir):
    t = montecarlo.teac(summary_full(spark, sf_dir), activities(spark, sf_dir), STATUS_DATE)
    return rounded(rounded(t, 6, "teac_expected", "teac_p50", "teac_p80", "teac_p95"), 8, "spi_t_p80")


def summary_full(spark, sf_dir) -> DataFrame:
    a, e = schedule(spark, sf_dir)
    return montecarlo.summary_sampled(montecarlo.with_scope(a, STATUS_DATE), e, FULL)


@query()
def mc_forecast_full(spark, sf_dir):
    return mc_forecast(spark, sf_dir)


@query()
def mc_teac_full(spark, sf_dir):
    return mc_teac(spark, sf_dir)


_NAMES = "CASE part % 8 WHEN 0 THEN 'Design review' WHEN 1 THEN 'Vendor shipment' WHEN 2 THEN 'Engineering model' WHEN 3 THEN 'Weld frame' WHEN 4 THEN 'Install pipes' WHEN 5 THEN 'Start-up tests' ELSE 'Other' END"
_SUPPLIER = "CASE supplier % 9 WHEN 0 THEN 'external_equipment' WHEN 1 THEN 'External_Service' ELSE '' END"
CRASH = f"""{PASSES}, nm AS (SELECT *, {_NAMES} AS name, lower({_SUPPLIER}) AS st, duration * (1 - pct / 100) AS remaining, tf / 8 AS float_days FROM dates),
kd AS (SELECT *, CASE WHEN st <> '' THEN st WHEN name = 'Design review' THEN 'governance' WHEN name = 'Vendor shipment' THEN 'procurement' WHEN name = 'Engineering model' THEN 'engineering' WHEN name = 'Weld frame' THEN 'fabrication' WHEN name = 'Install pipes' THEN 'construction' WHEN name = 'Start-up tests' THEN 'commissioning' ELSE 'generic' END AS kind FROM nm),
cr AS (SELECT *, remaining * CASE kind WHEN 'external_equipment' THEN 0.03 WHEN 'external_service' THEN 0.10 WHEN 'governance' THEN 0.08 WHEN 'procurement' THEN 0.12 WHEN 'engineering' THEN 0.18 WHEN 'fabrication' THEN 0.22 WHEN 'construction' THEN 0.28 WHEN 'commissioning' THEN 0.20 ELSE 0.25 END::DOUBLE AS crash FROM kd),
cd AS (SELECT *, CASE WHEN critical THEN 1.0 ELSE greatest(0.2, least(0.75, 1 - float_days / 12)) END AS lev FROM cr WHERE actual_finish IS NULL AND remaining >= 16 AND crash >= 8 AND (critical OR float_days <= 10)),
cc AS (SELECT project_id, id, kind, round(remaining, 7) AS remaining_hrs, round(crash, 7) AS max_crash_hrs, round(lev, 7) AS leverage, critical AS on_critical, round(float_days, 7) AS float_days, round(remaining * lev * (0.55 + 0.45 * importance), 7) AS score FROM cd)"""


def crash(spark, sf_dir) -> DataFrame:
    a, e = schedule(spark, sf_dir)
    named = a.withColumn("name", F.expr(_NAMES)).withColumn("supplier_type", F.expr(_SUPPLIER))
    return recovery.crash_candidates(named, cpm.cpm(a, e), places=7)


@query(f"{CRASH} SELECT * FROM cc")
def crash_candidates(spark, sf_dir):
    return crash(spark, sf_dir)


@query(
    f"""{CRASH}, rk AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(max_crash_hrs) OVER (PARTITION BY project_id ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM cc WINDOW w AS (PARTITION BY project_id ORDER BY score DESC, id))
SELECT project_id, id, rank, round(least(max_crash_hrs, 20 - bf), 6) AS crash_hrs, bf + max_crash_hrs >= 20 AS meets_target FROM rk WHERE bf < 20 AND rank <= 18"""
)
def recovery_packages(spark, sf_dir):
    return rounded(recovery.packaged(crash(spark, sf_dir), 20.0), 6, "crash_hrs")


@query(f"{PASSES} SELECT l.project_id, source, target, rel, lag / 8 AS lag_days, a.critical AND b.critical AS on_chain, lag / 16 AS saved_days FROM lnk l JOIN dates a ON a.id = l.source JOIN dates b ON b.id = l.target WHERE lag > 0 AND lag / 8 >= 0.25 AND ((a.critical AND b.critical) OR lag / 8 >= 0.5)")
def lag_candidates(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    return recovery.lag_candidates(e, cpm.cpm(a, e), least_days=0.25, off_chain_days=0.5)


def solver_rows(spark, sf_dir) -> DataFrame:
    a, e = schedule(spark, sf_dir)
    dates = cpm.cpm(a, e).select("project_id", "id", "es", "ef", "tf", "critical", "makespan")
    return a.join(dates, ["project_id", "id"]).withColumn("crash_fraction", F.col("importance") / 4).withColumn("quality_sensitivity", 1 + F.col("risk"))


OBJ = f"{PASSES}, ob AS (SELECT *, importance / 4 AS cf, 1 + risk AS qs, 2 - greatest(0, least(1, tf / greatest(makespan, 1e-9))) AS cr FROM dates)"


@query(
    f"""{OBJ}, b AS (SELECT *, least(ceil(makespan), 500)::INTEGER AS n, makespan / least(ceil(makespan), 500) AS w FROM ob WHERE ef > es AND makespan > 0), c AS (SELECT *, greatest(0, least(floor(es / w), n - 1))::INTEGER AS b0 FROM b), d AS (SELECT *, greatest(b0 + 1, least(ceil(ef / w), n))::INTEGER AS b1 FROM c),
p AS (SELECT project_id, any_value(w) AS w, k, sum(resource_count) AS lvl FROM d, unnest(range(b0, b1)) t(k) GROUP BY project_id, k), r AS (SELECT project_id, sum(greatest(lvl - 10, 0) ** 2 * w) AS resources FROM p GROUP BY 1)
SELECT project_id, max(makespan) AS schedule, sum(85 * resource_count * duration) AS cost, round(sum(risk * 10 * cr * duration), 5) AS risk, round(sum(cf * cf * qs * duration), 6) AS quality, round(coalesce(any_value(r.resources), 0), 5) AS resources FROM ob LEFT JOIN r USING (project_id) GROUP BY 1"""
)
def solver_objectives(spark, sf_dir):
    return rounded(rounded(solver.objectives(solver_rows(spark, sf_dir)), 5, "risk", "resources"), 6, "quality")


GRAD = f"{OBJ}, g AS (SELECT project_id, id, critical::INT::DOUBLE AS d_schedule, 85 * resource_count AS d_cost, risk * 10 * cr AS d_risk, CASE WHEN duration > 0 THEN -2 * cf * qs ELSE 0 END AS d_quality FROM ob)"


@query(f"{GRAD} SELECT project_id, id, d_schedule, d_cost, round(d_risk, 8) AS d_risk, round(d_quality, 8) + 0.0 AS d_quality FROM g")
def solver_gradients(spark, sf_dir):
    return rounded(solver.gradients(solver_rows(spark, sf_dir)), 8, "d_risk", "d_quality")


_PAIRS = [("schedule", "cost"), ("schedule", "risk"), ("schedule", "quality"), ("cost", "risk"), ("cost", "quality"), ("risk", "quality")]


@query(f"{GRAD} SELECT project_id, " + ", ".join(f"round(CASE WHEN sum(d_{a} ** 2) > 0 AND sum(d_{b} ** 2) > 0 THEN sum(d_{a} * d_{b}) / sqrt(sum(d_{a} ** 2) * sum(d_{b} ** 2)) ELSE 0 END, 7) AS {a}_{b}" for a, b in _PAIRS) + " FROM g GROUP BY 1")
def gradient_alignment(spark, sf_dir):
    return rounded(solver.alignment(solver.gradients(solver_rows(spark, sf_dir))), 7, *[f"{a}_{b}" for a, b in _PAIRS])


@query(
    f"""{GRAD}, s AS (SELECT project_id, id, d_schedule * 0.5 + abs(d_risk) * 0.3 + abs(d_quality) * 0.2 AS sens FROM g), t AS (SELECT *, CASE WHEN max(sens) OVER w > 0 THEN sens / max(sens) OVER w ELSE 0 END AS score, row_number() OVER (PARTITION BY project_id ORDER BY sens DESC, id) AS rank FROM s WINDOW w AS (PARTITION BY project_id))
SELECT project_id, id, rank, round(sens, 8) AS sensitivity, round(score, 8) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS priority FROM t"""
)
def intervention_ranking(spark, sf_dir):
    return rounded(solver.ranking(solver.gradients(solver_rows(spark, sf_dir)), {"schedule": 0.5, "risk": 0.3, "quality": 0.2}), 8, "sensitivity", "score")


@query(f"WITH {ACT_SQL} SELECT project_id, id, duration, risk, tax FROM act a WHERE NOT EXISTS (SELECT 1 FROM act b WHERE b.project_id = a.project_id AND b.duration <= a.duration AND b.risk <= a.risk AND b.tax <= a.tax AND (b.duration < a.duration OR b.risk < a.risk OR b.tax < a.tax))")
def pareto_front(spark, sf_dir):
    a = activities(spark, sf_dir).select("project_id", "id", "duration", "risk", "tax")
    return solver.pareto_front(a, "project_id", ["duration", "risk", "tax"])


@query("SELECT i::INTEGER AS k, round(0.05 + 0.9 * i / 29, 9) AS schedule, round(0.95 - 0.9 * i / 29, 9) AS cost FROM range(30) t(i)")
def weight_vectors(spark, sf_dir):
    v = solver.weight_vectors(["schedule", "cost"])
    return spark.createDataFrame([(i, round(x["schedule"], 9), round(x["cost"], 9)) for i, x in enumerate(v)], "k int, schedule double, cost double")
