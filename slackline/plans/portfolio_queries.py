"""Queries: longest paths and deep networks, input rows, calendar projections, portfolio analytics; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.operators import analytics, calendar, cpm, ensemble, evm, inputs, longest, mining, montecarlo, outcomes, sanitise
from slackline.plans.core_queries import BASE, PASSES, rounded, schedule
from slackline.functions import reference_classes
from slackline.plans.extra_queries import OUT_SQL, PATH_CTE, order_outcomes, scratch
from slackline.plans.final_queries import predictions
from slackline.plans.more_queries import CAL_DAY, CAL_DAYS, CAL_SQL, MCF, SAMPLES, SPELLINGS, work_calendar
from slackline.sources import deep, requests
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


# --- paths and deep networks ----------------------------------------------------------------------

ESTIMATES = f"""{PATH_CTE}, en AS (SELECT project_id, max(seq) AS last FROM act GROUP BY 1),
es AS (SELECT project_id, seq, id AS path, duration::DOUBLE AS estimate FROM act WHERE seq = 1 UNION ALL SELECT e.project_id, l.dst, e.path || '>' || b.id, e.estimate + l.lag + b.duration FROM es e JOIN lnk l ON l.project_id = e.project_id AND l.src = e.seq JOIN act b ON b.id = l.target),
ep AS (SELECT e.project_id, path, estimate, row_number() OVER (PARTITION BY e.project_id ORDER BY estimate DESC, path) AS rank, count(*) OVER (PARTITION BY e.project_id) AS n FROM es e JOIN en ON en.project_id = e.project_id AND en.last = e.seq)"""


@query(f"{ESTIMATES} SELECT ep.project_id, rank, estimate, pt.duration, path, n::DOUBLE AS n_paths, n > 20 AS truncated FROM ep JOIN pt USING (project_id, path) WHERE rank <= 20")
def longest_paths(spark, sf_dir):
    return longest.longest_paths(*schedule(spark, sf_dir))


def deep_schedule(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = deep.activities(spark, sf_dir)
    return a, deep.links(a)


DEEP = f"""WITH RECURSIVE {deep.SQL}, dn AS (SELECT project_id, max(seq) AS last FROM dact GROUP BY 1)"""


@query(
    f"""{DEEP}, e AS (SELECT project_id, seq, 0.0::DOUBLE AS es FROM dact WHERE seq <= {deep.WIDTH} UNION ALL SELECT l.project_id, l.dst, greatest(0, max(e.es + l.w)) FROM e JOIN dlnk l ON l.project_id = e.project_id AND l.src = e.seq GROUP BY l.project_id, l.dst)
SELECT project_id, 'd-' || project_id || '-' || seq AS id, es, es + duration AS ef, max(es + duration) OVER (PARTITION BY project_id) AS makespan FROM e JOIN dact USING (project_id, seq)"""
)
def deep_cpm(spark, sf_dir):
    return cpm.cpm(*deep_schedule(spark, sf_dir)).select("project_id", "id", "es", "ef", "makespan")


@query(
    f"""{DEEP}, e AS (SELECT project_id, seq, duration::DOUBLE AS est, 1.0::DOUBLE AS n FROM dact WHERE seq <= {deep.WIDTH} UNION ALL SELECT l.project_id, l.dst, max(e.est + l.lag) + any_value(l.ds), sum(e.n) FROM e JOIN dlnk l ON l.project_id = e.project_id AND l.src = e.seq GROUP BY l.project_id, l.dst)
SELECT project_id, max(est) AS estimate, round(log10(sum(n)), 6) AS digits FROM e WHERE NOT EXISTS (SELECT 1 FROM dlnk l WHERE l.project_id = e.project_id AND l.src = e.seq) GROUP BY 1"""
)
def deep_longest(spark, sf_dir):
    d = longest.longest_paths(*deep_schedule(spark, sf_dir), most=1)
    return rounded(d.select("project_id", "estimate", F.log10("n_paths").alias("digits")), 6, "digits")


@query(
    f"""{BASE}, n AS (SELECT project_id, max(seq) AS last FROM act GROUP BY 1), f AS (SELECT project_id, 2::BIGINT AS seq FROM n WHERE last >= 2 UNION SELECT l.project_id, l.dst FROM f JOIN lnk l ON l.project_id = f.project_id AND l.src = f.seq),
b AS (SELECT project_id, last - 1 AS seq FROM n UNION SELECT l.project_id, l.src FROM b JOIN lnk l ON l.project_id = b.project_id AND l.dst = b.seq) SELECT project_id, project_id || '-' || seq AS id FROM f JOIN b USING (project_id, seq)"""
)
def active_subgraph(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    n = a.groupBy("project_id").agg(F.max("seq").alias("last"))
    return longest.between(a.join(n, "project_id").select("project_id", "seq", "id", (F.col("seq") == 2).alias("is_start"), (F.col("seq") == F.col("last") - 1).alias("is_end")), e)


@query(f"{BASE}, d AS (SELECT project_id, seq, 0 AS hops FROM act WHERE seq = 1 UNION SELECT l.project_id, l.dst, d.hops + 1 FROM d JOIN lnk l ON l.project_id = d.project_id AND l.src = d.seq WHERE hops < 3), h AS (SELECT project_id, seq, min(hops) AS hops FROM d GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY hops, seq) AS k FROM h WHERE hops > 0) SELECT project_id, project_id || '-' || seq AS id, hops FROM k WHERE k <= 4")
def downstream_activities(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    return longest.downstream(a.withColumn("is_start", F.col("seq") == 1), e, hops=3, most=4)


@query(f"{PASSES} SELECT project_id, id, critical, duration >= 49 AS milestone, importance >= 0.92 AS importance_outlier, risk >= 0.97 AS risk_outlier FROM dates WHERE critical OR duration >= 49 OR importance >= 0.92 OR risk >= 0.97")
def significant_activities(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    c = cpm.cpm(a, e).select("project_id", "id", "critical")
    rows = a.join(c, ["project_id", "id"]).select("project_id", "id", "critical", (F.col("duration") >= 49).alias("milestone"), (F.col("importance") >= 0.92).alias("importance_outlier"), (F.col("risk") >= 0.97).alias("risk_outlier"))
    return rows.where("critical or milestone or importance_outlier or risk_outlier")


@query(f"{PATH_CTE}, cr AS (SELECT id FROM (WITH RECURSIVE x AS (SELECT 1) SELECT id FROM act WHERE risk >= 0.5) z), g AS (SELECT project_id, path, duration, string_split(path, '>') AS x, max(duration) OVER (PARTITION BY project_id) AS d, max(len(string_split(path, '>'))) OVER (PARTITION BY project_id) AS n FROM pt), k AS (SELECT project_id, path, count(cr.id) AS k FROM (SELECT project_id, path, unnest(x) AS id FROM g) u LEFT JOIN cr USING (id) GROUP BY 1, 2) SELECT project_id, path, round(CASE WHEN d > 0 THEN 0.4::DOUBLE * duration / d + 0.3::DOUBLE * k / len(x) + 0.3::DOUBLE * len(x) / n ELSE 0 END, 8) AS significance FROM g JOIN k USING (project_id, path)")
def path_significance(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    return rounded(analytics.significance(cpm.path_durations(a, e), a.where("risk >= 0.5").select("project_id", "id")), 8, "significance")


@query(f"{PATH_CTE}, l AS (SELECT project_id, list_sort(list(len(string_split(path, '>')) - 1)) AS v FROM pt GROUP BY 1), s AS (SELECT project_id, n, (SELECT count(*) FROM lnk WHERE lnk.project_id = q.project_id) AS k FROM (SELECT project_id, count(*) AS n FROM act GROUP BY 1) q), t AS (SELECT project_id, n, k, v[floor(0.5 * (len(v) - 1))::INT + 1] AS m FROM s JOIN l USING (project_id)) SELECT project_id, 80::INT AS max_paths, 0.9::DOUBLE AS overlap_threshold, 4::INT AS min_unique_edges, 20000::INT AS candidate_cap, 2::INT AS midpoint_depth, m::BIGINT AS median_edges, n, k AS links FROM t")
def tuned_selection(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    lengths = cpm.path_durations(a, e).groupBy("project_id").agg(F.sort_array(F.collect_list((F.col("length") - 1).cast("long"))).alias("v"))
    shape = a.groupBy("project_id").agg(F.count("*").alias("nodes")).join(e.groupBy("project_id").agg(F.count("*").alias("k")), "project_id", "left").join(lengths, "project_id")
    shape = shape.select("project_id", "nodes", F.coalesce("k", F.lit(0)).alias("links"), F.element_at("v", (F.floor(0.5 * (F.size("v") - 1)) + 1).cast("int")).alias("median_edges"))
    return analytics.tuned_selection(shape).join(shape.select("project_id", "median_edges", F.col("nodes").alias("n"), "links"), "project_id")


# --- calendars and earned value -------------------------------------------------------------------


def advanced(name: str, source: str) -> str:
    """CTEs that advance st by h working hours in a table of midnights and whole hours; the result is column to_date of `name`."""
    return f"""{name}1 AS (SELECT s.*, floor(h / 8)::INTEGER AS whole, CASE WHEN h < 8 THEN c.next_weekday ELSE c.next_working END AS frm FROM {source} s JOIN cal c ON c.day = st::DATE),
{name}2 AS (SELECT r.*, CASE WHEN whole = 0 THEN frm ELSE coalesce(arrive, {CAL_DAYS - 1}) END * 24 + h - whole * 8 AS hh, most FROM {name}1 r JOIN cal f ON f.day_idx = frm CROSS JOIN mx LEFT JOIN ar ON ar.days_before = least(f.days_before + whole, most)),
{name} AS (SELECT r.*, CASE WHEN h <= 0 THEN st ELSE TIMESTAMP '{CAL_DAY} 00:00:00' + to_hours((hh + (c.next_working - c.day_idx) * 24)::INTEGER) END AS to_date FROM {name}2 r JOIN cal c ON c.day_idx = least(floor(hh / 24)::INTEGER, {CAL_DAYS - 1}))"""


CALENDAR = f"{CAL_SQL}, mx AS (SELECT max(days_before + is_working::INT) AS most FROM cal), ar AS (SELECT days_before, max(day_idx) AS arrive FROM cal GROUP BY 1)"


@query(f"{PASSES}, {CALENDAR}, sr AS (SELECT project_id, min(start) AS st, max(makespan) AS h FROM dates GROUP BY 1), {advanced('ad', 'sr')} SELECT ad.project_id, h AS makespan, to_date AS finished, c.days_before + floor(h / 8) >= most AS horizon_exhausted FROM ad JOIN cal c ON c.day = st::DATE")
def end_dates(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    span = cpm.cpm(a, e).groupBy("project_id").agg(F.max("makespan").alias("makespan"))
    rows = a.groupBy("project_id").agg(F.min("start").alias("start")).join(span, "project_id")
    return calendar.end_dates(rows, work_calendar(spark), "start", "makespan", CAL_DAY, CAL_DAYS).select("project_id", "makespan", "finished", "horizon_exhausted")


@query(
    f"""{PASSES}, {CALENDAR}, ps AS (SELECT project_id, min(start) AS st FROM act GROUP BY 1), sr AS (SELECT project_id, id, st, which, greatest(h, 0) AS h FROM (SELECT project_id, id, unnest(['es', 'ef', 'ls', 'lf']) AS which, unnest([es, ef, ls, lf]) AS h FROM dates) JOIN ps USING (project_id)), {advanced('ad', 'sr')},
pv AS (SELECT project_id, id, {', '.join(f"max(CASE WHEN which = '{n}' THEN to_date END) AS {n}_date" for n in ('es', 'ef', 'ls', 'lf'))} FROM ad GROUP BY 1, 2) SELECT *, date_diff('day', ef_date::DATE, lf_date::DATE)::INTEGER AS slack_days FROM pv"""
)
def calendar_slack(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    starts = a.groupBy("project_id").agg(F.min("start").alias("project_start"))
    return calendar.slack_dates(cpm.cpm(a, e), starts, work_calendar(spark), CAL_DAY, CAL_DAYS)


RISKY = "CASE WHEN part % 3 = 0 THEN start + to_days(5) END AS risk_start, CASE WHEN part % 3 = 0 THEN finish + to_days(9) END AS risk_end, CASE WHEN part % 5 < 2 THEN duration * 1.5::DOUBLE END AS risk_duration"
_BEGIN, _END = "coalesce(risk_start, start)", "coalesce(risk_end, finish)"
_PART = f"CASE WHEN sdt >= {_END} THEN 1.0::DOUBLE WHEN sdt > {_BEGIN} THEN (epoch(sdt) - epoch({_BEGIN})) / (epoch({_END}) - epoch({_BEGIN})) ELSE 0 END"


@query(f"WITH {ACT_SQL}, r AS (SELECT *, {RISKY}, TIMESTAMP '{STATUS_DATE}' AS sdt FROM act), s AS (SELECT *, {_PART} AS k FROM r) SELECT project_id, round(sum(duration * k), 7) AS forecasted_bcwp, round(sum(coalesce(risk_duration, duration) * k), 7) AS forecasted_acwp_hours, round(sum(coalesce(risk_duration, duration) * k * cost_rate), 6) AS forecasted_acwp_cost, bool_or(part % 3 = 0 OR part % 5 < 2) AS risk_adjusted FROM s GROUP BY 1")
def forecasted_values(spark, sf_dir):
    day = lambda n: F.make_dt_interval(F.lit(n))
    some = F.col("part") % 3 == 0
    a = activities(spark, sf_dir).withColumns({"risk_start": F.when(some, F.col("start") + day(5)), "risk_end": F.when(some, F.col("finish") + day(9)), "risk_duration": F.when(F.col("part") % 5 < 2, F.col("duration") * 1.5)})
    return rounded(rounded(evm.forecasted(a, STATUS_DATE), 7, "forecasted_bcwp", "forecasted_acwp_hours"), 6, "forecasted_acwp_cost")


@query(f"WITH {ACT_SQL}, d AS (SELECT project_id, start AS day FROM act UNION SELECT project_id, finish FROM act), k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY day) - 1 AS i FROM d) SELECT project_id, coalesce(min(CASE WHEN day > TIMESTAMP '{STATUS_DATE}' THEN i END), count(*)) AS transition FROM k GROUP BY 1")
def curve_transition(spark, sf_dir):
    return evm.first_after(evm.planned_curve(activities(spark, sf_dir)), STATUS_DATE)


@query(
    f"""WITH {ACT_SQL}, o AS (SELECT project_id, unnest([start, finish, actual_start, actual_finish]) AS day FROM act), e AS (SELECT project_id, min(day) AS a, max(day) AS z FROM o WHERE day IS NOT NULL GROUP BY 1), d AS (SELECT project_id, day FROM o WHERE day IS NOT NULL UNION SELECT project_id, unnest(generate_series(a, z, INTERVAL 7 DAY)) FROM e UNION SELECT project_id, TIMESTAMP '{STATUS_DATE}' FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY project_id) AS n FROM d), w AS (SELECT DISTINCT project_id, CASE WHEN n <= 40 THEN i ELSE (t * (n - 1)) // 39 END AS i FROM k, range(40) r(t) WHERE n <= 40 OR k.i = 0) SELECT project_id, day FROM k JOIN w USING (project_id, i)"""
)
def significant_dates(spark, sf_dir):
    return evm.significant_dates(activities(spark, sf_dir), ["start", "finish", "actual_start", "actual_finish"], STATUS_DATE, most=40)


# --- input rows -----------------------------------------------------------------------------------


def with_aliases(spark, sf_dir) -> DataFrame:
    a = activities(spark, sf_dir)
    return a.withColumns({"wbs": F.when(F.col("part") % 4 == 0, F.lit(None)).otherwise(F.col("resources")), "contract": F.when(F.col("part") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("C"), F.col("task_type")))})


ALIASES = f"WITH {ACT_SQL}, al AS (SELECT *, CASE WHEN part % 4 = 0 THEN NULL ELSE resources END AS wbs, CASE WHEN part % 3 = 0 THEN '  ' ELSE 'C' || task_type END AS contract FROM act)"


@query(f"{ALIASES} SELECT project_id, id, coalesce(nullif(trim(wbs), ''), nullif(trim(contract), ''), '(unassigned)') AS grp, coalesce(actual_cost, 0.0::DOUBLE) AS cost, greatest(resource_count, 1) AS resource_count, 85.0::DOUBLE AS rate FROM al")
def defaulted_nodes(spark, sf_dir):
    a = with_aliases(spark, sf_dir)
    return a.select("project_id", "id", inputs.first_filled(F.col("wbs"), F.col("contract"), default=F.lit("(unassigned)")).alias("grp"), inputs.first_number(F.col("actual_cost").cast("string"), default=0.0).alias("cost"), F.greatest(F.col("resource_count"), F.lit(1.0)).alias("resource_count"), inputs.first_number(F.lit("no number"), F.lit("85")).alias("rate"))


@query(f"{ALIASES}, g AS (SELECT project_id, count(*) AS n, count(nullif(trim(wbs), '')) AS a, count(nullif(trim(contract), '')) AS b FROM al GROUP BY 1), p AS (SELECT project_id, n, CASE WHEN a > 0 THEN 'wbs' WHEN b > 0 THEN 'contract' ELSE 'wbs' END AS field, CASE WHEN a > 0 THEN a ELSE b END AS populated FROM g) SELECT project_id, field, populated, n, CASE WHEN populated = 0 THEN 'none' WHEN populated < n THEN 'partial' END AS advice FROM p")
def grouping_fields(spark, sf_dir):
    return inputs.grouping_field(with_aliases(spark, sf_dir), ["wbs", "contract"])


@query(f"WITH {ACT_SQL} SELECT project_id, id, duration, risk FROM act WHERE seq <= 3")
def first_rows(spark, sf_dir):
    return inputs.first_rows(activities(spark, sf_dir), ["project_id", "id", "duration", "risk"], 3)


UNITS = [s if s.strip("? ") else "" for s in SPELLINGS]


def with_units(spark, sf_dir) -> DataFrame:
    return activities(spark, sf_dir).withColumn("unit", F.element_at(F.array(*map(F.lit, UNITS)), (F.col("part") % len(UNITS) + 1).cast("int"))).withColumn("duration", F.when(F.col("part") % 9 == 0, 0.0).otherwise(F.col("duration")))


UNIT_SQL = f"WITH {ACT_SQL}, un AS (SELECT project_id, seq, id, CASE WHEN part % 9 = 0 THEN 0 ELSE duration END AS duration, [{', '.join(repr(s) for s in UNITS)}][part % {len(UNITS)} + 1] AS unit FROM act)"


@query(f"{UNIT_SQL}, v AS (SELECT project_id, lower(coalesce(nullif(trim(unit), ''), 'Hours')) AS u, count(*) AS n, min(seq) AS pos, arg_min(coalesce(nullif(trim(unit), ''), 'Hours'), seq) AS f FROM un WHERE duration > 0 GROUP BY 1, 2), d AS (SELECT project_id, arg_max(f, (n, -pos)) AS unit, count(*) > 1 AS mixed FROM v GROUP BY 1) SELECT p.project_id, coalesce(unit, 'Hours') AS unit, coalesce(mixed, false) AS mixed FROM (SELECT DISTINCT project_id FROM un) p LEFT JOIN d USING (project_id)")
def dominant_units(spark, sf_dir):
    return inputs.dominant_units(with_units(spark, sf_dir), "unit", "duration")


_WALL = "CASE " + " ".join(f"WHEN u IN ({', '.join(map(repr, names))}) THEN {ms}::DOUBLE" for names, ms in inputs.WALL) + f" ELSE {inputs.HOUR}::DOUBLE END"


@query(f"{UNIT_SQL} SELECT project_id, id, round(duration * {_WALL}, 3) AS ms FROM (SELECT *, lower(trim(unit)) AS u FROM un)")
def wall_clock(spark, sf_dir):
    return rounded(with_units(spark, sf_dir).select("project_id", "id", inputs.wall_clock_ms(F.col("duration"), F.col("unit")).alias("ms")), 3, "ms")


@query(
    f"""{BASE}, ba AS (SELECT project_id, CASE WHEN part % 31 = 0 THEN '' WHEN part % 29 = 0 THEN project_id || '-1' ELSE id END AS id, CASE WHEN part % 23 = 0 THEN -1 ELSE duration END AS duration FROM act), bl AS (SELECT project_id, source, CASE WHEN lag = 4 THEN 'gone' WHEN lag = -4 THEN source ELSE target END AS target, CASE WHEN lag = 0 THEN 'XX' ELSE rel END AS rel FROM lnk),
v AS (SELECT project_id, 'missing_id' AS code, count(*) AS n FROM ba WHERE trim(id) = '' GROUP BY 1 UNION ALL SELECT project_id, 'bad_duration', count(*) FROM ba WHERE duration < 0 GROUP BY 1 UNION ALL SELECT project_id, 'duplicate_id', count(*) FROM (SELECT project_id, id FROM ba GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1 UNION ALL SELECT project_id, 'unknown_relation', count(*) FROM bl WHERE rel = 'XX' GROUP BY 1 UNION ALL SELECT project_id, 'self_link', count(*) FROM bl WHERE source = target GROUP BY 1
UNION ALL SELECT project_id, 'dangling_link', count(*) FROM (SELECT project_id, unnest([source, target]) AS id FROM bl) x WHERE NOT EXISTS (SELECT 1 FROM ba WHERE ba.project_id = x.project_id AND ba.id = x.id) GROUP BY 1) SELECT * FROM v"""
)
def request_violations(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    bad = F.when(F.col("part") % 31 == 0, "").when(F.col("part") % 29 == 0, F.concat(F.col("project_id"), F.lit("-1"))).otherwise(F.col("id"))
    a = a.withColumn("id", bad).withColumn("duration", F.when(F.col("part") % 23 == 0, -1.0).otherwise(F.col("duration")))
    target = F.when(F.col("lag") == 4, "gone").when(F.col("lag") == -4, F.col("source")).otherwise(F.col("target"))
    return inputs.violations(a, e.withColumn("target", target).withColumn("rel", F.when(F.col("lag") == 0, "XX").otherwise(F.col("rel"))))


@query(f"WITH {ACT_SQL} SELECT project_id, id, CASE WHEN part % 7 > 0 THEN duration END AS duration, strftime(start, '%Y-%m-%dT%H:%M:%S') AS start FROM act")
def json_round_trip(spark, sf_dir):
    a = activities(spark, sf_dir).select("project_id", "id", F.when(F.col("part") % 7 > 0, F.col("duration")).otherwise(F.lit(float("nan"))).alias("duration"), F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"))
    text = inputs.json_ready(a).select(F.to_json(F.struct(*a.columns)).alias("json"))
    return text.select(F.from_json("json", "project_id long, id string, duration double, start string").alias("r")).select("r.*")


@query(f"WITH {ACT_SQL} SELECT project_id, sha256(string_agg('duration=' || duration::BIGINT || ';id=' || id, chr(10) ORDER BY seq)) AS key FROM act GROUP BY 1")
def cache_keys(spark, sf_dir):
    a = activities(spark, sf_dir).select("project_id", "seq", "id", F.col("duration").cast("long").alias("duration"))
    return inputs.cache_keys(a, ["id", "duration"])


@query("SELECT name, value FROM (VALUES ('a', 1.0::DOUBLE), ('b', 20.0::DOUBLE), ('c', 300.0::DOUBLE), ('d', 4.0::DOUBLE)) t(name, value)")
def merged_registry(spark, sf_dir):
    make = lambda rows: spark.createDataFrame(rows, "name string, value double")
    return inputs.merged_registry(make([("a", 1.0), ("b", 2.0), ("c", 3.0)]), make([("b", 20.0), ("c", 30.0), ("d", 4.0)]), make([("c", 300.0)]))


# --- portfolio analytics --------------------------------------------------------------------------


@query(f"WITH {ACT_SQL} SELECT project_id, id, 1 + risk AS by_fraction, 1 + importance * 0.5::DOUBLE AS by_probability, least(3.0, 1 + part / 100.0::DOUBLE) AS by_percent FROM act")
def overrun_multipliers(spark, sf_dir):
    m = analytics.overrun_multiplier
    return activities(spark, sf_dir).select("project_id", "id", m(F.col("risk")).alias("by_fraction"), m(F.col("importance"), "probability", 0.5).alias("by_probability"), m(F.col("part").cast("double"), "percent").alias("by_percent"))


@query(f"WITH {ACT_SQL}, w AS (SELECT *, len(list_filter(range(0, date_diff('day', start::DATE, finish::DATE) + 1), lambda i: (isodow(start) - 1 + i) % 7 < 5)) AS n FROM act) SELECT project_id, id, CASE WHEN n > 0 THEN ceil(duration / (n * 8)) ELSE 0 END::INTEGER AS resources_needed FROM w")
def resource_needs(spark, sf_dir):
    return activities(spark, sf_dir).select("project_id", "id", analytics.resource_need(F.col("start"), F.col("finish"), F.col("duration")).alias("resources_needed"))


HISTOGRAM = f"WITH {ACT_SQL}, g AS (SELECT task_type, floor(duration * (1 + risk) / 3)::BIGINT AS bin, count(*) AS n FROM act GROUP BY 1, 2), e AS (SELECT task_type, unnest(range(min(bin), max(bin) + 1)) AS bin FROM g GROUP BY 1), h AS (SELECT task_type, bin, coalesce(n, 0) AS n FROM e LEFT JOIN g USING (task_type, bin)), s AS (SELECT *, avg(n) OVER (PARTITION BY task_type ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM h)"


def typed_histogram(spark, sf_dir) -> DataFrame:
    return analytics.histogram(activities(spark, sf_dir).withColumn("x", F.col("duration") * (1 + F.col("risk"))), "task_type", "x", 3.0)


@query(f"{HISTOGRAM} SELECT task_type, bin, n, round(s, 8) AS smoothed FROM s")
def duration_histogram(spark, sf_dir):
    return rounded(typed_histogram(spark, sf_dir), 8, "smoothed")


@query(
    f"""{HISTOGRAM}, p AS (SELECT * FROM (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r FROM s WINDOW w AS (PARTITION BY task_type ORDER BY bin)) WHERE s > l AND s > r),
v AS (SELECT p.task_type, p.bin, p.n, p.s, (SELECT max(o.bin) FROM s o WHERE o.task_type = p.task_type AND o.bin < p.bin AND o.s > p.s) AS lo, (SELECT min(o.bin) FROM s o WHERE o.task_type = p.task_type AND o.bin > p.bin AND o.s > p.s) AS hi FROM p),
b AS (SELECT v.*, greatest((SELECT min(o.s) FROM s o WHERE o.task_type = v.task_type AND o.bin <= v.bin AND (lo IS NULL OR o.bin >= lo)), (SELECT min(o.s) FROM s o WHERE o.task_type = v.task_type AND o.bin >= v.bin AND (hi IS NULL OR o.bin <= hi))) AS base FROM v),
w AS (SELECT b.*, (SELECT max(o.bin) FROM s o WHERE o.task_type = b.task_type AND o.bin < b.bin AND o.s <= (b.s + base) / 2) AS x, (SELECT min(o.bin) FROM s o WHERE o.task_type = b.task_type AND o.bin > b.bin AND o.s <= (b.s + base) / 2) AS y, (SELECT min(bin) FROM s o WHERE o.task_type = b.task_type) AS first, (SELECT max(bin) FROM s o WHERE o.task_type = b.task_type) AS last FROM b)
SELECT task_type, bin, n, round(s, 8) AS smoothed, round((s - base) / s, 8) AS prominence, coalesce(y, last + 1) - coalesce(x, first - 1) - 1 AS width FROM w"""
)
def duration_peaks(spark, sf_dir):
    return rounded(analytics.peaks(typed_histogram(spark, sf_dir), "task_type"), 8, "smoothed", "prominence")


@query(f"WITH {ACT_SQL} SELECT project_id, id, round(0.4::DOUBLE * risk + 0.3::DOUBLE * importance + CASE WHEN pct > 90 THEN 0.15::DOUBLE ELSE 0 END + 0.15::DOUBLE * least(1, tax / 8), 9) AS risk_index FROM act")
def activity_risk_index(spark, sf_dir):
    r = analytics.risk_index(F.col("risk"), F.col("importance"), F.col("pct") > 90, -F.col("tax") / 8)
    return rounded(activities(spark, sf_dir).select("project_id", "id", r.alias("risk_index")), 9, "risk_index")


@query(f"WITH {ACT_SQL} SELECT project_id, date_diff('day', min(start)::DATE, max(finish)::DATE)::INTEGER AS spread, CASE WHEN date_diff('day', min(start)::DATE, max(finish)::DATE) <= 14 THEN 'high' WHEN date_diff('day', min(start)::DATE, max(finish)::DATE) <= 45 THEN 'medium' WHEN date_diff('day', min(start)::DATE, max(finish)::DATE) <= 90 THEN 'low' ELSE 'critical' END AS confidence FROM act GROUP BY 1")
def forecast_confidence(spark, sf_dir):
    g = activities(spark, sf_dir).groupBy("project_id").agg(F.datediff(F.max("finish"), F.min("start")).alias("spread"))
    return g.withColumn("confidence", analytics.confidence(F.col("spread")))


@query(f"WITH {ACT_SQL}, z AS (SELECT project_id, id, duration, actual_finish, CASE WHEN part % 2 = 0 THEN 0 ELSE pct / 100 END AS p, CASE WHEN part % 5 > 0 THEN actual_start END AS st FROM act) SELECT project_id, id, round(CASE WHEN p > 0 THEN p WHEN st IS NOT NULL AND actual_finish IS NULL AND duration > 0 THEN least(0.99::DOUBLE, greatest(0, epoch(TIMESTAMP '{STATUS_DATE}') - epoch(st)) / 3600 * (5 / 7::DOUBLE) / duration) ELSE 0 END, 8) AS progress FROM z")
def estimated_progress(spark, sf_dir):
    p, st = F.when(F.col("part") % 2 == 0, 0.0).otherwise(F.col("pct") / 100), F.when(F.col("part") % 5 > 0, F.col("actual_start"))
    return rounded(activities(spark, sf_dir).select("project_id", "id", analytics.elapsed_percent(p, st, F.col("actual_finish"), F.col("duration"), STATUS_DATE).alias("progress")), 8, "progress")


@query(f"WITH {ACT_SQL}, g AS (SELECT r_name AS region, task_type AS t, risk FROM act JOIN supplier ON s_suppkey = supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE part % 10 < 8 OR task_type <> 'A'), h AS (SELECT region, count(DISTINCT t) AS types, count(*) AS signals, greatest(0, max(risk)) AS max_severity FROM g GROUP BY 1) SELECT region, types, signals, max_severity, round(least(1.5, 1 + 0.25::DOUBLE * log2(types) + CASE WHEN max_severity > 0.7 THEN 0.08 WHEN max_severity > 0.4 THEN 0.04 ELSE 0 END), 9) AS amplification FROM h WHERE types >= 2")
def compound_risk(spark, sf_dir):
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("s_suppkey").alias("supplier"), F.col("r_name").alias("region"))
    s = activities(spark, sf_dir).where("part % 10 < 8 or task_type <> 'A'").join(places, "supplier").select("region", F.col("task_type").alias("type"), F.col("risk").alias("severity"))
    return rounded(analytics.compound_risk(s), 9, "amplification")


NAMES = [n for n, _ in analytics.SECTORS] + ["", "Light RAIL and airport"]
_FACTOR = "CASE " + " ".join(f"WHEN contains(lower(sector), '{n}') THEN {f}::DOUBLE" for n, f in analytics.SECTORS) + " ELSE 1 END"


@query(f"WITH {ACT_SQL}, g AS (SELECT project_id, count(*) AS n, date_diff('day', min(start)::DATE, max(finish)::DATE) AS d, sum(duration * cost_rate) * 1000 AS c, [{', '.join(repr(n) for n in NAMES)}][project_id % {len(NAMES)} + 1] AS sector FROM act GROUP BY 1) SELECT project_id, least(100, floor((least(25, n * 100 / 500::DOUBLE * 25) + least(25, d / 1500::DOUBLE * 25) + least(25, c / 5e9 * 25) + CASE WHEN n * 100 > 1000 THEN 10 WHEN n * 100 > 500 THEN 5 ELSE 0 END) * {_FACTOR} + 0.5))::INTEGER AS complexity FROM g")
def project_complexity(spark, sf_dir):
    sector = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("project_id") % len(NAMES) + 1).cast("int"))
    g = activities(spark, sf_dir).groupBy("project_id").agg((F.count("*") * 100).alias("n"), F.datediff(F.max("finish"), F.min("start")).alias("d"), (F.sum(F.col("duration") * F.col("cost_rate")) * 1000).alias("c"))
    return g.select("project_id", analytics.complexity(F.col("n"), F.col("d"), F.col("c"), sector).alias("complexity"))


LABELS = ["Steel pipe purchase", "Crane rental", "crew and staff", "permit office", "vendor", "tool steel", "supervisor management", "nothing"]
_SCORES = [" + ".join(f"contains(x, '{w}')::INT" for w in words) for _, words in analytics.COST_WORDS]


@query(f"WITH {ACT_SQL}, n AS (SELECT *, lower([{', '.join(map(repr, LABELS))}][part % {len(LABELS)} + 1] || ' ' || p_name) AS x FROM act JOIN part ON p_partkey = part), s AS (SELECT *, [{', '.join(_SCORES)}] AS k FROM n), t AS (SELECT *, CASE WHEN list_max(k) > 0 THEN [{', '.join(repr(c) for c, _ in analytics.COST_WORDS)}][list_position(k, list_max(k))] ELSE 'DIRECT_LABOR' END AS cost_type FROM s) SELECT project_id, cost_type, count(*) AS tasks, round(sum(duration * cost_rate), 6) AS budget, round(sum(coalesce(actual_cost, 0)), 6) AS actual FROM t GROUP BY 1, 2".replace(" JOIN part ON p_partkey = part)", " JOIN part AS pp ON pp.p_partkey = act.part)"))
def cost_breakdown(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name")
    name = F.concat(F.element_at(F.array(*map(F.lit, LABELS)), (F.col("part") % len(LABELS) + 1).cast("int")), F.lit(" "), F.col("p_name"))
    g = activities(spark, sf_dir).join(p, "part").withColumn("cost_type", analytics.cost_type(name)).groupBy("project_id", "cost_type")
    return rounded(g.agg(F.count("*").alias("tasks"), F.sum(F.col("duration") * F.col("cost_rate")).alias("budget"), F.sum(F.coalesce("actual_cost", F.lit(0.0))).alias("actual")), 6, "budget", "actual")


@query(f"WITH {ACT_SQL}, p AS (SELECT a.project_id, a.seq AS first, b.seq - a.seq + 1 AS length, (SELECT avg(c.risk) FROM act c WHERE c.project_id = a.project_id AND c.seq BETWEEN a.seq AND b.seq) AS mean FROM act a JOIN act b ON b.project_id = a.project_id AND b.seq >= a.seq + 2), k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY length DESC, round(mean, 9) DESC, first) AS k FROM p WHERE mean >= 0.55 + 1e-12) SELECT project_id, first, length, round(mean, 9) AS mean FROM k WHERE k = 1")
def salient_windows(spark, sf_dir):
    return rounded(analytics.best_windows(activities(spark, sf_dir), "risk", 0.55 + 1e-12), 9, "mean")


# --- mining, predictions, cycles, constraints -----------------------------------------------------

_Z = ", ".join(f"CASE WHEN d_{m} > 0 THEN (x.{m} - m_{m}) / (1.4826 * d_{m}) WHEN s_{m} > 1e-12 THEN (x.{m} - a_{m}) / s_{m} ELSE 0 END AS z_{m}" for m in ("deg_in", "deg_out", "risk", "importance"))
_UP = lambda x: f"greatest(0, least(3, {x})) / 3"


@query(
    f"""{PATH_CTE}, nd AS (SELECT a.project_id, a.id, (SELECT count(DISTINCT source) FROM lnk l WHERE l.target = a.id)::DOUBLE AS deg_in, (SELECT count(DISTINCT target) FROM lnk l WHERE l.source = a.id)::DOUBLE AS deg_out, risk, importance FROM act a), el AS (SELECT * FROM nd WHERE (deg_in > 0) = (deg_out > 0)),
md AS (SELECT project_id, {', '.join(f"median({m}) AS m_{m}, avg({m}) AS a_{m}, stddev_pop({m}) AS s_{m}" for m in ('deg_in', 'deg_out', 'risk', 'importance'))} FROM el GROUP BY 1), mm AS (SELECT x.project_id, {', '.join(f"median(abs(x.{m} - m_{m})) AS d_{m}" for m in ('deg_in', 'deg_out', 'risk', 'importance'))} FROM el x JOIN md USING (project_id) GROUP BY 1),
z AS (SELECT x.project_id, x.id, {_Z} FROM el x JOIN md USING (project_id) JOIN mm USING (project_id)), zz AS (SELECT project_id, id, greatest(z_deg_in, z_deg_out, z_risk, z_importance) >= 0.9 AS anchor, {_UP('z_deg_in')} AS ji, {_UP('z_deg_out')} AS jo, {_UP('(z_risk + z_importance) / 3')} AS sal FROM z),
pp AS (SELECT project_id, path, string_split(path, '>')[2:-2] AS x FROM pt), po AS (SELECT pp.project_id, path, x, i, x[i] AS id, anchor, ji, jo, sal FROM (SELECT project_id, path, x, unnest(range(1, len(x) + 1)) AS i FROM pp WHERE len(x) >= 3) pp JOIN zz ON zz.id = pp.x[pp.i]),
pr AS (SELECT f.project_id, f.path, array_to_string(f.x[f.i:l.i], '>') AS part, l.i - f.i + 1 AS n, f.ji, l.jo, (SELECT avg(sal) FROM po m WHERE m.project_id = f.project_id AND m.path = f.path AND m.i BETWEEN f.i AND l.i) AS sal, CASE WHEN f.i > 1 THEN f.x[f.i - 1] END AS le, f.x[l.i + 1] AS ri FROM po f JOIN po l ON l.project_id = f.project_id AND l.path = f.path AND l.i >= f.i + 2 AND f.anchor AND l.anchor),
nb AS (SELECT project_id, part, max(k) AS k FROM (SELECT project_id, part, s, id, count(*) AS k FROM (SELECT project_id, part, 0 AS s, le AS id FROM pr UNION ALL SELECT project_id, part, 1, ri FROM pr) WHERE id IS NOT NULL GROUP BY ALL) GROUP BY 1, 2),
cp AS (SELECT project_id, count(*) AS corpus FROM pt GROUP BY 1), g AS (SELECT project_id, part, min(n)::INTEGER AS length, count(*) AS support, min(ji) AS ji, min(jo) AS jo, max(sal) AS sal FROM pr GROUP BY 1, 2)
SELECT project_id, part, length, support, round(support / corpus::DOUBLE, 8) AS supp, round((ji + jo) / 2, 8) AS junc, round(sal, 8) AS sal, round(coalesce(k, 0) / support::DOUBLE, 8) AS maxpen, round(support / corpus::DOUBLE + (ji + jo) / 2 + sal - coalesce(k, 0) / support::DOUBLE, 8) AS score FROM g JOIN cp USING (project_id) LEFT JOIN nb USING (project_id, part)"""
)
def mined_parts(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    found = mining.recurring_parts(cpm.path_durations(a, e), mining.node_scores(a, e), threshold=0.9)
    return rounded(found, 8, "supp", "junc", "sal", "maxpen", "score")


@query()
def mined_top_parts(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    return mining.top_parts(mining.recurring_parts(cpm.path_durations(a, e), mining.node_scores(a, e), threshold=0.9))


@query()
def propagated_predictions(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    f = evm.frontier(a, e).withColumn("frontier", F.lit(True))
    known = [r["day"] for r in work_calendar(spark).where("is_working").select("day").collect()]  # the days of one calendar
    return evm.propagated_predictions(predictions(spark, sf_dir).join(f, ["project_id", "id"], "left"), e, known)


@query()
def risk_on_cycles(spark, sf_dir):
    """The derived links with one that leads back from each third activity to its project's first."""
    a, e = schedule(spark, sf_dir)
    back = a.where("seq = 3").select("project_id", F.col("id").alias("source"), F.concat_ws("-", F.col("project_id"), F.lit(1)).alias("target"), F.lit("FS").alias("rel"), F.lit(0.0).alias("lag"), F.lit(3).alias("ord"))
    return sanitise.risk_on_cycles(a, e.unionByName(back))


@query(
    f"""{PASSES}, m AS (SELECT project_id, max(makespan) AS makespan, sum(85 * greatest(resource_count, 1) * duration) AS cost, CASE WHEN project_id % 4 > 0 THEN sum(duration) * 0.8::DOUBLE END AS mm, 12000.0::DOUBLE AS mb FROM dates GROUP BY 1)
SELECT project_id, makespan, cost, coalesce(greatest(0, makespan - mm), 0) AS makespan_violation, coalesce(makespan - mm <= 1e-6 * greatest(mm, 1), true) AS makespan_met, greatest(0, cost - mb) AS budget_violation, cost - mb <= 1e-6 * greatest(mb, 1) AS budget_met, round(coalesce(50 * greatest(0, makespan - mm) ** 2 / mm ** 2, 0) + 50 * greatest(0, cost - mb) ** 2 / mb ** 2, 7) AS penalty FROM m"""
)
def constraint_report(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    cost = a.groupBy("project_id").agg(F.sum(85 * F.greatest("resource_count", F.lit(1.0)) * F.col("duration")).alias("cost"), F.sum("duration").alias("hours"))
    m = cpm.cpm(a, e).groupBy("project_id").agg(F.max("makespan").alias("makespan")).join(cost, "project_id")
    out = ensemble.constraints(m, F.when(F.col("project_id") % 4 > 0, F.col("hours") * 0.8), F.lit(12000.0)).drop("hours")
    return rounded(out, 7, "penalty")


@query()
def optimised_tchebycheff(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    return ensemble.optimise(a.withColumn("budget", F.lit(9000.0)), e, {"schedule": 0.5, "cost": 0.3, "quality": 0.2}, tchebycheff=True, max_budget="budget")


# --- requests, outcomes, registers ----------------------------------------------------------------


@query(f"WITH {ACT_SQL} SELECT project_id, seq::INTEGER AS seq, id, CASE WHEN part % 11 = 0 THEN 1.0::DOUBLE ELSE duration END AS duration, start, risk FROM act")
def request_nodes(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    a = a.withColumn("duration", F.when(F.col("part") % 11 > 0, F.col("duration")))
    path = scratch(spark, "requests")
    requests.packed(a, e).write.json(path)
    return requests.nodes(requests.read(spark, path))


@query("SELECT 'good' AS name, 1.1::DOUBLE AS p50, 1.3::DOUBLE AS p80, 1.6::DOUBLE AS p95")
def class_registry_file(spark, sf_dir):
    path = scratch(spark, "classes")
    lines = ['{"name": "good", "p50": 1.1, "p80": 1.3, "p95": 1.6, "cap": 5}', '{"name": "falling", "p50": 1.5, "p80": 1.3, "p95": 1.6}', "no json", '{"p50": 1, "p80": 2, "p95": 3}', '{"name": "low", "p50": 1, "p80": 2, "p95": 3, "cap": 1}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return reference_classes.loaded(spark, path).select("name", "p50", "p80", "p95")


MISSPELT = ["raill", "Nuclear New-Build", "IT softwear", "tunnnels", "hydro dams", "zzzzzzzzzzzzzzzzzz", "sollar", "mning"]


@query(f"WITH n AS (SELECT unnest([{', '.join(map(repr, MISSPELT))}]) AS name), k AS (SELECT unnest([{', '.join(map(repr, sorted({c[0] for c in reference_classes.CLASSES} | set(reference_classes.ALIASES))))}]) AS k), d AS (SELECT name, k, levenshtein(regexp_replace(lower(trim(name)), '[\\s\\-]+', '_', 'g'), k) AS d FROM n, k) SELECT name, CASE WHEN min(d) <= 6 THEN arg_min(k, (d, k)) END AS suggestion FROM d GROUP BY 1")
def class_suggestions(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in MISSPELT], "name string").withColumn("suggestion", reference_classes.suggested(F.col("name")))


@query(f"WITH {OUT_SQL} SELECT reference_class, project_id, strftime(submitted_at, '%Y-%m-%dT%H:%M:%S') AS submitted_at FROM oc WHERE reference_class = 'rail' ORDER BY project_id LIMIT 10000")
def outcome_listing(spark, sf_dir):
    rows = outcomes.listed(order_outcomes(spark, sf_dir), "rail")
    return rows.select("reference_class", "project_id", F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("submitted_at"))


@query(f"{MCF} SELECT project_id, list_min(v) AS earliest, list_max(v) AS latest, round(mean, 6) AS mean, round(sd, 6) AS sd FROM sm JOIN ps USING (project_id)")
def mc_spread(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    s = montecarlo.spread(montecarlo.forecast(montecarlo.with_scope(a, STATUS_DATE), e, SAMPLES))
    return rounded(s, 6, "mean", "sd")


@query(f"WITH {ACT_SQL}, f AS (SELECT *, bool_or(actual_start IS NOT NULL) OVER p AS begun, min(CASE WHEN seq > 1 THEN actual_start END) OVER p AS first FROM act WINDOW p AS (PARTITION BY project_id)) SELECT project_id, id, CASE WHEN seq = 1 AND begun THEN 100 ELSE pct END AS pct, CASE WHEN seq = 1 AND begun THEN coalesce(actual_start, first, start) ELSE actual_start END AS actual_start, CASE WHEN seq = 1 AND begun THEN coalesce(actual_finish, actual_start, first, start) ELSE actual_finish END AS actual_finish FROM f")
def completed_starts(spark, sf_dir):
    return evm.completed_starts(activities(spark, sf_dir), F.col("seq") == 1).select("project_id", "id", "pct", "actual_start", "actual_finish")


@query(f"WITH {ACT_SQL}, d AS (SELECT task_type, risk - importance AS d FROM act WHERE abs(risk - importance) > 0.05) SELECT task_type, count(*) AS signals, count_if(d > 0) AS overreacting, count_if(d < 0) AS underreacting, floor(avg(d) * 1000 + 0.5::DOUBLE) / 1000 AS average FROM d GROUP BY 1")
def sentiment_divergence(spark, sf_dir):
    return analytics.sentiment_divergence(activities(spark, sf_dir).withColumn("divergence", F.col("risk") - F.col("importance")), "task_type")


@query(f"WITH {ACT_SQL} SELECT resources, count(*) AS forecasts, floor(avg(risk) * 1000 + 0.5::DOUBLE) / 1000 AS confidence, max(floor(importance * 1000 + 0.5::DOUBLE) / 1000) AS max_severity, count_if(seq % 3 = 0) AS h24, count_if(seq % 3 = 1) AS h48 FROM act WHERE task_type = 'A' GROUP BY 1")
def weather_confidence(spark, sf_dir):
    horizon = F.when(F.col("seq") % 3 == 0, "24h").when(F.col("seq") % 3 == 1, "48h")
    s = activities(spark, sf_dir).select("resources", F.when(F.col("task_type") == "A", "weather").otherwise("other").alias("type"), F.col("risk").alias("confidence"), F.col("importance").alias("severity"), horizon.alias("horizon"))
    return analytics.weather_confidence(s, "resources")


@query("WITH r AS (SELECT p_name AS name, p_type AS type, p_partkey AS ord, 0 AS p FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT upper(p_name), p_type, p_partkey, 1 FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(type) ORDER BY p, ord) AS k FROM r) SELECT name, type, ord FROM k WHERE k = 1")
def merged_risks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("ord"))
    return analytics.merged_risks(p.where("ord % 3 = 0"), p.withColumn("name", F.upper("name")))


@query(f"WITH {ACT_SQL}, g AS (SELECT task_type, round(duration * 10)::BIGINT AS tenths, resources AS v, count(*) AS k FROM act GROUP BY 1, 2, 3), t AS (SELECT task_type, tenths, sum(k)::BIGINT AS n, max(k) AS top FROM g GROUP BY 1, 2 HAVING sum(k) > 1) SELECT task_type, tenths, n, string_agg(v, ',' ORDER BY v) AS modes FROM g JOIN t USING (task_type, tenths) WHERE k = top GROUP BY 1, 2, 3")
def pattern_modes(spark, sf_dir):
    return analytics.pattern_modes(activities(spark, sf_dir), "resources")
