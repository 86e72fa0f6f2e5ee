"""Queries over the derived schedules: critical path, interfaces, earned value; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.operators import cpm, evm, interface
from slackline.sources.star import ACT_SQL, LNK_SQL, STATUS_DATE, activities, links, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def schedule(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = activities(spark, sf_dir)
    return a, links(a)


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Columns rounded as the SQL's engine does, by scaled numbers and not by decimal digits, and 0 for -0."""
    return df.withColumns({c: F.round(F.col(c) * 10.0**places) / F.lit(10.0**places) + F.lit(0.0) for c in columns})


BASE = f"WITH RECURSIVE {ACT_SQL},\n{LNK_SQL}"
#: Early starts as maxima over all path prefixes, late starts over all suffixes.
PASSES = f"""{BASE},
fwd AS (SELECT project_id, seq, 0.0::DOUBLE AS es FROM act UNION SELECT f.project_id, l.dst, greatest(0, f.es + l.w) FROM fwd f JOIN lnk l ON l.project_id = f.project_id AND l.src = f.seq),
early AS (SELECT project_id, seq, max(es) AS es FROM fwd GROUP BY 1, 2),
span AS (SELECT project_id, max(es + duration) AS makespan FROM early JOIN act USING (project_id, seq) GROUP BY 1),
bwd AS (SELECT a.project_id, a.seq, makespan - duration AS ls FROM act a JOIN span USING (project_id) UNION SELECT b.project_id, l.src, b.ls - l.w FROM bwd b JOIN lnk l ON l.project_id = b.project_id AND l.dst = b.seq),
late AS (SELECT project_id, seq, min(ls) AS ls FROM bwd GROUP BY 1, 2),
dates AS (SELECT a.*, es, es + duration AS ef, ls, ls + duration AS lf, ls - es AS tf, abs(ls - es) < 1e-9 AS critical, makespan FROM act a JOIN early USING (project_id, seq) JOIN late USING (project_id, seq) JOIN span USING (project_id))
"""


@query(f"{PASSES} SELECT project_id, id, seq, es, ef, ls, lf, tf, critical, makespan FROM dates")
def cpm_activities(spark, sf_dir):
    return cpm.cpm(*schedule(spark, sf_dir))


@query(f"{PASSES} SELECT project_id, max(makespan) AS makespan, count_if(critical) AS critical_count, count(*) AS activities FROM dates GROUP BY 1")
def cpm_makespan(spark, sf_dir):
    d = cpm.cpm(*schedule(spark, sf_dir))
    return d.groupBy("project_id").agg(F.max("makespan").alias("makespan"), F.count_if("critical").alias("critical_count"), F.count("*").alias("activities"))


@query(f"{PASSES} SELECT project_id, id, tf FROM dates WHERE tf <= 24 + 1e-9")
def near_critical(spark, sf_dir):
    return cpm.cpm(*schedule(spark, sf_dir)).where("tf <= 24 + 1e-9").select("project_id", "id", "tf")


@query(
    f"""{PASSES}, cl AS (SELECT l.project_id, l.src, l.dst, l.ord FROM lnk l JOIN dates a ON a.project_id = l.project_id AND a.seq = l.src AND a.critical JOIN dates b ON b.project_id = l.project_id AND b.seq = l.dst AND b.critical),
nx AS (SELECT project_id, src, arg_min(dst, ord) AS dst FROM cl GROUP BY 1, 2),
lvl AS (SELECT seq, project_id, 0 AS k FROM act WHERE seq = 1 UNION SELECT l.dst, l.project_id, v.k + 1 FROM lvl v JOIN lnk l ON l.project_id = v.project_id AND l.src = v.seq),
st AS (SELECT d.project_id, arg_min(d.seq, (v.k, d.seq)) AS seq FROM dates d JOIN (SELECT project_id, seq, max(k) AS k FROM lvl GROUP BY ALL) v USING (project_id, seq) WHERE critical AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.project_id = d.project_id AND cl.dst = d.seq) GROUP BY 1),
walk AS (SELECT project_id, seq, 0 AS pos FROM st UNION ALL SELECT w.project_id, nx.dst, w.pos + 1 FROM walk w JOIN nx ON nx.project_id = w.project_id AND nx.src = w.seq)
SELECT project_id, pos, project_id || '-' || seq AS id FROM walk"""
)
def critical_path(spark, sf_dir):
    return cpm.critical_path(*schedule(spark, sf_dir))


@query(
    f"""{BASE}, fw AS (SELECT *, CASE WHEN rel IN ('FF', 'SF') THEN greatest(w, 0) ELSE w END AS f FROM lnk),
a0 AS (SELECT project_id, seq, 0.0::DOUBLE AS d FROM act a WHERE NOT EXISTS (SELECT 1 FROM lnk l WHERE l.project_id = a.project_id AND l.dst = a.seq) UNION SELECT a0.project_id, l.dst, a0.d + l.f FROM a0 JOIN fw l ON l.project_id = a0.project_id AND l.src = a0.seq),
z0 AS (SELECT project_id, seq, 0.0::DOUBLE AS d FROM act a WHERE NOT EXISTS (SELECT 1 FROM lnk l WHERE l.project_id = a.project_id AND l.src = a.seq) UNION SELECT z0.project_id, l.src, CASE rel WHEN 'FS' THEN dp + lag + z0.d WHEN 'SS' THEN greatest(dp, lag + z0.d) WHEN 'FF' THEN greatest(dp, greatest(0, dp + lag - ds) + z0.d) ELSE greatest(dp, greatest(0, lag - ds) + z0.d) END FROM z0 JOIN lnk l ON l.project_id = z0.project_id AND l.dst = z0.seq)
SELECT a.project_id, a.id, s.lo AS shortest_from_start, s.hi AS longest_from_start, e.lo AS shortest_to_end, e.hi AS longest_to_end FROM act a JOIN (SELECT project_id, seq, min(d) AS lo, max(d) AS hi FROM a0 GROUP BY 1, 2) s USING (project_id, seq) JOIN (SELECT project_id, seq, min(d) AS lo, max(d) AS hi FROM z0 GROUP BY 1, 2) e USING (project_id, seq)"""
)
def distances(spark, sf_dir):
    return cpm.distances(*schedule(spark, sf_dir))


@query(
    f"""{PASSES}, c AS (SELECT l.*, e.es + l.w AS c FROM lnk l JOIN early e ON e.project_id = l.project_id AND e.seq = l.src)
SELECT * FROM (SELECT project_id, target AS id, row_number() OVER (PARTITION BY project_id, dst ORDER BY c DESC, src) AS rank, source AS pred_id, c AS candidate_es, max(c) OVER (PARTITION BY project_id, dst) - c AS delta,
 max(c) OVER (PARTITION BY project_id, dst) - c <= 1e-6 AS driving, max(c) OVER (PARTITION BY project_id, dst) - c <= 8 AS near_driving FROM c) WHERE rank <= 10"""
)
def predecessor_rankings(spark, sf_dir):
    return cpm.predecessor_rankings(*schedule(spark, sf_dir))


@query(
    f"""{BASE}, p AS (SELECT project_id, seq, 0.0::DOUBLE AS s, duration AS f, 1 AS n, id AS path FROM act a WHERE NOT EXISTS (SELECT 1 FROM lnk l WHERE l.project_id = a.project_id AND l.dst = a.seq)
UNION ALL SELECT q.project_id, q.dst, q.ns, greatest(q.nf, q.ns + q.ds), q.n + 1, q.path FROM (SELECT p.project_id, l.dst, l.ds, p.n, p.path || '>' || l.target AS path,
 greatest(0, CASE rel WHEN 'FS' THEN f + lag WHEN 'SS' THEN s + lag WHEN 'FF' THEN greatest(0, f + lag - ds) ELSE greatest(0, s + lag - ds) END) AS ns,
 CASE rel WHEN 'FS' THEN greatest(0, f + lag) + ds WHEN 'SS' THEN greatest(0, s + lag) + ds WHEN 'FF' THEN f + lag ELSE s + lag END AS nf FROM p JOIN lnk l ON l.project_id = p.project_id AND l.src = p.seq) q)
SELECT project_id, n AS length, CASE WHEN n = 1 THEN 0.0 ELSE f END AS duration, path FROM p WHERE NOT EXISTS (SELECT 1 FROM lnk l WHERE l.project_id = p.project_id AND l.src = p.seq)"""
)
def path_durations(spark, sf_dir):
    return cpm.path_durations(*schedule(spark, sf_dir))


@query(
    f"""{BASE}, np AS (SELECT project_id, dst, count(*) AS n FROM lnk GROUP BY 1, 2),
r1 AS (SELECT project_id, seq, risk, 1 AS k, risk AS prev, 0.0::DOUBLE AS prev2 FROM act WHERE seq = 1 UNION ALL
 SELECT a.project_id, a.seq, a.risk, a.seq, a.risk + CASE a.seq WHEN 2 THEN r1.prev ELSE (r1.prev + r1.prev2) / 2 END, r1.prev FROM r1 JOIN act a ON a.project_id = r1.project_id AND a.seq = r1.seq + 1)
SELECT r1.project_id, r1.project_id || '-' || seq AS id, round(prev, 9) AS propagated_risk, round(prev * (SELECT count(*) FROM lnk l WHERE l.project_id = r1.project_id AND l.src = r1.seq), 9) AS risk_transmission FROM r1"""
)
def risk_propagation(spark, sf_dir):
    return cpm.risk_propagation(*schedule(spark, sf_dir), places=9)


LENSES = """lens AS (SELECT 'type' AS lens, id, task_type AS g, risk, duration AS total_float FROM act UNION ALL SELECT 'brand', id, p_brand, risk, duration FROM act JOIN part ON p_partkey = part UNION ALL SELECT 'nation', id, n_name, risk, duration FROM act JOIN supplier ON s_suppkey = supplier JOIN nation ON n_nationkey = s_nationkey),
crs AS (SELECT a.lens, l.source, l.target, a.g AS pg, b.g AS sg, b.risk, b.total_float, a.g <> b.g AS x FROM lnk l JOIN lens a ON a.id = l.source JOIN lens b ON b.id = l.target AND a.lens = b.lens)"""


def lens_links(spark, sf_dir):
    """The same links under three lenses; the duration stands in for the float in these queries."""
    a = activities(spark, sf_dir)
    nation = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("supplier"), "n_name")
    wide = a.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_brand"), "part", "left").join(nation, "supplier", "left")
    lenses = F.array(*[F.struct(F.lit(n).alias("lens"), F.col(c).alias("group")) for n, c in (("type", "task_type"), ("brand", "p_brand"), ("nation", "n_name"))])
    nodes = wide.select("project_id", "id", "risk", F.col("duration").alias("total_float"), F.explode(lenses).alias("l")).select("project_id", "l.lens", "id", "l.group", "total_float", "risk")
    return interface.cross_links(nodes, links(a))


@query(f"{BASE}, {LENSES} SELECT lens, count(*) AS links, count_if(x) AS cross_links, avg(x::INT) AS cross_ratio, count(DISTINCT CASE WHEN x THEN sg END) AS groups_in, count(DISTINCT CASE WHEN x THEN pg END) AS groups_out FROM crs GROUP BY 1")
def interface_summary(spark, sf_dir):
    return interface.summary(lens_links(spark, sf_dir))


@query(f"{BASE}, {LENSES} SELECT lens, pg AS pred_group, sg AS succ_group, count(*) AS links, min(total_float) AS min_float, max(risk) AS max_risk FROM crs WHERE x GROUP BY ALL")
def interface_matrix(spark, sf_dir):
    return interface.matrix(lens_links(spark, sf_dir))


HOT = f"""{BASE}, {LENSES}, i AS (SELECT lens, sg AS g, count(*) AS incoming, count(DISTINCT pg) AS distinct_pred, min(total_float) AS min_float, avg(total_float) AS avg_float, max(risk) AS max_risk, avg(risk) AS avg_risk FROM crs WHERE x GROUP BY ALL),
o AS (SELECT lens, pg AS g, count(*) AS outgoing, count(DISTINCT sg) AS distinct_succ, max(risk) AS max_down_risk, avg(risk) AS avg_down_risk FROM crs WHERE x GROUP BY ALL),
h AS (SELECT lens, g, coalesce(incoming, 0) AS incoming, coalesce(distinct_pred, 0) AS distinct_pred, min_float, avg_float, max_risk, avg_risk, coalesce(outgoing, 0) AS outgoing, coalesce(distinct_succ, 0) AS distinct_succ, max_down_risk, avg_down_risk, greatest(max_risk, max_down_risk) AS r FROM i FULL JOIN o USING (lens, g)),
sc AS (SELECT *, 100 * ({' + '.join(f"{w} * coalesce(({c} - min({c}) OVER l) / nullif(max({c}) OVER l - min({c}) OVER l, 0), 0)" for w, c in ((0.35, 'incoming'), (0.2, 'distinct_pred'), (0.25, 'outgoing'), (0.1, 'distinct_succ'), (0.1, 'r')))}) AS score FROM h WINDOW l AS (PARTITION BY lens))"""


@query(f'{HOT} SELECT lens, g AS "group", incoming, distinct_pred, min_float, round(avg_float, 6) AS avg_float, max_risk, round(avg_risk, 6) AS avg_risk, outgoing, distinct_succ, max_down_risk, round(avg_down_risk, 6) AS avg_down_risk, round(score, 6) AS score FROM sc')
def interface_hotspots(spark, sf_dir):
    return rounded(interface.hotspots(lens_links(spark, sf_dir)), 6, "score", "avg_float", "avg_risk", "avg_down_risk")


@query(f'{HOT} SELECT lens, g AS "group", round(score, 6) AS score FROM sc ORDER BY sc.score DESC, lens, g LIMIT 10')
def interface_top_hotspots(spark, sf_dir):
    return rounded(interface.top_hotspots(lens_links(spark, sf_dir), 10).select("lens", "group", "score"), 6, "score")


@query(f'{BASE}, {LENSES}, t AS (SELECT lens, sg AS g, target AS id, max(risk) AS risk, min(total_float) AS total_float FROM crs WHERE x GROUP BY ALL) SELECT lens, g AS "group", id, risk, total_float, rank FROM (SELECT *, row_number() OVER (PARTITION BY lens, g ORDER BY risk DESC NULLS LAST, total_float, id) AS rank FROM t) WHERE rank <= 3')
def interface_samples(spark, sf_dir):
    return interface.samples(lens_links(spark, sf_dir))


EV = f"""{BASE}, st AS (SELECT TIMESTAMP '{STATUS_DATE}' AS sdt),
v AS (SELECT a.*, pct / 100 AS p, sdt, CASE WHEN sdt >= finish THEN 1.0 WHEN sdt > start THEN (epoch(sdt) - epoch(start)) / (epoch(finish) - epoch(start)) ELSE 0.0 END AS share,
 least(1.0, date_diff('day', start::DATE, sdt::DATE) / greatest(1, date_diff('day', start::DATE, finish::DATE))::DOUBLE) AS e FROM act a, st),
v2 AS (SELECT *, CASE WHEN p < 1 AND e > 0 AND p < e THEN least(2.0, greatest(1.0, e / p)) ELSE 1.0 END AS behind FROM v),
s AS (SELECT project_id, sum(duration) AS bac, sum(duration * share) AS bcws, sum(duration * p) AS bcwp, sum(CASE WHEN p = 0 THEN 0 WHEN actual_cost > 0 THEN actual_cost / cost_rate ELSE duration * p * behind END) AS acwp_hours, sum(CASE WHEN p = 0 THEN 0 WHEN actual_cost > 0 THEN actual_cost ELSE duration * p * behind * cost_rate END) AS acwp_cost FROM v2 GROUP BY 1)"""


@query(f"{EV} SELECT project_id, bac, round(bcws, 6) AS bcws, round(bcwp, 6) AS bcwp, round(acwp_hours, 6) AS acwp_hours, round(acwp_cost, 7) AS acwp_cost FROM s")
def evm_scalars(spark, sf_dir):
    s = evm.scalars(activities(spark, sf_dir), STATUS_DATE)
    return rounded(rounded(s, 6, "bcws", "bcwp", "acwp_hours"), 7, "acwp_cost")


EVX = f"""{EV}, m AS (SELECT *, CASE WHEN bcws > 0 THEN bcwp / bcws WHEN bcwp <= 0 THEN 1.0 END AS spi, CASE WHEN acwp_hours > 0 THEN bcwp / acwp_hours WHEN bcwp <= 0 THEN 1.0 END AS cpi, 100 * bcwp / bac AS pc FROM s),
m2 AS (SELECT *, CASE WHEN spi IS NULL THEN 1.0 ELSE greatest(0.05, least(10.0, spi)) END AS sm, CASE WHEN cpi IS NULL THEN 1.0 ELSE greatest(0.05, least(20.0, cpi)) END AS cm FROM m),
m3 AS (SELECT *, bac * pc / 100 / cm AS ac, bac * (1 - pc / 100) AS rest FROM m2)"""


@query(f"{EVX} SELECT project_id, round(bcwp - bcws, 6) AS sv, round(bcwp - acwp_hours, 6) AS cv, round(spi, 9) AS spi, round(cpi, 9) AS cpi, round(sm, 9) AS spi_model, round(cm, 9) AS cpi_model, round(greatest(greatest(ac, bac * 0.8), least(CASE WHEN pc < 10 THEN bac * 1.15 WHEN pc > 90 THEN ac + rest WHEN cm < 0.8 OR cm > 1.2 THEN ac + rest / (cm * sm) ELSE ac + rest / cm END, bac * CASE WHEN pc > 50 THEN 2.5 ELSE 3.0 END)), 5) AS eac FROM m3")
def evm_metrics(spark, sf_dir):
    m = evm.metrics(evm.scalars(activities(spark, sf_dir), STATUS_DATE)).select("project_id", "sv", "cv", "spi", "cpi", "spi_model", "cpi_model", "eac")
    return rounded(rounded(rounded(m, 6, "sv", "cv"), 9, "spi", "cpi", "spi_model", "cpi_model"), 5, "eac")


DW = f"""{EV}, dw AS (SELECT project_id, sum(duration) AS total_hours, sum(duration * CASE WHEN actual_finish <= sdt THEN 1.0 ELSE p END) AS actual_hours, sum(duration * share) AS planned_hours, max(finish) AS pe, any_value(sdt) AS sdt FROM v GROUP BY 1),
dx AS (SELECT *, CASE WHEN planned_hours > 0 THEN actual_hours / planned_hours WHEN actual_hours > 0 THEN 2.0 ELSE 1.0 END AS dw_spi FROM dw)"""


@query(f"{DW} SELECT project_id, total_hours, round(actual_hours, 6) AS actual_hours, round(planned_hours, 6) AS planned_hours, round(dw_spi, 6) AS dw_spi FROM dx")
def evm_duration_weighted(spark, sf_dir):
    return rounded(evm.duration_weighted(activities(spark, sf_dir), STATUS_DATE), 6, "actual_hours", "planned_hours", "dw_spi")


@query(
    f"""{DW}, d AS (SELECT *, greatest(0.5, least(2.0, CASE WHEN dw_spi > 0 THEN greatest(0.5, least(3.0, 1 / dw_spi)) ELSE 1.25 END / 1.25)) AS pd, greatest(0, date_diff('day', sdt::DATE, pe::DATE)) AS lft FROM dx)
SELECT project_id, round(pd, 6) AS performance_delta, round(greatest(0.6, least(2.0, pd)), 6) AS multiplier, greatest(-180, least(365, round_even(lft * greatest(0.6, least(2.0, pd)) - lft, 0)))::INTEGER AS slip_days FROM d"""
)
def evm_delay(spark, sf_dir):
    a = activities(spark, sf_dir)
    return rounded(evm.delay(evm.duration_weighted(a, STATUS_DATE), a, STATUS_DATE), 6, "performance_delta", "multiplier")


@query(f"{BASE} SELECT project_id, id FROM act a WHERE pct > 0 AND NOT EXISTS (SELECT 1 FROM lnk l JOIN act b ON b.id = l.target WHERE l.source = a.id AND b.pct > 0)")
def evm_frontier(spark, sf_dir):
    return evm.frontier(*schedule(spark, sf_dir))


CURVE = f"""{BASE}, dt AS (SELECT project_id, start AS d FROM act UNION SELECT project_id, finish FROM act),
cv AS (SELECT dt.project_id, d, sum(CASE WHEN d >= finish THEN duration WHEN d > start THEN duration * (epoch(d) - epoch(start)) / (epoch(finish) - epoch(start)) ELSE 0 END) AS v FROM dt JOIN act a USING (project_id) GROUP BY 1, 2)"""


@query(f"{CURVE} SELECT project_id, d AS date, round(v, 5) AS planned_hours FROM cv")
def evm_planned_curve(spark, sf_dir):
    return rounded(evm.planned_curve(activities(spark, sf_dir)), 5, "planned_hours")


@query(f"{CURVE} SELECT project_id, d AS date, round(v, 4) AS cumulative, round(v - coalesce(lag(v) OVER (PARTITION BY project_id ORDER BY d), 0), 4) AS period FROM cv")
def evm_period_curve(spark, sf_dir):
    curve = evm.monotone(evm.planned_curve(activities(spark, sf_dir)), "planned_hours")
    return rounded(curve.select("project_id", "date", "cumulative", "period"), 4, "cumulative", "period")


@query(
    f"""{CURVE}, b AS (SELECT project_id, min(start)::DATE AS ps, max(finish)::DATE AS pf, sum(duration * pct / 100) AS ev, sum(duration) AS pv FROM act GROUP BY 1),
sg AS (SELECT *, lead(d) OVER w AS d1, lead(v) OVER w AS v1 FROM cv WINDOW w AS (PARTITION BY project_id ORDER BY d)),
hit AS (SELECT project_id, arg_min(date_diff('day', ps, d::DATE) + CASE WHEN v1 > v THEN (ev - v) / (v1 - v) ELSE 0 END * date_diff('day', d::DATE, d1::DATE), d) AS inner_days FROM sg JOIN b USING (project_id) WHERE d1 IS NOT NULL AND v <= ev AND ev <= v1 GROUP BY 1),
o AS (SELECT b.*, greatest(date_diff('day', ps, pf), 0)::DOUBLE AS pd, greatest(date_diff('day', ps, DATE '{STATUS_DATE[:10]}'), 0)::DOUBLE AS sdt, inner_days FROM b LEFT JOIN hit USING (project_id)),
o2 AS (SELECT *, CASE WHEN ev <= 0 THEN 0.0 WHEN ev >= pv - 1e-9 THEN pd ELSE coalesce(inner_days, 0) END AS es FROM o),
o3 AS (SELECT *, CASE WHEN sdt > 0 THEN greatest(0.05, least(10.0, es / sdt)) ELSE 1.0 END AS m FROM o2)
SELECT project_id, round(es, 7) AS es, sdt AS at, pd, round(CASE WHEN sdt > 0 THEN es / sdt WHEN es <= 0 THEN 1.0 END, 9) AS spi_t, round(m, 9) AS spi_t_model, round(CASE WHEN pd > 0 THEN greatest(sdt, pd / m) ELSE 0.0 END, 7) AS teac_days FROM o3"""
)
def evm_earned_schedule(spark, sf_dir):
    e = evm.earned_schedule(activities(spark, sf_dir), STATUS_DATE)
    return rounded(rounded(e, 7, "es", "teac_days"), 9, "spi_t", "spi_t_model")
