"""Queries: outcomes, communities, path corpora, portfolio summaries and streams; with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.functions import reference_classes
from slackline.operators import community, cpm, evm, outcomes, paths
from slackline.plans.core_queries import BASE, PASSES, SQL as CORE_SQL, rounded, schedule
from slackline.plans.more_queries import MCF_FULL, summary_full
from slackline.sources.star import ACT_SQL, STATUS_DATE, activities, table
from slackline.streaming import progress

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


OUT_SQL = """oc AS (SELECT o_orderkey AS project_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'rail' WHEN '2-HIGH' THEN 'roads' WHEN '3-MEDIUM' THEN 'mining' ELSE 'tunnels' END AS reference_class, o_orderdate + to_days((o_custkey % 50)::INTEGER) AS submitted_at,
 o_orderdate + to_days(30) AS baseline_finish, o_orderdate + to_days((20 + o_custkey % 60)::INTEGER) AS p80_finish, f AS actual_finish FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def order_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, done = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("actual_finish"))
    p = F.col("o_orderpriority")
    cls = F.when(p == "1-URGENT", "rail").when(p == "2-HIGH", "roads").when(p == "3-MEDIUM", "mining").otherwise("tunnels")
    later = lambda days: F.col("o_orderdate") + F.make_dt_interval(days)
    k = F.col("o_custkey").cast("int")
    rows = o.join(done, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("project_id"), cls.alias("reference_class"), later(k % 50).alias("submitted_at"), later(F.lit(30)).alias("baseline_finish"), later(20 + k % 60).alias("p80_finish"), "actual_finish")


@query(
    f"""WITH {OUT_SQL}, r AS (SELECT reference_class, greatest(0, (epoch(actual_finish) - epoch(baseline_finish)) / 86400) / ((epoch(p80_finish) - epoch(baseline_finish)) / 86400) AS ratio FROM oc WHERE p80_finish > baseline_finish), v AS (SELECT reference_class, list_sort(list(ratio)) AS v, avg(ratio) AS mean FROM r GROUP BY 1)
SELECT reference_class, len(v) AS n, v[floor(0.5 * (len(v) - 1))::INT + 1] AS p50, v[floor(0.8 * (len(v) - 1))::INT + 1] AS p80, CASE WHEN len(v) >= 5 THEN v[floor(0.95 * (len(v) - 1))::INT + 1] END AS p95, round(mean, 8) AS mean, CASE WHEN mean > 1.3 THEN 'tighten' WHEN mean < 0.7 THEN 'relax' ELSE 'keep' END AS advice FROM v"""
)
def outcome_calibration(spark, sf_dir):
    return rounded(outcomes.calibration(order_outcomes(spark, sf_dir)), 8, "mean")


@query(f"WITH {OUT_SQL} SELECT reference_class, project_id, submitted_at, actual_finish FROM oc WHERE submitted_at >= TIMESTAMP '2001-01-01' - INTERVAL 1825 DAY")
def outcome_latest(spark, sf_dir):
    twice = order_outcomes(spark, sf_dir)
    older = twice.withColumn("submitted_at", F.col("submitted_at") - F.make_dt_interval(F.lit(9)))  # an earlier record of each
    return outcomes.latest(twice.unionByName(older), "2001-01-01 00:00:00").select("reference_class", "project_id", "submitted_at", "actual_finish")


@query("SELECT " + ", ".join(f"x.{c.split()[0]}" for c in reference_classes.SCHEMA.split(", ")) + " FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, bool) else f"{v}::DOUBLE" for v in (n, f, o, *a, t, *p, c, m, fat, fin)) + ")" for n, f, o, a, t, p, c, m, fat, fin in reference_classes.CLASSES) + ") x(" + ", ".join(c.split()[0] for c in reference_classes.SCHEMA.split(", ")) + ")")
def reference_class_table(spark, sf_dir):
    return reference_classes.table(spark)


def calibrated(s: DataFrame) -> DataFrame:
    named = F.when(F.col("project_id") % 3 == 0, "Civil").when(F.col("project_id") % 3 == 1, "it software")
    s = s.withColumn("reference_class", reference_classes.resolved(named))
    f = reference_classes.table(s.sparkSession).select(F.col("name").alias("reference_class"), *[F.col(f"p{q}").alias(f"f{q}") for q in (50, 80, 95)])
    rows = s.join(F.broadcast(f), "reference_class", "left")  # 19 rows
    out = rows.select("project_id", "reference_class", *[reference_classes.calibrated(F.col(f"p{q}"), F.col("expected"), F.col(f"f{q}")).alias(f"p{q}_calibrated") for q in (50, 80, 95)])
    return rounded(out, 6, "p50_calibrated", "p80_calibrated", "p95_calibrated")


@query(f"{MCF_FULL}, c AS (SELECT project_id, expected, p50, p80, p95, CASE project_id % 3 WHEN 0 THEN 'rail' WHEN 1 THEN 'it_software' END AS rc FROM sm) SELECT project_id, rc AS reference_class, " + ", ".join(f"round(expected + (p{q} - expected) * CASE rc WHEN 'rail' THEN {a} WHEN 'it_software' THEN {b} ELSE 1 END, 6) AS p{q}_calibrated" for q, a, b in ((50, 1.15, 1.15), (80, 1.45, 1.50), (95, 1.95, 2.50))) + " FROM c")
def mc_calibrated(spark, sf_dir):
    return calibrated(summary_full(spark, sf_dir))


@query()
def mc_calibrated_full(spark, sf_dir):
    return mc_calibrated(spark, sf_dir)


def by_type(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a, e = schedule(spark, sf_dir)
    return a.select("project_id", "id", F.col("task_type").alias("community")), e


CM = f"{BASE}, mb AS (SELECT project_id, id, task_type AS c FROM act), le AS (SELECT l.project_id, a.c AS ca, b.c AS cb, (a.c = b.c)::INTEGER AS same, source, target FROM lnk l JOIN mb a ON a.id = l.source JOIN mb b ON b.id = l.target), sz AS (SELECT project_id, c, count(*) AS size FROM mb GROUP BY 1, 2), ie AS (SELECT project_id, ca AS c, count(*) AS k FROM le WHERE same > 0 GROUP BY 1, 2), be AS (SELECT project_id, c, count(*) AS k FROM (SELECT project_id, ca AS c FROM le WHERE same < 1 UNION ALL SELECT project_id, cb FROM le WHERE same < 1) GROUP BY 1, 2)"


@query(f"{CM} SELECT project_id, c AS community, size, coalesce(ie.k, 0) AS inner_links, coalesce(be.k, 0) AS boundary_links, CASE WHEN size > 1 THEN 2 * coalesce(ie.k, 0) / (size * (size - 1))::DOUBLE ELSE 0 END AS density FROM sz LEFT JOIN ie USING (project_id, c) LEFT JOIN be USING (project_id, c)")
def group_density(spark, sf_dir):
    return community.metrics(*by_type(spark, sf_dir))


@query(f"{CM}, dg AS (SELECT project_id, c, count(*) AS d FROM (SELECT project_id, ca AS c FROM le UNION ALL SELECT project_id, cb FROM le) GROUP BY 1, 2), m AS (SELECT project_id, count(*) AS m FROM lnk GROUP BY 1) SELECT project_id, round(sum(coalesce(k, 0) / m::DOUBLE - (d / (2.0 * m)) ** 2), 9) + 0.0 AS modularity FROM dg JOIN m USING (project_id) LEFT JOIN ie USING (project_id, c) GROUP BY 1")
def group_modularity(spark, sf_dir):
    return rounded(community.modularity(*by_type(spark, sf_dir)), 9, "modularity")


@query(f"{CM}, nb AS (SELECT id, count(*) AS k FROM (SELECT unnest([source, target]) AS id FROM le WHERE same > 0) GROUP BY id) SELECT project_id, id, round(CASE WHEN size > 1 THEN coalesce(k, 0) / (size - 1)::DOUBLE ELSE 0 END, 4) AS coupling FROM mb JOIN sz USING (project_id, c) LEFT JOIN nb USING (id)")
def coupling_density(spark, sf_dir):
    return community.coupling(*by_type(spark, sf_dir))


@query()
def louvain_communities(spark, sf_dir):
    return community.communities(*schedule(spark, sf_dir))


PATHS = CORE_SQL["path_durations"]
PATH_CTE = PATHS[: PATHS.rindex("SELECT project_id, n AS length")] + ", pt AS (" + PATHS[PATHS.rindex("SELECT project_id, n AS length") :] + ")"


@query(f"{PATH_CTE} SELECT project_id, path, duration, array_to_string(x[1:2], '>') AS branch, array_to_string(x[greatest(1, len(x) // 2):greatest(1, len(x) // 2) + 1], '>') AS midpoint, len(x)::INTEGER - 1 AS hops FROM (SELECT *, string_split(path, '>') AS x FROM pt)")
def path_signatures(spark, sf_dir):
    return paths.signatures(cpm.path_durations(*schedule(spark, sf_dir)))


@query(f"{PATH_CTE}, q AS (SELECT project_id, quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.75) AS q3, max(duration) AS longest FROM pt GROUP BY 1), z AS (SELECT pt.project_id, path, duration, duration > q3 + 1.5 * (q3 - q1) AS beyond_fence, duration >= 0.8 * longest AS near_longest FROM pt JOIN q USING (project_id)) SELECT * FROM z WHERE beyond_fence OR near_longest")
def outlier_paths(spark, sf_dir):
    return paths.outliers(cpm.path_durations(*schedule(spark, sf_dir)))


@query(f"{PATH_CTE}, x AS (SELECT project_id, string_split(path, '>')[2:-2] AS x FROM pt), y AS (SELECT project_id, array_to_string(x[i:i + k - 1], '>') AS part FROM x, range(1, 20) r(i), (VALUES (3), (4)) v(k) WHERE i + k - 1 <= len(x)) SELECT project_id, part, count(*) AS support FROM y GROUP BY 1, 2 HAVING count(*) >= 2")
def recurring_subpaths(spark, sf_dir):
    return paths.recurring(cpm.path_durations(*schedule(spark, sf_dir)))


@query(f"{PATH_CTE}, k AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY duration DESC, path) AS k, string_split(path, '>') AS x FROM pt), t AS (SELECT project_id, k, list_transform(range(1, greatest(2, len(x))), lambda i: x[i] || '>' || coalesce(x[i + 1], '')) AS e FROM k WHERE k <= 64) SELECT a.project_id, a.k, b.k AS k2, len(list_intersect(a.e, b.e)) / len(list_distinct(list_concat(a.e, b.e)))::DOUBLE AS jaccard FROM t a JOIN t b ON a.project_id = b.project_id AND a.k < b.k")
def path_overlaps(spark, sf_dir):
    return paths.overlaps(cpm.path_durations(*schedule(spark, sf_dir)))


@query(f"{PASSES}, sl AS (SELECT project_id, seq, CASE seq WHEN 1 THEN 40.0::DOUBLE ELSE 0.0 END AS es FROM act UNION SELECT f.project_id, l.dst, greatest(0, f.es + l.w) FROM sl f JOIN lnk l ON l.project_id = f.project_id AND l.src = f.seq), s2 AS (SELECT project_id, seq, max(es) AS es FROM sl GROUP BY 1, 2) SELECT d.project_id, id, s2.es - d.es AS slip, s2.es - d.es <= tf + 1e-9 AS absorbed FROM dates d JOIN s2 USING (project_id, seq)")
def cascade_slip(spark, sf_dir):
    return paths.cascade(*schedule(spark, sf_dir), hours=40.0)


@query(
    f"""{BASE}, fr AS (SELECT project_id, seq FROM act a WHERE pct > 0 AND NOT EXISTS (SELECT 1 FROM lnk l JOIN act b ON b.id = l.target WHERE l.source = a.id AND b.pct > 0)), h AS (SELECT project_id, seq, 0 AS hops FROM fr UNION SELECT h.project_id, l.dst, h.hops + 1 FROM h JOIN lnk l ON l.project_id = h.project_id AND l.src = h.seq)
SELECT project_id, project_id || '-' || seq AS id, min(hops) AS hops, round(power(0.85, min(hops)), 9) AS decay FROM h GROUP BY project_id, seq"""
)
def frontier_decay(spark, sf_dir):
    a, e = schedule(spark, sf_dir)
    f = evm.frontier(a, e).withColumn("frontier", F.lit(True))
    marked = a.select("project_id", "seq", "id").join(f, ["project_id", "id"], "left").fillna(False, ["frontier"])
    return rounded(paths.frontier_decay(marked, e), 9, "decay")


@query(f"WITH {ACT_SQL} SELECT task_type, x::DOUBLE AS x, round(sum(exp(-0.5 * ((x - duration) / 4.0) ** 2)) / (count(*) * 4.0 * sqrt(2 * pi())), 9) AS density FROM act, range(0, 55, 5) r(x) GROUP BY 1, 2")
def duration_density(spark, sf_dir):
    grid = F.broadcast(spark.range(0, 55, 5).select(F.col("id").cast("double").alias("x")))  # eleven points
    a = activities(spark, sf_dir).groupBy("task_type", "duration").agg(F.count("*").alias("n"))
    k = F.exp(-0.5 * F.pow((F.col("x") - F.col("duration")) / 4.0, 2)) * F.col("n")
    return rounded(a.crossJoin(grid).groupBy("task_type", "x").agg((F.sum(k) / (F.sum("n") * 4.0 * F.sqrt(2 * F.pi()))).alias("density")), 9, "density")


@query(f"WITH {ACT_SQL}, c AS (SELECT id, CASE WHEN regexp_matches(p_name, 'ring|gear') THEN 'mechanical' WHEN regexp_matches(p_name, 'widget|bolt') THEN 'hardware' ELSE 'other' END AS category FROM act JOIN part ON p_partkey = part) SELECT category, count(*) AS tasks, sum(duration) AS hours, round(sum(duration * pct / 100) / sum(duration), 8) AS progress, round(avg(risk), 8) AS mean_risk, round(sum(duration * cost_rate), 2) AS planned_cost FROM act JOIN c USING (id) GROUP BY 1")
def category_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.when(F.col("p_name").rlike("ring|gear"), "mechanical").when(F.col("p_name").rlike("widget|bolt"), "hardware").otherwise("other").alias("category"))
    g = activities(spark, sf_dir).join(p, "part").groupBy("category")
    out = g.agg(F.count("*").alias("tasks"), F.sum("duration").alias("hours"), (F.sum(F.col("duration") * F.col("pct") / 100) / F.sum("duration")).alias("progress"), F.avg("risk").alias("mean_risk"), F.sum(F.col("duration") * F.col("cost_rate")).alias("planned_cost"))
    return rounded(rounded(out, 8, "progress", "mean_risk"), 2, "planned_cost")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; a temporary one only where none is set, and only on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="slackline-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_windows(spark, sf_dir):
    s = progress.windowed(progress.events(spark, f"{sf_dir}/events.parqu*t"))
    out = progress.run_once(s, scratch(spark, "stream"), scratch(spark, "stream-state"))
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), 6, "total")


@query("SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_latest(spark, sf_dir):
    s = progress.events(spark, f"{sf_dir}/events.parqu*t")
    out = progress.upsert_latest(s, "user_id", scratch(spark, "latest"), scratch(spark, "latest-state"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
