"""Working calendars as a dimension of days, and advancing dates by working hours on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first_day: str, days: int, working_days: tuple[int, ...] = (1, 2, 3, 4, 5), holidays: tuple[str, ...] = (), hours_per_day: float = 8.0) -> DataFrame:
    """(day_idx, day, is_weekday, is_working, days_before, hours_before, next_weekday, next_working).

    The horizon is bounded (some thousand days), so the windows over all days are small. next_* point to the
    day itself or the next such day, at the end of the horizon to its last day.
    """
    d = spark.range(days).select(F.col("id").cast("int").alias("day_idx"), F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int")).alias("day"))
    d = d.withColumn("is_weekday", (F.weekday("day") + 1).isin(*working_days))
    d = d.withColumn("is_working", F.col("is_weekday") & ~F.col("day").isin(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.col("is_weekday"))
    w = Window.orderBy("day_idx")
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("days_before", F.coalesce(F.sum(F.col("is_working").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    nxt = lambda c: F.coalesce(F.min(F.when(F.col(c), F.col("day_idx"))).over(ahead), F.lit(days - 1))
    return d.withColumn("hours_before", F.col("days_before") * F.lit(hours_per_day)).withColumn("next_weekday", nxt("is_weekday")).withColumn("next_working", nxt("is_working"))


def advance(rows: DataFrame, cal: DataFrame, start: str, hours: str, first_day: str, days: int, hours_per_day: float = 8.0) -> DataFrame:
    """rows with finished: start advanced by working hours, whole days on the calendar and the rest by the clock.

    No work leaves the start as it is. A start is moved to a working day (with less than one day of work only
    to a weekday); the rest of the hours may run over midnight, and if that lands on a day off, the next
    working day is taken at the same time of day. Beyond the horizon its last day counts. The calendar is broadcast:
    a row for each day of the horizon.
    """
    origin = F.to_timestamp_ntz(F.lit(first_day + " 00:00:00"))
    last = days - 1
    clipped = F.greatest(F.timestamp_diff("SECOND", origin, F.col(start)), F.lit(0))
    r = rows.withColumn("_h", F.least(F.col(hours), F.lit(100_000.0))).withColumn("_s", F.least(clipped, F.lit(days * 86400 - 1)))
    r = r.withColumn("_day", F.floor(F.col("_s") / 86400).cast("int")).withColumn("_clock", F.col("_s") % 86400).withColumn("_whole", F.floor(F.col("_h") / hours_per_day).cast("int"))
    by_day = F.broadcast(cal.select(F.col("day_idx").alias("_day"), "next_weekday", "next_working"))
    r = r.join(by_day, "_day").withColumn("_from", F.when(F.col("_whole") == 0, F.col("next_weekday")).otherwise(F.col("next_working"))).drop("next_weekday", "next_working")
    before = F.broadcast(cal.select(F.col("day_idx").alias("_from"), F.col("days_before").alias("_n")))
    most = cal.agg(F.max(F.col("days_before") + F.col("is_working").cast("int")).alias("_most"))
    r = r.join(before, "_from").crossJoin(F.broadcast(most)).withColumn("_target", F.least(F.col("_n") + F.col("_whole"), F.col("_most")))
    # the last day with that many working days before it
    arrive = F.broadcast(cal.groupBy(F.col("days_before").alias("_target")).agg(F.max("day_idx").alias("_arrive")))
    r = r.join(arrive, "_target", "left").withColumn("_to", F.when(F.col("_whole") == 0, F.col("_from")).otherwise(F.coalesce("_arrive", F.lit(last))))
    rest = (F.col("_h") - F.col("_whole") * F.lit(hours_per_day)) * 3600
    r = r.withColumn("_f", (F.col("_to") * 86400 + F.col("_clock") + rest).cast("double")).withColumn("_fd", F.least(F.floor(F.col("_f") / 86400), F.lit(last)).cast("int"))
    settle = F.broadcast(cal.select(F.col("day_idx").alias("_fd"), F.col("next_working").alias("_fn")))
    r = r.join(settle, "_fd").withColumn("_f", F.col("_f") + (F.col("_fn") - F.col("_fd")) * 86400)
    out = origin + F.make_dt_interval(secs=F.col("_f").cast("decimal(18,6)"))
    return r.withColumn("finished", F.when(F.col(hours) <= 0, F.col(start)).otherwise(out)).drop("_h", "_s", "_day", "_clock", "_whole", "_from", "_n", "_most", "_target", "_arrive", "_to", "_f", "_fd", "_fn")


def horizon_days(hours: float, hours_per_day: float = 8.0, cap: float | None = None, least: int = 30, most: int = 3650) -> int:
    """Days that a calendar needs for so much work, with room for multipliers up to the cap."""
    if hours <= 0 or hours_per_day <= 0:
        return least
    factor = max(6.0, 1.5 * cap) if cap and cap > 0 else 6.0
    return int(min(max(-(-hours / hours_per_day * factor // 1), least), most))


def add_days(rows: DataFrame, cal: DataFrame, start: str, hours: str, first_day: str, out: str = "finished", hours_per_day: float = 8.0, back: bool = False) -> DataFrame:
    """rows with the start moved by whole working days: as many as the hours begin, at the same time of day.

    The other algebra of the two: no rest by the clock, and the start itself need not be a working day.
    """
    n = F.ceil(F.col(hours) / hours_per_day).cast("int")
    d = F.broadcast(cal.select(F.col("day").alias("_d"), F.col("days_before").alias("_b"), F.col("is_working").cast("int").alias("_w")))
    r = rows.join(d, F.to_date(F.col(start)) == F.col("_d"), "left").withColumn("_k", F.when(F.lit(back), F.col("_b") - n + 1).otherwise(F.col("_b") + F.col("_w") + n))
    # the k-th working day of the calendar
    kth = F.broadcast(cal.where("is_working").select((F.col("days_before") + 1).alias("_k"), F.col("day").alias("_to")))
    r = r.join(kth, "_k", "left")
    return r.withColumn(out, F.when(F.col(hours) > 0, F.col(start) + F.make_dt_interval(F.datediff("_to", F.to_date(F.col(start))))).otherwise(F.col(start))).drop("_d", "_b", "_w", "_k", "_to")


def end_dates(rows: DataFrame, cal: DataFrame, start: str, hours: str, first_day: str, days: int, hours_per_day: float = 8.0) -> DataFrame:
    """rows with finished (as advance() gives it) and horizon_exhausted: the work reaches the calendar's last working day, so the
    date is a lower bound. Rows whose start lies outside the calendar are clipped to its first or last day."""
    origin = F.to_timestamp_ntz(F.lit(first_day + " 00:00:00"))
    day = F.least(F.greatest(F.datediff(F.col(start), origin), F.lit(0)), F.lit(days - 1))
    d = F.broadcast(cal.select(F.col("day_idx").alias("_d"), F.col("days_before").alias("_done")))  # a row for each day
    most = cal.agg(F.max(F.col("days_before") + F.col("is_working").cast("int")).alias("_all"))
    r = advance(rows, cal, start, hours, first_day, days, hours_per_day).withColumn("_at", day)
    r = r.join(d, F.col("_at") == F.col("_d")).crossJoin(F.broadcast(most))
    spent = F.col("_done") + F.floor(F.greatest(F.col(hours), F.lit(0.0)) / hours_per_day)
    return r.withColumn("horizon_exhausted", spent >= F.col("_all")).drop("_at", "_d", "_done", "_all")


def slack_dates(cpm: DataFrame, starts: DataFrame, cal: DataFrame, first_day: str, days: int, hours_per_day: float = 8.0) -> DataFrame:
    """(project_id, id, es_date, ef_date, ls_date, lf_date, slack_days): the four times of cpm() in working hours as dates from the project's
    start (project_id, project_start), and the days from early to late finish.

    The four times of an activity are advanced as rows of their own, by one set of broadcast lookups, and meet again by activity.
    """
    names = ("es", "ef", "ls", "lf")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("which"), F.greatest(F.col(n), F.lit(0.0)).alias("hours")) for n in names])).alias("t")
    r = cpm.join(starts, "project_id").select("project_id", "id", "project_start", each).select("project_id", "id", "project_start", "t.*")
    r = advance(r, cal, "project_start", "hours", first_day, days, hours_per_day)
    out = r.groupBy("project_id", "id").agg(*[F.max(F.when(F.col("which") == n, F.col("finished"))).alias(f"{n}_date") for n in names])
    return out.withColumn("slack_days", F.datediff("lf_date", "ef_date"))
