"""Earned value: scalars, indices, estimates, earned schedule and curves, keyed by project."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from slackline.functions.units import clamp
from slackline.plans.grouped import graph_apply, project_apply

from .cpm import acyclic, by_level

MIN_CPI, MAX_CPI, MIN_SPI, MAX_SPI = 0.05, 20.0, 0.05, 10.0


def seconds(t: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), t) / F.lit(1e6)


def planned_share(start: Column, finish: Column, at: Column) -> Column:
    """Share of a window passed: linear, all at its end; an empty window counts wholly at its finish."""
    s, f, d = seconds(start), seconds(finish), seconds(at)
    return F.when(d >= f, 1.0).when(d > s, (d - s) / (f - s)).otherwise(0.0)


def sums(rows: DataFrame, **values: Column) -> DataFrame:
    """Sums by project. With a column row they are added in its order, so their last digits (which decide comparisons and ties of
    rounding) don't depend on how rows are spread over tasks."""
    if "row" not in rows.columns:
        return rows.groupBy("project_id").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    w = Window.partitionBy("project_id").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = rows.select("project_id", "row", *[v.alias(n) for n, v in values.items()])
    return each.select("project_id", *[F.sum(n).over(w).alias(n) for n in values]).groupBy("project_id").agg(*[F.max(n).alias(n) for n in values])


def scalars(acts: DataFrame, status: str, default_rate: float = 1.0) -> DataFrame:
    """BAC, BCWS, BCWP, ACWP (hours and cost) for each project at the status date.

    Activities without duration count nowhere; without dates not in BCWS. Actual cost is taken where given,
    else imputed from progress, up to doubled if that is behind the linear plan.
    """
    at = F.to_timestamp_ntz(F.lit(status))
    h, p = F.col("duration"), F.col("pct") / 100
    begun = F.coalesce("actual_start", "start")
    planned_days = F.greatest(F.lit(1), F.coalesce(F.datediff("finish", begun), F.lit(1)))
    expected = F.least(F.lit(1.0), F.datediff(at, begun) / planned_days)
    behind = F.when((p < 1) & (expected > 0) & (p < expected), clamp(expected / p, 1.0, 2.0)).otherwise(1.0)
    rate = F.when(F.col("cost_rate") > 0, F.col("cost_rate")).otherwise(default_rate)
    given = F.col("actual_cost") > 0
    hours = F.when(p == 0, 0.0).when(given, F.col("actual_cost") / rate).when(begun.isNotNull(), h * p * behind).otherwise(0.0)
    cost = F.when(p == 0, 0.0).when(given, F.col("actual_cost")).when(begun.isNotNull(), h * p * behind * rate).otherwise(0.0)
    dated = F.col("start").isNotNull() & F.col("finish").isNotNull()
    planned = F.when(dated, h * planned_share(F.col("start"), F.col("finish"), at)).otherwise(0.0)
    return sums(acts.where(h > 0), bac=h, bcws=planned, bcwp=h * p, acwp_hours=hours, acwp_cost=cost)


def metrics(s: DataFrame) -> DataFrame:
    """SV, CV, SPI, CPI (null stands for infinity) with bounded ones, and EAC by the state of completion."""
    spi = F.when(F.col("bcws") > 0, F.col("bcwp") / F.col("bcws")).when(F.col("bcwp") <= 0, 1.0)
    cpi = F.when(F.col("acwp_hours") > 0, F.col("bcwp") / F.col("acwp_hours")).when(F.col("bcwp") <= 0, 1.0)
    out = s.withColumn("sv", F.col("bcwp") - F.col("bcws")).withColumn("cv", F.col("bcwp") - F.col("acwp_hours")).withColumn("spi", spi).withColumn("cpi", cpi)
    out = out.withColumn("spi_model", F.when(F.col("spi").isNull(), 1.0).otherwise(clamp(F.col("spi"), MIN_SPI, MAX_SPI)))
    out = out.withColumn("cpi_model", F.when(F.col("cpi").isNull(), 1.0).otherwise(clamp(F.col("cpi"), MIN_CPI, MAX_CPI)))
    return out.withColumn("eac", eac(F.col("bac"), F.col("cpi_model"), F.col("spi_model"), 100 * F.col("bcwp") / F.col("bac")))


def eac(bac: Column, cpi: Column, spi: Column, pct: Column) -> Column:
    ac = bac * pct / 100 / cpi
    rest = bac * (1 - pct / 100)
    raw = F.when(pct < 10, bac * 1.15).when(pct > 90, ac + rest).when((cpi < 0.8) | (cpi > 1.2), ac + rest / (cpi * spi)).otherwise(ac + rest / cpi)
    low, high = F.greatest(ac, bac * 0.8), bac * F.when(pct > 50, 2.5).otherwise(3.0)
    return F.when(bac > 0, F.greatest(low, F.least(raw, high))).otherwise(0.0)


def duration_weighted(acts: DataFrame, status: str) -> DataFrame:
    """Progress by planned hours: what is done against what the plan says; finished work counts wholly."""
    at = F.to_timestamp_ntz(F.lit(status))
    h = F.col("duration")
    p = F.when(F.col("actual_finish") <= at, 1.0).otherwise(F.col("pct") / 100)
    dated = F.col("start").isNotNull() & F.col("finish").isNotNull()
    s = sums(acts.where(h > 0), total_hours=h, actual_hours=h * p, planned_hours=F.when(dated, h * planned_share(F.col("start"), F.col("finish"), at)).otherwise(0.0))
    spi = F.when(F.col("planned_hours") > 0, F.col("actual_hours") / F.col("planned_hours")).when(F.col("actual_hours") > 0, 2.0).otherwise(1.0)
    return s.withColumn("dw_spi", spi)


def delay(dw: DataFrame, acts: DataFrame, status: str, sector_overrun: float = 0.25) -> DataFrame:
    """Schedule multiplier and slip in days from duration-weighted progress and the sector's overrun."""
    end = acts.groupBy("project_id").agg(F.max("finish").alias("planned_end"))
    actual = F.when(F.col("dw_spi") > 0, clamp(1 / F.col("dw_spi"), 0.5, 3.0)).otherwise(1 + sector_overrun)
    rows = dw.join(end, "project_id").withColumn("performance_delta", clamp(actual / (1 + sector_overrun), 0.5, 2.0))
    rows = rows.withColumn("multiplier", clamp(F.col("performance_delta"), 0.6, 2.0))
    left = F.greatest(F.lit(0), F.datediff("planned_end", F.to_timestamp_ntz(F.lit(status))))
    slip = clamp(F.bround(left * F.col("multiplier") - left).cast("double"), -180, 365)
    return rows.select("project_id", "performance_delta", "multiplier", slip.cast("int").alias("slip_days"))


def frontier(acts: DataFrame, links: DataFrame) -> DataFrame:
    """Activities in progress none of whose successors is."""
    moving = acts.where((F.col("duration") != 0) & (F.col("actual_start").isNotNull() | (F.col("pct") > 0))).select("project_id", "id")
    any_moving = acts.where(F.col("actual_start").isNotNull() | (F.col("pct") > 0)).select("project_id", F.col("id").alias("target"))
    led = links.join(any_moving, ["project_id", "target"], "left_semi").select("project_id", F.col("source").alias("id"))
    return moving.join(led, ["project_id", "id"], "left_anti")


def planned_curve(acts: DataFrame) -> DataFrame:
    """Cumulative planned hours at each of a project's own start and finish dates, as a sweep.

    Every activity adds its rate at its start; at its finish it takes it away again and adds its hours, so finished work
    counts exactly, and running sums of slopes only what is open. Activities never meet each date.
    """
    dated = acts.where("duration > 0 and start is not null and finish is not null")
    # times from the project's own start, for exact sums
    dated = dated.withColumn("_first", F.min("start").over(Window.partitionBy("project_id")))
    x = lambda c: seconds(F.col(c)) - seconds(F.col("_first"))
    rate = F.col("duration") / (seconds(F.col("finish")) - seconds(F.col("start")))
    names = ("t", "x", "slope", "rise", "open", "step")
    event = lambda at, *v: F.struct(*[c.alias(n) for n, c in zip(names, (F.col(at), x(at), *v))])
    zero, none = F.lit(0.0), F.lit(0)
    both = F.array(event("start", rate, rate * x("start"), F.lit(1), zero), event("finish", -rate, -(rate * x("start")), F.lit(-1), F.col("duration")))
    both = F.when(F.col("finish") > F.col("start"), both).otherwise(F.array(event("start", zero, zero, none, F.col("duration"))))
    e = dated.select("project_id", F.explode(both).alias("e")).groupBy("project_id", F.col("e.t").alias("t")).agg(F.max("e.x").alias("x"), *[F.sum(f"e.{n}").alias(n) for n in names[2:]])
    w = Window.partitionBy("project_id").orderBy("t")
    run = {n: F.sum(n).over(w) for n in names[2:]}
    ahead = F.when(run["open"] > 0, run["slope"] * F.col("x") - run["rise"]).otherwise(0.0)
    return e.select("project_id", F.col("t").alias("date"), (run["step"] + ahead).alias("planned_hours"))


def monotone(curve: DataFrame, value: str) -> DataFrame:
    """Running maximum and first differences of a curve."""
    w = Window.partitionBy("project_id").orderBy("date")
    out = curve.withColumn("cumulative", F.max(value).over(w))
    return out.withColumn("period", F.col("cumulative") - F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)))


def earned_schedule(acts: DataFrame, status: str) -> DataFrame:
    """Earned schedule in days, actual time, planned duration, SPI(t) and the time estimate at completion."""
    curve = planned_curve(acts)
    w = Window.partitionBy("project_id").orderBy("date")
    seg = curve.withColumn("d1", F.lead("date").over(w)).withColumn("v1", F.lead("planned_hours").over(w))
    base = acts.groupBy("project_id").agg(F.to_date(F.min("start")).alias("ps"), F.to_date(F.max("finish")).alias("pf"))
    base = base.join(sums(acts, ev=F.col("duration") * F.col("pct") / 100, pv=F.col("duration")), "project_id")
    hit = seg.join(base.select("project_id", "ev", "ps"), "project_id").where("d1 is not null and planned_hours <= ev and ev <= v1")
    days = F.datediff("date", "ps") + F.when(F.col("v1") > F.col("planned_hours"), (F.col("ev") - F.col("planned_hours")) / (F.col("v1") - F.col("planned_hours"))).otherwise(0.0) * F.datediff("d1", "date")
    hit = hit.groupBy("project_id").agg(F.min_by(days, "date").alias("inner_days"))
    out = base.join(hit, "project_id", "left").withColumn("pd", F.greatest(F.datediff("pf", "ps"), F.lit(0)).cast("double")).withColumn("at", F.greatest(F.datediff(F.to_date(F.lit(status)), "ps"), F.lit(0)).cast("double"))
    out = out.withColumn("es", F.when(F.col("ev") <= 0, 0.0).when(F.col("ev") >= F.col("pv") - 1e-9, F.col("pd")).otherwise(F.coalesce("inner_days", F.lit(0.0))))
    spi_t = F.when(F.col("at") > 0, F.col("es") / F.col("at")).when(F.col("es") <= 0, 1.0)
    model = F.when(F.col("at") > 0, clamp(F.col("es") / F.col("at"), MIN_SPI, MAX_SPI)).otherwise(1.0)
    out = out.withColumn("spi_t", spi_t).withColumn("spi_t_model", model)
    teac = F.when(F.col("pd") > 0, F.greatest(F.col("at"), F.col("pd") / F.col("spi_t_model"))).otherwise(0.0)
    return out.select("project_id", "es", "at", "pd", "spi_t", "spi_t_model", teac.alias("teac_days"))


def earned_at(rows: DataFrame, status: str) -> DataFrame:
    """Earned hours of each activity at a day (columns duration, pct, dates and day), by what is known of it.

    Finished work counts wholly from its finish, and linearly by days before it; started work rises to its percentage
    at the status date; progress without dates follows the plan up to its percentage; work after the status date
    follows predicted dates. Days are calendar days; a window has one day at least.
    """
    at, h, p = F.to_timestamp_ntz(F.lit(status)), F.col("duration"), F.col("pct") / 100
    day, a0, a1 = F.col("day"), F.col("actual_start"), F.col("actual_finish")
    share = lambda frm, to: F.least(F.lit(1.0), F.greatest(F.lit(0), F.datediff(day, frm)) / F.greatest(F.lit(1), F.datediff(to, frm)))
    started = F.when(a1.isNotNull(), h * share(a0, a1)).when(p > 0, h * p * share(a0, at)).otherwise(0.0)
    planned = F.when(F.col("finish") <= day, h * p).when(F.col("start") <= day, h * F.least(share(F.col("start"), F.col("finish")), p)).otherwise(0.0)
    ps, pe = F.coalesce("predicted_start", "start"), F.col("predicted_end")
    ahead = F.when(pe <= day, h).when((ps <= day) & (day < pe), h * share(ps, pe)).otherwise(0.0)
    value = F.when(a1 <= day, h).when(a0 <= day, started).when((p > 0) & (day <= at), planned).when(day > at, ahead).otherwise(0.0)
    return rows.withColumn("earned", value)


def earned_curve(acts: DataFrame, dates: DataFrame, status: str) -> DataFrame:
    """Earned hours of each project at each of its dates (project_id, day), never falling.

    Activities meet only their own project's dates, in a join by project.
    """
    rows = earned_at(acts.join(dates, "project_id"), status)
    w = Window.partitionBy("project_id").orderBy("day")
    return rows.groupBy("project_id", "day").agg(F.sum("earned").alias("e")).select("project_id", "day", F.max("e").over(w).alias("earned"))


def initial_predictions(acts: DataFrame, status: str) -> DataFrame:
    """predicted_hours and predicted_start of each activity, before any propagation (columns performance_delta, slip_days).

    Finished work keeps its dates; work in progress takes its remaining hours times the performance;
    what hasn't begun starts at its date or the status date, moved on by the slip.
    """
    at, h, p = F.to_timestamp_ntz(F.lit(status)), F.col("duration"), F.col("pct") / 100
    k = F.greatest(F.col("performance_delta"), F.lit(0.0))
    done = F.col("actual_start").isNotNull() & F.col("actual_finish").isNotNull()
    going = F.col("actual_start").isNotNull() & (p > 0) & (p < 1)
    hours = F.when(done, h).when(p >= 1, h).when(going, h * p + h * (1 - p) * k).otherwise(h * k)
    shifted = F.greatest("start", at) + F.make_dt_interval(F.col("slip_days"))
    start = F.when(done | going, F.col("actual_start")).when(p >= 1, F.col("start")).otherwise(shifted)
    return acts.withColumn("predicted_hours", hours).withColumn("predicted_start", start)


def forecasted(acts: DataFrame, status: str, default_rate: float = 1.0) -> DataFrame:
    """(project_id, forecasted_bcwp, forecasted_acwp_hours, forecasted_acwp_cost, risk_adjusted): accrual at the status date over
    risk-adjusted windows (columns risk_start, risk_end, risk_duration; where null, the planned ones).

    BCWP accrues planned hours, ACWP risk-adjusted ones; an empty window counts from its end on. Activities without hours or dates
    count nowhere. risk_adjusted tells whether any activity of the project has a risk-adjusted value.
    """
    at = F.to_timestamp_ntz(F.lit(status))
    share = planned_share(F.coalesce("risk_start", "start"), F.coalesce("risk_end", "finish"), at)
    share = F.when(F.coalesce("risk_start", "start").isNotNull() & F.coalesce("risk_end", "finish").isNotNull() & (F.col("duration") > 0), share).otherwise(0.0)
    hours = F.coalesce(F.nullif("risk_duration", F.lit(0.0)), "duration") * share
    rate = F.when(F.col("cost_rate") > 0, F.col("cost_rate")).otherwise(default_rate)
    given = F.col("risk_start").isNotNull() | F.col("risk_end").isNotNull() | F.col("risk_duration").isNotNull()
    return acts.groupBy("project_id").agg(F.sum(F.col("duration") * share).alias("forecasted_bcwp"), F.sum(hours).alias("forecasted_acwp_hours"), F.sum(hours * rate).alias("forecasted_acwp_cost"), F.bool_or(given).alias("risk_adjusted"))


def first_after(curve: DataFrame, status: str, date: str = "date") -> DataFrame:
    """(project_id, transition): the place (from 0) of a curve's first date after the status date, or the number of its dates."""
    w = Window.partitionBy("project_id").orderBy(date)
    k = curve.withColumn("_i", F.row_number().over(w) - 1)
    late = F.col(date) > F.to_timestamp_ntz(F.lit(status))
    return k.groupBy("project_id").agg(F.coalesce(F.min(F.when(late, F.col("_i"))), F.count("*")).cast("long").alias("transition"))


def significant_dates(acts: DataFrame, columns: list[str], status: str, most: int, step_days: int = 7) -> DataFrame:
    """(project_id, day): the distinct dates of the columns, the status date and every step_days between the first and the last; where they
    are more than most, evenly spaced ones of them, the first and the last among them."""
    own = acts.groupBy("project_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(*columns))))).alias("own")).where(F.size("own") > 0)
    # arrays by project: what is filled in between is many times the activities, and never shuffled
    fill = F.sequence(F.array_min("own"), F.array_max("own"), F.make_dt_interval(F.lit(step_days)))
    days = own.select("project_id", F.array_sort(F.array_distinct(F.concat("own", fill, F.array(F.to_timestamp_ntz(F.lit(status)))))).alias("days"))
    days = days.select("project_id", F.size("days").alias("_n"), F.posexplode("days").alias("_i", "day"))
    # i is one of floor(k (n - 1) / (most - 1)): the place of the smallest such k that reaches i gives i back
    k = F.ceil(F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    keep = (F.col("_n") <= most) | (F.floor(k * (F.col("_n") - 1) / (most - 1)) == F.col("_i"))
    return days.where(keep).select("project_id", "day")


DAY = np.timedelta64(1, "D")


class WorkDays:
    """Whole working days added to or taken from dates, for arrays of dates; a calendar's days as an array."""

    def __init__(self, days: np.ndarray, hours_per_day: float = 8.0):
        self.days, self.hours = np.sort(days.astype("datetime64[D]")), hours_per_day

    def moved(self, at: np.ndarray, hours: np.ndarray, back: bool = False) -> np.ndarray:
        """Dates moved by as many working days as the hours begin, at the same time of day; 0 hours leave a date as it is. Beyond the calendar
        its first or last day counts."""
        day = at.astype("datetime64[D]")
        n = np.ceil(np.maximum(hours, 0) / self.hours).astype(int)
        k = np.searchsorted(self.days, day, side="left") - n if back else np.searchsorted(self.days, day, side="right") + n - 1
        to = self.days[np.clip(k, 0, len(self.days) - 1)]
        return np.where(hours > 0, at + (to - day).astype("timedelta64[us]"), at)


def propagated_predictions(acts: DataFrame, links: DataFrame, working_days: list, hours_per_day: float = 8.0, decay: float = 0.85) -> DataFrame:
    """(project_id, id, predicted_hours, predicted_start, predicted_end) after distance decay and propagation along the links.

    acts has the columns of initial_predictions() and frontier (boolean). Behind the frontier the performance fades: an activity without
    progress, d links away, takes its hours times decay ** d * performance + 1 - decay ** d. Then, level by level, an activity that hasn't
    started begins no earlier than its links demand, by whole working days (working_days: the calendar's days, a bounded list); lags of 0 or
    less don't move a date. On a cycle, links against the input order are left out. Empty tables give no rows.
    """
    days = np.array(working_days, "datetime64[D]")

    def kernel(a, e):
        work = WorkDays(days, hours_per_day)
        e, level = acyclic(len(a), e)
        src, dst, lag = e.src.to_numpy(int), e.dst.to_numpy(int), np.maximum(e.lag.to_numpy(float), 0)
        rel = e.rel.str.upper().to_numpy(object) if len(e) else np.zeros(0, object)
        away = np.where(a.frontier.fillna(False).to_numpy(bool), 0.0, np.inf)
        for g in by_level(level, dst):
            np.minimum.at(away, dst[g], away[src[g]] + 1)
        begun = a.actual_start.notna().to_numpy()
        idle = ~begun & ~a.actual_finish.notna().to_numpy() & ~(a.pct.to_numpy(float) > 0)
        fade = np.where(np.isfinite(away) & idle, decay ** np.where(np.isfinite(away), away, 0), np.nan)
        plain = a.duration.to_numpy(float)
        hours = np.where(np.isnan(fade), a.predicted_hours.to_numpy(float), plain * (fade * a.performance_delta.to_numpy(float) + 1 - fade))
        start = a.predicted_start.to_numpy("datetime64[us]").copy()
        end = work.moved(start, hours)
        for g in by_level(level, dst):
            s, t = src[g], dst[g]
            by_start, by_finish = np.isin(rel[g], ["SS", "SF"]), np.isin(rel[g], ["FF", "SF"])
            need = work.moved(np.where(by_start, start[s], end[s]), lag[g])
            need = np.where(by_finish, np.where(hours[t] > 0, work.moved(need, hours[t], back=True), np.datetime64("1678-01-01", "us")), need)
            least = np.full(len(a), np.datetime64("1678-01-01", "us"))
            np.maximum.at(least, t, need)
            late = np.unique(t)
            late = late[~begun[late] & (least[late] > start[late])]
            start[late] = least[late]
            end[late] = work.moved(start[late], hours[late])
        return a.assign(predicted_hours=hours, predicted_start=start, predicted_end=end)

    columns = ["seq", "duration", "pct", "actual_start", "actual_finish", "performance_delta", "predicted_hours", "predicted_start", "frontier"]
    return graph_apply(acts, links, kernel, "project_id long, id string, predicted_hours double, predicted_start timestamp_ntz, predicted_end timestamp_ntz", columns)


def completed_starts(acts: DataFrame, is_start: Column) -> DataFrame:
    """acts with each project's start milestone marked as done where any activity has begun: 100 %, begun with the earliest other activity
    that has (else at its own start, dates that are given stay), finished when it began. One window by project."""
    w = Window.partitionBy("project_id")
    begun = F.max(F.col("actual_start").isNotNull()).over(w)
    first = F.min(F.when(~is_start, F.col("actual_start"))).over(w)
    rows = acts.withColumns({"_mark": is_start & begun, "_at": F.coalesce("actual_start", first, "start")})
    done = lambda c, v: F.when(F.col("_mark"), v).otherwise(F.col(c))
    return rows.withColumns({"pct": done("pct", F.lit(100.0)), "actual_finish": done("actual_finish", F.coalesce("actual_finish", "_at")), "actual_start": done("actual_start", F.col("_at"))}).drop("_mark", "_at")


def accrual(windows: DataFrame, days: DataFrame) -> DataFrame:
    """(project_id, curve, day, amount, period) at each of a project's days (project_id, day), for every curve it has.

    windows (project_id, curve, begin, end, amount): an amount that accrues evenly from begin to end, or is there from its
    end on if that isn't later. `amount` is what has accrued by then; `period` is the sum of the daily amounts of the windows open
    at that time, both ends included, where a window counts as a day long at least. Rows with a null are left out; a project
    without days has no rows. A sweep: windows never meet days, both become events of one running sum.
    """
    w = windows.where("project_id is not null and curve is not null and begin is not null and end is not null and amount is not null")
    span = seconds(F.col("end")) - seconds(F.col("begin"))
    slope = F.when(span > 0, F.col("amount") / span).otherwise(0.0)
    daily = F.when(span >= 0, F.col("amount") / F.greatest(span / 86400, F.lit(1.0))).otherwise(0.0)
    zero, none, one = F.lit(0.0), F.lit(0), F.when(span > 0, 1).otherwise(0)
    names = ("slope", "open", "step", "opens", "closes")
    event = lambda at, *v: F.struct(F.col(at).alias("t"), *[x.alias(n) for x, n in zip(v, names)])
    both = F.array(event("begin", slope, one, zero, daily, zero), event("end", -slope, -one, F.when(span > 0, zero).otherwise(F.col("amount")), zero, daily))
    e = w.select("project_id", "curve", F.explode(both).alias("e")).select("project_id", "curve", "e.*", F.lit(False).alias("asked"))
    asked = w.select("project_id", "curve").distinct().join(days.where("day is not null").distinct(), "project_id")
    e = e.unionByName(asked.select("project_id", "curve", F.col("day").alias("t"), *[(none if n == "open" else zero).alias(n) for n in names], F.lit(True).alias("asked")))
    e = e.groupBy("project_id", "curve", "t").agg(*[F.sum(n).alias(n) for n in names], F.max("asked").alias("asked"))
    run = Window.partitionBy("project_id", "curve").orderBy("t")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    # what accrues up to the next event; nothing between windows, whatever sums of slopes leave
    gain = F.when(F.sum("open").over(run) > 0, F.sum("slope").over(run) * (seconds(F.lead("t").over(run)) - seconds(F.col("t")))).otherwise(0.0)
    e = e.withColumn("gain", gain).withColumn("steps", F.sum("step").over(run)).withColumn("opened", F.sum("opens").over(run)).withColumn("closed", F.sum("closes").over(before))
    amount = F.coalesce(F.sum("gain").over(before), zero) + F.col("steps")
    e = e.withColumn("amount", amount).withColumn("period", F.col("opened") - F.coalesce("closed", zero))
    return e.where("asked").select("project_id", "curve", F.col("t").alias("day"), "amount", "period")


def running(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sums of the rows of x (events, values) within segments (first row and size of each), one after the other in each segment.

    Segments of like size are summed side by side."""
    out, kind = np.empty_like(x), np.frexp(size - 1)[1]
    for k in np.unique(kind):
        at, n = first[kind == k, None], size[kind == k, None]
        place = np.arange(n.max())
        inside = place < n
        rows = np.where(inside, at + place, 0)
        total = np.cumsum(np.where(inside[..., None], x[rows], 0.0), axis=1)
        out[rows[inside]] = total[inside]
    return out


def swept(p: np.ndarray, begin: np.ndarray, end: np.ndarray, amounts: np.ndarray, ap: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What accrual gives, for arrays: windows of projects p (numbers) with several amounts (windows, values) and moments asked, of projects ap,
    all different; times are whole microseconds. Gives which moments of projects with windows these are, their amounts and periods."""
    span, values = (end - begin)[:, None] / 1e6, amounts.shape[1]
    slope = np.divide(amounts, span, out=np.zeros_like(amounts), where=span > 0)
    daily = np.where(span >= 0, amounts / np.maximum(span / 86400, 1.0), 0.0)
    zero, one = np.zeros_like(amounts), (span > 0).astype(float)
    known = np.flatnonzero(np.isin(ap, p))
    # columns: open, and slope, step, opens, closes of each value
    change = np.concatenate([np.concatenate([one, slope, zero, daily, zero], axis=1), np.concatenate([-one, -slope, np.where(span > 0, 0.0, amounts), zero, daily], axis=1), np.zeros((len(known), 1 + 4 * values))])
    at, who = np.concatenate([begin, end, asked[known]]), np.concatenate([p, p, ap[known]])
    order = np.lexsort((at, who))
    at, who = at[order], who[order]
    new = np.r_[True, (np.diff(at) != 0) | (np.diff(who) != 0)] if len(at) else np.zeros(0, bool)
    event = np.empty(len(order), int)
    event[order] = np.cumsum(new) - 1
    change = np.add.reduceat(change[order], np.flatnonzero(new)) if len(at) else change
    at, who = at[new], who[new]
    first = np.flatnonzero(np.r_[True, np.diff(who) != 0]) if len(at) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(at)])
    level = running(change, first, size)
    opened, slopes, steps, opens, closes = level[:, :1], *(level[:, 1 + i * values : 1 + (i + 1) * values] for i in range(4))
    later = np.r_[np.diff(at), 0][:, None] / 1e6
    later[first + size - 1] = 0
    # what accrues up to the next event; nothing between windows, whatever sums of slopes leave
    both = running(np.where(opened > 0, slopes * later, 0.0), first, size)

    def before(x):
        out = np.concatenate([np.zeros_like(x[:1]), x[:-1]])
        out[first] = 0
        return out

    own = event[2 * len(p) :]
    return known, (before(both) + steps)[own], (opens - before(closes))[own]


CURVES = ("planned", "overrun", "earned")


def forecasted_curves(acts: DataFrame, status: str, shown: Callable[[np.ndarray], np.ndarray] = lambda x: x, default_rate: float = 1.0) -> DataFrame:
    """(project_id, curve, day, amount, period) of planned, overrun and earned, each in hours and (suffix _cost) in cost, at each start and
    finish of a project's activities and the status date; amount and period are those of accrual(), passed through shown.

    Planned and earned work accrues over the planned window, overrun over the risk-adjusted one (columns risk_start, risk_end,
    risk_duration; where null, the planned ones; a duration of 0 too). Activities without hours or dates have no windows. Only activities
    are shuffled; windows and days, twenty times as many, are made in a kernel.
    """
    rate = F.when(F.col("cost_rate") > 0, F.col("cost_rate")).otherwise(default_rate)
    rows = acts.withColumns({"risk_start": F.coalesce("risk_start", "start"), "risk_end": F.coalesce("risk_end", "finish"), "risk_duration": F.coalesce(F.nullif("risk_duration", F.lit(0.0)), "duration"), "pct": F.coalesce("pct", F.lit(0.0)), "rate": rate})
    at = np.datetime64(status, "us").astype("int64")
    schema = "project_id long, curve string, day timestamp_ntz, amount double, period double"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def kernel(t):
        a = {c: t[c].to_pandas().to_numpy() for c in t.column_names}
        micros = lambda c: a[c].astype("datetime64[us]").astype("int64")
        ids = a["project_id"]
        p = np.cumsum(np.r_[0, np.diff(ids) != 0])
        ids = ids[np.r_[True, np.diff(ids) != 0]]
        some = [~np.isnat(a[c]) for c in ("start", "finish")]
        has = np.unique(p)
        days = np.stack([np.concatenate([p[some[0]], p[some[1]], has]), np.concatenate([micros("start")[some[0]], micros("finish")[some[1]], np.full(len(has), at)])])
        days = days[:, np.lexsort(days[::-1])]
        days = days[:, np.r_[True, (np.diff(days) != 0).any(0)]]
        hours = a["duration"].astype(float)
        known = np.flatnonzero(some[0] & some[1] & (hours > 0))
        for name, b, e, h in (("planned", "start", "finish", hours), ("overrun", "risk_start", "risk_end", a["risk_duration"].astype(float)), ("earned", "start", "finish", hours * a["pct"].astype(float) / 100)):
            h = h[known]
            k, amount, period = swept(p[known], micros(b)[known], micros(e)[known], np.stack([h, h * a["rate"][known].astype(float)], axis=1), *days)
            for i, curve in enumerate((name, f"{name}_cost")):
                yield pa.RecordBatch.from_arrays([pa.array(ids[days[0, k]], pa.int64()), pa.repeat(pa.scalar(curve), len(k)), pa.array(days[1, k]).cast(target.field("day").type), pa.array(shown(amount[:, i])), pa.array(shown(period[:, i]))], schema=target)

    return project_apply(rows, kernel, schema, ["start", "finish", "risk_start", "risk_end", "duration", "risk_duration", "pct", "rate"], "start")


def progress_curves(acts: DataFrame, days: DataFrame, status: str) -> DataFrame:
    """(project_id, day, planned, actual, expected) in per cent of a project's hours at its days: planned work up to its planned finish,
    actual work up to the status date, expected work from there to the expected finish (columns expected_start, expected_finish); else null.

    Finished work accrues over its actual window, work in progress up to its percentage at the status date (from its
    actual, else its planned start), remaining work over its expected window from the status date on. Activities without hours count
    nowhere; a project without any has no rows. Missing percentages are 0; work is finished with an actual finish or 100 %.
    """
    at, h = F.to_timestamp_ntz(F.lit(status)), F.col("duration")
    a = acts.where(h > 0).withColumn("pct", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("pct", F.lit(0.0)))))
    p = F.col("pct") / 100
    finished = F.col("actual_finish").isNotNull() | (p >= 1)
    going = F.col("actual_finish").isNull() & (F.col("actual_start").isNotNull() | (p > 0))
    frm = F.coalesce("actual_start", "start", at)
    ahead = F.greatest(at, F.coalesce("expected_start", at))
    window = lambda name, when, begin, end, v: F.when(when, F.struct(F.lit(name).alias("curve"), begin.alias("begin"), end.alias("end"), v.alias("amount")))
    parts = F.array(
        window("planned", F.col("start").isNotNull() & F.col("finish").isNotNull(), F.col("start"), F.col("finish"), h),
        window("actual", F.col("actual_finish").isNotNull(), F.coalesce("actual_start", "actual_finish"), F.col("actual_finish"), h),
        window("actual", going, F.least(frm, at), at, F.when(frm <= at, h * p).otherwise(0.0)),
        window("expected", ~finished, ahead, F.coalesce("expected_finish", ahead), h * (1 - p)),
    )
    w = a.select("project_id", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("w")).select("project_id", "w.*")
    wide = accrual(w, days).groupBy("project_id", "day").agg(*[F.max(F.when(F.col("curve") == c, F.col("amount"))).alias(c) for c in ("planned", "actual", "expected")])
    total = a.groupBy("project_id").agg(F.sum("duration").alias("_h"), F.sum(F.when(finished, h).otherwise(h * p)).alias("_done"), F.max("finish").alias("_planned"), F.max(F.greatest(F.coalesce("expected_finish", at), at)).alias("_expected"))
    share = lambda v: clamp(100 * F.coalesce(v, F.lit(0.0)) / F.col("_h"), 0.0, 100.0)
    day = F.col("day")
    return days.where("day is not null").distinct().join(total, "project_id").join(wide, ["project_id", "day"], "left").select(
        "project_id",
        "day",
        F.when(day <= F.col("_planned"), share(F.col("planned"))).alias("planned"),
        F.when(day <= at, share(F.col("actual"))).alias("actual"),
        F.when((day >= at) & (day <= F.col("_expected")), share(F.col("_done") + F.coalesce("expected", F.lit(0.0)))).alias("expected"),
    )
