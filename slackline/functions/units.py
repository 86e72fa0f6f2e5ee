"""Durations, percentages and clamps as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKS_PER_MONTH, WEEKS_PER_YEAR = 4.345, 52.14

#: Exact spellings of units (fixed values).
UNITS = {
    "hour": ("h", "hr", "hrs", "hour", "hours"),
    "second": ("s", "sec", "secs", "second", "seconds"),
    "minute": ("min", "mins", "minute", "minutes", "m"),
    "day": ("d", "day", "days"),
    "week": ("w", "wk", "wks", "week", "weeks"),
    "month": ("mo", "mon", "mons", "month", "months"),
    "year": ("y", "yr", "yrs", "year", "years"),
}


def hours_in(unit: Column, hours_per_day: float = 8.0, days_per_week: float = 5.0) -> Column:
    """Hours of one unit: by exact spelling, else by first letter (mo before m), else hours."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit("hours"))))
    size = {"hour": 1.0, "second": 1 / 3600, "minute": 1 / 60, "day": hours_per_day, "week": days_per_week * hours_per_day, "month": WEEKS_PER_MONTH * days_per_week * hours_per_day, "year": WEEKS_PER_YEAR * days_per_week * hours_per_day}
    out = None
    for name, spellings in UNITS.items():
        out = (F if out is None else out).when(u.isin(*spellings), size[name])
    for start, name in (("h", "hour"), ("d", "day"), ("w", "week"), ("y", "year"), ("mo", "month"), ("m", "minute")):
        out = out.when(u.startswith(start), size[name])
    return out.otherwise(1.0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def to_hours(duration: Column, unit: Column, hours_per_day: float = 8.0, days_per_week: float = 5.0) -> Column:
    """Working hours; 0 for what isn't a positive finite number."""
    d = duration.try_cast("double")
    return F.when(finite(d) & (d > 0), d * hours_in(unit, hours_per_day, days_per_week)).otherwise(0.0)


def from_hours(hours: Column, unit: Column, hours_per_day: float = 8.0, days_per_week: float = 5.0) -> Column:
    h = hours.try_cast("double")
    return F.when(finite(h) & (h > 0), h / hours_in(unit, hours_per_day, days_per_week)).otherwise(0.0)


def percent(raw: Column) -> Column:
    """0 to 1 from 0 to 100, from numbers or texts with a percent sign; anything else is 0."""
    v = F.replace(F.trim(raw.cast("string")), F.lit("%"), F.lit("")).try_cast("double")
    return F.when(finite(v) & (v > 0), F.least(v / 100, F.lit(1.0))).otherwise(0.0)


def clamp(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """Within bounds; what isn't finite becomes the lower one."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(finite(x), F.greatest(lo, F.least(x, hi))).otherwise(lo)


#: Typical schedule overrun of sectors, in the order in which partial matches are tried (fixed values).
SECTOR_OVERRUN = {
    "nuclear": 0.65, "nuclear energy": 0.65, "oil and gas": 0.64, "oil & gas": 0.64, "oilgas": 0.64, "o&g": 0.64, "lng": 0.58, "petrochemical": 0.55,
    "infrastructure": 0.37, "epc": 0.37, "civil": 0.35, "transportation": 0.40, "rail": 0.45, "mining": 0.42,
    "construction": 0.25, "commercial": 0.20, "buildings": 0.20, "residential": 0.15, "industrial": 0.30,
    "defense": 0.50, "government": 0.45, "federal": 0.45, "military": 0.50, "technology": 0.25, "software": 0.30, "it": 0.28, "default": 0.25,
}


def sector_overrun(sector: Column, override: Column | None = None) -> Column:
    s = F.lower(F.trim(F.coalesce(sector, F.lit(""))))
    out = F.when(s.isin(*SECTOR_OVERRUN), F.element_at(F.create_map(*[F.lit(v) for kv in SECTOR_OVERRUN.items() for v in kv]), s))
    for key, value in SECTOR_OVERRUN.items():
        if key != "default":
            out = out.when((s != "") & (F.contains(s, F.lit(key)) | F.contains(F.lit(key), s)), value)
    if override is not None:
        out = out.when(override.try_cast("double") > 0, override.try_cast("double"))
    return out.otherwise(SECTOR_OVERRUN["default"])
