"""Reference classes of projects as a small table, with aliases and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, fat tail from, power law behind it, alpha range, tier 4, factors at P50 P80 P95 P99 (None: unbounded), cap,
#: mean overrun, fat-tailed, finite mean (fixed values).
CLASSES = (
    ("oil_gas_offshore", 0.55, 0.25, (1.8, 2.5), "birnbaum_saunders", (1.10, 1.30, 1.55, 2.00), 10.0, 0.40, True, True),
    ("oil_gas_onshore_lng", 0.60, 0.25, (2.0, 2.7), "birnbaum_saunders", (1.05, 1.20, 1.40, 1.75), 8.0, 0.20, True, True),
    ("nuclear_new_build", 0.40, 0.20, (1.4, 2.0), "birnbaum_saunders", (1.35, 1.85, 2.80, 5.00), 20.0, 1.173, True, True),
    ("nuclear_decommissioning", 0.35, 0.15, (1.2, 1.8), "birnbaum_saunders", (1.50, 2.20, 4.00, 8.00), 30.0, 1.50, True, True),
    ("rail", 0.55, 0.30, (2.0, 2.8), "birnbaum_saunders", (1.15, 1.45, 1.95, 3.00), 10.0, 0.45, True, True),
    ("tunnels", 0.50, 0.25, (1.8, 2.5), "birnbaum_saunders", (1.20, 1.55, 2.30, 3.80), 12.0, 0.50, True, True),
    ("bridges_fixed_links", 0.60, 0.30, (2.2, 3.0), "birnbaum_saunders", (1.10, 1.35, 1.75, 2.50), 8.0, 0.34, True, True),
    ("roads", 0.75, 0.20, (2.5, 3.5), "lognormal", (1.05, 1.20, 1.40, 1.70), 5.0, 0.20, False, True),
    ("buildings_standard", 0.70, 0.25, (2.5, 3.5), "lognormal", (1.05, 1.20, 1.35, 1.65), 5.0, 0.13, False, True),
    ("buildings_nonstandard", 0.55, 0.25, (1.9, 2.6), "birnbaum_saunders", (1.15, 1.45, 1.85, 2.50), 8.0, 0.30, True, True),
    ("defense_mdap", 0.50, 0.20, (1.7, 2.4), "birnbaum_saunders", (1.20, 1.55, 2.15, 3.50), 12.0, 0.33, True, True),
    ("it_software", 0.30, 0.05, (0.8, 1.5), "direct_normal_to_pareto", (1.15, 1.50, 2.50, None), 50.0, 4.47, True, False),
    ("olympics", 0.20, 0.05, (0.9, 1.4), "direct_normal_to_pareto", (1.50, 2.40, 4.50, None), 50.0, 1.72, True, False),
    ("mining", 0.50, 0.25, (1.8, 2.5), "birnbaum_saunders", (1.20, 1.55, 2.25, 3.75), 10.0, 0.62, True, True),
    ("solar_pv", 0.85, 0.10, (3.0, 4.0), "lognormal", (1.00, 1.10, 1.20, 1.35), 3.0, 0.05, False, True),
    ("wind_onshore", 0.85, 0.10, (3.0, 4.0), "lognormal", (1.00, 1.10, 1.20, 1.35), 3.0, 0.08, False, True),
    ("wind_offshore", 0.60, 0.25, (2.0, 2.7), "birnbaum_saunders", (1.10, 1.30, 1.55, 2.00), 6.0, 0.20, True, True),
    ("battery_storage", 0.85, 0.10, (3.0, 4.0), "lognormal", (1.00, 1.10, 1.20, 1.35), 3.0, 0.05, False, True),
    ("data_centre_hyperscale", 0.55, 0.25, (1.9, 2.6), "birnbaum_saunders", (1.10, 1.40, 1.85, 2.75), 8.0, 0.30, True, True),
)

#: Other names of classes (fixed values).
ALIASES = {
    "oil_and_gas": "oil_gas_offshore", "oil_gas": "oil_gas_offshore", "lng": "oil_gas_onshore_lng", "petrochemical": "oil_gas_onshore_lng", "petrochem": "oil_gas_onshore_lng",
    "nuclear": "nuclear_new_build", "nuclear_energy": "nuclear_new_build", "infrastructure": "rail", "epc": "rail", "civil": "rail", "transportation": "rail",
    "construction": "buildings_standard", "commercial": "buildings_standard", "buildings": "buildings_standard", "industrial": "buildings_nonstandard",
    "defense": "defense_mdap", "government": "defense_mdap", "federal": "defense_mdap", "military": "defense_mdap", "technology": "it_software", "software": "it_software", "it": "it_software",
    "data_centre": "data_centre_hyperscale", "data_center": "data_centre_hyperscale", "datacentre": "data_centre_hyperscale", "datacenter": "data_centre_hyperscale", "hyperscale": "data_centre_hyperscale",
}
SCHEMA = "name string, fat_tail_from double, pareto_offset double, alpha_low double, alpha_high double, tier_4 string, p50 double, p80 double, p95 double, p99 double, cap double, mean_overrun double, fat_tailed boolean, finite_mean boolean"


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, f, o, *a, t, *p, c, m, fat, fin) for n, f, o, a, t, p, c, m, fat, fin in CLASSES], SCHEMA)


def resolved(name: Column) -> Column:
    """A class's own name from a name or alias in any spelling; null if there is no such class."""
    n = F.regexp_replace(F.lower(F.trim(name)), r"[\s\-]+", "_")
    alias = F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), n)
    return F.when(n.isin(*[c[0] for c in CLASSES]), n).otherwise(alias)


def calibrated(finish: Column, expected: Column, factor: Column) -> Column:
    """The finish with its distance from the expected one multiplied; unchanged without a factor."""
    return F.when(factor.isNull(), finish).otherwise(expected + (finish - expected) * factor)


def suggested(name: Column, most: int = 6) -> Column:
    """The known name or alias with the fewest edits from a name in any spelling (ties: the smaller name), at most so many; else null."""
    n = F.regexp_replace(F.lower(F.trim(name)), r"[\s\-]+", "_")
    known = sorted({c[0] for c in CLASSES} | set(ALIASES))
    best = F.array_min(F.array(*[F.struct(F.levenshtein(n, F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in known]))
    return F.when(best["d"] <= most, best["k"])


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """Classes of JSON files, one object for each line, in the columns of table(). Lines that are no JSON, have no name, quantiles that are
    missing or fall, or a cap of 1 or less, are skipped."""
    rows = spark.read.schema(SCHEMA + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    good = F.col("_broken").isNull() & F.col("name").isNotNull() & (F.trim("name") != "") & (F.col("p50") <= F.col("p80")) & (F.col("p80") <= F.col("p95")) & (F.coalesce("cap", F.lit(10.0)) > 1)
    return rows.where(good).drop("_broken")
