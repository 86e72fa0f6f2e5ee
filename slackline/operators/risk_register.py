"""Registers of external risks: scores, groups of alike ones, and which are covered."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slackline.plans.grouped import whole_projects

#: Words that tell nothing of a risk (fixed values).
STOP_WORDS = (
    "the and for with that this from are will may can could would should have has been being was were which their them these those such than then "
    "into over under during before after above below project risk impact delay issue problem cause effect potential possible related associated result lead due"
).split()
#: Patterns of specific texts and what they are worth (fixed values).
SPECIFIC = (
    (r"\d+\s*(day|week|month|hour|%|percent|km|mile|mw|ton|usd|\$)", 0.2),
    (r"compressor|reactor|cracker|furnace|column|vessel|pump|turbine|generator|transformer|switchgear", 0.15),
    (r"commissioning|startup|fabrication|erection|excavation|piling|hydro|loop", 0.1),
    (r"contractor|vendor|supplier|regulator|agency|utility|epc|owner", 0.1),
)
#: Shares of the parts of a score (fixed values): specificity, completeness, severity, confidence.
SPECIFICITY, COMPLETENESS, SEVERITY, CONFIDENCE, GROUNDING = 0.25, 0.20, 0.15, 0.10, 0.30


def keywords(text: Column) -> Column:
    """The distinct words of more than three letters a-z of a text in lower case that tell something, sorted; other characters vanish."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s]", ""), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS))))


def specificity(text: Column, reason: Column, cited: Column) -> Column:
    """0 to 1: quantities, plant, phases and parties named in the text, the length of the reason given, and whether data are cited."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.length(F.coalesce(reason, F.lit("")))
    parts = [F.when(low.rlike(p), v).otherwise(0.0) for p, v in SPECIFIC]
    parts += [F.when(n > 80, 0.25).when(n > 40, 0.15).otherwise(0.0), F.when(F.coalesce(cited, F.lit(False)), 0.15).otherwise(0.0)]
    return F.least(F.lit(1.0), sum(parts, F.lit(0.0)))


def severity(probability: Column, cost: Column, schedule: Column) -> Column:
    """Probability times the larger impact; what is missing or 0 counts as one half."""
    half = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.5))
    return half(probability) * F.greatest(half(cost), half(schedule))


def composite(specific: Column, grounded: Column, complete: Column, severe: Column, confidence: Column) -> Column:
    """Weighted sum of the parts; a missing confidence is one half."""
    return specific * SPECIFICITY + grounded * GROUNDING + complete * COMPLETENESS + severe * SEVERITY + F.coalesce(confidence, F.lit(0.5)) * CONFIDENCE


def grouped(risks: DataFrame, least: float = 0.5) -> DataFrame:
    """(register, risk_id, leader): risks (register, risk_id, ord, type, words) of one type whose words overlap (Jaccard) by more than `least`
    with those of the leader of a group, which is the first by ord that no earlier leader took.

    A null type is a type; risks without words stand alone; ties of ord go to the smaller risk_id. A register is a project's own and meets in one
    task; risks are compared only with leaders of their type that share a word, through an index of the leaders' words.
    """
    rows = risks.select(F.col("register").cast("long").alias("project_id"), "risk_id", F.coalesce("type", F.lit("")).alias("type"), "words", F.col("ord").cast("long").alias("o"))
    rows = rows.repartition("project_id").sortWithinPartitions("project_id", "o", "risk_id")

    def run(batches):
        for t in whole_projects(batches):
            out = []
            for project, own in t.to_pandas().groupby("project_id", sort=False):
                index: dict[tuple[str, str], list[int]] = {}
                leaders: list[tuple[int, int]] = []  # id and number of words
                for rid, kind, words in zip(own.risk_id, own.type, own.words):
                    words = [] if words is None else list(words)
                    shared: dict[int, int] = {}
                    for w in words:
                        for k in index.get((kind, w), ()):
                            shared[k] = shared.get(k, 0) + 1
                    near = [k for k, n in shared.items() if n > least * (leaders[k][1] + len(words) - n)]
                    if not near:
                        for w in words:
                            index.setdefault((kind, w), []).append(len(leaders))
                        near = [len(leaders)]
                        leaders.append((rid, len(words)))
                    out.append((project, rid, leaders[min(near)][0]))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["register", "risk_id", "leader"]).astype("int64"), preserve_index=False)

    return rows.mapInArrow(run, "register long, risk_id long, leader long")


def merged(risks: DataFrame, groups: DataFrame, most: int = 8) -> DataFrame:
    """(register, leader, best, members, mitigations): the best of each group by score (ties: smaller risk_id), and the mitigations of all, its own
    first, then those of the others by score, each once, `most` of them. risks has register, risk_id, score and mitigations."""
    m = risks.join(groups, ["register", "risk_id"])
    own = Window.partitionBy("register", "leader").orderBy(F.desc_nulls_last("score"), "risk_id")
    m = m.withColumn("_k", F.row_number().over(own))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("mitigations", F.array().cast("array<string>")).alias("m")))), lambda s: s["m"])
    g = m.groupBy("register", "leader").agg(F.min_by("risk_id", "_k").alias("best"), F.count("*").alias("members"), lists.alias("_m"))
    return g.select("register", "leader", "best", "members", F.slice(F.array_distinct(F.flatten("_m")), 1, most).alias("mitigations"))


def coverage(risks: DataFrame, mapped: DataFrame, mitigations: DataFrame) -> DataFrame:
    """(register, risk_id, mapped, mitigated): whether any activity carries a risk (mapped: register, risk_id), and whether any mitigation
    (register, risk_id, name) names it by id or, in any case and without outer blanks, by name. risks has register, risk_id and name."""
    name = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    on = mapped.select("register", "risk_id").distinct().withColumn("_m", F.lit(True))
    by_id = mitigations.where("risk_id is not null").select("register", "risk_id").distinct().withColumn("_i", F.lit(True))
    by_name = mitigations.select("register", name(F.col("name")).alias("_name")).where("_name is not null").distinct().withColumn("_n", F.lit(True))
    rows = risks.select("register", "risk_id", name(F.col("name")).alias("_name"))
    rows = rows.join(on, ["register", "risk_id"], "left").join(by_id, ["register", "risk_id"], "left").join(by_name, ["register", "_name"], "left")
    yes = lambda *c: F.coalesce(*[F.col(x) for x in c], F.lit(False))
    return rows.select("register", "risk_id", yes("_m").alias("mapped"), yes("_i", "_n").alias("mitigated"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """(register, risks, mapped, mitigated, uncovered): counts of each register; uncovered risks are neither."""
    c = covered.groupBy("register").agg(F.count("*").alias("risks"), F.count_if("mapped").alias("mapped"), F.count_if("mitigated").alias("mitigated"), F.count_if(~F.col("mapped") & ~F.col("mitigated")).alias("uncovered"))
    return c
