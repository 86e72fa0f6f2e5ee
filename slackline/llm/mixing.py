"""Mixing to target weights with soft membership, in DataFrame functions only.

A naive Bayes classifier, learned from a labelled table, gives each document a posterior over
domains. Nonnegative rates (expected numbers of copies) are then fitted so that the expected tokens
of each domain meet its target: projected gradient least squares, the gradient being scaled by the
Gram matrix of the documents whose rate is free. An iteration is one aggregate over the documents;
only a vector and a matrix of the domains' number reach the driver.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import hash_sample, persisted


#: Documents' worth of the prior in each feature's counts, and the log likelihood that a feature must gain.
SMOOTHING = 5.0
LEAST_GAIN = 10.0


@dataclass(frozen=True)
class DomainModel:
    domains: list[str]
    base: list[float]  # log weight of a text without any feature
    weights: dict[str, list[float]]  # what a feature's presence adds, by domain


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def _style(text: Column, words: Column, distinct: Column) -> Column:
    """Buckets of three ratios, written as features beside the words (which have no digits)."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.size(words), F.lit(1))
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:?'-]"))
    loud = F.regexp_count(text, F.lit(r"\p{Lu}{2,}"))
    bucket = lambda name, x: F.concat(F.lit(name), F.least(F.lit(8), F.floor(x * 8)).cast("string"))
    return F.array(bucket("odd1-", odd / n), bucket("loud1-", loud / n), bucket("varied1-", F.size(distinct) / n))


def _features(df: DataFrame, text: str) -> DataFrame:
    """df with __n (words) and __f (distinct words and style)."""
    df = df.withColumn("__w", words_of(F.col(text))).withColumn("__u", F.array_distinct("__w"))
    return df.withColumn("__n", F.size("__w").cast("long")).withColumn("__f", F.concat("__u", _style(F.col(text), F.col("__w"), F.col("__u"))))


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, low (quality 0) or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def learn_domains(docs: DataFrame, labelled: DataFrame, train_limit: int = 4000, lexicon: int = 256, doc_id: str = "doc_id", text: str = "text") -> DomainModel | None:
    """Learn from at most train_limit labelled documents (smallest hashes of their ids); of the features
    that tell more than chance would, the lexicon most telling ones stay (the model's size, not a cut of the rows: it is
    written into the plan as literals, and more features hardly change a posterior). A document with several domains counts for each. None without labels."""
    known = hash_sample(labelled.where("doc_id is not null").select(F.col("doc_id").alias("__d"), "domain").distinct(), train_limit, "__d", "domain")
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(known), F.col("__id") == F.col("__d"))  # train_limit rows at most
    rows = rows.groupBy("__id", "domain").agg(F.min("__t").alias("__t"))  # one text of an id, however often it is repeated
    rows = persisted(_features(rows, "__t").select("domain", "__f"), "mixing-sample")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").collect()}
    if not sizes:
        return None
    domains, total = list(sizes), sum(sizes.values())
    tally = rows.select("domain", F.explode("__f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)])
    prior = [(n + 1) / (total + len(domains)) for n in sizes.values()]
    ratio = [F.log((F.col(f"n{i}") + SMOOTHING * p) / (F.col("n") + SMOOTHING) / p) for i, p in enumerate(prior)]
    absent = [F.log1p(-(F.col(f"n{i}") + SMOOTHING * p) / (n + SMOOTHING)) - F.log1p(-(F.col("n") + SMOOTHING) / (total + 2 * SMOOTHING)) for i, (p, n) in enumerate(zip(prior, sizes.values()))]
    tally = tally.select("f", F.array(*ratio).alias("w"), F.array(*absent).alias("v"), sum((F.col(f"n{i}") * r for i, r in enumerate(ratio)), F.lit(0.0)).alias("gain"))
    best = tally.where(F.col("gain") > LEAST_GAIN).orderBy(F.desc("gain"), "f").limit(lexicon).collect()
    base = [math.log(p) + sum(r["v"][i] for r in best) for i, p in enumerate(prior)]
    return DomainModel(domains, base, {r["f"]: [x - y for x, y in zip(r["w"], r["v"])] for r in best})


def with_posteriors(df: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """df with __n (tokens) and __p (posteriors in the order of model.domains)."""
    df = _features(df, text)
    lex = F.array(*[F.lit(f) for f in model.weights]).cast("array<string>")
    # the casts give an empty lexicon its types
    table = F.map_from_arrays(lex, F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in model.weights.values()]).cast("array<array<double>>"))
    df = df.withColumn("__hits", F.transform(F.array_intersect("__f", lex), lambda f: F.element_at(table, f)))
    summed = lambda i: lambda a, w: a + w[i]
    logs = [F.aggregate("__hits", F.lit(float(b)), summed(i)) for i, b in enumerate(model.base)]
    df = df.withColumn("__l", F.array(*logs)).withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
    total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("__p", F.transform("__e", lambda x: x / total)).drop("__w", "__u", "__f", "__hits", "__l", "__e")


def rate_of(steps: list[list[float]]) -> Column:
    """The rate after these steps, from __n and __p: each subtracts tokens times p . step, not below 0."""
    r = F.lit(1.0)
    if not steps:
        return r
    path = F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in steps])
    k = len(steps[0])
    return F.aggregate(path, r, lambda a, v: F.greatest(F.lit(0.0), a - F.col("__n") * sum((F.col("__p")[i] * v[i] for i in range(k)), F.lit(0.0))))


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with pivots for a system of the domains' number."""
    n = len(b)
    rows = [list(r) + [x] for r, x in zip(a, b)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[p] = rows[p], rows[i]
        for r in range(n):
            if r != i:
                f = rows[r][i] / rows[i][i]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[i])]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def fit_rates(members: DataFrame, weights: list[float], most: int = 40, within: float = 1e-6) -> list[list[float]]:
    """Steps whose rates make the expected domain tokens meet weights times all tokens.

    members has __n and __p. The start is a rate of 1 for all. A step that makes the distance
    larger is halved, and dropped if it is the last. Ends when the distance is within a share of the target; warns with the
    distance left where it hardly shrinks for four steps (targets out of reach) or most steps don't suffice.
    """
    k = len(weights)
    total = members.agg(F.sum("__n")).first()[0] or 0
    if not total:
        return []
    target = [w * total for w in weights]
    p = [F.col("__p")[i] for i in range(k)]
    steps: list[list[float]] = []
    before, step, stalled = float("inf"), None, 0
    for turn in range(most + 1):
        rows = members.withColumn("__r", rate_of(steps))
        free = F.when(F.col("__r") > 0, F.col("__n").cast("double") * F.col("__n")).otherwise(0.0)
        got = rows.agg(*[F.sum(F.col("__r") * F.col("__n") * p[i]).alias(f"g{i}") for i in range(k)], *[F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        gap = [got[f"g{i}"] - target[i] for i in range(k)]
        distance = sum(x * x for x in gap) ** 0.5
        if distance <= within * sum(x * x for x in target) ** 0.5:
            return steps
        if distance > before * (1 + 1e-12):
            step = [x / 2 for x in step]
            if turn == most or max(abs(x) for x in step) < 1e-18:
                steps.pop()  # it leads away
                break
            steps[-1] = step
            continue
        stalled = stalled + 1 if distance > before * (1 - 1e-4) else 0
        before = distance
        if turn == most or stalled == 4:
            break
        gram = [[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]
        ridge = 1e-9 * sum(gram[i][i] for i in range(k)) + 1e-12
        step = solve([[x + ridge * (i == j) for j, x in enumerate(row)] for i, row in enumerate(gram)], gap)
        steps.append(step)
    warnings.warn(f"mixing: after {turn} steps the expected domain tokens are {before / sum(target):.2g} of all tokens away from the targets", stacklevel=2)
    return steps


def _plan(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], train_limit: int, doc_id: str, text: str):
    model = learn_domains(docs, labelled, train_limit, doc_id=doc_id, text=text)
    if model is None:
        return None, None
    wanted = [max(0.0, float(targets.get(d, 0.0))) for d in model.domains]
    share = sum(wanted)
    return model, [w / share for w in wanted] if share else [1 / len(wanted)] * len(wanted)


def _rated(df: DataFrame, steps: list[list[float]], doc_id: Column) -> DataFrame:
    """rate, and copies: a whole number whose mean over ids is the rate."""
    draw = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("copies")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.withColumn("__rate", rate_of(steps)).withColumn("__copies", F.floor(F.col("__rate") + draw).cast("int"))


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], train_limit: int = 4000, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, p_<domain>..., rate, copies), one row per row of docs.

    labelled has (doc_id, domain). Domains are those that occur in the sample of labelled documents;
    targets of others are left out and the rest scaled to 1; without any labels every rate is 1
    and there are no p columns. A null or empty text has no tokens and rate 1; null ids and
    sources stay; repeated rows are rows of their own (with equal copies); an empty table gives no
    rows. Other columns are not read. Rates don't depend on the order of rows.
    """
    model, wanted = _plan(docs, labelled, targets, train_limit, doc_id, text)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("__text"))
    if model is None:
        return base.select("doc_id", "source", F.size(words_of(F.col("__text"))).cast("long").alias("n_tokens"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    members = persisted(with_posteriors(base, model, "__text").drop("__text"), "mixing-members")
    out = _rated(members, fit_rates(members, wanted), F.col("doc_id"))
    return out.select("doc_id", "source", F.col("__n").alias("n_tokens"), *[F.col("__p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)], F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def resample(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], train_limit: int = 4000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every row as often as its copies say; the cases are those of mix().

    The posteriors are computed anew beside the texts, so texts are neither shuffled nor joined.
    """
    model, wanted = _plan(docs, labelled, targets, train_limit, doc_id, text)
    if model is None:
        return docs
    members = persisted(with_posteriors(docs.select(F.col(text).alias("__text")), model, "__text").drop("__text"), "mixing-members")
    steps = fit_rates(members, wanted)
    out = _rated(with_posteriors(docs, model, text), steps, F.col(doc_id))
    # a filter on __copies, also one inferred from an inner explode, would be pushed below and compute it all twice
    return out.withColumn("__one", F.explode_outer(F.array_repeat(F.lit(1), F.col("__copies")))).where("__one is not null").select(*docs.columns)
