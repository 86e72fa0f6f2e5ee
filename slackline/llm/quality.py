"""Quality by hierarchical empirical Bayes: a document's own evidence with that of its site and path.

A logistic model on style features of the whole text gives each document's evidence. Grouped sums of
it give every site's posterior quality, shrunk toward the global prior, and every path's (a part of a
site), shrunk toward its site's. How strongly is learned from how much the groups differ, so a
sparse site hardly moves its documents. A document's own evidence is left out of its site's and its path's, so it
counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import hash_sample, persisted, small_batches

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 capital, 3 digit, 4 blank, 5 sentence mark
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[0x80:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[0x20, *range(9, 14)]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
N_FEATURES = 14
#: Groups broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_GROUPS = 100_000


def features(text: str | None) -> np.ndarray:
    """Style of a whole text: shares of kinds of characters, runs, repetition, lengths of words and lines."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        out[0] = 1
        return out
    b = np.frombuffer(raw, np.uint8)
    kind = _KIND[b]
    n = np.bincount(kind, minlength=6)
    seen = max(1, len(b) - n[4])
    words = raw.split()
    blanks = kind == 4
    starts = np.flatnonzero(np.diff(blanks.astype(np.int8), prepend=np.int8(1)) == -1)
    odd_end = np.count_nonzero((kind[:-1] == 0) & blanks[1:]) + (kind[-1] == 0)
    lengths = np.diff(np.append(starts, len(b)))
    lines = raw.split(b"\n")
    out[1] = n[0] / seen
    out[2] = n[2] / max(1, n[1] + n[2])
    out[3] = n[3] / seen
    out[4] = n[5] / seen
    out[5] = odd_end / max(1, len(words))
    out[6] = np.log1p(len(words))
    out[7] = len(set(words)) / max(1, len(words))
    out[8] = np.count_nonzero(b[1:] == b[:-1]) / len(b)
    out[9] = np.mean([w == v for w, v in zip(words, words[1:])]) if len(words) > 1 else 0
    out[10] = np.log1p(lengths.mean()) if len(lengths) else 0
    out[11] = len(set(lines)) / len(lines)
    out[12] = np.count_nonzero(kind[starts] == 2) / max(1, len(starts))
    out[13] = (n[1] + n[2]) / seen
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the constant last) by Newton steps with a ridge penalty."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def expanded(x: np.ndarray) -> np.ndarray:
    """With squares, so that both extremes of a share can count against a text."""
    return np.concatenate([x, x * x], axis=1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def style(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts])


def learn(docs: DataFrame, labels: DataFrame, train_limit: int, doc_id: str, text: str, label: str) -> tuple | None:
    """Fit on at most train_limit labelled documents, those with the smallest hashes of their ids.

    Of a document with several labels the least counts, of a doc_id with several texts the smallest. None without both kinds of label.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("__d"), F.col(label).cast("double").alias("__y")).where(F.col("__d").isNotNull() & F.col("__y").isNotNull())
    known = hash_sample(known.groupBy("__d").agg(F.min("__y").alias("__y")), train_limit, "__d")
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), F.col("__id") == F.col("__d"))  # train_limit rows at most
    rows = rows.groupBy("__id").agg(F.min("__text").alias("__text"), F.min("__y").alias("__y"))  # one text of an id
    got = rows.select(style("__text").alias("x"), "__y", "__id").orderBy("__id").collect()
    y = np.array([r["__y"] > 0 for r in got], float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return fit_logistic(expanded(np.array([r["x"] for r in got])), y)


def evidence(spark, model: tuple | None):
    """A column function from text to the log odds of good quality by style alone."""

    @F.pandas_udf("double")
    def log_odds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model is None or not len(texts):
                yield pd.Series(np.zeros(len(texts)))
                continue
            mean, scale, w = model
            x = (expanded(np.array([features(t) for t in texts])) - mean) / scale
            yield pd.Series(np.clip(x @ w[:-1] + w[-1], -20, 20))

    return log_odds


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _prob(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strength(groups: DataFrame, prior: Column) -> float:
    """How many documents the prior is worth, by the method of moments over group means: little
    where groups differ more than the noise of their own size explains, much where they don't."""
    m = F.col("s") / F.col("n")
    r = groups.where("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (m - prior) ** 2).alias("between"), F.sum(F.col("q") - F.col("n") * m * m).alias("within"), F.count("*").alias("k")).first()
    if not r["k"] or not r["n"] or r["n"] <= r["k"]:
        return 100.0
    noise = max(r["within"], 0.0) / (r["n"] - r["k"])
    spread = max(r["between"] / r["n"] - noise * r["k"] / r["n"], 1e-6)
    return float(min(max(noise / spread, 1.0), 10_000.0))


def score_quality(docs: DataFrame, labels: DataFrame, train_limit: int = 4000, doc_id: str = "doc_id", text: str = "text", site: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """(doc_id, site, path, log_odds, site_quality, path_quality, quality, keep), one row per row of docs.

    quality is the probability that combines the document's log odds with its path's posterior; both posteriors are
    without the document itself; keep is quality >= 0.5. A null text has the evidence of an
    empty one; a null site or path is a group of its own, apart from an empty one; without usable labels all evidence is 0 and
    quality the prior 0.5. Repeated rows are rows of their own; ties (exactly 0.5) are kept; an empty
    table gives no rows. Other columns of docs and labels are not read. At most train_limit labelled
    documents' features are gathered to fit the model.

    The features are computed once into a table in the shared folder; group sums have a partial
    aggregate, so a site with any share of the rows is no hot task, and the group table joins by
    broadcast only under Spark's size threshold, otherwise by a join that adaptive execution splits.
    """
    model = learn(docs, labels, train_limit, doc_id, text, label)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).cast("string").alias("site"), F.col(path).cast("string").alias("path"), F.col(text).alias("__text"))
    base = persisted(base.withColumn("log_odds", evidence(docs.sparkSession, model)("__text")).drop("__text"), "quality-evidence")
    return combined(base)


def hierarchy(base: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(sums of every path and of its site, the global prior, its strength for sites, a site posterior's strength
    for its paths) over (site, path, log_odds)."""
    p = _prob(F.col("log_odds"))
    sums = (F.sum(p).alias("s"), F.sum(p * p).alias("q"), F.count("*").alias("n"))
    paths = persisted(base.groupBy("site", "path").agg(*sums), "quality-paths")
    sites = paths.groupBy(F.col("site").alias("__site")).agg(*(F.sum(c).alias(f"site_{c}") for c in ("s", "q", "n")))
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = total["s"] / total["n"] if total["n"] else 0.5
    k_site = strength(sites.select(*(F.col(f"site_{c}").alias(c) for c in ("s", "q", "n"))), F.lit(prior))
    joined = paths.join(sites, F.col("site").eqNullSafe(F.col("__site"))).drop("__site")
    joined = joined.withColumn("site_quality", (F.col("site_s") + k_site * prior) / (F.col("site_n") + k_site))
    joined = persisted(joined.select(F.col("site").alias("__site"), F.col("path").alias("__path"), "s", "q", "n", "site_s", "site_n", "site_quality"), "quality-groups")
    return joined, prior, k_site, strength(joined, F.col("site_quality"))


def posteriors(own: Column, prior: float, k_site: float, k_path: float) -> tuple[Column, Column]:
    """(site's, path's) posterior without the document of probability own, from the columns of hierarchy()."""
    site = (F.col("site_s") - own + k_site * prior) / (F.col("site_n") - 1 + k_site)
    return site, (F.col("s") - own + k_path * site) / (F.col("n") - 1 + k_path)


def combined(base: DataFrame) -> DataFrame:
    """The posteriors of (doc_id, site, path, log_odds)."""
    groups, prior, k_site, k_path = hierarchy(base)
    rows = base.join(groups, F.col("site").eqNullSafe(F.col("__site")) & F.col("path").eqNullSafe(F.col("__path")))
    site, path = posteriors(_prob(F.col("log_odds")), prior, k_site, k_path)
    rows = rows.select("doc_id", "site", "path", "log_odds", site.alias("site_quality"), path.alias("path_quality"))
    quality = _prob(F.col("log_odds") + _odds(F.col("path_quality")) - _odds(F.lit(prior)))
    return rows.withColumn("quality", quality).withColumn("keep", F.col("quality") >= 0.5)


def keep_good(docs: DataFrame, labels: DataFrame, train_limit: int = 4000, doc_id: str = "doc_id", text: str = "text", site: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs that score_quality() keeps, with their columns. Texts aren't shuffled: a
    document's evidence is computed anew beside it, and only the group sums join it."""
    model = learn(docs, labels, train_limit, doc_id, text, "quality")
    group = lambda c: F.col(c).cast("string")
    log_odds = evidence(docs.sparkSession, model)
    base = persisted(docs.select(group(site).alias("site"), group(path).alias("path"), log_odds(F.col(text)).alias("log_odds")), "quality-evidence")
    groups, prior, k_site, k_path = hierarchy(base)
    groups = groups.select(F.struct("__site", "__path").alias("__key"), F.struct("s", "n", "site_s", "site_n").alias("__sums"))
    rows = docs.withColumn("__log_odds", log_odds(F.col(text))).withColumn("__group", F.struct(group(site), group(path)))
    if groups.count() <= MAX_BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    rows = rows.join(groups, F.col("__group").eqNullSafe(F.col("__key")))
    own = _prob(F.col("__log_odds"))
    s, n, site_s, site_n = (F.col(f"__sums.{c}") for c in ("s", "n", "site_s", "site_n"))
    others = (s - own + k_path * (site_s - own + k_site * prior) / (site_n - 1 + k_site)) / (n - 1 + k_path)
    return rows.where(_prob(F.col("__log_odds") + _odds(others) - _odds(F.lit(prior))) >= 0.5).select(*docs.columns)
