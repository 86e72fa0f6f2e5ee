"""From documents to packed sequences: language, quality, near duplicates, mixture, packing.

Each stage reads what its predecessor wrote, takes its decisions over all of it, and (but for the
last) returns rows with the columns of documents. All stages keep extra columns, accept null in any
column and give no rows for no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.llm import jaccard_join, langid, mixing, packing, quality
from slackline.llm._shared import broadcast_if_small, persisted
from slackline.llm.components import components
from slackline.llm.queries import DOMAIN_TARGETS, table

#: A learned model, scores near half and repeated sampling have no SQL; tests use brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null texts, those without a letter and those that are less likely, letter
    by letter, than any text the languages were learned from go (another script, noise)."""
    texts = langid.sample(docs, 3000)
    predict = langid.predictor(spark, langid.fit(texts) if texts else None)
    if not texts:  # nothing to learn from: keep what has a letter
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.withColumn("__lang", predict(F.col("text"))).where(~F.col("__lang.strange")).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality is at least one half."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the smallest doc_id.

    A class is one of texts, not of ids: of rows that repeat a doc_id, each distinct text is judged for itself, and
    one row stays of those that are alike in words (that of the smallest hash of all columns). Texts without words
    and rows without a doc_id have no copies and stay, but rows that repeat an id without words are one. What goes is
    joined away: by broadcast if it is few, else by a shuffle.
    """
    plan = jaccard_join.JoinPlan()
    found = jaccard_join.links(docs, plan)
    classes = persisted(components(found.edges), "pipeline-classes")
    of = found.nodes.join(classes, "node").select("component", "node", "first")
    best = of.groupBy("component").agg(F.min_by("node", F.struct("first", "node")).alias("best"))
    lost = persisted(of.join(best, "component").where("node != best").select("node"), "pipeline-lost")
    stay = found.nodes.join(broadcast_if_small(lost, lost.count()), "node", "left_anti").select(F.col("first").alias("doc"), "node")
    rows = found.sets.where("doc is not null").groupBy("doc").agg(F.count("*").alias("rows"), F.max(F.col("n") == 0).alias("empty"))
    rows = rows.join(stay.select("doc").distinct().withColumn("stays", F.lit(True)), "doc", "left")
    gone = persisted(rows.where("rows = 1 and not empty and stays is null").select(F.col("doc").alias("__gone")), "pipeline-gone")
    repeated = persisted(rows.where("rows > 1").select(F.col("doc").alias("__repeated")), "pipeline-repeated")
    n = repeated.count()
    kept = docs.join(broadcast_if_small(gone, gone.count()), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    if n:
        few = broadcast_if_small(repeated, n)
        again = kept.join(few, F.col("doc_id").cast("long") == F.col("__repeated"), "left_semi")
        again = again.withColumn("__key", jaccard_join.node_key(plan, found.clash)("text")).groupBy("doc_id", "__key")
        again = again.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
        good = stay.select(F.col("doc").alias("__doc"), F.col("node").alias("__node"))
        again = again.join(good, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.col("__key") == F.col("__node")), "left")
        once = again.where("__key is null or __node is not null").select("__row.*")
        kept = kept.join(few, F.col("doc_id").cast("long") == F.col("__repeated"), "left_anti").unionByName(once)
    return kept


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says, so that the domains meet their target weights."""
    return mixing.resample(docs, mixing.quality_domains(table(spark, sf_dir, "labels")), DOMAIN_TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing to target weights", mixture),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = persisted(docs, "pipeline-stage")
    return docs
