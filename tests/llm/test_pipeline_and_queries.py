"""The registered queries on the smallest tables, against SQL or brute force; the pipeline's stages."""

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slackline.llm import queries as Q
from slackline.llm.queries import table

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = c.execute(Q.oracle_sql()[name]).df(), Q.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda d: sorted((tuple("" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in d[sorted(d.columns)].itertuples(index=False)))
    assert rows(want) == rows(got)


def texts(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


def test_op4(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Q.op4_best_fit_packing(spark, SF).toPandas()
    docs = texts(spark)
    for i, g in got.groupby("doc_id"):
        ids = np.array(tk.encode(docs[i].text or "", add_special_tokens=False).ids + [0], "<u4")
        g = g.sort_values("piece")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g.start, g.length)] == g.ids_crc32.tolist() and g.length.sum() == len(ids)
    assert set(got.doc_id) == set(docs)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.02 + 1


def test_op5(spark):
    sets = {}
    for i, r in texts(spark).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op5_ngram_jaccard_join(spark, SF).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_op3_op7_op8_op9_op10(spark):
    docs = texts(spark)
    lang = Q.op7_language_id(spark, SF).toPandas().set_index("doc_id")
    held = lang[lang.held_out]
    assert (held.lang_pred == [docs[i].lang for i in held.index]).mean() >= 0.97
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in lang.held_out.items())
    quality = Q.op8_quality_classifier(spark, SF).toPandas().set_index("doc_id")
    known = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert np.mean([(quality.keep[i] == (q == 1)) for i, q in known.items()]) >= 0.95
    mixed = Q.op3_source_mixing(spark, SF).toPandas()
    assert len(mixed) == len(docs) and (mixed.rate >= 0).all()
    found = Q.op9_license_scan(spark, SF).toPandas().set_index("doc_id")
    assert all(bool(found.labels[i]) or "License" not in (r.text or "") for i, r in docs.items())
    near = Q.op10_nearest_neighbours(spark, SF).toPandas()
    e = {r.vec_id: np.array(r.embedding, float) for r in table(spark, SF, "embeddings").collect()}
    hits = 0
    for q, g in near.groupby("query_id"):
        best = sorted((-(e[q] @ v), i) for i, v in e.items() if i != q)[:20]
        hits += len({i for _, i in best} & set(g.vec_id))
    assert hits / len(near) >= 0.9 and len(near) == 20 * sum(i % 20 == 0 for i in e)


def test_stages_on_odd_rows(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, token string, score string, keep string"
    good = "The and thing to heer the, anea. Eriner thanea with order."
    rows = [(1, good, "en", "s", 9, "t", "x", "y"), (1, good, "en", "s", 9, "t", "x", "y"), (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "t", "x", "y"), (4, "123", None, "s", 3, "t", "x", "y"), (None, "Der und nicht für über.", "de", None, None, None, None, None), (5, good + " more", "en", "s", 9, "t", "x", "y"), (6, "word " * 50_000, "en", "s", 9, "t", "x", "y")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, shape)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert data or out.count() == 0
        assert corpus_pipeline.packed(spark, docs, SF).count() == (0 if not data else len(data) + 24)
    docs = spark.createDataFrame(rows, shape)
    told = [r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()]
    assert sorted(x or -1 for x in told) == [-1, 1, 1, 5, 6]
    kept = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert sorted(x or -1 for x in kept) == [-1, 1, 2, 3, 4, 5, 6] or sorted(x or -1 for x in kept) == [-1, 1, 2, 3, 4, 6]
    other, third = (" ".join(f"{k}{i}" for i in range(40)) for k in "uv")  # ids that repeat with different texts
    twice = [(1, good), (1, other), (1, other), (2, other + " more"), (3, third), (4, third), (4, other), (4, None), (4, None), (None, third)]
    twice = spark.createDataFrame([(i, t, "en", "s", k, None, None, None) for k, (i, t) in enumerate(twice)], shape)
    kept = [(r.doc_id or -1, r.text) for r in corpus_pipeline.one_of_each_group(spark, twice, SF).collect()]
    assert sorted(kept, key=str) == sorted([(-1, third), (1, good), (1, other), (3, third), (4, None)], key=str)


def test_pipeline_keeps_clean_documents(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = texts(spark)
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    classes = {r.doc_id: r.component_id for r in Q.op5_ngram_jaccard_join(spark, SF).collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0 and docs[i].text and classes[i] == i]
    assert np.mean([i in set(out.doc_id) for i in clean]) >= 0.95
    assert not any(labels[i].quality == 0 for i in set(out.doc_id) if i in labels)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() and g.length.sum() <= 2048
