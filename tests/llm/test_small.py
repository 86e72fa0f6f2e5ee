"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slackline.llm import jaccard_join, langid, license_scan, mixing, packing, pstable, quality, url_filter, warc
from slackline.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOCS)
    if extra:  # names that the operators use inside or return
        for c in ("token", "doc", "n", "score", "labels", "component_id", "piece", "length", "rate", "copies", "site", "path", "keep", "lang_pred", "base_labels"):
            df = df.withColumn(c, F.lit("x"))
    return df


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


# --- components -----------------------------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (7, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- URL filter -----------------------------------------------------------------------------------

RULES = [url_filter.UrlRule.parse(*r) for r in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("org/fr/", "block"))]


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/de/#y", "example.net", "/de/", "net/", "block"),
        ("https://myexample.com/de/", "myexample.com", "/de/", None, "allow"),
        ("https://example.com/de", "example.com", "/de", None, "allow"),
        ("http://x.org/fr/é", "x.org", "/fr/é", "org/fr/", "allow"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://ÄB.net?q=/en/", "Äb.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://" + "a." * 500 + "net/" + "p" * 5000, "a." * 500 + "net", "/" + "p" * 5000, "net/", "block"),
    ],
)
def test_url_cases(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "old")], "page_id long, url string, host string")
    rows = url_filter.judge_urls(df, RULES, keep=["page_id", "host"]).collect()
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows] == [(1, host, path, rule, verdict)]


def test_url_collisions_and_empty(spark, tmp_path):
    index = url_filter.DigestArray(*url_filter.build(RULES, str(tmp_path)))
    at = index.probe(np.array([index.keys[0], index.keys[0]], np.uint64), [b"another", index.text(0)[1:]])
    assert at.tolist() == [-1, 0]
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge_urls(one, [], default="block").first().verdict == "block"


# --- vectors --------------------------------------------------------------------------------------


def brute_links(vectors, cosine):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in vectors}
    for a, b in itertools.combinations(ok, 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / math.sqrt(ok[a] @ ok[a]) / math.sqrt(ok[b] @ ok[b]) >= cosine:
            links[a].add(b)
            links[b].add(a)
    comp = {}
    for i in sorted(links):
        if i in comp:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += links[x]
    return links, comp


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(40, 300):  # groups of near copies, one of them large
        c = base[0] if i < 180 else base[i % 10]
        out.append((i, (c * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.02).tolist()))
    out += [(i, base[1].tolist()) for i in range(300, 330)]  # equal ones
    out += [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, []), (405, [float("inf")] * 16), (406, [1.0, 2.0]), (407, [2.0, 4.0])]
    return out


def test_near_vectors_against_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("n_links", F.lit("old"))
    rows = pstable.near_vectors(df, cosine=0.9, recall=0.9999, block_rows=32).collect()
    links, comp = brute_links(vectors, 0.9)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {i: (len(links[i]), comp[i], comp[i] == i) for i, _ in vectors}
    assert len(rows) == len(vectors)


def test_near_vectors_empty_and_null_ids(spark):
    shape = "vec_id long, embedding array<float>"
    assert pstable.near_vectors(spark.createDataFrame([], shape)).count() == 0
    rows = pstable.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0])], shape)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in rows) == [(-1, 0, None, False), (2, 1, 2, True), (3, 1, 2, False)]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 24)) * rng.uniform(0.2, 3, (800, 1))
    x[50:60] = x[7]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = pstable.SearchPlan(projections=4, visit=0.8, query_rows=10, least=20, step=3)
    got = pstable.nearest(df, df.where("vec_id % 20 = 0"), k=20, plan=plan).toPandas()
    found = {q: g.sort_values("rank") for q, g in got.groupby("query_id")}
    assert set(found) == set(range(0, 800, 20))
    hits = 0
    for q, g in found.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(800), -score)) if i != q][:20]
        hits += len(set(best) & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 21))
        assert np.allclose(g.score, score[g.vec_id], rtol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
    assert hits / 20 / len(found) >= 0.9


def test_nearest_visits_only_its_buckets(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(i % 7, (3 * x[i % 7]).tolist()) for i in range(30)] + [(700, [1.0, 2.0])], "vec_id long, embedding array<float>")
    df = df.withColumn("score", F.lit("old"))
    whole = pstable.nearest(df, df.where("vec_id % 20 = 0"), k=5, plan=pstable.SearchPlan(projections=4, visit=1.0, least=50, step=4)).collect()
    x = x.astype(np.float32).astype(float)
    of = lambda i: [x[i], (3 * x[i]).astype(np.float32).astype(float)] if i < 7 else [x[i]]
    for q in range(0, 600, 20):
        top = {i: max(a @ b for a in of(i) for b in of(q)) for i in range(600) if i != q}
        best = sorted(top, key=lambda i: (-top[i], i))[:5]
        assert [r.vec_id for r in sorted(whole, key=lambda r: r["rank"]) if r.query_id == q] == best
    few = pstable.nearest(df, df.where("vec_id = 40"), k=600, plan=pstable.SearchPlan(projections=4, visit=0.05)).count()
    assert 20 <= few <= 400


def test_merge_counts_an_id_once():
    s, i = np.full((2, 3), -np.inf), np.full((2, 3), -1, np.int64)
    pstable._merge(s, i, np.array([0, 0, 0, 1]), np.array([5, 5, 4, 9]), np.array([1.0, 3.0, 3.0, 0.5]), 3)
    pstable._merge(s, i, np.array([0, 0]), np.array([7, 8]), np.array([2.0, 9.0]), 3)
    assert i.tolist() == [[8, 4, 5], [9, -1, -1]] and s[0].tolist() == [9.0, 3.0, 3.0]


def test_nearest_fewer_candidates_and_none(spark):
    shape = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.5, 0.5])], shape)
    rows = pstable.nearest(df, df.where("vec_id = 0"), k=5, plan=pstable.SearchPlan(projections=2, visit=1.0)).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1, 5.0), (2, 2, 1.5)]
    none = spark.createDataFrame([], shape)
    assert pstable.nearest(none, none).count() == 0
    assert pstable.nearest(none, df).count() == 0


# --- packing --------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(words(i, int(n))), "en", "s") for i, n in enumerate(rng.integers(1, 60, 80))]
    rows += [(100, None, None, None), (101, "", "en", "s"), (102, " ".join(words(9, 3000)), "en", "s"), (103, "a <|endoftext|> b \n\t é 漢字 \U0001f600", "en", "s"), (104, "x" * 30000, "en", "s"), (None, "no id", "en", "s"), (3, rows[3][1], "en", "s")]
    got = packing.pack(docs(spark, rows, extra=True), capacity=128).toPandas()
    want = [np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t, _, _ in rows]
    assert got.length.sum() == sum(map(len, want)) and got.length.max() <= 128
    for (i, _, _, _), ids in zip(rows, want):
        own = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values(["piece", "sequence_id"])
        if i == 3:
            own = own[own.groupby("piece").cumcount() == 0]
        assert b"".join(own.ids) == ids.tobytes()
        assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and (own.length.iloc[1:] == 128).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(x) for x in own.ids]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() and g.length.sum() <= 128
    assert packing.pack(docs(spark, [])).count() == 0


def one_by_one(sizes, capacity):
    """Number of sequences of best fit, longest first."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - s)
    return len(gaps)


@pytest.mark.parametrize("case", ["spread", "equal", "tiny", "one long", "halves"])
def test_best_fit_rounds(spark, case, monkeypatch):
    rng = np.random.default_rng(4)
    sizes = {"spread": rng.integers(1, 129, 1500), "equal": np.full(400, 37), "tiny": rng.integers(1, 4, 600), "one long": np.append(127, np.full(300, 3)), "halves": np.repeat([64, 65], 50)}[case]
    monkeypatch.setattr(packing, "SWEEP_ROWS", 100)  # several tasks
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "pid long, size int")
    got = packing.best_fit(df, 128).toPandas()
    assert sorted(got.pid) == list(range(len(sizes)))
    got["size"] = sizes[got.pid]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g["size"][:-1]]).tolist() and g["size"].sum() <= 128
    assert got.sequence_id.nunique() <= one_by_one(sizes.tolist(), 128) * 1.01 + 1


def test_matched_is_a_stack():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 60):
        piece = rng.random(n) < 0.5
        stack, pairs, alone = [], set(), []
        for i, p in enumerate(piece):
            if not p:
                stack.append(i)
            elif stack:
                pairs.add((i, stack.pop()))
            else:
                alone.append(i)
        a, b, c, d = packing.matched(piece)
        assert set(zip(a.tolist(), b.tolist())) == pairs and c.tolist() == alone and d.tolist() == stack


def test_resolved_like_one_sweep():
    counts = [(0, 2, 5), (1, 3, 1), (2, 2, 0), (3, 9, 4)]
    stack, want = [], []
    for part, pieces, gaps in counts:
        want += [((part, r), stack.pop()) for r in range(pieces) if stack]
        stack += [(part, r) for r in range(gaps)]
    got = [((p, first + i), (owner, top - i)) for p, first, last, owner, top in packing.resolved(counts) for i in range(last - first + 1)]
    assert got == want


# --- n-gram Jaccard join --------------------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            comp[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def jaccard_rows():
    rng = np.random.default_rng(8)
    common = words(77, 30)
    rows, i = [], 0
    for g in range(12):  # groups of edited copies, around the threshold
        base = words(g, 60 + 40 * (g % 4))
        for _ in range(14):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = f"e{int(rng.integers(0, 10**6))}"
            rows.append((i, " ".join(w), "en", "s"))
            i += 1
    for g in range(60):  # one passage in many documents
        rows.append((i, " ".join(common + words(1000 + g, 4 + g)), "en", "s"))
        i += 1
    rows += [(i + 1, None, None, None), (i + 2, "", "en", "s"), (i + 3, " \t\n ", "en", "s"), (i + 4, "One two", "en", "s"), (i + 5, "one\x0btwo", "en", "s"), (i + 6, "one two three four five", "en", "s"), (i + 7, "ONE TWO three four five", "en", "s"), (i + 8, "é É", "en", "s")]
    rows.append((i + 9, "Z" * 3_000_000, "en", "s"))
    rows.append((i + 10, " ".join(words(5, 100_000)), "en", "s"))
    rows.append((i + 11, " ".join(words(5, 100_000)[:90_000]), "en", "s"))
    return rows


@pytest.mark.parametrize("plan", [jaccard_join.JoinPlan(), jaccard_join.JoinPlan(cells=64, parts=4, most=8, verify_cost=5.0, block_rows=4, star_rows=3), jaccard_join.JoinPlan(most=1)])
def test_jaccard_against_brute_force(spark, plan):
    rows = jaccard_rows()
    got = jaccard_join.jaccard_classes(docs(spark, rows, extra=True), plan).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows)


def test_jaccard_repeated_ids_with_different_texts(spark):
    text = {k: " ".join(words(i, 60)) for i, k in enumerate("ABXY")}
    more = {k: v + " more" for k, v in text.items()}
    rows = [(1, text["A"]), (1, text["B"]), (2, more["B"]), (3, more["A"]), (10, text["X"]), (15, text["X"]), (15, text["Y"]), (16, more["Y"]), (16, None), (20, "alone"), (20, None), (None, text["A"])]
    got = jaccard_join.jaccard_classes(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (10, 10), (15, 10), (15, 10), (16, 10), (16, 10), (20, 20), (20, 20)]


def test_jaccard_keys_that_clash(spark, monkeypatch):
    rows = [(i, " ".join(words(i // 2, 40) + ["x"] * (i % 2)), "en", "s") for i in range(12)]
    keys = jaccard_join.keys_of

    def poor(sets):
        a, b = keys(sets)
        return a % 3, b

    monkeypatch.setattr(jaccard_join, "keys_of", poor)
    assert sorted(jaccard_join.node_keys([np.array([k], np.uint64) for k in range(9)], [0, 1, 2]).tolist()) == sorted(keys([np.array([k], np.uint64) for k in range(9)])[1].tolist())
    monkeypatch.undo()
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(12)}


def test_jaccard_threshold_null_ids_and_empty(spark):
    a = [f"t{k}" for k in range(13)]  # 9 shingles; one more word makes 10: 9 / 10; two more: 9 / 11
    rows = [(1, " ".join(a), "", ""), (2, " ".join(a + ["x"]), "", ""), (3, " ".join(a + ["y", "z", "q"]), "", ""), (None, " ".join(a), "", ""), (1, " ".join(a), "", "")]
    got = jaccard_join.jaccard_classes(docs(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 9, -1), (1, 9, 1), (1, 9, 1), (2, 10, 1), (3, 12, 3)]
    assert jaccard_join.jaccard_classes(docs(spark, [])).count() == 0


# --- WARC -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    import base64
    import hashlib

    trap = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\nrest"
    rows = [(1, "a", "<p>é</p>"), (2, "b", None), (3, "c", ""), (4, None, "<p>é</p>"), (5, "d", trap), (6, "e", trap * 2), (7, "f", "x" * 200_000), (8, "g", "\r\n\r\n\n"), (9, "h", trap), (10, "i", "\r"), (-3, "j", "neg")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: r for r in warc.archive_round_trip(df).collect()}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    assert set(got) == {r[0] for r in rows}
    for i, _, h in rows:
        raw = (h or "").encode()
        ref = first[h or ""]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if ref == i else "revisit", None if ref == i else ref)
        assert r.intact
    assert {r.record_type for r in warc.archive_round_trip(df, least_bytes=10**6).collect()} == {"response"}
    assert warc.archive_round_trip(df.where("false")).count() == 0


def test_warc_null_and_repeated_ids_and_rolling(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 16)
    monkeypatch.setattr(warc, "RECORDS", 20)
    rows = [(None, "same"), (5, "same"), (5, "same"), (4, "same"), (9, "other"), (9, "else"), (None, None)] + [(100 + i, f"{i} " + "y" * (700 * i)) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    got = warc.archive_round_trip(df).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = lambda i: sorted((r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id == i)
    assert by(5) == [("revisit", 4, 4)] * 2 and by(4) == [("response", None, 4)] and by(None) == [("response", None, 0), ("response", None, 4)]
    assert by(9) == [("response", None, 4), ("response", None, 5)]
    sizes = {}
    for r in got:
        sizes[r.file] = sizes.get(r.file, 0) + (r.payload_bytes if r.record_type == "response" else 0)
    assert len(sizes) > 10 and max(sizes.values()) <= max(1 << 16, max(r.payload_bytes for r in got))


def test_warc_chain_breaks(spark, tmp_path):
    good = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(good * 3 + b"junk" + good)  # what follows junk can't be reached
    (tmp_path / "b.warc").write_bytes(b"junk" + good)
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r.file[-6:], r.offset) for r in rows) == [("a.warc", k * len(good)) for k in range(3)]


# --- language ID ----------------------------------------------------------------------------------


def language_rows(n=240):
    lex = {"en": ["the", "and", "thing", "order", "with", "under"], "de": ["der", "und", "über", "schon", "nicht", "für"], "fr": ["être", "une", "où", "leur", "avec", "déjà"]}
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(lex[la], 12)), la, "s") for i, la in enumerate(rng.choice(list(lex), n))]


def test_langid(spark):
    rows = language_rows()
    rows += [(1000, None, "en", None), (1001, "", "en", "s"), (1002, "123 !!", "de", "s"), (1003, "THE AND " * 50_000, None, "s"), (1004, "ü" * 50_000, "de", "s"), (1005, "漢字 仮名", None, "s"), (None, "the and", None, "s")]
    got = langid.identify(docs(spark, rows, extra=True), train_limit=100).toPandas()
    assert len(got) == len(rows) and (got.score.between(0, 1)).all() and "token" in got.columns
    by = got.set_index("doc_id")
    for i in (1000, 1001, 1002):
        assert (by.lang_pred[i], by.score[i]) == ("und", 0.0)
    assert by.lang_pred[1003] == "en" and by.lang_pred[1005] in ("en", "de", "fr")
    held = [i for i, *_ in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert (by.lang_pred[held] == by.lang[held]).mean() >= 0.98
    blind = langid.identify(docs(spark, [(i, t, None, s) for i, t, _, s in rows])).toPandas()
    assert set(blind.lang_pred) == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def segmentations(known, codes):
    return 1.0 if not codes else sum(known.get(tuple(codes[:n]), 0.0) * segmentations(known, codes[n:]) for n in range(1, len(codes) + 1))


def toy_model():
    parts = [[1], [2], [3], [1, 2], [2, 3], [2, 2], [2, 3, 2, 3, 2, 2, 3, 3]]
    pieces = langid.Pieces.of({"▁": 1, "a": 2, "b": 3}, parts)
    p = np.random.default_rng(0).uniform(0.05, 0.3, len(parts))[:, None]
    model = langid.LanguageModel(["x"], pieces, p, np.ones(1))
    return model, {tuple(k): p[np.searchsorted(pieces.keys, langid.Pieces.key(k)), 0] for k in parts}


def test_forward_sums_all_segmentations():
    model, known = toy_model()
    for word in ("ab", "aab", "abab", "b", "aaaa", "ababaabb", "aababaabba"):
        codes = [1] + [{"a": 2, "b": 3}[c] for c in word]
        assert np.exp(model.word_scores([word])[0, 0]) == pytest.approx(segmentations(known, codes))


def test_long_words_by_chunks(monkeypatch):
    model, _ = toy_model()
    rng = np.random.default_rng(1)
    words_ = ["".join(rng.choice(["a", "b"], n)) for n in (39, 40, 41, 77, 200)]
    whole = model.word_scores(words_)
    monkeypatch.setattr(langid, "CHUNK", 10)
    assert np.allclose(model.word_scores(words_), whole, rtol=1e-10)
    monkeypatch.undo()
    long = model.word_scores(["ab" * 100_000])[0, 0]
    assert np.isfinite(long) and long == pytest.approx(50 * model.word_scores(["ab" * 2000])[0, 0], rel=0.01)


def test_learning_counts_every_use():
    model, known = toy_model()
    used = model.learn({"ababaabb": 2, "b": 1}, 0)
    at = lambda k: np.searchsorted(model.pieces.keys, langid.Pieces.key(k))
    letters = sum(used[at(list(k))] * len(k) for k in known)
    assert letters == pytest.approx(2 * 9 + 2)


def test_letters_are_unicode_letters(spark):
    assert langid.words_of("x²½Ⅷ٣ é_ß 9a") == ["x", "é", "ß", "a"]
    rows = language_rows(60) + [(500, "½ ² Ⅷ ٣", "en", "s")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, rows)).collect()}
    assert got[500] == "und" and set(got.values()) == {"en", "de", "fr", "und"}


@pytest.mark.parametrize("ids", ["null", "one", "few"])
def test_samples_of_null_and_repeated_ids(spark, ids):
    n = 20_000
    key = {"null": F.lit(None).cast("long"), "one": F.lit(8).cast("long"), "few": (F.col("id") % 3 * 5 + 3).cast("long")}[ids]
    df = spark.range(n).select(key.alias("doc_id"), F.concat(F.lit("word "), F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("text"), F.lit("en").alias("lang"))
    trained = df.where(~langid.held_out(F.col("doc_id"))).count()
    assert trained and len(langid.sample(df, 3000)) == 3000
    assert len(langid.sample(df, 3000, most_bytes=60)) == 10
    assert len(langid.sample(df.limit(50), 3000)) == df.limit(50).where(~langid.held_out(F.col("doc_id"))).count()


def test_langid_keeps_every_letter(spark):
    hangul = [chr(c) for c in range(0xAC00, 0xAC00 + 1500)]
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 1500)]
    texts = [("".join(x[i : i + 5]), la) for x, la in ((hangul, "ko"), (han, "zh")) for i in range(0, 1500, 5)]
    model = langid.fit(texts)
    assert all(c in model.pieces.letters for c in hangul + han)
    assert len(set(model.pieces.keys)) == len(model.pieces.keys)
    codes = model.pieces.coded(["▁" + hangul[-1], "▁" + han[-1]])
    assert (codes != langid.STRANGE).all() and (model.pieces.entries(codes)[3] < len(model.pieces.keys)).all()
    ko, zh = model.word_scores([hangul[-1] + hangul[3], han[-1] + han[3]])
    assert ko[0] > ko[1] + 1 and zh[1] > zh[0] + 1
    assert (model.pieces.coded(["\u1e4d\U0001e900"]) == langid.STRANGE).any()


# --- quality --------------------------------------------------------------------------------------


def quality_rows():
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(300):
        w = words(i, 40)
        bad = i % 4 == 0
        rows.append((i, " ".join(f"{x}$$$" for x in w) if bad else " ".join(w).capitalize() + ".", str(rng.choice(["en", "de"])), "hot" if i % 3 == 0 else f"s{i % 7}"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, int(i % 10 == 0)))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    rows += [(900, None, None, None), (901, "", "en", "s1"), (902, " ".join(words(3, 60_000)) + ".", "en", "s1"), (None, "Plain words here.", "en", None), (5, rows[5][1], rows[5][2], rows[5][3])]
    lab = spark.createDataFrame(labels + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = quality.score_quality(docs(spark, rows, extra=True), lab).toPandas()
    assert len(got) == len(rows) and got.quality.between(0, 1).all()
    by = got[got.doc_id < 300].drop_duplicates("doc_id").set_index("doc_id")
    assert (by.keep == np.array([i % 4 != 0 for i in by.index])).all()
    kept = quality.keep_good(docs(spark, rows, extra=True), lab).toPandas()
    assert sorted(kept.doc_id.fillna(-1)) == sorted(got.doc_id[got.keep].fillna(-1)) and list(kept.columns) == docs(spark, [], extra=True).columns
    none = quality.score_quality(docs(spark, rows), lab.where("false")).toPandas()
    assert np.allclose(none.quality, 0.5) and none.keep.all()
    assert quality.score_quality(docs(spark, []), lab).count() == 0


def test_quality_against_brute_force(spark):
    rng = np.random.default_rng(12)
    base = [(i, [None, "", "a", "b", f"s{i}"][int(rng.integers(0, 5))], [None, "", "x"][int(rng.integers(0, 3))], float(rng.normal(0, 2))) for i in range(300)]
    got = {r.doc_id: r for r in quality.combined(spark.createDataFrame(base, "doc_id long, site string, path string, log_odds double")).collect()}
    p = {i: 1 / (1 + math.exp(-x)) for i, _, _, x in base}
    prior = sum(p.values()) / len(p)

    def worth(groups, toward):
        many = [(g, m) for g, m in groups.items() if len(m) > 1]
        n, k = sum(len(m) for _, m in many), len(many)
        within = sum(sum((x - np.mean(m)) ** 2 for x in m) for _, m in many)
        between = sum(len(m) * (np.mean(m) - toward(g)) ** 2 for g, m in many)
        noise = within / (n - k)
        return min(max(noise / max(between / n - noise * k / n, 1e-6), 1), 10_000)

    sites, paths = {}, {}
    for i, s, q, _ in base:
        sites.setdefault(s, []).append(p[i])
        paths.setdefault((s, q), []).append(p[i])
    ks = worth(sites, lambda g: prior)
    post = {s: (sum(m) + ks * prior) / (len(m) + ks) for s, m in sites.items()}
    kp = worth(paths, lambda g: post[g[0]])
    for i, s, q, x in base:
        site = (sum(sites[s]) - p[i] + ks * prior) / (len(sites[s]) - 1 + ks)
        path = (sum(paths[s, q]) - p[i] + kp * site) / (len(paths[s, q]) - 1 + kp)
        want = 1 / (1 + math.exp(-(x + math.log(path / (1 - path)) - math.log(prior / (1 - prior)))))
        assert (got[i].site_quality, got[i].path_quality, got[i].quality) == pytest.approx((site, path, want))


def test_quality_on_held_out_labels(spark):
    rows, labels = quality_rows()
    shown = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.score_quality(docs(spark, rows), shown).collect()}
    assert np.mean([got[i] == (q == 1) for i, q, _ in labels if i % 3 == 0]) >= 0.95


def test_quality_shrinks_sparse_sites(spark):
    base = [(i, "big", "x", 3.0) for i in range(400)] + [(1000 + i, "low", "x", -3.0) for i in range(400)] + [(5000, "one", "x", -3.0)]
    got = quality.combined(spark.createDataFrame(base, "doc_id long, site string, path string, log_odds double")).toPandas()
    site = got.groupby("site").site_quality.first()
    assert site["low"] < 0.1 < 0.9 < site["big"] and site["one"] == pytest.approx(0.5, abs=0.01)  # its own evidence is left out


# --- licences -------------------------------------------------------------------------------------


def test_licenses_against_brute_force(spark):
    rng = np.random.default_rng(9)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "under the mit", "cc by", "license under the MIT license under the mit license"]
    rows = [(i, " ".join(words(i, 30)) + "\n" + "\n".join(rng.choice(lines, int(rng.integers(0, 4)))) + "\n" + " ".join(words(i + 500, 20)), "en", "s") for i in range(80)]
    rows += [(100, None, None, None), (101, "", "en", "s"), (102, "--- !!", "en", "s"), (103, "under theé mit license", "en", "s"), (104, "x " * 100_000 + "CC-BY-NC", "en", "s"), (105, " ".join(" ".join(p) for label, _, p in license_scan.NOTICES if label == "mit").upper() + " cc_by\x00nc", "en", "s"), (106, "redistribution and use in source and binary forms, with or without change, are allowed provided that the following conditions are met", "en", "s"), (107, "published under the terms of the GNU Affero General Public License", "en", "s"), (108, "redistribution and use in source or binary forms with or without modification are permitted provided that the following conditions are met", "en", "s"), (109, "of this software and associated documentation files the software", "en", "s"), (None, "cc by nc", "en", "s")]
    got = license_scan.scan_licenses(docs(spark, rows, extra=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        at, found = [], set()
        for label, phrase in license_scan.BASE:
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            found |= {label} if hits else set()
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)))
        assert found <= set(r.labels.split(",")) or not found
        assert ("gpl" in r.labels.split(",")) == ("gnu general public license" in " ".join(w))
    assert by[105].labels == "cc-by-nc,mit" and by[105].score == 1.0
    assert by[106].labels == "bsd" and by[107].labels == "agpl" and by[108].labels == "" and by[109].labels == ""
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0


# --- mixing ---------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rows, labels = quality_rows()
    rows += [(900, None, None, None), (901, "", "en", "s1"), (None, "plain words", "en", None), (5, rows[5][1], rows[5][2], rows[5][3])]
    lab = spark.createDataFrame([(i, "bad" if q == 0 else "fine") for i, q, _ in labels] + [(None, "bad")], "doc_id long, domain string")
    got = mixing.mix(docs(spark, rows, extra=True), lab, {"fine": 0.9, "bad": 0.1, "absent": 3.0}).toPandas()
    assert len(got) == len(rows) and (got.rate >= 0).all()
    total = got.n_tokens.sum()
    assert got.n_tokens.eq(0).sum() == 2
    share = {d: (got.rate * got.n_tokens * got[f"p_{d}"]).sum() / total for d in ("fine", "bad")}
    assert share["fine"] + share["bad"] == pytest.approx(1, abs=1e-4) and share["bad"] == pytest.approx(0.1 / 3.1 * 3.1 / 1.0, abs=2e-2)
    assert (np.abs(got.copies - got.rate) <= 1).all()
    again = mixing.resample(docs(spark, rows, extra=True), lab, {"fine": 0.9, "bad": 0.1})
    assert again.columns == docs(spark, [], extra=True).columns and again.count() == got.copies.sum()
    plain = mixing.mix(docs(spark, rows), lab.where("false"), {"fine": 1.0}).toPandas()
    assert plain.rate.eq(1).all() and plain.copies.eq(1).all()
    assert mixing.mix(docs(spark, []), lab, {"fine": 1.0}).count() == 0


def test_mixing_native_plan(spark):
    rows, labels = quality_rows()
    lab = spark.createDataFrame([(i, "bad" if q == 0 else "fine") for i, q, _ in labels], "doc_id long, domain string")
    plan = mixing.resample(docs(spark, rows), lab, {"fine": 0.9, "bad": 0.1})._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rates_out_of_reach_warn(spark):
    df = spark.createDataFrame([(10, [1.0, 0.0]), (10, [0.9, 0.1])], "__n long, __p array<double>")
    with pytest.warns(UserWarning, match="away from the targets"):
        steps = mixing.fit_rates(df, [0.0, 1.0], most=6)
    r = np.array([x.r for x in df.select(mixing.rate_of(steps).alias("r")).collect()])
    assert (r >= 0).all() and np.hypot(*((10 * r) @ [[1, 0], [0.9, 0.1]] - [0, 20])) <= np.hypot(19, -19)


def test_rates_against_numpy(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.5, 0.5, 0.5], 400)
    n = rng.integers(1, 900, 400)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "__n long, __p array<double>")
    steps = mixing.fit_rates(df, [0.7, 0.2, 0.1])
    r = np.ones(400)
    for v in steps:
        r = np.maximum(0, r - n * (p @ np.array(v)))
    got = np.array([x.r for x in df.select(mixing.rate_of(steps).alias("r")).collect()])
    assert np.allclose(got, r) and np.allclose((r * n) @ p / n.sum(), [0.7, 0.2, 0.1], atol=1e-5)
