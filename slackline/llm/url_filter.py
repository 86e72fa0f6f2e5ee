"""URL filter over a sorted digest array.

Rules (a host, or a host and the start of a path) are kept as an array of sorted 64-bit xxhash
keys beside their full strings, in files that every executor maps into memory. Each url is turned
into the keys of all rules that could fit it: every suffix of its host with every rule's path
length. A vectorised binary search finds the keys; the stored strings settle collisions.
"""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rules in one array at most: about 16 bytes of index and the string for each, mapped, not loaded.
MAX_RULES = 50_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
VERDICT = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


@dataclass(frozen=True)
class UrlRule:
    """verdict is 'allow' or 'block'. host/path must be given as parsed: 'example.net', '/en/'."""

    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, text: str, verdict: str) -> UrlRule:
        host, slash, rest = text.partition("/")
        return cls(host, slash + rest, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """(host, path): the host with A-Z lower-cased up to / ? # or the end, the path up to ? # or the end.

    Both are empty for null and for urls without '://'.
    """
    if url is None:
        return b"", b""
    at = url.find(b"://")
    if at < 0:
        return b"", b""
    rest = url[at + 3 :]
    for stop in (b"?", b"#"):
        k = rest.find(stop)
        if k >= 0:
            rest = rest[:k]
    k = rest.find(b"/")
    return (rest.translate(_LOWER), b"") if k < 0 else (rest[:k].translate(_LOWER), rest[k:])


class DigestArray:
    """The mapped files of one rule list."""

    def __init__(self, keys: str, offsets: str, strings: str, meta: str):
        self.keys = np.memmap(keys, np.uint64, "r") if os.path.getsize(keys) else np.zeros(0, np.uint64)
        self.offsets = np.memmap(offsets, np.int64, "r")
        self.strings = np.memmap(strings, np.uint8, "r") if os.path.getsize(strings) else np.zeros(0, np.uint8)
        with open(meta) as f:
            self.path_lengths: list[int] = json.load(f)["path_lengths"]

    def text(self, i: int) -> bytes:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def probe(self, keys: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Index of the rule with each key and exactly that text, or -1."""
        out = np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else []
        for i in hit:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.text(k)[1:] == texts[i]:
                    out[i] = k
                    break
                k += 1
        return out


def build(rules: list[UrlRule], folder: str) -> list[str]:
    """Write the four files of a rule list; of rules with one text the first stays."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; one digest array holds {MAX_RULES} at most")
    unique: dict[bytes, bytes] = {}
    for r in rules:
        unique.setdefault(r.text.encode(), r.verdict[:1].encode())
    texts = sorted(unique, key=xxhash.xxh64_intdigest)
    body = [unique[t] + t for t in texts]
    files = {
        "keys": np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).tobytes(),
        "offsets": np.cumsum([0] + [len(b) for b in body], dtype=np.int64).tobytes(),
        "strings": b"".join(body),
        "meta": json.dumps({"path_lengths": sorted({len(r.path.encode()) for r in rules})}).encode(),
    }
    out = []
    tag = xxhash.xxh64_hexdigest(b"\n".join(body))
    for name, data in files.items():
        out.append(os.path.join(folder, f"urls-{tag}.{name}"))
        with open(out[-1], "wb") as f:
            f.write(data)
    return out


def judge_batch(urls: list[bytes | None], index: DigestArray, default: str) -> tuple[list, list, list, list]:
    hosts, paths, texts, owner = [], [], [], []
    for i, u in enumerate(urls):
        host, path = split_url(u)
        hosts.append(host)
        paths.append(path)
        if not host:
            continue
        at, suffixes = 0, [host]
        while (at := host.find(b".", at) + 1) > 0:
            suffixes.append(host[at:])
        for s in suffixes:
            for n in index.path_lengths:
                if n <= len(path):
                    texts.append(s + path[:n])
                    owner.append(i)
    found = index.probe(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64), texts)
    best: dict[int, tuple[int, int]] = {}
    for j in np.flatnonzero(found >= 0).tolist():
        best[owner[j]] = max(best.get(owner[j], (-1, -1)), (len(texts[j]), j))
    rule, verdict = [None] * len(urls), [default] * len(urls)
    for i, (_, j) in best.items():
        stored = index.text(int(found[j]))
        rule[i], verdict[i] = stored[1:], "allow" if stored[:1] == b"a" else "block"
    return hosts, paths, rule, verdict


def judge_urls(df: DataFrame, rules: list[UrlRule], url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """Each row's keep columns with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting
    rule decides, and where none fits the verdict is default. A null url, one without '://' and an
    empty path are judged like any other (host and path empty: no rule fits). Rows that repeat stay;
    an empty table gives no rows; only keep (default: all columns but url) and url are read. Columns
    of keep named like an output column are replaced by it.

    One narrow pass, no shuffle. The files reach executors through the file server and are mapped,
    so the tasks of one executor share their pages.
    """
    spark: SparkSession = df.sparkSession
    keep = [c for c in (df.columns if keep is None else keep) if c not in VERDICT.names and c != url]
    names = []
    for p in build(rules, tempfile.mkdtemp(prefix="urls-")):
        names.append(os.path.basename(p))
        if not os.path.exists(SparkFiles.get(names[-1])):  # names tell the content
            spark.sparkContext.addFile(p)

    def run(batches):
        index = DigestArray(*[SparkFiles.get(n) for n in names])
        for b in batches:
            col = b.column("__url")
            out = judge_batch(col.cast(pa.binary()).to_pylist(), index, default)
            cols = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [c.cast(pa.string()) for c in cols] + [pa.array(out[3], pa.string())], names=keep + VERDICT.names)

    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + VERDICT.fields)
    keep = [f.name for f in schema.fields if f.name not in VERDICT.names]
    return df.select(*[df[c] for c in keep], df[url].alias("__url")).mapInArrow(run, schema)
