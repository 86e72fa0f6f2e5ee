"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing needs no Python: a record is a binary column that the text sink writes as it stands (its
line end is the record's last byte). Reading: each task scans a file for every place that looks like
a record's start and emits (offset, offset of what follows by its own length). Pointer jumping from
each file's start, as joins whose number is the logarithm of the longest chain, then keeps only what
is reachable, so a record header inside a payload is never taken for a record.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import dropped, persisted, write_path

MAGIC = b"WARC/1.0\r\n"
#: RFC 4648 alphabet (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are exactly 32 letters, five bits each."""
    bits = F.sha1(payload)
    letters = []
    for k in range(8):  # 20 bits (5 hex digits) make 4 letters
        v = F.conv(F.substring(bits, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, payload, payload_bytes, payload_digest, refers_to): of equal payloads of at least
    least_bytes the smallest page_id is the response (refers_to null), the others refer to it.

    A null payload is empty; rows that repeat a page_id with one payload are responses each; a null
    page_id is a response. Payloads are equal if their SHA-256, SHA-1 and lengths are (two pages can be made to share
    a SHA-1). They aren't shuffled: digests are grouped (with a partial minimum, so a payload shared by any share of
    the pages is no hot task), and only digests that occur twice are joined back, by broadcast if Spark's size
    threshold allows.
    """
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.select("page_id", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    base = base.withColumn("strong", F.unhex(F.sha2("payload", 256)))
    again = base.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes", "strong").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = persisted(again, "warc-copies")
    joined = base.join(again, ["payload_digest", "payload_bytes", "strong"], "left")
    return joined.select("page_id", "payload", "payload_bytes", "payload_digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def record(row: DataFrame) -> Column:
    """The record of a row of with_revisits(), without its last line feed."""
    revisit = row["refers_to"].isNotNull()
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(row["page_id"].cast("string"), F.lit("")),
        F.lit(">\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), row["refers_to"].cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"),
        row["payload_digest"],
        F.lit("\r\nWARC-Payload-Length: "),
        row["payload_bytes"].cast("string"),
        F.lit("\r\nContent-Length: "),
        F.when(revisit, "0").otherwise(row["payload_bytes"].cast("string")),
        F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, F.lit(b"")).otherwise(row["payload"])
    # a binary value cast to a string keeps its bytes
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r")).cast("string")


#: Files roll at so many records and so many bytes, unless a single record is longer.
RECORDS, FILE_BYTES = 2000, 128 << 20
HEAD_BYTES = 1024


def size_classes(most: int) -> list[tuple[int, int, int]]:
    """(least, most payload bytes, records of a file) of classes of pages that are written apart: a file of a class
    can't exceed FILE_BYTES, as none of its records exceeds the class, and long pages don't make short ones' files few."""
    out, low, high = [], 0, FILE_BYTES // RECORDS - HEAD_BYTES
    while low <= most:
        out.append((low, high, max(1, FILE_BYTES // (high + HEAD_BYTES))))
        low, high = high + 1, 16 * high
    return out


def write_archives(rows: DataFrame, path: str) -> None:
    """Rows of with_revisits() as .warc files of bounded size, a folder for each class of sizes; no shuffle."""
    found = rows.agg(F.max("payload_bytes")).first()[0]
    for k, (low, high, records) in enumerate(size_classes(found if found is not None else 0)):
        own = rows.where(F.col("payload_bytes").between(low, high))
        own.select(record(own).alias("value")).write.option("maxRecordsPerFile", records).option("lineSep", "\n").text(f"{path}/class-{k}")


CANDIDATES = "file string, offset long, successor long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, intact boolean, first boolean"


def parse_head(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower()] = v.strip()
    return out


def candidates(content: bytes) -> list[dict]:
    """Everything in a file that looks like a record, with the place where the next would begin."""
    out = []
    at = content.find(MAGIC)
    while at >= 0:
        end = content.find(b"\r\n\r\n", at, at + 65536)
        if end >= 0:
            h = parse_head(content[at:end])
            size = h.get(b"content-length", b"")
            if size.isdigit():
                body, stop = end + 4, end + 4 + int(size)
                if content[stop : stop + 4] == b"\r\n\r\n":
                    number = lambda k: int(v) if (v := h.get(k, b"").removeprefix(b"<urn:page:").removesuffix(b">")).removeprefix(b"-").isdigit() else None  # noqa: B023, E731
                    kind, digest = h.get(b"warc-type", b"").decode("latin-1"), h.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1")
                    whole = kind != "response" or base64.b32encode(hashlib.sha1(content[body:stop]).digest()).decode() == digest
                    out.append({"offset": at, "successor": stop + 4, "record_type": kind, "page_id": number(b"warc-record-id"), "refers_to": number(b"warc-refers-to"), "payload_bytes": number(b"warc-payload-length"), "payload_digest": digest, "intact": whole, "first": at == 0})
        at = content.find(MAGIC, at + 1)
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Record rows of all .warc files below path: file, offset, type, ids, payload's bytes and digest,
    and intact (a response's payload has the digest of its header).

    Only records on the chain from offset 0 of their file are returned. An empty file has none.
    Repeated files give their rows again. A file is read by one task (and Spark refuses files above 2 GB), so files
    are rolled at a bounded number of records and bytes when written.
    """

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = candidates(content.as_py())
                if rows:
                    yield pa.RecordBatch.from_pylist([r | {"file": file} for r in rows], schema=pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in fields]))

    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(CANDIDATES).fields
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = persisted(raw.select("path", "content").mapInArrow(run, CANDIDATES), "warc-candidates")
    on_chain = reachable(found.select("file", "offset", "successor"))
    return found.join(on_chain.hint("merge"), ["file", "offset"], "left_semi").drop("successor", "first")


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of what can be reached from offset 0 by successor links, by pointer jumping.

    Round k holds each candidate's 2**k-th successor and what lies within 2**k steps of the start;
    it ends when no pointer leads to a candidate any more. Join keys are unique on one side. The joins
    are merges: file names compress so well that a broadcast judged by file size could be large.
    """
    jump = links.select("file", F.col("offset").alias("at"), F.col("successor").alias("to"))
    jump = persisted(jump.join(jump.select("file", F.col("at").alias("to")).hint("merge"), ["file", "to"], "left_semi").select("file", "at", "to"), "warc-jumps")
    reach = persisted(links.where("offset = 0").select("file", "offset"), "warc-reach")
    while not jump.isEmpty():
        further = reach.join(jump.hint("merge"), (reach["file"] == jump["file"]) & (reach["offset"] == jump["at"])).select(reach["file"], F.col("to").alias("offset"))
        new = persisted(reach.unionByName(further), "warc-reach")
        second = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        longer = persisted(jump.join(second.hint("merge"), ["file", "to"]).select("file", "at", F.col("then").alias("to")), "warc-jumps")
        dropped(reach, jump)
        reach, jump = new, longer
    return reach


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a table of pages as archives in the shared folder and read the records back."""
    path = write_path(pages.sparkSession, "warc")
    write_archives(with_revisits(pages, page_id, html, least_bytes), path)
    return read_archives(pages.sparkSession, path)
