"""WARC archives, index first: records are written with an index of file, offset, length, URL and digest; readers
take the index rows they want, sort them, join near byte ranges into one read, and cut the records out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_kind, lookup, open_fs, shared_path, ship, written

ship(__name__)

#: Payloads of fewer bytes are never stored as revisits.
REVISIT_BYTES = 0
FILE_BYTES = 256 << 20
#: Records closer than GAP bytes are read together, in reads of about READ_BYTES.
GAP, READ_BYTES = 64 << 10, 4 << 20
DATE = "2024-08-01T00:00:00Z"
INDEX = "file string, offset long, length long, page_id {kind}, url string, digest string, record_type string, payload_bytes long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response with its HTTP head and payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), type, payload and its full length of one record; checks lengths and digest."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != full or base32_sha1(payload) != digest):
        raise ValueError("payload doesn't match its record")
    return fields | {"payload": payload, "payload_bytes": full, "digest": digest}


def revisits(pages: DataFrame, page_id: str, html: str, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages whose payload a page of larger id has too.

    Works on ids and digests only; the pages of one payload meet in a partial aggregate, and each page looks its
    digest up among those that repeat: rows of a hot payload stay where they are.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    small = pages.select(F.col(page_id).alias("_page"), F.sha1(body).alias("_sha1"), F.octet_length(body).alias("_bytes"))
    small = written(small.filter(F.col("_bytes") >= least).select("_page", "_sha1"), "digests")
    heads = small.groupBy("_sha1").agg(F.max("_page").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = lookup(small, written(heads, "heads"), "_sha1", "inner").filter(F.coalesce(F.col("_page") < F.col("refers_to"), F.col("refers_to").isNotNull()))
    return found.select("_page", "_sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages as WARC files and returns their index table.

    A retried task writes files of new names; only those in the index count.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    back = revisits(rows, "page_id", "html")
    rows = rows.withColumn("sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    rows = rows.join(back, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task, out, seq, at = TaskContext.get(), None, 0, 0
        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)
        for b in batches:
            found = []
            for page, u, body, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3).to_pylist()):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{seq:04d}.warc.gz"
                    out, at = fs.open_output_stream(f"{where}/{name}", compression=None), 0
                payload = body.as_py() or b""
                digest = base32_sha1(payload)
                raw = record(page, u, payload, digest, refers)
                out.write(raw)
                found.append((f"{folder}/{name}", at, len(raw), page, u, digest, "response" if refers is None else "revisit", len(payload)))
                at += len(raw)
                if at >= FILE_BYTES:
                    out.close()
                    out, seq = None, seq + 1
            cols = list(zip(*found)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), b.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "offset", "length", "page_id", "url", "digest", "record_type", "payload_bytes"])
        if out is not None:
            out.close()
    return written(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX.format(kind=kind)), "warc-index")


def ranges(index: DataFrame) -> DataFrame:
    """One row per read: file, first byte, length, and the records in it by offset. Files are of bounded size, so is a window."""
    w = W.partitionBy("file").orderBy("offset")
    apart = (F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w) > GAP) | \
        (F.floor(F.col("offset") / READ_BYTES) != F.floor(F.lag("offset").over(w) / READ_BYTES))
    cut = index.select("file", "offset", "length").withColumn("new", F.coalesce(apart, F.lit(True)).cast("long")).withColumn("no", F.sum("new").over(w))
    return cut.groupBy("file", "no").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"),
                                         F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


def read_records(index: DataFrame, kind: str = "bigint", with_payload: bool = False) -> DataFrame:
    """The records of the selected index rows, from the archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to (and payload)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def run(batches):
        import pyarrow as pa
        own = arrow_kind(kind)
        cast = str if kind == "string" else int
        kinds = [own, pa.string(), pa.int64(), pa.string(), pa.string(), own, pa.binary()]
        for b in batches:
            for file, start, end, records in zip(*[b.column(i).to_pylist() for i in range(4)]):
                fs, where = open_fs(file)
                with fs.open_input_file(where) as f:
                    raw = f.read_at(end - start, start)
                rows = []
                for r in records:
                    x = parse(raw[r["offset"] - start:r["offset"] - start + r["length"]])
                    rows.append([cast(x["x-page-id"]) if "x-page-id" in x else None, x.get("warc-target-uri"), x["payload_bytes"], x["digest"], x["warc-type"],
                                 cast(x["x-refers-to-page-id"]) if "x-refers-to-page-id" in x else None] + [x["payload"]] * with_payload)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    out = f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}" + ", payload binary" * with_payload
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges(index).select("file", "start", "end", "records").repartition(n, "file", "start").mapInArrow(run, out)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives in the shared folder, reads every record back and returns one row per page.

    Null or empty html: an empty payload.  Null url: no target header.  A null id is smaller than all others.
    Rows that repeat an id and payload are records of one kind.  Empty table: no rows.  Other columns are not read.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    index = write_archives(pages, shared_path(pages.sparkSession, "warc"), page_id, url, html)
    return read_records(index, kind).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p),
s AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS parts FROM m)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(parts, lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM s
"""
