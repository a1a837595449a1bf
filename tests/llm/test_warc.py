import base64
import hashlib

from pyspark.sql import functions as F

from sellerscope.llm import common, warc

PAGES = [(1, "http://a.example/1", "<p>x</p>"), (2, "http://a.example/2 with space\n", "<p>x</p>"), (3, None, None), (4, "http://a.example/4", ""), (5, "u", "<p>é漢</p>"),
         (6, "u", "z" * 300_000), (6, "u", "z" * 300_000), (None, "n", "<p>x</p>"), (None, "n", "only null"), (7, "u", "only null ")]


def brute(pages):
    top = {}
    for i, _, h in pages:
        b = (h or "").encode()
        top[b] = max([x for x in (top.get(b), i) if x is not None], default=None)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = i == top[b]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top[b]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("_page", F.lit(1)).withColumn("sha1", F.lit("x"))
    assert sorted((tuple(r) for r in warc.archive(df.repartition(3)).collect()), key=str) == brute(PAGES)
    assert warc.archive(df.limit(0)).count() == 0


def test_selected_records_come_from_their_byte_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (50 + i)) for i in range(300)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), common.shared_path(spark, "t"))
    some = index.filter("page_id % 7 = 0")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(some, with_payload=True).collect()}
    assert got == {i: h for i, _, h in rows if i % 7 == 0}
    assert warc.ranges(index).count() < 300 and all(r["end"] > r["start"] for r in warc.ranges(some).collect())


def test_record_round_trip():
    raw = warc.record(5, "http://x/", b"\r\n\r\nbody", warc.base32_sha1(b"\r\n\r\nbody"), None)
    x = warc.parse(raw)
    assert x["payload"] == b"\r\n\r\nbody" and x["warc-type"] == "response" and x["x-page-id"] == "5"
    y = warc.parse(warc.record(4, None, b"body", warc.base32_sha1(b"body"), 9))
    assert (y["payload"], y["payload_bytes"], y["x-refers-to-page-id"]) == (b"", 4, "9")


def test_pages_of_a_hot_payload_stay_where_they_are(spark):
    """Broadcasts of the session off: only the hot digests are broadcast, so the empty payload's rows are not dealt out by it."""
    rows = [(i, "u", "") for i in range(900)] + [(900 + i, "u", f"p{i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
    got = warc.archive(df)
    assert got.schema["page_id"].dataType.simpleString() == got.schema["refers_to"].dataType.simpleString() == "int"
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = warc.revisits(df, "page_id", "html")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan
