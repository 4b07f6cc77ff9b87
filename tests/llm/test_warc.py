"""WARC files: round trip, magic inside payloads, revisits and broken chains."""

import glob
import gzip
import hashlib
import tempfile

import duckdb
import pytest
from cases import SF, ordered, tables

from quillspark.llm import oracles, queries, warc

BIG = "<p>" + "x" * 1200
FAKE = "WARC/1.0\r\nWARC-Type: response\r\nPage-ID: 77\r\nContent-Length: 5\r\n\r\nabc"
ROWS = [
    (1, "http://a/", BIG), (2, "http://b/\r\nWARC-Type: x", BIG), (3, None, BIG), (4, "u", "short"), (5, "u", "short"),
    (6, "u", None), (7, "u", ""), (8, "u", f"é{FAKE}\r\n\r\n{FAKE}\r\n\r\n"), (9, "u", "WARC/1.0\r\n"), (None, None, "n" + BIG),
    (None, None, BIG), (10, "u", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"), (11, "u", "é" * 600), (12, "u", "é" * 600), (12, "u", "é" * 600),
    (13, "u", f"{warc.END}{warc.MAGIC}" * 50),
]


def expected(rows):
    texts = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in texts:
        if len(p) >= 1000 and i is not None:
            first[p] = max(i, first.get(p, i))
    many = {p for _, p in texts if sum(q == p for _, q in texts) > 1}
    out = []
    for i, p in texts:
        revisit = p in many and p in first and i != first[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(map(str, out))


def result(df):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted(str(tuple(r)) for r in df.select(cols).collect())


def pages(spark, rows):
    full = [(*r, "clash", 1) for r in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, digest string, size int")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    folder = tempfile.mkdtemp(prefix="warc-") + "/w"
    warc.write(pages(spark, ROWS).repartition(3), folder, compression=compression)
    df = warc.read(spark, folder)
    assert result(df) == expected(ROWS)
    want = {(i, h or "") for i, _, h in ROWS}
    assert {(r["page_id"], r["payload"]) for r in df.where("record_type = 'response'").collect()} <= want


def test_files_may_be_packed_anew_while_reading(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="warc-") + "/w"
    warc.write(pages(spark, ROWS).repartition(5), folder)
    key, store = "spark.sql.files.maxPartitionBytes", warc.stored

    def packed_otherwise(df, name):
        out = store(df, name)
        if name == "chains":
            spark.conf.set(key, "1k")
        return out

    old = spark.conf.get(key)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    monkeypatch.setattr(warc, "stored", packed_otherwise)
    try:
        assert result(warc.read(spark, folder)) == expected(ROWS)
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_files_read_the_same(spark):
    folder = tempfile.mkdtemp(prefix="warc-") + "/w"
    rows = [(i, "u", f"{i} " * 400 + (warc.MAGIC if i % 3 else "")) for i in range(200)]
    warc.write(pages(spark, rows).coalesce(1), folder, compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = warc.read(spark, folder)
        assert df.rdd.getNumPartitions() > 5 and result(df) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_are_plain_warc(spark):
    folder = tempfile.mkdtemp(prefix="warc-") + "/w"
    warc.write(pages(spark, ROWS), folder)
    n = 0
    for name in glob.glob(f"{folder}/part-*"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.0\r\n")
            size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data, n = rest[size + 4 :], n + 1
    assert n == len(ROWS)


def test_broken_chain_is_an_error(spark):
    folder = tempfile.mkdtemp(prefix="warc-") + "/w"
    warc.write(pages(spark, ROWS).coalesce(1), folder, compression="none")
    (name,) = glob.glob(f"{folder}/part-*")
    data = open(name, "rb").read()
    other = tempfile.mkdtemp(prefix="warc-")
    with open(f"{other}/part-0", "wb") as f:
        f.write(data.replace(b"Content-Length: ", b"Content-Length: 1", 1))
    with pytest.raises(ValueError, match="broken record chains"):
        warc.read(spark, other)


def test_no_pages(spark):
    folder = tempfile.mkdtemp(prefix="warc-") + "/w"
    warc.write(pages(spark, []), folder)
    assert warc.read(spark, folder).count() == 0


def test_query_matches_sql(spark):
    df = queries.op9_warc(spark, SF)
    sql = tables(duckdb.connect()).sql(oracles.ORACLES["op9_warc"])
    assert ordered(df.collect(), df.columns) == ordered(sql.fetchall(), sql.columns)
