"""WARC archives: write, and read back with boundary-chain verification.

Writing. One record per page; a payload that equals an earlier one of at least ``least`` bytes becomes a
revisit. The records go through Spark's text writer with the record terminator as line separator, so each
task's file is a plain WARC file in any store Spark writes to, committed as a whole.

Reading. The text reader splits the files at the magic line. Every piece is a candidate record: its offset is
the running length of the pieces before it, and its Content-Length gives the offset of its successor. A
page can hold the magic line too, so candidates are not trusted: pointer jumping from offset 0 of every file
keeps only the candidates that the chain of lengths reaches, doubling the jump in each round. It runs per file
on offsets alone (two numbers a record; a file is what one task wrote). The pieces of a record whose payload
holds the magic line are put together again. A file whose chain does not end at its last byte is an error.

Defined results: a null page is an empty payload; null ids and URLs leave out their header; a null id is
never the original of other rows with an id; rows that share the largest id of a payload are all responses;
an empty table gives no records. Line breaks in a URL are percent-encoded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import plain, small, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(
    pages: DataFrame, html: str = "html", url: str = "url", id: str = "page_id", least: int = LEAST_BYTES, date: str = DATE
) -> DataFrame:
    """One column ``record`` without the terminator."""
    rows = pages.select(
        F.col(id).cast("long").alias("id"), F.col(url).alias("url"), plain(F.col(html)).alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    repeated = (
        rows.where(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("of"), "original")
    )
    rows = rows.join(small(stored(repeated, "payloads")), F.col("digest") == F.col("of"), "left")
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    name = F.md5(F.concat_ws("|", F.col("id").cast("string"), "url", "digest"))
    urn = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return rows.select(
        F.concat(
            F.lit(MAGIC),
            _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), urn, F.lit(">"))),
            _header("WARC-Date", F.lit(date)),
            _header("WARC-Target-URI", address),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _header("Page-ID", F.col("id").cast("string")),
            _header("Payload-Length", F.col("size").cast("string")),
            _header("Refers-To-Page-ID", F.when(revisit, F.col("original").cast("string"))),
            _header("Content-Type", F.lit("application/http; msgtype=response")),
            _header("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("record")
    )


def write(pages: DataFrame, folder: str, compression: str = "gzip", **params) -> None:
    records(pages, **params).write.option("lineSep", END).option("compression", compression).text(folder)


# --- reading


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """What follows each magic line; ``at`` rises in the order of the file."""
    text = spark.read.option("lineSep", MAGIC).text(folder)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?m)^{name}: (.*?)\r?$", 1)
    return F.when(found != "", found)


def candidates(pieces: DataFrame) -> DataFrame:
    """(file, at, offset, next, stop): each piece with its successor's offset and the end of the piece."""
    head = F.substring_index("value", END, 1)
    length = _field(head, "Content-Length").cast("long")
    size = F.octet_length(head) + len(END) + length + len(END)
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sized = pieces.select("file", "at", F.octet_length("value").cast("long").alias("n"), size.alias("size"))
    placed = sized.withColumn("stop", F.sum(F.col("n") + len(MAGIC)).over(earlier) - len(MAGIC))
    begin = F.col("stop") - F.col("n") - len(MAGIC)
    return placed.select("file", "at", begin.alias("offset"), (F.col("stop") - F.col("n") + F.col("size")).alias("next"), "stop")


def on_chain(offsets: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the rising ``offsets`` are reached from offset 0 along ``following``, by pointer jumping.

    Each round doubles the length of all jumps, so the rounds are logarithmic in the number of records.
    """
    n = len(offsets)
    jump = np.searchsorted(offsets, following)
    known = jump < n
    known[known] = offsets[jump[known]] == following[known]
    jump = np.append(np.where(known, jump, n), n)  # n: no candidate there
    reached = np.append(offsets == 0, False)
    while True:
        reached[jump[reached]] = True
        if (jump == n).all():
            return reached[:n]
        jump = jump[jump]


def reachable(found: DataFrame) -> DataFrame:
    """(file, at, owner, inner, next, stop): the piece ``owner`` begins the record that a piece belongs to, and
    ``inner`` says that the piece does not begin a record itself. One file's offsets go to one task."""

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("offset", ignore_index=True)
        real = on_chain(pieces["offset"].to_numpy(), pieces["next"].fillna(-1).to_numpy(np.int64))
        owner = pieces["at"].where(real).ffill()
        return pieces[["file", "at", "next", "stop"]].assign(owner=owner, inner=~real)

    rows = found.where("offset >= 0")
    return rows.groupBy("file").applyInPandas(
        run, "file string, at long, next long, stop long, owner long, inner boolean"
    )


def _parsed(rows: DataFrame) -> DataFrame:
    head = F.substring_index("value", END, 1)
    rows = rows.withColumn("head", head)
    block = F.substring("value", F.length("head") + len(END) + 1, F.length("value"))
    payload = F.substring(block, F.instr(block, END) + len(END), F.length(block))
    payload = F.substring(payload, F.lit(1), F.length(payload) - len(END))
    kind = _field(F.col("head"), "WARC-Type")
    rows = rows.select(
        "head", kind.alias("record_type"), F.when(kind == "response", payload).alias("payload")
    )
    stored_digest = F.substring_index(_field(F.col("head"), "WARC-Payload-Digest"), ":", -1)
    return rows.select(
        _field(F.col("head"), "Page-ID").cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"),
        "record_type",
        F.coalesce(
            F.octet_length("payload").cast("long"), _field(F.col("head"), "Payload-Length").cast("long")
        ).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), stored_digest).alias("payload_digest"),
        _field(F.col("head"), "Refers-To-Page-ID").cast("long").alias("refers_to"),
        "payload",
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record on the chains: page_id, url, record_type, payload_bytes, payload_digest, refers_to
    and the payload (null for a revisit)."""
    pieces = stored(_pieces(spark, folder), "pieces")  # another scan may number them differently
    marked = stored(reachable(candidates(pieces)), "chains")
    ends = marked.groupBy("file").agg(
        F.max("stop").alias("size"), F.max(F.when(~F.col("inner"), F.col("next"))).alias("end")
    )
    broken = ends.where(~F.col("size").eqNullSafe(F.col("end"))).limit(5).collect()
    if broken:
        raise ValueError(f"broken record chains: {[(r['file'], r['end'], r['size']) for r in broken]}")
    parts = marked.where("inner").select(F.col("owner").alias("of")).distinct()
    split = marked.select("at", "owner").join(parts, F.col("owner") == F.col("of"), "left_semi")
    torn = small(stored(split.select(F.col("at").alias("piece"), "owner"), "torn"))
    rows = pieces.where(F.col("value") != "").join(torn, F.col("at") == F.col("piece"), "left")
    whole = rows.where(F.col("owner").isNull()).select("value")
    ordered = F.sort_array(F.collect_list(F.struct("at", "value")))
    mended = (
        rows.where(F.col("owner").isNotNull())
        .groupBy("owner")
        .agg(F.array_join(F.transform(ordered, lambda x: x["value"]), MAGIC).alias("value"))
    )
    return _parsed(whole.unionByName(mended.select("value")))
