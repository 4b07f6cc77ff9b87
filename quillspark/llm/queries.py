"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import (
    collocations, decontaminate, license_scan, merkle, mixing, passages, quality, rule_ensemble, secret_scan, simhash, token_files,
    url_filter, warc,
)
from quillspark.session import shared_folder


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.within_bits(_read(spark, sf, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(_read(spark, sf, "documents"), folder, vocabulary, end_id=2)
    return token_files.read(spark, folder)


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf, "documents"))


def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.matches(_read(spark, sf, "documents"), _read(spark, sf, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("start").alias("start_word"),
        "n_words",
        "distance",
        "similarity",
    )


def op6_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated(_read(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


# The rules of the registered URL query.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = _read(spark, sf, "pages")
    model = url_filter.train(url_filter.label_by_rules(pages, URL_RULES))
    return url_filter.judge(pages, URL_RULES, model)


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf, "documents"))
    number = {r.kind: i for i, r in enumerate(secret_scan.RULES)}
    base = F.filter("spans", lambda s: s["number"] < sum(r.base for r in secret_scan.RULES))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["number"] == number[kind])).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(_read(spark, sf, "documents"))


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_read(spark, sf, "documents"))


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(_read(spark, sf, "pages"), folder)
    return warc.read(spark, folder).drop("payload", "url")


def op11_rule_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    return rule_ensemble.score(docs, rule_ensemble.train(docs, _read(spark, sf, "labels")))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    lowered = F.translate("text", url_filter.UPPER, url_filter.LOWER)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(tampered, merkle.leaf(*fields, lowered))
    found = merkle.verified(merkle.manifest(_read(spark, sf, "documents"), other=other))
    proof = F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_token_files, op3_license_scan, op4_decontaminate, op5_url_filter, op6_passages, op7_secret_scan, op8_quality, op9_warc,
        op10_mixing, op11_rule_ensemble, op12_merkle, op13_collocations,
    )
}
