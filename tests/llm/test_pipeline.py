"""The pipeline against the operators' own verdicts, and its stages on awkward rows."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from cases import AWKWARD, SF, frame
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from quillspark.llm import decontaminate, mixing, quality, simhash


def test_stages_follow_the_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    keep = lambda ids: docs.where(docs.doc_id.isin(sorted(ids)))
    good = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    assert 0 < len(good) < len(text)
    found = simhash.near_duplicates(keep(good)).collect()
    single = {r["component_id"] for r in found}
    assert single < good
    leaks = {r["id"] for r in decontaminate.matches(keep(single), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    clean = single - leaks
    assert leaks
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(keep(clean)).collect()}
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want, start = [], 0
    for d in sorted(clean):
        ids = [*encode(text[d], add_special_tokens=False).ids, 2]
        for _ in range(copies[d]):
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_stages_take_awkward_and_empty_tables(spark):
    for rows in (AWKWARD, []):
        docs = frame(spark, rows)
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.count()


def test_registry():
    names = set(entry_module.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op")}
    assert "pipeline" in names and set(entry_module.oracle_sql()) <= names
