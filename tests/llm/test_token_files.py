"""Token files: round trip against whole-text encoding; Elias-Fano against plain arrays."""

import tempfile
import zlib

import numpy as np
import public_tokenizers
from cases import AWKWARD, SF, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
PIECES = token_files.Pieces(PATH, 2)


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def expected(rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*whole(text), 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text() | st.text(alphabet="aZé'’  ́ \n\t\x1c\x85ſKİß<|endoftext|>12", max_size=40))
def test_pieces_equal_whole_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(PIECES.encode(text), "<u2").tolist() == whole(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1) | st.integers(0, 300), max_size=700))
def test_elias_fano(values):
    values = np.array(sorted(values), np.uint64)
    code = token_files.EliasFano.loads(token_files.EliasFano.of(values).dumps())
    assert code.values().tolist() == values.tolist()
    assert [code.select(i) for i in range(len(values))] == values.tolist()


def test_boundaries_take_few_bits():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 5000))
    assert len(token_files.EliasFano.of(ends).dumps()) * 8 < 13 * len(ends)


def test_query_against_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op2_token_files(spark, SF).collect())
    assert got == expected(sorted(tuple(r) for r in docs))


def test_awkward_rows_and_small_segments(spark):
    folder = tempfile.mkdtemp(prefix="tokens-")
    token_files.write(frame(spark, AWKWARD), f"{folder}/a", PATH, 2, segment_tokens=100)
    got = token_files.read(spark, f"{folder}/a").orderBy("start").collect()
    key = lambda d: (d is not None, d or 0)
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in AWKWARD), key=key)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    want = sorted((key(d), len(whole(t)) + 1, zlib.crc32(np.array([*whole(t), 2], "<u4").tobytes())) for d, t in AWKWARD)
    assert sorted((key(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    token_files.write(frame(spark, [(-5, "a b"), (-9, None)]), f"{folder}/n", PATH, 2)
    assert [tuple(r)[:3] for r in token_files.read(spark, f"{folder}/n").orderBy("start").collect()] == [(-9, 0, 1), (-5, 1, 3)]
    token_files.write(frame(spark, []), f"{folder}/e", PATH, 2)
    assert token_files.read(spark, f"{folder}/e").count() == 0
