"""Hashing helpers, tokenisation and packing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import packing
from veilspark.llm.textbytes import LOWER, Words, blocks, buffer_of, shingle_sets

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = ["", " ", "it's we're ,'s,'t a.'s x',y ,'re", "<|endoftext|> a<|endoftext|>b", "<|ENDOFTEXT|> Aé", "ΑΣ, ΣΑΣ.", "“a” »b, é’s éx İ", "a b\x0bc\x1cd", "中文,字", "don't.Stop", "x" * 5000, "1,2;3.4"]


def brute(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library_on_whole_texts():
    rng = random.Random(3)
    texts = TRICKY + ["".join(rng.choice("aAbs'tTrReé É×÷ß,.!-<|>\n\t 12٣ñ“”»ΣσİÍ 中#&…_/:") for _ in range(rng.randrange(60))) for _ in range(3000)]
    encoder = packing.Encoder(PATH)
    for part in (texts[:700], texts[700:1400], texts):  # later parts meet remembered runs
        assert [list(i) for i in encoder.ids(*buffer_of(pa.array(part)))] == brute(part)


def test_blocks_and_words_across_texts():
    batch = pa.record_batch([pa.array(["a b", None, "", "x" * 50, " c "])], names=["text"])
    assert [b.num_rows for b in blocks([batch, batch.slice(0, 0)], limit=10)] == [3, 1, 1]
    raw, at = buffer_of(batch.column(0))
    w = Words(LOWER[raw], at)
    assert np.diff(w.first).tolist() == [2, 0, 0, 1, 1]
    assert [len(s) for s in shingle_sets(w, 2)] == [1, 0, 0, 1, 1]
    assert (w.hashes(stretch=3) == w.hashes()).all()
    assert buffer_of(batch.column(0).slice(3))[1].tolist() == [0, 50, 53]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 101, 500))[::-1]
    limits = np.array([100, 4, 5200])
    bins, offsets = packing.best_fit(lengths, limits, np.array([1.0, 0.1, 0.1]), rule)
    for b in set(bins.tolist()):
        mine = lengths[bins == b]
        at = np.argsort(offsets[bins == b])
        assert mine.sum() <= 100 and len(mine) <= 4
        assert (mine.astype(float) ** 2).sum() <= 5200 or len(mine) == 1
        assert offsets[bins == b][at].tolist() == np.concatenate(([0], np.cumsum(mine[at])[:-1])).tolist()


def packed(spark, rows, schema="doc_id long, text string", **options):
    return packing.pack(spark.createDataFrame(rows, schema), PATH, **options).collect()


def check(rows, texts, capacity):
    """Every piece of every text is there once, and each sequence is gapless."""
    wanted = []
    for doc, ids in zip([d for d, _ in texts], brute([t or "" for _, t in texts]), strict=True):
        ids = np.append(np.array(ids, "<u4"), 0).astype("<u4")
        wanted += [(doc, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(wanted, key=key)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(w[3] for w in wanted)


def test_pack_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    sequences, tokens = check(packing.pack(docs, PATH).collect(), texts, 2048)
    assert sequences <= -(-tokens // 2048) * 1.02 + 1


def test_pack_edges(spark):
    big = 2**60
    texts = [(1, None), (1, None), (big + 1, ""), (None, "a b c"), (None, "a b c"), (5, "word " * 5000), (-7, "<|endoftext|>")]
    rows = [(d, t, 9, "x") for d, t in texts]
    schema = "doc_id long, text string, shard int, sequence_id string"
    check(packed(spark, rows, schema, capacity=64), texts, 64)
    assert packed(spark, [], schema) == []


def test_document_capacity(spark):
    rows = packed(spark, [(i, "a") for i in range(50)], capacity=100, max_documents=7)
    assert max(np.unique([r["sequence_id"] for r in rows], return_counts=True)[1]) == 7


def test_shards_cover_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_SHARD", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text"))
    sequences, tokens = check(packing.pack(docs, PATH).collect(), [tuple(r) for r in docs.collect()], 2048)
    assert sequences <= -(-tokens // 2048) + 8
