"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import inspect
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from veilspark.llm import decontaminate, neardedup, secret_scan, toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_shape(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert all(df.columns == COLUMNS for df in steps[:-1]) and all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = ids(steps[1])
    model = toxicity.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept == {r["doc_id"] for r in toxicity.grades(steps[0], model).collect() if not r["toxic"]}
    assert all(d in kept for d, t in labels.items() if not t) and sum(d in kept for d, t in labels.items() if t) < 0.35 * sum(labels.values())


def test_one_of_each_group_stays(steps):
    from test_neardedup import brute

    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    assert ids(steps[2]) == {d for d, _, c in brute(rows) if d == c}
    assert neardedup.near_duplicates(steps[2]).filter("not kept").count() == 0


def test_benchmark_items_go(spark, steps):
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: decontaminate.normal(r["text"]) for r in df.collect()} for df in steps[2:4])
    leaked = {d for d, t in before.items() if any(i in t for i in items)}
    assert leaked and not leaked & set(after) and set(before) - leaked >= set(after) and len(before) - len(after) <= len(leaked) + 2


def test_secrets_give_way(steps):
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in steps[3:5])
    assert set(before) == set(after)
    for d, r in after.items():
        found = secret_scan.find(before[d]["text"])
        assert (r["text"] != before[d]["text"]) == bool(found) and r["n_chars"] == len(r["text"])
    assert any(r["text"] != before[d]["text"] for d, r in after.items()) and not any(re.search("AKIA[A-Z0-9]{12}", r["text"]) for r in after.values())


def test_everything_is_packed(spark, steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {}
    for r in steps[5].collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in steps[4].collect()}


def test_run_equals_the_stages(spark, steps):
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[5])


def test_odd_documents_pass_every_stage(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (None, "a b c", "fr", None, 5), (None, "a b c", "fr", None, 5), (3, "", None, "s", None), (3, "", None, "s", None), (4, "w " * 100_000, "en", "s", 200_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {1, None, 3, 4} and sum(r["doc_id"] == 3 for r in out) == 1
