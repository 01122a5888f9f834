"""Resolution, splicing, fakes, providers, deduplication and OCR boxes."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import fake
from veilspark.operators import ocr, providers, report
from veilspark.operators.detect import MATCH, TYPES
from veilspark.operators.redact import redact
from veilspark.operators.resolve import apply, resolve_overlaps


def match(kind, start, end, value=""):
    return (start, start - end, TYPES.index(kind), kind, end, value)


def resolve(spark, lists):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"i int, m array<{MATCH}>")
    return [[(m["type"], m["start"], m["end"]) for m in r["m"]] for r in rows.select("i", resolve_overlaps(F.col("m")).alias("m")).orderBy("i").collect()]


def test_longest_wins_and_ties_go_to_the_first_registered(spark):
    got = resolve(spark, [[match("SSN", 0, 11), match("PHONE", 0, 7)], [match("IP_ADDRESS", 3, 9), match("PHONE", 3, 9)], [match("EMAIL", 0, 3), match("EMAIL", 3, 6)], []])
    assert got == [[("SSN", 0, 11)], [("PHONE", 3, 9)], [("EMAIL", 0, 3), ("EMAIL", 3, 6)], []]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(TYPES), st.integers(0, 30), st.integers(1, 9)), max_size=8), min_size=40, max_size=60))
def test_resolution_is_the_greedy_rule(spark, lists):
    wanted = []
    for items in lists:
        kept, last = [], -1
        for s, _, _, kind, e, _ in sorted(match(k, s, s + n) for k, s, n in items):
            if s >= last:
                kept.append((kind, s, e))
                last = e
        wanted.append(kept)
    assert resolve(spark, [[match(k, s, s + n) for k, s, n in items] for items in lists]) == wanted


def test_splice(spark):
    rows = spark.createDataFrame([("call 555-0100 now", [(5, 13, "XXX-XXXX")]), ("é a b", [(2, 3, ""), (4, 5, "ü")]), ("same", [])], "text string, r array<struct<start:bigint,end:bigint,replacement:string>>")
    assert [r[0] for r in rows.select(apply(F.col("text"), F.col("r"))).collect()] == ["call XXX-XXXX now", "é  ü", "same"]


def test_redaction(spark):
    texts = ["jane@example.com sent a copy to jane@example.com.", None, "", "nothing here", "é jane@example.com x 523-45-6789"]
    rows = redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    first, second = re.fullmatch(r"(\S+) sent a copy to (\S+)\.", rows[0]["redacted"]).groups()
    assert first == second != "jane@example.com" and rows[0]["n"] == 2
    assert [r["redacted"] for r in rows[1:4]] == [None, "", "nothing here"]
    assert rows[4]["redacted"].startswith(f"é {first} x ") and "523-45-6789" not in rows[4]["redacted"]


def test_identity_fakes_give_the_text_back(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    found = redact(rows)
    same = apply(F.col("text"), F.transform("matches", lambda m: m.withField("replacement", m["value"])))
    assert found.filter((same != F.col("text")) & F.col("text").isNotNull()).count() == 0


@pytest.mark.parametrize(
    "kind, shape",
    [
        ("EMAIL", r"[a-z]+\.[a-z]+\d+@example\.(com|net|org)"), ("PHONE", r"\(\d{3}\) \d{3}-\d{4}"), ("SSN", r"\d{3}-\d{2}-\d{4}"), ("CREDIT_CARD", r"\d{16}"), ("IP_ADDRESS", r"(\d+\.){3}\d+"),
        ("DATE_OF_BIRTH", r"\d\d/\d\d/(19|20)\d\d"), ("PERSON", r"\w+ \w+"), ("ORG", r"\w+ \w+"), ("ADDRESS", r"\d+ \w+ \w+"), ("PASSPORT", r"\[REDACTED\]"),
    ],
)
def test_fakes(spark, kind, shape):
    rows = spark.range(300).select(F.concat(F.lit("v"), "id").alias("v"))
    one = [r[0] for r in rows.select(fake.fake_of(kind, F.col("v"))).collect()]
    two = [r[0] for r in rows.repartition(5).select("v", fake.fake_of(kind, F.col("v")).alias("f")).orderBy(F.expr("cast(substr(v, 2) as int)")).select("f").collect()]
    assert one == two and all(re.fullmatch(shape, x) for x in one)
    if kind != "PASSPORT":
        assert len(set(one)) > 30
        assert one != [r[0] for r in rows.select(fake.fake_of(kind, F.col("v"), "salt")).collect()]
    if kind == "CREDIT_CARD":
        assert all(sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10 == 0 for x in one)


def names():
    """A provider; its class is local, so that it goes to the workers by value."""

    class Names:
        def analyze(self, texts):
            if "BOOM" in texts[0]:
                raise RuntimeError("no model")
            return [[("PERSON", t.index("Nora Fields"), t.index("Nora Fields") + 11, "Nora Fields", 0.8)] if "Nora Fields" in t else [] for t in texts]

        def redact_image(self, data, fmt):
            if data == b"bad":
                raise ValueError("cannot decode")
            return (data + b"!", 1) if b"pii" in data else (data, 0)

    return Names()


def test_provider_entities_once_per_text_and_errors_visible(spark):
    rows = spark.createDataFrame([(1, "é Nora Fields"), (2, "é Nora Fields"), (3, "BOOM"), (4, None), (5, "")], "i int, text string")
    got = {r["i"]: r for r in providers.entities(rows, "text", names()).collect()}
    assert got[1]["entities"] == got[2]["entities"] and got[1]["entities"][0]["start"] == 2
    assert got[3]["entities"] == [] and "no model" in got[3]["provider_error"] and got[4]["entities"] is None and got[5]["entities"] == []
    assert all(not r["entities"] for r in providers.entities(rows, "text", providers.NoOp()).collect())


def test_images_by_format_and_failures_kept(spark):
    rows = spark.createDataFrame([("a", "png", b"pii"), ("b", "jpeg", b"pii"), ("c", "png", b"pii"), ("d", "png", b"bad"), ("e", "png", b"ok")], "name string, format string, data binary")
    got = {r["name"]: (bytes(r["redacted"]), r["regions"], r["image_error"]) for r in providers.redact_images(rows, names()).collect()}
    assert got["a"] == got["b"] == got["c"] == (b"pii!", 1, None) and got["d"][0] == b"bad" and "cannot decode" in got["d"][2] and got["e"] == (b"ok", 0, None)


WORD = "img_id int, i int, text string, conf string, left int, top int, width int, height int, block_num int, par_num int, line_num int"


def test_ocr_lines_and_spans(spark):
    rows = spark.createDataFrame(
        [(1, 0, "Hello", "95", 0, 0, 5, 5, 1, 1, 1), (1, 1, " world ", "92", 6, 0, 5, 5, 1, 1, 1), (1, 2, "junk", "5", 0, 9, 5, 5, 1, 1, 2), (2, 0, "", "88", 0, 0, 1, 1, 1, 1, 1), (2, 1, "  ", "-1", 0, 0, 1, 1, 1, 1, 1), (2, 2, "ok", "88", 0, 0, 1, 1, 1, 1, 1), (2, 3, "x", "?", 0, 0, 1, 1, 1, 1, 1)],
        WORD,
    )
    kept = ocr.confident_words(rows)
    assert sorted((r["img_id"], r["line_text"]) for r in ocr.lines(kept, ["img_id"]).collect()) == [(1, "Hello world"), (2, "ok")]
    assert sorted((r["img_id"], r["start"], r["end"]) for r in ocr.word_spans(kept, ["img_id"]).collect()) == [(1, 0, 5), (1, 6, 11), (2, 0, 2)]


def test_ocr_boxes(spark):
    rows = spark.createDataFrame([(1, 0, "4111", "90", 10, 10, 20, 20, 1, 1, 1), (1, 1, "1111", "90", 50, 5, 10, 10, 1, 1, 1), (1, 2, "1111", "90", 60, 5, 10, 10, 1, 1, 1), (1, 3, "1111", "90", 70, 5, 10, 10, 1, 1, 1), (1, 4, "total", "90", 99, 5, 9, 9, 1, 1, 1)], WORD)
    (box,) = ocr.redaction_boxes(rows, ["img_id"]).collect()
    assert (box["left"], box["top"], box["right"], box["bottom"], box["type"]) == (10, 5, 80, 30, "CREDIT_CARD")


def test_boxes_in_one_pass_equal_the_joined_ones(spark):
    """Several entities a line, words that two entities share, repeated words, an empty table; a null key is kept."""
    texts = ["a@b.co,c@d.co", "123-45-6789", "x", "10.0.0.1", "10.0.0.1", "4111", "1111", "1111", "1111", "y"]
    rows = spark.createDataFrame([(img, i, t, "90", 10 * i + img, i % 3, 7, 9 + i, 1, 1, 1 + i // 7) for img in (1, 2) for i, t in enumerate(texts)], WORD)
    kept = ocr.confident_words(rows)
    joined = ocr.boxes(ocr.overlapping(ocr.word_spans(kept, ["img_id"]), ocr.entities(ocr.lines(kept, ["img_id"]), ["img_id"]), ["img_id"]), ["img_id"])
    mine = ocr.redaction_boxes(rows, ["img_id"])
    assert mine.columns == joined.columns and mine.dtypes == joined.dtypes
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, joined.collect())) and mine.count() >= 8
    assert ocr.redaction_boxes(rows.limit(0), ["img_id"]).count() == 0
    lost = rows.filter("img_id = 1").withColumn("img_id", F.lit(None).cast("int"))
    assert ocr.redaction_boxes(lost, ["img_id"]).count() == mine.filter("img_id = 1").count()


def test_evaluation_without_cases(spark):
    row = report.evaluate(spark.createDataFrame([], "truth boolean, found boolean"), "truth", "found").first()
    assert (row["tp"], row["accuracy"], row["precision"]) == (0, None, None)
