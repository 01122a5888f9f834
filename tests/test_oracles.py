"""Every registered query of the library against its SQL; derived inputs must hit and miss."""

from __future__ import annotations

import pytest

from veilspark.plans.registry import DETECT_SOURCES, ORACLES, QUERIES
from veilspark.plans.texts import SOURCES, duck_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, against_oracle):
    assert against_oracle(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(DETECT_SOURCES))
def test_sources_have_texts_without_a_hit(name, spark, duck):
    source = DETECT_SOURCES[name]
    hits = QUERIES[f"detect_{name}"](spark, "/root/testdata/sf0.01").select("id").distinct().count()
    assert 0 < hits < duck.execute(f"SELECT count(*) FROM ({duck_sql(SOURCES[source])})").fetchone()[0]


#: Words beside characters that are letters, digits or spaces in Unicode only; the first seven of a line of OCR words are read.
ODD_WORDS = [
    "Las Coóque, Nora LPñ Acme Inc.é", "éAcme Corp Las\u00a0Co Ltd\u0301 x", "\u00a0Acme\u00a0 Corp\u2028 \u000bNora\u000b Group", "Nagarñ Sectoré No. 5 Roadü 6", "Las Roadé Main Rdß",
    "١٢ Main Street 12 Main Streeté", "12 Main St, Apt é4 Plot noé", "Plot no.: ß/4é ſ. no. 7ñ", "Pune ٤٠٠٠٠١ Pune 400001é", "Pune\u00a0400001 Pune–400001 x400001", "A_b Co₂ A²b Co² Xⅷ Ltd", "Ａ Corp ＿A Co\u200d Acme L.L.C.é",
]


@pytest.mark.parametrize("name", ["box_union", "ocr_word_entity_overlap", "ocr_conf_filter", "ocr_lines", "word_spans", "redact_text"])
def test_odd_characters_equal_sql(name, spark, tmp_path):
    import duckdb

    texts = [" ".join(["x"] * at) + " " + words for at in (8, 24, 40) for words in ODD_WORDS] + ["", None, "\u00a0 " * 20]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    mine = QUERIES[name](spark, str(tmp_path))
    theirs = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in mine.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, mine.collect()), key=repr) == sorted(theirs, key=repr) and len(theirs) > 20


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
