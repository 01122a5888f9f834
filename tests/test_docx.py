"""Packages: reading, byte-exact splicing, rebuilding, failures, sinks and streams."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.operators import providers
from veilspark.operators.redact import redact
from veilspark.sources import docx
from veilspark.streaming import redact_stream

W = docx.NAMESPACE


def secret(df):
    """SECRET becomes REDACTED; BOOM fails."""
    failed = F.col("text").contains("BOOM")
    return df.withColumn("n", F.when(failed, 0).otherwise((F.length("text") - F.length(F.replace("text", F.lit("SECRET"), F.lit("")))) / 6).cast("long")).withColumn("redacted", F.replace("text", F.lit("SECRET"), F.lit("REDACTED")))


def entries(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {e.filename: (z.read(e), e.compress_type) for e in z.infolist()}


def frame(spark, *packages):
    return spark.createDataFrame([(f"p{i}", c) for i, c in enumerate(packages)], "path string, content binary")


def run(spark, *packages, **options):
    rows = docx.redact_packages(frame(spark, *packages), options.pop("redact", secret), **options).collect()
    return {r["path"]: r for r in rows}


def test_spans_with_entities_prefixes_and_empty_elements():
    part = f'<x:document xmlns:x="{W}" xmlns:o="other"><x:t a=">">Nora &amp; Fields</x:t><x:t/><o:t>no</o:t><x:t></x:t><x:t><![CDATA[a<b]]> é</x:t></x:document>'.encode()
    spans = docx.find_spans(part)
    assert [s[2] for s in spans] == ["Nora & Fields", "", "", "a<b é"]
    assert part[spans[0][0] : spans[0][1]] == b"Nora &amp; Fields"
    assert docx.splice(part, spans, {0: 'A & B <C> "D"'}).count(b"A &amp; B &lt;C&gt; &#34;D&#34;") == 1
    assert docx.find_spans(docx.splice(part, spans, {0: 'A & B <C> "D"\t'}))[0][2] == 'A & B <C> "D"\t'


def test_only_text_changes(spark):
    body = f'<?xml version="1.0"?><w:document xmlns:w="{W}"><w:p><w:pPr><w:shd w:fill="FF0000"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve"> SECRET </w:t></w:r></w:p><w:p><w:t>clean</w:t></w:p><w:tbl><w:t>a SECRET</w:t></w:tbl></w:document>'
    header = f'<w:hdr xmlns:w="{W}"><w:t>SECRET</w:t></w:hdr>'.encode()
    made = docx.package([], {"word/document.xml": body.encode(), "word/header1.xml": header, "word/sub/header1.xml": header, "word/footnotes.xml": header, "word/media/image1.JPG": b"\xff\xd8"})
    row = run(spark, made)["p0"]
    old, new = entries(made), entries(bytes(row["content"]))
    assert row["redactions"] == 3 and list(old) == list(new)
    assert new["word/document.xml"][0].decode() == body.replace("SECRET", "REDACTED") and b"REDACTED" in new["word/header1.xml"][0]
    assert all(new[k] == old[k] for k in old if k not in ("word/document.xml", "word/header1.xml"))


def test_failing_span_stays_and_others_go(spark):
    row = run(spark, docx.package(["BOOM", "SECRET"]))["p0"]
    assert b">BOOM<" in entries(bytes(row["content"]))["word/document.xml"][0] and row["redactions"] == 1


def test_unchanged_and_unreadable_packages_keep_their_bytes(spark):
    clean = docx.package(["nothing", "to hide"])
    got = run(spark, clean, b"not a zip", None)
    assert bytes(got["p0"]["content"]) == clean and got["p0"]["error"] is None
    assert bytes(got["p1"]["content"]) == b"not a zip" and got["p1"]["error"] and got["p2"]["error"]


def test_images(spark):
    made = docx.package(["SECRET"], {"word/media/a.png": b"pii", "word/media/b.jpg": b"clean", "word/media/raw": b"x"})

    class Painter(providers.NoOp):
        def redact_image(self, data, fmt):
            return (b"black", 5) if data == b"pii" and fmt == "png" else (data, 0)

    packages = frame(spark, made, docx.package(["no media"]))
    found = docx.media(packages)
    assert sorted((r["name"], r["format"]) for r in found.collect()) == [("word/media/a.png", "png"), ("word/media/b.jpg", "jpeg"), ("word/media/raw", "")]
    rows = {r["path"]: r for r in docx.redact_packages(packages, secret, providers.redact_images(found, Painter())).collect()}
    new = entries(bytes(rows["p0"]["content"]))
    assert (rows["p0"]["redactions"], rows["p0"]["regions"]) == (1, 5) and new["word/media/a.png"][0] == b"black" and new["word/media/b.jpg"][0] == b"clean"
    assert rows["p1"]["regions"] == 0


def test_source_sink_and_stream(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir(), out.mkdir()
    (folder / "a.DOCX").write_bytes(docx.package(["mail jane@example.com"]))
    (folder / "b.docx").write_bytes(docx.package(["clean"]))
    (folder / "c.txt").write_bytes(b"no")
    read = docx.read(spark, str(folder))
    assert read.count() == 2
    docx.write(docx.redact_packages(read, redact), str(out))
    assert sorted(p.name for p in out.iterdir()) == ["a.DOCX", "b.docx"]
    assert b"jane@example.com" not in entries((out / "a.DOCX").read_bytes())["word/document.xml"][0]
    redact_stream.watch_packages(spark, str(folder), str(tmp_path / "batches"), str(tmp_path / "cp")).awaitTermination()
    streamed = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in spark.read.parquet(str(tmp_path / "batches")).collect()}
    assert streamed == {p.name: p.read_bytes() for p in out.iterdir()}


def test_sink_keeps_folders_and_refuses_clashes(spark, tmp_path):
    rows = spark.createDataFrame([("file:/d/a/x.docx", b"1"), ("file:/d/b/x.docx", b"2"), ("file:/d/b/y.docx", b"3")], "path string, content binary")
    docx.write(rows, str(tmp_path))
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*.docx")} == {"a/x.docx": b"1", "b/x.docx": b"2", "b/y.docx": b"3"}
    with pytest.raises(ValueError):
        docx.write(rows, str(tmp_path), F.element_at(F.split("path", "/"), -1))


def test_other_encodings_stay_and_are_told(spark):
    text = f'<?xml version="1.0" encoding="UTF-16"?><w:document xmlns:w="{W}"><w:t>SECRET</w:t></w:document>'
    made = docx.package([], {"word/document.xml": text.encode("utf-16"), "word/header1.xml": f'<w:hdr xmlns:w="{W}"><w:t>SECRET</w:t></w:hdr>'.encode()})
    row = run(spark, made)["p0"]
    new = entries(bytes(row["content"]))
    assert new["word/document.xml"][0] == text.encode("utf-16") and b"REDACTED" in new["word/header1.xml"][0] and "utf-16" in row["error"] and row["redactions"] == 1


def test_repeated_paths_and_many_changes(spark, monkeypatch):
    made = docx.package(["SECRET"] * 30)
    for most in (docx.MAX_CHANGES, 0):  # broadcast and shuffled changes
        monkeypatch.setattr(docx, "MAX_CHANGES", most)
        twice = spark.createDataFrame([("p", made), ("p", made), ("q", made)], "path string, content binary")
        rows = docx.redact_packages(twice, secret).collect()
        assert [r["redactions"] for r in rows] == [30] * 3 and len({bytes(r["content"]) for r in rows}) == 1


def test_text_stream_with_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a@example.com"), ("2024-01-01 00:20:00", "b@example.com 523-45-6789"), ("2024-01-01 05:00:00", "clean")]
    source = tmp_path / "rows"
    spark.createDataFrame(rows, "ts string, text string").selectExpr("CAST(ts AS timestamp) AS ts", "text").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(source))
    query = redact_stream.counts_by_window(stream, "ts").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["type"], r["matches"]) for r in spark.table("counted").collect()) == [("EMAIL", 2), ("SSN", 1)]
