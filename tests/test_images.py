"""Raster formats by round trips and written-out bytes, painting, and images redacted by their words."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.functions import raster
from veilspark.operators import images, providers
from veilspark.operators.redact import redact
from veilspark.sources import docx


def picture(height, width, channels, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width, channels), dtype=np.uint8)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width, height, depth, colour, raw, interlaced=0, **more):
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    between = b"".join(chunk(k.encode(), v) for k, v in more.items())
    packed = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + between + chunk(b"IDAT", packed[:5]) + chunk(b"IDAT", packed[5:]) + chunk(b"IEND", b"")


def filtered(rows, kinds, step):
    """Rows filtered by the definitions, sample by sample."""
    out, above = b"", [0] * len(rows[0])
    for line, kind in zip(rows, kinds, strict=True):
        out += bytes([kind])
        for i, value in enumerate(line):
            left, up, corner = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda c: (abs(p - c), (left, up, corner).index(c)))
            out += bytes([(value - (0, left, up, (left + up) // 2, paeth)[kind]) % 256])
        above = line
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.integers(0, 1000))
def test_png_and_bmp_round_trip(height, width, channels, seed):
    made = picture(height, width, channels, seed)
    assert (raster.read_png(raster.write_png(made)) == made).all()
    assert (raster.read_bmp(raster.write_bmp(made)) == raster.as_rgb(made)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.sampled_from([(0, 1), (4, 2), (2, 3), (6, 4)]), st.lists(st.integers(0, 4), min_size=1, max_size=8), st.integers(0, 1000))
def test_png_filters(width, kind, filters, seed):
    colour, channels = kind
    made = picture(len(filters), width, channels, seed)
    raw = filtered([list(map(int, r)) for r in made.reshape(len(filters), -1)], filters, channels)
    assert (raster.read_png(png(width, len(filters), 8, colour, raw)) == made).all()


def test_png_depths_palettes_and_transparency():
    assert raster.read_png(png(3, 1, 1, 0, b"\x00\xa0"))[0, :, 0].tolist() == [255, 0, 255]
    assert raster.read_png(png(3, 1, 4, 0, b"\x00\x1f\x20"))[0, :, 0].tolist() == [17, 255, 34]
    assert raster.read_png(png(1, 1, 16, 2, b"\x00\x12\x34\x56\x78\x9a\xbc"))[0, 0].tolist() == [0x12, 0x56, 0x9A]
    palette = bytes([1, 2, 3, 4, 5, 6])
    assert raster.read_png(png(2, 1, 2, 3, b"\x00\x10", PLTE=palette)).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert raster.read_png(png(2, 1, 2, 3, b"\x00\x10", PLTE=palette, tRNS=b"\x00")).tolist() == [[[1, 2, 3, 0], [4, 5, 6, 255]]]
    assert raster.read_png(png(2, 1, 8, 0, b"\x00\x07\x08", tRNS=b"\x00\x08")).tolist() == [[[7, 255], [8, 0]]]


def test_png_interlaced():
    made = picture(11, 13, 3, 4)
    raw = b""
    for y0, dy, x0, dx in raster._PASSES:
        part = made[y0::dy, x0::dx]
        raw += b"".join(b"\x00" + row.tobytes() for row in part) if part.size else b""
    assert (raster.read_png(png(13, 11, 8, 2, raw, interlaced=1)) == made).all()


def test_bmp_with_a_palette_and_top_down():
    head = struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 8, 0, 4, 0, 0, 2, 0)
    made = b"BM" + struct.pack("<IHHI", 66, 0, 0, 62) + head + bytes([3, 2, 1, 0, 6, 5, 4, 0]) + bytes([1, 0, 0, 0])
    assert raster.read_bmp(made).tolist() == [[[4, 5, 6], [1, 2, 3]]]


@pytest.mark.parametrize("data", [b"", b"\x89PNG\r\n\x1a\n", raster.write_png(picture(3, 3, 3))[:40], png(2, 2, 8, 0, b"\x00"), png(2, 1, 8, 3, b"\x00\x00\x09", PLTE=b"abc"), b"BM12", png(70000, 70000, 8, 6, b"\x00"), png(1, 1, 8, 0, b"\x09\x00"), raster.write_bmp(picture(4, 4, 3))[:60]])
def test_damage_is_a_value_error(data):
    with pytest.raises(ValueError):
        raster.read(data, "JPEG")


def test_painting_covers_its_edges_and_nothing_else():
    for channels, black in ((1, [0]), (2, [0, 255]), (3, [0, 0, 0]), (4, [0, 0, 0, 255])):
        made = np.full((5, 6, channels), 9, np.uint8)
        done = raster.paint(made, [(1, 2, 3, 3), (-5, -5, 0, 0), (5, 4, 99, 99), (-9, -9, -1, -1)])
        inside = {(2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (0, 0), (4, 5)}
        assert all(done[y, x].tolist() == (black if (y, x) in inside else [9] * channels) for y in range(5) for x in range(6)) and (made == 9).all()


def reader():
    class Reader:  # local, so that it is shipped whole
        """Words by the first sample of the picture; a black one cannot be scanned."""

        def words(self, data, fmt):
            first = int(raster.read(data, fmt)[0, 0, 0])
            if first == 0:
                raise RuntimeError("no text engine")
            return [("mail", 95, 0, 0, 2, 1, 1, 1, 1), ("jane@example.com", 95, 3, 1, 4, 2, 1, 1, 1)] if first == 1 else [("plain", 95, 0, 0, 2, 1, 1, 1, 1)]

    return Reader()


def shade(value, channels=3):
    return raster.write_png(np.full((6, 10, channels), value, np.uint8))


def test_images_by_their_words(spark, monkeypatch):
    rows = [("a", "png", shade(1)), ("b", "png", shade(1)), ("c", "bmp", raster.write_bmp(np.full((6, 10, 3), 1, np.uint8))), ("d", "png", shade(2)), ("e", "png", shade(0)), ("f", "png", b"junk"), ("g", "jpeg", shade(1)), ("h", "png", None), ("i", None, shade(2))]
    table = spark.createDataFrame(rows, "name string, format string, data binary")
    for most in (images.MAX_BOXES, 0):  # boxes broadcast and shuffled
        monkeypatch.setattr(images, "MAX_BOXES", most)
        done = images.redact_by_words(table, reader())
        assert done.columns == ["name", "format", "data", "redacted", "regions", "image_error"]
        got = {r["name"]: (None if r["redacted"] is None else bytes(r["redacted"]), r["regions"], r["image_error"]) for r in done.collect()}
        assert got["a"] == got["b"] and got["a"][1:] == (1, None) and got["c"][1:] == (1, None) and got["c"][0].startswith(b"BM")
        for name in "ac":
            shown = raster.read(got[name][0], "")
            assert (shown[1:4, 3:8] == 0).all() and shown.sum() == 3 * (60 - 15)
        assert got["d"] == (shade(2), 0, None) and got["i"] == (shade(2), 0, None) and got["h"] == (None, 0, None)
        assert got["e"][:2] == (shade(0), 0) and "no text engine" in got["e"][2] and got["f"][:2] == (b"junk", 0) and got["f"][2]
        assert got["g"][:2] == (shade(1), 0) and "Pillow" in got["g"][2] or got["g"][1] == 1  # where Pillow is installed it is written
    assert images.redact_by_words(table.limit(0), reader()).count() == 0


def test_folder_to_folder_with_images(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    for folder, text in (("x", "mail jane@example.com"), ("y", "clean")):
        (source / folder).mkdir(parents=True)
        (source / folder / "a.docx").write_bytes(docx.package([text], {"word/media/p.png": shade(1 if folder == "x" else 2)}))
    (source / "y" / "broken.docx").write_bytes(b"no package")
    report = docx.redact_folder(spark, str(source), str(target), redact, lambda media: images.redact_by_words(media, reader()))
    got = {r["name"]: (r["redactions"], r["regions"], r["error"] is None) for r in report.collect()}
    assert got == {"x/a.docx": (1, 1, True), "y/a.docx": (0, 0, True), "y/broken.docx": (0, 0, False)}
    found = {str(p.relative_to(target)) for p in target.rglob("*") if p.is_file() and "_report" not in str(p)}
    assert found == set(got)
    assert (target / "y/a.docx").read_bytes() == (source / "y/a.docx").read_bytes() and (target / "y/broken.docx").read_bytes() == b"no package"
    (row,) = docx.media(docx.read(spark, str(target / "x"))).collect()
    assert (raster.read(bytes(row["data"]), "PNG")[1:4, 3:8] == 0).all()


def test_a_failing_python_detector_does_not_stop_the_others(spark):
    def badge(text):
        if "BOOM" in text:
            raise RuntimeError("no badge today")
        return [(text.index("B-7"), text.index("B-7") + 3)] if "B-7" in text else [] if "wide" not in text else [(0, 999)]

    rows = spark.createDataFrame([(1, "é B-7 a@b.co"), (2, "BOOM a@b.co"), (3, None), (4, ""), (5, "wide a@b.co")], "i int, text string")
    found = rows.withColumn("badge", providers.detector("BADGE", badge)("text"))
    done = redact(found, extra=(found["badge.matches"],))
    got = {r["i"]: r for r in done.select("i", "n", "redacted", "badge.error").collect()}
    assert got[1]["n"] == 2 and "[REDACTED]" in got[1]["redacted"] and "a@b.co" not in got[1]["redacted"] and got[1]["error"] is None
    assert got[2]["n"] == 1 and "no badge" in got[2]["error"] and got[5]["n"] == 1 and "outside" in got[5]["error"]
    assert got[3]["redacted"] is None and got[3]["n"] == 0 and got[4]["redacted"] == ""
