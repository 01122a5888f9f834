"""Scalar functions over text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def has_enough_digits(value: Column, least: int = 7) -> Column:
    """At least `least` ASCII digits."""
    return F.length(digits(value)) >= least


def strip_separators(value: Column) -> Column:
    """Without spaces and dashes."""
    return F.translate(value, " -", "")


def luhn(value: Column) -> Column:
    """The check digit fits; false for anything but digits. Null stays null."""
    return F.when(value.rlike("^[0-9]+$"), F.call_function("luhn_check", value)).otherwise(F.when(value.isNotNull(), F.lit(False)))


def year_bounds(year: Column, as_of_year: int) -> Column:
    return year.between(1900, as_of_year)


def xml_escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def xml_unescape(text: Column) -> Column:
    for coded, plain in (("&#xD;", "\r"), ("&#xA;", "\n"), ("&#x9;", "\t"), ("&#39;", "'"), ("&#34;", '"'), ("&quot;", '"'), ("&apos;", "'"), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def plain_date(text: Column) -> Column:
    """Without dots and commas, and with single spaces."""
    return F.regexp_replace(F.trim(F.translate(text, ".,", "")), r"[\t\n\f\r ]+", " ")


def format_bytes(n: Column) -> Column:
    """Whole bytes, or KB, MB or GB with one decimal; the base is 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", n / F.lit(float(1024**power))), F.lit(f" {unit}"))).otherwise(out)
    return out


def redacted_filename(name: Column) -> Column:
    """A safe file name with `-redacted.docx` for `.docx`, else `redacted.docx`."""
    safe = F.regexp_replace(name, r"[^\w.-]+", "_")
    return F.when(F.lower(safe).endswith(".docx"), F.regexp_replace(safe, r"(?i)\.docx$", "-redacted.docx")).otherwise("redacted.docx")


def media_format(name: Column) -> Column:
    """The lower-cased extension, `jpeg` for `jpg`, empty without one."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(ext == "jpg", "jpeg").otherwise(ext)


# Image formats by extension.
PILLOW = {"jpeg": "JPEG", "jpg": "JPEG", "png": "PNG", "gif": "GIF", "bmp": "BMP", "tiff": "TIFF", "tif": "TIFF", "webp": "WEBP"}


def pillow_format(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PILLOW.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.upper(ext))


def image_cache_key(fmt: Column, data: Column) -> Column:
    return F.concat(fmt, F.lit(":"), F.sha2(data, 256))


def is_text_part(name: Column) -> Column:
    """The main document, and headers and footers directly in its folder."""
    return name.rlike(r"^word/(?:document\.xml|(?:header|footer)[^/]*\.xml)$")
