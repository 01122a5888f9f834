"""Detector cases: values that must and must not be found."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspark.functions import patterns
from veilspark.functions.spans import match_spans
from veilspark.functions.text import luhn
from veilspark.operators.detect import DETECTORS, Options, confidences, detect_all, from_entities, full_names, valid_named_date, valid_numeric_date, valid_phone

CASES = [
    ("email", "Contact nora.fields@example.com or support+billing@example.co.uk for help.", ["nora.fields@example.com", "support+billing@example.co.uk"]),
    ("email", "Ticket #1234 was resolved on version 2.0 of the app.", []),
    ("email", "éa@b.com", ["a@b.com"]),
    ("phone", "Call us at (415) 555-0132 or +1-415-555-0148 for support.", ["(415) 555-0132", "+1-415-555-0148"]),
    ("phone", "UK office: +44 20 7946 0958.", ["+44 20 7946 0958"]),
    ("phone", "Server 192.168.1.100 rejected connection from 999.999.999.999.", []),
    ("phone", "The meeting is scheduled for 12-25 at gate 42.", []),
    ("phone", "call 415-555-0132 2024 now", []),
    ("phone", "(415) 555-0132\n(415) 555-0148", []),
    ("phone", "(555) 234-5678 and 999-234-5678", []),
    ("ssn", "Employee SSN on file: 523-45-6789.", ["523-45-6789"]),
    ("ssn", "000-45-6789 666-45-6789 901-45-6789 523-00-6789 523-45-0000", []),
    ("ssn", "Order number 523456789 was shipped.", []),
    ("ssn", "1-523-45-6789", ["523-45-6789"]),
    ("credit_card", "Card on file: 4111 1111 1111 1111 (Visa test number).", ["4111 1111 1111 1111"]),
    ("credit_card", "4111-1111-1111-1111 was charged.", ["4111-1111-1111-1111"]),
    ("credit_card", "Reference order number 4111111111111112 was shipped today.", []),
    ("credit_card", "4111111111111111 123", []),
    ("credit_card", "4111111111111111 4111111111111111", ["4111111111111111", "4111111111111111"]),
    ("ipv4", "Server at 192.168.1.100, 01.2.3.4 and 999.999.999.999; 1.2.3.4.5", ["192.168.1.100", "1.2.3.4"]),
    ("ipv4", "é1.2.3.4 x 10.0.0.1é", ["1.2.3.4", "10.0.0.1"]),
    ("ipv6", "forwarded to 2001:db8::1 and back to ::1.", ["2001:db8::1", "::1"]),
    ("ipv6", "12:30:45 aa:bb:cc:dd:ee:ff 1::2::3 1:2:3:4:5:6:7::8", []),
    ("ipv6", "std::vector a::b ::ffff:1.2.3.4", ["d::", "a::b", "::ffff:1"]),
    ("dob_numeric", "DOB: 05/12/1990. Registered on 1990-05-12 in the system.", ["05/12/1990", "1990-05-12"]),
    ("dob_numeric", "13/45/2020, 25/12/1990, 05/12-1990, 07/04/1785, 12/31/2099, 02/30/1990", []),
    ("dob_mdy", "Born on January 5, 1990; Jan. 5, 1990; february 28 2001", ["January 5, 1990", "Jan. 5, 1990", "february 28 2001"]),
    ("dob_mdy", "February 30, 1990 and Sept 5, 1990", []),
    ("dob_dmy", "again referenced as 5 January 1990.", ["5 January 1990"]),
    ("org_suffix", "The contract was signed with Global Dynamics LLC yesterday.", ["Global Dynamics LLC"]),
    ("org_suffix", "Nora Fields works at Acme Corp on weekdays.", ["Acme Corp"]),
    ("org_suffix", "Étoile Noire Ltd. and Acme L.L.C. did", ["Noire Ltd"]),
    ("address_us", "Please ship the package to 123 Main Street, Suite 400.", ["123 Main Street, Suite 400"]),
    ("address_in_locality", "Road closed ahead", ["Road closed"]),
    ("address_in_house", "snow, 11/3, 11/4", ["snow"]),
    ("address_in_pin", "Invoice 123456", ["Invoice 123456"]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(CASES)], "i int, name string, text string").coalesce(1)
    out = {}
    for name, detector in DETECTORS.items():
        for r in rows.filter(F.col("name") == name).select("i", "text", detector(F.col("text"), Options(as_of_year=2026)).alias("m")).collect():
            assert all(r["text"][m["start"] : m["end"]] == m["value"] for m in r["m"])
            out[r["i"]] = [m["value"] for m in r["m"]]
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(i, found):
    assert found[i] == CASES[i][2]


def test_region(spark):
    df = spark.createDataFrame([("69765 43210",)], "text string")
    count = lambda region: df.select(F.size(DETECTORS["phone"](F.col("text"), Options(region=region)))).first()[0]
    assert (count("IN"), count("US"), count("DE")) == (1, 0, 0)


def test_area_codes_in_use(spark):
    df = spark.createDataFrame([("(987) 654-3210 and (415) 654-3210",)], "text string")
    values = lambda **o: df.select(DETECTORS["phone"](F.col("text"), Options(**o))["value"]).first()[0]
    assert (len(values()), values(area_codes=("415", "212"))) == (2, ["(415) 654-3210"])


def test_luhn(spark):
    rows = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("79927398713",), ("79927398710",), ("12a",), ("",), (None,)], "d string")
    assert [r[0] for r in rows.select(luhn(F.col("d"))).collect()] == [True, False, True, False, False, False, None]


def test_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",)], "text string")
    assert [r[0] for r in rows.select(F.size(detect_all(F.col("text")))).collect()] == [0, 0]


def test_many_matches_keep_their_places(spark):
    text = "é" + "ab12 " * 1000
    row = spark.createDataFrame([(text,)], "text string").select(match_spans(F.col("text"), "[0-9]+").alias("m")).first()["m"]
    assert [(m["start"], m["end"]) for m in row] == [(3 + 5 * k, 5 + 5 * k) for k in range(1000)]


def test_entities_keep_their_label(spark):
    schema = "e array<struct<type:string,start:int,end:int,text:string,confidence:double>>"
    rows = spark.createDataFrame([([("PERSON", 0, 11, "Nora Fields", 0.8), ("ORG", 20, 26, "Acme B", 0.6), ("PERSON", 30, 35, "Suite", 0.8)],), (None,)], schema)
    got = rows.select(from_entities(full_names(F.col("e")), "PERSON").alias("m")).collect()
    assert [[m["value"] for m in r["m"]] for r in got] == [["Nora Fields"], []]


def test_options_from_the_session(spark):
    spark.conf.set("veilspark.region", "IN")
    spark.conf.set("veilspark.areaCodes", "415, 212")
    try:
        assert Options.from_conf(spark) == Options("IN", 2026, ("415", "212"))
    finally:
        spark.conf.unset("veilspark.region")
        spark.conf.unset("veilspark.areaCodes")


def test_scores(spark):
    row = spark.range(1).select(confidences().alias("c")).first()["c"]
    assert row["email"] == 1.0 and row["org_suffix"] == 0.85 and row["address_in_house"] == 0.6


@pytest.mark.parametrize(
    ("region", "good", "bad"),
    [("AU", "02 9374 4000", "02 9374"), ("JP", "03-1234-5678", "03-1234-56789-01"), ("ES", "912 345 678", "912 345 678 901"), ("IT", "06 6982 1234", "16 6982 1234"), ("RU", "8 495 123-45-67", "2 495 123-45-67"), ("PR", "787-234-5678", "087-234-5678"), ("IN", "098765 43210", "055555 55555"), ("HU", "06 1 234 5678", "06 0 234 5678")],
)
def test_national_forms_by_region(spark, region, good, bad):
    rows = spark.createDataFrame([(good,), (bad,)], "v string").select(valid_phone(F.col("v"), region).alias("ok"))
    assert [r["ok"] for r in rows.collect()] == [True, False]


def test_every_calling_code_has_a_region_and_others_are_refused(spark):
    assert sorted(patterns.REGIONS.values()) == sorted(patterns.CALLING) and set(patterns.NATIONAL) <= set(patterns.REGIONS)
    with pytest.raises(ValueError):
        valid_phone(F.lit("1"), "XX")


def test_days_of_the_calendar_are_those_of_the_standard_library(spark):
    """Every day number of 1 to 31 in every month of leap and common years, and the bounds of years."""
    from datetime import date

    def real(y, m, d):
        try:
            return 1900 <= date(y, m, d).year <= 2026
        except ValueError:
            return False

    names = "January February March April May June July August September October November December".split()
    days = [(y, m, d) for y in (1899, 1900, 1904, 2000, 2023, 2024, 2026, 2027, 9999, 0) for m in range(0, 14) for d in range(0, 33)]
    rows = [(f"{m}/{d}/{y:04d}", f"{y:04d}-{m:02d}-{d:02d}", f"{names[m - 1]} {d}, {y:04d}" if 1 <= m <= 12 else f"Smarch {d} {y:04d}", f"{d} {names[m - 1][:3]}. {y:04d}" if 1 <= m <= 12 else "1 May", real(y, m, d)) for y, m, d in days]
    found = spark.createDataFrame(rows, "us string, iso string, mdy string, dmy string, truth boolean").select(
        valid_numeric_date(F.col("us"), 2026).alias("us"), valid_numeric_date(F.col("iso"), 2026).alias("iso"), valid_named_date(F.col("mdy"), 2026, False).alias("mdy"), valid_named_date(F.col("dmy"), 2026, True).alias("dmy"), "truth"
    )
    assert found.filter("us <> truth OR iso <> truth OR mdy <> truth OR dmy <> truth OR us IS NULL OR iso IS NULL OR mdy IS NULL OR dmy IS NULL").count() == 0
    other = spark.createDataFrame([("1/2-2003",), ("2003/1-2",), ("1/2/203",), ("20031/1/2",), ("",), (None,)], "v string")
    assert not any(r["x"] for r in other.select(valid_numeric_date(F.col("v"), 2026).alias("x")).collect())
