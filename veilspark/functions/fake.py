"""Fake values: a pure function of type, original value and optional salt.

Equal originals of a type have equal fakes on every partition, run and machine, with no
shared state. Numbers come from slices of SHA-256 of `salt|type|value`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
FIRST = "Alice Ben Clara David Elena Frank Grace Henry Irene Jack Karen Leo Maria Noah Olivia Paul Quinn Rosa Simon Tara".split()
LAST = "Adams Baker Carter Dixon Evans Foster Grant Hayes Irwin Jensen Keller Lopez Morgan Nolan Owens Parker Reyes Stone Turner Walsh".split()
COMPANY = "Northwind Bluepeak Silverline Oakridge Brightwater Stonebridge Clearfield Redwood Ironwood Lakeshore".split()
KIND = "Inc LLC Group Partners Holdings".split()
STREET = "Maple Cedar Birch Walnut Juniper Willow Chestnut Magnolia Sycamore Hawthorn".split()
WAY = "Street Avenue Road Lane Drive Court Boulevard Terrace".split()
DOMAIN = "example.com example.net example.org".split()


def seed(value: Column) -> Column:
    """The first 64 bits of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("decimal(20,0)")


class _Source:
    def __init__(self, kind: str, value: Column, salt: str):
        self.hash = F.sha2(F.concat(F.lit(f"{salt}|{kind}|"), value), 256)

    def number(self, slot: int, below: int) -> Column:
        """0 to `below` - 1 from the slot-th 32 bits."""
        return F.conv(F.substring(self.hash, 8 * slot + 1, 8), 16, 10).cast("bigint") % below

    def pick(self, slot: int, words: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (self.number(slot, len(words)) + 1).cast("int"))


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def email(s: _Source) -> Column:
    return F.concat(F.lower(s.pick(0, FIRST)), F.lit("."), F.lower(s.pick(1, LAST)), s.number(2, 10_000).cast("string"), F.lit("@"), s.pick(3, DOMAIN))


def phone(s: _Source) -> Column:
    return F.concat(F.lit("("), (s.number(0, 800) + 200).cast("string"), F.lit(") "), (s.number(1, 800) + 200).cast("string"), F.lit("-"), _padded(s.number(2, 10_000), 4))


def ssn(s: _Source) -> Column:
    nine = (s.number(0, 900_000_000) + 100_000_000).cast("string")
    return F.concat_ws("-", F.substring(nine, 1, 3), F.substring(nine, 4, 2), F.substring(nine, 6, 4))


def card(s: _Source) -> Column:
    """Sixteen digits that start with 4 and pass the check."""
    body = F.concat(F.lit("4"), _padded(s.number(0, 10_000_000), 7), _padded(s.number(1, 10_000_000), 7))
    doubled = lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    total = F.aggregate(F.transform(F.transform(F.split(body, ""), lambda c: c.cast("int")), doubled), F.lit(0), lambda a, d: a + d)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def ipv4(s: _Source) -> Column:
    return F.concat_ws(".", *((s.number(k, 254) + 1).cast("string") for k in range(4)))


def birth_date(s: _Source) -> Column:
    return F.date_format(F.date_add(F.lit("1930-01-01").cast("date"), s.number(0, 27_000).cast("int")), "MM/dd/yyyy")


def name(s: _Source) -> Column:
    return F.concat_ws(" ", s.pick(0, FIRST), s.pick(1, LAST))


def company(s: _Source) -> Column:
    return F.concat_ws(" ", s.pick(0, COMPANY), s.pick(1, KIND))


def address(s: _Source) -> Column:
    return F.concat_ws(" ", (s.number(0, 9_999) + 1).cast("string"), s.pick(1, STREET), s.pick(2, WAY))


GENERATORS = {
    "EMAIL": email, "PHONE": phone, "SSN": ssn, "CREDIT_CARD": card, "IP_ADDRESS": ipv4, "DATE_OF_BIRTH": birth_date,
    "PERSON": name, "ORG": company, "ADDRESS": address,
}


def fake_of(kind: str, value: Column, salt: str = "", generators: dict = GENERATORS) -> Column:
    return generators[kind](_Source(kind, value, salt)) if kind in generators else F.lit(REDACTED)


def fake(kind: Column, value: Column, salt: str = "", generators: dict = GENERATORS) -> Column:
    """The fake by the type's generator; `[REDACTED]` for a type that has none."""
    out = F.lit(REDACTED)
    for name_ in generators:
        out = F.when(kind == name_, fake_of(name_, value, salt, generators)).otherwise(out)
    return out
