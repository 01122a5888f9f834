"""Detectors: Column expressions from a text to its array of matches.

A match is (start, neg_length, priority, type, end, value); offsets are code points, end
exclusive. The field order is the order in which overlaps are resolved. Every
detector pairs a candidate pattern with a validator and a cheap guard, so texts without
a trace of the type are passed over after one scan. Null and empty texts have no matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions.spans import let, match_pairs, placed
from veilspark.functions.text import digits, luhn, plain_date, strip_separators, year_bounds

MATCH = "struct<start:bigint,neg_length:bigint,priority:int,type:string,end:bigint,value:string>"
# The types in the order in which their detectors are registered.
TYPES = ("EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS", "DATE_OF_BIRTH", "PERSON", "ORG", "ADDRESS")


@dataclass(frozen=True)
class Options:
    #: Whose national form a phone number without a calling code has; one that `patterns` doesn't list is an error.
    region: str = "US"
    as_of_year: int = 2026
    #: North American area codes in use; without them the numbering rule alone decides.
    area_codes: tuple[str, ...] = ()
    #: Word bounds, spaces and digits of the pattern recognisers are the ASCII ones, as in SQL with RE2; else Unicode ones.
    ascii_classes: bool = False

    @classmethod
    def from_conf(cls, spark: SparkSession) -> Options:
        """From the session's veilspark.region, veilspark.asOfYear and veilspark.areaCodes (comma-separated), with the defaults above."""
        get = lambda key, default: spark.conf.get(f"veilspark.{key}", default)
        codes = get("areaCodes", "")
        return cls(get("region", cls.region), int(get("asOfYear", str(cls.as_of_year))), tuple(c.strip() for c in codes.split(",") if c.strip()))


def no_matches() -> Column:
    return F.expr(f"cast(array() as array<{MATCH}>)")


def priority_of(kind: str) -> int:
    """A kind that is not among `TYPES` comes after all of them."""
    return TYPES.index(kind) if kind in TYPES else len(TYPES)


def _match(kind: Column, priority: Column, span: Column) -> Column:
    return F.struct(
        span["start"].alias("start"), (span["start"] - span["end"]).alias("neg_length"), priority.alias("priority"), kind.alias("type"),
        span["end"].alias("end"), span["value"].alias("value"),
    )


def as_match(kind: str, span: Column) -> Column:
    return _match(F.lit(kind), F.lit(priority_of(kind)), span)


def valid_card(value: Column) -> Column:
    plain = strip_separators(value)
    return F.length(plain).between(13, 19) & luhn(plain)


def valid_ssn(value: Column) -> Column:
    """Area not 000, 666 or 900 and over; group not 00; serial not 0000."""
    return value.rlike(P.SSN_VALID)


def valid_ipv6(value: Column) -> Column:
    groups = F.size(F.regexp_extract_all(value, F.lit("[0-9A-Fa-f]+"), F.lit(0)))
    return value.rlike(P.IPV6_FULL) | (value.rlike(P.IPV6_SHORT) & (groups <= 7))


def valid_phone(value: Column, region: str, area_codes: tuple[str, ...] = ()) -> Column:
    """At least seven digits, and a number by the numbering rules that `patterns` lists; a subset of what a full metadata library knows."""
    d = digits(value)
    american = d.rlike(f"^1?{P.NANP}$") & ~F.right(d, F.lit(10)).rlike(P.NANP_NOT)
    if area_codes:
        american = american & F.substring(F.right(d, F.lit(10)), 1, 3).isin(*area_codes)
    abroad = d.rlike(P.international())
    form = P.national(region)
    national = american if form is None else d.rlike(form)
    return (F.length(d) >= 7) & F.when(value.startswith("+"), F.when(d.startswith("1"), american & (F.length(d) == 11)).otherwise(abroad)).otherwise(national)


_NUMBER = {m: i % 12 + 1 for i, m in enumerate("January February March April May June July August September October November December".split())}
_NUMBER |= {m[:3]: n for m, n in list(_NUMBER.items())}


def _month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for m, n in _NUMBER.items() for x in (m.lower(), n)])
    return F.try_element_at(table, F.lower(name))


def _day(year: Column, month: Column, day: Column, as_of_year: int) -> Column:
    """The numbers are a day of the calendar between 1900 and the year given. By arithmetic: a parser's failures cost far more than its successes."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when(leap, 29).otherwise(28)
    return F.coalesce(year_bounds(year, as_of_year) & month.between(1, 12) & day.between(F.lit(1), days), F.lit(False))


def _int(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i)).try_cast("int")


def valid_numeric_date(value: Column, as_of_year: int) -> Column:
    """M/D/YYYY, M-D-YYYY, YYYY-M-D or YYYY/M/D."""
    us, iso = r"^[0-9]{1,2}([/-])[0-9]{1,2}\1[0-9]{4}$", r"^[0-9]{4}([/-])[0-9]{1,2}\1[0-9]{1,2}$"
    order = lambda p, y, m, d: _day(_int(p, y), _int(p, m), _int(p, d), as_of_year)
    return let(F.split(F.translate(value, "/", "-"), "-"), lambda p: F.when(value.rlike(us), order(p, 2, 0, 1)).when(value.rlike(iso), order(p, 0, 1, 2)).otherwise(False))


def valid_named_date(value: Column, as_of_year: int, day_first: bool) -> Column:
    """`January 2 2006` or `Jan 2 2006`, and the forms with the day first; no other abbreviations."""
    day, month = (0, 1) if day_first else (1, 0)
    return let(
        F.split(plain_date(value), " "),
        lambda p: F.when(F.size(p) == 3, _day(_int(p, 2), _month_number(F.get(p, F.lit(month))), _int(p, day), as_of_year)).otherwise(False),
    )


@dataclass(frozen=True)
class Detector:
    type: str
    pattern: str
    unicode: bool = False
    valid: Callable[[Column, Options], Column] | None = None
    guard: Callable[[Column], Column] | None = None
    #: How sure a match is; checked types are certain. It is reported, never used to filter.
    score: float = 1.0

    @property
    def needs_digit(self) -> bool:
        return self.pattern in (P.PHONE, P.SSN, P.CARD, P.IPV4, P.DATE, P.MDY, P.DMY, P.ADDRESS_US, P.ADDRESS_IN_PIN)

    def pairs(self, text: Column, has_digit: Column | None = None, options: Options = Options()) -> Column:
        """The candidates, as `match_pairs` gives them. `has_digit` spares texts without digits the guards of detectors that need one."""
        guard = self.guard(text) if self.guard else text.isNotNull()
        if has_digit is not None and self.needs_digit:
            guard = has_digit & guard
        return match_pairs(text, P.java(self.pattern, self.unicode, options.ascii_classes), guard)

    def __call__(self, text: Column, options: Options = Options()) -> Column:
        spans = let(self.pairs(text, options=options), placed)
        if self.valid:
            spans = F.filter(spans, lambda s: self.valid(s["value"], options))
        return F.transform(spans, lambda s: as_match(self.type, s))


def _trace(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


DETECTORS: dict[str, Detector] = {
    "email": Detector("EMAIL", P.EMAIL, guard=lambda t: t.contains("@")),
    "phone": Detector("PHONE", P.PHONE, valid=lambda v, o: valid_phone(v, o.region, o.area_codes), guard=_trace(r"[0-9][0-9().\-\t\n\f\r ]{6}")),
    "ssn": Detector("SSN", P.SSN, valid=lambda v, o: valid_ssn(v), guard=_trace("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    "credit_card": Detector("CREDIT_CARD", P.CARD, valid=lambda v, o: valid_card(v), guard=_trace("[0-9](?:[ -]?[0-9]){12}")),
    "ipv4": Detector("IP_ADDRESS", P.IPV4, valid=lambda v, o: v.rlike(P.IPV4_VALID), guard=_trace(r"[0-9]\.[0-9]{1,3}\.[0-9]")),
    "ipv6": Detector("IP_ADDRESS", P.IPV6, valid=lambda v, o: v.contains(":") & valid_ipv6(v), guard=lambda t: t.contains("::") | t.rlike(":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:")),
    "dob_numeric": Detector("DATE_OF_BIRTH", P.DATE, valid=lambda v, o: valid_numeric_date(v, o.as_of_year), guard=_trace("[0-9][/-][0-9]{1,2}[/-][0-9]")),
    "dob_mdy": Detector("DATE_OF_BIRTH", P.MDY, valid=lambda v, o: valid_named_date(v, o.as_of_year, False), guard=_trace(r"[0-9],?[\t\n\f\r ]+[0-9]{4}")),
    "dob_dmy": Detector("DATE_OF_BIRTH", P.DMY, valid=lambda v, o: valid_named_date(v, o.as_of_year, True), guard=_trace(rf"(?i)[0-9][\t\n\f\r ]+(?:{P.MONTHS})")),
    "org_suffix": Detector("ORG", P.ORG, unicode=True, guard=_trace(rf"(?U)\s(?:{P.SUFFIX})(?:\b|(?![0-9A-Za-z_]))"), score=P.SCORES["org_suffix"]),
    "address_us": Detector("ADDRESS", P.ADDRESS_US, unicode=True, guard=_trace(r"(?U)\d\s+[A-Z]"), score=P.SCORES["address_us"]),
    "address_in_locality": Detector("ADDRESS", P.ADDRESS_IN_LOCALITY, unicode=True, guard=_trace(rf"(?=[A-Z])(?:{P.LOCALITY})"), score=P.SCORES["address_in_locality"]),
    "address_in_house": Detector("ADDRESS", P.ADDRESS_IN_HOUSE, unicode=True, guard=_trace(r"(?U)[tTyYsSſ]\.?\s*[nN][oO]"), score=P.SCORES["address_in_house"]),
    "address_in_pin": Detector("ADDRESS", P.ADDRESS_IN_PIN, unicode=True, guard=_trace(r"(?U)\d{3}\s?\d{3}"), score=P.SCORES["address_in_pin"]),
}


def from_entities(entities: Column, kind: str) -> Column:
    """Matches from a provider's array of (type, start, end, text, confidence): those whose type is `kind`; null counts as none."""
    kept = F.filter(entities, lambda e: e["type"] == kind)
    return F.coalesce(F.transform(kept, lambda e: as_match(kind, F.struct(e["text"].alias("value"), e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end")))), no_matches())


def full_names(entities: Column) -> Column:
    """PERSON entities only if they have two tokens or more; others as they are."""
    return F.filter(entities, lambda e: (e["type"] != "PERSON") | full_name(e["text"]))


def full_name(value: Column) -> Column:
    return F.size(F.filter(F.split(value, r"\s+"), lambda t: t != "")) >= 2


def confidences() -> Column:
    """A map literal from detector name to score."""
    return F.create_map(*[F.lit(x) for name, d in DETECTORS.items() for x in (name, d.score)])


def detect_all(text: Column, names: tuple[str, ...] | None = None, options: Options = Options(), extra: tuple[Column, ...] = ()) -> Column:
    """The matches of all detectors (or those named), duplicates kept, and those of `extra` match arrays.

    Candidates are listed by each detector, then placed and checked by one expression over the
    list, so the expression is built and analysed once, not once a detector.
    """
    chosen = [DETECTORS[n] for n in names or DETECTORS]
    if not chosen:
        return F.concat(no_matches(), *extra)

    def valid(place: Column, value: Column) -> Column:
        out = F.lit(True)
        for k, d in enumerate(chosen):
            out = F.when(place == k, d.valid(value, options)).otherwise(out) if d.valid else out
        return out

    def listed(digit: Column) -> Column:
        row = lambda k, d: F.struct(F.lit(k).alias("k"), F.lit(d.type).alias("type"), F.lit(priority_of(d.type)).alias("priority"), d.pairs(text, digit, options).alias("pairs"))
        return F.array(*(row(k, d) for k, d in enumerate(chosen)))

    def matches(x: Column) -> Column:
        kept = F.filter(placed(x["pairs"]), lambda s: valid(x["k"], s["value"]))
        return F.transform(kept, lambda s: _match(x["type"], x["priority"], s))

    found = let(F.coalesce(text.rlike(r"\p{Nd}"), F.lit(False)), lambda digit: F.flatten(F.transform(F.filter(listed(digit), lambda x: F.size(x["pairs"]) > 0), matches)))
    return F.concat(found, *extra) if extra else found
