"""Secret scan: fixed patterns, and the guess cost of values in credential contexts.

A value that follows a credential word is judged by the cheapest way to guess it:
dynamic programming over its characters finds the segmentation of least cost into
common words, letters as in words, dates, repeats, keyboard walks and brute-force spans, in bits. Every part of
a walk, of a run of letters and of a repeat may be a span, not only the longest ones. Values
from `least_bits` on are reported as `context` spans beside the fixed patterns.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_arrow

# The kinds in the order in which they are listed at one start.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "context")
# Words after which a value may be a credential, with words joined to them, and what may stand between.
EDGE = r"(?:(?<![A-Za-z0-9])|(?<=(?-i:[a-z0-9]))(?=(?-i:[A-Z])))"
WORDS = rf"(?:pass(?:word|wd|wort|phrase|code)|pwd|kennwort|contrase[nñ]a|mot\ de\ passe|api[ _-]?key|{EDGE}(?:secret|token|access[ _-]?key|private[ _-]?key|credential|bearer|auth(?:ori[sz]ation)?|mdp))"
JOINED = r"(?:s(?![A-Za-z]))?(?:key(?![a-z]))?+(?:[_.-][A-Za-z0-9]++|(?<=(?-i:[a-z0-9]))(?-i:[A-Z])[A-Za-z0-9]*+|[0-9]++)*+(?:[ \t]++(?:key|value|code|string|hash|field|header|id)(?![A-Za-z]))?(?:[ \t]++(?:for|of)[ \t]++[\w@.-]{1,64}+(?<!\.))?"
GAP = r"[ \t\xa0]*+(?:\r?\n[ \t\xa0]*+)?"
SOME = r"(?:[ \t\xa0]++(?:\r?\n[ \t\xa0]*+)?|\r?\n[ \t\xa0]*+)"
# An unquoted value ends before the next assignment, a tag, or a quote that closes something else.
STOP = r"""[,;&]["']?[A-Za-z_][\w.-]*+["']?[:=]|</[A-Za-z][^<>\s]*+>|<(?:br|p|td|tr|li|div|span)\b|["'`](?:[\s,;:)\]}>]|$)"""
CONTEXT = re.compile(
    rf"""(?:{WORDS}{JOINED}["'`]?(?:{GAP}(?::=|=>|->|={{1,3}}|:){GAP}|(?P<prose>[ \t\xa0]++(?:is|was):?{SOME}))|(?P<scheme>{EDGE}(?:bearer|basic){SOME}))"""
    rf"""(?P<quote>["'`])?(?:(?:bearer|basic|digest|token){SOME})?(?P<value>(?(quote)(?:(?!(?P=quote))\S)++|(?:(?!{STOP})\S)++))""",
    re.I | re.A,
)
# One of these is in every text with a context.
STEMS = ("passw", "passp", "passc", "passe", "pwd", "secret", "token", "key", "credential", "bearer", "basic", "auth", "kennwort", "contrase", "mdp")
LEAST_BITS = 40.0
_WALK = math.log2(47)

# Common password words, most common first.
COMMON = (
    "password qwerty admin welcome login letmein dragon master monkey shadow sunshine princess football baseball superman batman "
    "iloveyou trustno hello freedom whatever michael jordan hunter killer ranger buster soccer hockey george charlie andrew "
    "secret token access root user test guest default changeme system server database example sample dummy foobar temp "
    "love money angel summer winter spring autumn flower orange banana cookie pepper ginger computer internet google "
    "company office public private account service manager student school family forever jesus london paris berlin"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LONGEST = max(map(len, COMMON))
# Rows of a keyboard and other sequences that are typed as walks.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
NEXT |= {x[::-1] for x in NEXT}
# The letters that follow a letter in English, German, French and Spanish words, most common first.
FOLLOW = dict(
    a="nrtlsucidmbgpvfkyh", b="eialroust", c="oheatirklusc", d="eiaorusdnl", e="rnsdltcmaivxpufgbyeqhwz", f="oiertaulf", g="eraionulhtsg", h="eaiortnuylm", i="noestclramdgvbfzpeh", j="eaou", k="eoianstlr",
    l="eialdtosuylfk", m="eaiopbmusn", n="tdgesiacokunfvyzlhp", o="nrumslfptcdwvkbgioe", p="eraoliuptsh", q="u", r="eaitosdnumckylgrvbfhwzp", s="teiascohupmkqlnwyv", t="heioarsutlwyzcmp", u="nrstelcimapdbgfvz", v="eioaru",
    w="aiehornsu", x="pticaeu", y="esotnaipml", z="eutiaowz",
)
SPOKEN = {a + b: math.log2(rank + 2) + 1 for a, row in FOLLOW.items() for rank, b in enumerate(row)}
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DATES = tuple(
    re.compile(form, re.A)
    for form in (r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", r"(?:19|20)\d\d")
)
DATE_BITS = {8: math.log2(365 * 200), 4: math.log2(200)}
LONGEST_RUN = 64  # characters of a walk or of letters as in words
MOST_TIMES, LONGEST_UNIT = 16, 8  # of a repeat; one that cannot be longer to its left may have more


def character_bits(value: str) -> float:
    """Bits of one brute-force character: of the classes that the value uses."""
    size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value)
    return math.log2(max(2, size + 33 * any(not c.isalnum() for c in value)))


def _case_bits(value: str, first_upper: bool, others_upper: int, letters: int) -> float:
    """Bits of the case of a span: none, one for a capital or capitals only, else one a character."""
    if not first_upper and not others_upper:
        return 0.0
    if not others_upper or (first_upper and others_upper == letters - 1):
        return 1.0
    return float(len(value))


def _cased(span: str) -> float:
    upper = [c.isupper() for c in span]
    return _case_bits(span, upper[0], sum(upper[1:]), sum(c.isalpha() for c in span))


def guess_bits(value: str) -> float:
    """The least cost of a segmentation: the sum of its spans' bits and one bit for each span but brute-force characters.

    Spans, by their end: words of the list, as they are or with 2 bits for digits and
    marks that stand for letters; dates; walks of 3 to 64 keys; 4 to 64 letters that follow each other
    as in words; units of 1 to 8 characters three times or more (two from 2 characters on), at most 16 times or as
    often as the text before allows, where the unit costs what it costs by itself.
    """
    low = value.lower()
    if len(low) != len(value):  # characters whose lower case is longer stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, n = low.translate(LEET), len(value)
    each = character_bits(value)
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if low[i].isdigit():
            for form in DATES:
                if m := form.match(value, i):
                    digits = sum(c.isdigit() for c in m[0])
                    dates.setdefault(m.end(), []).append((i, DATE_BITS[digits] + 2 * (m.end() - i > digits)))
    cost = [0.0] * (n + 1)
    walk = spoken = 1  # characters of the longest walk and run of letters that end here
    same = [0] * (LONGEST_UNIT + 1)  # characters that equal those a unit before
    for j in range(1, n + 1):
        best = cost[j - 1] + each
        for i, bits in dates.get(j, ()):
            best = min(best, cost[i] + bits + 1)
        for i in range(max(0, j - LONGEST), j - 2):
            for form, extra in ((low, 0.0), (plain, 2.0)):
                if rank := RANK.get(form[i:j]):
                    best = min(best, cost[i] + math.log2(rank + 1) + 2 + _cased(value[i:j]) + extra)
                    break
        pair = low[j - 2 : j] if j > 1 else ""
        walk = min(walk + 1, LONGEST_RUN) if pair in NEXT else 1
        turned = False
        for size in range(3, walk + 1):
            i = j - size
            turned = turned or low[i : i + 2] != low[i + 1 : i + 3][::-1]
            best = min(best, cost[i] + _WALK + math.log2(size) + turned + 1)
        spoken = min(spoken + 1, LONGEST_RUN) if pair in SPOKEN else 1
        if spoken >= 4:
            bits, upper = math.log2(26), [value[j - 1].isupper()]
            for size in range(2, spoken + 1):
                i = j - size
                bits += SPOKEN[low[i : i + 2]]
                first = value[i].isupper()
                if size >= 4:
                    best = min(best, cost[i] + bits + _case_bits(value[i:j], first, sum(upper), size) + 1)
                upper.append(first)
        for unit in range(1, min(LONGEST_UNIT, j - 1) + 1):
            same[unit] = same[unit] + 1 if value[j - 1] == value[j - 1 - unit] else 0
            most = same[unit] // unit + 1
            least = 3 if unit == 1 else 2
            if most >= least:
                bits = _unit_bits(value[j - unit : j]) + 1
                for times in (*range(least, min(most, MOST_TIMES) + 1), most):
                    best = min(best, cost[j - times * unit] + bits + math.log2(times))
        cost[j] = best
    return cost[-1]


_unit_bits = lru_cache(maxsize=8192)(guess_bits)


def worded(value: str) -> bool:
    """Whether a value holds no digit and all its letters follow each other as in words."""
    low = value.lower()
    return not any(c.isdigit() for c in value) and all(not (a.isascii() and b.isascii() and a.isalpha() and b.isalpha()) or a + b in SPOKEN for a, b in zip(low, low[1:], strict=False))


def contexts(text: str, least_bits: float) -> list[tuple[int, int, float]]:
    """(start, end, bits) of the values in credential contexts.

    The guess cost alone decides, but for words: after "is" or a scheme, as in prose, and for
    names of code, which are words joined by dots or underscores.
    """
    low = text.lower()
    if not any(w in low for w in STEMS):
        return []
    out, at = [], 0
    while m := CONTEXT.search(text, at):
        value = m["value"].rstrip(".:!?)]},;>") if m["quote"] is None else m["value"]
        named = m["prose"] is not None or m["scheme"] is not None or re.fullmatch(r"[A-Za-z]+(?:[_.]+[A-Za-z]+)+(?:\(.*)?", value)
        at = m.end()
        if value and not (named and worded(value)) and (bits := guess_bits(value)) >= least_bits:
            out.append((m.start("value"), m.start("value") + len(value), bits))
        elif len(value) <= 64:  # it may itself begin a context
            at = m.start("value")
    return out


def find(text: str | None, least_bits: float = LEAST_BITS) -> list[tuple[int, str, int, float | None]]:
    """(start, kind, end, bits) sorted by start and kind. assign and context spans have their value's bits."""
    text = text or ""
    out = [(m.start(), 0, m.end(), guess_bits(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    out += [(a, 3, b, bits) for a, b, bits in contexts(text, least_bits)]
    return [(s, KINDS[k], e, b) for s, k, e, b in sorted(out, key=lambda x: x[:3])]


def scan(docs: DataFrame, least_bits: float = LEAST_BITS) -> DataFrame:
    """doc_id and secrets: an array of (kind, start, end, bits), in code points, end exclusive, by start and then kind.

    A row for each row of `docs`, repeated ones too; null ids stay null. Null and empty
    texts hold no secrets. Texts are read whole. Other columns are not read.
    """
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e, "bits": b} for s, k, e, b in find(t, least_bits)] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, item)], names=["doc_id", "secrets"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, secrets array<struct<kind:string,start:bigint,end:bigint,bits:double>>")


def redact(docs: DataFrame, mark: str = "[SECRET]", least_bits: float = LEAST_BITS) -> DataFrame:
    """`docs` with each secret in `text` replaced by `mark` (overlapping spans as one); documents stay, other columns too. n_chars, where present, follows the text."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                spans = find(text, least_bits) if text else []
                parts, at = [], 0
                for start, _, end, _ in spans:
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if spans else text)
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["text"] = pa.array(out, batch.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(out, columns["n_chars"].to_pylist(), strict=True)], batch.schema.field("n_chars").type)
            yield pa.record_batch(list(columns.values()), schema=batch.schema)

    return map_arrow(docs, run, schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and the greatest guess cost of a value from `scan`'s result."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS[:3]),
        F.sha2(listed(F.filter("secrets", lambda x: x["kind"] != "context")), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        F.array_max(F.transform("secrets", lambda x: x["bits"])).alias("most_bits"),
    )
