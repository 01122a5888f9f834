"""DuckDB SQL that mirrors the registered queries."""

from __future__ import annotations

from veilspark.functions import fake as K
from veilspark.functions import patterns as P
from veilspark.operators.detect import _NUMBER, DETECTORS, TYPES
from veilspark.operators.ocr import OCR_DETECTORS

from .texts import SOURCES, duck_sql

AS_OF_YEAR = 2026


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(pattern: str, value: str = "value") -> str:
    return f"regexp_matches({value}, {quoted(pattern)})"


def luhn(digits: str) -> str:
    """The check of a string of digits."""
    d = f"(ascii(substr({digits}, length({digits}) - CAST(i AS INT), 1)) - 48)"
    return f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0"


def _dated(y: str, m: str, d: str) -> str:
    return f"coalesce(year(try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d')) BETWEEN 1900 AND {AS_OF_YEAR}, false)"


def _numeric_date() -> str:
    out = []
    for sep in "/-":
        for form, order in ((f"^[0-9]{{1,2}}{sep}[0-9]{{1,2}}{sep}[0-9]{{4}}$", (3, 1, 2)), (f"^[0-9]{{4}}{sep}[0-9]{{1,2}}{sep}[0-9]{{1,2}}$", (1, 2, 3))):
            y, m, d = (f"split_part(value, '{sep}', {k})" for k in order)
            out.append(f"CASE WHEN {matches(form)} THEN {_dated(y, m, d)} ELSE false END")
    return "(" + " OR ".join(out) + ")"


PLAIN_DATE = "regexp_replace(trim(translate({0}, '.,', '')), '\\s+', ' ', 'g')"


def _named_date(day_first: bool) -> str:
    plain = PLAIN_DATE.format("value")
    day, month = (1, 2) if day_first else (2, 1)
    number = f"CASE lower(split_part({plain}, ' ', {month})) " + " ".join(f"WHEN '{m.lower()}' THEN '{n}'" for m, n in _NUMBER.items()) + " END"
    y, d = f"split_part({plain}, ' ', 3)", f"split_part({plain}, ' ', {day})"
    return _dated(y, number, d)


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_AMERICAN = f"({matches('^1?' + P.NANP + '$', _DIGITS)} AND NOT {matches(P.NANP_NOT, f'right({_DIGITS}, 10)')})"
_PLAIN_CARD = "replace(replace(value, ' ', ''), '-', '')"
VALID = {
    "phone": f"length({_DIGITS}) >= 7 AND CASE WHEN value LIKE '+1%' OR (value LIKE '+%' AND {_DIGITS} LIKE '1%') THEN {_AMERICAN} AND length({_DIGITS}) = 11 WHEN value LIKE '+%' THEN {matches(P.international(), _DIGITS)} ELSE {_AMERICAN} END",
    "ssn": "substr(value, 1, 3)::INT NOT IN (0, 666) AND substr(value, 1, 3)::INT < 900 AND substr(value, 5, 2)::INT <> 0 AND substr(value, 8, 4)::INT <> 0",
    "credit_card": f"length({_PLAIN_CARD}) BETWEEN 13 AND 19 AND {luhn(_PLAIN_CARD)}",
    "ipv4": "list_bool_and(list_transform(string_split(value, '.'), lambda o: o::INT <= 255 AND (o = '0' OR o NOT LIKE '0%')))",
    "ipv6": f"contains(value, ':') AND ({matches(P.IPV6_FULL)} OR ({matches(P.IPV6_SHORT)} AND len(regexp_extract_all(value, '[0-9A-Fa-f]+')) <= 7))",
    "dob_numeric": _numeric_date(),
    "dob_mdy": _named_date(False),
    "dob_dmy": _named_date(True),
}


def spans(name: str, source: str) -> str:
    """(id, match_start, match_end, value) of a detector over (id, text) of a relation."""
    d = DETECTORS[name]
    p = quoted(P.re2(d.pattern, d.unicode))
    length = "list_transform({0}, lambda x: length(x))"
    return (
        f"SELECT id, match_start, match_start + length(value) AS match_end, value FROM (SELECT id, v[i] AS value, (coalesce(list_sum({length.format('g[1:i]')}), 0)"
        f" + coalesce(list_sum({length.format('v[1:i - 1]')}), 0))::BIGINT AS match_start FROM (SELECT id, v, g, unnest(range(1, len(v) + 1)) AS i FROM"
        f" (SELECT id, regexp_extract_all(text, {p}) AS v, string_split_regex(text, {p}) AS g FROM {source} WHERE regexp_matches(text, {p})))) WHERE {VALID.get(name, 'true')}"
    )


def all_matches(source: str, names=tuple(DETECTORS)) -> str:
    return " UNION ALL ".join(
        f"SELECT id, '{DETECTORS[n].type}' AS type, {TYPES.index(DETECTORS[n].type)} AS priority, match_start, match_end, value FROM ({spans(n, source)})" for n in names
    )


def resolved(relation: str, key: str = "id") -> str:
    """The kept matches of (key, type, priority, match_start, match_end, value)."""
    item = "{'s': match_start, 'e': match_end, 'type': type, 'value': value}"
    return (
        f"SELECT {key}, m.type AS type, m.s AS match_start, m.e AS match_end, m.value AS value FROM (SELECT {key}, unnest(list_reduce(list_transform(l, lambda x: [x]),"
        f" lambda acc, x: CASE WHEN x[1].s >= acc[len(acc)].e THEN list_concat(acc, x) ELSE acc END)) AS m FROM (SELECT {key}, list({item} ORDER BY match_start, match_start - match_end, priority, type, match_end, value) AS l"
        f" FROM {relation} GROUP BY {key}))"
    )


def _number(kind: str, slot: int, below: int) -> str:
    return f"(('0x' || substr(sha256('|{kind}|' || value), {8 * slot + 1}, 8))::BIGINT % {below})"


def _pick(kind: str, slot: int, words: list[str]) -> str:
    return f"[{', '.join(map(quoted, words))}][1 + {_number(kind, slot, len(words))}]"


def fake(kind: str) -> str:
    n = lambda slot, below: _number(kind, slot, below)
    w = lambda slot, words: _pick(kind, slot, words)
    text = lambda x: f"CAST({x} AS VARCHAR)"
    if kind == "EMAIL":
        return f"lower({w(0, K.FIRST)}) || '.' || lower({w(1, K.LAST)}) || {text(n(2, 10000))} || '@' || {w(3, K.DOMAIN)}"
    if kind == "PHONE":
        return f"'(' || {text(n(0, 800) + ' + 200')} || ') ' || {text(n(1, 800) + ' + 200')} || '-' || lpad({text(n(2, 10000))}, 4, '0')"
    if kind == "SSN":
        nine = text(n(0, 900_000_000) + " + 100000000")
        return f"substr({nine}, 1, 3) || '-' || substr({nine}, 4, 2) || '-' || substr({nine}, 6, 4)"
    if kind == "CREDIT_CARD":
        body = f"('4' || lpad({text(n(0, 10_000_000))}, 7, '0') || lpad({text(n(1, 10_000_000))}, 7, '0'))"
        d = "(ascii(c) - 48)"
        total = f"list_sum(list_transform(string_split({body}, ''), lambda c, i: CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END))"
        return f"{body} || CAST((10 - {total} % 10) % 10 AS VARCHAR)"
    if kind == "IP_ADDRESS":
        return " || '.' || ".join(text(n(k, 254) + " + 1") for k in range(4))
    if kind == "DATE_OF_BIRTH":
        return f"strftime(DATE '1930-01-01' + CAST({n(0, 27_000)} AS INT), '%m/%d/%Y')"
    if kind == "PERSON":
        return f"{w(0, K.FIRST)} || ' ' || {w(1, K.LAST)}"
    if kind == "ORG":
        return f"{w(0, K.COMPANY)} || ' ' || {w(1, K.KIND)}"
    return f"{text(n(0, 9999) + ' + 1')} || ' ' || {w(1, K.STREET)} || ' ' || {w(2, K.WAY)}"


def fake_case(kind: str = "type") -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{t}' THEN {fake(t)}" for t in K.GENERATORS) + f" ELSE '{K.REDACTED}' END"


def source(name: str) -> str:
    return "(" + duck_sql(SOURCES[name]) + ")"


def with_source(name: str, body: str) -> str:
    return f"WITH src AS {source(name)} {body}"


def redacted_from(relation: str) -> str:
    """(id, n, redacted) of a relation (id, text)."""
    return f"""WITH src AS ({relation}), found AS ({all_matches('src')}), kept AS ({resolved('found')}),
        placed AS (SELECT *, coalesce(lag(match_end) OVER (PARTITION BY id ORDER BY match_start), 0) AS before, {fake_case()} AS replacement FROM kept),
        spliced AS (SELECT id, count(*) AS n, string_agg(substr(text, before + 1, match_start - before) || replacement, '' ORDER BY match_start) AS head, max(match_end) AS last
          FROM placed JOIN src USING (id) GROUP BY id)
        SELECT src.id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN text ELSE head || substr(text, last + 1) END AS redacted FROM src LEFT JOIN spliced ON src.id = spliced.id"""


def redacted(name: str) -> str:
    return redacted_from(duck_sql(SOURCES[name]))


#: The paragraphs of documents, each a run of a package; characters that the format cannot hold are left out.
PARAGRAPHS = r"""
SELECT {'path': path, 'span': span} AS id, regexp_replace(paragraph, '[^\x{9}\x{A}\x{D}\x{20}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g') AS text FROM (
  SELECT CAST(doc_id AS VARCHAR) AS path, unnest(p) AS paragraph, unnest(range(0, len(p))) AS span FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))
"""


OCR_WORDS = """
SELECT doc_id AS img_id, CAST(i AS INT) AS i, text, CASE WHEN i % 17 = 3 THEN 'n/a' ELSE CAST(i * 7 % 100 AS VARCHAR) END AS conf, CAST(i % 8 * 60 AS INT) AS left_, CAST(i // 8 * 14 AS INT) AS top,
  CAST(length(text) * 6 AS INT) AS width, 12 AS height, CAST(i // 320 AS INT) AS block_num, CAST(i // 40 % 8 AS INT) AS par_num, CAST(i // 8 % 5 AS INT) AS line_num
FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS text, unnest(range(0, len(string_split(text, ' ')))) AS i FROM documents)
"""
OCR_KEPT = f"""
words AS ({OCR_WORDS}), kept AS (SELECT * EXCLUDE (conf, text, left_), left_ AS left_px, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, coalesce(try_cast(conf AS DOUBLE), -1.0) AS conf FROM words
  WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND coalesce(try_cast(conf AS DOUBLE), -1.0) >= 30),
spans AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY img_id, block_num, par_num, line_num ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word_start FROM kept),
lines AS (SELECT img_id, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY i) AS line_text, min(i) AS first_i FROM kept GROUP BY ALL)
"""
OCR_ENTITIES = f"""
src AS (SELECT {{'img_id': img_id, 'block_num': block_num, 'par_num': par_num, 'line_num': line_num}} AS id, line_text AS text FROM lines),
found AS ({all_matches('src', OCR_DETECTORS)}), ents AS (SELECT id.img_id AS img_id, id.block_num AS block_num, id.par_num AS par_num, id.line_num AS line_num, type, match_start, match_end, value FROM ({resolved('found')}))
"""
