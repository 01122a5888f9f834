"""Personal data by candidate boosting, in native expressions.

Fixed patterns with checks give the base spans. Beside them, generators of high
recall propose overlapping spans: loose, bracketed and spelt-out addresses, and any longer run of digits. Each
candidate becomes a vector of format and context bits; gradient-boosted trees of
depth two score it; candidates from a generator's calibrated threshold on become `boost` spans
unless a base span touches them.

The labels are independent of the base patterns and of the features: the trees are fitted on
planted examples, texts drawn from forms of which it is known whether they are personal data (`POSITIVE`, `NEGATIVE`),
in contexts that help, mislead or say nothing. `draws` bounds how many; one half fits the trees, the other calibrates the
thresholds. No count over the corpus enters, so the model is the same for a corpus of any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.spans import disjoint, let, match_context, match_spans, splice

# The base patterns, written so that no text makes them backtrack far.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
# Generators of candidates: loose addresses, spelt-out ones, and runs of digits.
AT, DOT = r"\s?[\[({](?:at|AT)[\])}]\s?", r"\s?[\[({](?:dot|DOT)[\])}]\s?"
LOOSE = {
    "address": rf"(?:\G|(?<![^\s<>()\[\]{{}},;:\"']))[^\s@<>()\[\]{{}},;:\"']++(?:@|{AT})(?:[^\s@<>()\[\]{{}},;:\"'.!?]|[.!?](?=[^\s@<>()\[\]{{}},;:\"'.!?])|{DOT})++",
    "spelt": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ (?:at|AT) [A-Za-z0-9-]++(?:(?:\.| (?:dot|DOT) )[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:(?:[ ()./-]{0,3}|\[\.\])[0-9]){6,}+",
}
GUARDS = {"address": r"@|[\[({](?:at|AT)[\])}]", "spelt": r" (?:at|AT) [A-Za-z0-9-]++(?:\.| (?:dot|DOT) )[A-Za-z0-9-]", "number": r"[0-9](?:(?:[ ()./-]{0,3}|\[\.\])[0-9]){6}"}
CONTEXT = 24
# Words before a candidate, in the languages of the corpus; forms of numbers.
FILL = r"(?:[^\p{L}]+(?:number|nummer|no|nr|is|are|me|us|at|on|under))*[^\p{L}]{0,8}$"
PHONE_WORDS = r"(?<!\p{L})(?:(?:tele)?phone|tel|call|mobile|cell|fax|telefon|rufnummer|handy|mobil|t[eé]l[eé]phone|t[eé]l|tel[eé]fono|m[oó]vil)" + FILL
MAIL_WORDS = r"(?<!\p{L})(?:e-?mail|mail|contact|write to|reach|correo|courriel|kontakt)" + FILL
NUMBER_WORDS = r"(?<!\p{L})(?:order|invoice|part|ref|reference|isbn|version|id|item|sku|ticket|build|serial|rechnung|bestellung|commande|pedido)" + FILL
NATIONAL = r"^\(?[2-9][0-9]{2}\)?[ ./-]?[2-9][0-9]{2}[ .-][0-9]{4}$"
TRUNK = r"^\(?0[1-9][0-9]{0,4}(?:\) ?|[ ./-])[0-9](?:[ ./-]?[0-9])*$"
DATE = r"^(?:(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][ ./-][0-3]?[0-9][ ./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[ /-]{1,3}(?:19|20)[0-9]{2})(?![0-9])"

# Forms of the planted examples by contexts. In a form # is a digit, N one from 2 on, L the check digit of a card, X a wrong one, w a word, h a host.
BEFORE = {
    "plain": ("the rest of it ", "we saw ", "it was ", "", "und dann ", "avec ", "para "), "phone": ("call ", "tel ", "Telefon: ", "phone number is ", "mobile: ", "móvil ", "téléphone "),
    "mail": ("mail ", "write to ", "contact: ", "reach me at ", "correo "), "number": ("order ", "invoice no ", "part ", "ref ", "ISBN ", "version ", "id ", "build "),
}
AFTER = (", as said", ".", " and so on", "", "; then")
POSITIVE = (
    ("(N##) N##-####", "plain phone"), ("N##-N##-####", "plain phone"), ("N##.N##.####", "plain phone"), ("N## N## ####", "phone"), ("0N## ######", "plain phone"), ("0N#/#######", "plain phone"), ("0N ## ## ## ##", "plain phone"),
    ("(0N#) ### ####", "plain phone"), ("00N# ### #######", "plain phone"), ("N######", "phone"), ("N## ####", "phone"), ("N##-####", "phone"), ("N # # # # # # # # #", "phone"), ("+N## (N##) N##-####", "plain phone"),
    ("4###.####.####.###L", "plain"), ("4###/####/####/###L", "plain"), ("5### - #### - #### - ###L", "plain"), ("4### #### #### ###L", "plain"), ("1##[.]1##[.]1##[.]1##", "plain"), ("1##.1##.1##.##", "plain"),
    ("w.w## [at] h.com", "plain mail"), ("w##(at)h.org", "plain mail"), ("w_w {at} h.net", "plain mail"), ("w## [at] h [dot] net", "plain mail"), ("w.w(at)h(dot)com", "plain mail"), ("w.w at h dot com", "plain mail"),
    ("w## AT h DOT org", "plain mail"), ("w## at h.com", "mail"), ("w.w@h.com", "plain mail"), ("w##@h", "mail"),
)
NEGATIVE = (
    ("20##-0N-1N", "plain number"), ("1#.0N.20##", "plain"), ("0N/1#/199#", "plain"), ("19N#-20##", "plain"), ("########", "plain number"), ("N######", "plain number"), ("978-N-##-######-#", "plain number"), ("N.###.###.###", "plain"),
    ("################", "plain number"), ("4##############X", "plain"), ("4###.####.####.###X", "plain number"), ("20##0N1N1#####", "plain number"), ("5N.######", "plain"), ("N.##.###.##", "number"), ("##-####-###", "plain number"),
    ("300.4##.5##.9##", "plain"), ("N## ### ###", "plain"), ("#### #### ####", "plain"), ("N##-N##-####-##", "number"), ("N## N## ####", "number"), ("0N## ######", "number"), ("# # # # # # # #", "plain"), ("N## ####", "plain"),
    ("w [at] h", "plain"), ("w@h", "plain"), ("w (at) h", "plain"), ("w at h.com", "plain"), ("w at h.5#", "plain"), ("w@@h", "plain"), ("w at h dot", "plain"),
)
NAMES = "ann bob carla dieter eva frank ines jose karin louis marta nils olga pablo rosa sven tina ursula victor yves".split()
HOSTS = "example mailbox kontor atelier empresa werkstatt bureau correo postfach lists inbox office".split()
DRAWS = 200  # of each form


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _kept(spans: Column, test) -> Column:
    return F.filter(spans, lambda x: test(x["value"]))


def _card(value: Column) -> Column:
    d = _digits(value)
    return F.length(d).between(16, 19) & F.call_function("luhn_check", d)


def base_spans(text: Column) -> dict[str, Column]:
    """The checked spans of each kind."""
    return {
        "email": match_spans(text, EMAIL, text.contains("@")),
        "ip": _kept(match_spans(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda v: v.rlike(rf"^(?:{PART}\.){{3}}{PART}$")),
        "card": _kept(match_spans(text, CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){15}")), _card),
        "phone": _kept(match_spans(text, PHONE, text.contains("+")), lambda v: F.length(_digits(v)).between(8, 15)),
    }


def _bits(x: Column) -> list[Column]:
    """Format and context features of a candidate (value, before, after)."""
    value, before, after = x["value"], F.lower(x["before"]), x["after"]
    digits = _digits(value)
    n = F.length(digits)
    plain = _plain(value)
    luhn = F.coalesce((n >= 2) & F.call_function("luhn_check", F.when(n >= 2, digits).otherwise("1")), F.lit(False))
    return [
        value.startswith("+"), value.contains("("), value.rlike(r"[0-9][ -][0-9]"), value.rlike(r"[0-9]\.[0-9]"), n >= 8, n >= 11, n.between(16, 19),
        F.length(F.regexp_replace(plain, r"[^.]", "")) == 3, plain.rlike(rf"^(?:{PART}\.){{3}}{PART}$"), luhn,
        plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), value.contains("@"),
        before.rlike(PHONE_WORDS), after.rlike("^[A-Za-z0-9_]"), value.rlike(NATIONAL), value.rlike(DATE), value.rlike(TRUNK), before.rlike(MAIL_WORDS), value.rlike(AT),
        before.rlike(NUMBER_WORDS), digits.rlike("^[3-6]"), value.rlike(r"^[0-9]{4}([^0-9]+)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), value.rlike(r"^[0-9](?: [0-9])+$"), value.rlike(r"^[0-9]+$"),
        value.startswith("00"), value.contains("["), value.rlike(r" (?:dot|DOT) |[\[({](?:dot|DOT)[\])}]"), value.rlike(r"^[A-Za-z]*[0-9._%+-]+[A-Za-z0-9._%+-]*(?:@|\s| [\[({])"), n.between(9, 12),
    ]


N_BITS = 29


def _plain(value: Column) -> Column:
    """An address or a number with hidden marks undone."""
    at = F.regexp_replace(F.regexp_replace(value, AT, "@"), DOT, ".")
    return F.replace(F.regexp_replace(F.regexp_replace(at, " (?:at|AT) ", "@"), " (?:dot|DOT) ", "."), F.lit("[.]"), F.lit("."))


def planted(spark: SparkSession, draws: int = DRAWS, without: tuple[str, ...] = ()) -> DataFrame:
    """The planted examples: form, good, draw, text, and the first and end code point of the planted value. Forms in `without` are left out."""
    rows = [(f, good, c) for good, forms in ((True, POSITIVE), (False, NEGATIVE)) for f, c in forms if f not in without]
    forms = F.array(*(F.struct(F.lit(f).alias("form"), F.lit(good).alias("good"), F.array(*(F.lit(b) for k in c.split() for b in BEFORE[k])).alias("befores")) for f, good, c in rows))
    drawn = spark.range(draws).withColumnRenamed("id", "draw").select("draw", F.explode(forms).alias("f")).select("draw", "f.*")

    def number(slot: Column | int, below: Column | int) -> Column:
        return F.pmod(F.xxhash64("draw", "form", "good", F.lit(slot) if isinstance(slot, int) else slot), F.lit(below) if isinstance(below, int) else below).cast("int")

    def pick(words, slot) -> Column:
        return F.get(F.array(*map(F.lit, words)), number(slot, len(words)))

    def filled(c: Column, i: Column) -> Column:
        return F.when(c == "#", number(i, 10).cast("string")).when(c == "N", (number(i, 8) + 2).cast("string")).when(c == "w", pick(NAMES, i)).when(c == "h", pick(HOSTS, i)).otherwise(c)

    value = F.array_join(F.transform(F.split("form", ""), filled), "")
    right = F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(_digits(F.col("value")), d.cast("string")))), F.lit(0))
    checked = F.when(F.col("form").endswith("L"), F.replace("value", F.lit("L"), right.cast("string"))).when(F.col("form").endswith("X"), F.replace("value", F.lit("X"), ((right + 3) % 10).cast("string"))).otherwise(F.col("value"))
    before = F.get(F.col("befores"), number(101, F.size("befores")))
    made = drawn.withColumn("value", value).withColumn("value", checked).withColumns({"before": before, "after": pick(AFTER, 102)})
    return made.select("form", "good", "draw", F.concat("before", "value", "after").alias("text"), F.length("before").alias("first"), F.length(F.concat("before", "value")).alias("last"))


def candidates(text: Column) -> Column:
    """array<struct<generator, start, end, bits>> of all generators."""

    def proposed(name: str) -> Column:
        guard, pattern = text.rlike(GUARDS[name]), LOOSE[name]
        both = lambda s, c: F.struct(F.lit(name).alias("generator"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), c["before"].alias("before"), c["after"].alias("after"))
        return F.zip_with(match_spans(text, pattern, guard), match_context(text, pattern, CONTEXT, guard), both)

    def coded(x: Column) -> Column:
        bits = F.lit(0)
        for k, b in enumerate(_bits(x)):
            bits = bits + F.when(b, F.lit(1 << k)).otherwise(0)
        return F.struct(x["generator"].alias("generator"), x["start"].alias("start"), x["end"].alias("end"), bits.alias("bits"))

    return let(F.concat(*map(proposed, LOOSE)), lambda every: F.transform(every, coded))


@dataclass
class Model:
    """trees: (bit, bit if unset, bit if set, four leaf values); thresholds by generator, null where no score is good enough; held: (generator, positives kept, negatives kept, positives) of the calibrating half."""

    bias: float = 0.0
    trees: list[tuple[int, int, int, tuple[float, float, float, float]]] = field(default_factory=list)
    thresholds: dict[str, float | None] = field(default_factory=lambda: dict.fromkeys(LOOSE))
    held: list[tuple[str, int, int, int]] = field(default_factory=list)

    def score(self, bits: int) -> float:
        total = self.bias
        for root, left, right, leaves in self.trees:
            up = bits >> root & 1
            total += leaves[2 * up + (bits >> (right if up else left) & 1)]
        return total

    def expression(self, bits: Column) -> Column:
        """The score, as a fold over the trees, which are one constant."""
        told = ", ".join(f"named_struct('root', {r}, 'low', {a}, 'high', {b}, 'leaves', array({', '.join(f'{float(v)!r}D' for v in leaves)}))" for r, a, b, leaves in self.trees)
        if not told:
            return F.lit(self.bias)
        bit = lambda k: F.call_function("shiftright", bits, k).bitwiseAND(F.lit(1))
        leaf = lambda t: F.get(t["leaves"], bit(t["root"]) * 2 + F.when(bit(t["root"]) == 1, bit(t["high"])).otherwise(bit(t["low"])))
        return F.aggregate(F.expr(f"array({told})"), F.lit(self.bias), lambda total, t: total + leaf(t))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def boost(rows: list[tuple[int, int, int]], rounds: int = 40, rate: float = 0.4, ridge: float = 1.0, n_bits: int = N_BITS) -> Model:
    """Fits trees of depth two by Newton boosting of the log loss on (bits, positives, negatives)."""
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return Model(bias=20.0 if good else -20.0)
    model = Model(bias=_logit(good / (good + bad)))
    has = np.array([[r[0] >> k & 1 for k in range(n_bits)] for r in rows], float)
    yes, n = np.array([r[1] for r in rows], float), np.array([r[1] + r[2] for r in rows], float)
    scores = np.full(len(rows), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-scores))
        sums = []
        for x in (n * p - yes, n * p * (1 - p)):
            both = has.T @ (x[:, None] * has)  # [root, bit] with both set
            one, all_ = x @ has, x.sum()
            sums.append(np.array([[all_ - one[:, None] - one[None, :] + both, one[None, :] - both], [one[:, None] - both, both]]))  # by root side, then bit side
        g, h = sums
        gains = (g * g / (h + ridge)).sum(axis=1)  # [root side, root, bit]
        best = gains.argmax(axis=2)
        root = int(gains.max(axis=2).sum(axis=0).argmax())
        low, high = int(best[0, root]), int(best[1, root])
        leaves = [-g[a, b, root, c] / (h[a, b, root, c] + ridge) for a, c in ((0, low), (1, high)) for b in (0, 1)]
        tree = (root, low, high, tuple(rate * float(np.clip(v, -4, 4)) for v in leaves))
        model.trees.append(tree)
        up = has[:, root] > 0
        scores = np.clip(scores + np.where(up, np.where(has[:, high] > 0, tree[3][3], tree[3][2]), np.where(has[:, low] > 0, tree[3][1], tree[3][0])), -30, 30)
    return model


def fit(spark: SparkSession, draws: int = DRAWS, precision: float = 0.98, without: tuple[str, ...] = ()) -> Model:
    """A model from `draws` planted examples of each form but those in `without`; what comes to the driver is a row of counts for each distinct bit vector.

    A candidate of a personal form is positive if it is the planted value, give or take a
    character at either end; one of another form is negative; others are left out.
    """
    text = F.col("text")
    rows = planted(spark, draws, without).withColumn("proposed", candidates(text))
    half = (F.pmod(F.xxhash64("draw"), F.lit(2)) == 0).alias("fitting")
    near = (F.abs(F.col("x.start") - F.col("first")) <= 1) & (F.abs(F.col("x.end") - F.col("last")) <= 1)
    counts = (
        rows.select(half, "good", "first", "last", F.explode_outer("proposed").alias("x")).filter(F.col("x").isNotNull() & (~F.col("good") | near))
        .groupBy("fitting", "x.generator", "x.bits").agg(F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()
    )
    by_bits: dict[int, list[int]] = {}
    for r in sorted(counts):
        if r["fitting"]:
            pair = by_bits.setdefault(r["bits"], [0, 0])
            pair[0] += r["good"]
            pair[1] += r["bad"]
    model = boost([(b, *v) for b, v in sorted(by_bits.items())])
    for name in LOOSE:
        held = sorted(((model.score(r["bits"]), r["good"], r["bad"]) for r in counts if not r["fitting"] and r["generator"] == name), reverse=True)
        good = bad = 0
        told = (name, 0, 0, sum(h[1] for h in held))
        for i, (score, a, b) in enumerate(held):
            good, bad = good + a, bad + b
            last = i + 1 == len(held) or held[i + 1][0] < score
            if last and score >= 0 and good + bad >= 20 and good >= precision * (good + bad):
                model.thresholds[name], told = score, (name, good, bad, told[3])
        model.held.append(told)
    return model


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and an array (value, start, end) for each of email, ip, card, phone and boost.

    Offsets are code points, end exclusive. A row for each row of `docs`, repeated ones
    too; null ids stay null. Null and empty texts hold nothing. Texts are read whole. Other
    columns are not read. `boost` spans are those that no base span touches, by start and then end; they may overlap each other.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return _with_spans(base, model).select("doc_id", *KINDS, "boost")


def _with_spans(base: DataFrame, model: Model) -> DataFrame:
    """`base` (doc_id, text) with the span columns."""
    text = F.col("text")
    active = [n for n in LOOSE if model.thresholds.get(n) is not None]
    listed = base.select("doc_id", "text", *(c.alias(n) for n, c in base_spans(text).items()), *([candidates(text).alias("proposed")] if active else []))
    covered = lambda x: F.exists(F.concat(*KINDS), lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    boosted = F.expr("cast(array() as array<struct<value:string,start:bigint,end:bigint>>)")
    if active:
        least = lambda x: F.coalesce(*(F.when(x["generator"] == n, F.lit(model.thresholds[n])) for n in active), F.lit(math.inf))
        left = F.filter("proposed", lambda x: ~covered(x) & (model.expression(x["bits"]) >= least(x)))
        order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise((a["end"] - b["end"]).cast("int"))
        boosted = F.array_sort(F.transform(left, lambda x: F.struct(F.lit(None).cast("string").alias("value"), x["start"].alias("start"), x["end"].alias("end"))), order)
    return listed.select("doc_id", "text", *KINDS, boosted.alias("boost"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans from `find`'s result."""
    told = lambda kind: F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))
    listed = found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.array_join(F.concat(*map(told, KINDS)), ",").alias("base"), F.array_join(told("boost"), ",").alias("more"))
    return listed.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif("more", F.lit(""))).alias("spans"))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and text with every span of `find` replaced by its kind in brackets; of overlapping spans the earliest, then longest, counts and the others are covered by it."""
    kind_of = "struct<start:bigint,last:bigint,end:bigint,replacement:string>"
    placed = lambda kind: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("last"), x["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("replacement")))
    every = F.array_sort(F.concat(*map(placed, (*KINDS, "boost"))))
    both = _with_spans(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), model)
    return both.select("doc_id", let(every, lambda x: let(disjoint(x, kind_of), lambda kept: splice(F.col("text"), kept))).alias("text"))
