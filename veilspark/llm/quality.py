"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters: 5-grams, kept exactly as two numbers (`hi`, `lo`) of two and
three 21-bit codes, so every character has its own. Only trusted text is counted. Each order joins
its counts with its context's totals and with the order below; all trusted documents
count, nothing is sampled.

An n-gram's log probability is a sum over the orders. A suffix of an n-gram that the model knows is
known too, so with p0 the uniform base
    log p = log p0 + sum over k of (log p_k - log p_k-1 if the order-k suffix is known, else the back-off weight of its context),
and each term is one entry of a table whose size is that of the trusted text's n-grams, not of the corpus.
Entries are whole numbers of millionths, so sums are exact in any order. The
table is joined in shards of at most `max_entries` rows by (order, context), each broadcast to one pass over
the texts whose partial sums add up: how many shards there are changes no value.

One trusted document in five, by hashed id, is held out of the counts and sets the
bounds: a language's bound is the quantile `quantile` of its held-out log-perplexities, from their
histogram. The mean over a few characters says little, so what is compared is the log-perplexity after
`prior` further characters at the mean of the language's held-out text. A language with fewer
than `least_held_out` held-out documents takes mean and quantile of all languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_IDS, drop, map_arrow, put
from .textbytes import U64, blocks, mix

ORDER, BITS = 5, 21
START, END = 0, 1
BASE_BITS = 12  # the uniform base of a character
UNIT = 1e-6  # of a log probability
QUANTILE, LEAST_HELD_OUT, PRIOR = 0.99, 30, 64
OTHER, TRAINS, HELD_OUT = 0, 1, 2
HELD_OUT_SHARE = 5  # one in so many
MAX_ENTRIES = 2_000_000  # of the table in one broadcast, 28 bytes each
BIN = 0.001  # of log-perplexity
_ONE = (1 << BITS) - 1


#: Characters of a text that are looked at together; longer texts go in stretches that know the characters before them.
STRETCH = 1 << 18


def stretches(texts: list[str], size: int | None = None):
    """(rows, contexts, parts, ends) of lists of stretches: the text of each, the characters before it, and whether the text ends with it."""
    size = size or STRETCH
    rows, contexts, parts, ends, held = [], [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text)), size):
            part = text[at : at + size]
            rows.append(row), contexts.append(text[max(0, at - ORDER + 1) : at]), parts.append(part), ends.append(at + size >= len(text))
            held += len(part)
            if held >= 4 * size:
                yield rows, contexts, parts, ends
                rows, contexts, parts, ends, held = [], [], [], [], 0
    if rows:
        yield rows, contexts, parts, ends


def grams(texts: list[str], contexts: list[str] | None = None, ends: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, which, begin): the distinct 5-grams, of each predicted character and text end its 5-gram, and the first of each text, with one more."""
    contexts = contexts or [""] * len(texts)
    lead = np.array([len(c) for c in contexts], np.int64)
    last = np.ones(len(texts), np.int64) if ends is None else np.array(ends, np.int64)
    codes = np.frombuffer("".join(c + t for c, t in zip(contexts, texts, strict=True)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = np.array([len(t) for t in texts], np.int64) + lead + last
    begin = np.concatenate(([0], np.cumsum(size)))
    flow = np.full(begin[-1], END, np.int64)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:][last == 1] - 1] = False
    flow[inside] = codes + 2
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    kept = place >= np.repeat(lead, size)
    seen = np.zeros(1 << BITS, bool)
    seen[flow], seen[START] = True, True
    own = np.flatnonzero(seen)  # the characters at hand; the places in this list make short keys
    places = np.zeros(1 << BITS, np.int64)
    places[own] = np.arange(len(own))

    def before(k: int) -> np.ndarray:
        out = np.full(begin[-1], START, np.int64)
        out[k:] = flow[: len(flow) - k]
        out[place < k] = START
        return out[kept]

    columns = [before(k) for k in range(ORDER)]  # the predicted character first
    width = max(1, int(len(own) - 1).bit_length())
    if width * ORDER < 64:
        key = np.zeros(len(columns[0]), np.int64)
        for k, c in enumerate(columns):
            key |= places[c] << (width * k)
        distinct, which = np.unique(key, return_inverse=True)
        columns = [own[distinct >> (width * k) & ((1 << width) - 1)] for k in range(ORDER)]
        hi, lo = _packed(columns)
    else:
        hi, lo = _packed(columns)
        hi, lo, which = _distinct(hi, lo)
    return hi, lo, which, np.concatenate(([0], np.cumsum(size - lead)))


def _packed(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return columns[3] | columns[4] << BITS, columns[0] | columns[1] << BITS | columns[2] << 2 * BITS


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.ones(len(hi), bool)
    first[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    which = np.empty(len(hi), np.int64)
    which[order] = np.cumsum(first) - 1
    return hi[first], lo[first], which


def _count(batches):
    """(hi, lo, c) of the 5-grams of each block of texts."""
    for batch in blocks(batches, limit=4 << 20):
        for _, contexts, parts, ends in stretches([t or "" for t in batch.column("text").to_pylist()]):
            hi, lo, which, _ = grams(parts, contexts, ends)
            yield pa.record_batch([pa.array(hi), pa.array(lo), pa.array(np.bincount(which, minlength=len(hi)))], names=["hi", "lo", "c"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified discounts of counts 1, 2 and 3 on; fixed ones where the counts of counts leave them undefined."""
    out = []
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and b and n1 else k / 2
        out.append(min(max(d, 0.05), k - 0.05))
    return out[0], out[1], out[2]


def _suffix(k: int) -> list:
    """hi and lo of the last k codes."""
    mask = lambda n: F.lit((1 << BITS * max(0, n)) - 1)
    return [F.col("hi").bitwiseAND(mask(k - 3)).alias("hi"), F.col("lo").bitwiseAND(mask(min(k, 3))).alias("lo")]


def _context() -> list:
    """hi and lo without the last code."""
    moved = F.shiftleft(F.col("hi").bitwiseAND(F.lit(_ONE)), 2 * BITS)
    return [F.shiftright("hi", BITS).alias("hi"), F.shiftright("lo", BITS).bitwiseOR(moved).alias("lo")]


def entries(counts: DataFrame) -> DataFrame:
    """(kind, hi, lo, value) from the counts (hi, lo, c > 0) of 5-grams: of kind k an n-gram of k codes, of kind k + 8 its context; value in millionths."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts
        levels[k] = levels[k + 1].groupBy(*_suffix(k)).agg(F.count(F.lit(1)).alias("c"))
    below, made, out = None, [], None
    whole = lambda p: F.round(F.log(p) / UNIT).cast("long")
    for k in range(1, ORDER + 1):
        level = put(levels[k], f"order{k}") if k < ORDER else counts
        made.append(level)
        n = level.agg(*(F.sum((F.col("c") == i).cast("long")) for i in range(1, 5))).first()
        d = discounts(*(x or 0 for x in n))
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        level = level.select("hi", "lo", "c", off.alias("off"), F.struct(*_context()).alias("h"), F.struct(*_suffix(k - 1)).alias("s"))
        context = put(level.groupBy("h").agg(F.sum("c").alias("total"), F.sum("off").alias("freed")), f"context{k}")
        made.append(context)
        level = level.join(context, "h")
        level = level.withColumn("q", F.lit(2.0**-BASE_BITS)) if below is None else level.join(below.select(F.struct("hi", "lo").alias("s"), F.col("p").alias("q")), "s")
        p = (F.col("c") - F.col("off") + F.col("freed") * F.col("q")) / F.col("total")
        below = put(level.select("hi", "lo", p.alias("p"), "q"), f"probability{k}")
        made.append(below)
        both = below.select(F.lit(k).alias("kind"), "hi", "lo", (whole(F.col("p")) - whole(F.col("q"))).alias("value"))
        both = both.unionAll(context.select(F.lit(k + 8).alias("kind"), "h.hi", "h.lo", whole(F.col("freed") / F.col("total")).alias("value")))
        out = both if out is None else out.unionAll(both)
    table = put(out, "entries")
    drop(*made)
    return table


def _hash(kind: int | np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(mix(hi.view(U64) + U64(1) * np.asarray(kind, U64)) ^ lo.view(U64))


def _shard(kind: int, hi: np.ndarray, lo: np.ndarray, shards: int) -> np.ndarray:
    """The shard of contexts of `kind` + 8 codes (hi, lo), and of the n-grams that continue them."""
    return (_hash(kind + 16, hi, lo) % U64(shards)).astype(np.int64)


def _shortened(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hi >> BITS, lo >> BITS | (hi & _ONE) << 2 * BITS


def _sharded(shards: int):
    def run(batches):
        for batch in batches:
            kind, hi, lo = (batch.column(c).to_numpy() for c in ("kind", "hi", "lo"))
            part = np.zeros(len(kind), np.int64)
            for k in range(1, ORDER + 1):
                own = kind == k
                part[own] = _shard(k, *_shortened(hi[own], lo[own]), shards)
                own = kind == k + 8
                part[own] = _shard(k, hi[own], lo[own], shards)
            yield pa.record_batch([*batch.columns, pa.array(part)], names=[*batch.schema.names, "shard"])

    return run


class Table:
    """Entries sorted by hash; a hit is compared in full."""

    def __init__(self, kind: np.ndarray, hi: np.ndarray, lo: np.ndarray, value: np.ndarray):
        h = _hash(kind, hi, lo)
        order = np.argsort(h, kind="stable")
        self.h, self.kind, self.hi, self.lo, self.value = h[order], kind[order].astype(np.int8), hi[order], lo[order], value[order].astype(np.int64)
        self.most = int(np.unique(self.h, return_counts=True)[1].max()) if len(h) else 0  # of one hash

    def find(self, kind: int, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is an entry, its value or 0)."""
        found, value = np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        at = np.searchsorted(self.h, _hash(kind, hi, lo))
        for k in range(self.most):
            i = np.minimum(at + k, len(self.h) - 1)
            same = (self.kind[i] == kind) & (self.hi[i] == hi) & (self.lo[i] == lo)
            found |= same
            value[same] = self.value[i[same]]
        return found, value


def _scored(table, shard: int, shards: int):
    """Of each text its key, its predicted characters and the sum of the terms that this shard holds."""

    def run(batches):
        t = Table(*table.value)
        base = round(float(np.log(2.0**-BASE_BITS)) / UNIT)
        for batch in blocks(batches, limit=1 << 20):
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, contexts, parts, ends in stretches([t_ or "" for t_ in batch.column("text").to_pylist()]):
                hi, lo, which, begin = grams(parts, contexts, ends)
                value = np.full(len(hi), base if shard == 0 else 0, np.int64)
                for k in range(1, ORDER + 1):
                    h, l_ = hi & ((1 << BITS * max(0, k - 3)) - 1), lo & ((1 << BITS * min(k, 3)) - 1)
                    ch, cl = _shortened(h, l_)
                    here = np.arange(len(hi)) if shards == 1 else np.flatnonzero(_shard(k, ch, cl, shards) == shard)
                    found, own = t.find(k, h[here], l_[here])
                    rest = here[~found]
                    value[here] += own
                    value[rest] += t.find(k + 8, ch[rest], cl[rest])[1]
                np.add.at(total, rows, np.add.reduceat(value[which], begin[:-1]))
                np.add.at(n, rows, np.diff(begin))
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*rest, pa.array(n), pa.array(total)], names=[*(c for c in batch.schema.names if c != "text"), "n", "total"])

    return run


def perplexities(docs: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(doc_id, lang, role, n, total) of docs (doc_id, lang, text, role): the number of predicted characters and their summed log probability in millionths, under the model of those that train."""
    spark = docs.sparkSession
    counted = map_arrow(docs.filter(F.col("role") == TRAINS).select("text"), _count, "hi long, lo long, c long").groupBy("hi", "lo").agg(F.sum("c").alias("c"))
    counts = put(counted, "grams")
    table = entries(counts)
    drop(counts)
    shards = max(1, -(-table.count() // max_entries))

    def broadcast(rows: DataFrame):
        found = rows.select("kind", "hi", "lo", "value").toArrow()
        return spark.sparkContext.broadcast(tuple(found[c].to_numpy().astype(np.int64) for c in ("kind", "hi", "lo", "value")))

    if shards == 1:
        return map_arrow(docs.select("doc_id", "lang", "role", "text"), _scored(broadcast(table), 0, 1), "doc_id long, lang string, role int, n long, total long")
    split = put(map_arrow(table, _sharded(shards), "kind int, hi long, lo long, value long, shard long"), "shards")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "lang", "role", F.sha2(text, 256).alias("key"), text.alias("text"))
    sums = None
    for i in range(shards):  # a pass each; what comes back is two numbers a text
        held = broadcast(split.filter(F.col("shard") == i))
        part = put(map_arrow(keyed.select("key", "text"), _scored(held, i, shards), "key string, n long, total long").dropDuplicates(["key"]), "partial")
        held.unpersist()
        sums = part if sums is None else sums.unionAll(part)
    sums = sums.groupBy("key").agg(F.max("n").alias("n"), F.sum("total").alias("total"))
    return keyed.select("doc_id", "lang", "role", "key").join(sums, "key").select("doc_id", "lang", "role", "n", "total")


def _quantile(bins: dict[int, int], share: float) -> float:
    """The upper edge of the bin that holds the quantile."""
    left = share * sum(bins.values())
    for b in sorted(bins):
        left -= bins[b]
        if left <= 1e-9:
            return (b + 1) * BIN
    return (max(bins) + 1) * BIN


def bounds_of(counts: list[tuple[str | None, int, int]], quantile: float, least_held_out: int) -> tuple[float | None, dict[str | None, float]]:
    """(bound of all, bounds by language) from (lang, bin, documents)."""
    by: dict[str | None, dict[int, int]] = {}
    every: dict[int, int] = {}
    for lang, b, n in counts:
        for bins in (by.setdefault(lang, {}), every):
            bins[b] = bins.get(b, 0) + n
    return (_quantile(every, quantile) if every else None), {lang: _quantile(bins, quantile) for lang, bins in by.items() if sum(bins.values()) >= least_held_out}


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, max_entries: int = MAX_ENTRIES, least_held_out: int = LEAST_HELD_OUT, prior: int = PRIOR) -> DataFrame:
    """doc_id, lang, n_predicted, perplexity, judged, bound, keep; a row for each row of `docs`.

    Trusted are documents with a label of quality 1. A text is kept if `judged`, its
    perplexity with the `prior` characters, is at most its language's bound. Null and empty texts predict only their end and
    are kept like any text. Null languages are one of their own; null ids are never
    trusted and stay null; repeated rows count each. Without trusted text there is no
    bound and everything is kept; without held-out text the trusted text itself sets the bounds. Other columns are not read.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    flags = rows.select("doc_id").distinct().join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    scored = put(perplexities(_marked(rows, flags), max_entries), "perplexity")
    sums = scored.filter(F.col("role") != OTHER).groupBy("lang", "role").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    used = HELD_OUT if any(r["role"] == HELD_OUT for r in sums) else TRAINS
    sums = [r for r in sums if r["role"] == used]
    own = {r["lang"]: -r["total"] * UNIT / r["n"] for r in sums if r["docs"] >= least_held_out}
    mean = _by_language(own, -sum(r["total"] for r in sums) * UNIT / sum(r["n"] for r in sums) if sums else None)
    scored = scored.withColumns({"x": -F.col("total") * F.lit(UNIT) / F.col("n"), "y": (mean * F.lit(prior) - F.col("total") * F.lit(UNIT)) / (F.col("n") + F.lit(prior))})
    counts = scored.filter(F.col("role") == used).groupBy("lang", F.floor(F.col("y") / BIN).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    every, bounds = bounds_of([(r["lang"], r["bin"], r["n"]) for r in counts], quantile, least_held_out)
    out = scored.withColumn("b", _by_language(bounds, every))
    return out.select(
        "doc_id", "lang", F.col("n").alias("n_predicted"), F.exp("x").alias("perplexity"), F.exp("y").alias("judged"), F.exp("b").alias("bound"), F.coalesce(F.col("y") <= F.col("b"), F.lit(True)).alias("keep")
    )


def _by_language(values: dict[str | None, float], others: float | None):
    out = F.lit(others).cast("double")
    for lang, value in values.items():
        out = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(value)).otherwise(out)
    return out


def _marked(rows: DataFrame, good: DataFrame) -> DataFrame:
    """`rows` with `role`; wide rows are shuffled only if the trusted ids are too many to broadcast."""
    ids = good.select(F.col("doc_id").alias("_id_"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    role = F.when(F.col("_id_").isNull(), OTHER).when(F.pmod(F.xxhash64("_id_"), F.lit(HELD_OUT_SHARE)) == 0, HELD_OUT).otherwise(TRAINS)
    return rows.join(ids, F.col("doc_id") == F.col("_id_"), "left").select("doc_id", "lang", "text", role.alias("role"))
