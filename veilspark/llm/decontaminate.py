"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by k = floor(m * error_rate)
edits. Cut into k + 1 pieces, at least one piece is untouched in any such passage,
so exact piece hits lose no match. Each hit fixes a window, hits on neighbouring
diagonals share one, and Myers' bit-parallel distance decides.

A benchmark of at most BLOCK_CHARS characters goes to every worker, where one
Aho-Corasick automaton finds the pieces in one pass over each whole text. A larger
one never leaves the executors: pieces and the windows of texts are joined by a rolling
hash, behind a bitmap of fixed size, and both ways give the same rows. There the
documents are read once too; their hits, and the texts once, are shuffled.

Texts are compared lower-cased and with runs of white space as one space.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import join_ids, map_arrow, put

ERROR_RATE = 0.08
#: Characters of items that one automaton holds, some 100 bytes of a worker's memory each; more items are joined.
BLOCK_CHARS = 1_000_000
#: Characters of a piece that the join's key covers; the window's distance decides about the rest.
KEY_CHARS = 16
#: Two to this many bits in the bitmap of piece keys: 8 MB. More pieces than bits make it admit more, never less.
BITMAP_BITS = 26
#: Characters hashed at a time.
STEP = 1 << 16


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(place, piece) of the k + 1 parts of near-equal length."""
    n = int(len(item) * rate) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(pattern: str, text: str) -> tuple[int, int]:
    """(least edits between `pattern` and any substring of `text`, end of the first such substring)."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    top, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(across | plus) & full
        down = plus & across
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        eq |= minus
        plus = down | ~(eq | up) & full
        minus = up & eq
        if score < best:
            best, end = score, j
            if not best:
                break
    return best, end


def best_place(text: str, pattern: str, budget: int, starts) -> tuple[int, int, int]:
    """(edits, from, to) of the pattern's place of fewest edits near the given starts; budget + 1 edits if there is none within the budget."""
    best = (budget + 1, 0, 0)
    spans: list[list[int]] = []
    for s in sorted(starts):
        if spans and s - budget <= spans[-1][1]:
            spans[-1][1] = s + len(pattern) + budget
        else:
            spans.append([max(0, s - budget), s + len(pattern) + budget])
    for low, high in spans:
        exact = text.find(pattern, low, high)
        if exact >= 0:
            return 0, exact, exact + len(pattern)
        edits, end = distance(pattern, text[low:high])
        if edits < best[0]:
            best = (edits, max(low, low + end - len(pattern) - edits), low + end)
    return best


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate)) for i, t in ((i, normal(t)) for i, t in items) if t]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, _) in enumerate(self.items):
            for place, piece in pieces(text, rate):
                at[piece].append((k, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, from, to) of each item that `text` holds within its budget, at the place of fewest edits; from and to bound the compared window's match."""
        if not len(self.automaton):
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, where) in self.automaton.iter(text):
            for k, place in where:
                starts[k].add(end + 1 - size - place)
        found = []
        for k, at in starts.items():
            item, pattern, budget = self.items[k]
            best = best_place(text, pattern, budget, at)
            if best[0] <= budget:
                found.append((item, *best))
        return sorted(found, key=lambda x: (x[0] is None, x))


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def window_keys(text: str, size: int) -> np.ndarray:
    """A 64-bit key of each window of `size` characters, by differences of one running sum."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n < size:
        return np.empty(0, np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    powers, inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, f, np.uint64)])) for f in (_ODD, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
    keys = (sums[size:] - sums[:-size]) * inverse[: n - size + 1] + np.uint64(size)
    keys = (keys ^ keys >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return keys ^ keys >> np.uint64(32)


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def _normalised(batches):
    for batch in batches:
        at = batch.schema.names.index("text")
        yield batch.set_column(at, "text", pa.array([normal(t) for t in batch.column("text").to_pylist()], pa.string()))


def _joined(docs: DataFrame, items: DataFrame, rate: float) -> DataFrame:
    """digest, doc_id, item_id, edits, start, end of each match; digest is the SHA-256 of the document's text. `docs` has doc_id and text, `items` item_id and text."""
    items = put(map_arrow(items.select("item_id", "text"), _normalised, items.select("item_id", "text").schema).filter("text <> ''"), "decontaminate-items")
    patterns = put(items.select("text").distinct().select(F.monotonically_increasing_id().alias("pid"), F.col("text").alias("pattern")), "decontaminate-patterns")

    def cut(batches):
        for batch in batches:
            rows = [
                (p, place, min(len(piece), KEY_CHARS), int(window_keys(piece[:KEY_CHARS], min(len(piece), KEY_CHARS)).view(np.int64)[0]))
                for p, t in zip(batch.column("pid").to_pylist(), batch.column("pattern").to_pylist(), strict=True)
                for place, piece in pieces(t, rate)
                if piece
            ]
            pid, place, size, key = list(zip(*rows, strict=True)) or [()] * 4
            yield _batch({"pid": (pid, pa.int64()), "place": (place, pa.int64()), "size": (size, pa.int32()), "key": (key, pa.int64())})

    cuts = put(map_arrow(patterns, cut, "pid long, place long, size int, key long"), "decontaminate-pieces")
    sizes = sorted(r[0] for r in cuts.select("size").distinct().collect())  # KEY_CHARS at most
    bit = F.shiftrightunsigned("key", 64 - BITMAP_BITS)
    words = cuts.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, int(shiftrightunsigned(key, {64 - BITMAP_BITS}) & 63)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << BITMAP_BITS - 6, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    bitmap = bitmap.view(np.uint64)

    nodes = docs.filter("text <> ''").select(F.monotonically_increasing_id().alias("node"), F.sha2("text", 256).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = put(map_arrow(nodes, _normalised, nodes.schema), "decontaminate-texts")

    def look(batches):
        kinds = ("node", "key", "at")
        held, n = [], 0
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for low in range(0, len(text), STEP):
                    for size in sizes:
                        keys = window_keys(text[low : low + STEP + size - 1], size)
                        bits = keys >> np.uint64(64 - BITMAP_BITS)
                        hit = np.flatnonzero(bitmap[bits >> np.uint64(6)] >> (bits & np.uint64(63)) & np.uint64(1))
                        if len(hit):
                            held.append((np.full(len(hit), node, np.int64), keys[hit].view(np.int64), hit.astype(np.int64) + low))
                            n += len(hit)
                    if n >= STEP:
                        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=list(kinds))
                        held, n = [], 0
        if held:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=list(kinds))

    hits = map_arrow(nodes.select("node", "text"), look, "node long, key long, at long")
    near = hits.join(cuts, "key").groupBy("node", "pid").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))
    size = F.length("pattern")
    # the window from the first to the last start, with room for the budget; places count from its begin
    near = (
        near.join(patterns, "pid")
        .withColumn("budget", F.floor(size * F.lit(rate)).cast("int"))
        .withColumn("low", F.greatest(F.lit(0).cast("long"), F.array_min("starts") - F.col("budget") - 1))
        .withColumn("high", F.array_max("starts") + size + F.col("budget") + 1)
        .join(nodes, "node")
        .select("digest", "doc_id", "pid", "pattern", "starts", "low", F.substring("text", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("window"))
    )

    def verify(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                budget, low = int(len(r["pattern"]) * rate), r["low"]
                edits, a, b = best_place(r["window"], r["pattern"], budget, [s - low for s in r["starts"]])
                if edits <= budget:
                    rows.append((r["digest"], r["doc_id"], r["pid"], edits, a + low, b + low))
            digest, doc, pid, edits, a, b = list(zip(*rows, strict=True)) or [()] * 6
            yield _batch({"digest": (digest, pa.string()), "doc_id": (doc, pa.int64()), "pid": (pid, pa.int64()), "edits": (edits, pa.int32()), "start": (a, pa.int64()), "end": (b, pa.int64())})

    found = map_arrow(near, verify, "digest string, doc_id long, pid long, edits int, start long, end long")
    ids = items.join(patterns, items["text"] == patterns["pattern"]).select("pid", F.col("item_id").cast("long").alias("item_id"))
    return found.join(ids, "pid").select("digest", "doc_id", "item_id", "edits", "start", "end")


def _items(benchmark: DataFrame, block_chars: int) -> tuple[DataFrame, list[tuple[int, str]] | None]:
    """The distinct items with a text, and their rows if these are `block_chars` characters at most."""
    items = benchmark.select("item_id", "text").filter("text <> ''").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return items, [(r["item_id"], r["text"]) for r in items.collect()] if total <= block_chars else None


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, start, end of each document and item matched, at the item's best place in the normalised text.

    Null and empty texts and items match nothing. Repeated rows of `docs` give
    repeated matches; equal items match each under their own id; null ids stay null.
    Items too short for one edit must occur exactly. An empty table gives no rows.
    """
    items, few = _items(benchmark, block_chars)
    if few is None:
        return _joined(docs.select("doc_id", "text"), items, error_rate).drop("digest")

    def run(batches):
        matcher = Matcher(few, error_rate)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for m in matcher.find(normal(t))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start", "end"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, item_id long, edits int, start long, end long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item. Without a shuffle for benchmarks up to `block_chars`; beyond, texts with a match are told by their digests."""
    items, few = _items(benchmark, block_chars)
    if few is None:
        own = f"_digest_{uuid.uuid4().hex[:12]}"  # no column of `docs` has it
        found = put(_joined(docs.select(F.lit(None).alias("doc_id"), "text"), items, error_rate).select("digest").distinct(), "decontaminate-found")
        return join_ids(docs.withColumn(own, F.sha2("text", 256)), own, found, "left_anti").drop(own)

    def run(batches):
        matcher = Matcher(few, error_rate)
        for batch in batches:
            yield batch.filter(pa.array([not (t and matcher.find(normal(t))) for t in batch.column("text").to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
