"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. One pass turns each text into its set of distinct 5-word shingles, a 128-value
   MinHash signature, a 128-bit sketch of it (one bit a value) and a 128-bit key
   of the whole set. Documents with equal sets form a class; a class is one row
   from here on, so exact copies cost nothing later.
2. Signatures are cut into 32 bands of 4 values. A pair at similarity 0.75 misses
   every band with probability (1 - 0.75**4)**32 = 5e-6.
3. Star round: in each bucket every class is paired with the bucket's smallest id.
   Linked pairs form components, and the smallest id, now compared with its whole bucket, leaves it:
   a bucket of two is settled. While the classes outside their bucket's largest component
   could still make many pairs, further rounds pair them with another member of that component.
4. Index round, for buckets that still hold several components. A bucket's anchor A is
   its class of fewest shingles; every class x of the bucket is compared with it in full,
   giving the a(x) shingles shared with A and the others X. Of two linked classes x and y
   of a bucket that are not both linked to A, at least
   need(x, y) = ceil(3 (|x| + |y|) / 7) - min(a(x), a(y)) >= 1
   shingles outside A are common, since |A| is the least. So x and y share one of the
   rarest |X| - k + 1 of their others, k the least need of x: these are joined by equality,
   and the order of rarity and the sketch rule pairs out. In each list of the index, classes
   outside the list's largest component ask all its other components, never their own, so a
   group of n near copies with m strays costs about n * m at the very most, and texts that
   only share a passage meet in no list. Lists are split by salt.
5. Verification of a pair is sequential: signature values in batches of 32; after each
   the pair goes if the posterior probability (uniform prior) that its similarity
   reaches the threshold is under `miss_probability`. Survivors are compared on their full
   sets. The set of a pair's second class moves once for up to 1,024 shares of its
   partners, not once a pair.
6. Components come from min-label hooking and pointer jumping over tables in the
   shared folder; labels are two numbers a row, and adaptive execution splits a frequent one.

A set is of 64-bit hashes of the shingles: two different ones among 1,000,000 agree with
probability 3e-8. Classes of equal sets are told by their size and 128 bits: two different
ones among 10**12 agree with probability 1e-15; these are not compared again.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import BROADCAST_IDS, drop, join_ids, map_arrow, put
from .textbytes import LOWER, U64, Words, blocks, buffer_of, bytes_of, mix, shingle_sets

VALUES, ROWS, WIDTH, BATCH = 128, 4, 5, 32
NUMERATOR, DENOMINATOR = 75, 100
MISS_PROBABILITY = 1e-5
_factors = mix(np.arange(1, VALUES + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def _tail(n: int, m: int, t: float, bits: int) -> float:
    """P(similarity >= t) after m of n agreements under a uniform prior; with bits=1 an agreement has probability (1+s)/2."""
    s = (np.arange(2000) + 0.5) / 2000
    p = (1 + s) / 2 if bits == 1 else s
    log = m * np.log(p) + (n - m) * np.log1p(-p)
    w = np.exp(log - log.max())
    return float(w[s >= t].sum() / w.sum())


@cache
def least_agreements(n: int, t: float, miss: float, bits: int = 0) -> int:
    """The fewest agreements among n that keep a pair."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _tail(n, mid, t, bits) >= miss else (mid + 1, high)
    return low


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (uint32), a row for each set; sets must not be empty."""
    size = np.array([len(s) for s in sets])
    out = np.empty((len(sets), VALUES), np.uint32)
    ends = np.cumsum(size)
    a = 0
    while a < len(sets):  # parts that stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 30_000, "right")))
        h = np.concatenate(sets[a:b])
        at = np.concatenate(([0], np.cumsum(size[a:b])[:-1]))
        for k in range(VALUES):
            out[a:b, k] = np.minimum.reduceat(h * _factors[k] >> U64(32), at)
        a = b
    return out


def _sketch(batches):
    for batch in blocks(batches):
        raw, offsets = buffer_of(batch.column("text"))
        sets = shingle_sets(Words(LOWER[raw], offsets), WIDTH)
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        sig = signatures([sets[i] for i in full]) if len(full) else np.empty((0, VALUES), np.uint32)
        key = np.zeros((2, len(sets)), U64)
        bits = np.zeros((2, len(sets)), U64)
        for i in full:
            key[0, i] = mix(sets[i]).sum(dtype=U64)
            key[1, i] = np.bitwise_xor.reduce(mix(sets[i] + U64(0xA5A5A5A5A5A5)))
        if len(full):
            bits[:, full] = np.packbits((sig >> 3 & 1).astype(np.uint8), axis=1).view(U64).T
        binary = np.zeros(len(sets), object)
        for row, i in enumerate(full):
            binary[i] = sig[row].tobytes()
        yield pa.record_batch(
            [batch.column("id"), pa.array(n), *(pa.array(x.view(np.int64)) for x in (*key, *bits)), pa.array([x or None for x in binary], pa.binary())],
            names=["id", "n", "k1", "k2", "b1", "b2", "sig"],
        )


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES // ROWS, ROWS).astype(U64)
        scale = mix(np.arange(7, 7 + ROWS, dtype=U64)) | U64(1)
        key = mix((sig * scale).sum(axis=2, dtype=U64) + mix(np.arange(VALUES // ROWS, dtype=U64))[None, :])
        row = pa.array(np.repeat(np.arange(batch.num_rows), VALUES // ROWS))
        yield pa.record_batch([pa.array(key.ravel().view(np.int64)), batch.column("id").take(row), batch.column("n").take(row)], names=["bucket", "id", "n"])


SALTS = 1024


def _beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (b, salt, kind, a, c, value): the value of b (kind 0), then those of its partners a (kind 1), in one task and in this order. pairs: distinct (a, b, c), where c is carried along; table: (id, value)."""
    table = table.toDF("id", "value")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    none = F.lit(None).cast("long")
    heads = salted.select("b", "salt").distinct().select("b", "salt", F.lit(0).alias("kind"), none.alias("a"), none.alias("c"), F.col("b").alias("id"))
    asked = heads.unionAll(salted.select("b", "salt", F.lit(1).alias("kind"), "a", "c", F.col("a").alias("id")))
    return asked.join(table, "id").select("b", "salt", "kind", "a", "c", "value").repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of partners, of each the number of heads up to it, rows of heads) of a batch of `_beside`."""
    head = batch.column("kind").to_numpy() == 0
    rows = np.flatnonzero(~head)
    return rows, np.cumsum(head)[rows], np.flatnonzero(head)


def _similar_signatures(batches):
    """Keeps the pairs that pass every batch of signature values."""
    need = [(n, least_agreements(n, NUMERATOR / DENOMINATOR, MISS_PROBABILITY)) for n in range(BATCH, VALUES + 1, BATCH)]
    last = np.zeros((1, VALUES), np.uint32)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = bytes_of(batch.column("value"))[0].view(np.uint32).reshape(-1, VALUES)
        rows, of, heads = _places(batch)
        leads = np.concatenate([last, sig[heads]])
        last = leads[-1:].copy()
        alive, agreed = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for n, least in need:
            agreed[alive] += (sig[rows[alive], n - BATCH : n] == leads[of[alive], n - BATCH : n]).sum(axis=1)
            alive = alive[agreed[alive] >= least]
        yield batch.select(["a", "b", "c"]).take(pa.array(rows[alive]))


def _sets(batches):
    for batch in blocks(batches):
        raw, offsets = buffer_of(batch.column("text"))
        sets = shingle_sets(Words(LOWER[raw], offsets), WIDTH)
        yield pa.record_batch([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


def _compared(keep_others: bool):
    """Of each pair the sizes, the shingles in common and, if asked for, those of a that b lacks."""

    def run(batches):
        last = np.zeros(0, U64)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = bytes_of(batch.column("value"))
            rows, of, heads = _places(batch)
            leads = [last, *(data[at[i] : at[i + 1]].view(U64) for i in heads.tolist())]
            last = leads[-1].copy()
            na, nb, common, others = [], [], [], []
            for i, k in zip(rows.tolist(), of.tolist(), strict=True):
                a, b = data[at[i] : at[i + 1]].view(U64), leads[k]
                both = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
                na.append(len(a)), nb.append(len(b)), common.append(int(both.sum()))
                others.append(a[~both].tobytes() if keep_others else None)
            kept = batch.select(["a", "b", "c"]).take(pa.array(rows))
            yield pa.record_batch([*kept.columns, *(pa.array(x, pa.int64()) for x in (na, nb, common)), pa.array(others, pa.binary())], names=["a", "b", "c", "na", "nb", "common", "others"])

    return run


_LINKED = f"{DENOMINATOR} * common >= {NUMERATOR} * (na + nb - common)"


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _compare(pairs: DataFrame, docs: DataFrame, once: bool, keep_others: bool = False) -> DataFrame:
    """Compares the full sets of distinct pairs (a, b, c). once: no id of `docs` has two rows."""
    ids = put(_ends(pairs), "ids")
    sets = map_arrow(join_ids(docs, "id", ids, "left_semi"), _sets, "id long, shingles binary")
    sets = sets if once else sets.dropDuplicates(["id"])  # read once: not worth a table
    out = put(map_arrow(_beside(pairs, sets), _compared(keep_others), "a long, b long, c long, na long, nb long, common long, others binary"), "compared")
    drop(ids)
    return out


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, once: bool) -> DataFrame:
    """Of distinct candidate pairs (a, b), those linked on their full sets."""
    pairs = put(pairs.select("a", "b", F.lit(None).cast("long").alias("c")), "pairs")
    ids = put(_ends(pairs), "ids")
    likely = put(map_arrow(_beside(pairs, join_ids(reps.select("id", "sig"), "id", ids, "left_semi")), _similar_signatures, "a long, b long, c long"), "likely")
    drop(ids)
    compared = _compare(likely, docs, once)
    linked = put(compared.filter(_LINKED).select("a", "b"), "linked")
    drop(pairs, likely, compared)
    return linked


#: Pairs that the members of a bucket's smaller components may make, for each row in a bucket, before another star round.
MOST_PAIRS = 32
#: Members of a list of the index that one task pairs with those that ask.
LIST_SHARE = 4096


def _tops(named: DataFrame) -> DataFrame:
    """(bucket, top, most, size, kinds) of the buckets in (bucket, id, n, c): the largest component, its members, all members, components."""
    sizes = named.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("size"))
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("size", "c")).alias("t"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("kinds"))
    return tops.select("bucket", F.col("t.c").alias("top"), F.col("t.size").alias("most"), "size", "kinds")


def _named(busy: DataFrame, found: DataFrame) -> DataFrame:
    return busy.join(found, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("c"))


def _split(busy: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows of `busy` with their components, `_tops` of the buckets that hold several)."""
    named = put(_named(busy, found), "named")
    return named, put(_tops(named).filter("kinds > 1"), "tops")


def _more_stars(busy: DataFrame, reps: DataFrame, found: DataFrame, docs: DataFrame, once: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`found` after star rounds with other members of the largest components, as long as much is left to pair and a round links a tenth of it; and `_split` by it."""
    before = None
    named, tops = _split(busy, found)
    for k in range(1, VALUES // ROWS + 1):
        strays, work = tops.agg(F.coalesce(F.sum(F.col("size") - F.col("most")), F.lit(0)), F.coalesce(F.sum((F.col("size") - F.col("most")).cast("double") * F.col("size")), F.lit(0.0))).first()
        if work <= MOST_PAIRS * busy.count() or (before is not None and strays > 0.9 * before):
            break
        before = strays
        own = named.join(tops.select("bucket", "top"), "bucket")
        centre = own.filter("c = top").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id")).alias("m")).select("bucket", F.col("m.id").alias("b"))
        pairs = put(own.filter("c <> top").join(centre, "bucket").select(F.col("id").alias("a"), "b").distinct(), "stars")
        linked = _verified(pairs, reps, docs, once)
        old, found = found, components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(linked))
        drop(named, tops, pairs, linked, old)
        named, tops = _split(busy, found)
    return found, named, tops


def _tokens(batches):
    """A row for each shingle that a class has beside its anchor's: the index key, and what bounds need. Both sizes and the shingles in common are the class's."""
    for batch in batches:
        data, at = bytes_of(batch.column("others"))
        size = np.diff(at) // 8
        anchor = mix(batch.column("b").to_numpy().view(U64) + U64(1))
        na, nb, common = (batch.column(x).to_numpy() for x in ("na", "nb", "common"))
        p, q = NUMERATOR, DENOMINATOR
        least = np.maximum(1, np.maximum(-(-p * na // q), -(-p * (na + nb) // (p + q))) - common)
        shingles = data.view(U64)
        for a in range(0, len(shingles), 1 << 17):  # whole texts may be long
            part = shingles[a : a + (1 << 17)]
            row = np.searchsorted(at[1:] // 8, np.arange(a, a + len(part)), "right")
            columns = [batch.column("b").take(pa.array(row)), batch.column("a").take(pa.array(row)), batch.column("c").take(pa.array(row)), pa.array(least[row]), pa.array(na[row]), pa.array(common[row])]
            yield pa.record_batch([pa.array(mix(part ^ anchor[row]).view(np.int64)), *columns], names=["key", "anchor", "id", "c", "k", "n", "common"])


def _crossing(named: DataFrame, tops: DataFrame, reps: DataFrame, docs: DataFrame, once: bool) -> tuple[DataFrame, DataFrame]:
    """(links to anchors, candidate pairs) between components that share a bucket, from `_split`, which is dropped."""
    named_open = put(named.join(tops.select("bucket"), "bucket"), "open")
    anchors = named_open.groupBy("bucket").agg(F.min(F.struct("n", "id")).alias("m")).select("bucket", F.col("m.id").alias("b"))
    near = put(named_open.join(anchors, "bucket").filter("id <> b").select(F.col("id").alias("a"), "b", "c").distinct(), "near")
    told = _compare(near, docs, once, keep_others=True)
    links = put(told.filter(_LINKED).select("a", "b"), "linked")
    tokens = put(map_arrow(told, _tokens, "key long, anchor long, id long, c long, k long, n long, common long"), "tokens")
    drop(named, tops, named_open, near, told)
    # a shingle that only one component has cannot be common to two
    shared = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("often"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key", "often")
    kept = put(tokens.join(shared, "key"), "shared")
    each = Window.partitionBy("anchor", "id")
    placed = kept.withColumns({"rest": F.count(F.lit(1)).over(each) - F.row_number().over(each.orderBy("often", "key")), "all": F.count(F.lit(1)).over(each)})
    prefix = placed.filter(F.col("all") - F.col("rest") <= F.col("all") - F.col("k") + 1).join(reps.select("id", "b1", "b2"), "id")
    prefix = put(prefix.select("key", "id", "c", "n", "common", "rest", "b1", "b2"), "prefix")
    drop(tokens, kept)
    lists = _tops(prefix.withColumnRenamed("key", "bucket")).filter("kinds > 1").select(F.col("bucket").alias("key"), "top", F.ceil(F.col("size") / LIST_SHARE).cast("int").alias("shares"))
    own = prefix.join(lists, "key")
    asks = own.filter("c <> top").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    told_ = own.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    x, y = asks.alias("x"), told_.alias("y")
    most = VALUES - least_agreements(VALUES, NUMERATOR / DENOMINATOR, MISS_PROBABILITY, 1)
    differ = F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1"))) + F.bit_count(F.col("x.b2").bitwiseXOR(F.col("y.b2")))
    # |x & y| / (|x| + |y| - |x & y|) >= p / q  means  (p + q) |x & y| >= p (|x| + |y|); at the first shingle in common no more than it and the rest of either are
    possible = (F.least("x.common", "y.common") + 1 + F.least("x.rest", "y.rest")) * (NUMERATOR + DENOMINATOR) >= (F.col("x.n") + F.col("y.n")) * NUMERATOR
    once = (F.col("y.c") == F.col("y.top")) | (F.col("x.id") < F.col("y.id"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.share") == F.col("y.share")) & (F.col("x.c") != F.col("y.c")) & once & (differ <= most) & possible)
    pairs = put(pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct(), "crossing")
    drop(prefix)
    return links, pairs


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (a, b): the smallest id reachable.

    Each round hooks an id, and its label, to the smallest label among the
    neighbours, then jumps pointers; the number of rounds is logarithmic.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = put(edges.filter("a <> b").select(F.explode(ways).alias("e")).select("e.a", "e.b"), "edges")
    label = put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("f")), "label")
    while True:
        to = label.select(F.col("id").alias("f"), F.col("f").alias("g"))
        jumped = label.join(to, "f").select("id", "f", "g")
        jumped = put(jumped, "jumped")
        near = both.join(jumped.select(F.col("id").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("g"))
        hooked = near.join(jumped.select(F.col("id").alias("a"), "f"), "a").select("a", "f", "g")
        offers = jumped.select("id", "g").unionAll(hooked.select(F.explode(F.array("a", "f")).alias("id"), "g"))
        new = offers.groupBy("id").agg(F.min("g").alias("f")).join(label.withColumnRenamed("f", "old"), "id").select("id", "f", "old")
        new = put(new, "label")
        done = new.filter("f <> old").isEmpty()
        drop(label, jumped)
        label = new.select("id", "f")
        label._veilspark_path = new._veilspark_path
        if done:
            drop(both)
            return label.select("id", F.col("f").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`.

    Words are runs of non-space characters after A-Z is lower-cased. Null and empty
    texts, and texts of spaces, have no shingles and no links. Shorter texts than
    five words are one shingle. Texts linked at 75 % or more of their shingles, and
    chains of them, form a component named by its smallest id. Repeated rows are
    linked like any copies. Rows that repeat an id with different texts form one
    node. A null id takes part like any other, never names a component and is never
    `kept`. Other columns of `docs` are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    repeated = put(rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id"), "repeated")
    if repeated.isEmpty() and rows.filter("id is null").isEmpty():
        found = _groups(rows).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    else:
        found = _with_odd_ids(rows, repeated)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _with_odd_ids(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) where rows without an id, or with one that other rows have too, are nodes by their text."""
    mark = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
    marked = rows.join(mark.withColumn("odd", F.lit(True)), "id", "left").withColumn("odd", F.col("odd").isNotNull() | F.col("id").isNull())
    salt = 0
    while True:  # nodes that are no row's id
        node = F.when(F.col("odd"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(salt)), 2) + F.lit(1 << 62)).otherwise(F.col("id"))
        nodes = put(marked.select("id", node.alias("node"), "odd"), "nodes")
        odd = nodes.filter("odd").select("node").distinct()
        texts = marked.filter("odd").select(F.sha2(F.coalesce("text", F.lit("")), 256)).distinct()
        if odd.count() == texts.count() and join_ids(rows.filter("id is not null"), "id", odd, "left_semi").isEmpty():
            break
        drop(nodes)
        salt += 1
    same = nodes.filter("odd and id is not null").select("id", "node").distinct()
    found = put(_groups(marked.select(node.alias("id"), "text"), same).dropDuplicates(["id"]).withColumnRenamed("id", "node"), "found")
    both = put(nodes.join(found, "node"), "placed")
    names = both.filter("n > 0 and id is not null").groupBy("component").agg(F.min("id").alias("name"))
    named = both.join(names, "component", "left")
    drop(nodes, found)
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def _groups(docs: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(id, n, component) for each row of (id, text), where an id has one text, and one row if `same` is not given. same: (id, node) rows, where the nodes of one id are linked unless their texts are empty."""
    once = same is None
    key = ["n", "k1", "k2"]
    sketched = put(map_arrow(docs, _sketch, "id long, n long, k1 long, k2 long, b1 long, b2 long, sig binary"), "signatures")
    base = put(sketched.select("id", *key), "keys")
    classes = put(base.filter("n > 0").groupBy(*key).agg(F.min("id").alias("id")), "classes")
    reps = join_ids(sketched.filter("n > 0"), "id", classes.select("id"), "left_semi")
    reps = put(reps if once else reps.dropDuplicates(["id"]), "representatives")
    drop(sketched)
    banded = put(map_arrow(reps.select("id", "n", "sig"), _bands, "bucket long, id long, n long"), "bands")
    shared = banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    pivoted = put(banded.join(shared.select("bucket", "pivot"), "bucket"), "busy")
    drop(banded)
    busy = pivoted.filter("id > pivot").select("bucket", "id", "n")  # the star round settles all pairs of the pivot
    stars = put(pivoted.filter("id > pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    first = _verified(stars, reps, docs, once)
    found, named, tops = _more_stars(busy, reps, components(first), docs, once)
    links, pairs = _crossing(named, tops, reps, docs, once)
    second = _verified(pairs, reps, docs, once)
    more = links.unionAll(second)
    if same is not None:  # the links of nodes, between their classes
        rep = base.filter("n > 0").join(classes.withColumnRenamed("id", "b"), key).select(F.col("id").alias("node"), "b").distinct()
        ends = put(same.join(rep, "node").select("id", "b").distinct(), "ends")
        more = more.unionAll(ends.join(ends.groupBy("id").agg(F.min("b").alias("a")), "id").filter("a <> b").select("a", "b"))
    if not more.isEmpty():
        old, found = found, components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))
        drop(old)
    drop(pivoted, stars, first, links, pairs, second, reps)
    final = classes.join(found, "id", "left").select(*key, F.coalesce("component", "id").alias("component"))
    return base.join(final, key, "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that name their component, each once; rows with a null id stay. All columns are returned."""
    groups = put(near_duplicates(docs), "groups")
    out = join_ids(docs, "doc_id", groups.filter("not kept and doc_id is not null").select("doc_id").distinct(), "left_anti")
    again = groups.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    return join_ids(out, "doc_id", again, "left_anti").unionByName(join_ids(out, "doc_id", again, "left_semi").dropDuplicates(["doc_id"]))
