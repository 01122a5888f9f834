"""Near-duplicate groups against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm import neardedup as N


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by an inverted index over all shingles."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index, ids = defaultdict(list), {}
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in index[g]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            index[g].append(i)
        if s and rows[i][0] is not None:
            j = ids.setdefault(rows[i][0], i)
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def run(spark, rows, schema="doc_id long, text string"):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)


def edited(rng, words, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in words)


WORDS = ["".join(random.Random(k).choice("abcdefghij") for _ in range(5)) for k in range(3000)]


def test_against_all_pairs(spark):
    """Groups of near copies with edits on both sides of the threshold, shared passages, chains."""
    rng = random.Random(1)
    texts = []
    for size in (60, 8, 3):
        base = [rng.choice(WORDS) for _ in range(80)]
        texts += [edited(rng, base, rng.choice((0.01, 0.03, 0.05, 0.08))) for _ in range(size)]
    passage = [rng.choice(WORDS) for _ in range(50)]
    texts += [" ".join(passage + [rng.choice(WORDS) for _ in range(rng.randrange(5, 40))]) for _ in range(40)]
    chain = [rng.choice(WORDS) for _ in range(120)]
    texts += [" ".join(chain[4 * k : 4 * k + 60]) for k in range(12)]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))) for _ in range(30)]
    texts += texts[:5] * 3 + [t.upper() for t in texts[:4]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    long = " ".join(random.Random(5).choice(WORDS) for _ in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e a b c d e"), (9, "a b c d e"),
        (None, "a b c d e"), (None, None), (None, "only me"), (10, long), (11, long + " more"), (4, "one two"), (12, "é É"), (13, "é é"), (6, "a b c d e"), (20, ""), (20, "p q"), (20, "r s"), (20, "t u"), (21, "t u"), (22, "r s"), (2**61, "one two"), (-3, "one two"),
    ]
    schema = "doc_id long, text string, n int, bucket string, component_id string, id long"
    assert run(spark, [(*r, 1, "x", "y", 3) for r in rows], schema) == brute(rows)
    assert run(spark, []) == []


def test_near_copies_without_an_id_link_others(spark):
    rng = random.Random(9)
    words = [rng.choice(WORDS) for _ in range(100)]
    text = lambda a: " ".join(words[a : a + 60])
    alone = [rng.choice(WORDS) for _ in range(80)]
    rows = [(1, text(0)), (None, text(6)), (2, text(12)), (None, " ".join(alone)), (None, " ".join(alone[1:])), (2**62 + 5, text(30)), (None, text(32)), (7, "x y"), (None, "x y"), (None, None)]
    got = run(spark, rows)
    assert got == brute(rows) and (2, 56, 1) in got


def test_drop_keeps_one_of_each_group_with_all_columns(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other words here are these", "z"), (3, "other words here are these", "z"), (None, "a b c d e f", "n"), (4, None, "e"), (4, None, "e"), (5, "", "f")]
    got = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _id_ string"))
    assert got.columns == ["doc_id", "text", "_id_"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[4], rows[5], rows[7]]))


@pytest.mark.parametrize("s", [0.75, 0.8, 0.9])
def test_pruning_keeps_pairs_at_the_threshold(s):
    """The chance that any batch drops a pair of similarity s is near the miss probability."""
    rng = np.random.default_rng(0)
    agree = rng.random((200_000, N.VALUES)) < s
    alive = np.ones(len(agree), bool)
    for n in range(N.BATCH, N.VALUES + 1, N.BATCH):
        alive &= agree[:, :n].sum(axis=1) >= N.least_agreements(n, 0.75, N.MISS_PROBABILITY)
    assert (~alive).mean() < 5e-4
    bits = rng.random((200_000, N.VALUES)) < (1 + s) / 2
    assert (bits.sum(axis=1) < N.least_agreements(N.VALUES, 0.75, N.MISS_PROBABILITY, 1)).mean() < 5e-4


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    sig = N.signatures([np.sort(base[:1000]), np.sort(base[200:1200])])
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.15


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(2).sample(range(n), n)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = {r["id"]: r["component"] for r in N.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_few_shuffles(spark, monkeypatch):
    """A shuffle is a round of tasks, however few its rows: there are no more of them than the rows need."""
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    pairs = spark.createDataFrame([(2, 1, 7), (3, 1, 7), (5, 4, 8)], "a long, b long, c long")
    beside = N._beside(pairs, spark.createDataFrame([(i, 10 * i) for i in range(1, 6)], "id long, value long"))
    assert sorted((r["b"], r["a"], r["value"]) for r in beside.filter("kind = 1").collect()) == [(1, 2, 20), (1, 3, 30), (4, 5, 50)]
    assert {(r["b"], r["value"]) for r in beside.filter("kind = 0").collect()} == {(1, 10), (4, 40)}
    made, put = Counter(), N.put

    def counted(df, name):
        made[name] += shuffles(df)
        return put(df, name)

    monkeypatch.setattr(N, "put", counted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(beside.select("*")) <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (2, text + " eleven"), (3, text + " eleven twelve"), (4, "other words that are here alone today")]
    assert run(spark, rows) == brute(rows)
    assert made["edges"] == 0 and made["sets"] == 0


def test_pairs_that_the_star_round_settled_are_not_compared_again(spark, monkeypatch):
    """Two classes that share buckets with each other only, and are not linked, take no part in the index round."""
    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = [rng.choice(WORDS) for _ in range(80)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:66] + [rng.choice(WORDS) for _ in range(14)]))]
    near, put = [], N.put

    def counted(df, name):
        out = put(df, name)
        if name in ("stars", "near"):
            near.append((name, out.count()))
        return out

    monkeypatch.setattr(N, "put", counted)
    assert run(spark, rows) == brute(rows)
    assert dict(near)["stars"] > 20 and dict(near)["near"] == 0
