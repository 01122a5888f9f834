"""Chat formatting, personal data and media columns: round trips and plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veilspark.llm import chat as C
from veilspark.llm import matroska as M
from veilspark.llm import pii as P
from veilspark.llm import queries


# Chat
def digest_of(spark, rows, template=C.CHATML):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segments": F.lit(1), "x": F.lit("y")})
    return {r["conv_id"]: r for r in C.digest(C.format_conversations(df, template), template).collect()}


def test_turns_come_back(spark):
    rng = random.Random(0)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "|>", "&", "&amp;", "&lt;|", "&nl;", "\n", "assistant", "a", "é", "<", "|", "amp;"]
    rows = [(i, k, rng.choice(["user", "assistant", "system", "a\nb&nl;<|", "", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(8))])) for i in range(300) for k in rng.sample(range(9), rng.randrange(1, 6))]
    rows += [(1000, 1, "user", "x" * 300_000), (1001, None, "user", "same"), (1001, None, "user", "same"), (None, 0, "user", "q"), (None, 1, "assistant", "r")]
    got = digest_of(spark, rows)
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        trained = "".join(text for role, text in turns if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(trained)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
        state, fault = "start", None
        for i, (role, _) in enumerate(turns):
            nxt = C.CHATML.transitions.get((state, role))
            fault = i if nxt is None and fault is None else fault
            state = nxt or role
        fault = len(turns) if fault is None and state != "assistant" else fault
        assert (r["valid"], r["first_fault"]) == (fault is None, -1 if fault is None else fault)


def test_segments_and_their_loss(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u<|"), (1, 2, "assistant", "a")]
    r = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r["formatted"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu&lt;|<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"] and [s["text"] for s in r["segments"] if s["loss"]] == ["a"]


def test_another_template(spark):
    t = C.Template(open_mark="<|turn|>", close_mark="<|end|>", loss_roles=("bot",), transitions={("start", "human"): "h", ("h", "bot"): "b", ("b", "human"): "h"}, final=("b",))
    got = digest_of(spark, [(1, 0, "human", "<|end|>"), (1, 1, "bot", "ok"), (2, 0, "bot", "no")], t)
    assert got[1]["valid"] and got[1]["loss_chars"] == 2 and (got[2]["valid"], got[2]["first_fault"]) == (False, 0)


def test_no_conversations(spark):
    assert digest_of(spark, []) == {}


def test_chat_query_equals_sql(against_oracle):
    rows = against_oracle(queries.op4_chat_formatting, queries.ORACLES["op4_chat_formatting"])
    assert any(r[0] == -1 for r in rows)


def test_native_queries_run_no_python(spark):
    for q in (queries.op4_chat_formatting, queries.op7_pii, queries.op10_url_filter):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# Personal data
def passes(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    return [
        [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(only(m)) <= 19 and passes(only(m))],
        [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(only(m)) <= 15],
    ]


@pytest.fixture(scope="module")
def model(spark):
    return P.fit(spark)


def test_base_spans(spark, model):
    rng = random.Random(2)
    texts = [None, "", *("".join(rng.choice("a@b.c-_+1 2.3()45%é@.") for _ in range(rng.randrange(80))) for _ in range(4000))]
    texts += ["4111 1111 1111 1111", "4" * 40, "00255.1.1.1 1.2.3.4.5.6.7.8 256.1.1.1", "+1 (310) 555-0199 +12 3", "a" * 9000, "1" * 9000, "a.b@c.d " * 3000, "a@" * 5000, "1." * 5000]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rows = {r["doc_id"]: r for r in P.digest(P.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("email", F.lit(1)).repartition(8), model)).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for kind in base for k, a, b in kind)
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (t or "")[:80]
        assert [rows[i][f"n_{k}"] for k in P.KINDS] == [len(kind) for kind in base]
        assert rows[i]["spans"].startswith(listed)


def test_boosting_learns_and_calibrates(model):
    assert all(t is not None and t >= 0 for t in model.thresholds.values()) and set(model.thresholds) == set(P.LOOSE)
    rng = random.Random(0)
    rows = {}
    for _ in range(4000):
        bits = rng.randrange(1 << 6)
        good = rng.random() < (0.95 if bits & 1 and not bits & 8 else 0.05)
        rows.setdefault(bits, [0, 0])[0 if good else 1] += 1
    fitted = P.boost([(b, *v) for b, v in rows.items()], n_bits=6)
    assert all((fitted.score(b) > 0) == bool(b & 1 and not b & 8) for b in rows)


def test_score_expression_equals_the_model(spark, model):
    rows = spark.range(1 << 10).select((F.col("id") * 13 % (1 << P.N_BITS)).cast("int").alias("b")).withColumn("s", model.expression(F.col("b"))).collect()
    assert all(r["s"] == pytest.approx(model.score(r["b"])) for r in rows)


def test_clean_text_has_no_boosted_spans(spark, model):
    clean = spark.createDataFrame([(1, "In 1999 and 2000 we sold 12 of 300 at 4.50 each"), (None, None), (None, None), (3, "version 1.2.3 of 2024-01-02")], "doc_id long, text string")
    assert all(r["spans"] == "" for r in P.digest(P.find(clean, model)).collect())


def judged(spark, fitted, rows):
    """(form, good, base touches it, boost finds it, boost finds anything) of planted rows."""
    told = dict(enumerate(rows.collect()))
    texts = spark.createDataFrame([(i, r["text"]) for i, r in told.items()], "doc_id long, text string")
    out = []
    for f in P.find(texts, fitted).collect():
        r = told[f["doc_id"]]
        base = any(s["start"] < r["last"] and s["end"] > r["first"] for k in P.KINDS for s in f[k])
        hit = any(abs(s["start"] - r["first"]) <= 1 and abs(s["end"] - r["last"]) <= 1 for s in f["boost"])
        out.append((r["form"], r["good"], base, hit, bool(f["boost"])))
    return out


def test_added_spans_of_unseen_draws(spark, model):
    """Precision and recall of what base misses, on draws that the fit did not see; a model that proposes nothing finds nothing."""
    rows = P.planted(spark, P.DRAWS + 40).filter(F.col("draw") >= P.DRAWS)
    told = judged(spark, model, rows)
    missed = [t for t in told if t[1] and not t[2]]
    right, wrong = sum(t[3] for t in missed), sum(t[4] for t in told if not t[1])
    assert right >= 0.95 * len(missed) and right >= 0.95 * (right + wrong)
    assert not any(t[4] for t in judged(spark, P.Model(), rows))


@pytest.mark.parametrize("form", ["N##-N##-####", "0N ## ## ## ##", "4###/####/####/###L", "w## [at] h [dot] net"])
def test_forms_that_the_fit_never_saw(spark, form):
    told = judged(spark, P.fit(spark, 60, without=(form,)), P.planted(spark, 40).filter((F.col("form") == form) & F.col("good")))
    assert sum(t[3] for t in told) >= 0.9 * len(told) > 0


def test_added_spans_in_odd_rows(spark, model):
    long = "é x. " * 40_000
    rows = [(1, "tel (310) 555-0123, ann7 [at] example.com"), (1, "tel (310) 555-0123, ann7 [at] example.com"), (None, "tel (310) 555-0123"), (3, long + "call 310-555-0123 " + long + "bob8 (at) example [dot] org"), (4, "order 1234567890"), (5, "a+1 310 555 0123 call (310) 555-0123")]
    got = sorted(((r["doc_id"], r["spans"]) for r in P.digest(P.find(spark.createDataFrame(rows, "doc_id long, text string"), model)).collect()), key=repr)
    n = len(long)
    two = "boost:4:18,boost:20:41"
    assert got == sorted([(1, two), (1, two), (None, "boost:4:18"), (3, f"boost:{n + 5}:{n + 17},boost:{2 * n + 18}:{2 * n + 45}"), (4, ""), (5, "phone:1:16,boost:22:36")], key=repr)
    text = {r["doc_id"]: r["text"] for r in P.redact(spark.createDataFrame(rows[3:], "doc_id long, text string"), model).collect()}
    assert text[3] == long + "call [BOOST] " + long + "[BOOST]" and text[4] == rows[4][1]


def test_many_spans_in_one_text(spark, model):
    text = " ".join(f"u{k}@m.example.com" for k in range(5000))
    assert P.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["text"] == " ".join(["[EMAIL]"] * 5000)


def test_redacted_text(spark, model):
    docs = spark.createDataFrame([(1, "é mail a@b.com or +1 310 555 0199."), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in P.redact(docs, model).collect()} == {1: "é mail [EMAIL] or [PHONE].", 2: ""}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    fitted = P.fit(spark, 0)
    assert P.find(none, fitted).count() == 0 and P.redact(none, fitted).count() == 0 and M.store_and_read(none).count() == 0


# Media
def test_files_come_back():
    rng = random.Random(0)
    for n in (64, 128, 1024, 1088, 4096, 64 * 99, 64 * 3001):
        payload = rng.randbytes(n)
        stored = M.write(payload)
        media = M.parse(stored)
        assert b"".join(stored[p.start : p.start + p.size] for p in media.packets) == payload
        assert [p.timestamp_ns for p in media.packets] == [k * M.FRAME * 125_000 for k in range(len(media.packets))]
        assert all(stored[at : at + 4] == bytes.fromhex("1f43b675") for _, _, at in media.cues) and media.tracks[1]["bits"] == 8


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing(lacing):
    rng = random.Random(lacing)
    for _ in range(200):
        sizes = [rng.choice((1, 7, 254, 255, 256, 600, 9000))] * 4 if lacing == 2 else [rng.choice((0, 1, 7, 126, 127, 254, 255, 256, 600, 9000)) for _ in range(1 if not lacing else rng.randrange(1, 9))]
        body = M._laced([bytes(n) for n in sizes], lacing)
        if lacing == 2:
            body = bytes([len(sizes) - 1]) + bytes(sum(sizes))
        got, at = M.lace_sizes(body, 0, len(body), lacing)
        assert got == sizes and at == len(body) - sum(sizes)


def test_unknown_sizes_block_groups_and_negative_times():
    def open_ended(kind, body):
        return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + body

    block = lambda ticks, data: b"\x81" + ticks.to_bytes(2, "big", signed=True) + b"\x00" + data
    one = M._number(M.CLUSTER_TIME, 10) + M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block(-3, b"key"))) + M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block(2, b"delta")) + M._element(M.REFERENCE, b"\x01"))
    two = M._number(M.CLUSTER_TIME, 99) + M._element(0xEC, b"void") + M._element(M.SIMPLE_BLOCK, b"\x40\x02" + (0).to_bytes(2, "big") + b"\x80last")
    data = M._element(M.EBML, b"") + open_ended(M.SEGMENT, M._element(M.INFO, b"") + open_ended(M.CLUSTER, one) + open_ended(M.CLUSTER, two))
    assert [(p.track, p.timestamp_ns // 1_000_000, data[p.start : p.start + p.size], p.key) for p in M.parse(data).packets] == [(1, 7, b"key", True), (1, 12, b"delta", False), (2, 99, b"last", True)]


def test_damage_is_told(spark):
    good = M.write(b"x" * 640)
    rng = random.Random(3)
    rows = [("good", good), ("cut", good[:-5]), ("text", b"hello world"), ("empty", b""), ("null", None), ("none", b"\x00" * 9)]
    for k in range(300):
        bad = bytearray(good)
        for _ in range(3):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        rows.append((f"r{k}", bytes(bad)))
    got = {r["name"]: r for r in M.packet_table(spark.createDataFrame([(n, c, "old") for n, c in rows], "name string, content binary, error string")).collect()}
    assert len(got) == len(rows) and got["good"]["error"] is None and len(got["good"]["packets"]) == 1 and got["good"]["n_cues"] == 1
    assert all(got[n]["error"] and got[n]["packets"] is None for n in ("cut", "text", "empty", "none")) and got["null"]["packets"] is None


def test_seek_reads_from_the_cue_on(spark):
    """Packets from any time on are those of the whole parse; clusters before the cue are not read, so damage in them does not matter."""
    stored = M.write(bytes(random.Random(5).randrange(256) for _ in range(120_000)))
    whole = M.parse(stored)
    assert len(whole.cues) == len(whole.clusters) > 3 and [c[2] for c in whole.cues] == [c[0] for c in whole.clusters]
    for when in (0, 1, whole.cues[1][0], whole.cues[2][0] - 1, whole.packets[-1].timestamp_ns, 10**15):
        found = M.seek(stored, 1, when)
        assert found.packets == [p for p in whole.packets if p.timestamp_ns >= when]
        assert len(found.clusters) == sum(c[0] + 1 > when for c in whole.cues) + (when not in [c[0] for c in whole.cues])
    assert M.seek(stored, 2, 0).packets == []
    place, a, b = whole.clusters[0]
    broken = stored[:a] + bytes(b - a) + stored[b:]
    with pytest.raises(M.Damaged):
        M.parse(broken)
    assert M.seek(broken, 1, whole.cues[1][0]).packets == [p for p in whole.packets if p.timestamp_ns >= whole.cues[1][0]]
    files = spark.createDataFrame([(1, stored), (2, broken), (3, None), (4, b"no")], "id long, content binary")
    got = {r["id"]: r for r in M.packets_from(files, 1, whole.cues[1][0]).collect()}
    assert got[1]["packets"] == got[2]["packets"] and len(got[1]["packets"]) == len(M.seek(stored, 1, whole.cues[1][0]).packets)
    assert [tuple(c) for c in got[1]["cues"]] == whole.cues and got[3]["packets"] is None and got[3]["error"] is None and got[4]["error"]


def test_media_query(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "word " * 30_000, "same", "same"]
    rows = M.store_and_read(spark.createDataFrame([(i if i < 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int")).collect()
    for r, t in zip(sorted(rows, key=lambda r: 7 if r["doc_id"] is None else r["doc_id"]), texts, strict=True):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        stored = M.write(payload)
        assert tuple(r)[1:7] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert len({r["feature"] for r in rows}) == 6  # both empty ones and both equal ones agree


def test_files_and_packets_as_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = M.packet_table(M.files(docs)).select("doc_id", F.explode("packets").alias("p"))
    sizes = {r[0]: r[1] for r in table.groupBy("doc_id").agg(F.sum("p.size")).collect()}
    assert all(sizes[r["doc_id"]] == len(M.padded(r["text"])) for r in docs.collect())
