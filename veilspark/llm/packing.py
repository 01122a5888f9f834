"""Tokenises documents and packs their pieces by vector best-fit.

Tokens are only counted and summed up here: the rows that move are a few numbers
for each piece. Pieces are dealt at random over shards of bounded size; each
shard packs its own pieces, so the cost of sharding is one open sequence a shard.

A sequence has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces go in by decreasing length. A piece goes to the
sequence, among those where it fits under every capacity, with the least weighted
norm of residual capacities after it ("norm") or the largest weighted dot product
of its demand with the residuals ("dot").
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.ship import ship

from .store import map_arrow, put
from .textbytes import LOWER, U64, Words, blocks, buffer_of, mix

PIECES_PER_SHARD = 16_384


#: Distinct runs that a task remembers between blocks.
REMEMBERED = 1_000_000
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = True
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


class Encoder:
    """Ids of texts by a vocabulary that drops white space and case and never joins letters to other characters.

    So a text is cut into runs, at ASCII spaces and between ASCII punctuation and a
    letter or digit, and each distinct run is encoded once. Apostrophes and the characters of special tokens
    never mark a cut. Runs of Latin letters are one pre-token each: they are encoded together,
    and their last ids, which end a word, tell them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.hashes, self.begin, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each run), of `words` first."""
        parts = [np.zeros(0, np.uint32)]
        for i in range(0, len(words), 10_000):  # the library's own result for a run is far larger than its ids
            (coded,) = self.tokenizer.encode_batch_fast([" ".join(words[i : i + 10_000])], add_special_tokens=False)
            parts.append(np.array(coded.ids, np.uint32))
        ids = np.concatenate(parts)
        last = np.flatnonzero(self.ends[ids])
        size = np.diff(np.concatenate(([-1], last)))
        if len(size) != len(words):
            raise ValueError("a run of letters is not one word of this vocabulary")
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else []
        return np.concatenate([ids, np.fromiter((i for c in coded for i in c), np.uint32)]), np.concatenate([size, np.array([len(c) for c in coded], np.int64)])

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a buffer."""
        data = raw.tobytes()
        if b"<|" not in data:
            raw = LOWER[raw]
            data = raw.tobytes()
        after = np.append(raw[1:], np.uint8(0))
        latin = (raw == 0xC3) & (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
        second = np.concatenate(([False], latin[:-1]))
        letter = _ALNUM[raw] | latin | second
        mark = _PUNCTUATION[raw]
        cut = np.zeros(len(raw), bool)
        cut[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        words = Words(raw, offsets, cuts=cut)
        h = words.hashes()
        distinct, where, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        bad = np.concatenate(([0], np.cumsum(~(((raw >= 97) & (raw <= 122)) | latin | second))))
        a, b = words.starts[where[new]], words.ends[where[new]]
        plain = bad[a] == bad[b]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        runs = [data[x:y].decode("utf-8", "replace") for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True)]
        ids, size = self._encode(runs[: int(plain.sum())], runs[int(plain.sum()) :])
        flat = np.concatenate([self.flat, ids])
        begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        size = np.concatenate([self.size, size])
        place = np.empty(len(distinct), np.int64)
        place[~new] = at[~new]
        place[np.flatnonzero(new)[order]] = len(self.hashes) + np.arange(len(order))
        row = place[which] if len(which) else place[:0]
        each = size[row]
        ends = np.concatenate(([0], np.cumsum(each)))
        out = flat[np.repeat(begin[row] - ends[:-1], each) + np.arange(ends[-1])]
        if len(begin) <= REMEMBERED and len(order):
            hashes = np.concatenate([self.hashes, distinct[new][order]])
            by_hash = np.argsort(hashes)
            self.hashes, self.begin, self.size, self.flat = hashes[by_hash], begin[by_hash], size[by_hash], flat
        return np.split(out, ends[words.first[1:-1]])


def _pieces(path: str, capacity: int):
    def run(batches):
        encoder = Encoder(path)  # of this task, so that an idle worker process holds no cache
        seen = 0
        for batch in blocks(batches):
            rows = []
            docs = batch.column("doc_id").to_pylist()
            for doc, ids in zip(docs, encoder.ids(*buffer_of(batch.column("text"))), strict=True):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True))
            salt = mix(np.arange(seen, seen + len(rows), dtype=U64) + mix(np.array([0 if d is None else d for d in columns[0]]).astype(U64)))
            seen += len(rows)
            yield pa.record_batch(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:]), pa.array((salt >> U64(1)).view(np.int64))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )

    return run


def best_fit(lengths: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths must be decreasing and at most the token capacity.

    A length that breaks another capacity on its own still gets a bin to itself.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    limits = capacities.astype(float)
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1)
    alone = (lengths == capacities[0]) | (demand > limits).any(axis=1)
    bins[alone], offsets[alone] = np.arange(alone.sum()), 0
    made = int(alone.sum())
    left = np.empty((3, 1024))
    name = np.empty(1024, np.int64)
    least = float(lengths.min()) if n else 0.0
    used = 0
    for i in np.flatnonzero(~alone):
        d = demand[i]
        open_ = left[:, :used]
        fits = np.flatnonzero((open_[0] >= d[0]) & (open_[1] >= d[1]) & (open_[2] >= d[2]))
        if len(fits):
            r = (open_[:, fits] - (d[:, None] if rule == "norm" else 0)) / limits[:, None]
            k = fits[np.argmin((weights[:, None] * r * r).sum(axis=0)) if rule == "norm" else np.argmax((weights[:, None] * r * (d / limits)[:, None]).sum(axis=0))]
        else:
            if used == left.shape[1]:
                left, name = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([name, np.empty_like(name)])
            k, used = used, used + 1
            left[:, k], name[k], made = limits, made, made + 1
        bins[i], offsets[i] = name[k], capacities[0] - left[0, k]
        left[:, k] -= d
        if left[0, k] < least or left[1, k] < 1:  # closed: the last open one takes its place
            used -= 1
            left[:, k], name[k] = left[:, used], name[used]
    return bins, offsets


def _pack(capacities: tuple[int, int, int], weights: tuple[float, float, float], rule: str):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        bins, offsets = best_fit(shard["length"].to_numpy(), np.array(capacities), np.array(weights), rule)
        out = shard.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(shard["shard"].to_numpy() * 2**32 + bins)).append_column("offset", pa.array(offsets))

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, max_documents: int | None = None, max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm",
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a final 0; null and empty texts are that 0 alone. Longer
    documents than `capacity` are cut into pieces of it, the last may be shorter. Unset
    capacities for documents and attention are the largest that can matter. Repeated
    rows are packed each for itself, and a null id stays null. An empty table gives no
    rows. Other columns of `docs` are not read.
    """
    limits = (capacity, max_documents or capacity, max_attention or capacity**2)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = put(map_arrow(docs, _pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"), "pieces")
    shards = max(1, -(-pieces.count() // PIECES_PER_SHARD))
    return (
        ship(pieces).withColumn("shard", F.col("salt") % F.lit(shards))
        .groupBy("shard")
        .applyInArrow(_pack(limits, weights, rule), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
