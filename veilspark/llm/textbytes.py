"""Vectorised word and shingle hashing over Arrow string columns.

A batch of texts is one UTF-8 byte buffer plus document offsets. Words, their
64-bit hashes and shingles come from a few numpy passes over that buffer, with
no Python work per word. Hashes are polynomial over random byte codes modulo
2**64 and mixed at the end; equal words have equal hashes in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Any byte of `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside ASCII letters, digits and non-ASCII characters.
NOT_WORD = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_CODES = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n + 1, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer that spreads every bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return bytes_of(pc.fill_null(column.cast(pa.large_string()), ""))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batches, text: str = "text", limit: int = 1 << 20):
    """Splits record batches at row bounds into blocks of about `limit` bytes of text; a longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of a block: byte spans, hashes and the document of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, cuts: np.ndarray | None = None):
        """cuts: bytes at which a word starts even without a separator before it."""
        self.raw, n = raw, len(raw)
        inside = ~separator[raw]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        if cuts is not None:
            first[:-1] |= cuts
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        #: Of each document, its first word; one more at the end.
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, stretch: int = 1 << 20) -> np.ndarray:
        """A hash of each word's bytes. The sums cover about `stretch` bytes at a time, so a very long text needs no more memory for them."""
        out = np.empty(len(self.starts), U64)
        a = 0
        while a < len(out):
            low = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, low + stretch, "right")))
            starts, ends = self.starts[a:b] - low, self.ends[a:b] - low
            n = int(ends[-1])
            up, down = _power_tables(n)
            sums = np.zeros(n + 1, U64)
            np.cumsum(_CODES[self.raw[low : low + n]] * up[:n], out=sums[1:])
            out[a:b] = mix((sums[ends] - sums[starts]) * down[starts])
            a = b
        return out


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """Of each document, the sorted distinct hashes of its runs of `width` words; the whole sequence if it has fewer words; empty without words."""
    w = words.hashes()
    scale = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    n = len(w)
    runs = np.zeros(max(0, n - width + 1), U64)
    for k in range(width if len(runs) else 0):
        runs += w[k : n - width + 1 + k] * scale[k]
    runs = mix(runs)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((w[a:b] * scale[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out
