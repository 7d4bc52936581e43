"""Whole Arrow batches of text as flat arrays of words, hashes and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vertexloom.llm.workers import let_go

#: White space between words: blank and the ASCII controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Line feeds alone.
NEWLINE = np.arange(256) == 10
BLOCK = 1 << 20
_ODD, _ODD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base and its inverse mod 2**64, to the powers 0 to n - 1."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[base] = (out[0], out[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a column of strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offs


def pieces(batches: Iterator[pa.RecordBatch], *columns: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (or of bytes) in these columns; a longer row is a batch of its own. Then freed memory goes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for name in columns:
            sizes += pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
        offs, at = np.r_[0, np.cumsum(sizes)], 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    let_go()


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, or what other gaps leave: word i is data[starts[i]:ends[i]]; text d has the words first[d]:first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        lo, hi = int(offsets[0]), int(offsets[-1])
        part = data[lo:hi]
        inside = ~gaps[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]] - lo
        begins[edges] = inside[edges]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = edges[1:] - 1
        ends[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(begins) + lo, np.flatnonzero(ends) + lo + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        return cls(*text_buffers(column))

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same on every machine."""
        out = np.empty(len(self.starts), np.uint64)
        at, n = 0, len(self.starts)
        while at < n:
            base = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, base + BLOCK, "right")))
            span = self.data[base : int(self.ends[to - 1])]
            up, down = powers(_ODD, len(span) + 1)
            sums = np.zeros(len(span) + 1, np.uint64)
            np.cumsum(_TABLE[span] * up[: len(span)], out=sums[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mix(out)

    def windows(self, hashes: np.ndarray, k: int, seeds: tuple[int, ...] = (_ODD2,)) -> tuple[np.ndarray, ...]:
        """The words at which k words of one text begin, then for each seed a hash of those words."""
        n = len(hashes)
        room = np.repeat(self.first[1:], self.counts) - np.arange(n)
        at = np.flatnonzero(room >= k)
        out = [at]
        for seed in seeds:
            up, down = powers(seed, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(hashes * up[:n], out=sums[1:])
            out.append(mix((sums[at + k] - sums[at]) * down[at]))
        return tuple(out)

    def document(self, words: np.ndarray) -> np.ndarray:
        """The text to which each word belongs."""
        return np.searchsorted(self.first, words, "right") - 1


#: Two independent odd multipliers for 128-bit window keys.
WIDE = (_ODD2, 0x165667B19E3779F9)


def sums_by_text(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of values[begins[d]:ends[d]] for each text d; begins[d] <= ends[d]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[begins]


def repeats(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal key in the same text at all, and which have it earlier."""
    both = keys ^ mix(docs.astype(np.uint64) + np.uint64(1))
    order = np.argsort(both, kind="stable")
    same = (both[order[1:]] == both[order[:-1]]) & (docs[order[1:]] == docs[order[:-1]])
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_ | later, later


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a window of k words that begins at one of `at`."""
    change = np.zeros(n + 1, np.int32)
    change += np.bincount(at, minlength=n + 1).astype(np.int32)
    change -= np.bincount(at + k, minlength=n + 1).astype(np.int32)
    return np.cumsum(change)[:n] > 0
