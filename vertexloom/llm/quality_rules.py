"""Quality rules: counts of a text, and a hashed n-gram logistic regression with calibrated probabilities.

Features are relative frequencies of hashed word 1- and 2-grams and character 2- and 3-grams, each family in its own range of
buckets, and the share of words that lie in a repeated 3-word window. A logistic regression is fitted to a bounded sample of
labelled texts (Newton steps in the dual), Platt scaling on rows that it has not seen makes its score a probability, and every
text is scored in Arrow batches and held against a fixed threshold.

Results, by case: a null or empty text has no words, so it fails the base rules; a text of any length is counted whole; repeated
rows get the same verdict; a table without rows gives none; extra columns are left out; labels that are null are not learnt from;
without labels of both kinds the fitted probability is the share of good labels (1 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.textops import NEWLINE, SPACE, Words, covered, mix, pieces, repeats, sums_by_text

#: Labelled texts to learn from at most, the last third of them for calibration; buckets of each family of n-grams.
SAMPLE, BITS, THRESHOLD = 2400, 12, 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_COUNTED = ((np.arange(256) & 0xC0) != 0x80) & ~SPACE
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts side by side, and where those of each text begin and end."""
    lo, part = int(offsets[0]), data[int(offsets[0]) : int(offsets[-1])]
    lead = np.flatnonzero((part & 0xC0) != 0x80)
    first = part[lead]
    if not len(lead) or int(first.max()) < 0x80:
        return part.astype(np.uint32), (offsets - lo).astype(np.int64)
    more = np.r_[part, np.zeros(3, np.uint8)].astype(np.uint32) & np.uint32(0x3F)
    code = first.astype(np.uint32)
    for low, length, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        at = np.flatnonzero((first >= low) & (first < (0xE0, 0xF0, 0x100)[length - 2]))
        value = first[at].astype(np.uint32) & np.uint32(mask)
        for k in range(1, length):
            value = value << np.uint32(6) | more[lead[at] + k]
        code[at] = value
    return code, np.searchsorted(lead, offsets - lo)


class Counted:
    """The words and the counts of each text of a batch."""

    def __init__(self, column: pa.Array):
        w = self.words = Words.of(column)
        self.hashes = w.hashes()
        data, offs, first = w.data, w.offsets, w.first
        lo, hi = offs[0], offs[-1]
        per = lambda table: sums_by_text(table[data[lo:hi]], offs[:-1] - lo, offs[1:] - lo)
        at, keys = w.windows(self.hashes, 3)
        again, _ = repeats(keys, w.document(at))
        in_repeat = covered(len(self.hashes), at[again], 3)
        lines = Words(data, offs, NEWLINE)
        has_word = np.searchsorted(w.starts, lines.starts) < np.searchsorted(w.starts, lines.ends)
        owner = lines.document(np.arange(len(lines.starts)))
        _, later = repeats(lines.hashes(), owner)
        self.counts = {
            "n_words": w.counts.astype(np.int64),
            "word_chars": per(_COUNTED),
            "n_symbols": per(_SYMBOL),
            "n_dup_lines": np.bincount(owner[later & has_word], minlength=len(offs) - 1),
            "n_repeat_words": sums_by_text(in_repeat, first[:-1], first[1:]),
        }

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each family the buckets of all n-grams, and where those of each text begin and end."""
        w, h, mask = self.words, self.hashes, np.uint64((1 << BITS) - 1)
        first, second = w.first[:-1], w.first[1:]
        yield (h & mask).astype(np.int32), first, second
        pairs = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
        yield (pairs & mask).astype(np.int32), np.minimum(first, len(pairs)), np.clip(second - 1, np.minimum(first, len(pairs)), len(pairs))
        chars, offs = characters(w.data, w.offsets)
        for n in (2, 3):
            code = chars[: max(0, len(chars) - n + 1)].copy()
            for k in range(1, n):
                code = code * np.uint32(0x01000193) + chars[k : len(code) + k]
            code *= np.uint32(0x9E3779B1)
            begins = np.minimum(offs[:-1], len(code))
            yield (code >> np.uint32(32 - BITS)).astype(np.int32), begins, np.clip(offs[1:] - n + 1, begins, len(code))

    def repeated_share(self) -> np.ndarray:
        return self.counts["n_repeat_words"] / np.maximum(1, self.counts["n_words"])

    def base_failed(self) -> np.ndarray:
        n, r = self.counts["n_words"], self.counts["n_repeat_words"]
        return (n < MIN_WORDS) | (100 * r > MAX_REPEATED_PERCENT * n)


@dataclass
class Model:
    weights: np.ndarray  # of the four families of n-grams, then of the repeated share
    bias: float
    prior: float = 0.5  # the share of good labels that it was calibrated on

    def log_odds(self, batch: Counted) -> np.ndarray:
        out = np.full(len(batch.words.counts), self.bias) + self.weights[-1] * batch.repeated_share()
        for f, (buckets, begins, ends) in enumerate(batch.grams()):
            out += sums_by_text(self.weights[f << BITS : (f + 1) << BITS][buckets], begins, ends) / np.maximum(1, ends - begins)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse training vectors of labelled texts."""
    for batch in pieces(batches, "text"):
        c = Counted(batch.column(batch.schema.get_field_index("text")))
        grams, share = list(c.grams()), c.repeated_share()
        index, value = [], []
        for d in range(batch.num_rows):
            dense = np.zeros((4 << BITS) + 1, np.float32)
            for f, (buckets, begins, ends) in enumerate(grams):
                if ends[d] > begins[d]:
                    dense[f << BITS : (f + 1) << BITS] = np.bincount(buckets[begins[d] : ends[d]], minlength=1 << BITS) / (ends[d] - begins[d])
            dense[-1] = share[d]
            at = np.flatnonzero(dense)
            index.append(at.astype(np.int32).tobytes())
            value.append(dense[at].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), batch.column(batch.schema.get_field_index("place")), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["label", "place", "index", "value"])


class Sparse:
    """Rows of indices and values: only a block of columns is ever dense."""

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray], size: int):
        self.row = np.repeat(np.arange(len(index), dtype=np.int32), [len(i) for i in index])
        self.index, self.value = np.concatenate(index), np.concatenate(value)
        self.rows, self.size = len(index), size

    def gram(self, rows: int, block: int = 1024) -> np.ndarray:
        """The products of the first rows with each other."""
        out = np.zeros((rows, rows))
        for a in range(0, self.size, block):
            at = np.flatnonzero((self.index >= a) & (self.index < a + block) & (self.row < rows))
            dense = np.zeros((rows, block), np.float32)
            dense[self.row[at], self.index[at] - a] = self.value[at]
            out += dense @ dense.T
        return out

    def weighted(self, alpha: np.ndarray) -> np.ndarray:
        """The sum of the first rows, each times its alpha."""
        n = int(np.searchsorted(self.row, len(alpha)))
        return np.bincount(self.index[:n], self.value[:n] * alpha[self.row[:n]], self.size)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], self.rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, ridge: float = 2e-5) -> Model:
    """docs: doc_id, text; labels: doc_id and the label column, 1 for good. Learns from at most `sample` rows, taken by a hash."""
    chosen = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"), F.abs(F.xxhash64(F.col("doc_id"), F.lit(7))).alias("place")).orderBy("place", "doc_id").limit(sample)
    # at most `sample` rows of three numbers are broadcast; where a doc_id is repeated, the join is bounded again
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "place", "text")
    vectors = rows.mapInArrow(_vectors, "label int, place long, index binary, value binary")
    if docs.select("doc_id").join(F.broadcast(chosen), "doc_id").count() > sample:
        vectors = vectors.orderBy("place", "label", "index").limit(sample)
    rows = vectors.toPandas()
    rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
    y = rows["label"].to_numpy(np.float64)
    size = (4 << BITS) + 1
    if len(y) < 4 or len(set(y)) < 2:
        prior = float(y.mean()) if len(y) else 1.0
        return Model(np.zeros(size), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), prior)
    cut = len(y) * 2 // 3
    x = Sparse([np.frombuffer(r, np.int32) for r in rows["index"]], [np.frombuffer(r, np.float32) for r in rows["value"]], size)
    del rows
    if len(set(y[:cut])) < 2 or len(set(y[cut:])) < 2:
        cut = len(y)
    t = y[:cut]
    gram = x.gram(cut) + 0.01  # the constant: a bias that is hardly shrunk
    alpha = np.zeros(cut)
    for _ in range(12):
        f = gram @ alpha
        p = sigmoid(f)
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(gram + np.diag(ridge / w), f + (t - p) / w) - alpha
        alpha += step
        if np.abs(gram @ step).max() < 1e-3:
            break
    weights, bias = x.weighted(alpha), 0.01 * alpha.sum()
    # Platt scaling, on the rows not trained on if there are such
    rest = slice(cut, None) if cut < len(y) else slice(None)
    s, t = x.times(weights)[rest] + bias, y[rest]
    good, bad = t.sum(), len(t) - t.sum()
    t = np.where(t == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a = np.array([1.0, 0.0])
    design = np.stack([s, np.ones_like(s)], 1)
    for _ in range(50):
        p = sigmoid(design @ a)
        h = design.T @ (design * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (t - p) - 1e-6 * (a - [1.0, 0.0]))
        a += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return Model(weights * a[0], float(bias * a[0] + a[1]), float(y.mean()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, p_quality and kept for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            c = Counted(batch.column(batch.schema.get_field_index("text")))
            p, failed = sigmoid(model.log_odds(c)), c.base_failed()
            columns = [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(c.counts[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "p_quality", "kept"])

    kinds = ", ".join(f"{k} long" for k in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {kinds}, base_failed boolean, p_quality double, kept boolean")
