"""Benchmark decontamination by templates.

A text becomes a sequence of literals (lower-cased words without punctuation at their ends) and typed placeholders: numbers, units
after a number, and names (capitalised words inside a sentence). Windows of 8 are hash-joined with those of the benchmark items. The
matches of a document and an item are lined up by their distance, and a window counts only where its slots are consistent along the
line: one value of a placeholder in the item stands for one value in the document, and the reverse, as in a question asked anew with
other parameters. A window that has the item's own values counts always; one with fewer than 3 literals counts only so. A document is
contaminated by an item if windows that count cover 13 of the item's words, or all of a shorter item.

Windows of items are a table. Documents are read once: those of their windows that a bitmap of fixed size lets through are written with
the words that fill their slots, and are joined with the items' windows by hash; so only these windows move, whatever the size of the
benchmark. A document and an item that have windows in common are then judged together; that group is no larger than the two of them.

Results, by case: null and empty texts match nothing; an item of fewer than 3 words is never matched, one of fewer
than 3 literals by its exact words only; an item of fewer than 8 words
is matched as a whole; a text of any length is read whole; repeated rows and items each give their own rows; a table without rows
gives none; extra columns are left out (`matches`) or kept (`clean`); a null item_id stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.names import fresh
from vertexloom.llm.scratch import Scratch
from vertexloom.llm.textops import WIDE, mix, pieces, powers
from vertexloom.llm.workers import claim

WINDOW, COVERED, LITERALS = 8, 13, 3
#: The most bits of the bitmap of the benchmark's windows, as a power of two; smaller benchmarks have 256 bits or more for each window.
FILTER_BITS = 28
#: Where the bits of a key's two places begin.
SHIFTS = (36, 5)
_UNITS = frozenset("mm cm m km in ft mi inch inches foot feet mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur mph kph hz khz mhz ghz kb mb gb tb w kw v degrees".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:e[+-]?\d+)?(?:st|nd|rd|th|%)?$")
_JOINED = re.compile(r"([+-]?\d+(?:[.,]\d+)*)([^\W\d_]+)$")
_EDGES = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
#: Kinds of words, in the low bits of their code; the bits above are a hash.
LITERAL, NAME, NUMBER, UNIT, NOTHING, AMOUNT, STOP = 0, 1, 2, 3, 4, 5, 8
_HOLE = {NAME: 11, NUMBER: 13, UNIT: 17, AMOUNT: 19}
REMEMBERED = 200_000


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Codes(dict):
    """The code of each word by itself: its kind, whether a sentence ends with it, and a hash of its literal."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        most = text.strip(".,;")
        if most.isalpha() and most.lower() not in _UNITS:  # nearly all words
            code = (_hash(most.lower()) & ~15) | (NAME if most[0].isupper() and not most.isupper() else LITERAL) | (STOP if text[-1] == "." else 0)
            if len(self) < REMEMBERED:
                self[word] = code
            return code
        stop = STOP if text.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":", "…") else 0
        edge = _EDGES.sub("", text)
        plain = _TRIM.sub("", text)
        if _NUMBER.match(edge):
            kind = NUMBER
        elif (m := _JOINED.match(edge)) and m[2].lower() in _UNITS:
            kind = AMOUNT
        elif not plain:
            kind = NOTHING
        elif plain.lower() in _UNITS:
            kind = UNIT
        elif plain[0].isupper() and any(c.islower() for c in plain):
            kind = NAME
        else:
            kind = LITERAL
        code = (_hash(plain.lower()) & ~15) | kind | stop
        if len(self) < REMEMBERED:
            self[word] = code
        return code


_codes = Codes()


def template(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words that count, their kinds, the hash of each as a template has it, and that of the word itself."""
    code = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    kind = (code & np.uint64(7)).astype(np.int8)
    stop = (code & np.uint64(STOP)) > 0
    at = np.flatnonzero(kind != NOTHING)
    stop_before = np.ones(len(at), bool)
    if len(at):
        ends = np.cumsum(stop)
        stop_before[1:] = ends[at[1:] - 1] > np.r_[0, ends][at[:-1]]  # a sentence ended at the word before, or at signs between
    kind, code = kind[at], code[at] & ~np.uint64(15)
    number_before = np.r_[False, kind[:-1] == NUMBER]
    kind[(kind == NAME) & stop_before] = LITERAL
    kind[(kind == UNIT) & ~number_before] = LITERAL
    hashes = code.copy()
    for k, value in _HOLE.items():
        hashes[kind == k] = value
    return at, kind, mix(hashes), mix(code)


def windows(hashes: np.ndarray, kind: np.ndarray, k: int, few: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of k with enough literals begin, or with too few, and their hashes."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(WIDE[0], n + 1)
    sums, plain = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    np.cumsum(kind == LITERAL, out=plain[1:])
    at = np.flatnonzero((plain[k:] - plain[:-k] >= min(k, LITERALS)) != few)
    return at, mix((sums[at + k] - sums[at]) * down[at]) ^ np.uint64(k)


class Windows:
    """The words of a text that count, and its windows of given lengths."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode("utf-8", "replace").split()
        self.at, self.kind, self.hashes, self.exact = template(self.words)

    def of(self, k: int, few: bool) -> tuple[np.ndarray, np.ndarray]:
        return windows(self.exact if few else self.hashes, self.kind, k, few)

    def values(self, place: int, k: int) -> list[int]:
        """A hash of each word of a window, as it fills a slot."""
        return [_value(self.words[self.at[p]]) for p in range(place, place + k)]


def _value(word: bytes) -> int:
    return _hash(_EDGES.sub("", word.decode("utf-8", "replace")).lower()) - (1 << 63)


def counted(hits: list[tuple[int, int, int, bool, list[int], list[int], list[int]]], size: int) -> tuple[int, bool] | None:
    """Covered words of an item and whether all slots have its own values, or None if too few are covered.

    hits: a window's place in the document and in the item, its length, whether it is of few literals, the kinds of the item's words,
    and the values of both; size: the words of the item.
    """
    lines: dict[int, dict[tuple[int, bool], tuple[list[int], list[int], list[int]]]] = {}
    for p, place, _, few, *slots in hits:
        lines.setdefault(p - place, {})[place, few] = slots
    covered: set[int] = set()
    same = True
    for _, begins in sorted(lines.items()):
        filled = {b: [((k, u), (k, v)) for k, u, v in zip(*slots, strict=True) if k != LITERAL] for b, slots in begins.items()}
        there, back = {}, {}
        for (_, few), pairs in filled.items():
            if not few:
                for u, v in pairs:
                    there.setdefault(u, set()).add(v)
                    back.setdefault(v, set()).add(u)
        for (place, few), pairs in filled.items():
            exact = all(u == v for u, v in pairs)
            if exact or not few and all(len(there[u]) == 1 == len(back[v]) for u, v in pairs):
                covered.update(range(place, place + len(begins[place, few][0])))
                same = same and exact
    return (len(covered), same) if len(covered) >= min(COVERED, size) and covered else None


def _item_windows(text: str | None) -> Iterator[tuple[int, int, int, bool, list[int], list[int]]]:
    """key, place, length, few, kinds and values of each window of an item."""
    w = Windows(text)
    k = min(WINDOW, len(w.at))
    if k < LITERALS:
        return
    for few in (False, True):
        for place, key in zip(*w.of(k, few), strict=True):
            yield int(key.view(np.int64)), int(place), k, few, w.kind[place : place + k].tolist(), w.values(int(place), k)


class Index:
    """A few items in one process: what `matches` does over the cluster, for one text at a time."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = [(i, len(Windows(t).at)) for i, t in items]
        self.found: dict[int, list[tuple]] = {}
        for n, (_, text) in enumerate(items):
            for key, *rest in _item_windows(text):
                self.found.setdefault(key, []).append((n, *rest))
        self.lengths = {(k, few) for x in self.found.values() for _, _, k, few, *_ in x}

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, bool]]:
        """(item_id, covered words, words of the item, whether all slots have the item's own values) for each contaminating item."""
        w, hits = Windows(text), {}
        for k, few in self.lengths:
            for p, key in zip(*w.of(k, few), strict=True):
                for n, place, size, other, kinds, values in self.found.get(int(key.view(np.int64)), ()):
                    if (size, other) == (k, few):
                        hits.setdefault(n, []).append((int(p), place, k, few, kinds, values, w.values(int(p), k)))
        found = [(n, counted(h, self.items[n][1])) for n, h in sorted(hits.items())]
        return [(self.items[n][0], c[0], self.items[n][1], c[1]) for n, c in found if c]


_ITEM = "item long, item_id long, size int, key long, place int, k int, few boolean, kinds array<int>, own array<long>"
_HIT = "uid long, key long, p int, k int, few boolean, value array<long>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("decontaminate", _codes.clear)
    for batch in pieces(batches, "text"):
        for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = list(_item_windows(text))
            size = len(Windows(text).at)
            key, place, k, few, kinds, values = zip(*found, strict=True) if found else ((),) * 6
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array(key, pa.int64()), pa.array(place, pa.int32()), pa.array(k, pa.int32()), pa.array(few, pa.bool_()), pa.array(kinds, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], ["item", "item_id", "size", "key", "place", "k", "few", "kinds", "own"])


def _near(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    last = np.uint64(8 * len(bitmap) - 1)
    near = np.ones(len(key), bool)
    for shift in SHIFTS:
        at = (key >> np.uint64(shift) & last).astype(np.int64)
        near &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return near


def _bitmap(items: DataFrame) -> Broadcast:
    """Two places for each key of the items: 32 MB at most."""
    size = max(16, min(FILTER_BITS, (256 * items.count()).bit_length()))
    at = [F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << size) - 1)) + 1 for shift in SHIFTS]  # Spark numbers bits from 1
    parts = items.select(F.explode(F.array(*at)).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bitmap = bytearray(max(4096, 1 << (size - 3)))
    for r in parts.collect():  # 8192 parts of 4 kB at most
        bitmap[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["bits"]
    bitmap = bitmap[: 1 << (size - 3)]
    return items.sparkSession.sparkContext.broadcast(bytes(bitmap))


def _hits(bitmap: Broadcast, lengths: list[tuple[int, bool]]):
    """The windows of documents (uid, text) that an item may have, too."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        uid, key, p, k, few, value = zip(*out, strict=True) if out else ((),) * 6
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(key, pa.int64()), pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(few, pa.bool_()), pa.array(value, pa.list_(pa.int64()))], ["uid", "key", "p", "k", "few", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate", _codes.clear)
        bits, out = np.frombuffer(bitmap.value, np.uint8), []
        for batch in pieces(batches, "text"):
            for uid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = Windows(text)
                for k, few in lengths:
                    where, key = w.of(k, few)
                    near = np.flatnonzero(_near(bits, key))
                    for at in range(0, len(near), 10_000):
                        some = near[at : at + 10_000]
                        out += [(uid, int(x), int(p), k, few, w.values(int(p), k)) for p, x in zip(where[some], key[some].view(np.int64), strict=True)]
                        if len(out) >= 10_000:
                            yield rows(out)
                            out = []
        if out:
            yield rows(out)

    return run


def _resolved(hits: pa.Table) -> pa.Table:
    """One row for a document and an item, if it is contaminated by it."""
    rows = hits.to_pydict()
    found = counted(list(zip(*(rows[c] for c in ("p", "place", "k", "few", "kinds", "own", "value")), strict=True)), rows["size"][0])
    one = [rows[c][:1] if found else [] for c in ("uid", "item_id", "size")]
    return pa.table([pa.array(one[0], pa.int64()), pa.array(one[1], pa.int64()), pa.array([found[0]] if found else [], pa.int64()), pa.array(one[2], pa.int64()), pa.array([found[1]] if found else [], pa.bool_())], ["uid", "item_id", "n_covered", "n_item_words", "exact"])


def _contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """docs: uid, text. uid, item_id, n_covered, n_item_words and exact."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    items = scratch.table(items.mapInArrow(_items, _ITEM), "items")
    lengths = [(r["k"], r["few"]) for r in items.select("k", "few").distinct().collect()]  # six lengths, of few literals or not
    hits = docs.mapInArrow(_hits(_bitmap(items), lengths), _HIT).dropDuplicates(["uid", "key", "p", "k", "few"])  # rows that are equal throughout
    hits = scratch.table(hits, "hits")
    # both sides are written tables, so Spark knows their sizes and splits a window that very many texts have
    met = hits.join(items, ["key", "k", "few"])
    return met.groupBy("uid", "item").applyInArrow(_resolved, "uid long, item_id long, n_covered long, n_item_words long, exact boolean")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_covered, n_item_words and exact for each contaminated document (doc_id, text) and its items (item_id, text)."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    # a row is known by a hash that is the same for equal rows
    uid = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), uid.alias("uid"), "text")
    found = scratch.table(_contaminated(rows.select("uid", "text"), benchmark, scratch), "found")
    return rows.select("doc_id", "uid").join(found, "uid").select("doc_id", "item_id", "n_covered", "n_item_words", "exact")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text no item contaminates."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    (uid,) = fresh(docs.columns, "uid")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    found = scratch.table(_contaminated(docs.select(key.alias("uid"), "text"), benchmark, scratch).select(F.col("uid").alias(uid)).distinct(), "found")
    return docs.withColumn(uid, key).join(found, uid, "left_anti").select(*docs.columns)
