"""Substring de-duplication: words in a window of 20 words that has begun earlier are removed.

Every window holds an anchor: the least of its 8-word hashes. Equal windows have equal anchors at the same place, so a count of
anchors is never less than the count of any window that holds them.

1. Each task counts its anchors in a count-min sketch of fixed size; tasks send the sketch's cells by segment, and segments are
   merged by addition. Two bitmaps come back, 32 MB at any size of the corpus: cells of two and more, and cells of many.
2. A second pass sends on only the windows whose anchor is estimated to repeat, and so loses none that repeats. Of equal windows
   in one chunk of a task only the first is sent; the others are removed there and then, so a window that stands in a third of all
   documents reaches the shuffle once for each chunk. Windows of frequent anchors are dealt out one by one, others by anchor; the
   rows of one frequent window are thinned to one in each of 256 parts before they meet.
3. Exact groups of 128-bit keys (anchor and window) find the windows that are not the first, and their words go.

The sketch loses force as the corpus outgrows it (anchors are a seventh of the words; about 100 million for one window in four to
pass needlessly) but not exactness; `width_bits` is a parameter.

Results, by case: a null or empty text has no words and nothing is removed; texts of fewer than 20 words stay whole; a text of any
length is read whole; rows with one doc_id do not precede each other at the same word, so repeated rows with one id stay alike; a
null doc_id precedes all others; a table without rows gives none; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.names import fresh
from vertexloom.llm.scratch import Scratch
from vertexloom.llm.textops import WIDE, Words, mix, pieces
from vertexloom.llm.workers import alone

WINDOW, GRAM = 20, 8
#: Cells of each of two rows of the sketch, as a power of two; the count from which an anchor is frequent.
WIDTH_BITS, FREQUENT = 26, 64
SEGMENT_BITS = 20
#: Parts in which a frequent window is thinned before its exact group.
SALTS = 256
#: Windows that a task holds at once, and bytes of text that it adds to them.
CHUNK, TEXT = 600_000, 1 << 20
FIRST_ID = -(1 << 63)


def anchors(w: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words at which windows begin, and for each the place and the hash of its anchor (the leftmost least gram)."""
    at, _ = w.windows(hashes, window, WIDE[:1])
    n = len(hashes)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    sums = hashes[: n - gram + 1].copy()
    for k in range(1, gram):
        sums = sums * np.uint64(WIDE[1]) + hashes[k : k + len(sums)]
    grams = mix(sums)
    best = grams[: n - window + 1].copy()
    place = np.zeros(len(best), np.uint8)
    for k in range(1, window - gram + 1):
        other = grams[k : k + len(best)]
        less = other < best
        np.copyto(best, other, where=less)
        place[less] = k
    return at, at + place[at], best[at]


def cells(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's cell in each row of the sketch; the second row's cells come after the first's."""
    mask = np.uint64((1 << bits) - 1)
    return (anchor & mask).astype(np.int64), ((anchor >> np.uint64(32)) & mask).astype(np.int64) + (1 << bits)


def occurrences(place: np.ndarray) -> np.ndarray:
    """Where, among windows in order, a new anchor begins: windows that share one stand together."""
    return np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else place


def _count(window: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            all_ = np.repeat(found, np.minimum(count, FREQUENT))
            segment = all_ >> SEGMENT_BITS
            cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            low, high = (all_ & 0xFFFF).astype(np.uint16), ((all_ >> 16) & ((1 << (SEGMENT_BITS - 16)) - 1))
            rows = list(zip(cuts, np.r_[cuts[1:], len(all_)], strict=True))
            sizes = [np.bincount(high[a:b], minlength=1 << (SEGMENT_BITS - 16)).astype(np.int32).tobytes() for a, b in rows]
            return pa.RecordBatch.from_arrays([pa.array(segment[cuts].astype(np.int32)), pa.array(sizes, pa.binary()), pa.array([low[a:b].tobytes() for a, b in rows], pa.binary())], ["segment", "blocks", "cells"])

        held = 0
        for batch in pieces(batches, "text", most=TEXT):
            w = Words.of(batch.column(batch.schema.get_field_index("text")))
            _, place, anchor = anchors(w, w.hashes(), window, gram)
            one, two = cells(anchor[occurrences(place)], bits)
            if len(one):
                waiting += [one, two]
                held += 2 * len(one)
            if held > 1 << 22:
                yield flush()
                held = 0
        if held:
            yield flush()

    return run


def _merge(frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, blocks, low in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sizes = np.frombuffer(blocks, np.int32)
                at = np.frombuffer(low, np.uint16).astype(np.int64) + np.repeat(np.arange(len(sizes)) << 16, sizes)
                count = state.setdefault(segment, np.zeros(1 << SEGMENT_BITS, np.uint8))
                found, more = np.unique(at, return_counts=True)
                count[found] = np.minimum(count[found].astype(np.int64) + more, frequent)
        for segment, count in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(count >= 2, bitorder="little").tobytes()], pa.binary()), pa.array([np.packbits(count >= frequent, bitorder="little").tobytes()], pa.binary())], ["segment", "twice", "often"])

    return run


def _bits(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _later(key: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal one with a smaller (doc, start)."""
    order = np.lexsort((start, doc, *key))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in key:
        same &= k[order[1:]] == k[order[:-1]]
    begins = np.flatnonzero(np.r_[True, ~same]) if len(order) else order
    first = np.repeat(order[begins], np.diff(np.r_[begins, len(order)]))
    out = np.zeros(len(order), bool)
    out[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return out


def _ranges(doc: np.ndarray, row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Removed windows as doc, row and ranges of words."""
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + window)] if len(doc) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    last = np.r_[a[1:], len(doc)] - 1
    return doc[a], row[a], start[a], start[last] + window


_SENT = "route long, anchor long, doc long, row long, start int, offsets binary, keys binary, lo int, hi int, hot boolean"
_NAMES = ["route", "anchor", "doc", "row", "start", "offsets", "keys", "lo", "hi", "hot"]


def _removed_rows(doc, row, lo, hi) -> pa.RecordBatch:
    n = len(doc)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([*none, pa.array(doc), pa.array(row), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.nulls(n, pa.bool_())], _NAMES)


def _send(window: int, gram: int, bits: int, twice, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = np.frombuffer(twice.value, np.uint8), np.frombuffer(often.value, np.uint8)
        waiting: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            anchor, key, doc, row, start, hot, run_ = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            later = _later([key, anchor], doc, start)
            if later.any():
                yield _removed_rows(*_ranges(doc[later], row[later], start[later], window))
            keep = ~later
            anchor, key, doc, row, start, hot, run_ = (x[keep] for x in (anchor, key, doc, row, start, hot, run_))
            if not len(anchor):
                return
            cut = np.flatnonzero(np.r_[True, (run_[1:] != run_[:-1]) | hot[1:]])
            ends = np.r_[cut[1:], len(anchor)]
            route = np.where(hot, mix(anchor ^ key), anchor).view(np.int64)
            base = np.repeat(start[cut], ends - cut)
            offsets, keys = (start - base).astype(np.uint8).tobytes(), key.tobytes()
            for at in range(0, len(cut), 50_000):
                c, e = cut[at : at + 50_000], ends[at : at + 50_000]
                n = len(c)
                yield pa.RecordBatch.from_arrays([pa.array(route[c]), pa.array(anchor[c].view(np.int64)), pa.array(doc[c]), pa.array(row[c]), pa.array(start[c].astype(np.int32)), pa.array([offsets[a:b] for a, b in zip(c, e, strict=True)], pa.binary()), pa.array([keys[8 * a : 8 * b] for a, b in zip(c, e, strict=True)], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(hot[c])], _NAMES)

        held = runs = 0
        for batch in pieces(batches, "text", most=TEXT):
            w = Words.of(batch.column(batch.schema.get_field_index("text")))
            hashes = w.hashes()
            at, place, anchor = anchors(w, hashes, window, gram)
            if not len(at):
                continue
            begin = occurrences(place)
            one, two = cells(anchor[begin], bits)
            hit = _bits(repeated, one) & _bits(repeated, two)
            hot = _bits(frequent, one) & _bits(frequent, two)
            lengths = np.diff(np.r_[begin, len(at)])
            keep = np.repeat(hit, lengths)
            if not keep.any():
                continue
            _, key = w.windows(hashes, window, WIDE[1:])
            d = w.document(at[keep])
            ids = np.asarray(batch.column(batch.schema.get_field_index("doc")))
            rows = np.asarray(batch.column(batch.schema.get_field_index("row")))
            waiting.append((anchor[keep], key[keep], ids[d], rows[d], at[keep] - w.first[d], np.repeat(hot, lengths)[keep], np.repeat(np.arange(len(begin)) + runs, lengths)[keep]))
            runs += len(begin)
            held += int(keep.sum())
            if held > CHUNK:
                yield from flush()
                held = 0
        if waiting:
            yield from flush()

    return run


def _group(window: int, thin: bool = False):
    """Ranges of the windows that are not the first. thin: rows as they were sent, of single windows; the first ones go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[pa.RecordBatch] = []

        def resolve(part: pa.Table) -> pa.RecordBatch | None:
            blobs = part.column("offsets").to_pylist()
            m = np.fromiter(map(len, blobs), np.int64, len(blobs))
            spread = lambda name: np.repeat(part.column(name).to_numpy(), m)
            key = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.uint64)
            doc, row = spread("doc"), spread("row")
            start = spread("start").astype(np.int64) + np.frombuffer(b"".join(blobs), np.uint8)
            later = _later([key, spread("anchor")], doc, start)
            if thin:
                gone = [_removed_rows(*_ranges(doc[later], row[later], start[later], window))] if later.any() else []
                return pa.concat_batches([*gone, *(pa.RecordBatch.from_arrays(b.columns, _NAMES) for b in part.filter(pa.array(~later)).to_batches())])
            if not later.any():
                return None
            doc, row, lo, hi = _ranges(doc[later], row[later], start[later], window)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc", "row", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            route = batch.column(0).to_numpy()
            last = int(np.searchsorted(route, route[-1], "left"))
            if last or (carry and carry[-1].column(0)[0].as_py() != route[0]):
                done = [*carry, batch.slice(0, last)] if last else carry
                if (out := resolve(pa.Table.from_batches(done))) is not None:
                    yield out
                carry = []
            carry.append(batch.slice(last))
        if carry and (out := resolve(pa.Table.from_batches(carry))) is not None:
            yield out

    return run


def _kept(batch: pa.RecordBatch) -> tuple[np.ndarray, list[int], list[str | None]]:
    """The number of words of each text and of those removed, and the words that stay (None where all do)."""
    w = Words.of(batch.column(batch.schema.get_field_index("text")))
    data, kept, removed = w.data, [], []
    for d, ranges in enumerate(batch.columns[-1].to_pylist()):
        n = int(w.counts[d])
        if not ranges:
            kept.append(None)
            removed.append(0)
            continue
        change = np.bincount([r["lo"] for r in ranges], minlength=n + 1) - np.bincount([r["hi"] for r in ranges], minlength=n + 1)
        stay = np.cumsum(change)[:-1] == 0
        words = bytes(data[w.offsets[d] : w.offsets[d + 1]]).split()
        kept.append(b" ".join([x for x, s in zip(words, stay, strict=True) if s]).decode())
        removed.append(n - int(stay.sum()))
    return w.counts, removed, kept


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
        counts, removed, kept = _kept(batch)
        texts = [k if k is not None else b" ".join(t.encode().split()).decode() for k, t in zip(kept, column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def repeated_ranges(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, width_bits: int = WIDTH_BITS) -> DataFrame:
    """docs: doc (long), row (long), text. doc, row and ranges lo, hi of words to remove; ranges may overlap."""
    spark = docs.sparkSession
    texts = docs.select("text")
    sketch = texts.mapInArrow(_count(window, gram, width_bits), "segment int, blocks binary, cells binary")
    merged = sketch.repartition("segment").mapInArrow(_merge(FREQUENT), "segment int, twice binary, often binary")
    size = 1 << (SEGMENT_BITS - 3)
    twice, often = (bytearray(max(size, 2 << (width_bits - 3))) for _ in range(2))
    for r in merged.toLocalIterator():  # one row for each segment of the fixed sketch
        twice[r["segment"] * size : (r["segment"] + 1) * size] = r["twice"]
        often[r["segment"] * size : (r["segment"] + 1) * size] = r["often"]
    share = spark.sparkContext.broadcast
    sent = scratch.table(docs.select("doc", "row", "text").mapInArrow(_send(window, gram, width_bits, share(bytes(twice)), share(bytes(often))), _SENT), "sent")
    # a frequent window has a row for each chunk of a task: these are thinned in SALTS parts first, so that no task gets all of them
    salted = sent.where("hot").withColumn("salt", F.pmod(F.xxhash64("doc", "row", "start"), F.lit(SALTS)))
    thinned = scratch.table(salted.repartition("route", "salt").drop("salt").sortWithinPartitions("route").mapInArrow(_group(window, thin=True), _SENT), "thinned")
    both = sent.where("not coalesce(hot, false)").unionByName(thinned)
    local = both.where("route is null").select("doc", "row", "lo", "hi")
    found = both.where("route is not null").drop("lo", "hi", "hot").repartition("route").sortWithinPartitions("route").mapInArrow(_group(window), "doc long, row long, lo int, hi int")
    return local.unionByName(found)


def _with_ranges(docs: DataFrame, *columns: str, **options: int) -> DataFrame:
    """The columns, and then the ranges to remove, for each row of docs."""
    scratch = Scratch(docs.sparkSession, "substring")
    doc, row, found = fresh(docs.columns, "doc", "row", "ranges")
    keys = {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)), row: F.xxhash64(F.coalesce("text", F.lit("")))}
    plain = docs.select(keys[doc].alias("doc"), keys[row].alias("row"), "text")
    ranges = repeated_ranges(plain, scratch, **options).groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi")).alias(found))
    ranges = ranges.withColumnsRenamed({"doc": doc, "row": row})
    return docs.select(*columns).withColumns(keys).join(ranges, [doc, row], "left").select(*columns, found)


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width_bits: int = WIDTH_BITS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by blanks) for each row of docs (doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _with_ranges(plain, "doc_id", "text", window=window, gram=gram, width_bits=width_bits)
    return rows.mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_text string")


def stripped(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width_bits: int = WIDTH_BITS) -> DataFrame:
    """The rows of docs with all their columns. A text that loses words is what stays, joined by blanks; n_chars, if there, follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            _, _, kept = _kept(batch)
            names = batch.schema.names[:-1]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            old = columns["text"].to_pylist()
            columns["text"] = pa.array([t if k is None else k for t, k in zip(old, kept, strict=True)], pa.string())
            if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                columns["n_chars"] = pa.array([c if k is None else len(k) for c, k in zip(columns["n_chars"].to_pylist(), kept, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return _with_ranges(docs, *docs.columns, window=window, gram=gram, width_bits=width_bits).mapInArrow(run, docs.schema)
