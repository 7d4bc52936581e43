"""Near-duplicate documents by SimHash and random bit sampling.

Two texts are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more; a class is what links connect.

1. Equal texts count once. A text gets a fingerprint of 256 bits, each the majority of that bit over its distinct shingles.
2. Each of several tables samples 40 coordinates. Rows are sorted by table and sampled bits; texts that agree in the first bits are
   a bucket. One of more than 4096 texts is cut into blocks, and every pair of blocks is a unit of work, so all its pairs meet. The number of first bits follows the number of texts, and the number of
   tables is what finds 99.5 % of pairs at similarity 0.8, more of closer ones.
3. In a unit all pairs are compared by distance. Those within the limit become candidates; of a text with many, the nearest first.
   When these are verified, every unit where some were left out is compared again for texts with others within the limit that no
   link connects so far. Two of those can be linked only if they share one of their rarest shingles, so they are dealt out by these;
   pairs within the limit become candidates unless the rarest shingles alone show that too few are in both. Pairs that are connected change no class, so nothing is lost, and texts
   that share no more than a template meet nowhere.
4. Candidates are verified on the texts themselves, exactly, and verified links go into connected components.

Texts of up to 24 shingles are not left to fingerprints: they meet in one of their least shingles and are compared exactly.

Results, by case: null and empty texts and texts without words have no shingles and are like equal texts only (null counts as
empty); a text of 1 to 4 words has one shingle; repeated rows and ties fall into one class, whose class_id is the least doc_id (null
ids last); a table without rows gives none; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.functions.names import fresh
from vertexloom.llm.scratch import Scratch
from vertexloom.llm.textops import Words, mix, pieces, repeats, text_buffers
from vertexloom.llm.workers import alone, let_go
from vertexloom.operators.components import star_components

SHINGLE, SIMILARITY, BITS = 5, 0.8, 256
#: Texts in a bucket on average and at most; sampled coordinates of a table; the share of pairs at the least similarity to be found.
MEAN_BUCKET, CAP, SAMPLED, RECALL = 1000, 4096, 40, 0.995
#: First bits of a bucket at least; so corpora of up to half a million texts have the same tables.
LEAST_BITS = 9
#: A text with up to MANY candidates in 256 rows of a block sends them all at first, one with more its FEW nearest in either direction.
MANY, FEW = 16, 1
#: How far below the least similarity a fingerprint may put a pair that is verified.
SLACK = 0.15
#: Texts with up to so many shingles are found by the shingles themselves: few shingles bend the share of bits that agree.
SMALL = 24
#: Shingles of a text that are held against those of others at once.
TOLD = 128
#: Bits of the bitmap that tells whose texts are wanted, as a power of two.
FILTER_BITS = 27
FIRST_ID = -(1 << 63)
_SEEDS = np.array([0x9E3779B97F4A7C15 * (i + 1) % (1 << 64) for i in range(BITS // 64)], np.uint64)


def shingles(w: Words, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, and the text of each, in order. Fewer words than `size` are one shingle."""
    keys, docs = [], []
    for k in range(1, size + 1):
        at, key = w.windows(hashes, k)
        doc = w.document(at)
        if k < size:
            short = w.counts[doc] == k
            key, doc = key[short], doc[short]
        keys.append(key)
        docs.append(doc)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    _, later = repeats(key, doc)
    key, doc = key[~later], doc[~later]
    order = np.argsort(doc, kind="stable")
    return key[order], doc[order]


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """The majority of each bit over the shingles."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(keys), 255 * 32):
        part = mix(keys[at : at + 255 * 32, None] ^ _SEEDS)
        bits = np.unpackbits(part.view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(keys)).view(np.uint64)


def _prints(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """doc_id, digest, n_shingles, print, and small: the shingles of a text with up to `most`, in order."""
    alone()
    for batch in pieces(batches, "text"):
        w = Words.of(batch.column(batch.schema.get_field_index("text")))
        keys, doc = shingles(w, w.hashes())
        cuts = np.searchsorted(doc, np.arange(len(w.counts) + 1))
        found = [fingerprint(keys[a:b]) if b > a else np.zeros(BITS // 64, np.uint64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        small = [np.sort(keys[a:b]).tobytes() if 0 < b - a <= most else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        data = w.data
        digests = [hashlib.sha256(data[a:b]).digest()[:16] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(digests, pa.binary()), pa.array(np.diff(cuts)), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(small, pa.binary())], ["doc_id", "digest", "n_shingles", "print", "small"])


def agreement(similarity: float) -> float:
    """The share of bits in which fingerprints of two sets of this similarity agree."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(texts: int) -> tuple[int, int]:
    """The first bits of a bucket, and the number of tables."""
    bits = min(SAMPLED - 8, max(LEAST_BITS, math.ceil(math.log2(max(texts, 1) / MEAN_BUCKET))))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agreement(SIMILARITY) ** bits))


def coordinates(tables: int) -> np.ndarray:
    rng = np.random.default_rng(20240611)
    return np.stack([rng.permutation(BITS)[:SAMPLED] for _ in range(tables)])


def _rows(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, weight = coordinates(tables), np.int64(1) << np.arange(SAMPLED - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                prints = part.column(1)
                bits = np.unpackbits(np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1).astype(np.int64)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, t, np.int32)), pa.array(bits[:, where[t]] @ weight), part.column(0), prints], ["t", "key", "digest", "print"])

    return run


def units(rows: DataFrame, scratch: Scratch, cap: int, name: str = "large") -> DataFrame:
    """rows (t, bucket, digest, ...) with own, lo, hi: a bucket of more than `cap` rows is cut into blocks, and each pair of blocks is a unit.

    A row of a bucket of n blocks occurs in n units; unit lo = hi is a block by itself, the others hold one block against another.
    """
    large = scratch.table(rows.groupBy("t", "bucket").count().where(F.col("count") > cap).select("t", "bucket", F.ceil(F.col("count") / cap).cast("int").alias("n")), name)
    cut = rows.join(large, ["t", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = cut.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("n")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return other.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("n", "other")


def divided(keys: np.ndarray, shift: int, cap: int) -> Iterator[tuple[int, int, bool]]:
    """Parts of sorted keys: (begin, end, whether they agree in all sampled bits). Parts of up to `cap` agree in keys >> shift."""
    stack = [(0, len(keys), shift)]
    while stack:
        a, b, s = stack.pop()
        if b - a <= cap:
            yield a, b, False
        elif s == 0:
            yield a, b, True
        else:
            s -= 1
            half = a + int(np.searchsorted((keys[a:b] >> s) & 1, 1))
            stack += [(x, y, s) for x, y in ((a, half), (half, b)) if x < y]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray, list[list[bytes]]]]:
    """Units of two rows or more out of sorted rows (t, bucket, lo, hi, own, digest, ...): key, own, digests, and lists of what follows."""
    carry: list[pa.RecordBatch] = []
    last = None

    def unit() -> Iterator[tuple]:
        if sum(x.num_rows for x in carry) > 1:
            whole = pa.Table.from_batches(carry)
            digests = np.frombuffer(b"".join(whole.column(5).to_pylist()), np.uint8).reshape(whole.num_rows, -1)
            yield last, whole.column(4).to_numpy(), digests, [whole.column(i).to_pylist() for i in range(6, whole.num_columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1).astype(np.int64)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[a].tolist())
            if key != last:
                yield from unit()
                carry = []
            carry.append(batch.slice(a, b - a))
            last = key
    yield from unit()
    carry = []
    let_go()


def distances(prints: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, other rows, their distances: all pairs of one block once, or of two blocks across; 9999 where there is no pair."""
    two = own.min() != own.max()
    left, right = (np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max()))
    for a in range(0, len(left), 256):
        x, y = left[a : a + 256], right if two else right[: a + 256]
        d = np.zeros((len(x), len(y)), np.uint16)
        for plane in range(prints.shape[1]):
            d += np.bitwise_count(prints[x, plane, None] ^ prints[None, y, plane])
        if not two:
            d[y[None, :] >= x[:, None]] = 9999
        yield x, y, d


def near_first(prints: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs within the distance, of crowded rows the nearest few in either direction only; whether there are such rows."""
    pairs, above, crowded = [], [], False
    for x, y, d in distances(prints, own):
        hit = d <= most
        rows, columns = np.flatnonzero(hit.sum(axis=1) > MANY), np.flatnonzero(hit.sum(axis=0) > MANY)
        if len(rows) or len(columns):
            crowded = True
            hit[rows] = False
            hit[:, columns] = False
            if len(rows):
                hit[rows[:, None], np.argpartition(d[rows], FEW - 1, axis=1)[:, :FEW]] = True
            if len(columns):
                few = np.argpartition(d[:, columns], FEW - 1, axis=0)[:FEW]
                above.append(np.stack([np.broadcast_to(y[columns], few.shape), x[few], d[few, columns]], -1).reshape(-1, 3))
        i, j = np.nonzero(hit)
        pairs.append(np.stack([x[i], y[j]], 1))
    if above:  # the nearest few of each column, over all its blocks
        near = np.concatenate(above).astype(np.int64)
        near = near[np.lexsort((near[:, 2], near[:, 0]))]
        place = np.arange(len(near)) - np.searchsorted(near[:, 0], near[:, 0])
        pairs.append(near[place < FEW][:, :2])
    both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
    return both[:, 1], both[:, 0], crowded


def _digests(digests: np.ndarray, at: np.ndarray) -> pa.Array:
    offsets = np.arange(len(at) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(digests[at].tobytes())])


def _planes(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)


_FOUND = "a binary, b binary, t int, bucket long, lo int, hi int"


def _candidates(most: int):
    """Candidates (a, b), and the unit (t, bucket, lo, hi) wherever some were left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "t", "bucket", "lo", "hi"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        for key, own, digests, (prints,) in grouped(batches):
            row, near, crowded = near_first(_planes(prints), own, most)
            if len(row):
                yield pa.RecordBatch.from_arrays([_digests(digests, row), _digests(digests, near), *(pa.nulls(len(row), t) for t in types)], names)
            if crowded:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.array([k], t) for k, t in zip(key, types, strict=True))], names)

    return run


class Rare:
    """What is known of each row's shingles: their number, how many no other text has, and the rarest of the others in order."""

    def __init__(self, size: list[int], short: list[bool], lonely: list[int], rare: list[list[int]], rest: list[bool], similarity: float):
        self.size, self.short, self.lonely, self.share = np.array(size), np.array(short), np.array(lonely), similarity / (1 + similarity)
        self.known = [np.array(r, np.int64) for r in rare]
        # a shingle up to this place in the order that is not among the known ones is not in the text
        self.top = np.array([k[-1] if more else (1 << 63) - 1 for k, more in zip(self.known, rest, strict=True)])
        self.counts = np.zeros((len(rare), 1024), np.float32)
        keys, row = np.concatenate(self.known), np.repeat(np.arange(len(rare)), list(map(len, self.known)))
        np.add.at(self.counts, (row, (mix(keys.astype(np.uint64)) & np.uint64(1023)).astype(np.int64)), 1)

    def may_link(self, x: np.ndarray) -> np.ndarray:
        """Whether rows x may be as similar as any row. In both may be at least the known shingles that the other cannot lack."""
        a, b = self.size[x][:, None], self.size[None, :]
        both = self.counts[x] @ self.counts.T  # never less than the known shingles in common
        least = np.ceil(self.share * (a + b) - 1e-9)
        mine = np.stack([np.searchsorted(self.known[i], self.top, "right") for i in x])
        theirs = np.stack([np.searchsorted(k, self.top[x], "right") for k in self.known], 1)
        good = ((a <= b) & self.short[x][:, None]) | ((b <= a) & self.short[None, :])
        return good & (self.lonely[x][:, None] + mine - both <= a - least) & (self.lonely[None, :] + theirs - both <= b - least)


def across(prints: np.ndarray, own: np.ndarray, labels: list[bytes], most: int, rare: Rare | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the distance that have different labels. Rows of the most common label are not held against each other."""
    _, label = np.unique(np.array(labels, object), return_inverse=True)
    sizes = np.bincount(label)
    if len(sizes) == 1:
        return
    minor, two = np.flatnonzero(label != sizes.argmax()), own.min() != own.max()
    for at in range(0, len(minor), 256):
        x = minor[at : at + 256]
        d = np.zeros((len(x), len(prints)), np.uint16)
        for plane in range(prints.shape[1]):
            d += np.bitwise_count(prints[x, plane, None] ^ prints[None, :, plane])
        good = (d <= most) & (label[x][:, None] != label[None, :])
        if two:
            good &= own[x][:, None] != own[None, :]
        if rare is not None and good.any():
            good &= rare.may_link(x)
        i, j = np.nonzero(good)
        yield x[i], j


def _involved(most: int):
    """digest of each row with another within the distance whose text no verified link connects so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, digests, (prints, labels) in grouped(batches):
            found = np.zeros(len(own), bool)
            for x, y in across(_planes(prints), own, labels, most):
                found[x] = found[y] = True
            if found.any():
                yield pa.RecordBatch.from_arrays([_digests(digests, np.flatnonzero(found))], ["digest"])

    return run


def _rest(most: int, similarity: float, few: int | None = None):
    """Pairs (a, b) within the distance whose texts no verified link connects so far: all, or of each row the nearest few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own, digests, (prints, labels, *known) in grouped(batches):
            planes = _planes(prints)
            for x, y in across(planes, own, labels, most, Rare(*known, similarity)):
                if few:
                    far = sum(np.bitwise_count(planes[x, k] ^ planes[y, k]).astype(np.int64) for k in range(planes.shape[1]))
                    order = np.lexsort((far, x))
                    x, y = x[order], y[order]
                    nearest = np.arange(len(x)) - np.searchsorted(x, x) < few
                    x, y = x[nearest], y[nearest]
                a, b = np.maximum(x, y), np.minimum(x, y)  # rows are in the order of their digests
                for at in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([_digests(digests, a[at : at + 100_000]), _digests(digests, b[at : at + 100_000])], ["a", "b"])

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, shingle) for each distinct shingle of each text, and how many the text has."""
    for batch in pieces(batches, "text", most=1 << 20):
        w = Words.of(batch.column(1))
        keys, doc = shingles(w, w.hashes())
        size = np.bincount(doc, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(keys.view(np.int64)), pa.array(size[doc])], ["digest", "bucket", "size"])


def rare_prefixes(texts: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """(digest, bucket, size, short, lonely, rare, more) for a text's rarest shingles, of which texts of this similarity share one.

    Of two such texts, the smaller one with n shingles has n - ceil(2 s / (1 + s) n) + 1 rarest ones (`short`), the larger one with m
    has m - ceil(s m) + 1, and these have one in common: so many of the smaller one's shingles are in both. Shingles that no other
    text has are left out.
    """
    rows = scratch.table(texts.mapInArrow(_shingle_rows, "digest binary, bucket long, size long"), "shingles")
    often = scratch.table(rows.groupBy("bucket").agg(F.count("*").alias("often")).where("often > 1"), "often")
    order = F.shiftleft(F.least("often", F.lit((1 << 31) - 1)), 32).bitwiseOR(F.col("bucket").bitwiseAND(F.lit((1 << 32) - 1)))
    own = rows.join(often, "bucket").groupBy("digest").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct(order.alias("order"), "bucket"))).alias("all"))
    own = own.withColumn("lonely", F.col("size") - F.size("all"))
    reach = lambda share: F.greatest(F.col("size") - F.ceil(F.lit(share) * F.col("size") - 1e-9) + 1 - F.col("lonely"), F.lit(0)).cast("int")
    own = own.withColumn("taken", F.slice("all", F.lit(1), reach(similarity)))
    # of a very long text only the first of these are told to the others; the fewer are known, the less is ruled out
    told = F.slice("taken.order", F.lit(1), F.lit(TOLD))
    own = own.select("digest", "size", "lonely", told.alias("rare"), (F.size("all") > F.least(F.size("taken"), F.lit(TOLD))).alias("more"), F.posexplode("taken").alias("place", "x"), reach(2 * similarity / (1 + similarity)).alias("near"))
    return scratch.table(own.select("digest", "x.bucket", "size", (F.col("place") < F.col("near")).alias("short"), "lonely", "rare", "more"), "prefixes")


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j), j < i, that connect all sets which pairs of this similarity connect."""
    owner, size = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.array([len(x) for x in sets])
    keys = np.concatenate(sets)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    label, out = np.arange(len(sets)), []
    for i, own in enumerate(sets):
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        same = np.bincount(np.concatenate([owner[a:b] for a, b in zip(lo, hi, strict=True)]), minlength=len(sets))[:i]
        good = np.flatnonzero((same > 0) & (same >= similarity * (size[i] + size[:i] - same) - 1e-9))
        for k, j in zip(*np.unique(label[good], return_index=True), strict=True):
            out.append((i, int(good[j])))
            label[label == k] = label[i]
    return out


def _small_rows(similarity: float):
    """(bucket, digest, small) for each shingle of the prefix: two sets of this similarity have one of their least shingles in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, at = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                keys = np.frombuffer(x, np.uint64)
                first = len(keys) - math.ceil(similarity * len(keys) - 1e-9) + 1
                buckets.append(keys[:first].view(np.int64))
                at += [i] * len(buckets[-1])
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets) if buckets else np.zeros(0, np.int64)), batch.column(0).take(taken), batch.column(1).take(taken)], ["bucket", "digest", "small"])

    return run


def _small_links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, digests, (sets,) in grouped(batches):
            found = np.array(alike([np.frombuffer(x, np.uint64) for x in sets], similarity), np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_arrays([_digests(digests, found[:, 0]), _digests(digests, found[:, 1])], ["a", "b"])

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_a", "text_b"):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = []
                for name in ("text_a", "text_b"):
                    w = Words.of(part.column(part.schema.get_field_index(name)))
                    keys, doc = shingles(w, w.hashes())
                    sets.append(np.split(keys, np.searchsorted(doc, np.arange(1, part.num_rows))))
                good = []
                for x, y in zip(*sets, strict=True):
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(same >= similarity * (len(x) + len(y) - same) - 1e-9 and same > 0)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(good)) for i in (0, 1)], ["a", "b"])

    return run


def _bitmap(wanted: DataFrame) -> Broadcast:
    """The first bits of the wanted digests: a bitmap of 16 MB, whatever their number."""
    at = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - FILTER_BITS) + 1  # Spark numbers bits from 1
    parts = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bitmap = bytearray(1 << (FILTER_BITS - 3))
    for r in parts.collect():  # 4096 parts of 4 kB at most
        begin = (r["part"] - 1) * 4096
        bitmap[begin : begin + 4096] = r["bits"]
    return wanted.sparkSession.sparkContext.broadcast(bytes(bitmap))


def _wanted(bitmap: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in pieces(batches, "text"):
            data, offs = text_buffers(batch.column(1))
            digests = [hashlib.sha256(data[a:b]).digest()[:16] for a, b in zip(offs[:-1], offs[1:], strict=True)]
            at = np.frombuffer(b"".join(digests), ">u4")[::4].astype(np.int64) >> (32 - FILTER_BITS)
            keep = pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(digests, pa.binary()).filter(keep), batch.column(1).filter(keep)], ["doc_id", "digest", "text"])

    return run


def digest(text: str = "text") -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _bodies(rows: DataFrame, texts: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """digest and text of the nodes (digest), each once. Only these texts are moved: a bitmap of fixed size lets few others through."""
    wanted = scratch.table(texts.select("digest", "doc_id").join(nodes, "digest"), f"wanted-{name}")
    rough = rows.mapInArrow(_wanted(_bitmap(wanted)), "doc_id long, digest binary, text string").withColumn("id", F.coalesce("doc_id", F.lit(FIRST_ID)))
    keys = wanted.select("digest", F.coalesce("doc_id", F.lit(FIRST_ID)).alias("id"))
    return scratch.table(rough.join(keys, ["digest", "id"], "left_semi").select("digest", "id", "text").dropDuplicates(["digest", "id"]).select("digest", "text"), f"bodies-{name}")


def _links(rows: DataFrame, texts: DataFrame, pairs: DataFrame, scratch: Scratch, similarity: float, name: str) -> DataFrame:
    """Those of pairs (a, b) whose texts are as similar, by the texts themselves."""
    body = _bodies(rows, texts, pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct(), scratch, name)
    left = pairs.join(body.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(body.select(F.col("digest").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    links = scratch.table(both.mapInArrow(_verified(similarity), "a binary, b binary"), f"links-{name}")
    scratch.drop(f"bodies-{name}", f"wanted-{name}")
    return links


def _classes(docs: DataFrame, scratch: Scratch, similarity: float, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id and digest of each row; digest and class of each text; class, class_id, n_class and the representative's digest of each class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    reach = math.floor(SMALL / similarity + 1e-9)  # shingles of a text that is as similar to a small one, at most
    prints = scratch.table(rows.mapInArrow(lambda x: _prints(x, reach), "doc_id long, digest binary, n_shingles long, print binary, small binary"), "prints")
    texts = scratch.table(prints.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"), F.max("print").alias("print"), F.max("small").alias("small")), "texts")
    bits, tables = plan(texts.count())
    most = math.floor(BITS * (1 - agreement(similarity - SLACK)))
    sampled = texts.where(F.col("n_shingles") > SMALL).select("digest", "print").mapInArrow(_rows(tables), "t int, key long, digest binary, print binary")
    sampled = units(sampled.withColumn("bucket", F.shiftright("key", SAMPLED - bits)), scratch, cap)
    unit = ["t", "bucket", "lo", "hi"]
    # few bytes are much work here, so small partitions are not put together
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, *more: df.select(*unit, "own", "digest", *more).repartition(parts, *unit).sortWithinPartitions(*unit, "digest")
    found = scratch.table(dealt(sampled, "print").mapInArrow(_candidates(most), _FOUND), "found")
    pairs = scratch.table(found.where("a is not null").select("a", "b").distinct(), "pairs")
    links = _links(rows, texts, pairs, scratch, similarity, "first")
    crowded = found.where("a is null").select(*unit)
    if not crowded.isEmpty():
        def labelled(links: DataFrame, name: str) -> DataFrame:
            found = scratch.table(star_components(links, scratch.table, scratch.drop), f"labels-{name}").withColumnRenamed("id", "digest")
            return scratch.table(texts.select("digest", "print").join(found, "digest", "left").select("digest", "print", F.coalesce("label", "digest").alias("label")), f"labelled-{name}")

        labels = labelled(links, "first")
        again = sampled.drop("print").join(crowded, unit, "left_semi").join(labels, "digest")
        involved = scratch.table(dealt(again, "print", "label").mapInArrow(_involved(most), "digest binary").distinct(), "involved")
        # which of them may be linked at all is left to their rarest shingles, exactly; each one's nearest come first
        prefixes = rare_prefixes(_bodies(rows, texts, involved, scratch, "involved"), scratch, similarity)
        for name, few in (("nearest", FEW), ("second", None)):
            known = prefixes.join(labels, "digest").withColumn("t", F.lit(-2))
            mixed = known.groupBy("bucket").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.max("short").alias("short")).where("short and one <> other").select("bucket")
            cut = units(scratch.table(known.join(mixed, "bucket", "left_semi"), f"mixed-{name}"), scratch, cap, f"large-{name}")
            rest = dealt(cut, "print", "label", "size", "short", "lonely", "rare", "more").mapInArrow(_rest(most, similarity, few), "a binary, b binary").distinct().join(pairs, ["a", "b"], "left_anti")
            rest = scratch.table(rest, f"rest-{name}")
            links, pairs = links.union(_links(rows, texts, rest, scratch, similarity, name)), pairs.union(rest)
            if few:
                labels = labelled(links, name)
    short = texts.where("small is not null").select("digest", "small").mapInArrow(_small_rows(similarity), "bucket long, digest binary, small binary").withColumn("t", F.lit(-1))
    short = units(short, scratch, cap, "large-small")
    links = links.union(scratch.table(dealt(short, "small").mapInArrow(_small_links(similarity), "a binary, b binary"), "links-small"))
    labels = scratch.table(star_components(links, scratch.table, scratch.drop), "labels")
    classes = scratch.table(texts.join(labels, texts["digest"] == labels["id"], "left").select("digest", "doc_id", "n", F.coalesce("label", "digest").alias("class")), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    least = scratch.table(classes.groupBy("class").agg(first, F.sum("n").alias("n_class")).select("class", F.col("first.doc_id").alias("class_id"), "n_class", F.col("first.digest").alias("digest")), "least")
    return prints.select("doc_id", "digest"), classes.select("digest", "class"), least


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, cap: int = CAP) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_class (rows of the class) for each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, classes, least = _classes(docs, scratch, similarity, cap)
    named = scratch.table(classes.join(least.drop("digest"), "class").select("digest", "class_id", "n_class"), "named")
    return rows.join(named, "digest").select("doc_id", "class_id", "n_class")


def representatives(docs: DataFrame, similarity: float = SIMILARITY, cap: int = CAP) -> DataFrame:
    """One row of docs, with all its columns, for each class: that with the least doc_id."""
    _, _, least = _classes(docs, Scratch(docs.sparkSession, "simhash"), similarity, cap)
    id_, key, place = fresh(docs.columns, "id", "digest", "place")
    keys = least.select(F.coalesce("class_id", F.lit(FIRST_ID)).alias(id_), F.col("digest").alias(key))
    kept = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)), key: digest()}).join(keys, [id_, key], "left_semi")
    first = F.row_number().over(Window.partitionBy(id_, key).orderBy(F.lit(0)))
    return kept.withColumn(place, first).where(F.col(place) == 1).select(*docs.columns)
