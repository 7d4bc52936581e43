"""Token ids in binary shards, compressed by a grammar (Re-Pair in rounds).

Documents are sorted by doc_id over the cluster, encoded, and written in blocks of about two million ids. In a block, rounds replace
the most frequent pairs of symbols by new symbols: each counts all pairs exactly and takes those that are at least a sixteenth as
frequent as the most frequent one. Where two of them overlap the more frequent one wins; in a run of equal symbols every second place
is replaced. It ends when no pair occurs 16 times any more, or when ids and new symbols fill 16 bits. No symbol crosses the end of a
document.

A block holds, little-endian: b"RPG1", the numbers of documents, rules and symbols (uint32), the ids of documents (int64, with a bit
map of nulls), where each begins in ids and in symbols (uint32), the rules as pairs (uint16), how many ids each expands to (uint32),
and the symbols (uint16). So a document, or a range of ids in it, is decoded without the rest: lengths of expansions find the symbols
that it needs, and rules expand those alone. Blocks are rows of a Parquet table, as Spark's writers reach every store.

Results, by case: a null or empty text is the end id alone; null ids come first; repeated rows and ties of doc_id stand side by side,
in the order of a hash of the text; a text of any length is one document, and makes its block longer; a table without rows gives no blocks; extra columns are
left out.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.llm.scratch import Scratch
from vertexloom.llm.textops import Words, mix, pieces, text_buffers
from vertexloom.llm.workers import claim

END_ID, BLOCK_IDS = 1, 2_000_000
#: The least count of a pair that is replaced; a round takes the pairs that are at least a FACTOR-th as frequent as the most frequent.
LEAST, FACTOR = 16, 16
#: Words that a worker remembers with their ids, each of so many bytes at most.
REMEMBERED, REMEMBERED_BYTES = 700_000, 64
MAGIC = b"RPG1"

SPACE, LETTER, NUMBER, OTHER = range(4)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of single bytes, of the characters of two bytes after 0xC2 and 0xC3, and lower case of bytes; all of lower-case text."""
    one, two, lower = np.full(256, OTHER, np.uint8), np.full((2, 64), OTHER, np.uint8), np.arange(256, dtype=np.uint8)
    one[[9, 10, 11, 12, 13, 32]] = SPACE
    one[97:123], one[48:58] = LETTER, NUMBER
    lower[65:91] += 32
    for cp in range(0x80, 0x100):
        kind = SPACE if cp in (0x85, 0xA0) else NUMBER if cp in (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE) else LETTER if cp in (0xAA, 0xB5, 0xBA) or cp >= 0xDF and cp != 0xF7 else OTHER
        two[(cp >> 6) - 2, cp & 63] = kind
    return one, two, lower


_ONE, _TWO, _LOWER = _classes()


class LatinWords(Words):
    """The words of Latin-1 texts as the word vocabulary splits them, over lower-cased bytes. Texts in `whole` have none."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray):
        n = len(data)
        low = np.zeros(n + 4, np.uint8)
        np.take(_LOWER, data, out=low[:n])
        kind = _ONE[low[:n]]
        lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
        after = low[lead + 1]
        upper = (data[lead] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        low[lead[upper] + 1] += 32
        kind[lead] = kind[np.minimum(lead + 1, n - 1)] = _TWO[data[lead] - 0xC2, low[lead + 1] & 63]
        for d in whole:
            kind[offsets[d] : offsets[d + 1]] = SPACE
        start = kind != SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | ((kind[1:] == NUMBER) & ((data[1:] & 0xC0) != 0x80))
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[begins] = kind[begins] != SPACE
        # 's 't 'm 'd 're 've 'll where a run of signs begins
        p = np.flatnonzero(start & (low[:n] == 39))
        end = offsets[np.searchsorted(offsets, p, "right")]
        x, y = low[p + 1], low[p + 2]
        short = (p + 1 < end) & np.isin(x, np.frombuffer(b"stmd", np.uint8))
        long_ = (p + 2 < end) & (((y == ord("e")) & ((x == ord("r")) | (x == ord("v")))) | ((x == ord("l")) & (y == ord("l"))))
        for at, length in ((p[short], 2), (p[long_], 3)):
            start[at + 1] = False
            rest = at + length
            rest = rest[rest < end[short if length == 2 else long_]]
            start[rest[kind[rest] == LETTER]] = True
        edge = np.flatnonzero(start | (kind == SPACE))
        own = start[edge]
        self.data, self.offsets = low, offsets
        self.starts, self.ends = edge[own], np.r_[edge[1:], n][own]
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)


class Remembered:
    """Words by 64-bit hash, in open addressing, with where their ids are in one pool. Lengths and end bytes are compared, too."""

    def __init__(self, most: int):
        self.most = most
        self.mask = np.uint64((1 << (3 * most).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)
        self.n, self.begin, self.size, self.check = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def find(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out, todo, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys & self.mask
        while len(todo):
            here = self.keys[slot]
            hit = here == keys[todo]
            out[todo[hit]] = self.place[slot[hit]]
            go = ~hit & (here != 0)
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & self.mask
        if self.n:
            out[(out >= 0) & (self.check[out] != check)] = -1
        return out

    def add(self, keys: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Distinct words that find() does not know."""
        if self.n + len(keys) > self.most:
            self.clear()
        if len(keys) > self.most:
            return
        begin = np.cumsum(size) - size + len(self.pool)
        self.begin, self.size, self.check, self.pool = np.r_[self.begin, begin], np.r_[self.size, size], np.r_[self.check, check], np.r_[self.pool, ids]
        todo, slot = np.arange(len(keys)), keys & self.mask
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            won = free & (self.keys[slot] == keys[todo])
            self.place[slot[won]] = todo[won] + self.n
            todo, slot = todo[~won], (slot[~won] + np.uint64(1)) & self.mask
        self.n += len(keys)


class WordTokenizer:
    """The tokenizers library, asked once for each word that a worker remembers; all else is done for a whole batch at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        # for words that are normal and apart already, only their bytes and merges are left to do
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.plain.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.known = Remembered(REMEMBERED)
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in self.plain.get_vocab().items() if t.endswith("</w>")]] = True

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has. Many are encoded as one text: the last id of a word ends it."""
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            found = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            size = np.diff(np.r_[0, np.flatnonzero(self.ends[found]) + 1])
            if len(size) != len(part):
                one = [self.library.encode(w, add_special_tokens=False).ids for w in part]
                found, size = np.array([i for x in one for i in x], np.uint16), np.array([len(x) for x in one])
            ids.append(found)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has. Texts beyond Latin-1 go to the library whole."""
        data, offs = text_buffers(column)
        base = int(offs[0])
        data, offs = data[base : int(offs[-1])], offs - base
        odd = data >= 0xC4
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        whole = np.unique(np.searchsorted(offs, np.flatnonzero(odd), "right") - 1)
        w = LatinWords(data, offs, whole)
        keys = w.hashes()
        keys[keys == 0] = 1
        check = (w.ends - w.starts) << 16 | w.data[w.starts].astype(np.int64) << 8 | w.data[w.ends - 1]
        number = self.known.find(keys, check)
        new = np.flatnonzero(number < 0)
        known = self.known
        begin, size, pool = known.begin, known.size, known.pool
        if len(new):
            _, first, inverse = np.unique(keys[new] ^ mix(check[new].astype(np.uint64)), return_index=True, return_inverse=True)
            at = new[first]
            text = w.data.tobytes()
            ids, sizes = self.words([text[a:b].decode() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
            number[new] = len(size) + inverse
            begin, size, pool = np.r_[begin, len(pool) + np.cumsum(sizes) - sizes], np.r_[size, sizes], np.r_[pool, ids]
            keep = (w.ends[at] - w.starts[at] <= REMEMBERED_BYTES) & (known.find(keys[at], check[at]) < 0)
            keep &= np.r_[True, np.diff(np.sort(keys[at])) > 0].all()  # two words with one hash: remember none of these
            known.add(keys[at][keep], check[at][keep], sizes[keep], ids[np.repeat(keep, sizes)])
        own = size[number]
        flat = pool[np.repeat(begin[number] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        counts = np.diff(np.r_[0, np.cumsum(own)][w.first])
        others = {int(d): self.library.encode(data[offs[d] : offs[d + 1]].tobytes().decode(), add_special_tokens=False).ids for d in whole}
        inside = counts.copy()
        counts[list(others)] = [len(x) for x in others.values()]
        counts += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.uint16)
        out[ends - 1] = end_id
        out[np.repeat(ends - counts - (np.cumsum(inside) - inside), inside) + np.arange(len(flat))] = flat
        for d, ids in others.items():
            out[ends[d] - counts[d] : ends[d] - 1] = ids
        return out, counts


#: Spreads pairs over slots; and no pair of symbols: rounds end before the symbol 0xFFFF could be in one.
_SPREAD, _NO_PAIR = np.uint32(0x9E3779B1), np.uint32(0xFFFFFFFF)


class Pairs:
    """The numbers of distinct pairs, each a number of 32 bits, in open addressing."""

    def __init__(self, pairs: np.ndarray):
        bits = max(12, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.keys, self.number, self.used = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, bool)
        todo, slot = np.arange(len(pairs)), pairs * _SPREAD >> self.shift
        while len(todo):
            free = ~self.used[slot]
            self.keys[slot[free]] = pairs[todo[free]]
            won = free & (self.keys[slot] == pairs[todo])
            self.used[slot[won]], self.number[slot[won]] = True, todo[won]
            todo, slot = todo[~won], (slot[~won] + np.uint32(1)) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in keys these pairs are, in ascending order, and their numbers."""
        slot = keys * _SPREAD >> self.shift
        at = np.flatnonzero(self.used[slot])
        own, slot = keys[at], slot[at]
        rest = np.flatnonzero(self.keys[slot] != own)
        while len(rest):
            slot[rest] = next_ = (slot[rest] + np.uint32(1)) & self.mask
            rest = rest[self.used[next_] & (self.keys[next_] != own[rest])]
        hit = self.used[slot] & (self.keys[slot] == own)
        return at[hit], self.number[slot[hit]]


def repair(ids: np.ndarray, ends: np.ndarray, first_new: int, least: int = LEAST, factor: int = FACTOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and where each document ends in the symbols. ends: where documents end in ids; least: 2 or more."""
    seq = ids.astype(np.uint16)
    rules, made = [np.zeros(0, np.uint32)], 0
    while (room := (1 << 16) - first_new - made) > 0 and len(seq) - len(ends) >= least:
        key = seq[:-1].astype(np.uint32)
        key <<= np.uint32(16)
        key |= seq[1:]
        key[ends[:-1] - 1] = _NO_PAIR
        inside = np.sort(key)[: len(seq) - len(ends)]
        # a pair that is there `least` times or more equals what comes least - 1 places later; so these lie in one run for each pair
        again = np.zeros(len(inside) - least + 3, bool)
        np.equal(inside[least - 1 :], inside[: len(inside) - least + 1], out=again[1:-1])
        edge = np.flatnonzero(again[1:] != again[:-1])
        begin, count = edge[::2], edge[1::2] - edge[::2] + least - 1
        if not len(begin):
            break
        often = np.flatnonzero(count >= -(-int(count.max()) // factor))
        often = often[np.argsort(-count[often], kind="stable")][:room]
        pairs = inside[begin[often]]
        at, rank = Pairs(pairs).find(key)
        # of overlapping places that with the more frequent pair is replaced; in a run of equal symbols every second one
        beside = at[1:] == at[:-1] + 1
        begin = np.flatnonzero(np.r_[True, ~(beside & (rank[1:] == rank[:-1]))])
        take = (np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))) & 1 == 0
        take[1:] &= ~(beside & (rank[:-1] < rank[1:]))
        take[:-1] &= ~(beside & (rank[1:] < rank[:-1]))
        at, rank = at[take], rank[take]
        # a pair that has lost most of its places to others waits for a later round; the most frequent one always has half of them
        good = np.bincount(rank, minlength=len(pairs)) >= -(-least // 2)
        use = good[rank]
        at, rank = at[use], rank[use]
        seq[at] = (first_new + made + np.cumsum(good) - 1)[rank].astype(np.uint16)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, ends = seq[stay], ends - np.searchsorted(at, ends - 1)
        rules.append(pairs[good])
        made += int(good.sum())
    table = np.concatenate(rules)
    return seq, np.stack([table >> np.uint32(16), table & np.uint32(0xFFFF)], 1).astype(np.uint16).reshape(-1, 2), ends


def lengths_of(rules: np.ndarray, first_new: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out = np.ones(first_new + len(rules), np.uint32)
    # a rule of one round uses symbols of earlier rounds alone, but rounds are not marked: settle until nothing changes
    while len(rules):
        new = out[rules[:, 0]] + out[rules[:, 1]]
        if np.array_equal(new, out[first_new:]):
            break
        out[first_new:] = new
    return out[first_new:]


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, first_new: int) -> bytes:
    """A block. counts: the number of ids of each document, 1 at least."""
    ends = np.cumsum(counts)
    symbols, rules, symbol_ends = repair(ids, ends, first_new)
    nulls = np.packbits([d is None for d in doc_ids], bitorder="little")
    return b"".join([
        MAGIC, struct.pack("<IIII", len(doc_ids), len(rules), len(symbols), first_new),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(),
        np.r_[0, ends].astype("<u4").tobytes(), np.r_[0, symbol_ends].astype("<u4").tobytes(),
        rules.astype("<u2").tobytes(), lengths_of(rules, first_new).astype("<u4").tobytes(), symbols.astype("<u2").tobytes(),
    ])


class Block:
    """A block, opened: any document or range of ids without decoding the rest."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a block of ids")
        docs, rules, symbols, self.first_new = struct.unpack_from("<IIII", blob, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        ids = take("<i8", docs)
        nulls = np.unpackbits(take("u1", -(-docs // 8)), bitorder="little")[:docs]
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, nulls, strict=True)]
        self.starts, self.symbol_starts = take("<u4", docs + 1).astype(np.int64), take("<u4", docs + 1).astype(np.int64)
        self.rules, self.lengths = take("<u2", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take("<u2", symbols)

    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All expansions side by side, and where that of each symbol begins and how long it is."""
        n = self.first_new
        length = np.r_[np.ones(n, np.int64), self.lengths.astype(np.int64)]
        at = np.cumsum(length) - length
        flat = np.zeros(int(length.sum()), np.uint16)
        flat[:n] = np.arange(n)
        a, b = self.rules[:, 0].astype(np.int64), self.rules[:, 1].astype(np.int64)
        todo, ready = np.arange(len(a)), np.r_[np.ones(n, bool), np.zeros(len(a), bool)]
        while len(todo):
            can = ready[a[todo]] & ready[b[todo]]
            now = todo[can]
            for part, shift in ((a[now], 0), (b[now], length[a[now]])):
                m = length[part]
                inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                flat[np.repeat(at[n + now] + shift, m) + inner] = flat[np.repeat(at[part], m) + inner]
            ready[n + now] = True
            todo = todo[~can]
        return flat, at, length

    def ids(self) -> np.ndarray:
        """The ids of all documents."""
        flat, at, length = self._flat()
        m = length[self.symbols]
        ends = np.cumsum(m)
        return flat[np.repeat(at[self.symbols] - (ends - m), m) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def document(self, i: int, begin: int = 0, end: int | None = None) -> list[int]:
        """Ids begin to end of document i; only the symbols that hold them are expanded."""
        part = self.symbols[self.symbol_starts[i] : self.symbol_starts[i + 1]].astype(np.int64)
        length = np.r_[np.ones(self.first_new, np.int64), self.lengths.astype(np.int64)]
        ends = np.cumsum(length[part])
        end = int(ends[-1]) if end is None else min(end, int(ends[-1]))
        if begin >= end:
            return []
        a, b = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, end, "left"))
        out, skip = [], begin - int(ends[a] - length[part[a]])
        stack = part[a : b + 1].tolist()[::-1]
        while stack:
            s = stack.pop()
            if s < self.first_new:
                out.append(s)
            else:
                x, y = self.rules[s - self.first_new]
                stack += [int(y), int(x)]
        return out[skip : skip + end - begin]


_tokenizers: dict[str, WordTokenizer] = {}
_BLOCK = "part int, block int, n_docs long, n_ids long, bytes binary"


def write(docs: DataFrame, scratch: Scratch, vocabulary: str, block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> DataFrame:
    """The table of blocks of docs (doc_id, text), in ascending order of doc_id by part and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token-files", _tokenizers.clear)
        if vocabulary not in _tokenizers:
            _tokenizers[vocabulary] = WordTokenizer(vocabulary)
        tokenizer = _tokenizers[vocabulary]
        gc.freeze()
        part, block, held = TaskContext.get().partitionId(), 0, 0
        waiting: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            names = [x for w in waiting for x in w[0]]
            counts, ids = (np.concatenate([w[k] for w in waiting]) for k in (1, 2))
            blob = pack(names, counts, ids, tokenizer.size)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(names)]), pa.array([len(ids)]), pa.array([blob], pa.binary())], ["part", "block", "n_docs", "n_ids", "bytes"])

        for batch in pieces(batches, "text"):
            names = batch.column(0).to_pylist()
            ids, counts = tokenizer.encode(batch.column(1), end_id)
            ends, at = np.cumsum(counts), 0
            while at < len(names):
                before = int(ends[at] - counts[at])
                to = min(len(names), int(np.searchsorted(ends, before + block_ids - held)) + 1)  # to the document that fills the block
                waiting.append((names[at:to], counts[at:to], ids[before : ends[to - 1]]))
                held, at = held + int(ends[to - 1]) - before, to
                if held >= block_ids:
                    yield flush()
                    block, held = block + 1, 0
        if waiting:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that share one doc_id (null, say) are spread by a hash of the text
    ordered = rows.withColumn("spread", F.xxhash64("text")).repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text").drop("spread")
    return scratch.table(ordered.mapInArrow(run, _BLOCK), "blocks")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the blocks."""
    spark = blocks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                b = Block(blob)
                ids = memoryview(b.ids().astype("<u4")).cast("B")
                n = len(b.doc_ids)
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(b.starts[:-1].tolist(), b.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(b.doc_ids, pa.int64()), pa.array(b.starts[:-1]), pa.array(np.diff(b.starts)), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "inner", "n_tokens", "ids_crc32"])

    # one number for each task that wrote; blocks of one part are added up on the cluster
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, base = 0, []
    for r in sizes:
        base.append((r["part"], before))
        before += r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("skip")).join(bases, "part").select("part", "block", (F.col("base") + F.col("skip")).alias("origin"))
    docs = blocks.select("part", "block", "bytes").mapInArrow(run, "part int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "block"]).select("doc_id", (F.col("origin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
