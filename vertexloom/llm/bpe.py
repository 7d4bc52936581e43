"""Byte-pair encoding and decoding by a walk over a trie of the distinct words.

For a vocabulary whose merges are ranked by id, the encoding of a prefix of a word is that of a shorter prefix and one last
token. So each node of a trie of words needs only its last token: the longest token that ends at the node and may follow the
last token of the node where it begins. Two tokens may stand side by side if no merge across their border comes before the
merges that built them. A depth-first walk over the sorted distinct words computes each shared prefix once.

Results, by case: a null or empty text has no tokens and decodes to the empty text; the strings of special tokens in a text are
those tokens; repeated rows are encoded alike; a table without rows gives none; an input column that has the name of an output
column is replaced by it; bytes that are no UTF-8 decode to the replacement character.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vertexloom.llm.textops import pieces
from vertexloom.llm.workers import claim

#: Words that a worker remembers with their encodings, each of so many bytes at most.
REMEMBERED, REMEMBERED_BYTES = 150_000, 64
#: The word pattern with the letters, numbers and white space of Latin-1 spelt out, since `re` is faster than `regex`.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r\x20\x85\xa0"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_models: dict[str, TrieBPE] = {}
_tables: dict[str, np.ndarray] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id of a vocabulary file; those of special tokens are their strings."""
    vocab, letters = spec["model"]["vocab"], byte_alphabet()
    out = [b""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
    for t, i in vocab.items():
        out[i] = bytes(letters[c] for c in t)
    for a in spec["added_tokens"]:
        out[a["id"]] = a["content"].encode()
    return out


class TrieBPE:
    """A byte-level vocabulary file of the tokenizers library, with ids in the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        self.path, self.bytes = path, token_bytes(spec)
        size = len(self.bytes)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.ids = {self.bytes[i]: i for i in vocab.values()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * size
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole = vocab[a + b]
            self.pairs[vocab[a], vocab[b]] = whole
            self.halves[whole] = (vocab[a], vocab[b])
            if whole <= max(vocab[a], vocab[b]):
                raise ValueError("the ids of this vocabulary are not in the order of its merges")
        self._automaton()
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = letters
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _automaton(self) -> None:
        """States are prefixes of tokens. ends has for each state the tokens, longest first, that end where it is reached."""
        self.edges: dict[int, int] = {}  # state << 8 | byte: the longer prefix
        own: list[int] = [-1]
        for token, i in self.ids.items():
            at = 0
            for byte in token:
                key = at << 8 | byte
                if (to := self.edges.get(key)) is None:
                    to = self.edges[key] = len(own)
                    own.append(-1)
                at = to
            own[at] = i
        self.fail, self.ends = [0] * len(own), [()] * len(own)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.edges.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        level = [(0, 0)]
        while level:
            below = []
            for at, back in level:
                for byte, to in children.get(at, ()):
                    f = self._step(back, byte) if at else 0
                    self.fail[to] = f
                    here = ((own[to], len(self.bytes[own[to]])),) if own[to] >= 0 else ()
                    self.ends[to] = here + self.ends[f]
                    below.append((to, f))
            level = below
        self.moves = dict(self.edges)

    def _step(self, state: int, byte: int) -> int:
        while (to := self.edges.get(state << 8 | byte)) is None and state:
            state = self.fail[state]
        return to or 0

    def apart(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when their bytes are encoded together."""
        # a and b: the pieces beside the border, from the last merge back; each exists until the piece around it is merged
        a, b, until_a, until_b = left, right, len(self.bytes), len(self.bytes)
        while True:
            whole = self.pairs.get((a, b))
            if whole is not None and whole < until_a and whole <= until_b:
                return False
            undo_a = self.halves[a] is not None and (a >= b or self.halves[b] is None)
            if undo_a:
                until_a, a = a, self.halves[a][1]
            elif self.halves[b] is not None:
                until_b, b = b, self.halves[b][0]
            else:
                return True

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Distinct words with their encodings, in sorted order: a depth-first walk of their trie whose path is kept in lists."""
        last, size, state, before = [-1], [0], [0], b""  # by depth: the last token of the prefix, its length, the automaton's state
        ends, fits, moves, step, apart = self.ends, self.fits, self.moves, self._step, self.apart
        if len(fits) > 1 << 17:
            fits.clear()
        if len(moves) > len(self.edges) + (1 << 17):
            moves = self.moves = dict(self.edges)
        for word in sorted(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], size[same + 1 :], state[same + 1 :]
            at, end = state[-1], same
            for byte in word[same:]:
                end += 1
                key = at << 8 | byte
                if (to := moves.get(key)) is None:
                    to = moves[key] = step(at, byte)
                at = to
                for token, n in ends[at]:
                    if n == end:
                        break
                    pair = last[end - n] << 20 | token
                    if (ok := fits.get(pair)) is None:
                        ok = fits[pair] = apart(last[end - n], token)
                    if ok:
                        break
                last.append(token)
                size.append(n)
                state.append(at)
            out, at = [], len(word)
            while at:
                out.append(last[at])
                at -= size[at]
            out.reverse()
            before = word
            yield word, out

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens. The library splits what may depend on a newer Unicode table."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            letters = self.letters
            return [bytes(letters[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as packed 32-bit integers."""
        parts: list[list[list[str] | int]] = []
        for text in texts:
            if self.cuts is None or "<|" not in text:
                parts.append([self.split(text)])
            else:
                parts.append([self.special.get(x) if x in self.special else self.split(x) for x in self.cuts.split(text) if x])
        known, found, new = self.known, [], set()
        for doc in parts:
            for part in doc:
                if isinstance(part, list):
                    got = list(map(known.get, part))
                    if None in got:
                        new.update(w for w, g in zip(part, got, strict=True) if g is None)
                    found.append(got)
        if len(known) + len(new) > REMEMBERED and len(new) * 3 > sum(map(len, found)):
            known = self.known = {}  # what comes now differs from what was kept
        rare: dict[str, bytes] = {}
        for word, ids in self.walk([w.encode() for w in new]):
            keep = known if len(known) < REMEMBERED and len(word) <= REMEMBERED_BYTES else rare
            keep[word.decode()] = rare[word.decode()] = array("i", ids).tobytes()
        out, fetch = [], iter(found)
        for doc in parts:
            packed = []
            for part in doc:
                if isinstance(part, int):
                    packed.append(array("i", [part]).tobytes())
                else:
                    got = next(fetch)
                    packed.append(b"".join(got) if None not in got else b"".join([g if g is not None else rare[w] for w, g in zip(part, got, strict=True)]))
            out.append(packed[0] if len(packed) == 1 else b"".join(packed))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def model(path: str) -> TrieBPE:
    if path not in _models:
        _models[path] = TrieBPE(path)
    return _models[path]


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name.lower() != name.lower()), T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], [*(batch.schema.names[i] for i in kept), name])


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _models.clear)
        bpe = model(vocabulary)
        gc.freeze()  # the tables of the model and the remembered words hold no cycles, so collecting need not visit them
        for batch in pieces(batches, text):
            packed = bpe.encode([x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()])
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            yield _with(batch, ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32))))

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with a column of the text that the ids stand for; special tokens are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe-decode", _tables.clear)
        if vocabulary not in _tables:
            with open(vocabulary, encoding="utf-8") as f:
                _tables[vocabulary] = np.array(token_bytes(json.load(f)), object)
        table = _tables[vocabulary]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                column = part.column(part.schema.get_field_index(ids))
                column = column.fill_null([]) if column.null_count else column
                offs = column.offsets.to_numpy()
                tokens = table[column.values.to_numpy()[offs[0] : offs[-1]]].tolist()
                texts = [b"".join(tokens[a:b]).decode("utf-8", "replace") for a, b in zip(offs[:-1] - offs[0], offs[1:] - offs[0], strict=True)]
                yield _with(part, decoded, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema(df, decoded, T.StringType()))


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with ids instead of the text, and with what these ids decode to: encode and decode in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _models.clear)
        bpe = model(vocabulary)
        gc.freeze()
        table = np.array(bpe.bytes, object)
        for batch in pieces(batches, text, most=2 << 20):
            at = batch.schema.get_field_index(text)
            packed = bpe.encode([x or "" for x in batch.column(at).to_pylist()])
            found = [np.frombuffer(p, np.int32) for p in packed]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            texts = [b"".join(table[x].tolist()).decode("utf-8", "replace") for x in found]
            rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], [n for i, n in enumerate(batch.schema.names) if i != at])
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield _with(_with(rest, ids, values), decoded, pa.array(texts, pa.string()))

    kept = T.StructType([f for f in df.schema.fields if f.name.lower() not in (text.lower(), ids.lower(), decoded.lower())])
    return df.mapInArrow(run, T.StructType([*kept.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]))
