"""Language identification by a blended-spectrum string kernel.

The kernel of two texts is the number of distinct character 1-, 2- and 3-grams that both have, over the root of the product of their
own numbers. Landmarks (Nystroem) are texts of the training sample; one-versus-rest kernel ridge regression on the landmark features
learns a weight vector for each language. A batch is scored with one product: the texts' gram indicators by the landmarks' indicators
by the weights; the latter two are multiplied once, so what is left is a sparse matrix by a matrix of grams by languages.

Characters are lower-cased and mapped to 47 classes (letters of the Latin alphabet by themselves, others by a hash), so all grams fit a table.

Results, by case: a text that is null, empty or has no letter is `und` with score 0; a text of any length is read whole; ties go to
the first language in alphabetical order; repeated rows get the same result; a table without rows gives none; extra columns are left
out; rows with a null lang are not learnt from; if nothing can be learnt every text is `und`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.textops import pieces
from vertexloom.llm.workers import alone

#: Texts to learn from for each language at most, about; landmarks in all; the ridge.
PER_LANGUAGE, LANDMARKS, RIDGE = 500, 400, 1e-3
SHARPNESS, LEAST_SCORE = 4.0, 0.3
CLASSES = 48
GRAMS = CLASSES + CLASSES**2 + CLASSES**3
_ACCENTED = "àâáäæçèéêëìíîïñòóôöœùúûüÿß"
_LETTER = regex.compile(r"\p{L}")


def _classes() -> np.ndarray:
    """A class for each code point below 65536: 0 no letter, 1 to 26 Latin letters, others by a hash."""
    table = np.zeros(1 << 16, np.int32)
    for cp in range(1 << 16):
        c = chr(cp).lower()
        if len(c) == 1 and "a" <= c <= "z":
            table[cp] = ord(c) - 96
        elif c.isalpha():
            table[cp] = 27 + (_ACCENTED.index(c) % 20 if c in _ACCENTED else zlib.crc32(c.encode()) % 20)
    return table


_table: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """The distinct grams of a whole text; runs of other characters count as one gap."""
    if not _table:
        _table.append(_classes())
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _table[0][np.minimum(code, 65535)]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] > 0) | (x[:-1] > 0)
    x = x[keep]
    seen = np.zeros(GRAMS, bool)
    seen[x] = True
    if len(x) > 1:
        two = x[:-1] * CLASSES + x[1:]
        seen[CLASSES + two] = True
        if len(x) > 2:
            seen[CLASSES + CLASSES**2 + two[:-1] * CLASSES + x[2:]] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # of each gram for each language
    bias: np.ndarray


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in pieces(batches, "text"):
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = [grams(t or "").astype(np.int32) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("lang")), batch.column(batch.schema.get_field_index("place")), pa.array(found, pa.list_(pa.int32()))], ["lang", "place", "grams"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """docs: doc_id, text, lang. Learns from about `per_language` texts of each language, by a hash, of rows not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return Model([], np.zeros((GRAMS, 0), np.float32), np.zeros(0))
    # the text is hashed, too: rows that share a doc_id are taken or left one by one
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30))
    share = F.element_at(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, per_language / n)))))), F.col("lang"))
    chosen = known.select("lang", place.alias("place"), "text", share.alias("share")).where("place < share").select("lang", "place", "text")
    rows = chosen.mapInArrow(_sample, "lang string, place long, grams array<int>").toPandas()
    rows = rows.sort_values(["place", "lang"], kind="stable").reset_index(drop=True)
    rows = rows[rows["grams"].map(len) > 0].reset_index(drop=True)
    languages = sorted(set(rows["lang"]))
    if len(languages) < 2:
        return Model(languages, np.zeros((GRAMS, len(languages)), np.float32), np.ones(len(languages)))
    # landmarks in turn from each language
    turn = rows.groupby("lang").cumcount().to_numpy()
    order = np.lexsort((np.arange(len(rows)), turn))[:landmarks]
    used = np.unique(np.concatenate([rows["grams"].iloc[i] for i in order]))
    column = np.full(GRAMS, -1)
    column[used] = np.arange(len(used))
    marks = np.zeros((len(order), len(used)), np.float32)
    for k, i in enumerate(order):
        g = rows["grams"].iloc[i]
        marks[k, column[g]] = 1 / np.sqrt(len(g))
    kernel = np.zeros((len(rows), len(order)))
    for i, g in enumerate(rows["grams"]):
        at = column[g]
        kernel[i] = marks[:, at[at >= 0]].sum(axis=1) / np.sqrt(len(g))
    target = np.stack([(rows["lang"] == x).to_numpy() * 2.0 - 1 for x in languages], 1)
    balance = 1 / np.sqrt(rows.groupby("lang")["lang"].transform("size").to_numpy() * len(languages))
    # Nystroem features of the kernel: K_nm K_mm^(-1/2); the ridge then in closed form, rows balanced by language
    values, vectors = np.linalg.eigh(marks.astype(np.float64) @ marks.T)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = np.c_[kernel @ root, np.ones(len(rows))]
    w = features * balance[:, None]
    solved = np.linalg.solve(w.T @ w + ridge * np.eye(w.shape[1]), w.T @ (target * balance[:, None]))
    weights = np.zeros((GRAMS, len(languages)), np.float32)
    weights[used] = marks.T @ (root @ solved[:-1])
    return Model(languages, weights, solved[-1])


def products(found: list[np.ndarray], weights: np.ndarray, block: int = 8192) -> np.ndarray:
    """The products of the texts' gram indicators, as one sparse matrix of a batch, and the matrix of grams by languages."""
    sizes = np.array([len(g) for g in found], np.int64)
    index, out = (np.concatenate(found) if len(found) else np.zeros(0, np.int64)), np.zeros((len(found), weights.shape[1]))
    begins = np.cumsum(sizes) - sizes
    at = 0
    while at < len(found):  # about a million rows of the matrix are gathered at once; a longer text alone
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + (1 << 20), "left")))
        to = min(to, at + block)
        some = np.flatnonzero(sizes[at:to]) + at
        if len(some):
            rows = weights[index[begins[at] : begins[to - 1] + sizes[to - 1]]]
            out[some] = np.add.reduceat(rows, begins[some] - begins[at], axis=0, dtype=np.float64)
        at = to
    return out


def _answer(model: tuple, texts: list[str | None], sharpness: float) -> tuple[list[str], list[float]]:
    """The language and the score of each text of a batch, by one product for all of them."""
    languages, weights, bias = model
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if languages and t and _LETTER.search(t)]
    if some:
        found = [grams(texts[i]) for i in some]
        y = products(found, weights) / np.sqrt([[len(g)] for g in found]) + bias
        e = np.exp(sharpness * (y - y.max(axis=1, keepdims=True)))
        best = y.argmax(axis=1)
        lang[some] = np.array(languages, object)[best]
        score[some] = e[np.arange(len(some)), best] / e.sum(axis=1)
    return lang.tolist(), score.tolist()


def _shared(docs: DataFrame, model: Model):
    """The model for the workers: grams by languages, of fixed size for each language."""
    return docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))


def predict(docs: DataFrame, model: Model, sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the softmax share of the best language) for each row of docs (doc_id, text)."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in pieces(batches, "text"):
            lang, score = _answer(shared.value, batch.column(batch.schema.get_field_index("text")).to_pylist(), sharpness)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("held_out")), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE, sharpness: float = SHARPNESS) -> DataFrame:
    """The rows of docs, with all their columns, that have a language: not `und`, and a score of `least` or more."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in pieces(batches, "text"):
            lang, score = _answer(shared.value, batch.column(batch.schema.get_field_index("text")).to_pylist(), sharpness)
            yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
