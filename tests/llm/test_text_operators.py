"""BPE, token files, quality, language ID: library or brute force, and null, empty, long, repeated and absent rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vertexloom.llm import bpe, langid, quality_bayes, quality_rules, queries, token_files
from vertexloom.llm.scratch import Scratch
from vertexloom.llm.textops import Words, text_buffers

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "a", "<|endoftext|> x<|endoft", "Ünïcode 日本 😀 \x85\x1c\xa0 x", "don't 12 3½ !!", "ab " * 4000, "z" * 20000, "same text here", "same text here"]
needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver's tables are not here")


def frame(spark, texts, **more):
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids int")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def noise(n, seed=3):
    rng = random.Random(seed)
    letters = "aabcdeeinorst  '\n.,12éß½ª\xa0\xad÷日😀ΣİA_"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_words_are_those_of_the_pattern():
    texts = [t or "" for t in ODD] + noise(50) + ["\x0b\x0c\r a\x1cb"]
    w = Words.of(pa.array(texts))
    got = [[bytes(w.data[w.starts[i] : w.ends[i]]).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    sliced = Words.of(pa.array(texts).slice(3, 5))
    assert sliced.counts.tolist() == w.counts[3:8].tolist() and (sliced.hashes() == w.hashes()[w.first[3] : w.first[8]]).all()


def test_bpe_is_the_library(spark):
    texts = ODD + noise(300)
    library = Tokenizer.from_file(BYTE)
    got = bpe.decode(bpe.encode(frame(spark, texts), BYTE), BYTE).orderBy("doc_id").collect()
    assert [c for c in got[0].asDict()] == ["doc_id", "text", "source", "ids", "decoded"]
    for r, t in zip(got, texts, strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(frame(spark, []), BYTE), BYTE).count() == 0


def test_bpe_remembers_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    texts = noise(200, 5)
    library, mine = Tokenizer.from_file(BYTE), bpe.TrieBPE(BYTE)
    for at in range(0, 200, 20):
        got = [np.frombuffer(x, np.int32).tolist() for x in mine.encode(texts[at : at + 20])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 20]]
    assert len(mine.known) <= 10


@needs_tables
def test_op1_over_documents(spark):
    library = Tokenizer.from_file(BYTE)
    text = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in queries.op1_bpe(spark, SF).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files_are_the_library(spark):
    texts = ODD + noise(200)
    docs = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit(None)).otherwise(F.col("doc_id") * -3)).repartition(5)
    blocks = token_files.write(docs, Scratch(spark, "t"), WORD, block_ids=500)
    got = {r.doc_id: r for r in token_files.read(blocks).collect()}
    library, at = Tokenizer.from_file(WORD), 0
    ids = {-3 * i if i != 1 else None: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    for doc in sorted(ids, key=lambda d: (d is not None, d or 0)):
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[doc]), zlib.crc32(np.array(ids[doc], "<u4").tobytes()))
        at += len(ids[doc])
    assert blocks.count() > 5
    assert token_files.read(token_files.write(frame(spark, []), Scratch(spark, "t"), WORD)).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for counts in ([1], [1, 1, 1], [5000, 1, 300, 2000], [7] * 400):
        ids = (rng.zipf(1.4, sum(counts)) % 60).astype(np.uint16)
        block = token_files.Block(token_files.pack(list(range(len(counts))), np.array(counts), ids, 100))
        assert (block.ids() == ids).all()
        for i in (0, len(counts) - 1):
            own = ids[block.starts[i] : block.starts[i + 1]].tolist()
            assert block.document(i) == own and block.document(i, 3, 9) == own[3:9] and block.document(i, 0, 10**6) == own
    assert len(block.rules) > 0 and len(block.symbols) < 2800
    with pytest.raises(ValueError):
        token_files.Block(b"none")


def test_words_of_token_files_are_the_library(monkeypatch):
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + noise(800, 11) + ["don't 'twas ''s 'RE'LL 've'd x's's 'm!'s It'S ÀÉ×ß÷ '", "'", "'r", "'l", "a'", "'s"]
    texts += ["".join(rng.choice("'srevldtm a1!é²") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    library = Tokenizer.from_file(WORD)
    for most in (50, 100_000):
        monkeypatch.setattr(token_files, "REMEMBERED", most)
        mine = token_files.WordTokenizer(WORD)
        for at in range(0, len(texts), 300):
            part = texts[at : at + 300]
            ids, counts = mine.encode(pa.array(part), 1)
            assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == library.encode(part[0], add_special_tokens=False).ids + [1]
            assert ids.tolist() == [i for t in part for i in [*library.encode(t, add_special_tokens=False).ids, 1]]
        assert mine.known.n <= most


def plain_repair(docs, first_new, least):
    """Re-Pair as it is defined: the most frequent pair goes first, one at a time."""
    docs, rules = [list(d) for d in docs], 0
    while True:
        count = Counter()
        for d in docs:
            held = -1
            for i, pair in enumerate(zip(d, d[1:])):
                if not (pair[0] == pair[1] and held == i - 1 and d[i - 1] == pair[0]):
                    count[pair] += 1
                    held = i
                else:
                    held = -1
        if not count or max(count.values()) < least:
            return sum(map(len, docs)), rules
        pair = max(count, key=lambda p: (count[p], p))
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                hit = tuple(d[i : i + 2]) == pair
                out.append(first_new + rules if hit else d[i])
                i += 2 if hit else 1
            docs[k] = out
        rules += 1


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(7)
    phrases = [rng.integers(0, 300, rng.integers(2, 12)) for _ in range(60)]
    docs = [np.concatenate([phrases[i] for i in rng.zipf(1.5, 40) % 60] + [rng.integers(0, 300, 5)]) for _ in range(150)]
    ids, ends = np.concatenate(docs).astype(np.uint16), np.cumsum([len(d) for d in docs])
    symbols, rules, cut = token_files.repair(ids, ends, 300)
    left = Counter(p for d in np.split(symbols.tolist(), cut[:-1]) for p in zip(d.tolist(), d.tolist()[1:]))
    assert max(left.values()) < token_files.LEAST
    plain, plain_rules = plain_repair(docs, 300, token_files.LEAST)
    assert len(symbols) + 2 * len(rules) <= 1.1 * (plain + 2 * plain_rules)
    for n in (1, 2, 3, 31, 100_000):  # equal ids
        same = np.full(n, 7, np.uint16)
        block = token_files.Block(token_files.pack([1], np.array([n]), same, 100))
        assert (block.ids() == same).all() and len(block.symbols) <= 20 + (n < 32) * 12
    many = np.tile(np.arange(40, dtype=np.uint16), 5000)
    assert len(token_files.repair(many, np.array([len(many)]), 100)[0]) < 50


def plain_rounds(docs, first_new, least, factor):
    """The rounds as they are described, over lists."""
    docs, rules = [list(d) for d in docs], []
    while True:
        count = Counter(p for d in docs for p in zip(d, d[1:]))
        top = max(count.values(), default=0)
        if top < least:
            return docs, rules
        often = sorted((p for p in count if count[p] * factor >= top and count[p] >= least), key=lambda p: (-count[p], p))
        rank, places = {p: r for r, p in enumerate(often)}, []
        for d in docs:
            own, run = [rank.get(p, len(rank)) for p in zip(d, d[1:])], 0
            for i, r in enumerate(own):
                run = run + 1 if i and own[i - 1] == r else 0
                places.append(r < len(rank) and run % 2 == 0 and not (i and own[i - 1] < r) and not (i + 1 < len(own) and own[i + 1] < r))
        at, used = iter(places), Counter()
        chosen = [[(i, rank[p]) for i, p in enumerate(zip(d, d[1:])) if next(at)] for d in docs]
        used.update(r for c in chosen for _, r in c)
        good = [r for r in range(len(rank)) if 2 * used[r] >= least]
        name = {r: first_new + len(rules) + k for k, r in enumerate(good)}
        for d, c in zip(docs, chosen, strict=True):
            for i, r in reversed(c):
                if r in name:
                    d[i : i + 2] = [name[r]]
        rules += [often[r] for r in good]


def test_rounds_look_up_no_place_by_search(monkeypatch):
    rng = np.random.default_rng(3)
    for least, factor in ((16, 16), (2, 3), (5, 16)):
        ids = (rng.zipf(1.3, 6000) % 90).astype(np.uint16)
        ids[1000:1300] = 7  # a run of equal ids
        ends = np.r_[np.flatnonzero(rng.random(5999) < 0.02) + 1, 6000]
        asked, search = [], np.searchsorted
        with monkeypatch.context() as m:
            m.setattr(token_files.np, "searchsorted", lambda a, v, *more, **named: (asked.append(np.size(v)), search(a, v, *more, **named))[1])
            symbols, rules, cut = token_files.repair(ids, ends, 100, least, factor)
        docs, plain = plain_rounds([d.tolist() for d in np.split(ids, ends[:-1])], 100, least, factor)
        assert symbols.tolist() == [s for d in docs for s in d] and cut.tolist() == np.cumsum([len(d) for d in docs]).tolist()
        assert [tuple(r) for r in rules.tolist()] == plain and len(plain) > 20
        # one for each document and round; looking up every place in every round cost more CPU than all else
        assert set(asked) == {len(ends)}


def test_pairs_are_found_as_in_a_dict():
    rng = np.random.default_rng(4)
    for n in (1, 40, 5000, 60_000):
        pairs = rng.permutation(np.unique(np.r_[np.uint32(0), rng.integers(0, 1 << 32, n, np.uint32)]))
        keys = np.r_[rng.choice(pairs, 20_000), pairs + np.uint32(1), rng.integers(0, 1 << 32, 20_000, np.uint32), np.uint32(0xFFFFFFFF)]
        number = {p: i for i, p in enumerate(pairs.tolist())}
        at, found = token_files.Pairs(pairs).find(keys)
        assert list(zip(at.tolist(), found.tolist())) == [(i, number[k]) for i, k in enumerate(keys.tolist()) if k in number]


def test_token_files_spread_rows_of_one_id(spark):
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = token_files.write(docs, Scratch(spark, "t"), WORD, block_ids=10**6)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert blocks.count() > 1 and token_files.read(blocks).count() == 400


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered)


def test_quality_counts_by_brute_force(spark):
    texts = ODD + noise(100) + ["a b c\na b c\n\n \nx\na b c", "w " * 60, "#*$%&|<> <<"]
    model = quality_rules.Model(np.zeros((4 << quality_rules.BITS) + 1), 1.0)
    got = {r.doc_id: r for r in quality_rules.score(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeated = brute_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and r.kept == (not r.base_failed)
    assert quality_rules.score(frame(spark, []), model).count() == 0


@needs_tables
def test_quality_on_rows_not_learnt_from(spark):
    docs, labels = documents(spark), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    large = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_rules.fit(large, labels, sample=250)
    learnt = {r.doc_id for r in labels.select("doc_id", F.abs(F.xxhash64("doc_id", F.lit(7))).alias("p")).orderBy("p").limit(250).collect()}
    rows = [r for r in quality_rules.score(large, model).join(labels, "doc_id").collect() if r.doc_id not in learnt and not r.base_failed]
    assert len(rows) > 100 and np.mean([(r.p_quality >= 0.5) == (r.quality == 1) for r in rows]) > 0.97
    assert quality_rules.fit(docs, labels.limit(0)).log_odds(quality_rules.Counted(pa.array(["x"])))[0] > 0


def test_posteriors_of_labels_by_hand(spark):
    """Two sites with sections, every figure computed again in plain Python; sparse groups stay near their parents."""
    groups = {("a", "x"): (18, 20), ("a", "y"): (10, 20), ("b", "x"): (2, 20), ("b", "y"): (1, 1), ("c", "x"): (0, 0)}  # good, labelled
    rows, labels = [], []
    for (site, section), (good, n) in groups.items():
        for k in range(n + 1):  # one of each group has no label
            rows.append((len(rows), "plain words", site, section, 5))
            if k < n:
                labels.append((len(rows) - 1, int(k < good)))
    labels += [(None, 1), (10**6, 0), (0, None)]
    docs = spark.createDataFrame(rows + [(None, None, None, None, 5)], "doc_id long, text string, source string, lang string, p int")
    model = quality_rules.Model(np.zeros((4 << quality_rules.BITS) + 1), 0.4)
    got = {r.doc_id: r for r in quality_bayes.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), model).collect()}

    def strength(shares):  # (good, n, mean)
        v = sum(n * m * (1 - m) for _, n, m in shares) / sum(n for _, n, _ in shares)
        between, each = sum(n * (g / n - m) ** 2 for g, n, m in shares), sum(n for _, n, _ in shares) / len(shares)
        return 1 / min(max((between / (len(shares) * v) - 1) / (each - 1), 1e-4), 0.5) - 1

    prior = 31 / 61
    sites = {"a": (28, 40), "b": (3, 21), "c": (0, 0), "": (0, 0)}
    k = strength([(g, n, prior) for g, n in sites.values() if n])
    mean = {s: (g + k * prior) / (n + k) for s, (g, n) in sites.items()}
    k2 = strength([(g, n, mean[s]) for (s, _), (g, n) in groups.items() if n])
    label = {d: y for d, y in labels if y is not None and d is not None}
    logit = lambda p: np.log(p / (1 - p))
    for d, _, site, section, _ in [*rows, (None, None, "", "", 5)]:
        good, n = groups.get((site, section), (0, 0))
        own = (good - label.get(d, 0) + k2 * mean[site]) / (n - (d in label) + k2)
        shift = 0.5 * min(max(logit(own) - logit(prior), -2), 2)
        want = 1 / (1 + np.exp(-(0.4 + shift)))
        assert abs(got[d].p_site - own) < 1e-9 and abs(got[d].p_quality - want) < 1e-9 and got[d].kept == (want >= 0.5)
    assert len(got) == len(rows) + 1 and quality_bayes.classify(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"), model).count() == 0
    assert all(abs(r.p_quality - r.p_text) < 1e-9 for r in quality_bayes.classify(docs, spark.createDataFrame([], "doc_id long, quality int"), model).collect())


@needs_tables
def test_op8_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learnt = labels.where("doc_id % 3 <> 0")  # the others are only judged
    got = quality_bayes.classify(docs, learnt, quality_rules.fit(docs, learnt))
    rows = got.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert got.count() == 1000 and len(rows) > 100 and np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.95


@needs_tables
def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.predict(docs, model).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    odd = frame(spark, ODD).withColumn("lang", F.lit("q"))
    found = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2)) and found[3].lang_pred != "und"
    assert langid.identified(odd, model, least=0).columns == odd.columns and langid.identified(odd, model, least=0).count() == len(ODD) - 3
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in langid.predict(docs.limit(5), one).collect()} == {"de"}


def test_string_kernel_is_what_the_weights_hold():
    a, b = (set(langid.grams(t).tolist()) for t in ("Abc abd", "abc"))
    letters = lambda t: re.sub("[^a-z]+", " ", t.lower())
    spans = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert len(a & b) == len(spans(letters("Abc abd")) & spans(letters("abc"))) and len(a) == len(spans("abc abd"))


def test_quality_model_learns_whole_sample_without_dense_rows():
    assert (quality_rules.SAMPLE, quality_rules.BITS) == (2400, 12)
    rng = np.random.default_rng(3)
    index = [np.sort(rng.choice(5000, rng.integers(0, 60), replace=False)).astype(np.int32) for _ in range(50)]
    value = [rng.random(len(i)).astype(np.float32) for i in index]
    dense = np.zeros((50, 5000))
    for row, i, v in zip(dense, index, value, strict=True):
        row[i] = v
    x, alpha, weights = quality_rules.Sparse(index, value, 5000), rng.random(30), rng.random(5000)
    assert np.allclose(x.gram(30), dense[:30] @ dense[:30].T, atol=1e-4)
    assert np.allclose(x.weighted(alpha), dense[:30].T @ alpha) and np.allclose(x.times(weights), dense @ weights)


def test_characters_are_code_points():
    texts = ["aé日😀", "", "plain", "\x80ÿĀ߿ࠀ￿𐀀", "zz"]
    for part in (texts, texts[2:3], ["", ""]):
        data, offs = text_buffers(pa.array(part))
        chars, ends = quality_rules.characters(data, offs)
        assert chars.tolist() == [ord(c) for t in part for c in t]
        assert ends.tolist() == np.cumsum([0, *map(len, part)]).tolist()


def test_sample_stays_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"some words number {i} " * 3) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert isinstance(quality_rules.fit(docs, labels, sample=10), quality_rules.Model)
    found = docs.withColumn("lang", F.lit("en")).withColumn("doc_id", F.lit(1).cast("long"))
    assert langid.fit(found, per_language=5).languages == ["en"]


def test_products_of_a_batch():
    rng = np.random.default_rng(9)
    weights = rng.random((langid.GRAMS, 3)).astype(np.float32)
    found = [np.sort(rng.choice(langid.GRAMS, n, replace=False)) for n in (5, 0, 900, 1, 0)]
    assert np.allclose(langid.products(found, weights), [weights[g].sum(axis=0) for g in found], rtol=1e-4)
    assert np.allclose(langid.products(found, weights, block=2), langid.products(found, weights)) and langid.products([], weights).shape == (0, 3)
