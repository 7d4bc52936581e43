"""Near duplicates, substrings, decontamination, WARC and HTML: brute force and SQL, and odd rows."""

import hashlib
import itertools
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import decontaminate, html_text, queries, simhash, substring, warc
from vertexloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver's tables are not here")


def prose(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)]


def corpus():
    """Unrelated texts, exact and near copies of them, and texts without words."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        for _ in range(rng.randint(1, 6)):
            c = list(b)
            for _ in range(rng.randint(0, 4)):
                c[rng.randrange(len(c))] = "new" + str(rng.randrange(99))
            texts.append(" ".join(c))
    texts += [None, "", " ", "one", "one", "one two", "\n", " ".join(prose(rng, 6000))]
    return texts


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(texts):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingle_set(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or same and same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long, digest string").repartition(4)


def test_near_duplicates_by_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    want = brute_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].n_class == want.count(want[i]) for i in range(len(texts)))
    kept = simhash.representatives(docs_of(spark, texts))
    assert kept.columns == docs_of(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_with_tiny_buckets_and_odd_ids(spark):
    rng = random.Random(9)
    base = prose(rng, 150)
    near = []
    for i in range(60):
        c = list(base)
        c[i * 2] = f"edit{i}"
        near.append(" ".join(c))
    got = simhash.near_duplicates(docs_of(spark, near), cap=8).collect()
    assert {r.class_id for r in got} == {0} and {r.n_class for r in got} == {60}
    rows = [(5, near[0]), (5, near[0]), (5, "other words here"), (None, near[1]), (None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_class) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(5, 5, 3), (5, 5, 3), (5, 5, 1), (None, 5, 3), (None, None, 1)], key=str)
    assert simhash.representatives(odd).count() == 3
    clash = odd.withColumns({"id": F.lit(7), "_digest": F.lit(8), "place": F.lit(9)})
    assert {(r.id, r._digest, r.place) for r in simhash.representatives(clash).collect()} == {(7, 8, 9)}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.representatives(odd.limit(0)).count() == 0


def test_buckets_are_divided_whole():
    keys = np.sort(np.r_[np.zeros(50, np.int64), np.random.default_rng(2).integers(0, 1 << 12, 200)])
    parts = sorted(simhash.divided(keys, 12, 16))
    assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and parts[0][0] == 0 and parts[-1][1] == 250
    assert all(b - a <= 16 or alike and len(set(keys[a:b])) == 1 for a, b, alike in parts)
    for texts in (100, 10**6, 10**11):
        bits, tables = simhash.plan(texts)
        assert 1 - (1 - simhash.agreement(0.8) ** bits) ** tables >= 0.995


def test_all_pairs_of_an_oversized_bucket_meet(spark):
    rows = spark.range(60).select(F.lit(3).alias("t"), (F.col("id") < 50).cast("long").alias("bucket"), F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"))
    cut = simhash.units(rows, Scratch(spark, "t"), 8)
    sizes = [r["count"] for r in cut.groupBy("t", "bucket", "lo", "hi").count().collect()]
    met = []
    for _, group in itertools.groupby(sorted(cut.collect(), key=lambda r: r[:2] + (r.lo, r.hi)), lambda r: (r.bucket, r.lo, r.hi)):
        group = list(group)
        own = np.array([r.own for r in group])
        for x, y, d in simhash.distances(np.zeros((len(group), 4), np.uint64), own):
            i, j = np.nonzero(d == 0)
            met += [frozenset((bytes(group[p].digest), bytes(group[q].digest))) for p, q in zip(x[i], y[j], strict=True)]
    assert len(met) == len(set(met)) == 50 * 49 // 2 + 10 * 9 // 2 and max(sizes) < 50


def test_a_base_with_many_copies_that_are_far_from_each_other(spark):
    rng = random.Random(11)
    found = [prose(rng, 204) for _ in range(2000)]
    base = max(found, key=lambda b: hashlib.sha256(" ".join(b).encode()).digest())  # so that the base is held against its copies
    texts = [" ".join(base)]
    for i in range(150):
        c = list(base)
        for at in rng.sample(range(4, 200, 10), 4):
            c[at] = f"edit{i}"
        texts.append(" ".join(c))
    got = simhash.near_duplicates(docs_of(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(brute_classes(texts)))


def test_links_among_texts_of_one_template(spark):
    """Three hundred pairs at 0.826 among 3,000 texts that are alike at 0.75 anyway: none is lost."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(244)]  # 240 shingles
    texts, n = [], 0
    for i in range(2700):
        c = list(base)
        for at in range(2 + i % 3, 34, 5):  # seven words, each in five shingles
            c[at] = f"own{n}"
            n += 1
        texts.append(c)
    for i in range(300):
        c = list(texts[i])
        for at in rng.sample(range(60, 240, 6), 4):
            c[at] = f"edit{n}"
            n += 1
        texts.append(c)
    sets = [shingle_set(" ".join(t)) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert min(near(i, 2700 + i) for i in range(300)) >= 0.8
    assert all(0.7 < near(*rng.sample(range(2700), 2)) < 0.8 for _ in range(300))
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs_of(spark, [" ".join(t) for t in texts])).collect()}
    found = sum(got[2700 + i] == got[i] for i in range(300))
    assert found >= 297 and len(set(got.values())) >= 2700


def test_rarest_shingles_rule_out_no_link(spark):
    rng = random.Random(14)
    base = prose(rng, 120)
    texts = []
    for _ in range(120):
        c = list(base) + prose(rng, rng.randrange(0, 12))
        for at in rng.sample(range(120), rng.randrange(0, 9)):
            c[at] = f"edit{rng.randrange(40)}"
        texts.append(" ".join(c))
    sets = [shingle_set(t) for t in texts]
    frame = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate(texts)], "digest binary, text string")
    rows = {}
    for r in simhash.rare_prefixes(frame, Scratch(spark, "t"), 0.8).collect():
        rows.setdefault(r.bucket, []).append(r)
    met, may = set(), 0
    for group in rows.values():
        rare = simhash.Rare(*([r[k] for r in group] for k in ("size", "short", "lonely", "rare", "more")), 0.8)
        for i, j in zip(*np.nonzero(rare.may_link(np.arange(len(group)))), strict=True):
            met.add((int(group[i].digest), int(group[j].digest)))
    want = {(i, j) for i in range(120) for j in range(120) if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want <= met and len(want) > 50 and len(met) < 4 * len(want) + 120


def test_short_texts(spark):
    rng = random.Random(12)
    texts = []
    for n in (8, 8, 9, 12, 13, 16, 20, 24, 28) * 8:
        words = prose(rng, n)
        texts += [" ".join(words), " ".join([*words, "more"])]
    got = simhash.near_duplicates(docs_of(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(brute_classes(texts)))


def brute_substring(rows, window=20):
    """rows: (doc_id, text). Removed words of each row."""
    first = {}
    words = [(t or "").split() for _, t in rows]
    for (d, _), w in sorted(zip(rows, words, strict=True), key=lambda x: x[0][0]):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {s + k for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (d, s) for k in range(window)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def passages():
    rng = random.Random(6)
    shared = [prose(rng, n) for n in (19, 20, 21, 60)]
    texts = []
    for i in range(80):
        w = prose(rng, rng.randint(0, 90))
        for p in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p
        texts.append(" ".join(w))
    texts += [None, "", "w " * 300, "w " * 19, "w " * 20, texts[3], texts[3], " ".join(prose(rng, 5000) + shared[3])]
    return texts


@pytest.mark.parametrize(("bits", "chunk", "frequent"), [(22, 600_000, 64), (19, 60, 64), (19, 60, 3)])
def test_substring_by_brute_force(spark, monkeypatch, bits, chunk, frequent):
    monkeypatch.setattr(substring, "SEGMENT_BITS", 18)
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    monkeypatch.setattr(substring, "SALTS", 3)
    rows = list(enumerate(passages()))
    docs = docs_of(spark, [t for _, t in rows]).repartition(7)
    got = {r.doc_id: r for r in substring.deduplicate(docs, width_bits=bits).collect()}
    for (d, t), kept in zip(rows, brute_substring(rows), strict=True):
        n = len((t or "").split())
        assert (got[d].n_words, got[d].n_removed, got[d].kept_text) == (n, n - len(kept), " ".join(kept))


def test_substring_keeps_columns_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(2, text, "a", 5), (2, text, "b", 5), (None, text, "c", 5), (7, "x\n" + text, "d", 9), (8, "a \n b", "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lo string, n_chars int")
    got = {r.lo: r for r in substring.stripped(docs, width_bits=22).collect()}
    assert got["c"].text == text and got["a"].text == "" == got["b"].text and (got["d"].text, got["d"].n_chars) == ("x", 1)
    assert (got["e"].text, got["e"].n_chars) == ("a \n b", 5) and substring.stripped(docs, width_bits=22).schema == docs.schema
    assert substring.deduplicate(docs.limit(0), width_bits=22).count() == 0
    clash = docs.withColumns({"doc": F.lit(77), "row": F.lit(78), "ranges": F.lit(79)})
    assert {(r.doc, r["row"], r.ranges) for r in substring.stripped(clash, width_bits=22).collect()} == {(77, 78, 79)}


def test_a_frequent_window_is_thinned():
    text = " ".join(f"w{i}" for i in range(20))
    batch = pa.RecordBatch.from_pydict({"doc": list(range(9)), "row": [1] * 9, "text": [text] * 9})
    everything = type("Bits", (), {"value": b"\xff" * (1 << 17)})
    sent = [b for k in range(9) for b in substring._send(20, 8, 19, everything, everything)(iter([batch.slice(k, 1)]))]
    assert len(sent) == 9 and all(b.column("hot").to_pylist() == [True] for b in sent)
    out = pa.Table.from_batches(list(substring._group(20, thin=True)(iter(sent))))
    assert sorted(d for d, r in zip(out["doc"].to_pylist(), out["route"].to_pylist(), strict=True) if r is None) == list(range(1, 9))
    assert [d for d, r in zip(out["doc"].to_pylist(), out["route"].to_pylist(), strict=True) if r is not None] == [0]


def test_sketch_never_underestimates():
    rng = np.random.default_rng(5)
    anchor = rng.integers(0, 1 << 60, 3000).astype(np.uint64)
    one, two = substring.cells(anchor, 10)
    assert one.max() < 1 << 10 <= two.min() and two.max() < 2 << 10


TEMPLATE = "Tom has 5 apples and gives 3 apples to Anna, so how many apples does Tom have left now?"


def test_templates_and_slots():
    index = decontaminate.Index([(1, TEMPLATE), (2, "a b"), (3, None), (4, "the quick brown fox jumps"), (5, TEMPLATE)])
    assert index.matches(TEMPLATE)[0] == (1, 19, 19, True)
    # the name that begins a sentence is a literal, so it is not covered
    other = "Well. Bill has 12 apples and gives 7 apples to Mary, so how many apples does Bill have left now? Yes."
    assert index.matches(other) == [(1, 18, 19, False), (5, 18, 19, False)]
    # one number in the place of two, and one name in the place of two
    assert index.matches(other.replace("gives 7", "gives 12")) == []
    assert index.matches(other.replace("does Bill", "does Mary")) == []
    assert [m[0] for m in index.matches("So: The QUICK brown, fox jumps!")] == [4]
    for clean in (None, "", "a b", "Tom has 5 apples and gives them away", "1 2 3 4 5 6 7 8 9 10"):
        assert index.matches(clean) == []


def test_a_slot_that_conflicts_loses_its_own_windows_only():
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50)]
    plain = list(words)
    plain[10] = plain[40] = "5"
    index = decontaminate.Index([(1, " ".join(plain)), (2, "12 7 19 33 2 8"), (3, "alpha " + " ".join(map(str, range(20, 40))))])
    altered = list(plain)
    altered[40] = "6"
    assert index.matches(" ".join(altered)) == [(1, 49, 50, True)]
    altered[10] = "7"  # two values for one: neither slot is consistent, what stands between and around them is verbatim
    assert index.matches(" ".join(altered)) == [(1, 48, 50, True)]
    assert index.matches("so 12 7 19 33 2 8 it is") == [(2, 6, 6, True)]
    assert index.matches("so 12 7 19 33 2 9 it is") == []
    assert index.matches("alpha " + " ".join(map(str, range(20, 40)))) == [(3, 21, 21, True)]


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(prose(rng, 30))) for i in range(12)] + [(None, None), (99, ""), (12, TEMPLATE), (13, TEMPLATE), (14, "a b c d"), (None, "w1 x2 y3 " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join([*prose(rng, 50), *t.split()[:take], *prose(rng, 20)]) for _, t in items[:12] for take in (30, 15, 9)] + [None, "", items[0][1], items[0][1]]
    texts += [TEMPLATE.replace("5 apples", "8 apples"), TEMPLATE.replace("Tom", "Bill") * 3, "a B c. d", "w1 x2 y3 " * 40, "word " * 50_000 + TEMPLATE]
    docs = docs_of(spark, texts).withColumn("uid", F.lit(5))
    index = decontaminate.Index(items)
    want = {(d, *m) for d, t in enumerate(texts) for m in index.matches(t)}
    assert {(3 * i + k, i) for i in range(12) for k in (0, 1)} | {(38, 0), (39, 0)} <= {m[:2] for m in want} and len(want) > 30
    got = [tuple(r) for r in decontaminate.matches(docs, bench).collect()]
    assert len(got) == len(want) and set(got) == want
    kept = decontaminate.clean(docs, bench)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {m[0] for m in want}
    twice = spark.createDataFrame([(None, TEMPLATE), (None, TEMPLATE), (1, TEMPLATE)], "doc_id long, text string")
    assert sorted(map(str, decontaminate.matches(twice, bench).select("doc_id", "item_id").collect())) == sorted(f"Row(doc_id={d}, item_id={i})" for d in (None, None, 1) for i in (12, 13))
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(texts)


@needs_tables
def test_op10_finds_the_items_that_stand_in_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, SF).collect()}
    assert {(d, i) for d, t in docs.items() for i, b in items.items() if b in t} <= got
    index = decontaminate.Index(list(items.items()))
    assert got == {(d, m[0]) for d, t in docs.items() for m in index.matches(t)}
    words = {d: set(zip(*(t.lower().split()[k:] for k in range(4)))) for d, t in docs.items()}
    assert all(words[d] & set(zip(*(items[i].lower().split()[k:] for k in range(4)))) for d, i in got)


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same", 1), (2, "http://a/2\r\nx", "same", 1), (3, None, None, 1), (None, "u", "lone ünï\r\n\r\n", 1), (5, "v", "", 1), (5, "v", "", 1), (6, "w", "x" * 100_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    archive = warc.write(pages, Scratch(spark, "t"))
    records = warc.records(archive)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.listing(records).collect()), key=str)
    want = [(1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 5), (None, 14, "response", None), (5, 0, "response", None), (5, 0, "response", None), (6, 100_000, "response", None)]
    assert got == sorted(want, key=str)
    assert sorted(((r.page_id, r.html) for r in warc.restore(archive).collect()), key=str) == sorted(((p, h or "") for p, _, h, _ in rows), key=str)
    assert archive.table("payloads").count() == 4
    warc.export(records, str(tmp_path / "warc"))
    import gzip

    whole = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").glob("*.gz"))
    assert sorted(whole.count(bytes(r.record)) for r in records.collect()) and all(bytes(r.record) in whole for r in records.collect())
    small = warc.listing(warc.records(warc.write(pages, Scratch(spark, "t"), least_bytes=5))).where("record_type = 'revisit'")
    assert small.count() == 0
    assert warc.listing(warc.records(warc.write(pages.limit(0), Scratch(spark, "t")))).count() == 0


def test_damaged_records_are_refused():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:{}\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n"
    http = len("HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\n")
    good = head.format(warc.base32_sha1(b"b"), http + 1).encode()
    assert warc.parse(good + b"b\r\n\r\n")["payload"] == b"b"
    for bad in (good + b"c\r\n\r\n", good + b"bb\r\n\r\n", good + b"b", b"nothing"):
        with pytest.raises(ValueError):
            warc.parse(bad)


PAGES = [
    (1, "http://h.com/a/1", "<body><div>Menu A</div><p>Unique one</p><div>Copyright</div></body>"),
    (2, "http://h.com/a/2?q", "<body><div>Menu A</div><p>Unique two &amp; more<br>x&nbsp;&#233;</p><div>Copyright</div></body>"),
    (3, "http://z.com/", "<nav>n</nav>hello <b>w</b>orld"),
    (4, None, None),
    (5, "http://h.com/b", "<title>t</title><main><article><header><h1>T</h1><p>by</p></header><p>body<script>x='</p>'</script></p><form>f</form><div class='comments'><p>c</p></div><article>reply</article></article></main><p>out"),
    (6, "http://h.com/c", "<div id=cookie-notice>c</div><aside>s</aside><article class=post><p>one<p>two <i>x</i><ul><li>a<li>b</ul><div class='ad'>buy</div><p hidden>h</p></article><footer>f"),
    (7, "u", ""),
    (8, "v", "<nav>never closed<article><p>a < b &lt;c&gt;</p></article><p clas"),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, uid string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    want = {1: "Unique one", 2: "Unique two & more x é", 3: "hello world", 4: "", 5: "T\nbody", 6: "one\ntwo x\na\nb", 7: "", 8: "a < b <c>"}
    assert got == want
    assert html_text.extract(pages.limit(0)).count() == 0
    again = html_text.extract(pages.where("page_id = 1").union(pages.where("page_id = 1"))).collect()
    assert [r.text for r in again] == ["Menu A\nUnique one\nCopyright"] * 2


def test_words_of_classes_and_quotes_in_tags(spark):
    """What only looks like boilerplate goes if the neighbour has it, too; a quote without an equals sign opens nothing."""
    page = "<nav>n</nav><article><h1>T{0}</h1><p class='share-price'>Price {0}</p><div class='notice-period'>Notice {0}</div><section id='comments-on-kant'>Kant {0}</section><p class='share-story-17'>Tell your friends</p><div class='comment-list'>c{0}</div><div class='adBox'>buy{0}</div></article>"
    rows = [(i, f"http://h.org/a/{i}", page.format(i)) for i in (1, 2, 3)]
    rows += [(8, "q1", "<article><a title='it's'>two</a><p>three isn't</p></article>"), (9, "q2", '<article><p>x<img alt="5" tall"> y</p></article>'), (10, "q3", "<article><p title=\"a>b\">z</p><p x='" + "=\"" * 3000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\nPrice {i}\nNotice {i}\nKant {i}" for i in (1, 2, 3)} | {8: "two\nthree isn't", 9: "x y", 10: "z"}


def brute_texts(rows):
    """rows: (page_id, url, html). Quadratic pairing and alignment, page by page."""

    def lcs(a, b):
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        return best[-1, -1]

    parsed = {p: (*html_text.place(u), *html_text.lines(h or "")) for p, u, h in rows}
    out = {}
    for p, (host, path, found, kinds) in parsed.items():
        groups = {}
        for q, (other_host, other_path, other, _) in parsed.items():
            if other_host == host:
                groups[tuple(other)] = min(groups.get(tuple(other), (other_path, q)), (other_path, q))
        order = sorted((v, k) for k, v in groups.items())
        at = [k for _, k in order].index(tuple(found))
        same = lambda k: next((i for i, (x, y) in enumerate(zip(order[at][0][0].split("/"), order[k][0][0].split("/"))) if x != y), min(len(order[at][0][0].split("/")), len(order[k][0][0].split("/"))))  # noqa: B023, E731
        near = [k for k in (at - 1, at + 1) if 0 <= k < len(order)]
        theirs = list(order[max(near, key=lambda k: (same(k), -k))][1]) if near and html_text.undecided(kinds) else []
        gone = html_text.shared(found, theirs)
        assert len(gone) == lcs(found, theirs)
        out[p] = "\n".join(html_text.kept(found, kinds, gone))
    return out


@needs_tables
def test_main_text_by_brute_force(spark):
    rng = random.Random(15)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    menus = [f"<div>Menu {i}</div>" for i in range(6)]
    for i in range(60):
        body = "".join(rng.choice([*menus, f"<p>own {rng.randrange(90)}</p>", f"<p class='share-x'>maybe {rng.randrange(4)}</p>"]) for _ in range(rng.randint(0, 12)))
        rows.append((1000 + i, f"http://{rng.choice('xy')}.org/{rng.choice('ab')}/{rng.choice('cd')}/{i}", f"<article><p>it</p>{body}</article>" if i % 3 == 0 else body))
    rows += [(2000 + i, "http://x.org/a/c/0", rows[-1][2]) for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == brute_texts(rows)


def test_alignment_of_long_and_of_equal_lines():
    equal, long_ = ["x"] * 8000, [str(i % 700) for i in range(20000)]
    assert len(html_text.shared(["a", *equal, "b"], ["c", *equal[:5000], "d"])) == 5000
    assert len(html_text.shared(["p", *long_, "q"], ["r", *long_, "s"])) == 20000


def test_copies_of_a_page_keep_what_other_pages_do_not_have(spark):
    body = "<div>Menu</div><p>{}</p><div>Copyright</div>"
    rows = [(i, f"http://h.com/a?q={i}", body.format("Copied")) for i in range(5)] + [(5, "http://h.com/b", body.format("Other"))]
    rows += [(i, f"http://mirrors.com/a{i}", body.format("Mirror")) for i in (6, 7)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys(range(5), "Copied") | {5: "Other"} | dict.fromkeys((6, 7), "Menu\nMirror\nCopyright")


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = sorted(html_text.shared(a, b))
        assert len(html_text.shared(a, b, most=4)) == len(got)
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_neighbours_of_one_large_host(spark):
    keys = spark.range(200).select(F.col("id").alias("uid"), F.lit("h").alias("host"), F.format_string("p/%03d", "id").alias("path"), F.lit(False).alias("settled"))
    near = {r.uid: r.other for r in html_text.neighbours(keys, Scratch(spark, "t")).collect()}
    assert len(near) == 200 and all(abs(u - o) == 1 for u, o in near.items())


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_beside_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))
