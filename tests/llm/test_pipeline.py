"""The pipeline: every stage's decisions, its columns, and its rows by brute force."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vertexloom.llm import langid

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver's tables are not here")


def test_stages_over_documents(spark):
    from test_dedup_operators import brute_classes, brute_substring

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.schema
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "substring_dedup", "decontamination", "bpe"]
    model = langid.fit(docs)
    known = {r.doc_id for r in langid.predict(docs, model).where("lang_pred <> 'und' and score >= 0.3").collect()}
    ids = sorted(known)
    classes = brute_classes([rows[i].text for i in ids])
    kept = [ids[k] for k in sorted(set(classes))]
    texts = dict(zip(kept, map(" ".join, brute_substring([(i, rows[i].text) for i in kept])), strict=True))
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], (ids, kept, kept), strict=True):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
        assert docs.schema == schema and sorted(r.doc_id for r in docs.collect()) == want, name
    assert {r.doc_id: " ".join(r.text.split()) for r in docs.collect()} == texts
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    leaked = {i for i, t in texts.items() if any(" ".join(b.split()) in t for b in items)}
    assert not clean & leaked and set(kept) - clean >= leaked
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == clean


def test_stages_of_odd_and_absent_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123 456", "en", "s", 7), (4, "plain words of one text", "en", "s", 23), (4, "plain words of one text", "en", "s", 23)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs, left in ((spark.createDataFrame(rows, schema), 1), (spark.createDataFrame([], schema), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() == left


def test_workers_hold_little_text_at_a_time(spark):
    """4,000 texts of 10 kB once came as one Arrow batch of 40 MB, which an executor holds several times over."""
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"), F.lit("en").alias("lang"))
    docs = docs.union(docs.limit(1).select("doc_id", F.repeat(F.lit("word "), 2_000_000).alias("text"), "lang"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"]) for b in batches)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        for _, stage in corpus_pipeline.STAGES[1:3]:
            stage(spark, docs.limit(0), SF)
            found = docs.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in found) == 4001
            *others, longest = sorted(r.bytes for r in found)
            assert others[-1] < 6 << 20
            assert 10_000_000 < longest < 10_000_000 + (6 << 20)  # a longer text is whole
            spark.conf.unset(key)
        spark.conf.set(key, "1000000")
        corpus_pipeline.bounded(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)


_KEPT = """
import re
import numpy as np, pyarrow as pa
from vertexloom.llm import simhash
def held():
    return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024
rng = np.random.default_rng(1)
def batches(n):
    for _ in range(n):
        texts = [" ".join(map(str, row)) for row in rng.integers(0, 1 << 40, (1400, 300))]
        yield pa.RecordBatch.from_arrays([pa.array(range(1400)), pa.array(texts)], ["doc_id", "text"])
for n in (1, 5):
    for out in simhash._prints(batches(n), 30):
        pass
    del out
    print(held())
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is not told here")
def test_idle_workers_keep_little():
    """A worker's allocators once kept what the task had taken until another operator came."""
    out = subprocess.run([sys.executable, "-c", _KEPT], capture_output=True, text=True, cwd=Path(corpus_pipeline.__file__).parent, check=True).stdout
    assert max(map(float, out.split())) < 120, out
