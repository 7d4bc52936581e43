"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.scratch import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, decode from the ids, and digest both."""
    from vertexloom.llm import bpe

    return bpe.round_trip(docs.select("doc_id", "text"), vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import warc
    from vertexloom.llm.scratch import Scratch

    archive = warc.write(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    return warc.listing(warc.records(archive))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import token_files
    from vertexloom.llm.scratch import Scratch

    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), Scratch(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import quality_rules

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import langid

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import quality_bayes, quality_rules

    ship(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_bayes.classify(docs, labels, quality_rules.fit(docs, labels))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import substring

    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vertexloom.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


#: Words as lists.
_WORDS = r"""w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""

#: Base32 of a SHA-1: each 5 hexadecimal digits are 4 digits of 5 bits.
_BASE32 = """array_to_string(list_transform(range(1, 41, 5), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, i, 5) AS BIGINT) >> b) & 31) + 1 AS BIGINT), 1)), '')), '')"""

ORACLES = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM p""",
    "op7_simhash_near_dedup": """
        WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1),
        w AS (SELECT id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM t),
        s AS (SELECT DISTINCT id, array_to_string(list_slice(ws, i, i + 4), ' ') AS k FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT id, count(*) AS c FROM s GROUP BY 1),
        p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * p.c >= 8 * (x.c + y.c - p.c)),
        sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(v, l) AS (SELECT id, id FROM t UNION SELECT b, l FROM reach JOIN sides ON a = v),
        class AS (SELECT v AS id, min(l) AS class_id FROM reach GROUP BY v)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_class FROM documents JOIN t ON coalesce(documents.text, '') = t.text JOIN class USING (id)""",
    "op9_substring_dedup": f"""
        WITH {_WORDS},
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
        keyed AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 19), ' ') AS k FROM starts),
        ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM keyed),
        gone AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 20)))) AS g FROM ranked WHERE r > 1 GROUP BY doc_id),
        pos AS (SELECT w.doc_id, len(ws) AS n, g, list_filter(list_transform(ws, lambda x, i: CASE WHEN g IS NOT NULL AND list_contains(g, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS kept
                FROM w LEFT JOIN gone USING (doc_id))
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM pos""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
