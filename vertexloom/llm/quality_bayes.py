"""Quality classifier: a document's own evidence, and what its site and section are worth, shrunk towards the corpus.

Labels are counted by site and section. A site's share of good documents gets a beta prior around the share of the corpus, a section's
around that of its site. How strongly each is shrunk comes from the spread between groups (method of moments), so sparse groups stay
near their parent. A document's posterior log-odds are those of its text, which counts once, plus a bounded share of how far its
section's log-odds are from the corpus's; its own label is left out of its section's.

Results, by case: a null or empty text has the evidence of no n-grams at all; a null site or section is a group like any other;
repeated rows count as often as they occur, several labels of a document by their mean; a table without rows gives none; extra columns
are left out; without labels no section moves anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.quality_rules import Counted, Model, sigmoid
from vertexloom.llm.scratch import Scratch
from vertexloom.llm.textops import pieces

#: How much of its section's log-odds a document takes over, and the most that they can be.
SITE_WEIGHT, SITE_LIMIT, THRESHOLD = 0.5, 2.0, 0.5


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text, site, section; instead of the text, p: the probability that the text alone gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            p = np.clip(sigmoid(model.log_odds(Counted(column("text")))), 1e-6, 1 - 1e-6)
            yield pa.RecordBatch.from_arrays([column("doc_id"), column("site"), column("section"), pa.array(p)], ["doc_id", "site", "section", "p"])

    return docs.mapInArrow(run, "doc_id long, site string, section string, p double")


def _strength(groups: DataFrame, mean: str) -> Column:
    """The number of documents that the prior counts for, from the spread of the groups' shares around `mean`."""
    row = groups.agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col(mean)) ** 2).alias("between"),
        F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("binomial"),
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
    ).first()
    if not row["n"] or row["groups"] < 2 or not row["binomial"]:
        return F.lit(100.0)
    # E[between] = groups * v * (1 + (n / groups - 1) * rho), v the binomial variance; rho = 1 / (strength + 1)
    v, each = row["binomial"] / row["n"], row["n"] / row["groups"]
    rho = (row["between"] / (row["groups"] * v) - 1) / max(each - 1, 1e-9)
    rho = min(max(rho, 1e-4), 0.5)
    return F.lit(1 / rho - 1)


def classify(docs: DataFrame, labels: DataFrame, model: Model, site: str | Column = "source", section: str | Column = "lang", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, site, section, p_text, p_site (of the document's section), p_quality and kept for each row of docs.

    labels: doc_id and the label column, 1 for good.
    """
    scratch = Scratch(docs.sparkSession, "quality-bayes")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    scored = scratch.table(evidence(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(col(site).cast("string"), F.lit("")).alias("site"), F.coalesce(col(section).cast("string"), F.lit("")).alias("section")), model), "evidence")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg((F.col(label) == 1).cast("double")).alias("own"))
    scored = scratch.table(scored.join(known, "doc_id", "left"), "labelled")
    sections = scratch.table(scored.groupBy("site", "section").agg(F.coalesce(F.sum("own"), F.lit(0.0)).alias("good"), F.count("own").alias("n")), "sections")
    sites = sections.groupBy("site").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    whole = sites.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    prior = min(max(whole["good"] / whole["n"], 1e-4), 1 - 1e-4) if whole["n"] else 0.5
    sites = scratch.table(sites.withColumn("mean", F.lit(prior)), "sites")
    k_site = _strength(sites.where("n > 0"), "mean")
    parts = scratch.table(sections.join(sites.select("site", ((F.col("good") + k_site * F.lit(prior)) / (F.col("n") + k_site)).alias("mean")), "site"), "parts")
    k_part = _strength(parts.where("n > 0"), "mean")
    # a document's own label is no evidence for itself
    own = (F.col("good") - F.coalesce("own", F.lit(0.0)) + k_part * F.col("mean")) / (F.col("n") - F.col("own").isNotNull().cast("int") + k_part)
    logit = lambda p: F.log(p / (1 - p))
    own = F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = F.lit(SITE_WEIGHT) * F.least(F.greatest(logit(own) - logit(F.lit(prior)), F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))
    posterior = 1 / (1 + F.exp(-(logit(F.col("p")) + shift)))
    # a few rows for each section: Spark broadcasts them if they are small, and splits a hot section if not
    return scored.join(parts, ["site", "section"], "left").select("doc_id", "site", "section", F.col("p").alias("p_text"), own.alias("p_site"), posterior.alias("p_quality"), (posterior >= threshold).alias("kept"))
