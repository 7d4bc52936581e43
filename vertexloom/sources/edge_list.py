"""Edge lists in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MALFORMED = "malformed edge line, two integers are expected: "


def parse_edge_lines(lines: DataFrame, canonical: bool = False, malformed: str = "fail") -> DataFrame:
    """src, dst and attr 1 of each line of `value`. Empty lines and those that begin with # are skipped.

    Tokens stand apart by white space; those after the second are ignored. A line without two integers at its beginning is an
    error, or is left out with malformed="drop". With `canonical`, the smaller end is the source.
    """
    if malformed not in ("fail", "drop"):
        raise ValueError("malformed: fail or drop")
    tokens = F.split("value", r"\s+")
    number = lambda i: F.get(tokens, i).try_cast("long")
    rows = lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select("value", number(0).alias("a"), number(1).alias("b"))
    complete = F.col("a").isNotNull() & F.col("b").isNotNull()
    if malformed == "drop":
        rows = rows.where(complete)
    else:
        rows = rows.withColumn("a", F.when(complete, F.col("a")).otherwise(F.raise_error(F.concat(F.lit(_MALFORMED), "value")).cast("long")))
    src, dst = (F.least("a", "b"), F.greatest("a", "b")) if canonical else (F.col("a"), F.col("b"))
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(1).alias("attr"))


def read_edge_list(spark: SparkSession, path: str, canonical: bool = False, malformed: str = "fail") -> DataFrame:
    """The edges in text files at `path`."""
    return parse_edge_lines(spark.read.text(path), canonical, malformed)


def write_edge_list(edges: DataFrame, path: str) -> None:
    """src and dst of each edge as text lines that `read_edge_list` reads."""
    edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.text(path)
