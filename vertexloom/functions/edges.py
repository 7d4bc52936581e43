"""Column functions of edges, and the partition numbers of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The multiplier that spreads ids over partitions.
SPREAD = 1125899906842597


def other_vertex(vertex: Column, src: Column | str = "src", dst: Column | str = "dst") -> Column:
    """The end of the edge that is not `vertex` (for a loop, `vertex`); an error if the edge does not touch it."""
    src, dst = (F.col(c) if isinstance(c, str) else c for c in (src, dst))
    return F.when(src == vertex, dst).when(dst == vertex, src).otherwise(F.raise_error(F.lit("the edge does not touch that vertex")).cast("long"))


def _spread(key: Column, parts: int) -> Column:
    """abs(key * SPREAD) % parts in wrapping 64-bit arithmetic, which ANSI mode would refuse."""
    wide, whole = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")
    product = F.pmod(key.cast("decimal(20,0)") * F.lit(SPREAD).cast("decimal(16,0)"), wide).cast("decimal(20,0)")
    signed = F.when(product >= whole, wide - product).otherwise(product)  # its absolute value
    return F.pmod(signed, F.lit(parts).cast("decimal(20,0)")).cast("int")


def edge_partition_1d(src: Column | str, parts: int) -> Column:
    """The partition of an edge by its source: all edges of a source have one number."""
    return _spread(F.col(src) if isinstance(src, str) else src, parts)


def hash_partition(key: Column | str, parts: int) -> Column:
    """The partition of a key by the 32-bit hash of a 64-bit integer; null goes to 0."""
    key = F.col(key) if isinstance(key, str) else key
    folded = key.bitwiseXOR(F.shiftrightunsigned(key, 32))
    low = F.shiftright(F.shiftleft(folded, 32), 32)
    return F.coalesce(_spread(low, parts), F.lit(0))
