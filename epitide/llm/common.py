"""What several operators of this package share: tables, text keys, connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epitide.session import cut

ROUNDS_AT_MOST = 200


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; NULL and the empty text share one key."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores more as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def same(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of the columns of two aliased tables."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def components(links: DataFrame) -> DataFrame:
    """Smallest node that each linked node can reach.

    ``links`` has two columns of one type, the ends of undirected links; repeated links, both
    directions and loops are fine. Result: ``node``, ``component``, one row for each node of a
    link between two different nodes. Rows with a NULL end are no links. An empty table gives
    an empty table.

    Alternating star contractions: each round hangs the larger neighbours of a node on its
    smallest neighbour, then the node and its smaller neighbours on the smallest of them. The
    number of rounds grows with the logarithm of the longest path. A node's smallest neighbour
    is aggregated map-side and joined back, so a node with a third of all links is split by
    adaptive execution; neighbours are never gathered. Every round is a written table.
    """
    a, b = links.columns
    edges = cut(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(), "links")
    state = _state(edges)
    for _ in range(ROUNDS_AT_MOST):
        if state[0] == 0:
            break
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("lo").alias("x"), "m").where("x > m").unionByName(
            down.select(F.col("hi").alias("x"), "m"))
        edges = cut(small.select(F.col("x").alias("hi"), F.col("m").alias("lo")).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {ROUNDS_AT_MOST} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of links and an order-free fingerprint of them: equal states mean equal tables."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
    return tuple(row)
