"""Connected components of links of any number, by large-star and small-star joins (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed


def joined_back(rows: DataFrame, summary: DataFrame, key: str | list[str]) -> DataFrame:
    """rows inner-joined to summary, which has one row for each key and is usually made of rows.

    The summary is written out first. So both sides of the join are plain shuffles, and adaptive execution can split a key
    that holds a large part of the rows over many tasks, which it cannot where the summary is added up in the same stage."""
    return rows.join(checkpointed(summary), key)


def connected(edges: DataFrame) -> DataFrame:
    """edges: columns a, b of one orderable type. node and root (the smallest node of its component) of every node in an edge.

    Nulls link nothing; loops and repeated edges do no harm. No task gathers a hub's edges: minima are partial first, and the joins that send them back may be split."""
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpointed(joined_back(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined_back(large, least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        before, state = state, _state(e)
        if before == state:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
