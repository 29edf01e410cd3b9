"""Connected components of links, by large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.durable import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"] or 0


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: each linked node and the smallest node that it reaches.

    Each round joins every node's larger neighbours to its smallest one and then its smaller
    ones likewise, until nothing changes; the links then form stars. Rounds are written to the
    shared folder, so lineage stays short; nothing but a count and a checksum reaches the driver.
    Links to itself and links with a null end are left out.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialize(edges.where(F.col("u") != F.col("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select(F.col("u").alias("node"), F.col("u").alias("component"))
    )
