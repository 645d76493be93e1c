"""Connected components of a link table, as joins and aggregates.

Every round replaces links by links to smaller ids (first among larger neighbours, then among
smaller ones) until nothing changes; the table never grows beyond twice its links, a hub's links
are pre-aggregated by `min` and its join side is split by adaptive skew handling. Each round is
written to the checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.llm.rows import hold


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node, component` (smallest id reachable) for each id in a link; ids are of one ordered type.

    Self links, repeated links and either direction are allowed; links with a null end are
    ignored; no links give an empty table.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    known = links[a].isNotNull() & links[b].isNotNull()
    now = hold(ends.filter(known & (F.col("u") != F.col("v"))).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = (
            both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        now = hold(smaller.distinct())
        before, state = state, _state(now)
        if state == before:
            break
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Count and an order-free checksum (two 32-bit halves summed apart, so sums can't overflow)."""
    h = F.xxhash64("u", "v")
    half = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return tuple(
        links.agg(F.count(F.lit(1)), half(h.bitwiseAND(F.lit(0xFFFFFFFF))), half(F.shiftrightunsigned(h, 32))).first()
    )
