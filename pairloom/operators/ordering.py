"""Exact positions and samples inside groups of any size.

A plain `row_number() over (partition by group)` sends a whole group to one task. Here the
order is by a hash of the row key; its leading digits name one of 4,096 buckets, so a group is
spread over 4,096 window partitions. Bucket sizes (at most 4,096 numbers per group) give
each bucket its offset, and offset + position in the bucket is the exact global position.
The result depends on the data only, so a recomputed partition repeats it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairloom.session import cut_lineage, join_bounded

BUCKET_DIGITS = 3
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def hash_key(seed: int | str, *parts: Column | str) -> Column:
    """Repeatable random key of a row: md5 of the seed and the row's key columns."""
    values = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[v.cast("string") for v in values]))


def _bucket_offsets(df: DataFrame, groups: Sequence[str], key: str) -> DataFrame:
    bucket = F.substring(key, 1, BUCKET_DIGITS).alias("_bucket")
    sizes = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_size"))
    upto = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    return sizes.select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_group_size"),
    )


def with_position(
    df: DataFrame, groups: Sequence[str], key: Column, tie: Sequence[str], limit: str | None = None
) -> DataFrame:
    """Adds `position` (0-based, by key then tie) and `group_size`.

    With `limit` (a column holding a count) only rows with position < limit stay, and buckets
    that start beyond it are dropped before the shuffle.
    """
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    offsets = _bucket_offsets(df.withColumn("_key", key), groups, "_key")
    joined = join_bounded(keyed, offsets, [*groups, "_bucket"])
    if limit is not None:
        joined = joined.filter(F.col("_before") < F.col(limit))
    inside = W.partitionBy(*groups, "_bucket").orderBy("_key", *tie)
    placed = joined.withColumn("position", F.col("_before") + F.row_number().over(inside) - 1)
    if limit is not None:
        placed = placed.filter(F.col("position") < F.col(limit))
    return placed.withColumnRenamed("_group_size", "group_size").drop("_key", "_bucket", "_before")


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of every group with their `rank` (1-based).

    Up to the window group limit of the session, Spark keeps only n rows per group and task before
    the shuffle. For a larger n rows are dealt to ranges by group and order; the sizes of a group's parts in the ranges give each
    part its offset, so no group is ranked in one task.
    """
    if n < 0:
        raise ValueError(f"n must not be negative, got {n}")
    if n <= int(df.sparkSession.conf.get(GROUP_LIMIT, "1000")):
        window = W.partitionBy(*groups).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
    dealt = cut_lineage(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    upto = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*groups, "_part", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_before")).filter(F.col("_before") < n)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*groups, "_part"]]  # null is a group too
    met = dealt.alias("l").join(F.broadcast(offsets).alias("o"), same).select("l.*", "o._before")  # a row per group and range at most
    window = W.partitionBy(*groups, "_part").orderBy(*order)
    ranked = met.withColumn("rank", (F.col("_before") + F.row_number().over(window)).cast("int"))
    return ranked.filter(F.col("rank") <= n).drop("_part", "_before")


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The n rows that come first by some columns (null first), as a set.

    The n-th smallest key is found on the keys alone, range by range; the rows are then filtered by it, so
    nothing but keys is sorted. Of rows that share the last key as many are taken as are missing.
    """
    if n <= 0:
        return df.limit(0)
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    keys = df.select(key.alias("_k"))
    dealt = cut_lineage(keys.repartitionByRange("_k").withColumn("_part", F.spark_partition_id()))
    before = 0
    for part, size in sorted(map(tuple, dealt.groupBy("_part").count().collect())):  # one row per partition
        if before + size >= n:
            break
        before += size
    else:
        return df
    at = W.orderBy("_k")  # the rows of one range
    inside = dealt.filter(F.col("_part") == part).withColumn("_at", F.row_number().over(at)).withColumn("_less", F.rank().over(at) - 1)
    last = inside.filter(F.col("_at") == n - before).select("_k", (F.lit(n - before) - F.col("_less")).alias("_more")).first()
    fields = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last[0], keys.schema["_k"].dataType.fields)]
    keyed = df.withColumn("_k", key)
    less, equal = keyed.filter(F.col("_k") < F.struct(*fields)), keyed.filter(F.col("_k").eqNullSafe(F.struct(*fields)))
    return less.unionByName(equal.limit(last["_more"])).drop("_k")


#: distinct values of a bracket that one task may rank, and bins of a histogram that cuts a larger one
BRACKET_VALUES, BRACKET_BINS = 100_000, 1024


def _narrowed(counted: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Brackets `groups, i, rank, side, inside, c, _lo, _hi` of at most `BRACKET_VALUES` values.

    The values of a larger one are counted in bins of equal width; the bins of the wanted rank and the next one stay, and the rest joins
    the counts below and above. Every round divides the width by the number of bins, so doubles need a few rounds at most.
    """
    at = [*groups, "i"]
    while True:
        sizes = counted.filter("side = 0").groupBy(*at).agg(F.count(F.lit(1)).alias("_m"), F.min("inside").alias("_a"), F.max("inside").alias("_b"))
        large = cut_lineage(sizes.filter((F.col("_m") > BRACKET_VALUES) & (F.abs("_a") < float("inf")) & (F.abs("_b") < float("inf"))))
        if large.isEmpty():
            return counted
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in at]
        met = counted.alias("l").join(F.broadcast(large).alias("r"), same, "left").select("l.*", "r._a", "r._b")  # a row per bracket
        share = (F.col("inside") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)
        bin_no = F.when(F.col("side") == 0, F.least(F.floor(share * BRACKET_BINS), F.lit(BRACKET_BINS - 1))).otherwise(F.col("side") * (BRACKET_BINS + 1))
        binned = cut_lineage(met.withColumn("_bin", F.when(F.col("_a").isNotNull(), bin_no)))
        running = W.partitionBy(*at).orderBy("_bin")
        bins = binned.filter("_bin IS NOT NULL").groupBy(*at, "rank", "_bin").agg(F.sum("c").alias("_c")).withColumn("_end", F.sum("_c").over(running))
        kept = bins.filter((F.col("_end") > F.floor("rank")) & (F.col("_end") - F.col("_c") <= F.floor("rank") + 1))
        span = cut_lineage(kept.groupBy(*at).agg(F.min("_bin").alias("_first"), F.max("_bin").alias("_last")))
        placed = binned.alias("l").join(F.broadcast(span).alias("r"), same, "left").select("l.*", "r._first", "r._last")
        side = F.when(F.col("_bin") < F.col("_first"), -1).when(F.col("_bin") > F.col("_last"), 1).otherwise(F.col("side"))
        moved = placed.withColumn("side", side.cast("int")).withColumn("inside", F.when(F.col("side") == 0, F.col("inside")))
        again = moved.groupBy(*at, "rank", "side", "inside").agg(F.sum("c").alias("c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        counted = cut_lineage(again)


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float]
) -> DataFrame:
    """Linear-interpolated quantiles per group: columns `q0, q1, ...` in the order of shares.

    `percentile` would keep every distinct value of a group in one buffer. Here a bounded
    sketch brackets each wanted rank, counts below the bracket and the few values inside
    it are aggregated in parallel. A bracket of many distinct values is cut by a histogram again and
    again, and only the values that are left are ranked.
    """
    if any(not 0.0 <= s <= 1.0 for s in shares):
        raise ValueError("shares must lie in [0, 1]")
    accuracy, margin = 10_000, 4 / 10_000
    rows = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    lows = [max(0.0, s - margin) for s in shares]
    highs = [min(1.0, s + margin) for s in shares]
    brackets = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", lows + highs, accuracy).alias("_cuts"),
    )
    k = len(shares)
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                (F.lit(s) * (F.col("_n") - 1)).alias("rank"),
                (F.lit(None).cast("double") if lows[i] == 0 else F.col("_cuts")[i]).alias("low"),
                (F.lit(None).cast("double") if highs[i] == 1 else F.col("_cuts")[k + i]).alias("high"),
            )
            for i, s in enumerate(shares)
        ]
    )
    nested = brackets.select(*groups, wanted.alias("_t"))
    side = F.when(F.col("_v") < F.col("t.low"), -1).when(F.col("_v") > F.col("t.high"), 1).otherwise(0)
    # one row per (group, target, value inside the bracket); below and above are one row each
    counted = (
        join_bounded(rows, nested, list(groups))
        .select(*groups, "_v", F.explode("_t").alias("t"))
        .select(*groups, "t.i", "t.rank", "_v", side.alias("side"))
        .groupBy(*groups, "i", "rank", "side", F.when(F.col("side") == 0, F.col("_v")).alias("inside"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    counted = _narrowed(cut_lineage(counted), groups)
    running = W.partitionBy(*groups, "i").orderBy("side", "inside")
    ranked = counted.withColumn("_end", F.sum("c").over(running)).withColumn(
        "_start", F.col("_end") - F.col("c")
    )

    def at(rank: Column) -> Column:
        """Value at a rank: in the bracket, the last one below it, or the first one above it."""
        here = (F.col("_start") <= rank) & (rank < F.col("_end"))
        last_below = (F.col("side") == -1) & (rank == F.col("_end") - 1)
        first_above = (F.col("side") == 1) & (rank == F.col("_start"))
        value = F.when(last_below, F.col("_hi")).when(
            (F.col("side") == 0) | first_above, F.col("_lo")
        )
        return F.max(F.when(here, value))

    low, part = F.floor("rank"), F.col("rank") - F.floor("rank")
    ends = ranked.groupBy(*groups, "i", "rank").agg(at(low).alias("a"), at(low + 1).alias("b"))
    between = F.when(part > 0, F.col("a") + (F.col("b") - F.col("a")) * part).otherwise(F.col("a"))
    missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
    values = ends.select(*groups, "i", F.coalesce(between, missed).alias("v"))
    return values.groupBy(*groups).agg(
        *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{i}") for i in range(k)]
    )
