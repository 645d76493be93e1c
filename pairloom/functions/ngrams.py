"""N-gram overlap statistics of text pairs, and the closed forms of chrF and BLEU on them.

The statistics of one row need only that row, so they are computed where the row is: one
Arrow batch in, one array of counts out, no explode and no shuffle (an exploded form would
move about 6 x characters rows per pair). Counts add up, so every score (per row, per
region, per corpus) is: sum the arrays by key, then apply the closed form.

Layout of a statistics array:
  chrF  [hyp_1, ref_1, match_1, ..., hyp_6, ref_6, match_6]
  BLEU  [hyp_len, ref_len, total_1, match_1, ..., total_4, match_4]
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.functions.overlap import (
    BLEU_ORDER,
    BLEU_WIDTH,
    CHRF_ORDER,
    CHRF_WIDTH,
    bleu_counts,
    chrf_counts,
)
from pairloom.functions.text import bind, col, spaced_13a, without_blanks

CHRF_BETA = 2.0
_COUNTS = "array<bigint>"


def chrf_stats(hyp: Column | str, ref: Column | str) -> Column:
    """Character n-gram statistics, blanks ignored."""
    count = F.pandas_udf(chrf_counts, _COUNTS)
    return count(without_blanks(col(hyp)), without_blanks(col(ref)))


def bleu_stats(hyp: Column | str, ref: Column | str) -> Column:
    """Word n-gram statistics over the 13a tokens."""
    count = F.pandas_udf(bleu_counts, _COUNTS)
    # the kernel splits at blanks, so they are not evened out before
    return count(spaced_13a(hyp), spaced_13a(ref))


def sum_stats(stats: str, width: int) -> Column:
    """Aggregate: element-wise sum of a statistics column (partial sums before the shuffle)."""
    sums = ", ".join(f"coalesce(sum(get({stats}, {i})), 0L)" for i in range(width))
    return F.expr(f"array({sums})")


def _orders(stats: Column, count: int, first: int, fields: tuple[str, ...]) -> Column:
    """The counts of every n-gram order as structs of doubles."""

    def one(n: Column) -> Column:
        start = n * len(fields) + first
        return F.struct(
            *[F.get(stats, start + k).cast("double").alias(f) for k, f in enumerate(fields)]
        )

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one)


def chrf_score(stats: Column | str) -> Column:
    """chrF (0..100): precision and recall averaged over the orders both sides have."""
    orders = _orders(col(stats), CHRF_ORDER, 0, ("hyp", "ref", "match"))
    usable = F.filter(orders, lambda o: (o["hyp"] > 0) & (o["ref"] > 0))

    def mean(of: str) -> Column:
        return F.aggregate(
            usable,
            F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("n")),
            lambda acc, o: F.struct(
                (acc["sum"] + o["match"] / o[of]).alias("sum"), (acc["n"] + 1.0).alias("n")
            ),
            lambda acc: F.coalesce(acc["sum"] / F.nullif(acc["n"], F.lit(0.0)), F.lit(0.0)),
        )

    weight = CHRF_BETA**2

    def score(m: Column) -> Column:
        below = weight * m["p"] + m["r"]
        return F.when(below > 0, 100.0 * (1 + weight) * m["p"] * m["r"] / below).otherwise(0.0)

    return bind(F.struct(mean("hyp").alias("p"), mean("ref").alias("r")), score)


def bleu_score(stats: Column | str) -> Column:
    """BLEU (0..100), effective order; zero matches are smoothed by halving."""
    s = col(stats)
    start = F.struct(
        F.lit(0.0).alias("logs"),
        F.lit(0.0).alias("orders"),
        F.lit(1.0).alias("halving"),
        F.lit(0.0).alias("matched"),
    )

    def add(acc: Column, o: Column) -> Column:
        halving = F.when(o["match"] == 0, acc["halving"] * 2).otherwise(acc["halving"])
        share = F.when(o["match"] == 0, 100.0 / (halving * o["total"])).otherwise(
            100.0 * o["match"] / o["total"]
        )
        return F.struct(
            (acc["logs"] + F.log(share)).alias("logs"),
            (acc["orders"] + 1.0).alias("orders"),
            halving.alias("halving"),
            (acc["matched"] + o["match"]).alias("matched"),
        )

    orders = F.filter(_orders(s, BLEU_ORDER, 2, ("total", "match")), lambda o: o["total"] > 0)
    hyp_len, ref_len = (F.get(s, k).cast("double") for k in (0, 1))
    brevity = F.when(hyp_len < ref_len, F.exp(1 - ref_len / hyp_len)).otherwise(1.0)
    precision = F.aggregate(
        orders,
        start,
        add,
        lambda acc: F.when(acc["matched"] > 0, F.exp(acc["logs"] / acc["orders"])).otherwise(0.0),
    )
    return F.when(hyp_len > 0, brevity * precision).otherwise(0.0)
