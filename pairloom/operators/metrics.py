"""Corpus metrics: row statistics once, sums by any keys, closed forms last.

A run table has one row per (run, sentence): `run, id, do, gen, rev, standard, dialect,
dialect_eojeol_map`, optionally `pred_label` and the embeddings `out_emb, dia_emb, std_emb`.
Because the statistics are plain counts, corpus, region, bucket and sentence scores are the
same aggregate under different keys, with partial sums before the only shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairloom.functions.ngrams import (
    BLEU_WIDTH,
    CHRF_WIDTH,
    bleu_score,
    bleu_stats,
    chrf_score,
    chrf_stats,
    sum_stats,
)
from pairloom.functions.prosody import strip_markers
from pairloom.functions.scores import region_label, word_hits
from pairloom.functions.text import col, edit_bucket, region_group, strip
from pairloom.operators.ordering import first_per_group
from pairloom.session import join_bounded

METRICS = (
    "tdr", "dfs", "eojeol_accuracy", "bleu", "chrf", "chrf_source", "copy_margin",
    "reconstruction_bleu", "jscore",
)


def with_gold(generations: DataFrame, gold: DataFrame) -> DataFrame:
    """Generated rows joined to their gold pair by id."""
    return generations.join(gold, "id")


def cosine(a: Column | str, b: Column | str) -> Column:
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)

    a, b = col(a), col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.greatest(norms, F.lit(1e-8))


def fidelity_term(out: str = "out_emb", dia: str = "dia_emb", std: str = "std_emb", eps: float = 1e-6):
    return F.log(1 + cosine(out, dia) + eps) - F.log(1 + cosine(out, std) + eps)


def remap_unit(value: Column | str, low: float, high: float, floor: float = 1e-6) -> Column:
    """[low, high] to (0, 1] with a floor; a zero span gives 0.5."""
    unit = (col(value) - low) / (high - low) if high > low else F.lit(0.5)
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), unit))


def jscore(
    tdr: Column, content: Column, edit: Column, fluency: Column, content_is_margin: bool = True
) -> Column:
    """Fourth root of the product of the four remapped axes."""
    axes = (
        remap_unit(tdr, 0.0, 1.0)
        * remap_unit(content, -100.0 if content_is_margin else 0.0, 100.0)
        * remap_unit(edit, 0.0, 1.0)
        * remap_unit(fluency, 0.0, 1.0)
    )
    return F.pow(axes, 0.25)


def row_stats(runs: DataFrame, post_strip: bool = False) -> DataFrame:
    """Adds the count columns every metric is summed from (optionally marker-free first)."""
    rows = runs
    if post_strip:
        rows = rows.withColumn("gen", strip_markers("gen"))
        if "rev" in runs.columns:
            rows = rows.withColumn("rev", strip_markers("rev"))
    hits, total = word_hits()
    columns = {
        "_chrf": chrf_stats("gen", "dialect"),
        "_chrf_source": chrf_stats("gen", "standard"),
        "_bleu": bleu_stats("gen", "dialect"),
        "_hits": hits,
        "_words": total,
        "_exact": F.when(strip("gen") == strip("dialect"), 1).otherwise(0),
    }
    if "rev" in runs.columns:
        columns["_bleu_rev"] = bleu_stats("rev", "standard")
    if "pred_label" in runs.columns:
        columns["_on_target"] = F.when(F.col("pred_label") == region_label("do"), 1).otherwise(0)
    if "out_emb" in runs.columns:
        columns["_fidelity"] = fidelity_term()
    return rows.withColumns(columns)


def metrics_by(stats: DataFrame, keys: Sequence[str], fluency: float = 0.5) -> DataFrame:
    """One wide row of metrics per key; optional metrics only where their inputs exist."""
    have = set(stats.columns)
    sums = [
        F.count(F.lit(1)).alias("n"),
        sum_stats("_chrf", CHRF_WIDTH).alias("_chrf"),
        sum_stats("_chrf_source", CHRF_WIDTH).alias("_chrf_source"),
        sum_stats("_bleu", BLEU_WIDTH).alias("_bleu"),
        F.sum("_hits").alias("_hits"),
        F.sum("_words").alias("_words"),
        F.sum("_exact").alias("exact_match"),
    ]
    if "_bleu_rev" in have:
        sums.append(sum_stats("_bleu_rev", BLEU_WIDTH).alias("_bleu_rev"))
    if "_on_target" in have:
        sums.append(F.sum("_on_target").alias("_on_target"))
    if "_fidelity" in have:
        sums.append(F.avg("_fidelity").alias("dfs"))
    wide = stats.groupBy(*keys).agg(*sums)
    out = {
        "tdr": F.col("_on_target") / F.col("n") if "_on_target" in have else None,
        "dfs": F.coalesce("dfs", F.lit(0.0)) if "_fidelity" in have else None,
        "eojeol_accuracy": F.when(F.col("_words") > 0, F.col("_hits") / F.col("_words")).otherwise(0.0),
        "bleu": bleu_score("_bleu"),
        "chrf": chrf_score("_chrf"),
        "chrf_source": chrf_score("_chrf_source"),
        "copy_margin": chrf_score("_chrf") - chrf_score("_chrf_source"),
        "reconstruction_bleu": bleu_score("_bleu_rev") if "_bleu_rev" in have else None,
    }
    named = {k: v for k, v in out.items() if v is not None}
    scored = wide.select(*keys, "n", "exact_match", *[v.alias(k) for k, v in named.items()])
    target = F.col("tdr") if "tdr" in named else F.lit(0.0)
    return scored.withColumn(
        "jscore", jscore(target, F.col("copy_margin"), F.col("eojeol_accuracy"), F.lit(fluency))
    )


def exact_matches(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`exact_match, exact_match_pct` per key: outputs equal to the dialect text but for blanks around."""
    hit = F.when(strip("gen") == strip("dialect"), 1).otherwise(0)
    share = F.round(100.0 * F.sum(hit) / F.count(F.lit(1)), 2)
    return runs.groupBy(*keys).agg(F.sum(hit).alias("exact_match"), share.alias("exact_match_pct"))


def metrics_long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys, metric, value` rows."""
    names = [m for m in METRICS if m in wide.columns]
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    return wide.select(*keys, F.explode(entries).alias("m")).select(*keys, "m.metric", "m.value")


def sentence_scores(runs: DataFrame, keys: Sequence[str] = ("do", "run", "id")) -> DataFrame:
    """Sentence BLEU of the back-translation, the input of the significance tests."""
    counted = runs.select(*keys, bleu_stats("rev", "standard").alias("_bleu_rev"))
    return counted.select(*keys, bleu_score("_bleu_rev").alias("score"))


def with_bucket(runs: DataFrame) -> DataFrame:
    """Adds `bucket` (small/med/large) and `bucket_key` (region group and bucket)."""
    bucket = edit_bucket("standard", "dialect")
    return runs.withColumn("bucket", bucket).withColumn(
        "bucket_key", F.concat_ws("_", region_group("do"), F.col("bucket"))
    )


def with_gold_run(runs: DataFrame, baseline: str, name: str = "GOLD") -> DataFrame:
    """Adds the pseudo-run that outputs the gold text: the upper bound of every metric."""
    perfect = runs.filter(F.col("run") == baseline).withColumn("run", F.lit(name)).withColumn(
        "gen", F.col("dialect")
    )
    return runs.unionByName(perfect)


def samples_by_bucket(runs: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """First k sentences per bucket with the outputs of the named runs side by side."""
    keyed = with_bucket(runs)
    pairs = keyed.filter(F.col("run") == names[0]).select(
        "id", "bucket_key", "standard", "dialect"
    )
    chosen = first_per_group(pairs, ["bucket_key"], ["id"], k)
    outputs = (
        runs.filter(F.col("run").isin(*names))
    )
    outputs = (
        join_bounded(outputs, chosen.select("id"), ["id"], "left_semi")  # k ids per bucket key
        .groupBy("id")
        .pivot("run", list(names))
        .agg(F.first("gen"))
    )
    renamed = outputs.select("id", *[F.col(n).alias(f"gen_{n}") for n in names])
    return chosen.join(renamed, "id")


def token_accuracy(tokens: DataFrame, keys: Sequence[str], sequence: str = "id") -> DataFrame:
    """Accuracy and mean entropy over supervised positions (label != -100).

    The prediction at a position is for the next token: one shuffle by sequence, whose length the
    model's context bounds, and the label behind each position.
    """
    after = F.lead(F.struct("pos", "label")).over(W.partitionBy(*keys, sequence).orderBy("pos"))
    following = tokens.select(*keys, "pos", "pred", "entropy", after.alias("_after"))
    supervised = following.filter(F.col("_after.pos") == F.col("pos") + 1).withColumn("_next", F.col("_after.label"))
    supervised = supervised.filter(F.col("_next") != -100)
    return supervised.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("pred") == F.col("_next"), 1.0).otherwise(0.0)).alias("token_accuracy"),
        F.avg("entropy").alias("mean_entropy"),
    )


def group_normalized_sum(
    scores: DataFrame,
    group: Sequence[str],
    weights: dict[str, float],
    eps: float = 1e-4,
    sample_std: bool = True,
) -> DataFrame:
    """Per group: z-score of every score column, then the weighted sum (`advantage`).

    The rows are shuffled by group once; the aggregate and the join read that same exchange, so
    the scores are computed once. A group is the completions of one prompt.
    """
    scores = scores.repartition(*group)
    std = F.stddev_samp if sample_std else F.stddev_pop
    stats = scores.groupBy(*group).agg(
        F.count(F.lit(1)).alias("group_rows"),
        *[F.avg(c).alias(f"_mean_{c}") for c in weights],
        *[F.coalesce(std(c), F.lit(0.0)).alias(f"_std_{c}") for c in weights],
    )
    joined = scores.join(stats, list(group))
    total = F.lit(0.0)
    for name, weight in weights.items():
        z = (F.col(name) - F.col(f"_mean_{name}")) / (F.col(f"_std_{name}") + eps)
        total = total + float(weight) * z
    return joined.select(*scores.columns, "group_rows", total.alias("advantage"))


def summed_advantage(
    scores: DataFrame, group: Sequence[str], weights: dict[str, float], eps: float = 1e-4
) -> DataFrame:
    """Weighted sum of the scores first, then its z-score inside the group."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + float(weight) * F.col(name)
    summed = scores.withColumn("total", total)
    return group_normalized_sum(summed, group, {"total": 1.0}, eps)


def incomplete_groups(scores: DataFrame, group: Sequence[str], size: int) -> DataFrame:
    """Groups whose row count is not a whole number of `size`."""
    return (
        scores.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") % size != 0)
    )
