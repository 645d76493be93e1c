"""Quality scores learned from preferences between pairs of documents (Bradley-Terry).

The probability that document a is preferred to b is the logistic function of score(a) - score(b),
and the score is linear in features of the text, so fitting is logistic regression on feature
differences. Preference pairs are drawn between documents of the two labels among at most
`sample_rows` labelled rows: only their feature rows (some tens of numbers each) reach the driver.
Features of all documents come from one pass over the texts and are kept as a narrow table; scores
are an expression over it, and the score quantile is taken over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import style
from pairloom.llm.rows import hold, map_batches, whole_text


def bradley_terry(better: np.ndarray, worse: np.ndarray, pairs: int, seed: int = 5, ridge: float = 1e-2) -> np.ndarray:
    """Weights w with P(a preferred to b) = 1 / (1 + exp(-w (a - b))), by Newton steps."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(better), pairs), np.arange(pairs) % len(worse)
    difference = better[a] - worse[b]
    w = np.zeros(difference.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ (1 - p) / pairs - ridge * w
        curvature = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities of the better label (Newton steps).

    Targets are drawn in by one pseudo-row a label, so perfectly separated labels stay finite.
    """
    n_good, n_bad = good.sum(), (~good).sum()
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x, w = np.stack([score, np.ones(len(score))], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`_features` of every whole text."""
    source = df.withColumn("_text", whole_text(text)).select(*keep, "_text")

    def work(batch: pa.RecordBatch) -> dict:
        rows = []
        for t in batch.column("_text").to_pylist():
            b = t.encode("utf-8", "surrogatepass")
            rows.append(style.style(b, b.split()))
        return {"_features": pa.array(rows, pa.list_(pa.float64()))}

    return map_batches(source, work, "_features array<double>", keep)


def score_quality(
    df: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    sample_rows: int = 20_000,
    pairs: int = 60_000,
    cut_quantile: float = 0.1,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` (default: the id) of `df` with `score` (0 to 1) and `above_cut`.

    `labels` holds `doc_id` and a 0/1 label; pairs are drawn among rows of `df` with a label where
    `learn_from` holds. `above_cut`: the score is at least the `cut_quantile` quantile of all scores
    (approximate to one part in 10,000, over all rows). Null texts count as empty, and empty texts
    are scored like any other. Labels that are null or repeated for an id: nulls are ignored, of
    several the largest counts. Without labels of both kinds every score is the share of label 1 (0.5
    if there is none). Rows with a null id are scored but never learned from. An empty table gives
    an empty table; names of other columns do not matter.
    """
    kept = [doc_id] if keep is None else keep
    inner = df.select(*kept, F.col(text).alias("_raw"), F.col(doc_id).alias("_id"), F.coalesce(learn_from, F.lit(False)).alias("_learn"))
    made = hold(features(inner, "_raw", [*kept, "_id", "_learn"]))
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IN (0, 1)")
    known = made.filter("_learn").join(marks.groupBy("_id").agg(F.max("_label").alias("_label")), "_id").select("_id", "_label", "_features")
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / total if total else 0.5
        scored = made.withColumn("score", F.lit(float(share)))
    else:
        w, mean, deviation, slope, offset = _fit(known, counts, sample_rows, pairs)
        linear = sum(
            (
                F.lit(float(slope * wk / dk)) * ((F.col("_features")[k % len(style.NAMES)] if k < len(style.NAMES) else F.sqrt(F.abs(F.col("_features")[k % len(style.NAMES)]))) - F.lit(float(mk)))
                for k, (wk, mk, dk) in enumerate(zip(w, mean, deviation))
            ),
            F.lit(float(offset)),
        )
        scored = made.withColumn("score", 1 / (1 + F.exp(-linear)))
    cut = scored.agg(F.percentile_approx("score", cut_quantile, 10_000)).first()[0]
    above = F.col("score") >= F.lit(cut) if cut is not None else F.lit(True)
    return scored.select(*kept, "score", above.alias("above_cut"))


def _fit(known: DataFrame, counts: dict[int, int], sample_rows: int, pairs: int):
    """Weights, scaling and calibration from a bounded sample with up to half of it from either label."""
    parts = []
    for value, n in sorted(counts.items()):
        share = int((1 << 30) * min(1.0, sample_rows / 2 / n))
        picked = F.xxhash64(F.lit(13), "_id").bitwiseAND(F.lit((1 << 30) - 1)) < share
        parts.append(known.filter((F.col("_label") == value) & picked).limit(sample_rows))
    rows = sorted(tuple(r) for p in parts for r in p.collect())
    good = np.array([r[1] == 1 for r in rows])
    x = style.expand(np.array([r[2] for r in rows]))
    mean, deviation = style.scale_of(x)
    z = (x - mean) / deviation
    w = bradley_terry(z[good], z[~good], pairs)
    slope, offset = calibrated(z @ w, good)
    return w, mean, deviation, slope, offset
