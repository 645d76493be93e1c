"""Mixing documents to target weights of domains with soft membership.

A softmax classifier, fitted on a bounded sample of a labelled table, gives every document its
probabilities over the domains. With t tokens, probabilities p and rate r of a document, the expected
domain totals are the sums of r * t * p. Rates start at 1 and move by projected gradient steps of the
least-squares distance between these totals and the targets: r <- max(0, r - p . step), where the
step is the residual of the totals, scaled by the inverse Gram matrix of the documents that are not
at a bound. One iteration is one aggregate of D + D * D sums over a narrow table; only those sums and
the step (D numbers) pass through the driver, and the rate of a document stays an expression over its
own probabilities, so no rates are collected or joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import style
from pairloom.llm.rows import hold, map_batches, stored, texts_of, whole_text


@dataclass
class DomainModel:
    """Softmax over style features and the shares of some telling words."""

    domains: list[str]
    words: list[bytes]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([(x - self.mean) / self.deviation, np.ones((len(x), 1))], axis=1) @ self.weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def describe(texts: list[str], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text and its number of tokens (words between blanks)."""
    place = {w: k for k, w in enumerate(words)}
    styles, shares, tokens = [], np.zeros((len(texts), len(words))), np.zeros(len(texts), dtype=np.int64)
    for row, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass")
        cut = b.split()
        tokens[row] = len(cut)
        styles.append(style.style(b, cut))
        for w in filter(place.__contains__, cut):
            shares[row, place[w]] += 1
    shares /= np.maximum(1, tokens)[:, None]
    plain = np.array(styles).reshape(-1, len(style.NAMES))
    return np.concatenate([style.expand(plain), np.sqrt(shares)], axis=1), tokens


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Weights (features + 1, classes) of a softmax model by accelerated gradient descent."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    target = np.eye(classes)[y]
    rate = 1.0 / (0.5 * np.linalg.eigvalsh(x1.T @ x1 / len(x1))[-1] + ridge)
    w = before = np.zeros((x1.shape[1], classes))
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - before)
        z = x1 @ ahead
        e = np.exp(z - z.max(axis=1, keepdims=True))
        before, w = w, ahead - rate * (x1.T @ (e / e.sum(axis=1, keepdims=True) - target) / len(x1) + ridge * ahead)
    return w


def telling_words(sample: DataFrame, most: int) -> list[bytes]:
    """Words whose share of documents differs most between the domains (chi-square against the pooled share)."""
    sizes = {r["_domain"]: r["count"] for r in sample.groupBy("_domain").count().collect()}
    everything = sum(sizes.values())
    word = F.explode(F.array_distinct(F.split("_text", r"[ \t\n\x0b\f\r]+"))).alias("word")
    counts = sample.select("_domain", word).filter("word <> ''").groupBy("word").pivot("_domain", sorted(sizes)).count().fillna(0)
    domains = sorted(sizes)
    seen = sum((F.col(f"`{d}`") for d in domains), F.lit(0))
    gap = sum(
        (F.pow(F.col(f"`{d}`") - seen * sizes[d] / everything, 2) / (seen * sizes[d] / everything) for d in domains), F.lit(0.0)
    )
    best = counts.filter(seen >= 5).orderBy(gap.desc(), "word").limit(most).select("word").collect()
    return [r["word"].encode("utf-8", "surrogatepass") for r in best]


def learn_domains(
    df: DataFrame, labelled: DataFrame, text: str, doc_id: str, domain: str, sample_rows: int, telling: int = 64
) -> DomainModel | None:
    """A model from at most about `sample_rows` labelled documents; None without labels.

    Small domains are taken whole as far as the bound allows, so that each is represented.
    """
    marks = labelled.select(F.col(doc_id).alias("_id"), F.col(domain).cast("string").alias("_domain")).filter(
        "_id IS NOT NULL AND _domain IS NOT NULL"
    )
    marks = hold(marks.groupBy("_id").agg(F.min("_domain").alias("_domain")))
    sizes = {r["_domain"]: r["count"] for r in marks.groupBy("_domain").count().collect()}
    if not sizes:
        return None
    each = sample_rows / len(sizes)
    share = F.create_map(*[F.lit(v) for d, n in sizes.items() for v in (d, int((1 << 30) * min(1.0, each / n)))])
    picked = F.xxhash64(F.lit(17), "_id").bitwiseAND(F.lit((1 << 30) - 1)) < share[F.col("_domain")]
    chosen = marks.filter(picked).limit(2 * sample_rows)  # bounded, so it may be broadcast
    rows = df.select(F.col(doc_id).alias("_id"), whole_text(text).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = hold(rows.select("_id", "_domain", "_text"))
    words = telling_words(sample, telling)

    def work(batch: pa.RecordBatch) -> dict:
        x, _ = describe(batch.column("_text").to_pylist(), words)
        return {"_x": pa.array(x.tolist(), pa.list_(pa.float64()))}

    made = sorted((r["_id"], r["_domain"], r["_x"]) for r in map_batches(sample, work, "_x array<double>", ["_id", "_domain"]).collect())
    if not made:
        return None
    domains = sorted(sizes)
    x, y = np.array([m[2] for m in made]), np.array([domains.index(m[1]) for m in made])
    mean, deviation = style.scale_of(x)
    z = np.clip((x - mean) / deviation, -8, 8)
    weights = softmax_regression(z, y, len(domains))
    # the sample is balanced between domains: shift the offsets to the shares of the labelled table
    drawn = np.bincount(y, minlength=len(domains)) / len(y)
    truth = np.array([sizes[d] for d in domains]) / sum(sizes.values())
    weights[-1] += np.log(truth) - np.log(np.maximum(drawn, 1e-9))
    return DomainModel(domains, words, mean, deviation, weights)


def add_posteriors(df: DataFrame, model: DomainModel, text: str, keep: list[str]) -> DataFrame:
    """`keep`, `tokens` and `posteriors` (in the order of `model.domains`)."""
    source = df.select(*dict.fromkeys([*keep, text]))

    def work(batch: pa.RecordBatch) -> dict:
        x, tokens = describe(texts_of(batch, text), model.words)
        z = np.clip((x - model.mean) / model.deviation, -8, 8)
        same = DomainModel(model.domains, model.words, np.zeros(x.shape[1]), np.ones(x.shape[1]), model.weights)
        return {"tokens": tokens, "posteriors": pa.array(same.posteriors(z).tolist(), pa.list_(pa.float64()))}

    return map_batches(source, work, "tokens bigint, posteriors array<double>", keep)


def _rate(steps: list[np.ndarray], most: float | None) -> Column:
    """The rate after the steps so far, as an expression over `posteriors`."""
    rate = F.lit(1.0)
    for step in steps:
        moved = sum((F.col("posteriors")[k] * F.lit(float(s)) for k, s in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - moved)
        rate = rate if most is None else F.least(F.lit(float(most)), rate)
    return rate


def fit_rates(
    rows: DataFrame, targets: np.ndarray, most: float | None = None, iterations: int = 15, tolerance: float = 1e-6
) -> list[np.ndarray]:
    """Steps of the projected gradient for `rows` (tokens, posteriors) towards the target totals."""
    d, steps = len(targets), []

    def measure(trial: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        p, r = F.col("posteriors"), F.col("_r")
        free = (r > 0) if most is None else (r > 0) & (r < most)
        moving = F.when(free, F.col("tokens")).otherwise(0)
        # a document at a bound may leave it: it counts a little, so that a step is always defined
        moving = moving + F.lit(1e-3) * F.col("tokens")
        sums = [F.sum(r * F.col("tokens") * p[i]) for i in range(d)]
        sums += [F.sum(moving * p[i] * p[j]) for i in range(d) for j in range(i, d)]
        out = np.array([float(v or 0) for v in rows.withColumn("_r", _rate(trial, most)).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()])
        gram = np.zeros((d, d))
        gram[np.triu_indices(d)] = out[d:]
        return out[:d], gram + np.triu(gram, 1).T

    total = max(1.0, float(np.abs(targets).sum()))
    reached, gram = measure(steps)
    for _ in range(iterations):
        residual = reached - targets
        if np.abs(residual).max() <= tolerance * total:
            break
        step = np.linalg.solve(gram + 1e-9 * max(1.0, np.trace(gram)) * np.eye(d), residual)
        for _ in range(6):  # shorter steps until the distance falls
            now, now_gram = measure([*steps, step])
            if np.square(now - targets).sum() < np.square(residual).sum():
                break
            step = step / 4
        else:
            break
        gained = 1 - np.square(now - targets).sum() / np.square(residual).sum()
        steps, reached, gram = [*steps, step], now, now_gram
        if gained < 1e-4:
            break
    return steps


def fit_limits(rows: DataFrame, fixed: Column, now: np.ndarray, share: np.ndarray, whole: int) -> list[np.ndarray]:
    """Steps for the rows that are not `fixed`, towards at most `share` of the tokens for every domain but `whole`.

    The total is that of the fixed rows where a domain may shrink, so it is not overstated and the limits hold.
    """
    d = len(now)
    base = [float(v or 0) for v in rows.filter(fixed).agg(*[F.sum(F.col("tokens") * F.col("posteriors")[k]).alias(f"s{k}") for k in range(d)]).first()]
    if base[whole] <= 0:
        return []
    above: list[int] = []
    while True:
        total = sum(base[k] for k in range(d) if k not in above) / max(1e-9, 1 - sum(share[k] for k in above))
        more = [k for k in range(d) if k != whole and k not in above and now[k] > share[k] * total]
        if not more:
            break
        above.append(max(more, key=lambda k: now[k] - share[k] * total))
    if not above:
        return []
    loose = rows.filter(~fixed).select("tokens", F.array(*[F.col("posteriors")[k] for k in above]).alias("posteriors"))
    targets = np.array([max(0.0, share[k] * total - base[k]) for k in above])
    steps = []
    for step in fit_rates(loose, targets, 1.0):
        steps.append(np.zeros(d))
        steps[-1][above] = step
    return steps


def mix(
    df: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    text: str = "text",
    doc_id: str = "doc_id",
    domain: str = "domain",
    total_tokens: float | None = None,
    max_rate: float | None = None,
    sample_rows: int = 6000,
    keep: list[str] | None = None,
    whole: str | None = None,
) -> DataFrame:
    """The columns `keep` (default: the id) of `df` with `tokens`, `posteriors`, `rate`, `copies`.

    `labelled` holds `doc_id` and a domain; `weights` gives every domain its share of the tokens (a
    domain not named weighs 0; shares are normalised). The targets add up to `total_tokens`, by default
    to the tokens of `df`; with `max_rate` they are scaled down so that no domain has to grow, and no
    rate exceeds it. `rate` is how often a document should occur on average, `copies` the whole number
    of times it does: the rate rounded up or down by a hash of id and text, so the mix repeats itself.
    Posteriors are in alphabetical order of the domains. Null and empty texts have no tokens and a rate
    like any other. With the domain `whole` the other shares are upper limits: documents most likely of that domain keep
    rate 1, only domains above their share shrink, `total_tokens` is not used, and without such documents all rates are 1.
    Repeated rows share rate and copies; without labels or weights all rates are 1; an
    empty table gives an empty table; other columns are ignored, whatever their names.
    """
    kept = [doc_id] if keep is None else keep
    model = learn_domains(df, labelled, text, doc_id, domain, sample_rows)
    source = df.withColumn("_draw", F.xxhash64(F.lit(29), F.col(doc_id), F.col(text)))
    model = model or DomainModel(["all"], [], *_nothing())
    rows = stored(add_posteriors(source, model, text, [*kept, "_draw"]))
    now = np.array([float(v or 0) for v in rows.agg(*[F.sum(F.col("tokens") * F.col("posteriors")[k]).alias(f"s{k}") for k in range(len(model.domains))]).first()])
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
    steps: list[np.ndarray] = []
    fixed = F.lit(False)
    if whole is not None:
        if whole in model.domains and share.sum() > 0:
            fixed = F.col("posteriors")[model.domains.index(whole)] >= F.array_max("posteriors")
            steps = fit_limits(rows, fixed, now, share / share.sum(), model.domains.index(whole))
    elif share.sum() > 0 and now.sum() > 0:
        share = share / share.sum()
        total = now.sum() if total_tokens is None else float(total_tokens)
        if max_rate is not None:
            total = min(total, min(max_rate * n / s for n, s in zip(now, share) if s > 0))
        steps = fit_rates(rows, total * share, max_rate)
    uniform = F.col("_draw").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    rate = F.when(fixed, 1.0).otherwise(_rate(steps, 1.0 if whole is not None else max_rate))
    return rows.withColumn("rate", rate).select(
        *kept, "tokens", "posteriors", "rate", F.floor(F.col("rate") + uniform).cast("int").alias("copies")
    )


def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = 2 * len(style.NAMES)
    return np.zeros(n), np.ones(n), np.zeros((n + 1, 1))
