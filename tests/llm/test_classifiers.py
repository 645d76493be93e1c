import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF, odd_documents
from pairloom.llm import langid, mixing, quality
from pairloom.llm.queries import QUERIES, domains, table
from pairloom.llm.rows import crc_of

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def languages(spark):
    return QUERIES["op6_language"][0](spark, BIG).cache()


def test_language_accuracy_on_held_out_rows(spark, languages):
    truth = table(spark, BIG, "documents").select("doc_id", "lang", (crc_of("doc_id") % 4 == 2).alias("_out"))
    rows = languages.join(truth, "doc_id").collect()
    assert len(rows) == truth.count() and all(r.held_out == r._out and 0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.97


def test_convolution_tables_equal_the_plain_sum():
    rng = np.random.default_rng(1)
    net = langid.ByteNet([rng.normal(size=(w, 256, 4)) for w in (1, 2, 3, 4, 5)], rng.normal(size=20), rng.normal(size=(20, 2)), np.zeros(2), ["a", "b"])
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    best = []
    for t in net.tables:
        out = [sum(t[k][x[:, p + k]] for k in range(len(t))) for p in range(langid.WINDOW - len(t) + 1)]
        best.append(np.max(out, axis=0))
    expected = np.maximum(np.concatenate(best, axis=1) + net.bias, 0)
    assert np.allclose(langid.pooled(x, net.pair_tables(), net.bias), expected, atol=1e-4)
    texts = [b"", b"abc", b"y" * 1000]
    windows, owner, filled = langid.windows_of(texts)
    assert owner.tolist() == [0, 1, 2, 2, 2, 2] and filled.tolist() == [1, 3, 256, 256, 256, 232]
    assert windows[owner == 2].tobytes().rstrip(b"\0") == texts[2]


def test_language_of_odd_rows(spark):
    df = odd_documents(spark).withColumnRenamed("source", "score").withColumnRenamed("n_chars", "_windows")
    rows = langid.identify(df, F.lit(True)).collect()
    assert len(rows) == df.count() and set(rows[0].asDict()) == set(df.columns) | {"lang_pred"}
    for r in rows:
        unknown = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == unknown and 0 <= r.score <= 1 and (r.score == 0) == unknown
    assert {r.lang_pred for r in langid.identify(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op10_quality"][0](spark, BIG).join(table(spark, BIG, "labels"), "doc_id", "left").collect()
    assert len(rows) == table(spark, BIG, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.quality, r.score) for r in rows if r.held_out and r.quality is not None]
    good, bad = ([s for q, s in held if q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    above = [r.score for r in rows if r.above_cut]
    assert 0.85 <= len(above) / len(rows) <= 1 and min(above) >= max([r.score for r in rows if not r.above_cut], default=0)


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", (crc_of("doc_id") % 5 == 0).alias("out"))
    labels = table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(crc_of("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score_quality(docs, x, ~F.col("out")).collect()} for x in (labels, turned))
    assert a == b


def test_pairwise_fit_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    good = x @ [2.0, -1.0, 0.0] + rng.normal(size=400) * 0.5 > 0
    w = quality.bradley_terry(x[good], x[~good], 5000)
    assert np.corrcoef(x @ w, x @ [2.0, -1.0, 0.0])[0, 1] > 0.98
    slope, offset = quality.calibrated(x @ w, good)
    p = 1 / (1 + np.exp(-(slope * (x @ w) + offset)))
    assert abs(p.mean() - good.mean()) < 0.02
    one = np.array([True, True, False])
    assert all(np.isfinite(quality.calibrated(np.array([5.0, 4.0, -9.0]), one)))


def test_quality_of_odd_rows(spark):
    df = odd_documents(spark).withColumnRenamed("source", "quality").withColumnRenamed("n_chars", "_features")
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (6, 0), (8, 0), (None, 1), (9, None)], "doc_id bigint, quality int")
    rows = quality.score_quality(df, labels, F.lit(True)).collect()
    assert len(rows) == df.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    none = quality.score_quality(df, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    assert {r.score for r in quality.score_quality(df, labels.filter("quality = 1"), F.lit(True)).collect()} == {1.0}
    assert quality.score_quality(df.limit(0), labels, F.lit(True)).count() == 0


def plain_rates(tokens, p, targets, most=None, steps=20_000):
    """Projected gradient with tiny fixed steps, from 1."""
    r = np.ones(len(tokens))
    gram = (p * tokens[:, None]).T @ p
    for _ in range(steps):
        r = np.clip(r - 0.5 / np.linalg.eigvalsh(gram)[-1] * (p @ ((r * tokens) @ p - targets)), 0, most)
    return r


@pytest.mark.parametrize("most", [None, 1.0])
def test_rates_reach_the_targets(spark, most):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    tokens = rng.integers(1, 500, 300)
    now = tokens @ p
    targets = now * ([0.9, 0.2, 0.5] if most else [1.5, 0.2, 0.7])
    df = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens bigint, posteriors array<double>")
    rate = mixing._rate(mixing.fit_rates(df, targets, most), most)
    got = np.array([r[0] for r in df.select(rate).collect()])
    assert got.min() >= 0 and (most is None or got.max() <= most)
    assert np.abs((got * tokens) @ p - targets).max() < 1e-3 * targets.sum()
    plain = plain_rates(tokens.astype(float), p, targets, most)
    assert np.abs((plain * tokens) @ p - targets).max() < 1e-2 * targets.sum()


def test_mixing_query_meets_its_shares(spark):
    rows = QUERIES["op8_mixing"][0](spark, BIG).collect()
    assert len(rows) == table(spark, BIG, "documents").count()
    totals = sum(r.rate * r.tokens * np.array(r.posteriors) for r in rows)
    assert np.allclose(totals / totals.sum(), [0.93, 0.05, 0.02], atol=0.005)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 and abs(sum(r.posteriors) - 1) < 1e-9 for r in rows)
    drawn = sum(r.copies * r.tokens for r in rows)
    assert abs(drawn / sum(r.rate * r.tokens for r in rows) - 1) < 0.05


def test_mixing_of_odd_rows(spark):
    df = odd_documents(spark).withColumnRenamed("source", "rate").withColumnRenamed("n_chars", "domain")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 1, 0), (6, 0, 0), (8, None, 1), (9, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = mixing.mix(df, domains(labels), {"clean": 1, "junk": 1}).collect()
    assert len(rows) == df.count() and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert [r.tokens for r in rows if r.doc_id in (3, 4, 5)] == [0, 0, 0]
    assert {r.rate for r in mixing.mix(df, domains(labels.limit(0)), {"clean": 1}).collect()} == {1.0}
    assert {r.rate for r in mixing.mix(df, domains(labels), {}).collect()} == {1.0}
    assert mixing.mix(df.limit(0), domains(labels), {"clean": 1}).count() == 0
