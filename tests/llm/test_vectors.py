import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import reachable
from pairloom.llm.topk import top_k
from pairloom.llm.vectors import near_duplicate_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def clustered(seed, n=600, dim=16):
    """Tight and loose clusters, copies, and noise."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim)) * rng.choice([0.05, 0.25, 1.0], (n, 1))
    x[50:60] = x[49]
    return x.astype(np.float32), rng.integers(0, 3, n)


ODD = [
    (5000, None, 1), (5001, [], 1), (5002, [0.0] * 16, 1), (5003, [float("nan")] + [1.0] * 15, 1), (5004, [None] + [1.0] * 15, 1),
    (5005, [float("inf")] + [1.0] * 15, 1), (5006, [1.0] * 16, None), (None, [1.0] * 16, 1), (5008, [1.0] * 3, 1), (5009, [1.0] * 3, 1),
    (5010, [1e-30] * 16, 2), (5010, [1e-30] * 16, 2), (5011, [2e-30] * 16, 2),
]


@pytest.fixture(scope="module")
def table(spark):
    x, label = clustered(3)
    rows = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows + ODD, SCHEMA).withColumn("node", F.lit("clash")).withColumn("component", F.lit(1))


def plain_links(rows):
    fit = [
        r for r in rows
        if r[0] is not None and r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])
    ]
    fit = list({r[0]: r for r in fit}.values())
    unit = [np.array(r[1], dtype=float) / np.linalg.norm(np.array(r[1], dtype=float)) for r in fit]
    near = np.array([[a[2] == b[2] and len(u) == len(v) and a[0] != b[0] and u @ v >= 0.93 for b, v in zip(fit, unit)] for a, u in zip(fit, unit)])
    order = sorted(range(len(fit)), key=lambda k: fit[k][0])
    near = near[np.ix_(order, order)]
    ids = [fit[k][0] for k in order]
    root = reachable(len(ids), lambda i: np.flatnonzero(near[i]).tolist())
    return {i: (int(near[k].sum()), ids[root[k]]) for k, i in enumerate(ids)}


def test_near_duplicates_against_brute_force(spark, table):
    rows = near_duplicate_vectors(table, window=32).collect()
    assert len(rows) == table.count()
    expected = plain_links([tuple(r)[:3] for r in table.collect()])
    for r in rows:
        links, component = expected.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id, r.kept) == (links, component, None if r.vec_id is None else r.vec_id == component)
    assert near_duplicate_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_on_planted_groups(spark, n):
    """Pairs, small groups and one large group around random centres, among as many vectors without a partner."""
    rng = np.random.default_rng(n)
    sizes = [n // 10, *rng.integers(2, 9, n // 16).tolist()]
    rows = []
    for size in sizes:
        centre = rng.normal(size=64)
        rows += [(centre + rng.normal(size=64) * rng.choice([0.05, 0.15, 0.22]) * np.linalg.norm(centre) / 8) for _ in range(size)]
    rows += list(rng.normal(size=(max(0, n - len(rows)), 64)))
    df = spark.createDataFrame([(i, x.astype(np.float32).tolist(), i % 2) for i, x in enumerate(rows)], "vec_id bigint, embedding array<float>, label int")
    expected = plain_links_fast(df.collect())
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df).collect()}
    assert sum(got.values()) >= 0.99 * sum(expected.values()) > 0 and all(got[k] <= v for k, v in expected.items())


def plain_links_fast(rows):
    out = {}
    for label in {r.label for r in rows}:
        own = [r for r in rows if r.label == label]
        x = np.array([r.embedding for r in own], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out |= {r.vec_id: int(n) - 1 for r, n in zip(own, (x @ x.T >= 0.93).sum(axis=1))}
    return out


def plain_top(rows, k=10):
    fit = {}
    for r in rows:
        if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]):
            fit[r[0]] = [int(np.floor(1024 * float(v))) for v in r[1]]
    out = set()
    for q, x in fit.items():
        if q % 100 == 0:
            sums = ((sum(a * b for a, b in zip(x, y)), i) for i, y in fit.items() if i != q and len(x) == len(y))
            scored = sorted((-max(min(s, 2**63 - 1), -(2**63)), i) for s, i in sums)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("group,block", [(8192, 4096), (50, 3)])
def test_top_k_against_brute_force(spark, table, group, block):
    found = top_k(table, F.col("vec_id") % 100 == 0, group=group, query_block=block)
    assert {tuple(r) for r in found.collect()} == plain_top([tuple(r)[:2] for r in table.collect()])


def test_top_k_ties_few_rows_and_huge_values(spark):
    rows = [(k, [1.0, 0.0]) for k in range(0, 14)] + [(100, [3e30, -3e30]), (101, [2e30, 1e30])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == plain_top([(k, np.float32(v).tolist()) for k, v in rows])
    assert top_k(df.filter("vec_id IN (0, 3)"), F.col("vec_id") == 0).count() == 1
    assert top_k(df.limit(0), F.lit(True)).count() == 0
