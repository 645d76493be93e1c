import random
import re

import numpy as np
import xxhash

from helpers import SF, odd_documents, reachable
from pairloom.llm import simhash as S
from pairloom.llm.components import components
from pairloom.llm.queries import QUERIES


def plain(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check(rows, docs):
    prints = np.array([plain(t) for _, t in docs], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    root = reachable(len(docs), lambda i: np.flatnonzero(near[i]).tolist())
    lowest = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            lowest[root[k]] = min(i, lowest.get(root[k], i))
    expected = sorted((str(i), f"{int(prints[k]):016x}", lowest[root[k]]) for k, (i, _) in enumerate(docs) if i is not None)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows if r.doc_id is not None) == expected


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(QUERIES["op5_simhash"][0](spark, SF).collect(), docs)


def test_odd_rows(spark):
    df = odd_documents(spark).withColumnRenamed("lang", "_fp").withColumnRenamed("source", "node")
    rows = S.near_duplicates(df).collect()
    assert len(rows) == df.count()
    check(rows, [(r.doc_id, r.text) for r in df.collect()])
    zero = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert {r.fingerprint for r in zero} == {"0" * 16} and {r.component_id for r in zero} == {3}
    assert S.near_duplicates(df.limit(0)).count() == 0


def spread(n=1500):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(20)]
    out = set()
    while len(out) < n:
        x = rnd.choice(base)
        for b in rnd.sample(range(64), rnd.randint(0, 7)):
            x ^= 1 << b
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def test_bit_sliced_comparison():
    fps = spread(700)
    distance = np.bitwise_count(fps[:, None] ^ fps[None, :])
    for radius in (1, 3, 4, 6):
        i, j = S.close_pairs(fps, fps, radius)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))
    sizes = [1, 2, 60, 1, 65, 5, 130, 2, 200]
    run = np.repeat(np.arange(len(sizes)), sizes)
    room = np.array([(run[k + 1 :] == run[k]).sum() for k in range(len(run))])
    i, j = S.close_neighbours(fps[: len(run)], room, 4)
    near = (distance[: len(run), : len(run)] <= 4) & (run[:, None] == run[None, :])
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))))


def test_hot_keys_in_chunks_lose_no_link(spark):
    fps = spread()
    nodes = spark.createDataFrame([(k, int(x)) for k, x in enumerate(fps.view(np.int64).tolist())], "node bigint, _fp bigint")
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    expected = reachable(len(fps), lambda i: np.flatnonzero(near[i]).tolist())
    found = {r.node: r.component for r in components(S.near_links(nodes, 4, chunk=40)).collect()}
    assert [found.get(k, k) for k in range(len(fps))] == expected


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 3), (2, 1), (9, 8), (8, 7), (7, 20), (30, None)] + [(100 + k, 101 + k) for k in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 7, 8: 7, 7: 7, 20: 7} | {100 + k: 100 for k in range(61)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
