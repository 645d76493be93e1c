"""Ranked search against a plain ranking of every document for every item."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import SF, odd_documents

from pairloom.llm import ranked
from pairloom.llm.queries import OP13_SQL, QUERIES
from pairloom.llm.ranked import ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k=10):
    """(item id, rank, doc id, score) by scoring all documents."""
    held = [(d, plain_terms(t)) for d, t in docs]
    held = [(d, len(t), Counter(t)) for d, t in held if t]
    n_docs, length = len(held), sum(n for _, n, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, n, tf in held:
            m = 25 + (75 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in plain_terms(text)
                if t in tf
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def same(found, wanted):
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def test_query_against_sql(spark):
    got = {tuple(r) for r in QUERIES["op13_ranked"][0](spark, SF).collect()}
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        assert got == set(db.sql(OP13_SQL).fetchall()) and got


def test_terms():
    text = "Don't STOP_me\x00now – 12x É Ü z\x7fÀb~[İ]"
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)
    assert terms_of(None) == [] and terms_of(b" -\x1f") == []


@pytest.fixture(scope="module")
def clustered():
    """Topics with words of their own, some very common words, many copies, and many equal lengths."""
    rng = np.random.default_rng(5)
    docs = []
    for i in range(3000):
        topic = int(rng.integers(0, 40))
        n = int(rng.choice([20, 20, 20, 60, 200]))
        words = [f"t{topic}w{w}" if rng.random() < 0.4 else f"c{w % 9}" for w in rng.zipf(1.6, n) % 60]
        docs.append((i, " ".join(words)))
    docs += [(10_000 + i, docs[7][1]) for i in range(1500)]
    items = [(j, docs[j * 11][1]) for j in range(30)]
    return docs, items


def test_pruned_search_is_exact(spark, clustered):
    docs, items = clustered
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    report: dict = {}
    got = ranked_search(d.repartition(6), i, report=report)
    same(got.collect(), plain_ranking(docs, items))
    assert 0 < report["scored"] < report["pairs"] // 2  # bounds leave over half of the (piece, item) pairs out


def test_items_in_groups_and_whole_numbers(spark, clustered, monkeypatch):
    """Several groups of items, small blocks, and sums beyond exact doubles give the same rows."""
    docs, items = clustered[0][:400], clustered[1][:12]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(ranked, "ITEMS_AT_ONCE", 5)
    monkeypatch.setattr(ranked, "ITEM_BLOCK", 2)
    monkeypatch.setattr(ranked, "CELLS", 100)
    monkeypatch.setattr(ranked, "EXACT", 1.0)
    same(ranked_search(d, i, k=3).collect(), plain_ranking(docs, items, 3))


def test_odd_rows(spark):
    docs = odd_documents(spark).selectExpr("*", "1 AS score", "2 AS rank", "3 AS _item", "4 AS n")
    items = [(1, "the CAT word word 中文 no"), (1, "the CAT word word 中文 no"), (None, "dog"), (3, None), (4, ""), (5, "!"), (6, "absent")]
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "text AS doc_id", "1 AS _row")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(ranked_search(docs, asked).collect(), plain_ranking(rows, items))
    assert ranked_search(docs.limit(0), asked).collect() == []
    empty = ranked_search(docs, asked.limit(0))
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search(docs.filter("doc_id IN (3, 4, 5)"), asked).collect() == []


def test_ids_of_other_types_and_names(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "x")], "name string, body string")
    items = spark.createDataFrame([("q", "x")], "ask string, body string")
    got = ranked_search(docs, items, "name", "body", "ask", "body", k=2)
    assert got.columns == ["ask", "rank", "name", "score"]
    same(got.collect(), plain_ranking([tuple(r) for r in docs.collect()], [("q", "x")], 2))
