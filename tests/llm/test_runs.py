"""Periodic runs against a plain search of every period, on texts and on the query's whole table."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from helpers import SF, odd_documents

from pairloom.llm.queries import QUERIES
from pairloom.llm.runs import Grammar, periodic_runs, runs_of, word_ids


def plain_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by comparing every word with the one a period later."""
    _, x = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True) if words else (None, np.zeros(0, int))
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - start + q >= max(least, 2 * q):
                found.setdefault((start, stop - start + q), q)
    return sorted((s, n_words, q) for (s, n_words), q in found.items())


def plain_row(doc_id, text):
    """The contract of the query, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs([w.decode() for w in words])
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id,
        len(runs),
        *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
        digest(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_plain_search(spark):
    got = {tuple(r) for r in QUERIES["op12_runs"][0](spark, SF).select(*COLUMNS).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert got == {plain_row(*r) for r in rows}
    assert sum(r[1] > 0 for r in got) > len(rows) // 20


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.integers(1, 6)):
            n, k = int(rng.choice([0, 1, 7, 30, 150])), int(rng.choice([1, 2, 3, 20]))
            words = rng.integers(0, k, n)
            if n and rng.random() < 0.6:
                a = int(rng.integers(0, n))
                p = int(rng.integers(1, max(2, (n - a) // int(rng.integers(2, 6)) + 1)))
                words = words[np.where(np.arange(n) < a, np.arange(n), a + (np.arange(n) - a) % p)]
                words[rng.integers(0, n, 2)] = 0
            texts.append([b"%d" % w for w in words])
        least = int(rng.choice([2, 3, 5, 12, 20]))
        ids, ends = word_ids(texts)
        start, end, period = runs_of(ids, ends, least)
        wanted, base = [], 0
        for words in texts:
            wanted += [(s + base, s + base + length, q) for s, length, q in plain_runs([w.decode() for w in words], least)]
            base += len(words)
        assert list(zip(start.tolist(), end.tolist(), period.tolist())) == sorted(wanted, key=lambda r: (r[0], r[2]))


def test_fibonacci_words():
    """The densest runs there are: periods nest in each other."""
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    words = [c.encode() for c in b]
    ids, ends = word_ids([words])
    got = [(s, e - s, q) for s, e, q in zip(*(x.tolist() for x in runs_of(ids, ends, 2)))]
    assert got == plain_runs(list(b), 2)


def test_grammar_compresses():
    """No pair is left twice: a text of one word needs a few symbols, its places cover the whole text."""
    ids, ends = word_ids([[b"w"] * 4096, [b"x", b"y"] * 512])
    grammar = Grammar(ids, ends)
    assert grammar.size < 40 and grammar.counts.max() == 2048
    low, _, high = grammar.symbols
    assert {(0, 4096), (4096, 5120)} <= set(zip(low.tolist(), high.tolist()))


def test_odd_rows(spark):
    docs = odd_documents(spark).selectExpr("*", "1 AS runs_", "text AS words")
    rows = periodic_runs(docs, keep=["doc_id", "source"]).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[3].n_words, by_id[3].runs, by_id[3].collapsed) == (0, [], "")
    assert (by_id[5].n_words, by_id[5].collapsed) == (0, "")
    assert [tuple(r) for r in by_id[8].runs] == [(0, 30_000, 1)] and by_id[8].collapsed == "word"
    assert by_id[9].n_words == 1 and by_id[7].runs == []
    assert len([r for r in rows if r.doc_id == 2]) == 2
    assert periodic_runs(docs.limit(0), keep=["doc_id"]).collect() == []


def test_extra_columns_of_the_same_names(spark):
    docs = odd_documents(spark).selectExpr("doc_id", "text", "1 AS runs", "2 AS collapsed", "3 AS n_words")
    assert periodic_runs(docs, keep=["doc_id"]).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_least_must_allow_a_period(spark):
    with pytest.raises(ValueError):
        periodic_runs(odd_documents(spark), least=1)
