import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.functions import ngrams as N, overlap, text as X


def grams(items, n):
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def brute_chrf(pairs):
    ps, rs = [], []
    for n in range(1, 7):
        hyp = ref = match = 0
        for h, r in pairs:
            a, b = grams("".join(h.split()), n), grams("".join(r.split()), n)
            hyp += sum(a.values()) if b else 0
            ref += sum(b.values())
            match += sum((a & b).values())
        if hyp and ref:
            ps.append(match / hyp)
            rs.append(match / ref)
    if not ps or sum(ps) + sum(rs) == 0:
        return 0.0
    p, r = sum(ps) / len(ps), sum(rs) / len(rs)
    return 100 * 5 * p * r / (4 * p + r)


def brute_bleu(pairs):
    c = sum(len(h) for h, _ in pairs)
    r = sum(len(x) for _, x in pairs)
    logs, orders, halving, matched = 0.0, 0, 1.0, 0
    for n in range(1, 5):
        total = sum(sum(grams(h, n).values()) for h, _ in pairs)
        match = sum(sum((grams(h, n) & grams(x, n)).values()) for h, x in pairs)
        if not total:
            break
        matched += match
        orders += 1
        if match:
            logs += math.log(100 * match / total)
        else:
            halving *= 2
            logs += math.log(100 / (halving * total))
    if not matched or not c:
        return 0.0
    return (math.exp(1 - r / c) if c < r else 1.0) * math.exp(logs / orders)


def samples():
    rng = random.Random(11)
    words = ["가", "나다", "the", "on.", "x,", "𝒳y", "ab-c", "3-1", "가나다라마바사"]
    out = [("", ""), ("", "가"), ("가", ""), ("같다", "같다"), ("abc", "xyz"), ("a", "a b c d e")]
    for _ in range(120):
        mk = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        out.append((mk(), mk()))
    return out


def test_against_brute_force(spark):
    df = spark.createDataFrame(samples(), "h string, r string")
    rows = df.select(
        "h", "r", X.tokenize_13a("h").alias("th"), X.tokenize_13a("r").alias("tr"),
        N.chrf_stats("h", "r").alias("c"), N.bleu_stats("h", "r").alias("b"),
    )
    for x in rows.select("*", N.chrf_score("c").alias("chrf"), N.bleu_score("b").alias("bleu")).collect():
        assert x.chrf == pytest.approx(brute_chrf([(x.h, x.r)]), abs=1e-9), (x.h, x.r)
        assert x.bleu == pytest.approx(brute_bleu([(x.th.split(), x.tr.split())]), abs=1e-9), (x.h, x.r)
    corpus = rows.agg(N.sum_stats("c", N.CHRF_WIDTH).alias("c"), N.sum_stats("b", N.BLEU_WIDTH).alias("b"))
    got = corpus.select(N.chrf_score("c").alias("chrf"), N.bleu_score("b").alias("bleu")).first()
    assert got.chrf == pytest.approx(brute_chrf(samples()))
    tokens = [(x.th.split(), x.tr.split()) for x in rows.collect()]
    assert got.bleu == pytest.approx(brute_bleu(tokens))


def test_identity_and_disjoint(spark):
    df = spark.createDataFrame([("오늘은 날씨가 좋다", "오늘은 날씨가 좋다", "xyz")], "a string, b string, c string")
    got = df.select(
        N.chrf_stats("a", "b").alias("s1"), N.chrf_stats("a", "c").alias("s2"),
        N.bleu_stats("a", "b").alias("s3"), N.bleu_stats("a", "c").alias("s4"),
    ).select(N.chrf_score("s1"), N.chrf_score("s2"), N.bleu_score("s3"), N.bleu_score("s4")).first()
    assert tuple(got) == (pytest.approx(100.0), 0.0, pytest.approx(100.0), 0.0)


def test_empty_group_scores_zero(spark):
    df = spark.createDataFrame([], "h string, r string").select(N.chrf_stats("h", "r").alias("c"), N.bleu_stats("h", "r").alias("b"))
    summed = df.agg(N.sum_stats("c", N.CHRF_WIDTH).alias("c"), N.sum_stats("b", N.BLEU_WIDTH).alias("b"))
    assert tuple(summed.select(N.chrf_score("c"), N.bleu_score("b")).first()) == (0.0, 0.0)


def test_blocks_keep_whole_rows(monkeypatch):
    import pandas as pd

    pairs = samples()
    h, r = pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])
    whole = [list(x) for x in overlap.chrf_counts(h, r)]
    monkeypatch.setattr(overlap, "_SYMBOLS_PER_BLOCK", 20)
    assert [list(x) for x in overlap.chrf_counts(h, r)] == whole


def test_null_texts_count_as_empty(spark):
    df = spark.createDataFrame([(None, "가나"), ("가나", None)], "h string, r string")
    assert [sum(r.c) for r in df.select(N.chrf_stats("h", "r").alias("c")).collect()] == [3, 0]
    assert df.select(F.sum(F.get(N.bleu_stats("h", "r"), 0)).alias("n")).first().n == 1


def test_bleu_kernel_takes_texts_with_runs_of_blanks():
    """The columns in front of it need not even the blanks out."""
    wide, even = pd.Series(["  a　 b \x1c c ", " \n ", ""]), pd.Series(["a b c", "", ""])
    ref = pd.Series(["a b d", "x", ""])
    assert [list(x) for x in overlap.bleu_counts(wide, ref)] == [list(x) for x in overlap.bleu_counts(even, ref)]
    assert list(overlap.bleu_counts(wide, ref)[0])[:4] == [3, 3, 3, 2]


def test_grams_by_one_sort_are_those_by_ranks(monkeypatch):
    """One pass over a block for all n, if its symbols fit into a word; ranks order by order for any alphabet."""
    rng = random.Random(3)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 6, 40])))
    wide = [chr(k) for k in range(0xAC00, 0xAC00 + 3000)]
    hyp = [text("ab é\ud800") for _ in range(300)] + [text(wide) for _ in range(300)]
    ref = [x if k % 3 == 0 else x[1:] + x[:2] if k % 3 == 1 else text("ab c") for k, x in enumerate(hyp)]
    used, kinds = [], {}
    for name in ("_sort_grams", "_rank_grams"):
        kinds[name] = getattr(overlap, name)
        monkeypatch.setattr(overlap, name, lambda *a, name=name: used.append(name) or kinds[name](*a))
    h, r = pd.Series(hyp), pd.Series(ref)
    got = [list(x) for part in (slice(0, 300), slice(300, 600)) for x in overlap.chrf_counts(h[part], r[part])]
    assert used == ["_sort_grams", "_rank_grams"]
    for a, b, counts in zip(hyp, ref, got, strict=True):
        for n in range(1, 7):
            x, y = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (a, b))
            assert counts[3 * n - 3 : 3 * n] == [x.total() if y else 0, y.total(), (x & y).total()]
    monkeypatch.setattr(overlap, "_sort_grams", kinds["_rank_grams"])
    assert [list(x) for x in overlap.chrf_counts(h[:300], r[:300])] == got[:300]


def test_places_without_a_match_are_not_ranked_again(monkeypatch):
    """Texts that share one word of three: only its places are looked at in longer n-grams."""
    sizes, factorize = [], pd.factorize
    monkeypatch.setattr(overlap.pd, "factorize", lambda x: sizes.append(len(x)) or factorize(x))
    monkeypatch.setattr(overlap, "_sort_grams", overlap._rank_grams)
    h, r = pd.Series(["abc xyz", "", "abcd"]), pd.Series(["abc uvw", "a", "abcd"])
    counts = [list(x) for x in overlap.chrf_counts(h, r)]
    assert sizes[1:] == [23, 14, 10, 6, 2]
    assert counts[0][:12] == [7, 7, 4, 6, 6, 3, 5, 5, 2, 4, 4, 1] and counts[0][12:] == [3, 3, 0, 2, 2, 0]
    assert counts[1] == [0, 1, 0] + [0] * 15 and counts[2] == [4, 4, 4, 3, 3, 3, 2, 2, 2, 1, 1, 1] + [0] * 6
