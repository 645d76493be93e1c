import random
import string

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as X

CLEAN = [
    ("그것도 (쫌)/(조금) 군살이 (쫌)/(조금) 많이 붙어가지구", "standard", "그것도 조금 군살이 조금 많이 붙어가지구"),
    ("그것도 (쫌)/(조금) 군살이 (쫌)/(조금) 많이 붙어가지구", "dialect", "그것도 쫌 군살이 쫌 많이 붙어가지구"),
    ("더 일하는(()) 분들이 와", "standard", "더 일하는 분들이 와"),
    ("&name& {laughing}", "standard", ""),
    ("달걀만 갖고는 쫌) 부족(하드라고", "dialect", "달걀만 갖고는 쫌 부족하드라고"),
    ("#아 그래~", "dialect", "아 그래~"),
    ("  가  나　", "standard", "가 나"),
    (None, "standard", ""),
    ("", "dialect", ""),
]


@pytest.mark.parametrize("raw,side,clean", CLEAN)
def test_clean_transcript(value, raw, side, clean):
    assert value(X.clean_transcript("t", side), "t string", (raw,)) == clean


def test_clean_rejects_unknown_side():
    with pytest.raises(ValueError):
        X.resolve_dual("t", "both")


def test_words(value):
    assert value(X.normalize_word("t"), "t string", ('"갔어".',)) == "갔어"
    got = value(X.word_set("t"), "t string", ("내가 갔어, 집에.",))
    assert set(got) == {"내가", "갔어", "집에"}
    assert value(X.words("t"), "t string", (" a b\x1cc ",)) == ["a", "b", "c"]
    assert value(X.words("t"), "t string", ("  ",)) == []


def test_completion_text(spark):
    forms = spark.createDataFrame(
        [("x", [("assistant", "y")], ("assistant", "z")), ("w", [], None)],
        "s string, l array<struct<role:string,content:string>>, m struct<role:string,content:string>",
    )
    got = forms.select(*[X.completion_text(forms, c).alias(c) for c in "slm"]).collect()
    assert [tuple(r) for r in got] == [("x", "y", "z"), ("w", "", "")]


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_distances_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [("abcd", "abce"), ("", "abc"), ("a", "a"), ("", ""), ("가나다", "가나라")]
    for _ in range(300):
        a = "".join(rng.choice("ab가") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            b.insert(rng.randint(0, len(b)), rng.choice(string.ascii_lowercase))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    thresholds = (0.05, 0.1, 0.25, 0.5, 1.0)
    near = [X.closer_than("a", "b", t).alias(f"n{i}") for i, t in enumerate(thresholds)]
    for r in df.select("a", "b", X.norm_levenshtein("a", "b").alias("d"), X.edit_bucket("a", "b").alias("k"), *near).collect():
        d = lev(r.a, r.b)
        norm = 0.0 if r.a == r.b else 1.0 if not r.a or not r.b else d / max(len(r.a), len(r.b))
        assert r.d == pytest.approx(norm)
        assert [r[f"n{i}"] for i in range(len(thresholds))] == [norm < t for t in thresholds]
        assert r.k == ("small" if d <= 3 else "med" if d <= 8 else "large")


def test_long_texts_and_every_band(spark):
    rng = random.Random(8)
    pairs = []
    for n in (1, 2, 31, 33, 399, 1200):
        a = "".join(rng.choice("ab가나𝒳") for _ in range(n))
        b = "".join(c for c in a if rng.random() > 0.05) + "끝"
        pairs += [(a, b), (b, a), (a, a), (a, ""), (a, "".join(rng.choice("abc") for _ in range(n)))]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", X.norm_levenshtein("a", "b").alias("d"), X.closer_than("a", "b", 0.1).alias("n")).collect()
    for r in got:
        d = lev(r.a, r.b) if r.a and r.b else None
        want = 0.0 if r.a == r.b else 1.0 if d is None else d / max(len(r.a), len(r.b))
        assert r.d == pytest.approx(want) and r.n == (want < 0.1)
    assert not any("Python" in line for line in df.select(X.norm_levenshtein("a", "b"))._jdf.queryExecution().toString().splitlines())
    skipped = df.select(X.edit_distance("a", "b", only_if=F.lit(False)).alias("d")).collect()
    assert all(r.d is None for r in skipped)


def test_marker_predicate(value):
    assert value(X.carries_marker("t"), "t string", ("뭐라 카노 진짜",)) is True
    assert value(X.carries_marker("t"), "t string", ("안녕하세요 반갑습니다",)) is False


def test_region_group(value):
    got = [value(X.region_group("t"), "t string", (d,)) for d in ("Gangwondo", "gyeongsangdo", "jejudo")]
    assert got == ["gangwon", "gyeongsang", "other"]


def test_changed_words_needs_equal_counts(value):
    row = ("나는 갔다", "나는 갔어예")
    got = value(X.changed_words("a", "b"), "a string, b string", row)
    assert [tuple(e) for e in got] == [("갔다", "갔어예")]
    assert value(X.changed_words("a", "b"), "a string, b string", ("a b", "a")) == []


def test_word_difference(value):
    assert value(X.word_difference("a", "b"), "a string, b string", ("a b c", "a x")) == 2


def test_tokenizer_13a(value):
    assert value(X.tokenize_13a("t"), "t string", ("Hi, a-b 3.5 2-1 &quot;x&quot;!",)) == 'Hi , a-b 3.5 2 - 1 " x " !'


def test_bind_evaluates_to_the_same(value):
    assert value(X.bind(F.col("x") + 1, lambda v: v * v), "x int", (3,)) == 16
