import pytest
from pyspark.sql import functions as F

from pairloom.functions import scores as S
from pairloom.operators import metrics as M

ROW = (
    "run string, id int, gen string, rev string, standard string, dialect string, direction string, do string, "
    "dialect_eojeol_map array<struct<standard:string,dialect:string>>, probs array<double>, nll double, pred_label int"
)
MAP = [("갔다", "갔어예")]


def row(gen, standard="나는 갔다", dialect="나는 갔어예", word_map=MAP, direction="std2dia", **more):
    base = {"run": "r", "id": 1, "rev": "", "do": "jejudo", "probs": [0.5, 0.0, 0.0, 0.0, 0.3, 0.2], "nll": 4.0, "pred_label": 4}
    base.update(more)
    base.update(gen=gen, standard=standard, dialect=dialect, direction=direction, dialect_eojeol_map=word_map)
    return base


@pytest.fixture(scope="module")
def score(spark):
    def run(column, needs=(), **fields):
        df = S.prepare(spark.createDataFrame([row(**fields)], ROW), needs)
        return df.select(column.alias("v")).first().v

    return run


@pytest.mark.parametrize(
    "gen,word_map,want",
    [
        ("나는 갔다. 그리고 갔어예!", MAP, 0.3),
        ("나는 갔어예.", MAP, 1.0),
        ("나는 갔다", [], 1.0),
        ("나는 갔소", [], 0.2),
        ("나는 갔다 ", None, 1.0),
        ("나는", [("", "갔어예"), (None, "x")], 0.5),
        ("나는", [("갔다", "")], 0.7),
        ("나는 가", [("갔다", "가"), ("갔다", "거"), ("나는", "가")], 0.7 * 2 / 3 + 0.3 * 2 / 3),
    ],
)
def test_edit(score, gen, word_map, want):
    assert score(S.edit(), gen=gen, word_map=word_map) == pytest.approx(want)


def test_edit_precision_and_recall(score):
    text = {"standard": "나는 어제 갔다", "dialect": "나는 어제 갔어예"}
    assert score(S.edit_precision(), gen="나는 어쩨 갔어예", **text) == 0.5
    assert score(S.edit_precision(), gen="x", standard="갔다", dialect="y") == 1.0
    assert score(S.edit_precision(), gen="나는", word_map=None, standard="나는 갔다") == 0.5
    assert score(S.edit_recall(), gen="나는 갔어예") == 1.0
    assert score(S.edit_recall(), gen="나는") == 0.0
    assert score(S.edit_recall(), gen="나는", word_map=None) == 1.0


def test_length(score):
    decay = S.length(max_ratio=1.5, tolerance=0.0)
    assert score(decay, gen="가" * 12, standard="x" * 10, dialect="나" * 10) == pytest.approx(0.6)
    assert score(S.length(), gen="가나다라마바사아", standard="WXYZ", dialect="가나다라") == 0.0
    assert score(S.length(), gen="가나다", standard="가나다", dialect="가", direction="dia2std") == 1.0
    assert score(S.length(), gen=" ", dialect="") == 1.0
    assert score(S.length(), gen="a", dialect="") == 0.0
    with pytest.raises(ValueError):
        S.length(max_ratio=1.2, tolerance=0.2)


def test_copy_margin_and_overcorrection(score):
    close = {"standard": "나는 학교에 간다", "dialect": "나는 핵교에 간다"}
    margin, over = S.copy_margin(), S.overcorrection()
    echo = score(margin, ["copy_margin"], gen=close["standard"], **close)
    gold = score(margin, ["copy_margin"], gen=close["dialect"], **close)
    assert echo < 0.5 < gold
    assert score(margin, ["copy_margin"], gen="같다", standard="같다", dialect="같다") == 0.5
    assert score(over, ["overcorrection"], gen=close["standard"], **close) == 1.0
    assert score(over, ["overcorrection"], gen=close["dialect"], **close) == pytest.approx(1.0)
    assert score(over, ["overcorrection"], gen="전혀 다른 말이다", **close) < 1.0
    assert score(S.content(), ["content"], gen=close["standard"], direction="dia2std", **close) == pytest.approx(1.0)


def test_style_and_fluency(score):
    assert score(S.style(), gen="x") == pytest.approx(-0.2)
    assert score(S.style(), gen="x", direction="dia2std") == pytest.approx(0.2)
    with pytest.raises(Exception, match="unknown region"):
        score(S.style(), gen="x", do="seoul")
    assert score(S.fluency(), gen="a b") == pytest.approx(0.36787944)
    assert score(S.fluency(), gen=" ") == 0.0
    assert score(S.fluency(), gen="a") == 0.5
    with pytest.raises(ValueError):
        S.fluency(scale=0)


def test_reconstruction(score):
    got = score(S.reconstruction(), ["reconstruction"], gen="x", rev="나는 갔다")
    assert got == pytest.approx(1.0)
    assert score(S.reconstruction(), ["reconstruction"], gen="x", rev=" ") == 0.0


def test_rescale(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (3.0,)], "x double")
    assert [r.v for r in df.select(S.rescale("x", -1, 1).alias("v")).collect()] == [0.0, 0.5, 1.0, 1.0]
    assert [r.v for r in df.select(S.rescale("x", 1, 1).alias("v")).collect()] == [-1.0, 0.0, 1.0, 3.0]


def test_registry():
    columns = ROW.replace(",", " ").split()
    built, weights = S.build_scores([*columns, "_chrf_gold"])
    assert list(built) == ["style", "content"] and weights == {"style": 1.0, "content": 0.5}
    with pytest.raises(ValueError, match="unknown score"):
        S.build_scores(columns, [("nope", 1.0)])
    with pytest.raises(ValueError, match="needs the columns"):
        S.build_scores(["gen"], [("style", 1.0)])
    S.register_score("two", lambda: F.lit(2.0))
    assert list(S.build_scores([], [("two", 0.5)])[0]) == ["two"]
    del S.REGISTRY["two"]


def test_joint_harmonic(value):
    axes = {"a": F.col("a"), "b": F.col("b")}
    joint = S.joint_harmonic(axes, {"a": 1.0, "b": 3.0})
    assert value(joint, "a double, b double", (1.0, 0.0)) == pytest.approx(4 / (1 / 1.1 + 3 / 0.1))
    with pytest.raises(ValueError):
        S.joint_harmonic(axes, {}, normalized=False)


def test_group_scores(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (1, 3.0, 0.0), (2, 5.0, 1.0)], "g int, a double, b double")
    rows = M.group_normalized_sum(df, ["g"], {"a": 2.0, "b": 1.0}, eps=0.0001).collect()
    got = sorted((r.g, r.a, round(r.advantage, 3)) for r in rows)
    assert got == [(1, 1.0, -1.414), (1, 3.0, 1.414), (2, 5.0, 0.0)]
    assert sorted(r.g for r in M.incomplete_groups(df, ["g"], 2).collect()) == [2]
    summed = {(r.g, r.a): r.advantage for r in M.summed_advantage(df, ["g"], {"a": 1.0, "b": 1.0}).collect()}
    assert summed[(1, 1.0)] == pytest.approx(-0.7071, abs=1e-3)


# ---- corpus metrics ------------------------------------------------------------------------


def test_all_metrics_perfect_and_empty(spark):
    rows = [row("나는 갔어예", id=i, rev="나는 갔다") for i in range(3)]
    df = spark.createDataFrame(rows, ROW)
    (got,) = M.metrics_by(M.row_stats(df), ["do", "run"]).collect()
    assert (got.n, got.exact_match, got.tdr, got.eojeol_accuracy) == (3, 3, 1.0, 1.0)
    assert got.chrf == pytest.approx(100.0) and got.bleu == pytest.approx(100.0)
    assert got.reconstruction_bleu == pytest.approx(100.0)
    assert got.copy_margin == pytest.approx(got.chrf - got.chrf_source)
    whole = M.metrics_by(M.row_stats(df.filter("false")), []).first()
    assert (whole.n, whole.bleu, whole.chrf, whole.eojeol_accuracy) == (0, 0.0, 0.0, 0.0)


def test_word_accuracy_does_not_strip_punctuation(spark):
    df = spark.createDataFrame([row("나는 갔어예."), row("나는 갔어예")], ROW)
    hits, total = M.word_hits()
    assert [tuple(r) for r in df.select(hits, total).collect()] == [(0, 1), (1, 1)]


def test_post_strip_removes_markers(spark):
    df = spark.createDataFrame([row("나는 갔어예<UP>", rev="나는 갔다<KEEP>")], ROW)
    (got,) = M.metrics_by(M.row_stats(df, post_strip=True), ["run"]).collect()
    assert got.exact_match == 1 and got.reconstruction_bleu == pytest.approx(100.0)


def test_fidelity_sign(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.1], [0.0, 1.0])], "out_emb array<double>, dia_emb array<double>, std_emb array<double>")
    assert df.select(M.fidelity_term().alias("v")).first().v > 0
    swapped = df.select(M.fidelity_term(dia="std_emb", std="dia_emb").alias("v")).first().v
    assert swapped < 0


def test_jscore_and_remap(value):
    assert value(M.remap_unit(F.lit(5.0), 0.0, 10.0)) == 0.5
    assert value(M.remap_unit(F.lit(5.0), 3.0, 3.0)) == 0.5
    assert value(M.remap_unit(F.lit(-9.0), 0.0, 1.0)) == 1e-6
    perfect = M.jscore(F.lit(1.0), F.lit(100.0), F.lit(1.0), F.lit(1.0))
    assert value(perfect) == pytest.approx(1.0)
    assert value(M.jscore(F.lit(1.0), F.lit(50.0), F.lit(1.0), F.lit(1.0), content_is_margin=False)) == pytest.approx(0.5**0.25)


def test_gold_run_and_samples(spark):
    rows = [row(f"g{i}", id=i, run=r, standard=f"문장 {i}", dialect=f"문쟝 {i}", do="gangwondo") for i in range(4) for r in ("a", "b")]
    df = spark.createDataFrame(rows, ROW)
    gold = M.with_gold_run(df, "a")
    assert gold.filter("run = 'GOLD' and gen = dialect").count() == 4
    shown = M.samples_by_bucket(df, ["a", "b"], 2).collect()
    assert sorted((r.bucket_key, r.id, r.gen_a, r.gen_b) for r in shown) == [("gangwon_small", 0, "g0", "g0"), ("gangwon_small", 1, "g1", "g1")]


def test_token_accuracy(spark):
    rows = [("r", 1, 0, 5, 0.1, -100), ("r", 1, 1, 6, 0.2, 5), ("r", 1, 2, 9, 0.4, 7), ("r", 1, 3, 0, 0.9, -100)]
    df = spark.createDataFrame(rows, "run string, id int, pos int, pred int, entropy double, label int")
    (got,) = M.token_accuracy(df, ["run"]).collect()
    assert (got.n, got.token_accuracy, got.mean_entropy) == (2, 0.5, pytest.approx(0.15))
