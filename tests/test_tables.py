import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.functions import chat
from pairloom.operators import ordering as O
from pairloom.operators import builders as B, curation as C
from pairloom.plans import jobs
from pairloom.sources import tables

PAIR = "id int, standard string, dialect string, do string, is_identical boolean, split string"


def pairs(spark, rows, split="train"):
    full = [(i, s, d, do, s == d, split) for i, (s, d, do) in enumerate(rows)]
    return spark.createDataFrame(full, PAIR)


def test_identical_flag_and_comparison(spark):
    flagged = spark.createDataFrame([("a", "a", None), ("a", "b", True), ("a", "a", False)], "standard string, dialect string, is_identical boolean")
    assert [tuple(r)[:2] for r in C.drop_identical(flagged).collect()] == [("a", "a"), ("a", "a")]
    plain = flagged.drop("is_identical")
    assert [tuple(r) for r in C.drop_identical(plain).collect()] == [("a", "b")]


def test_classifier_gates(spark):
    rows = pairs(
        spark,
        [
            ("밥 먹자", "밥 묵자 마", "gyeongsangdo"),
            ("뭐라 카노 진짜", "뭐라 하노 그래", "gyeongsangdo"),  # standard side carries a marker
            ("같은 말이다", "같은 말이다", "jejudo"),
            ("아주 긴 문장이 여기에 있습니다 그래요", "아주 긴 문장이 여기에 있습니다 그래유", "jeollado"),
            ("먼 곳의 말", "머언 디의 말", "pyeongando"),  # unsupported region: standard only
            ("다른 말", "밥 먹자", "jejudo"),  # its dialect text is a standard text elsewhere
        ],
    )
    got = {(r.text, r.label) for r in C.classifier_table(rows).collect()}
    assert got == {
        ("밥 묵자 마", 2), ("뭐라 하노 그래", 2), ("같은 말이다", 0),
        ("아주 긴 문장이 여기에 있습니다 그래요", 0), ("먼 곳의 말", 0), ("다른 말", 0),
    }
    (report,) = C.gate_report(rows).collect()
    assert report.asDict() == {
        "split": "train", "n_built": 8, "n_identical": 1, "n_near_standard": 1, "n_polluted": 1,
        "n_collisions": 2, "n_downsampled": 0, "n_left": 6,
    }


def test_collisions_stay_within_a_split_and_duplicates_stay(spark):
    rows = pairs(spark, [("가나다", "라마바", "jejudo"), ("가나다", "사아자", "jejudo")]).unionByName(
        pairs(spark, [("차카타", "가나다", "jejudo")], "valid")
    )
    table = C.classifier_table(rows)
    assert table.filter("split = 'train' and text = '가나다'").count() == 2
    assert table.filter("split = 'valid' and text = '가나다'").count() == 1


def labelled(spark, counts, split="train"):
    rows = [(i, "dialect", f"{label}-{i}", label, split) for label, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "id int, side string, text string, label int, split string")


@pytest.mark.parametrize(
    "counts,cap,ratio,want",
    [
        ({0: 50, 1: 10, 2: 4}, None, 1.5, {0: 15, 1: 10, 2: 4}),
        ({0: 50, 1: 10, 2: 4}, 6, 1.5, {0: 6, 1: 6, 2: 4}),
        ({0: 50}, None, 2.0, {}),
        ({0: 5, 1: 10}, None, 2.0, {0: 5, 1: 10}),
    ],
)
def test_class_caps(spark, counts, cap, ratio, want):
    rows = labelled(spark, counts).unionByName(labelled(spark, {0: 9}, "valid"))
    out = C.downsample(rows, cap, ratio)
    got = {r.label: r["count"] for r in out.filter("split = 'train'").groupBy("label").count().collect()}
    assert got == want
    assert out.filter("split = 'valid'").count() == 9
    assert out.distinct().count() == out.count()


def test_caps_are_the_smallest_hashes(spark):
    """The sample is that of a plain ranking, also at cut points inside a bucket."""
    rows = labelled(spark, {0: 3000, 1: 700})
    ranked = rows.withColumn("k", O.hash_key(42, "id", "label")).toPandas().sort_values(["k", "id"])
    out = C.downsample(rows, 500, None).toPandas()
    for label in (0, 1):
        assert set(out[out.label == label].id) == set(ranked[ranked.label == label].id.head(500))


def test_caps_hold_with_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "dialect", f"t{i}", 1, "train") for i in range(30)], "id int, side string, text string, label int, split string")
    out = C.downsample(rows.unionByName(labelled(spark, {0: 40})), 7, None)
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0: 7, 1: 7}


def test_no_text_is_shuffled(spark):
    rows = labelled(spark, {0: 400, 1: 100}).repartition(3)
    out = C.curate(rows, True, 50, 1.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan  # what needs a shuffle reads the narrow checkpoint only
    assert out.filter("label = 0").count() == 50


def test_class_weights(spark):
    rows = labelled(spark, {0: 6, 2: 2})
    balanced = {r.label: r.weight for r in C.class_weights(rows).collect()}
    assert balanced == {0: pytest.approx(9 / 18), 1: pytest.approx(3.0), 2: pytest.approx(1.5)}
    inverse = [r.weight for r in C.class_weights(rows, "inverse").collect()]
    assert sum(inverse) == pytest.approx(3.0)
    with pytest.raises(ValueError):
        C.class_weights(rows, "other")


def test_class_count(spark):
    assert C.class_count(labelled(spark, {0: 1, 5: 1})).first().num_labels == 6
    assert C.class_count(labelled(spark, {0: 1}).filter("false")).first().num_labels == 1


def test_region_slice_rejects_negative(spark):
    rows = pairs(spark, [("a", "b", "jejudo")]).withColumn("direction", F.lit("std2dia"))
    with pytest.raises(ValueError):
        C.region_slice(rows, -1)
    assert C.region_slice(rows, 5).count() == 1
    assert C.region_slice(rows, 0).count() == 0


def test_prompt_budget(spark):
    prompts = spark.createDataFrame([("a b c",), ("a b c d",)], "prompt string")
    assert [r.fits for r in C.within_length(prompts, 21, 10).collect()] == [True, False]
    by_chars = C.within_length(prompts, 23, 10, length=F.length("prompt"))
    assert [r.fits for r in by_chars.collect()] == [True, False]


def test_sft_fan_out(spark):
    rows = pairs(spark, [("나는 간다", "나는 가예", "gyeongsangdo"), ("밥 먹자", "밥 묵자", "gangwondo")])
    both = B.sft_table(rows, output_mode="structured")
    assert both.count() == 4
    assert set(both.columns) == {"id", "split", "source", "target", "do", "direction"}
    one = B.sft_table(rows, output_mode="structured", both_directions=False)
    assert one.count() == 2 and {r.direction for r in one.collect()} == {"std2dia"}
    for bad in ({"output_mode": "x"}, {"marker_mode": "x"}):
        with pytest.raises(ValueError):
            B.sft_table(rows, **bad)
    assert {c for m in ("all", "completion", "assistant") for c in B.for_loss(both, m).columns} == {
        "id", "split", "text", "prompt", "completion", "messages",
    }
    with pytest.raises(ValueError):
        B.for_loss(both, "none")


def test_sentence_markers_and_coverage(spark):
    schema = "standard string, dialect string, do string, is_identical boolean, prosody_marker string, split string"
    rows = spark.createDataFrame(
        [
            ("가", "밥 먹었나?", "jejudo", False, "<UP>", "train"),
            ("나", "다", "jejudo", False, None, "train"),
            ("같다", "같다", "jejudo", True, "<UP>", "train"),
            ("라", "마", "unknown", False, "<UP>", "train"),
            ("라", "마", "unknown", False, "<UP>", "valid"),
        ],
        schema,
    )
    out = B.sft_table(rows, output_mode="structured", include_prosody=True, both_directions=False)
    assert sorted(r.target for r in out.collect()) == ["다", "밥 먹었나<UP>?"]
    got = {r.split: tuple(r)[1:] for r in B.marker_coverage(rows).collect()}
    assert got == {"train": (2, 1, 1, 0.5), "valid": (0, 0, 0, 0.0)}
    (counts,) = B.fallback_counts(rows, "sentence").collect()
    assert (counts.total_rows, counts.fallback_rows) == (2, 1)


def test_prompts(value):
    prompt = chat.user_prompt("s", "d", "x")
    schema = "s string, d string, x string"
    assert value(prompt, schema, ("밥 먹자", "jejudo", "std2dia")) == "다음 문장을 제주도 사투리로 바꿔줘:\n밥 먹자"
    assert value(prompt, schema, ("밥", "seoul", "dia2std")) == "다음 seoul 사투리를 표준어로 바꿔줘:\n밥"
    cue = chat.render_chat(chat.prompt_messages("s", "d", "x"), True)
    assert value(cue, schema, ("밥", "jejudo", "std2dia")).endswith("밥\n[assistant]")
    with pytest.raises(ValueError):
        chat.system_prompt("nope")
    chat.register_template("short", "x")
    assert chat.system_prompt("short") == "x"


def sentence_rows(spark, n=6):
    rows = [
        (
            f"f_{i}", "jejudo", "train" if i % 3 else "valid", "say", f"나는 {i} 간다", f"내는 {i} 감수다 게", False, [],
            (100.0, 10.0, 100.0, 120.0, 0.2, 20.0), "<UP>", [], None, None,
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, schemas.SENTENCES)


def test_stage_job_and_manifest_gate(spark, tmp_path):
    raw = str(tmp_path / "raw")
    tables.write_by_split(sentence_rows(spark), raw)
    with pytest.raises(FileNotFoundError):
        jobs.build_training_tables(spark, raw, str(tmp_path / "out"), marker_mode="sentence")
    tables.write_manifest(spark, raw, {"source_format": "new"})
    with pytest.raises(ValueError, match="no prosody_marker_policy"):
        jobs.build_training_tables(spark, raw, str(tmp_path / "out"), marker_mode="sentence")
    tables.write_manifest(spark, raw, {"prosody_marker_policy": {"version": 1}})
    with pytest.raises(ValueError, match="version"):
        jobs.build_training_tables(spark, raw, str(tmp_path / "out"), marker_mode="sentence")
    tables.write_manifest(spark, raw, {"prosody_marker_policy": {"version": 2}})
    written = jobs.build_training_tables(spark, raw, str(tmp_path / "out"), marker_mode="sentence")
    counts = {name: spark.read.parquet(path).count() for name, path in written.items()}
    assert counts == {"sft": 12, "grpo": 6, "classifier": 12}
    manifest = tables.read_manifest(spark, written["sft"])
    assert manifest["prosody_marker_coverage"]["train"]["marked_rows"] == 4


def test_mark_table(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "marked")
    tables.write_by_split(sentence_rows(spark).withColumn("prosody_marker", F.lit(None).cast("string")), raw)
    marked = jobs.mark_table(spark, raw, out)
    assert {r.prosody_marker for r in marked.collect()} == {"<UP>"}
    assert tables.read_manifest(spark, out)["marker_distribution"]["train"] == {"<UP>": 4}
    with pytest.raises(ValueError):
        B.add_marker_column(marked.drop("prosody"))


def test_no_window_over_a_group_beyond_the_group_limit(spark):
    """Up to the limit Spark keeps n rows a task; above it the windows are over ranges of a group, and the setting stays."""
    from pairloom.operators.ordering import GROUP_LIMIT, first_per_group

    df = spark.range(20_000).selectExpr("id", "id % 3 AS g")
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(first_per_group(df, ["g"], ["id"], 500))
    before = spark.conf.get(GROUP_LIMIT, "1000")
    top = first_per_group(df, ["g"], ["id"], 5_000)
    windows = [line for line in plan(top).split("\n") if "Window [row_number()" in line]
    assert windows and all("_part" in line for line in windows)
    assert top.count() == 15_000 and spark.conf.get(GROUP_LIMIT, "1000") == before


def test_shuffled_head_is_a_distributed_top_n(spark):
    from pairloom.operators.curation import shuffled_head
    from pairloom.operators.ordering import hash_key

    df = spark.range(3_000)
    want = {r.id for r in df.orderBy(hash_key(42, "id"), "id").limit(700).collect()}
    got = shuffled_head(df, 700)
    assert {r.id for r in got.collect()} == want and got.columns == ["id"]
    assert shuffled_head(df, 0).count() == 0 and shuffled_head(df, 5_000).count() == 3_000


def test_views_keep_every_character_of_their_tables(spark):
    from pyspark.sql import functions as F

    from pairloom.plans import views as V

    sf = "/root/testdata/sf0.001"
    letters = lambda c: F.coalesce(F.sum(F.length(F.regexp_replace(c, r"[ \t\n\f\r]", ""))), F.lit(0))
    for view, name in ((V.pairs, "documents"), (V.gold, "conversations")):
        whole = V.table(spark, sf, name).agg(letters(F.col("text"))).first()[0]
        kept = view(spark, sf).agg(letters(F.col("standard"))).first()[0]
        assert kept == whole > 0
    hangul = V.pairs(spark, sf).filter(F.col("standard").rlike("[가-힣]")).count()
    assert hangul > 0.2 * V.pairs(spark, sf).count()
