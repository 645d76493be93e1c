import json
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.plans import jobs
from pairloom.plans.catalog import CATALOG
from pairloom.plans.catalog.ingest import SCAN_FOLDERS
from pairloom.session import ensure_checkpoint_dir
from pairloom.sources import tables, transcripts as T
from pairloom.streaming.incremental import append_sentences


def seg(dialect, standard=None, start="00:00:00.100", end="00:00:00.500", **more):
    return {"dialect": dialect, "standard": standard, "startTime": start, "endTime": end, **more}


def sentence(standard, dialect, number="1", start="00:00:00.000", end="00:00:01.000", pitch=()):
    return {
        "sentenceId": number, "startTime": start, "endTime": end,
        "standard": standard, "dialect": dialect, "intonations": list(pitch),
    }


def document(sentences, segments=(), name="say_sample", **annotation):
    return {
        "fileName": name,
        "transcription": {"sentences": sentences, "segments": list(segments)},
        "annotation": {"intents": [], "emotions": [], **annotation},
    }


GOLDEN_PATH = "/x/TL_01._강원도_01._1인발화_자유발화/Training/say_sample.json"


@pytest.fixture(scope="module")
def parse(spark):
    def run(doc, path=GOLDEN_PATH):
        text = doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False)
        return T.parse(spark.createDataFrame([(path, text)], "path string, content string")).collect()

    return run


def test_golden_document(parse):
    doc = document(
        [sentence("밥 먹었니?", "밥 먹었니?", pitch=[100.0, 118.0, 140.0])],
        [seg("밥"), seg("먹었니?", start="00:00:00.600", end="00:00:00.900")],
    )
    (row,) = parse(doc)
    assert (row.id, row.do, row.split, row.speech_kind) == ("say_sample_1", "gangwondo", "train", "say")
    assert row.is_identical is True
    assert row.dialect_eojeol_map == []
    assert row.prosody_marker == "<UP>"
    assert [w.word for w in row.dialect_eojeol_prosody] == ["밥", "먹었니?"]
    assert (row.intent, row.emotion, row.error) == (None, None, None)


def entries(row):
    return [(e.standard_idx, e.dialect_idx, e.standard, e.dialect) for e in row.dialect_eojeol_map]


def test_alignment_one_to_one_and_many_to_one(parse):
    doc = document(
        [sentence("그거 가 버리고 나는 갔다", "그거 가삐고 내는 갔어예")],
        [seg("그거"), seg("가삐고", "가 버리고"), seg("내는 갔어예", "나는 갔다", pronunciation="x")],
    )
    (row,) = parse(doc)
    assert entries(row) == [(1, 1, "가 버리고", "가삐고"), (3, 2, "나는", "내는"), (4, 3, "갔다", "갔어예")]
    assert [e.pronunciation for e in row.dialect_eojeol_map] == [None, "x", "x"]


def test_alignment_moves_past_repeats_and_skips_misses(parse):
    doc = document(
        [sentence("가 나 가 다", "가 나 거 다")],
        [seg("가"), seg("거", "가"), seg("없다", "가"), seg("다", "다라"), seg(" ", ""), seg("다")],
    )
    (row,) = parse(doc)
    # the second 가 is found after the first; a form missing on either side adds nothing
    assert entries(row) == [(2, 2, "가", "거")]


def test_alignment_with_an_empty_side(parse):
    (row,) = parse(document([sentence("가 나", "가 음 나")], [seg("가"), seg("음", "")]))
    assert entries(row) == [(1, 1, "", "음")]


def test_segments_belong_to_their_sentence(parse):
    doc = document(
        [sentence("가 나", "거 나", "1"), sentence("다", "더", "2", "00:00:02.000", "00:00:03.000")],
        [seg("거", "가", "00:00:01.010"), seg("더", "다", "00:00:02.500"), seg("나", None, None)],
    )
    first, second = parse(doc)
    assert entries(first) == [(0, 0, "가", "거")]  # end + 0.01 still counts
    assert entries(second) == [(0, 0, "다", "더")]


def test_annotation_takes_the_first_hit(parse):
    tags = [{"sentenceId": "2", "tagType": "a"}, {"sentenceId": "1", "tagType": "b"}, {"sentenceId": "1", "tagType": "c"}]
    (row,) = parse(document([sentence("가", "거")], intents=tags))
    assert (row.intent, row.emotion) == ("b", None)


@pytest.mark.parametrize(
    "doc,error",
    [
        (document([sentence("", "거"), sentence("가", "  ")]), T.EMPTY),
        (document([sentence("가", "거", start=None)]), "sentence without valid time or number"),
        (document([sentence("가", "거"), sentence("가", "거", end="1:2")]), "sentence without valid time or number"),
        (document([sentence("가", "거", number="x")]), "sentence without valid time or number"),
        (document([sentence("가", "거")], [seg("거", start="0:0")]), "segment with malformed time"),
        ("[1, 2]", T.EMPTY),
        ("{\"fileName\": \"x\"", T.EMPTY),
        ("{}", T.EMPTY),
        ("", T.EMPTY),
    ],
)
def test_dead_letters_fail_whole(parse, doc, error):
    (row,) = parse(doc)
    assert (row.error, row.split, row.standard) == (error, "failed", None)
    assert row.file == GOLDEN_PATH


def test_blank_sentences_and_null_segment_start_are_no_error(parse):
    doc = document([sentence(None, None, start=None), sentence(" 가 ", "거\n")], [seg("거", "가", start=None)])
    (row,) = parse(doc)
    assert (row.standard, row.dialect, row.error) == ("가", "거", None)
    assert row.dialect_eojeol_map == []


GOOD = json.dumps(document([sentence("가", "거")]), ensure_ascii=False)


@pytest.mark.parametrize(
    "damaged",
    [
        GOOD[:-1] + ", }",
        GOOD[:-1] + ",}",
        GOOD.replace("]}", ",  ]}", 1).replace("[ ,", "["),
        GOOD.replace('"', "'"),
        GOOD.replace('"sentenceId": "1",', '"sentenceId": 1.,'),
        GOOD.replace('}, "annotation"', '}, , "annotation"'),
        "\ufeff" + GOOD,
        GOOD.replace("{", "{\n\t"),
        GOOD[:-1] + ",\n}",
    ],
)
def test_repair(parse, damaged):
    (row,) = parse(damaged)
    assert (row.standard, row.dialect, row.error) == ("가", "거", None)


@pytest.mark.parametrize(
    "path,region,split,kind",
    [
        ("/a/VL_02._경상도_01/Validation/Training/st_1.json", "gyeongsangdo", "valid", "read"),
        ("/a/TL_제주도_x/talk_1.json", "jejudo", "unknown", "talk"),
        ("/a/_평안도_/Training/other.json", "평안도", "train", "unknown"),
        ("/a/b.json", "unknown", "unknown", "unknown"),
    ],
)
def test_path_metadata(value, path, region, split, kind):
    got = [value(f("p"), "p string", (path,)) for f in (T.path_region, T.path_split, T.path_speech_kind)]
    assert got == [region, split, kind]


def test_timecode(value):
    assert value(T.seconds("t"), "t string", ("01:02:03.5",)) == 3723.5
    for bad in ("1:2", "a:b:c", None, ""):
        assert value(T.seconds("t"), "t string", (bad,)) is None


LEGACY = {
    "utterance": [
        {
            "id": "u.1",
            "standard_form": "그것도 (쫌)/(조금) 많이",
            "dialect_form": "그것도 (쫌)/(조금) 마이",
            "eojeolList": [
                {"id": 1, "eojeol": "#마이", "standard": "많이"},
                {"id": 2, "eojeol": "그것도", "standard": None},
            ],
        },
        {"id": "u.2", "standard_form": "(())", "dialect_form": "{laughing}", "eojeolList": []},
    ]
}
LEGACY_PATH = "/r/한국어 방언 발화(전라도)/Training/a.json"


def legacy(spark, doc, path=LEGACY_PATH):
    text = doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False)
    return T.parse_legacy(spark.createDataFrame([(path, text)], "path string, content string")).collect()


def test_legacy_document(spark):
    (row,) = legacy(spark, LEGACY)
    assert (row.id, row.do, row.split, row.speech_kind) == ("u.1", "jeollado", "train", "read")
    assert (row.standard, row.dialect) == ("그것도 조금 많이", "그것도 쫌 마이")
    assert [(e.idx, e.dialect, e.standard) for e in row.dialect_eojeol_map] == [(1, "마이", "많이")]
    assert (row.prosody, row.intent, row.error) == (None, None, None)


def test_legacy_failures(spark):
    assert legacy(spark, LEGACY, LEGACY_PATH.replace("Training", "Test"))[0].error == "no such split: test"
    assert legacy(spark, {"other": []})[0].error == T.EMPTY
    broken = json.loads(json.dumps(LEGACY))
    broken["utterance"][0]["eojeolList"][0]["id"] = "x"
    assert legacy(spark, broken)[0].error == "word list without valid ids"


def corpus(root):
    for folder, name, text in (
        ("TL_01._강원도_01/Training", "say_a.json", GOOD),
        ("TL_01._강원도_01/Validation", "st_b.json", GOOD),
        ("TL_01._강원도_01/Test", "st_c.json", GOOD),
        ("TL_01._강원도_01/Training", "say_bad.json", "{"),
        ("TL_01._강원도_01/Training", "note.txt", GOOD),
    ):
        target = root / folder
        target.mkdir(parents=True, exist_ok=True)
        (target / name).write_text(text, encoding="utf-8")


def test_corpus_build(spark, tmp_path):
    corpus(tmp_path / "raw")
    out = str(tmp_path / "table")
    built = jobs.build_corpus(spark, str(tmp_path / "raw"), out)
    assert sorted((r.split, r.do) for r in built.collect()) == [("train", "gangwondo"), ("valid", "gangwondo")]
    assert [c for c in built.columns] == list(T.SENTENCE_COLUMNS)
    (dead,) = tables.load_dead_letters(spark, out).collect()
    assert dead.file.endswith("say_bad.json") and dead.error == T.EMPTY
    assert spark.read.json(out + "_failed_files").count() == 1
    manifest = tables.read_manifest(spark, out)
    assert manifest["source_format"] == "new" and manifest["prosody_marker_policy"]["version"] == 2
    plan = tables.load_sentences(spark, out, ["train"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*split", plan)


def test_build_from_a_sample_is_repeatable(spark, tmp_path):
    corpus(tmp_path)
    files = T.scan(spark, str(tmp_path))
    picks = [{r.path for r in T.sample_files(files.repartition(n), 2, seed=7).collect()} for n in (1, 3)]
    assert picks[0] == picks[1] and len(picks[0]) == 2


def test_sampled_build(spark, tmp_path):
    corpus(tmp_path / "raw")
    paths = T.sample_paths(spark, str(tmp_path / "raw"), 2, seed=3)
    assert len(paths) == 2 and paths == T.sample_paths(spark, str(tmp_path / "raw"), 2, seed=3)
    jobs.build_corpus(spark, str(tmp_path / "raw"), str(tmp_path / "t"), sample=2, seed=3)
    assert spark.read.parquet(str(tmp_path / "t")).select("file").distinct().count() == 2


def test_no_files_is_an_error(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        T.scan(spark, str(tmp_path / "empty"))


def test_other_encodings(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(GOOD.encode("utf-16"))
    (row,) = T.parse(T.scan(spark, str(tmp_path), encoding="utf-16")).collect()
    assert row.standard == "가"


def test_stream_appends_new_files_once(spark, tmp_path):
    corpus(tmp_path / "raw")
    args = (spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "progress"))
    append_sentences(*args).awaitTermination(120)
    (tmp_path / "raw" / "TL_01._제주도_01" / "Training").mkdir(parents=True)
    (tmp_path / "raw" / "TL_01._제주도_01" / "Training" / "talk_d.json").write_text(GOOD, encoding="utf-8")
    append_sentences(*args).awaitTermination(120)
    rows = tables.load_sentences(spark, str(tmp_path / "out")).collect()
    assert sorted((r.do, r.split) for r in rows) == [("gangwondo", "train"), ("gangwondo", "valid"), ("jejudo", "train")]
    assert tables.load_dead_letters(spark, str(tmp_path / "out")).count() == 1


def test_parsed_schema_is_the_declared_one(spark):
    empty = spark.createDataFrame([], "path string, content string")
    want = spark.createDataFrame([], schemas.SENTENCES).dtypes
    assert T.sentences(T.parse(empty)).dtypes == want
    assert T.sentences(T.parse_legacy(empty)).dtypes == want


def test_decoding_happens_once_per_file(spark):
    files = spark.createDataFrame([("p", GOOD)], "path string, content string")
    plan = T.parse(files).filter(F.col("error").isNull())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2  # the strict and the repaired form, not one per field


@pytest.mark.parametrize("after", ['{"x": 1}', " garbage }", ', {"x": 1}', "\n}", ' {"x": 1} }'])
def test_text_behind_the_document_is_a_dead_letter(parse, after):
    (row,) = parse(GOOD + after)
    assert (row.error, row.standard) == (T.EMPTY, None)


def test_an_end_time_counts_only_where_it_is_read(parse):
    given = sentence("가", "거")
    outside = [{"startTime": "90:00:00.000", "endTime": "1:2", "dialect": "거"}, {"startTime": None, "endTime": "1:2", "dialect": "거"}]
    blank = [{"startTime": given["startTime"], "endTime": "1:2", "dialect": " "}]
    for segments in (outside, blank):
        (row,) = parse(document([given], segments))
        assert (row.standard, row.error) == ("가", None)
    (row,) = parse(document([given], [{"startTime": given["startTime"], "endTime": "1:2", "dialect": "거"}]))
    assert row.error == "segment with malformed time"


def clock(seconds):
    return f"{int(seconds) // 3600:02d}:{int(seconds) // 60 % 60:02d}:{seconds % 60:06.3f}"


def test_long_recording_takes_its_own_segments(parse):
    """100,000 segments out of order and 10,000 sentences: the segments of each sentence, in the document's order."""
    n, per = 100_000, 10
    order = sorted(range(n), key=lambda i: (i * 7919) % n)
    segments = [seg(f"w{i}", standard=f"s{i}", start=clock(i / 10), end=clock(i / 10 + 0.05)) for i in order]
    sentences = [
        sentence(" ".join(f"s{i}" for i in own), " ".join(f"w{i}" for i in own), number=str(k), start=clock(own[0] / 10), end=clock(own[-1] / 10))
        for k in range(n // per)
        for own in [sorted(range(per * k, per * k + per), key=lambda i: (i * 7919) % n)]
        for own in [sorted(own)]
    ]
    began = time.time()
    rows = parse(document(sentences, segments))
    assert len(rows) == n // per and time.time() - began < 60
    place = {i: k for k, i in enumerate(order)}
    for r in rows[:: n // per // 50]:
        k = int(r.id.rsplit("_", 1)[1])
        own = sorted(range(per * k, per * k + per), key=place.get)
        spoken, at = [], -1
        for i in own:  # one pointer forward through the sentence, in the order of the document
            if i > at:
                spoken.append((i - per * k, f"w{i}"))
                at = i
        assert [(e.standard_idx, e.dialect) for e in r.dialect_eojeol_map] == spoken


@pytest.mark.parametrize("n", [5, 32, 33, 500])
def test_interval_search_equals_the_filter(spark, n):
    segments = [float((i * 37) % 50) / 4 for i in range(n)] + [-1.0]
    df = spark.createDataFrame([([(x,) for x in segments],)], "g array<struct<at: double>>")
    bounds = [(0.0, 3.0), (3.0, 2.0), (-2.0, 100.0), (12.25, 12.25), (50.0, 60.0), (2.99, 3.24), (-1.0, -1.0)]
    for low, high in bounds:
        near = T.segments_between(F.col("g"), T.starts_of(F.col("g")), F.lit(low), F.lit(high))
        assert [x.at for x in df.select(near.alias("n")).first().n] == [x for x in segments if low <= x <= high + 0.01]


def test_first_annotation_of_an_id_counts(parse, spark):
    tags = [{"sentenceId": str(i % 40), "tagType": f"t{i}"} for i in range(200)] + [{"sentenceId": None, "tagType": "none"}, {"tagType": "later"}]
    rows = parse(document([sentence("a", "b", number=str(k)) for k in (0, 7, 39, 40)], intents=tags))
    assert [r.intent for r in rows] == ["t0", "t7", "t39", None]
    items = spark.createDataFrame([([(None, "x"), ("b", "y"), (None, "z"), ("", "e")],)], "i array<struct<sentenceId: string, tagType: string>>")
    found = [T.tag_of(T.tags_by_id(F.col("i")), F.lit(k).cast("string")) for k in (None, "b", "", "a")]
    assert list(items.select(*found).first()) == ["x", "y", "e", None]


def test_scan_query_keeps_many_files_in_a_folder(spark, tmp_path):
    """A folder per document took longer to make and to list than its file; copies of a name are one file."""
    turns = [(c, t, "user", f"Words of {c}. And {t}.") for c in range(150) for t in range(4)]
    spark.createDataFrame(turns + turns[:1], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    top = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.iterdir())
    rows = CATALOG["ing01_scan"].run(spark, str(tmp_path)).collect()
    (made,) = [p for p in top.iterdir() if p not in before]
    assert sorted((r.name, r.documents) for r in rows) == sorted((f"{c}_{t}", 1) for c, t, *_ in turns)
    assert len([p for p in made.iterdir() if p.is_dir()]) <= SCAN_FOLDERS < len(turns) == len(list(made.rglob("*.txt")))


def test_scan_query_writes_no_second_file_per_document(spark, tmp_path):
    """Checksum files doubled the files of the corpus, and their modes were set by processes of their own."""
    turns = [(c, t, "user", f"Words of {c}. And {t}.") for c in range(20) for t in range(3)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    top = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.iterdir())
    rows = CATALOG["ing01_scan"].run(spark, str(tmp_path)).collect()
    (made,) = [p for p in top.iterdir() if p not in before]
    assert sorted((r.name, r.documents) for r in rows) == sorted((f"{c}_{t}", 1) for c, t, *_ in turns)
    assert [p.suffix for folder in made.iterdir() if folder.is_dir() for p in folder.iterdir()] == [".txt"] * len(turns)
