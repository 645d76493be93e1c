import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.functions import prosody as P

SERIES = "s array<double>"


def test_summary_and_marker(value):
    s = value(P.summarize_f0("s"), SERIES, ([100.0, 112.0, 130.0],))
    assert s.asDict() == {
        "f0_mean": 114.0, "f0_std": 12.33, "f0_start": 100.0, "f0_end": 130.0, "f0_delta": 0.3, "f0_range": 30.0,
    }
    assert value(P.marker_of_series("s"), SERIES, ([100.0, 112.0, 130.0],)) == "<UP>"


def test_unvoiced_points_do_not_count(value):
    s = value(P.summarize_f0("s"), SERIES, ([0.0, None, 100.0, 30.0, 112.0, 130.0],))
    assert s.f0_mean == 114.0
    assert value(P.summarize_f0("s"), SERIES, ([100.0, None, 112.0],)) is None
    assert value(P.summarize_f0("s"), SERIES, ([],)) is None


@pytest.mark.parametrize(
    "summary,v2,v1",
    [
        ((100.0, None, None, None, -0.5, None), "<DOWN>", "<DOWN>"),
        ((100.0, 40.0, None, None, 0.0, None), "<WAVE>", "<KEEP>"),
        ((100.0, 10.0, None, None, 0.0, None), "<KEEP>", "<KEEP>"),
        ((100.0, None, None, None, 0.0, 60.0), "<WAVE>", "<WAVE>"),
        ((192.0, 41.0, None, None, -0.198, None), "<KEEP>", "<DOWN>"),
        ((0.0, 41.0, None, None, 0.06, None), "<UP>", "<KEEP>"),
        (None, None, None),
    ],
)
def test_marker_policies(value, summary, v2, v1):
    schema = f"p {schemas.PROSODY}"
    assert value(P.contour_marker("p", 2), schema, (summary,)) == v2
    assert value(P.contour_marker("p", 1), schema, (summary,)) == v1


@pytest.mark.parametrize(
    "start,end,a,b,want",
    [
        (0.0, 1.0, 0.2, 0.5, [2.0, 3.0, 4.0]),
        (0.0, 0.0, 0.2, 0.5, []),
        (0.0, 1.0, 0.5, 0.5, []),
        (0.0, 1.0, -3.0, 9.0, [float(i) for i in range(10)]),
        (0.0, 1.0, 0.25, 0.35, [2.0, 3.0]),
    ],
)
def test_slice(value, start, end, a, b, want):
    piece = P.slice_series("s", *[F.lit(x) for x in (start, end, a, b)])
    assert value(piece, SERIES, ([float(i) for i in range(10)],)) == want


MARKS = "t string, m array<struct<word:string,marker:string>>"


def test_word_marks(value):
    marks = [("밥", "<KEEP>"), ("뭇나", "<UP>")]
    assert value(P.apply_marks("t", "m"), MARKS, ("밥 뭇나", marks)) == "밥<KEEP> 뭇나<UP>"
    assert value(P.apply_marks("t", "m"), MARKS, ("밥  뭇나 나", marks)) == "밥  뭇나 나"
    assert value(P.marks_aligned("t", "m"), MARKS, ("밥 뭇나", marks)) is True
    assert value(P.marks_aligned("t", "m"), MARKS, ("밥 뭇나", [])) is False
    assert value(P.marks_aligned("t", "m"), MARKS, ("밥 뭇나", None)) is False
    assert value(P.render_marked("m"), MARKS, ("", [("밥", None), ("뭇나", "<UP>")])) == "밥 뭇나<UP>"


@pytest.mark.parametrize(
    "text,marker,want",
    [("밥 먹었나?", "<UP>", "밥 먹었나<UP>?"), (" 밥 ", "<UP>", "밥<UP>"), ("밥。", "<UP>", "밥<UP>。"), ("", "<UP>", ""), ("밥", None, "밥")],
)
def test_final_marker(value, text, marker, want):
    assert value(P.add_final_marker("t", "m"), "t string, m string", (text, marker)) == want


def test_strip_inverts_apply(value):
    marks = [("밥", "<KEEP>"), ("뭇나?", "<UP>")]
    marked = P.apply_marks("t", "m")
    assert value(P.strip_markers(marked), MARKS, ("밥 뭇나?", marks)) == "밥 뭇나?"
    assert value(P.strip_markers("t"), MARKS, ("  밥  <UP> 뭇나<WAVE>", None)) == "밥 뭇나"


def test_marked_words_without_enough_points(value):
    schema = "s array<double>, w array<struct<word:string,start_s:double,end_s:double>>"
    row = ([100.0, 110.0, 120.0, 90.0], [("a", 0.0, 3.0), ("b", 3.0, 4.0)])
    got = value(P.marked_words("s", F.lit(0.0), F.lit(4.0), "w"), schema, row)
    assert [(m.word, m.marker) for m in got] == [("a", "<UP>"), ("b", None)]
    assert got[1].prosody is None
