import importlib.util
import pathlib

from helpers import DOCS

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_each_row_is_judged_on_its_own(spark):
    spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
    pipeline = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    texts = [
        "the first text tells of rivers and hills far in the north", "an unlike second one counts ships that left the harbour at dawn",
        "nobody knows a third story about seven clocks in a tower", "quiet gardens grow behind every fourth house along this road",
    ]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[2]), (None, texts[3]), (None, texts[0])]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    left = sorted((r.doc_id or 0, r.text) for r in pipeline.near_dedup(spark, df, "").collect())
    assert left == sorted([(1, texts[0]), (2, texts[1]), (3, texts[2]), (0, texts[3])])
