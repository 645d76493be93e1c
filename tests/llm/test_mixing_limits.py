import importlib.util
import pathlib

from helpers import SF
from pairloom.llm.mixing import mix
from pairloom.llm.queries import MIX, domains, table

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_pipeline_keeps_clean_documents_without_toxic_ones(spark):
    spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
    pipeline = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    kinds = domains(table(spark, SF, "labels"))
    docs = table(spark, SF, "documents").join(kinds, "doc_id").filter("domain = 'clean'").select(*pipeline.COLUMNS)
    assert pipeline.mixing(spark, docs, SF).count() >= 0.95 * docs.count()


def test_shares_are_upper_limits(spark):
    docs = table(spark, SF, "documents")
    rows = mix(docs, domains(table(spark, SF, "labels")), MIX, max_rate=1.0, whole="clean").collect()
    names = sorted(MIX)
    totals = [sum(r.rate * r.tokens * r.posteriors[k] for r in rows) for k in range(3)]
    assert all(totals[k] <= 1.01 * MIX[names[k]] * sum(totals) for k in (1, 2))
    assert all(r.rate == 1 for r in rows if r.posteriors[0] == max(r.posteriors))
