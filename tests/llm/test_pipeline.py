import importlib.util
import pathlib

import pytest

from helpers import SF, odd_documents
from pairloom.llm.queries import QUERIES, table

ROOT = pathlib.Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_queries_are_the_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_apply_their_operators(spark, pipeline):
    from test_bpe import PATH
    from test_lines import cleaned as without_repeats
    from test_simhash import plain as fingerprint
    from helpers import reachable
    from tokenizers import Tokenizer

    given = table(spark, SF, "documents")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_dedup", "mixing", "bpe"]
    kept = stages["language"](spark, given, SF).cache()
    docs = {r.doc_id: r for r in given.collect()}
    lettered = {i for i, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == given.columns and ids <= lettered and len(ids) >= 0.99 * len(lettered)

    cleaned = stages["lines"](spark, kept, SF).cache()
    rows = {r.doc_id: r for r in cleaned.collect()}
    assert cleaned.columns == given.columns
    assert {i: r.text for i, r in rows.items()} == without_repeats(spark, {i: docs[i].text for i in ids})
    assert all(r.n_chars == len(r.text) for r in rows.values())

    unique = stages["near_dedup"](spark, cleaned, SF).cache()
    order = sorted(rows)
    prints = [fingerprint(rows[i].text) for i in order]
    root = reachable(len(order), lambda a: [b for b in range(len(order)) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert sorted(r.doc_id for r in unique.collect()) == sorted({order[k] for k in root})
    assert unique.columns == given.columns

    mixed = stages["mixing"](spark, unique, SF).cache()
    assert mixed.columns == given.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in unique.collect()}

    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    last = stages["bpe"](spark, mixed, SF).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}


def test_stages_take_odd_and_empty_tables(spark, pipeline):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n <= docs.count() and (name == "bpe" or out.columns == list(pipeline.COLUMNS))
            assert name not in ("lines", "bpe") or n == docs.count()


def test_run(spark, pipeline):
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and "ids_sha256" in out.columns
