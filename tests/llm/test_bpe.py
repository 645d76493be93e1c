import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import odd_documents
from pairloom.llm.bpe import Recent, WordBpe, bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    return WordBpe(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(ours, library, texts):
    for text, (ids, decoded), theirs in zip(texts, ours.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.ids, text[:80]
        assert decoded == library.decode(theirs.ids, skip_special_tokens=False), text[:80]


def test_odd_texts(ours, library):
    same(ours, library, [
        "", "  \n", "<|startoftext|>Hello<|endoftext|>x <|endoftext|>", "<|endoftext", "don't WE'LL I'VE 's",
        "ΟΔΟΣ ΣΑΣ", "a\x1cb\x1d \x85\xa0c　d​e", "é é ﬁ ŉ", "½²٣ 中文 🙂👍", "x" * 3000, "!?" * 2000, "İIı", "a<b",
    ])


def test_random_words(ours, library):
    rnd = random.Random(1)
    tokens = [t.removesuffix("</w>") for t in ours.ids]
    letters = "aaabcdeéß ÀΣσ'’stre.,!?-#K中"
    texts = ["".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 5))) for _ in range(4000)]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(4000)]
    same(ours, library, texts)


def test_all_planes(ours, library):
    """Every code point beside letters, digits and itself; of the large blocks of ideographs every 16th."""
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x20000 or c % 16 == 0 or 0x2A600 < c < 0x33500)]
    for first in range(0, len(points), 5000):
        same(ours, library, [f"a{c}b 1{c}2{c}{c.upper()} {c}" for c in map(chr, points[first : first + 5000])])


def test_cache_forgets_without_harm(library):
    small = WordBpe(open(PATH, encoding="utf-8").read())
    small.seen, small.seen_words = Recent(6), Recent(4)
    texts = [f"alpha{k} beta gamma{k % 3} delta. Beta" for k in range(60)]
    for _ in range(2):
        for text in texts:
            same(small, library, [text])


def test_operator_on_odd_rows(spark, library):
    docs = odd_documents(spark).withColumnRenamed("n_chars", "n_tokens").withColumnRenamed("source", "_bpe_text")
    rows = bpe(docs, PATH).collect()
    assert len(rows) == docs.count() and set(docs.columns) | {"token_ids", "decoded"} == set(rows[0].asDict())
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.token_ids, r.n_tokens) == (ids, len(ids)) and r.decoded == library.decode(ids, skip_special_tokens=False)
    digests = {(r.doc_id, r.n_tokens): r for r in bpe(docs, PATH, digests_only=True, keep=["doc_id"]).collect()}
    for r in rows:
        d = digests[r.doc_id, r.n_tokens]
        assert d.ids_sha256 == hashlib.sha256(np.array(r.token_ids, "<u4").tobytes()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    from helpers import SF
    from pairloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"][0](spark, SF).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
