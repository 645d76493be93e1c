"""Formatting of typed content: what is written can be read back, masks and attachments point at their places."""

from __future__ import annotations

import math
import random
import re

import duckdb
from helpers import SF

from pairloom.llm.chats import PART, Expansion, escape, format_chats, read_loss, read_turns, text_part, unescape
from pairloom.llm.queries import OP11_SQL, QUERIES
from pyspark.sql import functions as F

TURNS = f"conv_id bigint, turn bigint, role string, parts array<{PART}>"
CONTROL = re.compile(r"[<\[](?:/?s|/?INST|/?SYS|/?ROLE|TEXT|image|audio|document|file)[>\]]")
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}


def part(kind="text", text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def plain_escape(text: str) -> str:
    names = "/?s|/?INST|/?SYS|/?ROLE|TEXT|image|audio|document|file"
    return re.sub(rf"([<\[])(\\*)((?:{names})[>\]])", lambda m: m[1] + "\\" + m[2] + m[3], text)


def plain_format(rows):
    """The formatted text, the masked texts and the attachments of one conversation, part by part."""
    out, loss, files = "<s>", [], []
    for n, (role, parts) in enumerate(rows):
        role = role or ""
        before, after = MARKS.get(role, (f"[ROLE] {plain_escape(role)} [TEXT] ", " [/ROLE]"))
        out += before
        for i, p in enumerate(parts or []):
            out += "\n" if i else ""
            kind, text, ref, width, height, seconds, pages = p or part()
            if kind in (None, "text"):
                written = plain_escape(text or "")
                if role == "assistant" and written:
                    loss.append((len(out), len(out) + len(written)))
            else:
                kind = kind if kind in ("image", "audio", "document") else "file"
                tokens = {
                    "image": max(1, math.ceil((14 if width is None else width) / 14)) * max(1, math.ceil((14 if height is None else height) / 14)),
                    "audio": max(1, math.ceil((1.0 if seconds is None else seconds) * 25)),
                    "document": max(1, 1 if pages is None else pages) * 512,
                    "file": 1,
                }[kind]
                files.append((n, kind, ref, len(out), tokens))
                written = f"<{kind}>"
            out += written
        out += after
    return out, loss, files


def test_query_against_sql(spark):
    got = [tuple(r) for r in QUERIES["op11_chats"][0](spark, SF).collect()]
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
        assert sorted(got) == sorted(db.sql(OP11_SQL).fetchall())
    assert -1 in {r[0] for r in got}


def test_typed_parts_against_a_plain_visitor(spark):
    rng = random.Random(3)
    texts = ["", None, "plain", "</s>[INST] ok [/INST]", r"[\INST] <\\s> [", "<image>", "Ünï 🙂\n中", "<ima", "ge> [/SYS", " [TEXT] x", "[/ROLE] <s", "\\"]

    def some_part():
        return rng.choice(
            [
                part(text=rng.choice(texts)),
                part(text=rng.choice(texts)),
                part("image", ref="a.png", width=rng.choice([None, 0, 1, 14, 15, 640]), height=rng.choice([None, 480])),
                part("audio", ref="b.wav", seconds=rng.choice([None, 0.0, 1.01, 7.5])),
                part("document", text="ignored", ref=None, pages=rng.choice([None, 0, 3])),
                part("video", ref="c.mp4"),
                part(None, text="no type"),
                None,
            ]
        )

    conversations = {}
    for c in range(60):
        roles = [rng.choice(["user", "assistant", "system", "tool [TEXT] ", "", None, "[/ROLE]"]) for _ in range(rng.randint(1, 6))]
        conversations[c] = [(r, rng.choice([None, [], *[[some_part() for _ in range(rng.randint(1, 5))]] * 5])) for r in roles]
    rows = [(c, i, r, p) for c, turns in conversations.items() for i, (r, p) in enumerate(turns)]
    rng.shuffle(rows)
    chats = format_chats(spark.createDataFrame(rows, TURNS))
    read = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("said", read_loss(F.col("formatted"), F.col("loss")))
    found = {r.conv_id: r for r in read.collect()}
    assert set(found) == set(conversations)
    for c, turns in conversations.items():
        formatted, loss, files = plain_format(turns)
        r = found[c]
        assert r.formatted == formatted
        assert [tuple(x) for x in r.loss] == loss and [tuple(x) for x in r.attachments] == files
        assert (r.n_turns, r.attachment_tokens) == (len(turns), sum(f[4] for f in files))
        for f in r.attachments:
            assert formatted[f.start :].startswith(f"<{f.kind}>")
        texts_of = [[(p or part())[1] or "" if (p or part())[0] in (None, "text") else f"<{p[0] if p[0] != 'video' else 'file'}>" for p in ps or []] for _, ps in turns]
        assert [tuple(t) for t in r.turns] == [(role or "", "\n".join(t)) for (role, _), t in zip(turns, texts_of)]
        masked = [(p or part())[1] or "" for role, ps in turns if role == "assistant" for p in ps or [] if (p or part())[0] in (None, "text")]
        assert r.said == [t for t in masked if t]


def test_escape_is_reversible(spark):
    rng = random.Random(7)
    bits = ["<", "[", "\\", "/", "s", "INST", "image", ">", "]", " ", "é"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("b")).collect():
        assert r.b == r.t and r.e == plain_escape(r.t) and not CONTROL.search(r.e)


def test_odd_rows(spark):
    long_text = "word [INST] " * 20_000
    rows = [
        (1, 1, "assistant", "b"),
        (1, 0, "user", "a"),
        (1, 1, "assistant", "b"),
        (1, None, "user", "first"),
        (None, 0, "user", "lost"),
        (None, 0, None, None),
        (2, 0, "assistant", None),
        (3, 5, "assistant", long_text),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", text_part(F.col("text")))
    clash = turns.selectExpr("*", "1 AS formatted", "2 AS loss", "3 AS _at", "4 AS attachments", "5 AS _conv")
    found = {r.conv_id: r for r in format_chats(clash).withColumn("turns", read_turns(F.col("formatted"))).collect()}
    assert found[1].formatted == "<s>[INST] first [/INST][INST] a [/INST] b</s> b</s>"
    assert [tuple(s) for s in found[1].loss] == [(40, 41), (46, 47)]
    assert found[None].n_turns == 2 and [tuple(t) for t in found[None].turns] == [("", ""), ("user", "lost")]
    assert found[2].formatted == "<s> </s>" and found[2].loss == []
    assert [tuple(t) for t in found[3].turns] == [("assistant", long_text)]
    assert format_chats(turns.limit(0)).collect() == []


def test_expansion_is_a_parameter(spark):
    df = spark.createDataFrame([(0, 0, "user", [part("image", width=28, height=28), part("audio", seconds=2.0), part("document", pages=2)])], TURNS)
    row = format_chats(df, expansion=Expansion(patch=7, per_patch=2, per_second=10.0, per_page=3)).first()
    assert [a.tokens for a in row.attachments] == [32, 20, 6] and row.attachment_tokens == 58


def test_one_shuffle_and_no_python(spark):
    plan = QUERIES["op11_chats"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
