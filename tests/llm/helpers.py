"""Small tables with every odd case, and plain versions of shared rules."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def odd_documents(spark, extra: str | None = None):
    """Null, empty, blank and very long texts, nulls in every column, ties and repeated rows."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon.\nA second line here.", "en", "a", 10),
        (2, "The cat sat on the mat and looked at the moon.\nA second line here.", "en", None, None),
        (2, "The cat sat on the mat and looked at the moon.\nA second line here.", "en", None, None),
        (3, None, "en", "a", None),
        (4, "", None, "a", 0),
        (5, " \n\t ", "de", "b", 4),
        (6, "12 34 !!! ??", "de", "b", 12),
        (7, "Ünïcödé straße ΣΑΣ İstanbul 🙂 中文 <|endoftext|> don't", "de", "b", 40),
        (None, "no id on this one", "en", "a", 17),
        (8, "word " * 30_000, "en", "a", 150_000),
        (9, "x" * 100_000, "en", "a", 100_000),
        (-4, "The dog ran.\n\n\nThe dog ran.\r\nthe DOG ran!", "en", "a", 40),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df


def reachable(n: int, linked) -> list[int]:
    """Smallest position reachable from each, by a search over `linked(i) -> positions`."""
    root = [-1] * n
    for k in range(n):
        if root[k] < 0:
            stack, root[k] = [k], k
            while stack:
                for j in linked(stack.pop()):
                    if root[j] < 0:
                        root[j] = k
                        stack.append(j)
    return root
