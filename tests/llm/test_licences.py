import math
import re
from collections import Counter

from pyspark.sql import functions as F

from pairloom.llm.licenses import TEMPLATES, page_lines, page_path, scan_licences
from pairloom.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"


def plain(files, is_file, threshold=0.6, header_line=None):
    """(id, path, text) -> (licence, origin, directory) by id."""
    words = lambda s: re.findall(r"[^\W_]+", s.lower())
    texts = {(p or "", t) for _, p, t in files if t}
    n = len([1 for _, _, t in files if t])
    df = Counter(w for _, _, t in files if t for w in set(words(t)))
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1 if w in vocabulary else math.log(1 + n) + 1
    vocabulary = {w for ts in TEMPLATES.values() for t in ts for w in words(t)}
    unit = lambda c: {w: k * idf(w) / math.sqrt(sum((m * idf(v)) ** 2 for v, m in c.items())) for w, k in c.items()}
    shapes = [(name, unit(Counter(words(t)))) for name, ts in TEMPLATES.items() for t in ts]
    found = {}
    for key in texts:
        for at, line in enumerate(key[1].split("\n")):
            if set(words(line)) & vocabulary:
                u = unit(Counter(words(line)))
                scored = [(-round(sum(v * s.get(w, 0) for w, v in u.items()), 9), name) for name, s in shapes]
                best = min(scored)
                if -best[0] >= threshold:
                    found.setdefault(key, []).append((best[0], at, best[1]))
    covers = {}
    for p, t in found:
        if is_file(p):
            for less, at, name in found[p, t]:
                if header_line is None or at == header_line:
                    d = p.rpartition("/")[0]
                    covers[d] = min(covers.get(d, (9, "")), (less, name))
    out = {}
    for i, p, t in files:
        p = p or ""
        if (p, t) in found:
            out[i] = (min(found[p, t])[2], "own", None)
            continue
        parts = p.split("/")
        above = ["/".join(parts[:k]) for k in range(len(parts) - 1, -1, -1)]
        near = next((d for d in above if d in covers), None)
        out[i] = (None, "none", None) if near is None else (covers[near][1], "inherited", near)
    return out


def as_dict(rows):
    return {r[0]: (r.licence, r.origin, r.directory) for r in rows}


FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/LICENSE.txt", "x\nLicensed under the Apache License, Version 2.0."),
    (3, "a/b/c/main.py", "print(1)\nthe end"), (4, "a/other.py", ""), (5, "z/q.py", None), (6, None, "no notice"),
    (7, "a/b/own.c", "/* This work is licensed under the GNU General Public License, version 3. */\ncode"), (8, "a/b/c/main.py", "print(1)\nthe end"),
    (9, "a/long.txt", "the rights of version " * 20_000), (10, "COPYING", "All rights reserved."), (None, "a/n.py", "nothing"),
    (11, "a/two.txt", "Licensed under CC BY 4.0\nLicensed under CC BY-SA 4.0"), (12, "a/LICENSE", "Released under the MIT License."),
]


def test_tree_against_brute_force(spark):
    df = spark.createDataFrame(FILES, "file_id bigint, path string, text string").withColumn("licence", F.lit("x")).withColumn("_key", F.lit(1))
    rows = scan_licences(df).collect()
    assert len(rows) == len(FILES)
    named = re.compile(r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([.-][^/]*)?$")
    expected = plain(FILES, lambda p: bool(named.search(p)))
    assert as_dict(rows) == expected
    assert expected[3] == ("Apache-2.0", "inherited", "a/b") and expected[5] == ("proprietary", "inherited", "")
    assert scan_licences(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    pages = table(spark, SF, "pages").select("page_id", page_path(F.col("url")), page_lines(F.col("html"))).collect()
    files = [tuple(r) for r in pages]
    assert as_dict(QUERIES["op3_licences"][0](spark, SF).collect()) == plain(files, lambda p: True, header_line=0)


def test_page_text_and_path(spark):
    html = "<html><title>A\nb</title><script>var t='</p>';</script><!-- x --><p>one</p> <p></p><p>two <b>three</b></p></html>"
    df = spark.createDataFrame([(html, "https://www.x.org/a/b.html?q=1#f"), (None, None), ("", "http://m.x.org/")], "h string, u string")
    rows = df.select(page_lines(F.col("h")), page_path(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [("A b\none\ntwo\nthree", "x.org/a/b.html"), (None, None), ("", "x.org")]
