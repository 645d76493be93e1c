"""DuckDB forms of the derived views, for checking results. Nothing here runs in Spark.

`with_views("pairs", body)` puts the common table expressions a body needs in front of it.
"""

from __future__ import annotations

from pairloom.constants import LABELS, MARKERS, REGIONS, WORD_EDGE_PUNCTUATION
from pairloom.plans.views import BLANK_RUN, ENDINGS, HANGUL, RUNS, SENTENCE


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


ONE_BLANK = "trim(regexp_replace({x}, '" + BLANK_RUN + "', ' ', 'g'))"
HANGUL_OF = "translate({x}, '" + HANGUL[0] + "', '" + HANGUL[1] + "')"
VARIANT = (
    r"regexp_replace(regexp_replace(replace(standard, 'th', 'd'), 'n([ .,])', 'ng\1', 'g'),"
    r" 'e([ .,])', 'ay\1', 'g')"
)
DIALECT = f"""CASE WHEN k % 5 = 0 THEN standard
  WHEN k % 5 = 1 THEN standard || ' ya'
  WHEN k % 20 = 13 AND coalesce(previous <> '', false) THEN previous
  ELSE {VARIANT} END"""
REGION_LIST = f"[{_names(REGIONS)}, 'unknown']"
MARKER_LIST = f"[{_names(MARKERS)}]"
LABEL_OF = (
    "CASE " + " ".join(f"WHEN \"do\" = '{r}' THEN {LABELS[r]}" for r in REGIONS) + " END"
)
SUPPORTED = f"\"do\" IN ({_names(REGIONS)})"
POLLUTED = f"regexp_matches(standard, '{'|'.join(ENDINGS)}')"
SPACE_WORDS = "list_filter(string_split({x}, ' '), lambda w: w <> '')"
# DuckDB's levenshtein counts bytes: every letter beyond ASCII is first written as an ASCII
# character that the tables do not use, one to one, so that bytes are characters
BEYOND_ASCII = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü" + HANGUL[1]
SINGLE_BYTES = "".join(map(chr, [*range(1, 9), *range(14, 32)])) + "~^[]_"


def edit_distance(a: str, b: str) -> str:
    one = lambda x: f"translate({x}, '{BEYOND_ASCII}', '{SINGLE_BYTES}')"
    return f"levenshtein({one(a)}, {one(b)})"


NORM_LEV = """CASE WHEN {a} = {b} THEN 0.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 1.0
  ELSE """ + edit_distance("{a}", "{b}") + """::DOUBLE / greatest(length({a}), length({b})) END"""
HASH32 = "('0x' || substr(md5({x}), 1, 8))::BIGINT"


def words(x: str) -> str:
    return SPACE_WORDS.format(x=x)


def bare_word(x: str) -> str:
    edges = WORD_EDGE_PUNCTUATION.replace("'", "''")
    return f"trim({x}, '{edges}')"


def norm_words(x: str) -> str:
    """Distinct words without punctuation at the ends."""
    return (
        f"list_distinct(list_filter(list_transform({words(x)}, lambda w: {bare_word('w')}),"
        " lambda w: w <> ''))"
    )


_SENTENCES = f"regexp_extract_all(text, '{SENTENCE}')"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body)


_view(
    "doc_parts",
    f"""SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS pos
FROM (SELECT doc_id, list_transform({_SENTENCES}, lambda x: {ONE_BLANK.format(x='x')}) AS parts FROM documents)""",
)
_view(
    "pairs",
    f"""SELECT *, standard = dialect AS is_identical,
  ({REGION_LIST})[doc_id % 6 + 1] AS "do",
  CASE WHEN doc_id % 10 IN (0, 7) THEN 'valid' ELSE 'train' END AS split
FROM (SELECT id, doc_id, k, standard, {DIALECT} AS dialect
  FROM (SELECT doc_id * 1000000 + pos AS id, doc_id, doc_id + pos AS k,
          CASE WHEN (doc_id + pos) % 4 = 3 THEN {HANGUL_OF.format(x='parts[pos]')} ELSE parts[pos] END AS standard,
          CASE WHEN pos > 1 THEN parts[pos - 1] END AS previous FROM doc_parts)
  WHERE standard <> '')""",
    "doc_parts",
)
_view(
    "marked_pairs",
    f"""SELECT *, CASE WHEN k % 7 = 0 THEN all_marks[1:len(all_marks) - 1] ELSE all_marks END AS marks
FROM (SELECT *, CASE WHEN (doc_id + 2 * k) % 5 < 4 THEN ({MARKER_LIST})[(doc_id + 2 * k) % 5 + 1] END AS prosody_marker,
  {words('dialect')} AS dwords,
  list_transform(range(1, len({words('dialect')}) + 1), lambda i: CASE WHEN (doc_id + i) % 5 < 4
    THEN ({MARKER_LIST})[(doc_id + i) % 5 + 1] END) AS all_marks FROM pairs)""",
    "pairs",
)
_view(
    "f0",
    """SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'valid' ELSE 'train' END AS split,
  list_transform(embedding, lambda x: 200.0::DOUBLE + (200 + 150 * (vec_id % 4)) * x::DOUBLE) AS series
FROM embeddings""",
)
_view(
    "voiced",
    """SELECT vec_id, split, v, len(v) AS n, list_sum(v) / len(v) AS mean
FROM (SELECT vec_id, split, list_filter(series, lambda p: p > 30) AS v FROM f0)""",
    "f0",
)
_view(
    "prosody",
    """SELECT vec_id, split, n,
  CASE WHEN n >= 3 THEN round_even(mean, 2) END AS f0_mean,
  CASE WHEN n >= 3 THEN round_even(sqrt(list_sum(list_transform(v, lambda p: (p - mean) * (p - mean))) / n), 2) END AS f0_std,
  CASE WHEN n >= 3 THEN round_even(v[1], 2) END AS f0_start,
  CASE WHEN n >= 3 THEN round_even(v[-1], 2) END AS f0_end,
  CASE WHEN n >= 3 THEN round_even((v[-1] - v[1]) / v[1], 3) + 0.0::DOUBLE END AS f0_delta,
  CASE WHEN n >= 3 THEN round_even(list_max(v) - list_min(v), 2) END AS f0_range
FROM voiced""",
    "voiced",
)
MARKER_V2 = """CASE WHEN f0_mean IS NULL THEN NULL WHEN f0_delta >= 0.05 THEN '<UP>' WHEN f0_delta <= -0.4 THEN '<DOWN>'
  WHEN f0_std / f0_mean >= 0.3 THEN '<WAVE>' ELSE '<KEEP>' END"""
MARKER_V1 = """CASE WHEN f0_mean IS NULL THEN NULL WHEN f0_delta >= 0.15 THEN '<UP>' WHEN f0_delta <= -0.15 THEN '<DOWN>'
  WHEN f0_range >= 50 THEN '<WAVE>' ELSE '<KEEP>' END"""
_view(
    "conv_parts",
    f"""SELECT conv_id, turn, parts, unnest(generate_series(1, len(parts))) AS pos
FROM (SELECT conv_id, turn, list_transform({_SENTENCES}, lambda x: {ONE_BLANK.format(x='x')}) AS parts FROM conversations)""",
)
_view(
    "gold",
    f"""SELECT *, standard = dialect AS is_identical, ({REGION_LIST})[conv_id % 6 + 1] AS "do",
  CASE WHEN conv_id % 4 = 3 THEN 'dia2std' ELSE 'std2dia' END AS direction
FROM (SELECT id, conv_id, k, standard, {DIALECT} AS dialect
  FROM (SELECT conv_id * 1000000 + turn * 1000 + pos AS id, conv_id, conv_id + turn + pos AS k,
          CASE WHEN (conv_id + turn + pos) % 4 = 3 THEN {HANGUL_OF.format(x='parts[pos]')} ELSE parts[pos] END AS standard, CASE WHEN pos > 1 THEN parts[pos - 1] END AS previous FROM conv_parts)
  WHERE standard <> '')""",
    "conv_parts",
)
_view("runs", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {i})" for i, r in enumerate(RUNS)) + ") AS t(run, run_no)")
_view(
    "gens",
    """SELECT *,
  CASE WHEN run_no = 0 THEN standard
    WHEN run_no = 1 THEN CASE WHEN k % 2 = 0 THEN dialect ELSE standard END
    WHEN k % 17 = 0 THEN '' WHEN k % 3 = 0 THEN replace(dialect, 'a', 'e') ELSE dialect END AS gen,
  CASE WHEN (k + run_no) % 3 = 0 THEN replace(standard, 'e', 'i') ELSE standard END AS rev,
  ((k + run_no) % 6)::INTEGER AS pred_label,
  CASE WHEN direction = 'std2dia' THEN dialect ELSE standard END AS target,
  CASE WHEN direction = 'std2dia' THEN standard ELSE dialect END AS source
FROM gold, runs""",
    "gold",
    "runs",
)
_view(
    "mapped",
    f"""SELECT *, CASE WHEN len(sw) = len(dw) THEN list_filter(list_transform(range(1, len(sw) + 1),
    lambda i: {{'standard': sw[i], 'dialect': dw[i]}}), lambda p: p.standard <> p.dialect) ELSE [] END AS word_map
FROM (SELECT *, {words('standard')} AS sw, {words('dialect')} AS dw FROM gens)""",
    "gens",
)
_view(
    "light_wide",
    """SELECT "do" AS region, run, run_no AS run_order,
  avg(CASE WHEN rev = standard THEN 100.0::DOUBLE ELSE 0 END) AS reconstruction_bleu,
  avg(CASE WHEN gen = dialect THEN 100.0::DOUBLE ELSE 0 END) - avg(CASE WHEN gen = standard THEN 100.0::DOUBLE ELSE 0 END) AS copy_margin,
  avg(CASE WHEN pred_label = 2 THEN 100.0::DOUBLE ELSE 0 END) / 100 AS tdr,
  avg(length(gen)::DOUBLE) AS chrf_source
FROM gens GROUP BY ALL""",
    "gens",
)
_view(
    "light",
    """SELECT region, run, run_order, 'reconstruction_bleu' AS metric, reconstruction_bleu AS value FROM light_wide
UNION ALL SELECT region, run, run_order, 'copy_margin', CASE WHEN region = 'jejudo' AND run = 'arm1' THEN 'nan'::DOUBLE ELSE copy_margin END FROM light_wide
UNION ALL SELECT region, run, run_order, 'tdr', tdr FROM light_wide
UNION ALL SELECT region, run, run_order, 'chrf_source', chrf_source FROM light_wide
UNION ALL SELECT region, run, run_order, 'dfs', tdr / 2 FROM light_wide WHERE run <> 'arm2'""",
    "light_wide",
)
_view(
    "scores",
    f"""SELECT "do" AS region, run, id, {HASH32.format(x="run || ':' || id")} % 10000 / 100.0::DOUBLE + run_no AS score
FROM gold, runs""",
    "gold",
    "runs",
)
_view(
    "latency",
    """SELECT event_type AS run, event_id, value / 100.0 AS seconds, (props ->> '$.k')::BIGINT AS tokens FROM events""",
)
_view(
    "train_log",
    """SELECT event_type AS run, event_id AS step, CASE WHEN value > 200 THEN 'nan'::DOUBLE ELSE value END AS grad_norm,
  least(value / 200.0, 1.0) AS frac, value AS reward, value / 10.0 AS kl FROM events""",
)
# classifier candidates after the row gates
_view(
    "built",
    f"""SELECT id, split, 'standard' AS side, standard AS text, 0 AS label FROM pairs WHERE NOT {POLLUTED}
UNION ALL SELECT id, split, 'dialect', dialect, {LABEL_OF} FROM pairs
WHERE {SUPPORTED} AND NOT is_identical AND ({NORM_LEV.format(a='standard', b='dialect')}) >= 0.1""",
    "pairs",
)
_view(
    "kept",
    """SELECT * FROM built WHERE (split, text) NOT IN
(SELECT (split, text) FROM built GROUP BY split, text HAVING count(DISTINCT label) > 1)""",
    "built",
)


def with_views(names: str, body: str, **extra: str) -> str:
    """`WITH` clause of the named views (space separated) and what they need, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in VIEWS[name][0]:
            visit(need)
        order.append(name)

    for name in names.split():
        visit(name)
    clauses = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    clauses += [f"{n} AS ({text})" for n, text in extra.items()]
    return f"WITH {', '.join(clauses)} {body}" if clauses else body


# ---- n-gram statistics ---------------------------------------------------------------------


def chrf_ctes(prefix: str, source: str, hyp: str, ref: str, keys: str) -> dict[str, str]:
    """`<prefix>_stats(keys, n, hyp, ref, m)`: character n-gram counts per row key."""
    return {
        f"{prefix}_text": f"SELECT {keys}, regexp_replace({hyp}, '\\s', '', 'g') AS h, regexp_replace({ref}, '\\s', '', 'g') AS r FROM {source}",
        f"{prefix}_grams": f"""SELECT {keys}, n, substr(h, i, n) AS g, 1 AS hc, 0 AS rc FROM (SELECT *, unnest(generate_series(1, length(h) - n + 1)) AS i FROM {prefix}_text, range(1, 7) t(n))
UNION ALL SELECT {keys}, n, substr(r, i, n), 0, 1 FROM (SELECT *, unnest(generate_series(1, length(r) - n + 1)) AS i FROM {prefix}_text, range(1, 7) t(n))""",
        f"{prefix}_per_gram": f"SELECT {keys}, n, g, sum(hc) AS hc, sum(rc) AS rc FROM {prefix}_grams GROUP BY {keys}, n, g",
        f"{prefix}_stats": f"""SELECT {keys}, n, CASE WHEN sum(rc) > 0 THEN sum(hc) ELSE 0 END AS hyp, sum(rc) AS ref, sum(least(hc, rc)) AS m
FROM {prefix}_per_gram GROUP BY {keys}, n""",
    }


def chrf_of(prefix: str, keys: str) -> str:
    """chrF per `keys` from `<prefix>_stats`, as a select of `keys, chrf`."""
    return f"""SELECT {keys}, CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END AS chrf FROM (
SELECT {keys}, coalesce(avg(m / hyp) FILTER (hyp > 0 AND ref > 0), 0) AS p, coalesce(avg(m / ref) FILTER (hyp > 0 AND ref > 0), 0) AS r FROM (
SELECT {keys}, n, sum(hyp)::DOUBLE AS hyp, sum(ref)::DOUBLE AS ref, sum(m)::DOUBLE AS m FROM {prefix}_stats GROUP BY {keys}, n) GROUP BY {keys})"""


def tokens_13a(x: str) -> str:
    out = f"replace(replace(replace({x}, '<skipped>', ''), '-\n', ''), '\n', ' ')"
    out = f"' ' || {out} || ' '"
    for pattern, to in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"list_filter(string_split_regex({out}, '\\s+'), lambda w: w <> '')"


def bleu_ctes(prefix: str, source: str, hyp: str, ref: str, keys: str) -> dict[str, str]:
    """`<prefix>_stats(keys, n, hyp, m)` and `<prefix>_len(keys, c, r)` per row key."""
    return {
        f"{prefix}_text": f"SELECT {keys}, {tokens_13a(hyp)} AS h, {tokens_13a(ref)} AS r FROM {source}",
        f"{prefix}_len": f"SELECT {keys}, len(h) AS c, len(r) AS r FROM {prefix}_text",
        f"{prefix}_grams": f"""SELECT {keys}, n, array_to_string(h[i:i + n - 1], ' ') AS g, 1 AS hc, 0 AS rc FROM (SELECT *, unnest(generate_series(1, len(h) - n + 1)) AS i FROM {prefix}_text, range(1, 5) t(n))
UNION ALL SELECT {keys}, n, array_to_string(r[i:i + n - 1], ' '), 0, 1 FROM (SELECT *, unnest(generate_series(1, len(r) - n + 1)) AS i FROM {prefix}_text, range(1, 5) t(n))""",
        f"{prefix}_per_gram": f"SELECT {keys}, n, g, sum(hc) AS hc, sum(rc) AS rc FROM {prefix}_grams GROUP BY {keys}, n, g",
        f"{prefix}_stats": f"SELECT {keys}, n, sum(hc) AS hyp, sum(least(hc, rc)) AS m FROM {prefix}_per_gram GROUP BY {keys}, n",
    }


def bleu_of(prefix: str, keys: str) -> str:
    """BLEU per `keys`, as a select of `keys, bleu`."""
    return f"""SELECT {keys}, CASE WHEN coalesce(matched, 0) = 0 OR c = 0 THEN 0.0
  ELSE CASE WHEN c < r THEN exp(1 - r / c) ELSE 1 END * exp(logs / orders) END AS bleu
FROM (SELECT {keys}, sum(c)::DOUBLE AS c, sum(r)::DOUBLE AS r FROM {prefix}_len GROUP BY {keys}) LEFT JOIN (
  SELECT {keys}, sum(m) AS matched, count(*) FILTER (hyp > 0) AS orders,
    sum(ln(CASE WHEN m = 0 THEN 100.0 / (pow(2, zeros) * hyp) ELSE 100.0 * m / hyp END)) FILTER (hyp > 0) AS logs
  FROM (SELECT *, count(*) FILTER (hyp > 0 AND m = 0) OVER (PARTITION BY {keys} ORDER BY n) AS zeros FROM (
    SELECT {keys}, n, sum(hyp)::DOUBLE AS hyp, sum(m)::DOUBLE AS m FROM {prefix}_stats GROUP BY {keys}, n)) GROUP BY {keys}) USING ({keys})"""
