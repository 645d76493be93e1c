"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.llm.bpe import bpe
from pairloom.llm.chats import format_chats, read_loss, read_turns, text_part
from pairloom.llm.langid import identify
from pairloom.llm.licenses import page_lines, page_path, scan_licences
from pairloom.llm.lines import dedup_lines
from pairloom.llm.mixing import mix
from pairloom.llm.pii import KINDS, find_private
from pairloom.llm.quality import score_quality
from pairloom.llm.ranked import ranked_search
from pairloom.llm.rows import crc_of
from pairloom.llm.runs import periodic_runs
from pairloom.llm.simhash import near_duplicates
from pairloom.llm.topk import top_k
from pairloom.llm.vectors import near_duplicate_vectors

Run = Callable[[SparkSession, str], DataFrame]

#: name -> (query, its DuckDB form or None)
QUERIES: dict[str, tuple[Run, str | None]] = {}

WORD_BPE = "word_bpe_49k.json"


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def wrap(run: Run) -> Run:
        QUERIES[name] = (run, sql)
        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe(docs, tokenizer_path(), digests_only=True, keep=["doc_id"])


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS iv
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.iv, c.iv)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.iv) = len(c.iv)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op2_top_k", OP2_SQL)
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_vectors")
def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False)))
    return identify(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    scored = score_quality(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"), keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


#: shares of tokens that the mix aims at
MIX = {"clean": 0.93, "junk": 0.05, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """Domain of each labelled document: toxic before junk (quality 0) before clean."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", kind.alias("domain"))


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), MIX, keep=["doc_id", "source"])


@query("op4_private")
def op4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    listed = lambda kind, spans: F.transform(
        spans, lambda s: F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else s["kind"], s["start"], s["end"])
    )
    base = F.concat(*[listed(k, F.col(f"_base_{k}")) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(f"_base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed(None, F.col("_added"))), ",").alias("spans"),
    )


@query("op9_lines")
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return cleaned.select("doc_id", n_lines.alias("lines_left"), "lines_dropped", F.sha2("text", 256).alias("text_sha256"), "text")


@query("op3_licences")
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files below their host; a page that is headed by a notice covers its directory."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", page_path(F.col("url")).alias("path"), page_lines(F.col("html")).alias("text")
    )
    return scan_licences(pages, file_id="page_id", licence_file=F.lit(True), header_line=0)


def looped(doc_id: str, text: str) -> Column:
    """The text; of documents with crc32(id) % 10 = 0, words from one on repeat a period, joined by single blanks."""
    h = crc_of(doc_id)
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " "))

    # the words are bound once: a plain column would be split again for every use
    words = F.array(F.regexp_extract_all(F.col(text), F.lit(r"[^ \t-\r]+"), F.lit(0)))
    return F.when(h % 10 == 0, F.transform(words, repeat)[0]).otherwise(F.col(text))


@query("op12_runs")
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped("doc_id", "text").alias("text"))
    found = periodic_runs(docs, keep=["doc_id"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"], r["period"])))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.length")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), i AS (
  SELECT row_number() OVER () AS item, item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), sizes AS (
  SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY row
), total AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), m AS (
  SELECT row, doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM sizes, total
), tf AS (
  SELECT row, term, count(*) AS tf FROM d GROUP BY row, term
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs
), s AS (
  SELECT item, any_value(item_id) AS item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row)
  GROUP BY item, row
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM s JOIN m USING (row) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op13_ranked", OP13_SQL)
def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE 23 + length(role) END
    + length(regexp_replace(text, '([<\[])(\\*)((/?s|/?INST|/?SYS|/?ROLE|TEXT|image|audio|document|file)[>\]])', '\1\\\2\3', 'g')) AS width
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  (3 + sum(width))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id
"""


@query("op11_chats", OP11_SQL)
def op11_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads turns and loss back from the formatted text; conversation -1 holds the template's own marks."""
    marks = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marks)
    chats = format_chats(turns.withColumn("parts", text_part(F.col("text"))))
    said = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chats.withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", F.array_join(read_loss(F.col("formatted"), F.col("loss")), ""))
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "attachment_tokens",
    )
