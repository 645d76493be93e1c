"""CLN-01..08 and DST-01..03, 13: string columns over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.constants import (
    BACK_TRANSLATION_PROMPT,
    BLANKS,
    REGION_NAMES,
    SYSTEM_PROMPTS,
    TO_DIALECT_PROMPT,
    TO_STANDARD_PROMPT,
    WORD_EDGE_PUNCTUATION,
)
from pairloom.functions import chat, text as X
from pairloom.plans import views as V
from pairloom.plans.catalog.registry import query
from pairloom.plans.sql import with_views

BLANK_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS) + "]+"
# every document wrapped in the annotations the cleaning rules know
ANNOTATED = (
    "'(' || source || ')/(' || lang || ') ' || text || ' {noise} ((x y)) ( ' || source || ' ) &n' || doc_id || '& #tag ~a [b ('"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def annotated(spark, sf):
    raw = F.concat(
        F.lit("("), "source", F.lit(")/("), "lang", F.lit(") "), "text",
        F.lit(" {noise} ((x y)) ( "), "source", F.lit(" ) &n"), F.col("doc_id").cast("string"),
        F.lit("& #tag ~a [b ("),
    )
    return V.texts(spark, sf, "documents", "doc_id", "text", "lang", "source").select(
        "doc_id", raw.alias("raw")
    )


def digest(df, *texts):
    """Texts as digest and length: compact rows that still depend on every character."""
    cols = [
        c
        for name, column in texts
        for c in (F.md5(column).alias(f"{name}_md5"), F.length(column).cast("bigint").alias(f"{name}_chars"))
    ]
    return df.select("doc_id", *cols)


def digest_sql(key: str, source: str, **texts: str) -> str:
    cols = ", ".join(f"md5({x}) AS {n}_md5, length({x}) AS {n}_chars" for n, x in texts.items())
    return f"SELECT {key}, {cols} FROM ({source})"


RAW = f"SELECT doc_id, {ANNOTATED} AS raw FROM documents"


def dual_sql(x: str, side: str) -> str:
    group = "\\1" if side == "dialect" else "\\2"
    return f"regexp_replace({x}, '\\(([^()]*)\\)/\\(([^()]*)\\)', '{group}', 'g')"


def spans_sql(x: str) -> str:
    for span in ("\\(\\([^()]*\\)\\)", "\\([^()]*\\)", "\\{[^}]*\\}", "&[^&]*&"):
        x = f"regexp_replace({x}, '{span}', '', 'g')"
    return x


def orphans_sql(x: str) -> str:
    return f"regexp_replace({x}, '[()\\[\\]{{}}&]', '', 'g')"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK_CLASS}', ' ', 'g'))"


def clean_sql(x: str, side: str) -> str:
    inner = f"replace({spans_sql(dual_sql(x, side))}, '#', '')"
    return squeeze_sql(orphans_sql(inner))


@query(
    "cln01_resolve_dual",
    digest_sql("doc_id", RAW, standard=dual_sql("raw", "standard"), dialect=dual_sql("raw", "dialect")),
)
def cln01(spark, sf):
    return digest(
        annotated(spark, sf),
        ("standard", X.resolve_dual("raw", "standard")),
        ("dialect", X.resolve_dual("raw", "dialect")),
    )


@query("cln02_drop_annotations", digest_sql("doc_id", RAW, kept=spans_sql("raw")))
def cln02(spark, sf):
    return digest(annotated(spark, sf), ("kept", X.drop_annotations("raw")))


@query("cln03_drop_hash", digest_sql("doc_id", RAW, kept="replace(raw, '#', '')"))
def cln03(spark, sf):
    return digest(annotated(spark, sf), ("kept", X.drop_hash("raw")))


@query("cln04_drop_orphans", digest_sql("doc_id", RAW, kept=orphans_sql("raw")))
def cln04(spark, sf):
    return digest(annotated(spark, sf), ("kept", X.drop_orphans("raw")))


@query(
    "cln05_clean_transcript",
    digest_sql("doc_id", RAW, standard=clean_sql("raw", "standard"), dialect=clean_sql("raw", "dialect")),
)
def cln05(spark, sf):
    return digest(
        annotated(spark, sf),
        ("standard", X.clean_transcript("raw", "standard")),
        ("dialect", X.clean_transcript("raw", "dialect")),
    )


DOC_WORDS = f"SELECT doc_id, list_filter(string_split_regex(text, '{BLANK_CLASS}'), lambda w: w <> '') AS ws FROM documents"


@query(
    "cln06_normalize_word",
    f"""SELECT word, count(*) AS n FROM (SELECT trim(unnest(ws), {quoted(WORD_EDGE_PUNCTUATION)}) AS word FROM ({DOC_WORDS}))
GROUP BY word""",
)
def cln06(spark, sf):
    docs = V.texts(spark, sf, "documents", "text")
    one = docs.select(F.explode(X.words("text")).alias("w")).select(X.normalize_word("w").alias("word"))
    return one.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cln07_word_set",
    f"""SELECT doc_id, len(ws) AS n_words, len(s) AS n_distinct, md5(array_to_string(list_sort(s), ' ')) AS set_md5
FROM (SELECT doc_id, ws, list_distinct(list_filter(list_transform(ws, lambda w: trim(w, {quoted(WORD_EDGE_PUNCTUATION)})), lambda w: w <> '')) AS s
FROM ({DOC_WORDS}))""",
)
def cln07(spark, sf):
    docs = V.texts(spark, sf, "documents", "doc_id", "text").withColumn("s", X.word_set("text"))
    return docs.select(
        "doc_id",
        F.size(X.words("text")).cast("bigint").alias("n_words"),
        F.size("s").cast("bigint").alias("n_distinct"),
        F.md5(F.array_join(F.sort_array("s"), " ")).alias("set_md5"),
    )


@query("cln08_completion_text", "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations")
def cln08(spark, sf):
    turns = V.texts(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    chats = turns.select(
        "conv_id",
        "turn",
        F.array(F.struct("role", F.col("text").alias("content"))).alias("completion"),
    )
    return chats.select("conv_id", "turn", F.md5(X.completion_text(chats, "completion")).alias("text_md5"))


# ---- prompts ---------------------------------------------------------------------------

NAME_OF = "CASE \"do\" " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGION_NAMES.items()) + ' ELSE "do" END'


def fill_sql(pattern: str, *values: str) -> str:
    pieces = pattern.split("%s")
    out = quoted(pieces[0])
    for value, piece in zip(values, pieces[1:]):
        out += f" || {value} || {quoted(piece)}"
    return f"({out})"


def user_sql(source: str, direction: str) -> str:
    return (
        f"CASE WHEN {direction} = 'std2dia' THEN {fill_sql(TO_DIALECT_PROMPT, NAME_OF, source)}"
        f" ELSE {fill_sql(TO_STANDARD_PROMPT, NAME_OF, source)} END"
    )


def prompt_sql(source: str, direction: str) -> str:
    system = quoted("[system] " + SYSTEM_PROMPTS["default"] + "\n[user] ")
    return f"({system} || {user_sql(source, direction)} || '\n[assistant]')"


def chat_sql(source: str, target: str, direction: str) -> str:
    system = quoted("[system] " + SYSTEM_PROMPTS["default"] + "\n[user] ")
    return f"({system} || {user_sql(source, direction)} || '\n[assistant] ' || {target})"


@query("dst01_user_prompt", with_views("gold", f"SELECT id, {user_sql('standard', 'direction')} AS prompt FROM gold"))
def dst01(spark, sf):
    return V.gold(spark, sf).select("id", chat.user_prompt("standard", "do", "direction").alias("prompt"))


@query(
    "dst02_chat_messages",
    with_views(
        "gold",
        f"""SELECT id, i - 1 AS pos, (['system', 'user', 'assistant'])[i] AS role, c[i] AS content
FROM (SELECT id, [{quoted(SYSTEM_PROMPTS['prosody'])}, {user_sql('standard', 'direction')}, dialect] AS c, unnest([1, 2, 3]) AS i FROM gold)""",
    ),
)
def dst02(spark, sf):
    messages = chat.chat_messages("standard", "dialect", "do", "direction", template="prosody")
    rows = V.gold(spark, sf).select("id", F.posexplode(messages).alias("pos", "m"))
    return rows.select("id", "pos", "m.role", "m.content")


@query(
    "dst03_render_chat",
    with_views(
        "gold",
        f"SELECT id, {chat_sql('standard', 'dialect', 'direction')} AS chat, {prompt_sql('standard', 'direction')} AS prompt FROM gold",
    ),
)
def dst03(spark, sf):
    messages = chat.chat_messages("standard", "dialect", "do", "direction")
    prompt = chat.prompt_messages("standard", "do", "direction")
    return V.gold(spark, sf).select(
        "id", chat.render_chat(messages).alias("chat"), chat.render_chat(prompt, True).alias("prompt")
    )


@query("dst13_back_prompt", with_views("gold", f"SELECT id, {fill_sql(BACK_TRANSLATION_PROMPT, 'dialect')} AS prompt FROM gold"))
def dst13(spark, sf):
    return V.gold(spark, sf).select("id", chat.back_translation_prompt("dialect").alias("prompt"))
