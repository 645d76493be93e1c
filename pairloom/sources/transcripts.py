"""Transcript files to sentence rows.

`scan` gives one row per file (`path, content`); `parse` and `parse_legacy` turn it into rows of
`schemas.SENTENCES` plus `file` and `error`. A file that fails yields exactly one row, with
`error` set and no sentence, so one pass over the corpus serves the table and the dead letters.
Everything is a projection or an explode: one stage, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom import schemas
from pairloom.constants import (
    LEGACY_REGION_IN_PATH,
    REGION_CODES,
    REGION_IN_PATH,
    REPAIR_DOUBLE_COMMA,
    REPAIR_PATTERNS,
    REPAIR_REMOVED,
    REPAIR_TEXTS,
    SPEECH_PREFIXES,
    SPLIT_FOLDERS,
)
from pairloom.functions.prosody import contour_marker, marked_words, summarize_f0
from pairloom.functions.text import bind, clean_transcript, col, strip, words
from pairloom.operators.ordering import first_rows, hash_key

EMPTY = "empty or invalid"
SENTENCE_COLUMNS = (
    "id", "do", "split", "speech_kind", "standard", "dialect", "is_identical",
    "dialect_eojeol_map", "prosody", "prosody_marker", "dialect_eojeol_prosody", "intent", "emotion",
)
_ALIGN_STATE = f"struct<sc:int,si:int,dc:int,di:int,m:{schemas.WORD_MAP}>"


# ---- files ------------------------------------------------------------------------------


def scan(
    spark: SparkSession, root: str | list[str], pattern: str = "*.json", encoding: str = "utf-8"
) -> DataFrame:
    """All matching files below `root`, whole content per row; none is an error."""
    if encoding.lower().replace("_", "-") in ("utf-8", "utf-8-sig"):
        reader = spark.read.option("wholetext", "true")
        content = F.col("value")
        source = "text"
    else:
        reader, source = spark.read, "binaryFile"
        content = F.decode(F.col("content"), encoding)
    files = (
        reader.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .format(source)
        .load(root)
        .select(F.url_decode(F.col("_metadata.file_path")).alias("path"), content.alias("content"))
    )
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} files under {root!r}")
    return files


def sample_paths(
    spark: SparkSession, root: str, k: int, seed: int = 42, pattern: str = "*.json"
) -> list[str]:
    """k file paths in a repeatable random order; the listing reads no file content."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path")
    )
    return [row.path for row in listed.orderBy(hash_key(seed, "path"), "path").limit(k).collect()]


def sample_files(files: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The k files that come first in a repeatable random order, for a small build; contents are not sorted."""
    return first_rows(files, [hash_key(seed, "path"), "path"], k)


# ---- decoding ---------------------------------------------------------------------------


def repair_json(text: Column | str) -> Column:
    """Known damage of the corpus: line breaks, trailing and doubled commas, single quotes."""
    out = F.translate(col(text), REPAIR_REMOVED, "")
    for pattern, fixed in REPAIR_PATTERNS:
        out = F.regexp_replace(out, pattern, fixed)
    for damaged, fixed in REPAIR_TEXTS:
        out = F.replace(out, F.lit(damaged), F.lit(fixed))
    return F.regexp_replace(out, REPAIR_DOUBLE_COMMA, "$1,")


def decode_strict(text: Column, schema: str) -> Column:
    """The one object that the text consists of, null for anything else.

    The decoder stops at the end of the first value, so the text is read as the only element of
    an array in a wrapper: whatever follows the object breaks the array or makes it longer. The
    wrapper's `_bad` is set for anything malformed.
    """
    blank = strip(text)
    is_object = blank.startswith("{") & blank.endswith("}")
    wrapped = F.from_json(
        F.concat(F.lit('{"d":['), text, F.lit("]}")),
        f"d array<struct<{schema}>>, _bad string",
        {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"},
    )
    whole = lambda w: w["_bad"].isNull() & (F.size(w["d"]) == 1)
    return F.when(is_object, bind(wrapped, lambda w: F.when(whole(w), F.get(w["d"], 0))))


def decode_json(text: Column | str, schema: str) -> Column:
    """Strict decoding first, the repaired text only if that fails; null if both do."""
    t = F.ltrim(col(text), F.lit("\ufeff"))
    return F.coalesce(decode_strict(t, schema), decode_strict(repair_json(t), schema))


def seconds(timecode: Column | str) -> Column:
    """`HH:MM:SS.mmm` in seconds; null when it is malformed."""

    def total(parts: Column) -> Column:
        h, m = (F.get(parts, i).try_cast("int") for i in (0, 1))
        s = F.get(parts, 2).try_cast("double")
        return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)

    return bind(F.split(col(timecode), ":"), total)


# ---- path metadata ----------------------------------------------------------------------


def _region(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in REGION_CODES.items() for x in pair])
    return F.when(name == "", F.lit("unknown")).otherwise(
        F.coalesce(F.try_element_at(table, name), name)
    )


def path_region(path: Column | str) -> Column:
    return _region(F.regexp_extract(col(path), REGION_IN_PATH, 1))


def path_split(path: Column | str) -> Column:
    """By the first folder that names a split."""
    table = F.create_map(*[F.lit(x) for pair in SPLIT_FOLDERS.items() for x in pair])
    named = F.filter(F.split(col(path), "/"), lambda part: part.isin(*SPLIT_FOLDERS))
    return F.coalesce(F.try_element_at(table, F.get(named, 0)), F.lit("unknown"))


def path_speech_kind(path: Column | str) -> Column:
    name = F.element_at(F.split(col(path), "/"), -1)
    kind = F.lit("unknown")
    for prefix, value in SPEECH_PREFIXES.items():
        kind = F.when(name.startswith(prefix), F.lit(value)).otherwise(kind)
    return kind


def legacy_region(path: Column | str) -> Column:
    return _region(F.regexp_extract(col(path), LEGACY_REGION_IN_PATH, 1))


def legacy_split(path: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SPLIT_FOLDERS.items() for x in pair])
    parent = F.coalesce(F.try_element_at(F.split(col(path), "/"), F.lit(-2)), F.lit(""))
    return F.coalesce(F.try_element_at(table, parent), F.lower(parent))


# ---- word alignment ---------------------------------------------------------------------


def _padded(words_: Column) -> Column:
    """Words as one string with a blank around each: ` a b `."""
    return F.concat(F.lit(" "), F.array_join(words_, " "), F.lit(" "))


def _blanks_in(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def align_words(standard: Column | str, dialect: Column | str, segments: Column | str) -> Column:
    """Word map of a sentence from its time-ordered segments `{standard, dialect, pronunciation}`.

    A fold with one pointer into each sentence. A segment with a standard form needs a match on
    both sides and adds entries (one per word when the counts agree, else one for the whole
    segment); a segment without one only moves the pointers. Words hold no blanks, so a run of
    words is found by a substring search from the pointer, which is a character place (`sc`,
    `dc`) next to the index of the word that starts there (`si`, `di`).
    """
    prepared = F.transform(
        col(segments),
        lambda g: bind(
            F.struct(
                g["standard"].isNull().alias("same"),
                words(F.coalesce(g["standard"], g["dialect"], F.lit(""))).alias("sw"),
                words(F.coalesce(g["dialect"], F.lit(""))).alias("dw"),
            ),
            lambda w: F.struct(
                w["same"].alias("same"),
                w["sw"].alias("sw"),
                w["dw"].alias("dw"),
                _padded(w["sw"]).alias("s_text"),
                _padded(w["dw"]).alias("d_text"),
                strip(g["standard"]).alias("standard"),
                strip(F.coalesce(g["dialect"], F.lit(""))).alias("dialect"),
                g["pronunciation"].alias("pronunciation"),
            ),
        ),
    )

    def search(sentence: Column, start: Column, needle: Column, run: Column) -> Column:
        """Character place of the first match at or after `start`; 0 if there is none."""
        at = F.call_function("locate", needle, sentence, start)
        return F.when(F.size(run) == 0, start).otherwise(at)

    def index(sentence: Column, at: Column, start: Column, first: Column) -> Column:
        skipped = _blanks_in(F.substring(sentence, start, at - start))
        return F.when(at > start, first + skipped).otherwise(first)

    def entry(s_at, d_at, d_text, s_text, spoken) -> Column:
        return F.struct(
            s_at.alias("standard_idx"),
            d_at.alias("dialect_idx"),
            F.lit(None).cast("int").alias("idx"),
            d_text.alias("dialect"),
            s_text.alias("standard"),
            spoken.alias("pronunciation"),
        )

    def step(text: Column, state: Column, g: Column) -> Column:
        places = F.struct(
            search(text["s"], state["sc"], g["s_text"], g["sw"]).alias("s"),
            search(text["d"], state["dc"], g["d_text"], g["dw"]).alias("d"),
        )

        def advance(at: Column) -> Column:
            both = (at["s"] > 0) & (at["d"] > 0)
            adds = ~g["same"] & both
            moves_s, moves_d = ((at[k] > 0) & (g["same"] | both) for k in ("s", "d"))
            return bind(
                F.struct(
                    index(text["s"], at["s"], state["sc"], state["si"]).alias("s"),
                    index(text["d"], at["d"], state["dc"], state["di"]).alias("d"),
                ),
                lambda i: F.struct(
                    _moved(moves_s, at["s"], g["s_text"], g["sw"], state["sc"]).alias("sc"),
                    F.when(moves_s, i["s"] + F.size(g["sw"])).otherwise(state["si"]).alias("si"),
                    _moved(moves_d, at["d"], g["d_text"], g["dw"], state["dc"]).alias("dc"),
                    F.when(moves_d, i["d"] + F.size(g["dw"])).otherwise(state["di"]).alias("di"),
                    F.when(adds, F.concat(state["m"], entries(g, i))).otherwise(state["m"]).alias("m"),
                ).cast(_ALIGN_STATE),
            )

        return bind(places, advance)

    def entries(g: Column, i: Column) -> Column:
        one_to_one = F.transform(
            F.arrays_zip(g["sw"].alias("sw"), g["dw"].alias("dw")),
            lambda w, k: entry(i["s"] + k, i["d"] + k, w["dw"], w["sw"], g["pronunciation"]),
        )
        whole = F.array(entry(i["s"], i["d"], g["dialect"], g["standard"], g["pronunciation"]))
        same_count = F.size(g["sw"]) == F.size(g["dw"])
        return F.when(same_count, one_to_one).otherwise(whole).cast(schemas.WORD_MAP)

    start = F.struct(
        F.lit(1).alias("sc"),
        F.lit(0).alias("si"),
        F.lit(1).alias("dc"),
        F.lit(0).alias("di"),
        F.array().cast(schemas.WORD_MAP).alias("m"),
    ).cast(_ALIGN_STATE)
    return bind(
        F.struct(_padded(words(standard)).alias("s"), _padded(words(dialect)).alias("d")),
        lambda text: F.aggregate(
            prepared, start, lambda state, g: step(text, state, g), lambda state: state["m"]
        ),
    )


def _moved(moves: Column, at: Column, needle: Column, run: Column, before: Column) -> Column:
    """Pointer on the blank behind the match."""
    behind = F.when(F.size(run) == 0, before).otherwise(at + F.length(needle) - 1)
    return F.when(moves, behind).otherwise(before)


#: arrays up to this size are searched item by item
SHORT_ARRAY = 32


def _first_place(ordered: Column, below: Callable[[Column], Column]) -> Column:
    """Number of items of an ordered array that are `below`, which holds for a head of it; by halving."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda k: k <= F.size(ordered))
    return F.aggregate(
        steps, F.lit(0), lambda at, k: F.when(F.coalesce(below(F.get(ordered, at + k - 1)), F.lit(False)), at + k).otherwise(at)
    )


def _tag_key(sentence_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), sentence_id), F.lit(""))


def tags_by_id(items: Column) -> Column:
    """Annotation items `key, i, tag` ordered by sentence id, then place; made once a document."""
    keyed = F.transform(items, lambda it, i: F.struct(_tag_key(it["sentenceId"]).alias("key"), i.alias("i"), it["tagType"].alias("tag")))
    return F.array_sort(F.coalesce(keyed, F.array().cast("array<struct<key:string,i:int,tag:string>>")))


def tag_of(tags: Column, sentence_id: Column) -> Column:
    """Tag of the first annotation item with this sentence id (null is an id too)."""

    def found(key: Column) -> Column:
        one = F.get(tags, _first_place(tags, lambda t: t["key"] < key))
        return F.when(one["key"] == key, one["tag"])

    return bind(_tag_key(sentence_id), found)


def starts_of(segments: Column) -> Column:
    """`at, i` of the segments, ordered by start; made once a document."""
    return F.array_sort(F.transform(segments, lambda g, i: F.struct(g["at"].alias("at"), i.alias("i"))))


def segments_between(segments: Column, starts: Column, start: Column, end: Column) -> Column:
    """Segments whose start lies in [start, end + 0.01], in the order of the document.

    In a long recording the bounds are found in `starts_of` by halving, so a sentence costs its own segments only.
    """
    few = F.filter(segments, lambda g: (g["at"] >= start) & (g["at"] <= end + 0.01))

    def cut(bounds: Column) -> Column:
        places = F.transform(F.slice(starts, bounds["low"] + 1, F.greatest(bounds["high"] - bounds["low"], F.lit(0))), lambda x: x["i"])
        return F.transform(F.array_sort(places), lambda i: F.get(segments, i))

    low = _first_place(starts, lambda x: x["at"] < start)
    high = _first_place(starts, lambda x: x["at"] <= end + 0.01)
    return F.when(F.size(segments) <= SHORT_ARRAY, few).otherwise(bind(F.struct(low.alias("low"), high.alias("high")), cut))


def decoded(files: DataFrame, document: Column) -> DataFrame:
    """`path, d`: the document computed once per file.

    A one-element explode keeps the optimizer from copying the decoding into every later
    expression and filter that mentions one of its fields.
    """
    return files.select("path", F.explode(F.array(document)).alias("d"))


# ---- current format ---------------------------------------------------------------------


def _blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def decode_transcripts(files: DataFrame) -> DataFrame:
    """`path, name, sentences, segments, starts, intents, emotions, error`, one row per file.

    `starts` orders the segments, `intents` and `emotions` the annotations for the look-ups of every sentence.
    """
    doc = decoded(files, decode_json("content", schemas.TRANSCRIPT))
    nothing = F.array()
    segments = F.transform(
        F.coalesce(F.col("d.transcription.segments"), nothing.cast(_field("segments"))),
        lambda g: F.struct(
            F.when(F.coalesce(g["startTime"], F.lit("")) == "", F.lit(-1.0))
            .otherwise(seconds(g["startTime"]))
            .alias("at"),
            (F.coalesce(g["startTime"], F.lit("")) != "").alias("has_start"),
            seconds(g["endTime"]).alias("end_s"),
            (F.coalesce(g["endTime"], F.lit("")) != "").alias("has_end"),
            g["standard"].alias("standard"),
            g["dialect"].alias("dialect"),
            g["pronunciation"].alias("pronunciation"),
        ),
    )
    sentences = F.transform(
        F.filter(
            F.coalesce(F.col("d.transcription.sentences"), nothing.cast(_field("sentences"))),
            lambda s: ~_blank(s["standard"]) & ~_blank(s["dialect"]),
        ),
        lambda s: F.struct(
            seconds(s["startTime"]).alias("start_s"),
            seconds(s["endTime"]).alias("end_s"),
            s["sentenceId"].alias("raw_id"),
            F.coalesce(s["sentenceId"], F.lit("0")).try_cast("int").alias("number"),
            s["standard"].alias("standard"),
            s["dialect"].alias("dialect"),
            F.coalesce(s["intonations"], nothing.cast("array<double>")).alias("intonations"),
        ),
    )
    name = F.coalesce(F.col("d.fileName"), F.element_at(F.split("path", "/"), -1))
    parts = F.struct(
        name.alias("name"),
        sentences.alias("sentences"),
        segments.alias("segments"),
        tags_by_id(F.col("d.annotation.intents")).alias("intents"),
        tags_by_id(F.col("d.annotation.emotions")).alias("emotions"),
    )
    # the order is an element of a generated row, so it is computed once and not copied into every sentence's look-up
    rows = doc.select("path", F.inline(F.array(parts))).select("*", F.explode(F.array(starts_of(F.col("segments")))).alias("starts"))
    bad_sentence = F.exists(
        "sentences", lambda s: s["start_s"].isNull() | s["end_s"].isNull() | s["number"].isNull()
    )
    # an end time is only read for a spoken segment with a start inside some sentence
    bad_end = lambda g: g["has_start"] & g["has_end"] & g["end_s"].isNull() & ~_blank(g["dialect"])
    own = lambda s: segments_between(F.col("segments"), F.col("starts"), s["start_s"], s["end_s"])
    bad_read = F.when(F.exists("segments", bad_end), F.exists("sentences", lambda s: F.exists(own(s), bad_end))).otherwise(F.lit(False))
    bad_segment = F.exists("segments", lambda g: g["at"].isNull()) | bad_read
    error = (
        F.when(F.coalesce(F.size("sentences"), F.lit(0)) <= 0, F.lit(EMPTY))
        .when(bad_sentence, F.lit("sentence without valid time or number"))
        .when(bad_segment, F.lit("segment with malformed time"))
    )
    return rows.withColumn("error", error)


def _field(name: str) -> str:
    inner = {
        "sentences": "struct<sentenceId:string,startTime:string,endTime:string,standard:string,"
        "dialect:string,intonations:array<double>>",
        "segments": "struct<startTime:string,endTime:string,dialect:string,standard:string,"
        "pronunciation:string>",
    }
    return f"array<{inner[name]}>"


def parse(files: DataFrame) -> DataFrame:
    """Sentence rows of the current format, one `error` row per failed file."""
    documents = decode_transcripts(files)
    # each sentence takes its own segments along; a failed file keeps one null element, so
    # explode emits exactly one row for it
    own = F.transform(
        "sentences",
        lambda s: s.withField(
            "near", segments_between(F.col("segments"), F.col("starts"), s["start_s"], s["end_s"])
        ),
    )
    rows = documents.select(
        "path", "name", "intents", "emotions", "error",
        F.explode_outer(F.when(F.col("error").isNull(), own)).alias("s"),
    )
    start, end = F.col("s.start_s"), F.col("s.end_s")
    timed = F.transform(
        F.filter(
            "s.near",
            lambda g: ~_blank(g["dialect"]) & g["has_start"] & g["has_end"],
        ),
        lambda g: F.struct(
            strip(g["dialect"]).alias("word"), g["at"].alias("start_s"), g["end_s"].alias("end_s")
        ),
    )
    ok = F.col("error").isNull()
    standard, dialect = strip(F.col("s.standard")), strip(F.col("s.dialect"))
    rows = rows.withColumn("prosody", summarize_f0("s.intonations"))
    return rows.select(
        F.when(ok, F.concat_ws("_", "name", F.col("s.number").cast("string"))).alias("id"),
        path_region("path").alias("do"),
        F.when(ok, path_split("path")).otherwise(F.lit("failed")).alias("split"),
        path_speech_kind("path").alias("speech_kind"),
        standard.alias("standard"),
        dialect.alias("dialect"),
        (standard == dialect).alias("is_identical"),
        align_words("s.standard", "s.dialect", "s.near").alias("dialect_eojeol_map"),
        "prosody",
        contour_marker("prosody").alias("prosody_marker"),
        marked_words("s.intonations", start, end, timed)
        .cast(schemas.MARKED_WORDS)
        .alias("dialect_eojeol_prosody"),
        tag_of(F.col("intents"), F.col("s.raw_id")).alias("intent"),
        tag_of(F.col("emotions"), F.col("s.raw_id")).alias("emotion"),
        F.col("path").alias("file"),
        "error",
    )


# ---- legacy format ----------------------------------------------------------------------


def parse_legacy(files: DataFrame) -> DataFrame:
    """Sentence rows of the legacy format, cleaned; one `error` row per failed file."""
    split = legacy_split("path")
    doc = decoded(files, decode_json("content", schemas.LEGACY_TRANSCRIPT)).select("path", "d.utterance")
    cleaned = F.filter(
        F.transform(
            "utterance",
            lambda u: F.struct(
                u["id"].alias("id"),
                clean_transcript(u["standard_form"], "standard").alias("standard"),
                clean_transcript(u["dialect_form"], "dialect").alias("dialect"),
                u["eojeolList"].alias("entries"),
            ),
        ),
        lambda u: (u["standard"] != "") & (u["dialect"] != ""),
    )
    rows = doc.select("path", F.explode(F.array(cleaned)).alias("rows"))
    kept = F.transform(
        F.filter("u.entries", lambda e: e["standard"].isNotNull()),
        lambda e: F.struct(
            F.lit(None).cast("int").alias("standard_idx"),
            F.lit(None).cast("int").alias("dialect_idx"),
            e["id"].try_cast("int").alias("idx"),
            clean_transcript(e["eojeol"], "dialect").alias("dialect"),
            clean_transcript(e["standard"], "standard").alias("standard"),
            F.lit(None).cast("string").alias("pronunciation"),
        ),
    )
    broken = F.exists(
        "rows",
        lambda u: u["entries"].isNull()
        | F.exists(u["entries"], lambda e: e["standard"].isNotNull() & e["id"].try_cast("int").isNull()),
    )
    error = (
        F.when(F.coalesce(F.size("rows"), F.lit(0)) <= 0, F.lit(EMPTY))
        .when(~split.isin("train", "valid", "unknown"), F.concat(F.lit("no such split: "), split))
        .when(broken, F.lit("word list without valid ids"))
    )
    rows = rows.withColumn("error", error)
    exploded = rows.select(
        "path", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("rows"))).alias("u")
    )
    ok = F.col("error").isNull()
    return exploded.select(
        F.col("u.id").alias("id"),
        legacy_region("path").alias("do"),
        F.when(ok, split).otherwise(F.lit("failed")).alias("split"),
        F.lit("read").alias("speech_kind"),
        F.col("u.standard").alias("standard"),
        F.col("u.dialect").alias("dialect"),
        (F.col("u.standard") == F.col("u.dialect")).alias("is_identical"),
        kept.cast(schemas.WORD_MAP).alias("dialect_eojeol_map"),
        F.lit(None).cast(schemas.PROSODY).alias("prosody"),
        F.lit(None).cast("string").alias("prosody_marker"),
        F.lit(None).cast(schemas.MARKED_WORDS).alias("dialect_eojeol_prosody"),
        F.lit(None).cast("string").alias("intent"),
        F.lit(None).cast("string").alias("emotion"),
        F.col("path").alias("file"),
        "error",
    )


# ---- outcomes ---------------------------------------------------------------------------


def sentences(parsed: DataFrame) -> DataFrame:
    """Rows of the merged table: train and valid only."""
    return parsed.filter(F.col("split").isin("train", "valid")).select(*SENTENCE_COLUMNS)


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select("file", "error")
