"""ING-01..18 over transcript documents made of every conversation turn."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.plans import views as V
from pairloom.plans.catalog.registry import query
from pairloom.plans.catalog.text import BLANK_CLASS
from pairloom.plans.sql import MARKER_V2, with_views, words
from pairloom.session import ensure_checkpoint_dir
from pairloom.sources import tables, transcripts as T

BAD = "(nr % 7 <> 3 AND (nr % 11 = 5 OR nr % 13 IN (6, 9)))"
FILES = """SELECT conv_id, turn, conv_id + turn AS nr, conv_id || '_' || turn AS name,
  '/corpus/TL_01._' || (['강원도', '경상도', '전라도', '제주도', '충청도', '평안도'])[conv_id % 6 + 1] || '_01/' ||
  (['Training', 'Validation', 'Other'])[conv_id % 3 + 1] || '/' || (['st_', 'say_', 'talk_', 'x_'])[(conv_id + turn) % 4 + 1] || conv_id || '_' || turn || '.json' AS path,
  (['gangwondo', 'gyeongsangdo', 'jeollado', 'jejudo', 'chungcheongdo', '평안도'])[conv_id % 6 + 1] AS "do",
  (['train', 'valid', 'unknown'])[conv_id % 3 + 1] AS split,
  (['read', 'say', 'talk', 'unknown'])[(conv_id + turn) % 4 + 1] AS speech_kind FROM conversations"""
# sentences of a file in order, `i` from 0
SENTS = f"""SELECT f.*, standard, {words('standard')} AS ws, row_number() OVER (PARTITION BY f.conv_id, f.turn ORDER BY pos) - 1 AS i
FROM (SELECT conv_id, turn, pos, parts[pos] AS standard FROM conv_parts WHERE parts[pos] <> '') s
JOIN files f ON f.conv_id = s.conv_id AND f.turn = s.turn"""
SAID = "array_to_string(list_transform(range(0, len(ws)), lambda j: CASE WHEN j % 3 = 1 THEN ws[j + 1] || 'q' ELSE ws[j + 1] END), ' ')"


SCAN_FOLDERS = 256
# a file per row, moved to its place by the task that wrote it instead of all by the driver
ONE_BY_ONE = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
# on local disks without checksum files, which double the files and start three more processes for the modes of each
ONE_BY_ONE |= {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def sql(body: str) -> str:
    return with_views("conv_parts", body, files=FILES, sents=SENTS)


def parsed(spark, sf):
    return T.parse(V.transcripts(spark, sf))


def fresh_folder(spark):
    """A new folder below the checkpoint folder, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def written(spark, sf, splits=tables.MERGED_SPLITS):
    """Sentence rows of the asked splits, from the table that the sink writes."""
    path = fresh_folder(spark)
    tables.write_parsed(parsed(spark, sf), path)
    return tables.load_sentences(spark, path, splits)


@query("ing01_scan", f"WITH files AS ({FILES}) SELECT name, 1::BIGINT AS documents FROM files")
def ing01(spark, sf):
    path = fresh_folder(spark)
    name = F.coalesce(F.regexp_extract("path", r"([0-9]+_[0-9]+)\.json$", 1), F.lit(""))
    docs = V.transcripts(spark, sf).select(name.alias("name"), F.coalesce("content", F.lit("")).alias("content"))
    # one file per name, many to a folder: making and listing a folder takes longer than reading its file
    files = docs.groupBy("name").agg(F.array_join(F.collect_list("content"), "\n").alias("value"))
    folder = F.pmod(F.xxhash64("name"), F.lit(SCAN_FOLDERS))
    files.select("value", folder.alias("folder")).write.partitionBy("folder").options(**ONE_BY_ONE).text(path)
    found = T.scan(spark, path, "*.txt")
    whole = F.col("content").startswith("{")
    named = F.regexp_extract("content", r'^\{"fileName":"([0-9]+_[0-9]+)"', 1)
    return found.groupBy(named.alias("name")).agg(F.sum(whole.cast("bigint")).alias("documents"))


@query(
    "ing03_strict_decode",
    f"WITH files AS ({FILES}) SELECT path, nr % 7 <> 3 AND nr % 11 <> 5 AND nr % 13 NOT IN (6, 9) AS strict FROM files",
)
def ing03(spark, sf):
    return V.transcripts(spark, sf).select("path", T.decode_strict(F.col("content"), schemas.TRANSCRIPT).isNotNull().alias("strict"))


@query(
    "ing04_repaired",
    f"WITH files AS ({FILES}) SELECT path, name AS file_name FROM files WHERE nr % 7 = 3",
)
def ing04(spark, sf):
    strict = T.decode_strict(F.col("content"), schemas.TRANSCRIPT)
    repaired = T.decode_json("content", schemas.TRANSCRIPT)
    rows = V.transcripts(spark, sf).filter(strict.isNull()).select("path", repaired["fileName"].alias("file_name"))
    return rows.filter(F.col("file_name").isNotNull())


@query(
    "ing09_segment_starts",
    sql(
        f"""SELECT path, coalesce(n, 0) + CASE WHEN nr % 17 = 8 THEN 2 ELSE 0 END AS segments, CASE WHEN nr % 17 = 8 THEN 1 ELSE 0 END AS without_start,
  round(coalesce(total, 0) + CASE WHEN nr % 17 = 8 THEN 90 * 3600 - 1 ELSE 0 END, 6)::DOUBLE AS total_start
FROM files JOIN (SELECT conv_id, turn, sum(len(ws))::BIGINT AS n,
  sum(list_sum(list_transform(range(0, len(ws)), lambda j: i * 2 + (j % 180) / 100.0::DOUBLE))) AS total FROM sents GROUP BY ALL)
USING (conv_id, turn) WHERE NOT {BAD}"""
    ),
)
def ing09(spark, sf):
    files = T.decode_transcripts(V.transcripts(spark, sf)).filter(F.col("error").isNull())
    starts = F.transform("segments", lambda g: g["at"])
    return files.select(
        "path",
        F.size("segments").cast("bigint").alias("segments"),
        F.size(F.filter(starts, lambda s: s == -1)).alias("without_start"),
        F.aggregate(starts, F.lit(0.0), lambda total, s: total + s).alias("total_start"),
    )


@query(
    "ing13_annotations",
    sql(f"SELECT name || '_' || (i + 1) AS id, CASE WHEN (i + 1) % 2 = 1 THEN 't' || ((i + 1) % 5) END AS intent, NULL::VARCHAR AS emotion FROM sents WHERE NOT {BAD}"),
)
def ing13(spark, sf):
    return parsed(spark, sf).filter(F.col("error").isNull()).select("id", "intent", "emotion")


@query(
    "ing02_sample_files",
    f"WITH files AS ({FILES}) SELECT path FROM files ORDER BY md5('42:' || path), path LIMIT 50",
)
def ing02(spark, sf):
    return T.sample_files(V.transcripts(spark, sf), 50).select("path")


@query(
    "ing05_dead_letters",
    sql(
        f"""SELECT path AS file, 'empty or invalid' AS error FROM files WHERE {BAD}
OR (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM conv_parts WHERE parts[pos] <> '')"""
    ),
)
def ing05(spark, sf):
    return T.dead_letters(parsed(spark, sf))


@query("ing06_path_metadata", f'WITH files AS ({FILES}) SELECT path, "do", split, speech_kind FROM files')
def ing06(spark, sf):
    return V.transcripts(spark, sf).select(
        "path",
        T.path_region("path").alias("do"),
        T.path_split("path").alias("split"),
        T.path_speech_kind("path").alias("speech_kind"),
    )


@query(
    "ing07_legacy_path_metadata",
    f"""WITH files AS ({FILES}) SELECT path, "do", split FROM (SELECT path,
  CASE WHEN conv_id % 6 = 5 THEN '평안도' ELSE "do" END AS "do", CASE split WHEN 'unknown' THEN 'other' ELSE split END AS split FROM files)""",
)
def ing07(spark, sf):
    # the same files under the folder layout of the legacy corpus
    folder = F.regexp_replace("path", r"^/corpus/TL_01\._([^_]+)_01/", "/raw/한국어 방언 발화($1)/")
    return V.transcripts(spark, sf).select(
        "path", T.legacy_region(folder).alias("do"), T.legacy_split(folder).alias("split")
    )


@query(
    "ing08_timecode",
    """SELECT event_id, round(hour(ts) * 3600 + minute(ts) * 60 + (floor(microsecond(ts) / 1000.0) / 1000.0), 3) AS seconds FROM events""",
)
def ing08(spark, sf):
    stamp = F.date_format("ts", "HH:mm:ss.SSS")
    return V.table(spark, sf, "events").select("event_id", T.seconds(stamp).alias("seconds"))


@query(
    "ing10_explode_strip",
    f"""SELECT doc_id, pos - 1 AS pos, standard, dialect FROM (
SELECT doc_id, pos, regexp_replace(lines[pos], '^{BLANK_CLASS}|{BLANK_CLASS}$', '', 'g') AS standard,
  regexp_replace(replace(lines[pos], 'the', ''), '^{BLANK_CLASS}|{BLANK_CLASS}$', '', 'g') AS dialect
FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS pos FROM (SELECT doc_id, string_split(text, '\n') AS lines FROM documents)))
WHERE standard <> '' AND dialect <> ''""",
)
def ing10(spark, sf):
    lines = V.texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    rows = lines.select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        T.strip("line").alias("standard"),
        T.strip(F.replace("line", F.lit("the"), F.lit(""))).alias("dialect"),
    )
    return rows.filter((F.col("standard") != "") & (F.col("dialect") != ""))


@query("ing11_interval_join", sql(f"SELECT name, i + 1 AS number, len(ws) AS segments FROM sents WHERE NOT {BAD}"))
def ing11(spark, sf):
    rows = T.decode_transcripts(V.transcripts(spark, sf)).filter(F.col("error").isNull())
    each = rows.select("name", "segments", "starts", F.explode("sentences").alias("s"))
    near = T.segments_between(F.col("segments"), F.col("starts"), F.col("s.start_s"), F.col("s.end_s"))
    return each.select("name", F.col("s.number").cast("bigint").alias("number"), F.size(near).cast("bigint").alias("segments"))


@query(
    "ing12_word_alignment",
    sql(
        f"""SELECT name || '_' || (i + 1) AS id, j::INTEGER AS standard_idx, j::INTEGER AS dialect_idx, ws[j + 1] || 'q' AS dialect, ws[j + 1] AS standard
FROM (SELECT name, i, ws, unnest(range(0, len(ws))) AS j FROM sents WHERE NOT {BAD}) WHERE j % 3 = 1"""
    ),
)
def ing12(spark, sf):
    rows = parsed(spark, sf).filter(F.col("error").isNull())
    each = rows.select("id", F.explode("dialect_eojeol_map").alias("e"))
    return each.select("id", "e.standard_idx", "e.dialect_idx", "e.dialect", "e.standard")


PITCH = "list_transform(range(0, 10), lambda p: (100 + (conv_id + i * 7 + p * p) % 60)::DOUBLE)"


@query(
    "ing14_sentence_rows",
    sql(
        f"""SELECT id, "do", split, speech_kind, standard, dialect, standard = dialect AS is_identical, intent, f0_mean, {MARKER_V2} AS prosody_marker FROM (
SELECT *, round_even(m, 2) AS f0_mean, round_even(sqrt(list_sum(list_transform(v, lambda p: (p - m) * (p - m))) / 10), 2) AS f0_std,
  round_even((v[-1] - v[1]) / v[1], 3) AS f0_delta FROM (
SELECT name || '_' || (i + 1) AS id, "do", split, speech_kind, standard, {SAID} AS dialect,
  CASE WHEN (i + 1) % 2 = 1 THEN 't' || ((i + 1) % 5) END AS intent, {PITCH} AS v, list_sum({PITCH}) / 10 AS m FROM sents WHERE NOT {BAD}))"""
    ),
)
def ing14(spark, sf):
    rows = parsed(spark, sf).filter(F.col("error").isNull())
    return rows.select(
        "id", "do", "split", "speech_kind", "standard", "dialect", "is_identical", "intent",
        F.col("prosody.f0_mean").alias("f0_mean"), "prosody_marker",
    )


def legacy_files(spark, sf):
    """One legacy document per turn: every sentence carries the annotations to clean."""
    turns = V.texts(spark, sf, "conversations", "conv_id", "turn", "text").select(
        "conv_id",
        "turn",
        F.filter(V.sentences("text"), lambda s: s != "").alias("parts"),
    )
    tail = " (aq)/(a) ((zz)) {laugh} #um &name1& (unclear) ]"
    utterances = F.transform(
        "parts",
        lambda s, i: F.struct(
            F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"), (i + 1).cast("string")).alias("id"),
            F.concat(s, F.lit(tail)).alias("standard_form"),
            F.concat(s, F.lit(tail)).alias("dialect_form"),
            F.transform(
                T.words(s),
                lambda w, j: F.struct(
                    (j + 1).cast("string").alias("id"),
                    F.concat(F.lit("#"), w, F.lit("q")).alias("eojeol"),
                    F.when(j % 2 == 0, w).alias("standard"),
                ),
            ).alias("eojeolList"),
        ),
    )
    korean = F.array(*[F.lit(n) for n in ("강원도", "경상도", "전라도", "제주도", "충청도", "평안도")])
    folder = F.array(F.lit("Training"), F.lit("Validation"), F.lit("Other"))
    path = F.concat(
        F.lit("/raw/한국어 방언 발화("), F.get(korean, (F.col("conv_id") % 6).cast("int")), F.lit(")/"),
        F.get(folder, (F.col("conv_id") % 3).cast("int")), F.lit("/"),
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.lit(".json"),
    )
    content = F.concat(F.lit("\ufeff"), F.to_json(F.struct(utterances.alias("utterance"))))
    return turns.select(path.alias("path"), content.alias("content"))


@query(
    "ing15_legacy_rows",
    sql(
        """SELECT conv_id || '.' || turn || '.' || (i + 1) AS id, "do", split, standard || ' a um' AS standard, standard || ' aq um' AS dialect,
  (len(ws) + 1) // 2 AS n_map, ws[1] || 'q' AS first_dialect, 1 AS first_idx FROM sents WHERE conv_id % 3 <> 2"""
    ),
)
def ing15(spark, sf):
    rows = T.parse_legacy(legacy_files(spark, sf)).filter(F.col("error").isNull())
    first = F.get("dialect_eojeol_map", F.lit(0))
    return rows.select(
        "id", "do", "split", "standard", "dialect",
        F.size("dialect_eojeol_map").cast("bigint").alias("n_map"),
        first["dialect"].alias("first_dialect"),
        first["idx"].alias("first_idx"),
    )


@query(
    "ing15_legacy_dead_letters",
    f"WITH files AS ({FILES}) SELECT 'no such split: other' AS error, count(*) AS n FROM files WHERE conv_id % 3 = 2 HAVING count(*) > 0",
)
def ing15_dead(spark, sf):
    dead = T.dead_letters(T.parse_legacy(legacy_files(spark, sf)))
    return dead.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("ing16_split_counts", sql(f'SELECT split, "do", count(*) AS n FROM sents WHERE NOT {BAD} AND split <> \'unknown\' GROUP BY ALL'))
def ing16(spark, sf):
    return written(spark, sf).groupBy("split", "do").agg(F.count(F.lit(1)).alias("n"))


@query("ing18_load_valid", sql(f"SELECT name || '_' || (i + 1) AS id, standard FROM sents WHERE NOT {BAD} AND split = 'valid'"))
def ing18(spark, sf):
    return written(spark, sf, ("valid",)).select("id", "standard")
