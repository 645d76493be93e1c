"""Parallel-text tables derived from the shared test tables, whole texts and all rows.

Every sentence of every document or conversation becomes a pair; the dialect side is a
deterministic variant, so that both engines derive equal rows. `SQL` holds the same
derivations as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.constants import MARKERS, REGIONS
from pairloom.functions.text import changed_words, words
from pairloom.session import spread

ENDINGS = ("onon", "erst")  # marker list of the derived English-like text
RUNS = ("base", "arm1", "arm2")
BASELINE = "base"

SENTENCE = r"[.!?]*[^.!?\n]+[.!?]*|[.!?]+"
BLANK_RUN = r"[ \t\n\f\r]+"  # both engines read this class alike
#: every fourth sentence has these letters written as Hangul, so that no text is Latin only
HANGUL = ("aeiountsrl", "가에이오우은트스르을")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A text table, pruned to `columns` and spread over the cores before it is taken apart."""
    return spread(table(spark, sf_dir, name).select(*columns))


def sentences(text: str) -> Column:
    """All sentences of a text, every character kept, with runs of blanks as one space."""
    found = F.regexp_extract_all(F.col(text), F.lit(SENTENCE), F.lit(0))
    return F.transform(found, lambda s: F.trim(F.regexp_replace(s, BLANK_RUN, " ")))


def _variant(standard: Column) -> Column:
    out = F.replace(standard, F.lit("th"), F.lit("d"))
    for ending, changed in (("n", "ng"), ("e", "ay")):
        for after in " .,":
            out = F.replace(out, F.lit(ending + after), F.lit(changed + after))
    return out


def _pair_rows(rows: DataFrame, keys: list[str], first_k: Column) -> DataFrame:
    """One row per sentence of `parts`: keys, `at`, `k`, `standard`, `dialect`, `is_identical`.

    The pair is built inside the exploded array, so later filters do not repeat the work.
    """

    def pair(plain: Column, at: Column) -> Column:
        k = first_k + at + 1
        standard = F.when(k % 4 == 3, F.translate(plain, *HANGUL)).otherwise(plain)
        previous = F.get("parts", at - 1)
        swapped = (k % 20 == 13) & (at > 0) & F.coalesce(previous != "", F.lit(False))
        dialect = (
            F.when(k % 5 == 0, standard)
            .when(k % 5 == 1, F.concat(standard, F.lit(" ya")))
            .when(swapped, previous)
            .otherwise(_variant(standard))
        )
        return F.struct(
            at.alias("at"), k.alias("k"), standard.alias("standard"), dialect.alias("dialect")
        )

    used = F.filter(F.transform("parts", pair), lambda p: p["standard"] != "")
    return rows.select(*keys, F.inline(used)).withColumn(
        "is_identical", F.col("standard") == F.col("dialect")
    )


def _region_by(key: str) -> Column:
    names = F.array(*[F.lit(r) for r in REGIONS], F.lit("unknown"))
    return F.get(names, (F.col(key) % 6).cast("int"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id, doc_id, k, standard, dialect, is_identical, do, split` from documents."""
    parts = texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", sentences("text").alias("parts")
    )
    rows = _pair_rows(parts, ["doc_id"], F.col("doc_id"))
    split = F.when((F.col("doc_id") % 10).isin(0, 7), F.lit("valid")).otherwise(F.lit("train"))
    return rows.select(
        (F.col("doc_id") * 1_000_000 + F.col("at") + 1).alias("id"),
        "doc_id",
        "k",
        "standard",
        "dialect",
        "is_identical",
        _region_by("doc_id").alias("do"),
        split.alias("split"),
    )


def _mark(number: Column) -> Column:
    """One of the four markers, or null for every fifth number."""
    names = F.array(*[F.lit(m) for m in MARKERS])
    return F.when(number % 5 < 4, F.get(names, (number % 5).cast("int")))


def marked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs plus `prosody_marker` and `dialect_eojeol_prosody` (one mark short where k % 7 = 0)."""
    all_marks = F.transform(
        words("dialect"),
        lambda w, i: F.struct(w.alias("word"), _mark(F.col("doc_id") + i + 1).alias("marker")),
    )
    short = F.slice(all_marks, F.lit(1), F.greatest(F.size(all_marks) - 1, F.lit(0)))
    return pairs(spark, sf_dir).withColumns(
        {
            "prosody_marker": _mark(F.col("doc_id") + 2 * F.col("k")),
            "dialect_eojeol_prosody": F.when(F.col("k") % 7 == 0, short).otherwise(all_marks),
        }
    )


def f0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`vec_id, split, series` from embeddings: 64 pitch points over 6.4 seconds."""
    gain = 200 + 150 * (F.col("vec_id") % 4)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("label") % 3 == 0, F.lit("valid")).otherwise(F.lit("train")).alias("split"),
        F.transform("embedding", lambda x: 200.0 + gain * x.cast("double")).alias("series"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id, conv_id, k, standard, dialect, is_identical, do, direction` from conversations."""
    parts = texts(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", sentences("text").alias("parts")
    )
    rows = _pair_rows(parts, ["conv_id", "turn"], F.col("conv_id") + F.col("turn"))
    direction = F.when(F.col("conv_id") % 4 == 3, F.lit("dia2std")).otherwise(F.lit("std2dia"))
    return rows.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn") * 1000 + F.col("at") + 1).alias("id"),
        "conv_id",
        "k",
        "standard",
        "dialect",
        "is_identical",
        _region_by("conv_id").alias("do"),
        direction.alias("direction"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gold x three runs: `run, run_no, gen, rev, pred_label, nll, probs, dialect_eojeol_map`."""
    k, no = F.col("k"), F.col("run_no")
    runs = F.array(
        *[F.struct(F.lit(r).alias("run"), F.lit(i).alias("run_no")) for i, r in enumerate(RUNS)]
    )
    gen = (
        F.when(no == 0, F.col("standard"))
        .when(no == 1, F.when(k % 2 == 0, F.col("dialect")).otherwise(F.col("standard")))
        .when(k % 17 == 0, F.lit(""))
        .when(k % 3 == 0, F.translate("dialect", "a", "e"))
        .otherwise(F.col("dialect"))
    )
    mapped = gold(spark, sf_dir).withColumn("dialect_eojeol_map", changed_words("standard", "dialect"))  # once for all runs
    rows = mapped.select("*", F.explode(runs).alias("r")).select("*", "r.*").drop("r")
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(5)),
        lambda i: F.conv(
            F.substring(F.md5(F.concat_ws(":", "run", F.col("id").cast("string"), i.cast("string"))), 1, 4), 16, 10
        ).cast("bigint")
        + 1,
    )
    total = F.aggregate("_raw", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return (
        rows.withColumns(
            {
                "gen": gen,
                "rev": F.when((k + no) % 3 == 0, F.translate("standard", "e", "i")).otherwise(
                    F.col("standard")
                ),
                "pred_label": ((k + no) % 6).cast("int"),
                "_raw": raw,
            }
        )
        .withColumn("nll", (F.length("gen") % 9).cast("double"))
        .withColumn("probs", F.transform("_raw", lambda x: x / total))
        .drop("_raw")
    )


def light_metrics(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """`region, run, run_order, metric, value` of cheap metrics of `rows` (default: generations), with a NaN and gaps."""
    rows = generations(spark, sf_dir) if rows is None else rows

    def pct(test: Column) -> Column:
        return F.avg(F.when(test, 100.0).otherwise(0.0))

    wide = rows.groupBy(F.col("do").alias("region"), "run", F.col("run_no").alias("run_order")).agg(
        pct(F.col("rev") == F.col("standard")).alias("reconstruction_bleu"),
        (pct(F.col("gen") == F.col("dialect")) - pct(F.col("gen") == F.col("standard"))).alias("copy_margin"),
        (pct(F.col("pred_label") == 2) / 100).alias("tdr"),
        F.avg(F.length("gen").cast("double")).alias("chrf_source"),
    )
    nan_cell = (F.col("region") == "jejudo") & (F.col("run") == "arm1")
    cells = [
        ("reconstruction_bleu", F.col("reconstruction_bleu")),
        ("copy_margin", F.when(nan_cell, F.lit(float("nan"))).otherwise(F.col("copy_margin"))),
        ("tdr", F.col("tdr")),
        ("chrf_source", F.col("chrf_source")),
        ("dfs", F.when(F.col("run") != "arm2", F.col("tdr") / 2)),
    ]
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in cells])
    return (
        wide.select("region", "run", "run_order", F.explode(entries).alias("m"))
        .select("region", "run", "run_order", "m.*")
        .filter(F.col("value").isNotNull())
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`region, run, id, score`: a hash score per sentence and run, with run offsets."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", "run", F.col("id").cast("string"))), 1, 8), 16, 10)
    runs = F.array(
        *[F.struct(F.lit(r).alias("run"), F.lit(float(i)).alias("offset")) for i, r in enumerate(RUNS)]
    )
    return (
        gold(spark, sf_dir)
        .select(F.col("do").alias("region"), "id", F.explode(runs).alias("r"))
        .select("region", "r.run", "id", "r.offset")
        .withColumn("score", (digest.cast("bigint") % 10000) / 100.0 + F.col("offset"))
        .drop("offset")
    )


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`run, event_id, seconds, tokens` from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        "event_id",
        (F.col("value") / 100.0).alias("seconds"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`run, step, pos, grad_norm, frac_reward_zero_std, reward, kl` from events."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("step"),
        F.col("event_id").alias("pos"),
        F.when(value > 200, F.lit(float("nan"))).otherwise(value).alias("grad_norm"),
        F.least(value / 200.0, F.lit(1.0)).alias("frac_reward_zero_std"),
        value.alias("reward"),
        (value / 10.0).alias("kl"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`run, id, pos, pred, entropy, label` from the words of every turn."""
    listed = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("run"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.posexplode(words("text")).alias("pos", "word"),
    )
    size = F.length("word")
    return listed.select(
        "run",
        "id",
        "pos",
        (size + F.col("pos") % 2).alias("pred"),
        (F.col("pos") % 7 / 7.0).alias("entropy"),
        F.when(F.col("pos") < 3, F.lit(-100)).otherwise(size).alias("label"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`path, content`: one transcript document per conversation turn, some damaged.

    Sentence i of a turn spans seconds [2i, 2i + 1.9]; its words are segments inside that span, and
    every third word carries a standard form that differs from the dialect form.
    """
    turns = texts(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", F.filter(sentences("text"), lambda s: s != "").alias("parts")
    )
    number = F.col("conv_id") + F.col("turn")

    def clock(hundredths: Column) -> Column:
        return F.concat(
            F.lpad((hundredths / 360000).cast("int").cast("string"), 2, "0"), F.lit(":"),
            F.lpad(((hundredths / 6000).cast("int") % 60).cast("string"), 2, "0"), F.lit(":"),
            F.lpad(((hundredths / 100).cast("int") % 60).cast("string"), 2, "0"), F.lit("."),
            F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("0"),
        )

    def said(word: Column, i: Column) -> Column:
        return F.when(i % 3 == 1, F.concat(word, F.lit("q"))).otherwise(word)

    def spoken(sentence: Column) -> Column:
        return F.array_join(F.transform(words(sentence), said), " ")

    timed = F.transform(
        "parts",
        lambda s, i: F.struct(
            (i + 1).cast("string").alias("sentenceId"),
            clock(i * 200).alias("startTime"),
            clock(i * 200 + 190).alias("endTime"),
            s.alias("standard"),
            spoken(s).alias("dialect"),
            F.transform(F.sequence(F.lit(0), F.lit(9)), lambda p: (100 + (F.col("conv_id") + i * 7 + p * p) % 60).cast("double")).alias("intonations"),
        ),
    )
    segments = F.flatten(
        F.transform(
            "parts",
            lambda s, i: F.transform(
                words(s),
                lambda w, j: F.struct(
                    clock(i * 200 + (j % 180)).alias("startTime"),
                    clock(i * 200 + (j % 180) + 10).alias("endTime"),
                    said(w, j).alias("dialect"),
                    F.when(j % 3 == 1, w).alias("standard"),
                ),
            ),
        )
    )
    # outside every sentence: an end time nobody reads, and a segment without a start
    outside = F.array(
        *[
            F.struct(
                F.lit(start).cast("string").alias("startTime"), F.lit("1:2").alias("endTime"),
                F.lit("zz").alias("dialect"), F.lit(None).cast("string").alias("standard"),
            )
            for start in ("90:00:00.00", None)
        ]
    )
    segments = F.when(number % 17 == 8, F.concat(segments, outside)).otherwise(segments)
    intents = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1))), lambda i: i % 2 == 1),
        lambda i: F.struct(i.cast("string").alias("sentenceId"), F.concat(F.lit("t"), (i % 5).cast("string")).alias("tagType")),
    )
    name = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    document = F.to_json(
        F.struct(
            name.alias("fileName"),
            F.struct(timed.alias("sentences"), segments.alias("segments")).alias("transcription"),
            F.struct(intents.alias("intents")).alias("annotation"),
        )
    )
    content = (
        F.when(number % 7 == 3, F.concat(F.substring("doc", F.lit(1), F.length("doc") - 1), F.lit(", }")))
        .when(number % 11 == 5, F.substring("doc", F.lit(1), F.length("doc") - 2))
        .when(number % 13 == 6, F.concat("doc", F.lit('{"x": 1}')))
        .when(number % 13 == 9, F.concat("doc", F.lit(" and so on }")))
        .otherwise(F.col("doc"))
    )
    korean = F.array(*[F.lit(n) for n in ("강원도", "경상도", "전라도", "제주도", "충청도", "평안도")])
    prefix = F.array(F.lit("st_"), F.lit("say_"), F.lit("talk_"), F.lit("x_"))
    folder = F.array(F.lit("Training"), F.lit("Validation"), F.lit("Other"))
    path = F.concat(
        F.lit("/corpus/TL_01._"), F.get(korean, (F.col("conv_id") % 6).cast("int")), F.lit("_01/"),
        F.get(folder, (F.col("conv_id") % 3).cast("int")), F.lit("/"),
        F.get(prefix, (number % 4).cast("int")), name, F.lit(".json"),
    )
    return turns.withColumn("doc", document).select(path.alias("path"), content.alias("content"))
