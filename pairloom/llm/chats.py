"""Chat formatting of turns whose content is a list of typed parts.

A visitor turns every part into text: a text part is escaped, an image, audio or document part becomes its
placeholder, and its reference and the number of tokens that the placeholder stands for are recorded. The parts
of a turn are joined by line feeds, the marks of its role put around them, and the turns of a
conversation joined in order:

    <s>[SYS] system text [/SYS][INST] user text [/INST] assistant text</s>...

Any other role is written as `[ROLE] name [TEXT] text [/ROLE]`. A text that contains a mark or a placeholder gets a
backslash after its bracket, and one more where backslashes are there already, so `unescape` gives back every text
and no text can pass for a mark. Line feeds between parts keep two texts from forming one.

Only built-in functions are used. Turns are formatted where they are read; one shuffle by conversation
brings them together, a running sum of their lengths gives the places of the loss mask and of the attachments. A
conversation is one row, so it has to fit into a cell (2 GB); there is no other bound on turns or parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: fields of a part; those that its type doesn't use are null
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
ATTACHED = ("image", "audio", "document")
OTHER = "file"

#: marks around the text of a role
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
BEGIN, ROLE, TEXT, END_ROLE = "<s>", "[ROLE] ", " [TEXT] ", " [/ROLE]"

_NAMES = "|".join(["/?s", "/?INST", "/?SYS", "/?ROLE", "TEXT", *ATTACHED, OTHER])
CONTROL = rf"([<\[])(\\*)(?=(?:{_NAMES})[>\]])"
ESCAPED = rf"([<\[])\\(\\*)(?=(?:{_NAMES})[>\]])"
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[ROLE\] .*? \[TEXT\] .*? \[/ROLE\]| .*?</s>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for; an unknown size counts as one unit."""

    patch: int = 14
    per_patch: int = 1
    per_second: float = 25.0
    per_page: int = 512

    def tokens(self, part: Column) -> Column:
        side = lambda x: F.greatest(F.ceil(F.coalesce(x, F.lit(self.patch)) / self.patch), F.lit(1))
        image = side(part["width"]) * side(part["height"]) * self.per_patch
        audio = F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * self.per_second), F.lit(1))
        document = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.per_page
        kind = part["type"]
        return F.when(kind == "image", image).when(kind == "audio", audio).when(kind == "document", document).otherwise(1).cast("long")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def text_part(text: Column) -> Column:
    """The content of a turn that is plain text."""
    fields = {"type": F.lit("text"), "text": text}
    return F.array(F.struct(*[fields.get(f.split(":")[0], F.lit(None)).alias(f.split(":")[0]) for f in PART[7:-1].split(", ")]).cast(PART))


def visit(part: Column, expansion: Expansion) -> Column:
    """What a part is written as, and what it refers to. A null part or type is an empty text; an unknown type is a `file`."""
    kind = F.coalesce(part["type"], F.lit("text"))
    known = F.when(kind.isin("text", *ATTACHED), kind).otherwise(F.lit(OTHER))
    is_text = kind == "text"
    return F.struct(
        known.alias("kind"),
        F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), known, F.lit(">"))).alias("written"),
        F.when(~is_text, part["ref"]).alias("ref"),
        F.when(~is_text, expansion.tokens(part)).alias("tokens"),
    )


def _placed(parts: Column) -> Column:
    """Each visited part with its first character in the turn's text."""
    start = F.struct(F.lit(0).cast("long").alias("next"), F.lit(None).cast("array<bigint>").alias("starts"))
    step = lambda acc, p: F.struct(
        (acc["next"] + F.length(p["written"]) + 1).cast("long").alias("next"),
        F.concat(F.coalesce(acc["starts"], F.array().cast("array<bigint>")), F.array(acc["next"])).alias("starts"),
    )
    # a turn of one part, the usual case, needs no fold
    return F.when(F.size(parts) <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.aggregate(parts, start, step)["starts"])


def format_chats(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    expansion: Expansion = Expansion(),
    trained: str = "assistant",
) -> DataFrame:
    """One row per conversation: its id, `formatted`, `loss`, `attachments`, `n_turns`, `attachment_tokens`.

    `loss` lists the (start, end) of the text parts of the role `trained` and `attachments` (turn, kind, ref, start, tokens) in the
    order of the text; places are code points of `formatted`, turns count from 0. Empty texts have no place in `loss`.

    Turns are ordered by `turn` (null first), ties by role, text and attachments; repeated rows are turns of their
    own. Null parts or an empty list are an empty text, a null role is the empty role, and rows with a null id make one conversation. An
    empty table gives an empty one; other columns are ignored.
    """
    visited = F.transform(F.coalesce(F.col(parts), F.expr(f"cast(array() as array<{PART}>)")), lambda p: visit(p, expansion))
    name = F.coalesce(F.col(role), F.lit(""))
    read = turns.select(F.col(conv_id).alias("_conv"), F.col(turn).alias("_turn"), name.alias("_role"), visited.alias("_parts"))
    opening = F.concat(F.lit(ROLE), escape(F.col("_role")), F.lit(TEXT))
    closing = F.lit(END_ROLE)
    for who, (before, after) in MARKS.items():
        opening = F.when(F.col("_role") == who, before).otherwise(opening)
        closing = F.when(F.col("_role") == who, after).otherwise(closing)
    text = F.array_join(F.transform("_parts", lambda p: p["written"]), "\n")
    piece = read.select("_conv", "_turn", "_role", "_parts", opening.alias("_open"), text.alias("_text"), closing.alias("_close"))
    starts = piece.withColumn("_starts", _placed(F.col("_parts")))
    listed = F.zip_with("_parts", F.slice("_starts", 1, F.size("_parts")), lambda p, s: F.struct(p.alias("part"), (s + F.length("_open")).alias("start")))
    spans = F.transform(
        F.filter(listed, lambda x: (x["part"]["kind"] == "text") & (x["part"]["written"] != "")),
        lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["part"]["written"])).alias("end")),
    )
    files = F.transform(
        F.filter(listed, lambda x: x["part"]["kind"] != "text"),
        lambda x: F.struct(x["part"]["kind"].alias("kind"), x["part"]["ref"].alias("ref"), x["start"].alias("start"), x["part"]["tokens"].alias("tokens")),
    )
    no_spans = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    written = starts.select(
        "_conv",
        "_turn",
        "_role",
        F.concat("_open", "_text", "_close").alias("_written"),
        F.when(F.col("_role") == trained, spans).otherwise(no_spans).alias("_spans"),
        files.alias("_files"),
    )
    order = W.partitionBy("_conv").orderBy(F.asc_nulls_first("_turn"), "_role", "_written", "_files")
    before = F.coalesce(F.sum(F.length("_written").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ordered = written.withColumn("_at", F.row_number().over(order) - 1).withColumn("_offset", before + len(BEGIN))
    moved = ordered.select(
        "_conv",
        F.struct(
            F.col("_at"),
            "_written",
            F.transform("_spans", lambda s: F.struct((s["start"] + F.col("_offset")).alias("start"), (s["end"] + F.col("_offset")).alias("end"))).alias("spans"),
            F.transform(
                "_files",
                lambda a: F.struct(
                    F.col("_at").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), (a["start"] + F.col("_offset")).alias("start"), a["tokens"].alias("tokens")
                ),
            ).alias("files"),
        ).alias("_piece"),
    )
    together = moved.groupBy("_conv").agg(F.sort_array(F.collect_list("_piece")).alias("_pieces"))
    attachments = F.flatten(F.transform("_pieces", lambda p: p["files"]))
    return together.select(
        F.col("_conv").alias(conv_id),
        F.concat(F.lit(BEGIN), F.array_join(F.transform("_pieces", lambda p: p["_written"]), "")).alias("formatted"),
        F.flatten(F.transform("_pieces", lambda p: p["spans"])).alias("loss"),
        attachments.alias("attachments"),
        F.size("_pieces").cast("long").alias("n_turns"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) of every turn, read from the formatted text; placeholders stay in the text."""

    def of(turn: Column) -> Column:
        inside = lambda before, after: unescape(
            F.substring(turn, F.lit(len(before) + 1), F.length(turn) - len(before) - len(after))
        )
        rest = F.substring(turn, F.lit(len(ROLE) + 1), F.length(turn) - len(ROLE) - len(END_ROLE))
        cut = F.locate(TEXT, rest)
        found = F.struct(
            unescape(F.substring(rest, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(rest, cut + len(TEXT), F.length(rest))).alias("text"),
        )
        for who, (before, after) in MARKS.items():
            found = F.when(F.startswith(turn, F.lit(before)), F.struct(F.lit(who).alias("role"), inside(before, after).alias("text"))).otherwise(found)
        return found

    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted))
    return F.transform(F.regexp_extract_all(body, F.lit(TURN), F.lit(0)), of)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
