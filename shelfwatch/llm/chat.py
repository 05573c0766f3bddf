"""Perspective rotation of dialogues: every participant in turn is the assistant.

For each participant of a conversation the dialogue is rendered with that speaker's turns as the
assistant, everybody else's as named users, system turns as system, and mask spans over what the
assistant says. A conversation is rendered in parts of ``PART_TURNS`` turn numbers. Turn numbers may repeat
or be NULL, so a part of more rows than that is cut by position into pieces of ``PART_TURNS`` rows, in the
order of turns: no group ever has more. Spans count characters of the piece's own text. Texts are shuffled once, by
(conversation, part, piece), together with narrow rows that bring each part the participants of its whole
conversation; the rotation itself is a map over the part.

Results in special cases: turns are ordered by turn number (NULL last), speaker (NULL last), text;
repeated turns are all rendered; a NULL or empty speaker is an unnamed user and no participant; a NULL
text is an empty turn; NULL conv_ids form one conversation; a conversation without participants
(system turns only) gives no rows; markers inside texts or names are broken up, so they cannot
forge a turn; an empty table gives an empty result; other input columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfwatch.llm.common import ROW_FILE, ROW_INDEX, before, identified, pin

PART_BITS = 6
PART_TURNS = 1 << PART_BITS
CONTEXT = ("system",)
END = "<|end|>\n"
_LAST = (1 << 63) - 1


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _header(turn: Column, me: Column, context: tuple[str, ...]) -> Column:
    who = turn["who"]
    return (F.when(who.isin(*context), F.concat(F.lit("<|"), who, F.lit("|>\n")))
            .when(who == me, F.lit("<|assistant|>\n"))
            .when(who == "", F.lit("<|user|>\n"))
            .otherwise(F.concat(F.lit("<|user|> "), who, F.lit("\n"))))


def _placed(turns: DataFrame, said: Column, part: Column, large: DataFrame) -> DataFrame:
    """conv_id, part, piece and said of the rows of large parts, each numbered inside its part."""
    rows = identified(turns.select("conv_id", part.alias("part"), said.alias("said")))
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part"))
    rows = rows.join(large, same, "left_semi").select("conv_id", "part", "said.*", ROW_FILE, ROW_INDEX, F.lit(1).alias("one"))
    # Ties in everything but the row are cut as well, so that a turn which is repeated often is many blocks.
    order = ["turn", "nameless", "who", "text", ROW_FILE, ROW_INDEX]
    rows = before(rows, ["conv_id", "part"], order, {"place": "one"}, "turn-places")
    return rows.select("conv_id", "part", F.shiftright("place", PART_BITS).alias("piece"),
                       F.struct("turn", "nameless", "who", "text").alias("said"))


def perspectives(turns: DataFrame, speaker: str = "role", context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """conv_id, speaker (the assistant), part, piece, n_turns, text, masks: a row per participant and piece."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(_LAST))
    part = F.shiftright(turn, PART_BITS)
    who = _plain(F.col(speaker))
    narrow = pin(turns.groupBy("conv_id", part.alias("part"), who.alias("who")).agg(F.count(F.lit(1)).alias("n")), "turn-counts")
    sizes = narrow.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    cast = narrow.where((F.col("who") != "") & ~F.col("who").isin(*context)).select(
        F.col("conv_id").alias("__conv"), F.col("who").alias("speaker")).distinct()
    said = F.struct(turn.alias("turn"), (who == "").alias("nameless"), who.alias("who"), _plain(F.col("text")).alias("text"))
    large = pin(sizes.where(F.col("n") > PART_TURNS).select(F.col("conv_id").alias("__conv"), F.col("part").alias("__part")), "large-parts")
    spoken = turns.select("conv_id", part.alias("part"), F.lit(0).cast("long").alias("piece"), said.alias("said"))
    if not large.isEmpty():
        same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part"))
        spoken = spoken.join(large, same, "left_anti").unionByName(_placed(turns, said, part, large))
    parts = spoken.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list("said")).alias("said"))
    # A row per participant on one side and per piece on the other: a conversation of very many of either is no single row.
    each = parts.join(cast, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", "part", "piece", "said", "speaker")
    pieces = F.transform("said", lambda t: F.struct(
        _header(t, F.col("speaker"), context).alias("header"), F.concat(t["text"], F.lit(END)).alias("body"),
        (t["who"] == F.col("speaker")).alias("mine")))
    each = each.select("conv_id", "speaker", "part", "piece", pieces.alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long>>").alias("masks"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["header"])
        stop = begin + F.char_length(p["body"])
        span = F.array(F.struct(begin.cast("long").alias("start"), stop.cast("long").alias("stop")))
        return F.struct(stop.cast("long").alias("at"), F.when(p["mine"], F.concat(acc["masks"], span)).otherwise(acc["masks"]).alias("masks"))

    return each.select(
        "conv_id", "speaker", "part", "piece", F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.flatten(F.transform("pieces", lambda p: F.array(p["header"], p["body"]))), "").alias("text"),
        F.aggregate("pieces", start, step)["masks"].alias("masks"))


def offsets(rendered: DataFrame) -> DataFrame:
    """conv_id, speaker, part, piece and offset: where the piece starts in the whole dialogue of its speaker, in characters.

    The texts of a (conv_id, speaker) by offset are the dialogue; masks plus offset are its spans. ``rendered``
    is what ``perspectives`` returns, best a written table.
    """
    narrow = rendered.select("conv_id", "speaker", "part", "piece", F.char_length("text").cast("long").alias("n_chars"))
    return before(narrow, ["conv_id", "speaker"], ["part", "piece"], {"offset": "n_chars"}, "chat-offsets").drop("n_chars")
