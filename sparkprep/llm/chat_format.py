"""Chat transcripts as one text per conversation, with a grammar that reads them back exactly.

A turn is written as

    ### Role[level]: text </turn>\\n

``level`` 0 leaves the text as it is, level 1 puts ``\\\\`` before each ``\\\\``, ``#``, ``<`` and ``[``.
A text is first rendered at level 0 and read back by the parser; only where the recovered turn differs from the
source is it rendered at level 1, where no control string can arise, and read back again. Roles are always escaped, so that
any role can be written. All steps are expressions on single turns; a conversation meets only to be joined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
_OPEN, _CLOSE = "### ", " </turn>\n"
_TURN = r"(?s)^### ((?:\\.|[^\\\[])*+)\[([01])\]: (.*)$"
LOSS_ROLE = "assistant"


def _escape(text: Column) -> Column:
    """Each backslash, number sign, smaller-than sign and square bracket behind a backslash: no control string is left."""
    return F.regexp_replace(text, r"([\\#<\[])", r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<\[])", "$1")


def _render(role: Column, level: int, text: Column) -> Column:
    return F.concat(F.lit(_OPEN), _escape(role), F.lit(f"[{level}]: "), text, F.lit(_CLOSE))


def _pieces(formatted: Column) -> Column:
    """The turns of a rendered text, without their ends. The last piece is what follows the last end: nothing."""
    parts = F.split(formatted, r" </turn>\n", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _read(piece: Column) -> Column:
    role, level, text = (F.regexp_extract(piece, _TURN, i) for i in (1, 2, 3))
    return F.struct(_unescape(role).alias("role"), F.when(level == "1", _unescape(text)).otherwise(text).alias("text"))


def parse_chat(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of struct(role, text)."""
    return F.transform(_pieces(formatted), _read)


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, ``n_turns`` and ``formatted``.

    Turns are ordered by their number, then role, then text (null numbers first); repeated rows are turns of their own.
    Null roles and texts are written as empty ones. Rows whose conversation is null form one conversation. Other columns
    are not looked at; an empty table gives an empty result. A conversation is one cell, so it must fit in one.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    plain = _render(F.col("role"), 0, F.col("text"))
    # A text that ends in a part of the closing string could run into what follows: the parser sees the next turn too.
    read = parse_chat(F.concat(plain, plain))
    source = F.struct("role", "text")
    same = (F.size(read) == 2) & (F.get(read, F.lit(0)) == source) & (F.get(read, F.lit(1)) == source)
    rendered = turns.select(
        "conv_id", F.struct("turn", "role", "text", F.when(same, plain).otherwise(_render(F.col("role"), 1, _escape(F.col("text")))).alias("out")).alias("t"))
    chats = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.transform("t", lambda x: F.struct(x["role"], x["text"])).alias("source"),
                         F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"))
    return chats.select(
        F.col("conv_id").alias(conv_col), F.size("source").cast("long").alias("n_turns"),
        # The whole text is read back before it is given out.
        F.when(F.to_json(parse_chat(F.col("formatted"))) == F.to_json("source"), F.col("formatted"))
        .otherwise(F.raise_error(F.lit("a conversation does not read back as it was"))).alias("formatted"),
    )


def loss_texts(formatted: Column, role: str = LOSS_ROLE) -> Column:
    """The texts under the loss mask, unescaped and in order, as an array."""
    return F.transform(F.filter(parse_chat(formatted), lambda t: t["role"] == role), lambda t: t["text"])


def loss_spans(formatted: Column, role: str = LOSS_ROLE) -> Column:
    """Where the texts under the loss mask stand in the rendered text: array of struct(start, end), in code points."""
    lengths = F.transform(_pieces(formatted), lambda p: F.struct(
        (F.length(p) + len(_CLOSE)).alias("all"), F.length(F.regexp_extract(p, _TURN, 3)).alias("text"),
        (_unescape(F.regexp_extract(p, _TURN, 1)) == role).alias("mine")))
    number = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("mine"), F.lit(0).alias("next")))
    walked = F.aggregate(lengths, number, lambda acc, x: F.concat(acc, F.array(F.struct(
        (F.element_at(acc, -1)["next"] + x["all"] - len(_CLOSE) - x["text"]).alias("start"),
        (F.element_at(acc, -1)["next"] + x["all"] - len(_CLOSE)).alias("end"), x["mine"].alias("mine"),
        (F.element_at(acc, -1)["next"] + x["all"]).alias("next")))))
    return F.transform(F.filter(walked, lambda x: x["mine"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
