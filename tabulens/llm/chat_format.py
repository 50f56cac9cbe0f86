"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = turn*
    turn         = "[INST] " role " [/INST]" text "</s>"

The parser cuts at "</s>", takes the role up to the first " [/INST]" and the
text after it, refuses a role or text that still holds a control string, and
undoes escapes in both.  A turn is first rendered as it is.  The rendered text
is parsed again, and if that does not give exactly the one turn it came from,
the turn's content is escaped and tried again.  So ordinary text stays as it
is, and a control string inside a text never reaches the output raw.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template and their escapes. "&" comes first when escaping and last
# when undoing, as it starts every escape.
HEAD, BODY, END = "[INST] ", " [/INST]", "</s>"
ESCAPES = [("&", "&amp;"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"), ("<s>", "&#60;s>"), ("</s>", "&#60;/s>")]
LEARNED_ROLE = "assistant"


def escaped(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(BODY), text, F.lit(END))


def pieces_of(formatted: Column) -> Column:
    """What stands before each END; an unfinished rest is an extra piece that is not empty."""
    cut = F.split(formatted, F.lit(r"\Q" + END + r"\E"), -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def has_control(c: Column) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(plain) for plain, _ in ESCAPES[1:]))


def parsed_turn(piece: Column) -> Column:
    """role, text (escapes undone) and body_at, the code points before the text; null roles where the grammar fails."""
    at = F.locate(BODY, piece)
    body_at = at - 1 + len(BODY)
    role, text = F.substring(piece, F.lit(len(HEAD) + 1), at - 1 - len(HEAD)), F.substring(piece, body_at + 1, F.length(piece))
    fits = piece.startswith(HEAD) & (at > len(HEAD) - 1) & ~has_control(role) & ~has_control(text)
    return F.struct(F.when(fits, unescaped(role)).alias("role"), unescaped(text).alias("text"), body_at.alias("body_at"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    return F.transform(pieces_of(formatted), parsed_turn)


def round_trip(rows: DataFrame) -> DataFrame:
    """``piece``: each turn rendered so that parsing gives exactly its ``role`` and ``text`` again."""
    same = lambda piece: (
        F.transform(parsed(piece), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        == F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    )
    tries = rows.withColumn("raw", rendered(F.col("role"), F.col("text")))
    tries = tries.withColumn("piece", F.when(same(F.col("raw")), F.col("raw")).otherwise(rendered(escaped(F.col("role")), escaped(F.col("text")))))
    # an escaped turn cannot conflict; if it ever did, stop rather than write it
    return tries.withColumn("piece", F.when(same(F.col("piece")), F.col("piece")).otherwise(F.raise_error(F.lit("a turn does not survive formatting")))).drop("raw")


def format_conversations(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss`` (array of start and length in code points).

    ``loss`` covers the texts of assistant turns as they stand in ``formatted``.
    Turns go by number; a null number comes first, and equal numbers go by role,
    then text, each kept.  Null roles and texts count as empty.  Rows with a null
    id are one conversation.  Other columns are left out.
    """
    rows = df.select(
        df[conv_id].alias("conv_id"),
        df[turn].alias("turn"),
        F.coalesce(df[role], F.lit("")).alias("role"),
        F.coalesce(df[text], F.lit("")).alias("text"),
    )
    pieces = round_trip(rows).select("conv_id", F.struct("turn", "role", "text", "piece").alias("t"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.select(
        "conv_id",
        F.array_join(F.col("ts.piece"), "").alias("formatted"),
        F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    whole = whole.withColumn("pieces", pieces_of(F.col("formatted")))
    whole = whole.withColumn("turns", F.transform("pieces", parsed_turn))
    back = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(back == F.col("source"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not survive formatting"))
    )
    # running place of each piece; END follows every piece
    spans = F.aggregate(
        F.arrays_zip(F.col("pieces").alias("p"), F.col("turns").alias("t")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["p"]) + len(END)).alias("at"),
            F.when(
                x["t"]["role"] == LEARNED_ROLE,
                F.concat(
                    s["spans"],
                    F.array(
                        F.struct(
                            (s["at"] + x["t"]["body_at"]).alias("start"),
                            (F.length(x["p"]) - x["t"]["body_at"]).cast("bigint").alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return whole.select("conv_id", checked.alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, ``turns`` (role, text) and ``learned`` (the text under the loss mask, escapes undone)."""
    cut = lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.select(
        "conv_id",
        "formatted",
        F.transform(parsed(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        F.array_join(F.transform("loss", cut), "").alias("learned"),
    )
