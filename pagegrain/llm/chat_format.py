"""Chat examples by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example: all turns before it as context, and
its own text as the one trainable span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END_REPLY, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
#: Control strings and what stands for them inside texts; the mark itself comes first.
ESCAPES = (("~", "~0"), ("</s>", "~1"), ("<s>", "~2"), ("[INST]", "~3"), ("[/INST]", "~4"))


def escape(text: Column) -> Column:
    """Reversible: afterwards every mark is followed by a digit, and no control string is left."""
    for plain, mark in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for plain, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def chat_examples(
    df: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_length (code points) of every example.

    A turn is shown as `` reply</s>`` if its role is ``target_role``, else as
    ``[INST] role``, a line feed, and ``text [/INST]``; line feeds of a role
    are escaped too.  A conversation that ends with another role gets a last
    example with all of it and an empty loss span, so nothing is lost.  Turns
    go by turn, then role and text; null turns come first, null texts and
    roles are empty, null ids form one conversation; other columns are
    ignored; an empty table gives no rows.  An example holds its whole
    context, so output grows with the square of a conversation's turns, as the
    method has it.
    """
    rows = df.select(
        F.col(f"`{id_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    target = F.col("role") == target_role
    shown = F.when(target, F.concat(F.lit(" "), escape(F.col("text")), F.lit(END_REPLY))).otherwise(
        F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("~5")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    )
    length = F.when(target, F.length(escape(F.col("text"))))
    turns = rows.select("conv_id", F.struct("turn", "role", "text", shown.alias("shown"), length.alias("length")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    ends = F.expr("filter(sequence(1, size(t)), i -> i = size(t) OR t[i - 1].length IS NOT NULL)")
    each = grouped.select("conv_id", "t", F.posexplode(ends).alias("example", "upto"))
    text = F.concat(F.lit(START), F.expr("array_join(transform(slice(t, 1, upto), x -> x.shown), '')"))
    each = each.select("conv_id", "example", text.alias("text"), F.coalesce(F.expr("t[upto - 1].length"), F.lit(0)).alias("loss_length"))
    start = F.when(F.expr(f"text LIKE '%{END_REPLY}'"), F.length("text") - len(END_REPLY) - F.col("loss_length"))
    return each.select("conv_id", "example", "text", F.coalesce(start, F.length("text")).alias("loss_start"), "loss_length")


def parse_example(text: Column, target_role: str = "assistant") -> Column:
    """The turns of an example's text: an array of (role, text), unescaped."""
    pieces = F.split(F.substr(text, F.lit(len(START) + 1)), r"(?<=</s>)|(?<= \[/INST\])", -1)

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(OPEN) + 1), F.length(piece) - len(OPEN) - len(CLOSE))
        role = F.substring_index(inner, "\n", 1)
        said = F.substr(inner, F.length(role) + 2)
        reply = F.substr(piece, F.lit(2), F.length(piece) - 1 - len(END_REPLY))
        return F.when(
            piece.endswith(END_REPLY), F.struct(F.lit(target_role).alias("role"), unescape(reply).alias("text"))
        ).otherwise(F.struct(unescape(F.replace(role, F.lit("~5"), F.lit("\n"))).alias("role"), unescape(said).alias("text")))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def loss_text(text: Column, start: Column, length: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return unescape(F.substr(text, start + 1, length))
