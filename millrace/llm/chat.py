"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where neighbours share a role, and concatenated:

    ### role: text</turn>

Adjacent turns of one role become one block whose parts stand apart by ``<part/>``. A backslash inside a role or a text
is doubled, and the control strings get a backslash inside, so no text can open or close a turn; dropping each escaping
backslash restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, PART, SEP = "### ", "</turn>\n", "<part/>", ": "


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, safe in (("###", "\\#\\#\\#"), ("</turn>", "<\\/turn>"), ("<part/>", "<\\part/>")):
        out = F.replace(out, F.lit(mark), F.lit(safe))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _merge(turns: Column) -> Column:
    """Runs of turns of one role as one struct(role, texts)."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(turns)))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda s: F.struct(
            F.get(turns, s["a"])["role"].alias("role"),
            F.transform(F.slice(turns, s["a"] + 1, s["b"] - s["a"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def format_chats(turns: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conv_id: conv_id, n_blocks, segments array<struct<text, loss>>, formatted.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Rows are ordered by turn (null first), ties by role and
    text, and repeated rows stay. A null text or role counts as empty; a null conv_id is a conversation of its own. An empty table
    gives no rows. A conversation is one row, so one task holds all its turns. ``formatted`` is the concatenation of the segments' texts; loss marks the pieces to train on, which
    hold (escaped) texts of ``train_roles`` alone, without markup.
    """
    clean = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = chats.select("conv_id", _merge(F.col("turns")).alias("blocks"))

    def piece(text: Column, loss: Column | bool) -> Column:
        return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def lay(block: Column) -> Column:
        train = block["role"].isin(*train_roles)
        body = F.flatten(
            F.transform(
                block["texts"],
                lambda x, i: F.array(piece(F.when(i > 0, F.lit(PART)).otherwise(F.lit("")), False), piece(escape(x), train)),
            )
        )
        return F.concat(
            F.array(piece(F.concat(F.lit(OPEN), escape_role(block["role"]), F.lit(SEP)), False)), body, F.array(piece(F.lit(CLOSE), False))
        )

    laid = blocks.select("conv_id", F.size("blocks").alias("n_blocks"), F.flatten(F.transform("blocks", lay)).alias("segments"))
    laid = laid.withColumn("segments", F.filter("segments", lambda s: (s["text"] != "") | s["loss"]))
    return laid.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: array<struct<role, text>>, one for each original turn."""
    blocks = F.split(formatted, CLOSE)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def parts(block: Column) -> Column:
        head = F.regexp_extract(block, r"(?s)^### ((?:[^\\:]++|\\.)*+): ", 1)
        body = F.substr(block, F.char_length(head) + len(OPEN) + len(SEP) + 1)
        return F.transform(F.split(body, PART), lambda x: F.struct(unescape(head).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, parts))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
