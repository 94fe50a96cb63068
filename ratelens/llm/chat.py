"""Chat formatting with Spark expressions only.

Turns of a conversation become one string:

    <|im_start|>role\\n text [<|im_sep|> text ...] <|im_end|>\\n

(without the blanks). Adjacent turns of one role are merged into one block: the block's texts are collected
as sorted structs and joined, with a separator that keeps the turns apart, so the turns can be read back.
Inside roles and texts a backslash goes before every backslash and before the bar of every "<|" (and before a
line feed in a role), so no control string can appear in them; removing each backslash before a character
reverses it. The loss mask is a list of character spans [start, length] over the formatted string: the texts of
the trained role, without roles, separators or end marks.

One shuffle, by conversation: offsets are window sums over the conversation's turns and both groupings keep
that partitioning. A conversation is one row of the result, so it has to fit in a row.

Defined results: null role or text is empty; a null conversation id is a conversation of its own; null turns
come first; ties in turn are ordered by role, then text; repeated rows are repeated turns; roles and texts may be
very long; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, SEPARATOR = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|(?<=<)\|", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"\\|\n|(?<=<)\|", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans (array of struct<start, length>, start from 0)."""
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumns({"place": F.row_number().over(order), "before": F.lag("role").over(order), "after": F.lead("role").over(order)})
    opens = F.col("before").isNull() | (F.col("before") != F.col("role"))
    closes = F.col("after").isNull() | (F.col("after") != F.col("role"))
    turns = turns.withColumns({"head": F.when(opens, F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).otherwise(SEPARATOR), "body": escape(F.col("text")), "tail": F.when(closes, F.lit(END + "\n")).otherwise(""), "opens": opens})
    turns = turns.withColumns({"block": F.sum(F.col("opens").cast("int")).over(so_far), "reach": F.sum(F.length("head") + F.length("body") + F.length("tail")).over(so_far)})
    span = F.struct((F.col("reach") - F.length("tail") - F.length("body")).alias("start"), F.length("body").cast("long").alias("length"))

    # Merge adjacent turns of a role, then concatenate the blocks.
    turn = F.struct("place", "body", span.alias("span"))
    blocks = turns.groupBy("conv_id", "block").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), F.array_join("turns.body", SEPARATOR), F.lit(END + "\n"))
    spans = F.when(F.col("role") == trained_role, F.col("turns.span")).otherwise(F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)"))
    merged = blocks.select("conv_id", F.struct("block", text.alias("text"), spans.alias("spans")).alias("b"))
    whole = merged.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    return whole.select("conv_id", F.array_join("blocks.text", "").alias("formatted"), F.flatten("blocks.spans").alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def ends(line: Column) -> Column:
        """Whether the line feed after a line ends the role: it isn't escaped by an odd number of backslashes."""
        return (F.length(line) - F.length(F.rtrim(line, F.lit("\\")))) % 2 == 0

    def of(block: Column) -> Column:
        first = F.substring_index(block, "\n", 1)
        lines = F.split(block, "\n")
        last = F.array_position(F.transform(lines, ends), True).cast("int")
        head = F.when(ends(first), first).otherwise(F.array_join(F.slice(lines, 1, last), "\n"))
        role = unescape(head)
        body = F.regexp_replace(F.substring(block, F.length(head) + 2, F.length(block)), r"<\|im_end\|>\n$", "")
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back from the output."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
