"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then the turn, whose text alone is trainable.
A conversation that does not end with an assistant turn gives one more example, its whole context with nothing trainable, so that
no turn is lost.

A turn is written <s>[INST]role[/INST]text</s>. In roles and texts every backslash is doubled, then a backslash is put after the
first character of each control string; so a control string never appears inside, and taking away one backslash of each run
start gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Reads from the left: a doubled backslash gives one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit("<s>[INST]"), escape(role), F.lit("[/INST]"))


def examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, target, n_turns, formatted, loss_start, loss_end): one for each assistant turn, and one more, with null target and
    an empty loss, where turns follow the last of them.

    target is the position of the trainable turn, from 0; the loss span is in code points of formatted, end exclusive. Turns are
    ordered by turn, then role, then text (nulls first), so ties and repeated rows have a fixed order and all count. Null texts
    and roles are empty; a null conversation is one of its own. The output of a conversation grows with the square of its turns:
    that is the method. Empty in, empty out.
    """
    piece = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    talks = conversations.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    written = F.transform(
        "turns",
        lambda x: F.struct(
            _head(x["role"]).alias("head"), escape(x["text"]).alias("body"), (F.coalesce(x["role"], F.lit("")) == ASSISTANT).alias("own")
        ),
    )
    talks = talks.select("conv_id", written.alias("turns")).withColumn("n_turns", F.size("turns"))
    targets = F.filter(F.sequence(F.lit(0), F.col("n_turns") - 1), lambda i: F.element_at("turns", i + 1)["own"] | (i == F.col("n_turns") - 1))
    each = talks.select("conv_id", "turns", F.explode(targets).alias("last"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("last")), lambda x: F.concat(x["head"], x["body"], F.lit("</s>"))), "")
    each = each.select("conv_id", "last", before.alias("before"), F.element_at("turns", F.col("last") + 1).alias("t"))
    start = (F.length("before") + F.length("t.head")).cast("long")
    return each.select(
        "conv_id",
        F.when(F.col("t.own"), F.col("last")).alias("target"),
        (F.col("last") + 1).alias("n_turns"),
        F.concat("before", "t.head", "t.body", F.lit("</s>")).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("t.own"), start + F.length("t.body")).otherwise(start).alias("loss_end"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of all turns of an example."""
    parts = F.filter(F.split(formatted, r"</s>", -1), lambda x: x.startswith("<s>[INST]"))

    def turn(x: Column) -> Column:
        inner = F.substring(x, F.lit(len("<s>[INST]") + 1), F.length(x))
        at = F.locate("[/INST]", inner)
        return F.struct(
            unescape(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substring(inner, at + len("[/INST]"), F.length(inner))).alias("text")
        )

    return F.transform(parts, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the examples alone."""
    loss = unescape(F.substring("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    slim = formatted.select("conv_id", "n_turns", loss.alias("loss"), F.length("formatted").cast("long").alias("chars"), "formatted")
    by = slim.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.array_sort(F.collect_list(F.struct("n_turns", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = read_back(F.col("longest"))
    by = by.select("conv_id", turns.alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
