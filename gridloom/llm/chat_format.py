r"""Chat formatting with prefix-target expansion, all in SQL functions.

A turn becomes

    ### role:\n text \n</turn>\n

A backslash, ``### `` and ``</turn>`` inside a text (and a colon inside a role) get a backslash before them, so
``\n</turn>\n`` and a bare ``### `` only ever are marks, and taking the backslashes away gives the text again.
Every assistant turn makes one example: all turns before it as context, then the turn itself; only the reply's text
is under the loss mask. What follows the last assistant turn (or a conversation without one) makes a last example
without a mask, so that the output holds every turn.

A conversation is one row while it is formatted (its digest needs that as well); its turns, not its examples, are shuffled. The expansion is quadratic in a
conversation's turns by definition; its examples pass one by one, and reading them back holds the longest of them and the replies, never all.

Defined results: a null text or role counts as empty; turns of the same number are ordered by role and text; repeated rows are
turns of their own; a null conv_id is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "\n</turn>\n"
_MARKS = r"(\\|### |</turn>)"
_ROLE_MARKS = r"(\\|### |</turn>|:)"
_ESCAPED = r"\\(\\|### |</turn>|:)"
_TURN = r"(?s)### ([^\\:]*+(?:\\.[^\\:]*+)*+):\n(.*?)\n</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _MARKS, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length); loss_start counts characters from 0, null without a mask."""
    own = turns.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    talks = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    heads = F.transform("ts", lambda t: F.concat(F.lit(OPEN), F.regexp_replace(t["role"], _ROLE_MARKS, r"\\$1"), F.lit(":\n")))
    talks = talks.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"] == target_role).alias("trained"),
        heads.alias("heads"),
        F.transform("ts", lambda t: escaped(t["text"])).alias("texts"),
    )
    n = F.size("texts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("trained", i) | (i == n))
    talks = talks.withColumn("blocks", F.zip_with("heads", "texts", lambda h, t: F.concat(h, t, F.lit(CLOSE))))
    each = talks.select("conv_id", "trained", "heads", "texts", "blocks", F.posexplode(ends).alias("example", "at"))
    context = F.array_join(F.slice("blocks", 1, F.col("at") - 1), "")
    each = each.select(
        "conv_id",
        "example",
        context.alias("context"),
        F.element_at("trained", F.col("at")).alias("trained"),
        F.element_at("heads", F.col("at")).alias("head"),
        F.element_at("texts", F.col("at")).alias("reply"),
    )
    start = F.length("context") + F.length("head")
    return each.select(
        "conv_id",
        "example",
        F.concat("context", "head", "reply", F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("trained"), start).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.length("reply")).cast("long").alias("loss_length"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) from the output of ``examples`` alone; turns: array of (role, text)."""
    loss = F.when(F.col("loss_start").isNotNull(), F.expr("substring(formatted, loss_start + 1, loss_length)"))
    own = formatted.select("conv_id", "example", "formatted", F.struct("example", loss.alias("text")).alias("loss"))
    back = own.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),  # the last example holds every turn
        F.sort_array(F.collect_list(F.when(F.col("loss.text").isNotNull(), F.col("loss")))).alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    roles, texts = F.regexp_extract_all("whole", F.lit(_TURN), F.lit(1)), F.regexp_extract_all("whole", F.lit(_TURN), F.lit(2))
    return back.select(
        "conv_id",
        F.zip_with(roles, texts, lambda r, t: F.struct(unescaped(r).alias("role"), unescaped(t).alias("text"))).alias("turns"),
        F.array_join(F.transform("losses", lambda e: unescaped(e["text"])), "").alias("loss_text"),
        "formatted_chars",
    )
