"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its reply is trainable. A template marks the turns:

    <s>[INST]role[/INST]text</s><s>[INST]assistant[/INST]reply</s>

Control strings inside roles and texts are escaped reversibly: a backslash goes
after the first character of anything that would read as a control string or as
an escaped one, so that texts never hold a control string and unescaping takes
out one backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
#: First character, backslashes, rest: all control strings of the template, and those of common other ones.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|[A-Za-z_]+\||<SYS>>|</SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|\|[A-Za-z_]+\||<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): one row a conversation, its turns in order of turn, role, text; null roles and texts are empty."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def head(role: Column) -> Column:
    return F.concat(F.lit(BOS + OPEN), escape(role), F.lit(CLOSE))


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars): a row for each turn of the target role.

    example counts from 1 in each conversation. formatted holds the turns up to the
    reply; the loss mask is the loss_chars code points of it from loss_start (from 0).
    A conversation that doesn't end with such a turn gets one more row, last, with all
    its turns as context and an empty mask, so that its last row always holds it whole.
    Turns are ordered by turn, equal ones by role and text; null turns come first; a
    null conv_id is one conversation. Repeated rows are repeated turns.
    Null texts and roles are empty. Other columns are ignored.

    A conversation is gathered in one row, because an example is one string: it has to
    fit in memory, as any example must. Formatted turns are made once and then sliced.
    """
    marked = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t["role"]).alias("head"), escape(t["text"]).alias("body")))
    rows = conversations(turns, conv_id, turn, role, text).withColumn("marked", marked)
    places = F.filter(F.transform("marked", lambda t, i: F.when(t["role"] == target, i)), lambda i: i.isNotNull())
    rest = F.when(F.element_at("marked", -1)["role"] == target, F.array().cast("array<int>")).otherwise(F.array(F.size("marked")))
    rows = rows.select("conv_id", "marked", F.posexplode(F.concat(places, rest)).alias("example", "at"))
    turn_at = F.get("marked", F.col("at"))
    joined = F.array_join(F.transform(F.slice("marked", F.lit(1), F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(EOS))), "")
    before = F.concat(joined, F.coalesce(turn_at["head"], F.lit("")))
    rows = rows.select("conv_id", (F.col("example") + 1).alias("example"), turn_at.isNotNull().alias("replied"), before.alias("before"), F.coalesce(turn_at["body"], F.lit("")).alias("reply"))
    return rows.select(
        "conv_id", "example",
        F.concat("before", "reply", F.when(F.col("replied"), EOS).otherwise("")).alias("formatted"),
        F.char_length("before").cast("bigint").alias("loss_start"),
        F.char_length("reply").cast("bigint").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) array of a formatted example, unescaped."""
    marked = F.filter(F.split(formatted, EOS), lambda x: x != "")
    cut = F.lit(len(BOS + OPEN) + 1)
    return F.transform(marked, lambda x: F.struct(unescape(F.substring(x, cut, F.locate(CLOSE, x) - cut)).alias("role"), unescape(F.substring(x, F.locate(CLOSE, x) + len(CLOSE), F.length(x))).alias("text")))


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int")))
