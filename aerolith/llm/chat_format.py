"""Chat formatting that is read back: grammar round trip with escapes where needed.

Template, one turn after the other:  `<s>[NAME] text [/NAME]</s>`  with NAME INST for user, ANSWER for assistant, SYS for
system, and ROLE followed by the escaped role for any other.

A turn is first written with its text as it is and parsed again by the grammar, in which no text holds a control string. If
role or text come back changed, the text's control strings are escaped: a `<` or `[` that begins one becomes `\\l` or `\\b`, a backslash before e, l or b becomes
`\\e`. The conversation is then parsed as a whole; should it still differ from the source, every `<`, `[` and backslash
of all its texts is escaped, which no control string survives. `identical` tells that the last parse equals the source.

Only column expressions are used. A conversation is one training example and so one row; its turns are all that a group
holds. Escapes are worked out per turn before the shuffle.

Defined results: null text and null role are empty; null turns come first; equal turns are ordered by role and text, and
repeated rows are turns of their own; a null conversation id is one conversation; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = {"user": "INST", "assistant": "ANSWER", "system": "SYS"}
_TURN = r"(?s)<s>\[(INST|ANSWER|SYS|ROLE[^\[\]<>]*)\] (.*?) \[/\1\]</s>"
_CONTROL = r"</?s>|\[/?(?:INST|ANSWER|SYS|ROLE[^\[\]<>]*)\]"


def escape(text: Column) -> Column:
    """Escape control strings, and backslashes that would read as escapes."""
    text = F.regexp_replace(text, r"\\(?=[elb])", r"\\\\e")
    text = F.regexp_replace(text, r"<(?=/?s>)", r"\\\\l")
    return F.regexp_replace(text, r"\[(?=/?(?:INST|ANSWER|SYS|ROLE))", r"\\\\b")


def escape_all(text: Column) -> Column:
    """Escape every character that any control string or escape begins with."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def _role_name(role: Column) -> Column:
    # also the brackets and angles that end a name
    other = F.replace(F.replace(escape_all(role), F.lit("]"), F.lit("\\r")), F.lit(">"), F.lit("\\g"))
    out = F.concat(F.lit("ROLE "), other)
    for name, mark in NAMES.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def _role_of(name: Column) -> Column:
    other = unescape(F.replace(F.replace(F.substring(name, 6, 1 << 30), F.lit("\\r"), F.lit("]")), F.lit("\\g"), F.lit(">")))
    for role, mark in NAMES.items():
        other = F.when(name == mark, F.lit(role)).otherwise(other)
    return other


def render_turn(role: Column, shown: Column) -> Column:
    name = _role_name(role)
    return F.concat(F.lit("<s>["), name, F.lit("] "), shown, F.lit(" [/"), name, F.lit("]</s>"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; text between turns makes an extra turn of no role."""
    names, texts = F.regexp_extract_all(formatted, F.lit(_TURN), 1), F.regexp_extract_all(formatted, F.lit(_TURN), 2)
    # a control string inside a text breaks the grammar: such a turn has no role
    turns = F.zip_with(names, texts, lambda n, t: F.struct(F.when(~t.rlike(_CONTROL), _role_of(n)).alias("role"), unescape(t).alias("text")))
    rest = F.regexp_replace(formatted, _TURN, "")
    stray = F.array(F.struct(F.lit(None).cast("string").alias("role"), rest.alias("text")))
    return F.when(rest == "", turns).otherwise(F.concat(turns, stray))


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, formatted, parsed turns, loss_text (all assistant texts read back), rounds, identical."""
    rows = df.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # only a text with a control string or an escape can come back changed, so only those are tried
    suspect = F.col("text").rlike(rf"{_CONTROL}|\\[elb]")
    back = parse(render_turn(F.col("role"), F.col("text")))
    same = (F.size(back) == 1) & (F.get(back, 0)["role"] == F.col("role")) & (F.get(back, 0)["text"] == F.col("text"))
    shown = F.when(suspect & ~F.coalesce(same, F.lit(False)), escape(F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("shown", shown)
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "shown"))).alias("turns"))

    def whole(level) -> Column:
        return F.array_join(F.transform("turns", lambda t: render_turn(t["role"], level(t))), "")

    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    turns = turns.select("conv_id", "turns", source.alias("source"), whole(lambda t: t["shown"]).alias("first"))
    turns = turns.withColumn("first_back", parse(F.col("first")))
    fits = F.col("first_back") == F.col("source")
    turns = turns.select("conv_id", "source", F.when(fits, F.lit(1)).otherwise(2).alias("rounds"), F.when(fits, F.col("first")).otherwise(whole(lambda t: escape_all(t["text"]))).alias("formatted"))
    turns = turns.withColumn("parsed", parse(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return turns.select("conv_id", "formatted", "parsed", loss.alias("loss_text"), "rounds", (F.col("parsed") == F.col("source")).alias("identical"))
