"""Chat formatting as a grammar round trip, in DataFrame functions only.

A conversation becomes one string whose turns are marked by control strings.  The string is parsed
again by a deterministic parser; where the recovered turns differ from the source, or a text or role has
a control string that a trainer would take for a mark, the conversation is rendered with its texts
escaped, and parsed again; the job fails if that isn't identical either.  A first mark tells the parser
which rendering it reads.

    <s>                     texts as they are          <s esc>  texts escaped
    [INST] text [/INST]     a user's turn
    text</s>                an assistant's turn, between "[OUT] " and "</s>"
    <<SYS role>> text <</SYS>>  any other role, its name in the mark

Cases: a null text or role is an empty one; turns are ordered by turn (nulls first), then role, then
text, so repeated turn numbers and repeated rows have one order; a null conv_id is a conversation like
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The escape sign (SYMBOL FOR ESCAPE) and the control strings, each replaced by the sign and a letter.
ESCAPE = "␛"
CONTROLS = {"[INST]": "a", "[/INST]": "b", "</s>": "c", "[OUT]": "d", "<<SYS": "e", "<</SYS>>": "f", ">>": "g", "<s>": "h", "<s esc>": "i"}
PLAIN, ESCAPED = "<s>", "<s esc>"
#: A turn of the grammar: one of three openings, anything, the closing that belongs to it.
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[OUT\] .*?</s>|<<SYS .*?>> .*? <</SYS>>"


def escape(text: Column) -> Column:
    """``text`` without control strings; the sign itself goes first, so the way back is unambiguous."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    return reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(ESCAPE + c[1])), CONTROLS.items(), text)


def unescape(text: Column) -> Column:
    text = reduce(lambda t, c: F.replace(t, F.lit(ESCAPE + c[1]), F.lit(c[0])), CONTROLS.items(), text)
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def conflicts(turns: Column) -> Column:
    """Whether a text or a role holds a control string or the escape sign."""
    signs = "|".join(rf"\Q{c}\E" for c in (*CONTROLS, ESCAPE))
    return F.exists(turns, lambda t: F.rlike(t["text"], F.lit(signs)) | F.rlike(t["role"], F.lit(signs)))


def render(turns: Column, escaped: bool) -> Column:
    """The conversation's string from an array of (role, text)."""
    safe = escape if escaped else (lambda x: x)

    def turn(t: Column) -> Column:
        text = safe(t["text"])
        return (
            F.when(t["role"] == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(t["role"] == "assistant", F.concat(F.lit("[OUT] "), text, F.lit("</s>")))
            .otherwise(F.concat(F.lit("<<SYS "), safe(t["role"]), F.lit(">> "), text, F.lit(" <</SYS>>")))
        )

    return F.concat(F.lit(ESCAPED if escaped else PLAIN), F.array_join(F.transform(turns, turn), ""))


def parse(formatted: Column) -> Column:
    """The array of (role, text) that a string says; what isn't in the grammar is skipped."""
    escaped = F.startswith(formatted, F.lit(ESCAPED))

    def turn(t: Column) -> Column:
        back = lambda x: F.when(escaped, unescape(x)).otherwise(x)
        middle = lambda lead, trail: F.substr(t, F.lit(lead + 1), F.length(t) - lead - trail)
        inst, out = F.startswith(t, F.lit("[INST] ")), F.startswith(t, F.lit("[OUT] "))
        close = F.locate(">> ", t)
        role = F.when(inst, F.lit("user")).when(out, F.lit("assistant")).otherwise(back(F.substr(t, F.lit(7), close - 7)))
        text = F.when(inst, middle(7, 8)).when(out, middle(6, 4)).otherwise(F.substr(t, close + 3, F.length(t) - close - 2 - 9))
        return F.struct(role.alias("role"), back(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: the assistant's, in order, nothing between."""
    said = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.array_join(F.transform(said, lambda t: t["text"]), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (source), formatted, parsed (read back), escaped (whether texts had to be)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = (
        rows.select("conv_id", F.struct("turn", empty("role"), empty("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )
    same = lambda c: parse(F.col(c)) == F.col("turns")
    shown = turns.withColumns({"plain": render(F.col("turns"), False), "safe": render(F.col("turns"), True)})
    lost = F.raise_error(F.lit("the escaped rendering doesn't read back as its source"))
    shown = shown.withColumn("formatted", F.when(~conflicts(F.col("turns")) & same("plain"), F.col("plain")).when(same("safe"), F.col("safe")).otherwise(lost))
    return shown.select(
        "conv_id", "turns", "formatted", parse(F.col("formatted")).alias("parsed"), F.startswith("formatted", F.lit(ESCAPED)).alias("escaped")
    )


def loss_spans(formatted: Column) -> Column:
    """(begin, end) in code points of each assistant text inside the formatted string, as written there."""
    turns = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    begin = F.when(F.startswith(formatted, F.lit(ESCAPED)), F.lit(len(ESCAPED))).otherwise(F.lit(len(PLAIN)))
    zero = F.struct(begin.cast("int").alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        end = (acc["at"] + F.length(t)).cast("int")
        span = F.array(F.struct((acc["at"] + 6).cast("int").alias("begin"), (end - 4).cast("int").alias("end")))
        spans = F.when(F.startswith(t, F.lit("[OUT] ")), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def masked_text(formatted: Column) -> Column:
    """The text under the loss mask of a formatted string, unescaped and joined."""
    escaped = F.startswith(formatted, F.lit(ESCAPED))
    cut_out = lambda s: F.substr(formatted, s["begin"] + 1, s["end"] - s["begin"])
    texts = F.transform(loss_spans(formatted), lambda s: F.when(escaped, unescape(cut_out(s))).otherwise(cut_out(s)))
    return F.array_join(texts, "")
