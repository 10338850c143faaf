"""Chat formatting by a grammar round trip, in DataFrame functions only.

A conversation is rendered with turn marks, parsed back by a deterministic
parser and compared with its source. Where the two differ, control strings
inside the content are escaped and the result is checked again; a
conversation that still differs stops the job instead of being written.

Grammar:  conversation = { "<|im_start|>" role "\\n" text "<|im_end|>" "\\n" }
Escape:   "<" "\\"*n "|im_start|>" becomes "<" "\\"*(n+1) "|im_start|>", likewise
for im_end, so no content holds a control string and the step is undone by
taking one backslash away. In roles a backslash and a line feed are first
written as two characters each.

Defined cases: null text or role is empty; repeated rows and ties on the turn
number are all kept, in order of (turn, role, text); a null conversation id is
a conversation of its own; an empty table gives an empty table; other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_PLAIN = r"<(\\*)\|(im_start|im_end)\|>"
_ESCAPED = r"<\\(\\*)\|(im_start|im_end)\|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _PLAIN, r"<$1\\|$2|>")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, r"<$1|$2|>")


def _role_out(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def render(turns: Column, escaped: bool) -> Column:
    """Array of {role, text} to the array of rendered pieces {head, body}; escaped says whether content is escaped."""
    fix = escape if escaped else (lambda c: c)
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), fix(_role_out(t["role"])), F.lit("\n")).alias("head"), fix(t["text"]).alias("body")
        ),
    )


def joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """Formatted text to the array of {role, text} it stands for. Every control string counts, wherever it stands."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n?|(?<!^)(?=<\|im_start\|>)"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(START) + 1, 2**31 - 1)
        head = F.substring_index(inner, "\n", 1)
        body = F.substr(inner, F.char_length(head) + 2, F.lit(2**31 - 1))
        return F.struct(_role_in(unescape(head)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def _spans(pieces: Column, trained_role: str) -> Column:
    """Where the bodies of trained turns lie in the joined text: {start, length} in code points, start from 0."""
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    head = F.lit(START + trained_role + "\n")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        length = F.char_length(p["body"]).cast("bigint")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct(
            (start + length + len(END) + 1).alias("at"),
            F.when(p["head"] == head, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(pieces, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), step, lambda a: a["spans"])


def format_chats(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped (whether content had to be), loss_spans."""
    empty = F.lit("")
    r = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), empty).alias("role"),
            F.coalesce(F.col(text).cast("string"), empty).alias("text"),
        ).alias("t"),
    )
    g = r.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    g = g.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    g = g.withColumn("pieces", render(F.col("turns"), False))
    g = g.withColumn("escaped", ~(parse(joined(F.col("pieces"))) == F.col("turns")))
    g = g.withColumn("pieces", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("pieces")))
    g = g.withColumn("formatted", joined(F.col("pieces")))
    same = ~F.col("escaped") | (parse(F.col("formatted")) == F.col("turns"))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    return g.select("conv_id", checked.alias("formatted"), "escaped", _spans(F.col("pieces"), trained_role).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Formatted conversations to turns and to the text under the loss mask, from the output alone."""
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(loss, "").alias("loss_text"))
