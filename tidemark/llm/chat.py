"""Chat formatting by grammar round trip.

Template: `<|im_start|>` role newline text `<|im_end|>` newline, turn after turn. The parser is deterministic: it cuts at
`<|im_start|>`, ends a turn at the first `<|im_end|>`, and takes back one escape level. Each turn is first rendered as it is and parsed;
if the parse isn't the source again, its control strings are escaped: `<|` gets a backslash between its characters, and one more where it
has some already; a newline in a role becomes `<|nl|>`. The whole conversation is then parsed once more and compared; a difference is an error.
Texts without control strings therefore stay as they are.

Turns come in order of turn (nulls first), then role, then text; repeated turns all stay. Null role or text: empty. Rows without a
conv_id form one conversation. A conversation is one row, as it is one training example. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parsed_turns(formatted: Column) -> Column:
    """Array of (role, text) that the grammar reads from a formatted conversation; null if it isn't one."""

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, END, 1)
        role = F.substring_index(body, "\n", 1)
        whole = (piece == F.concat(body, F.lit(END + "\n"))) & body.contains("\n")
        return F.when(whole, F.struct(_unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), _unescape(F.substr(body, F.length(role) + 2)).alias("text")))

    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    return F.when((F.element_at(pieces, 1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (parsed back from it) and loss_spans: start and end of each assistant body in formatted."""
    source = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = source.withColumn("plain", _render(F.col("role"), F.col("text"))).withColumn("back", parsed_turns(F.col("plain")))
    kept = F.col("back") == F.array(F.struct("role", "text"))
    escaped = _render(F.replace(_escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), _escape(F.col("text")))
    lines = plain.select("conv_id", "turn", "role", "text", F.when(F.coalesce(kept, F.lit(False)), F.col("plain")).otherwise(escaped).alias("line"))
    grouped = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "line"))).alias("rows"))
    rendered = grouped.select("conv_id", "rows", F.array_join(F.col("rows.line"), "").alias("formatted")).withColumn("turns", parsed_turns(F.col("formatted")))
    same = F.coalesce(F.col("turns") == F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))), F.lit(False))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, row: Column) -> Column:
        end = acc["at"] + F.length(row["line"])
        head = F.when(row["line"] == _render(row["role"], row["text"]), F.length(row["role"])).otherwise(F.length(F.replace(_escape(row["role"]), F.lit("\n"), F.lit(NEWLINE))))
        span = F.struct((acc["at"] + len(START) + 1 + head).alias("start"), (end - len(END) - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(row["role"] == "assistant", F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("rows", begin, step, lambda acc: acc["spans"])
    return rendered.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))).alias("formatted"), "turns", spans.alias("loss_spans"))
