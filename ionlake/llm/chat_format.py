"""Chat formatting with typed content parts, in DataFrame expressions only.

A message's content is a list of parts (type, text, ref, n_tokens). One pass over a
conversation flattens them in order: a text part gives its text with control strings
escaped, an image, audio or document part gives a numbered placeholder and an entry in
the conversation's attachments with its reference and the tokens it expands to. Turns
are marked ``<|im_start|>role\\n`` .. ``<|im_end|>\\n``; the loss mask is the spans, in
code points, of what assistants say.

Escaping is reversible: ``<``, any number of backslashes and ``|`` get one backslash more,
so no marker can occur inside a text, and reading back takes one away.

Edge cases: null text is empty; a null or unknown role is kept as text (null as the empty
role); turns sort by turn (null first), then role and text, so repeated rows stay, side by
side; a conversation's null id is a conversation of its own; an empty table gives an empty
result; other columns are not looked at. A conversation is one row, as long as its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that an attachment stands for where its part doesn't say.
EXPANDS = {"image": 576, "audio": 750, "document": 1024}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """A line's end becomes ``\\n`` and a backslash ``\\b``, so that each backslash says what it stands for."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """The content of a message that is plain text."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("long").alias("n_tokens")))


def flatten_parts(content: Column, first: Column) -> Column:
    """Visit the parts in order: struct(text, attachments); placeholders count from ``first``."""
    zero = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<number:bigint,type:string,ref:string,n_tokens:bigint>>").alias("attachments"))

    def visit(state: Column, part: Column) -> Column:
        kind = F.lower(F.coalesce(part["type"], F.lit("text")))
        number = (first + F.size(state["attachments"]) + 1).cast("long")
        tokens = F.coalesce(part["n_tokens"], *[F.when(kind == k, F.lit(v).cast("long")) for k, v in EXPANDS.items()], F.lit(0).cast("long"))
        entry = F.struct(number.alias("number"), kind.alias("type"), part["ref"].alias("ref"), tokens.alias("n_tokens"))
        attached = kind.isin(*EXPANDS)
        said = F.when(attached, F.concat(F.lit("<|"), kind, F.lit("_"), number.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
        return F.struct(F.concat(state["text"], said).alias("text"), F.when(attached, F.concat(state["attachments"], F.array(entry))).otherwise(state["attachments"]).alias("attachments"))

    return F.aggregate(F.coalesce(content, F.array().cast("array<struct<type:string,text:string,ref:string,n_tokens:bigint>>")), zero, visit)


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content") -> DataFrame:
    """Per conversation: id, n_turns, formatted, loss_spans (start, end), attachments, expanded_tokens."""
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    rows = messages.select(F.col(f"`{conv_col}`").alias("conv"), F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), F.col(f"`{content_col}`").alias("content")).alias("m"))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    zero_type = "struct<pieces:array<struct<head:string,body:string,loss:boolean>>,attachments:array<struct<number:bigint,type:string,ref:string,n_tokens:bigint>>>"
    plain = F.forall("turns", lambda m: F.forall(m["content"], lambda p: F.lower(F.coalesce(p["type"], F.lit("text"))).isin(*EXPANDS) == F.lit(False)))

    def piece(m: Column, body: Column) -> Column:
        return F.struct(F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n")).alias("head"), body.alias("body"), (m["role"] == "assistant").alias("loss"))

    # Without attachments a turn doesn't depend on those before it, so it needs no running state.
    alone = F.struct(
        F.transform("turns", lambda m: piece(m, F.concat_ws("", F.transform(m["content"], lambda p: escape(F.coalesce(p["text"], F.lit(""))))))).alias("pieces"),
        F.array().cast("array<struct<number:bigint,type:string,ref:string,n_tokens:bigint>>").alias("attachments"),
    )

    def add(state: Column, m: Column) -> Column:
        flat = flatten_parts(m["content"], F.size(state["attachments"]))
        return F.struct(F.concat(state["pieces"], F.array(piece(m, flat["text"]))).alias("pieces"), F.concat(state["attachments"], flat["attachments"]).alias("attachments"))

    empty = F.struct(F.array().cast("array<struct<head:string,body:string,loss:boolean>>").alias("pieces"), F.array().cast("array<struct<number:bigint,type:string,ref:string,n_tokens:bigint>>").alias("attachments"))
    running = F.aggregate("turns", empty, add)
    made = turns.withColumn("made", F.when(plain, alone.cast(zero_type)).otherwise(running.cast(zero_type)))

    spans_type = "array<struct<start:bigint,end:bigint>>"
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans_type).alias("spans"))

    def measure(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        mine = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(p["loss"], F.concat(state["spans"], mine)).otherwise(state["spans"]).alias("spans"))

    return made.select(
        F.col("conv").alias(conv_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("made.pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END)))).alias("formatted"),
        F.aggregate("made.pieces", begin, measure)["spans"].alias("loss_spans"),
        F.col("made.attachments").alias("attachments"),
        F.aggregate("made.attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation whose parts are text."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        line = F.instr(piece, "\n")
        body = F.substring(piece, line + 1, F.length(piece) - line - len(END))
        return F.struct(_unescape_role(F.substring(piece, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """Text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
