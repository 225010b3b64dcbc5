"""Conversations to training strings with a reversible template and a loss mask, in DataFrame functions only.

A turn's content is a list of typed parts. A visitor flattens them in order: text is escaped, and image, audio
and document parts become placeholders, their references and expanded token counts recorded as attachments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template and placeholders of parts. None holds a backslash or another of them.
TURN, SAYS, ENDS, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
MEDIA = ("image", "audio", "document")
CONTROL = (TURN, SAYS, ENDS, CLOSE, *(f"<|{m}|>" for m in MEDIA))
PART = "array<struct<type:string,text:string,ref:string,n_tokens:long>>"


def escape(text: Column) -> Column:
    """Double backslashes and break every control string with one after its first character."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, text)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The parts of a turn that is text only."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("n_tokens"))).cast(PART)


def visit(parts: Column) -> Column:
    """The flattened content. Types are matched exactly; of unknown ones the text is taken."""
    one = lambda p: F.when(p["type"].isin(*MEDIA), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))
    return F.coalesce(F.array_join(F.transform(parts, one), ""), F.lit(""))


def plain(parts: Column) -> Column:
    """The content by which tied turns are ordered: texts as they are, placeholders of the rest."""
    one = lambda p: F.when(p["type"].isin(*MEDIA), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(F.coalesce(p["text"], F.lit("")))
    return F.coalesce(F.array_join(F.transform(parts, one), ""), F.lit(""))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans, attachments and expanded_tokens for each conv_id of ``turns``.

    ``turns`` has conv_id, turn, role and parts (see PART) or text. Turns go by turn number, ties by role and
    content; a null number is first. Each is ``<s>role[INST]content[/INST]</s>``. loss_spans are code point
    ranges [start, end) of formatted with the contents of ``trained_role``, in order. attachments list turn,
    type, ref and n_tokens of the placeholders in order; expanded_tokens is their sum.

    Null roles and texts, and null, empty or missing parts, are empty strings. Rows with a null conv_id are
    one conversation. Repeated rows are turns of their own. No turns, no conversations. A conversation is one
    output row, so it has to fit a task.
    """
    parts = F.col("parts").cast(PART) if "parts" in turns.columns else text_part(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", visit(F.col("parts")).alias("content"), plain(F.col("parts")).alias("plain"), F.filter("parts", lambda p: p["type"].isin(*MEDIA)).alias("media"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)))
    rows = rows.withColumn("line", F.concat("head", "content", F.lit(ENDS + CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain", "content")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("start", F.sum(F.length("line")).over(upto) - F.length("line") + F.length("head"))
    rows = rows.withColumn("end", F.col("start") + F.length("content"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "turn", "role", "line", "start", "end", "media"))).alias("t"))
    media = F.flatten(F.transform("t", lambda t: F.transform(F.coalesce(t["media"], F.array().cast(PART)), lambda p: F.struct(t["turn"].alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["n_tokens"], F.lit(0)).alias("n_tokens")))))
    out = listed.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["line"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["role"] == trained_role), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
        media.alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted string; placeholders stay as they are."""
    lines = F.slice(F.split(formatted, CLOSE, -1), 1, F.greatest(F.size(F.split(formatted, CLOSE, -1)) - 1, F.lit(0)))

    def turn(line: Column) -> Column:
        head = F.substring_index(line, SAYS, 1)
        content = F.substring(line, F.length(head) + len(SAYS) + 1, F.length(line) - F.length(head) - len(SAYS) - len(ENDS))
        return F.struct(unescape(F.substring(head, F.lit(len(TURN) + 1), F.length(head))).alias("role"), unescape(content).alias("text"))

    return F.transform(lines, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
