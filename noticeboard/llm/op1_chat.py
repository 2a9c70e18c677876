"""Chat formatting with typed content parts, in column expressions only.

A turn holds parts (kind text, image, audio or document). A visit over the parts flattens them, in order, into one
string: texts are escaped (texts side by side as one, so that no control string arises between them), attachments become placeholders, and each attachment is recorded with its reference
and the number of tokens that its placeholder stands for. Turns are framed by control strings; a control string
inside a text or role gets a backslash after its first character (one more if it has some already), which
unescape() takes out again, so every text can be read back exactly.

Nulls and ties: null text is empty, a null role the empty role; a null part list is an empty turn; null sizes count
the least tokens of their kind; a null conversation id is one conversation; turns of equal number are ordered by
role, then parts; null turns come first; extra columns are ignored. A conversation is one output row, so its size
is bounded by what a cell can hold.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
START, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
# Strings that models of several families treat as control, besides those of this template.
_TAILS = (r"\|(?:turn|text|end|image|audio|document|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS>>|<SYS>>|<\/SYS>>")
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = rf"([<\[])\\(\\*)({_TAILS})"
IMAGE_PATCH = 28
AUDIO_RATE = 25
PAGE_TOKENS = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def text_part(text: Column) -> Column:
    """A list of one text part."""
    nothing = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), nothing("string").alias("ref"),
                            nothing("int").alias("width"), nothing("int").alias("height"),
                            nothing("double").alias("seconds"), nothing("int").alias("pages")))


def visited(parts: Column) -> Column:
    """Parts as they stand in the formatted text: texts gather until an attachment or the end, then are escaped."""
    def state(done: Column, text: Column) -> Column:
        return F.struct(done.alias("done"), text.alias("text"))

    def visit(s: Column, part: Column) -> Column:
        kind = part["kind"]
        out = F.when(kind == "text", state(s["done"], F.concat(s["text"], F.coalesce(part["text"], F.lit("")))))
        for name, mark in PLACEHOLDERS.items():
            out = out.when(kind == name, state(F.concat(s["done"], escape(s["text"]), F.lit(mark)), F.lit("")))
        return out.otherwise(s)
    return F.aggregate(parts, state(F.lit(""), F.lit("")), visit, lambda s: F.concat(s["done"], escape(s["text"])))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to."""
    patches = lambda side: F.greatest(F.ceil(F.coalesce(side, F.lit(1)) / IMAGE_PATCH), F.lit(1))
    return (F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
            .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1)))
            .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS)
            .otherwise(0).cast("long"))


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts: array of PART) to one row per conversation: formatted (the text),
    loss_spans (start and length, in code points, of each assistant turn's content), attachments (turn position,
    part position, kind, ref, tokens) and expanded_tokens."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), escape(role), F.lit(SEP))
    body = visited(parts)
    attached = F.filter(F.transform(parts, lambda p, i: F.struct(
        i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))),
        lambda a: a["kind"].isin(*PLACEHOLDERS))
    rows = (turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts"), head.alias("head"),
                         body.alias("body"), attached.alias("attached"))
            .withColumns({"piece": F.concat("head", "body", F.lit(END)), "at": F.row_number().over(order)})
            .withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))))
    turn = F.struct("at", "piece", "attached", F.when(F.col("role") == "assistant", F.struct(
        (F.col("offset") + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length")))
        .alias("loss"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    lists = F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct(
        t["at"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"),
        a["tokens"].alias("tokens")))))
    return (grouped.select("conv_id", F.concat_ws("", F.col("turns.piece")).alias("formatted"),
                           F.filter(F.col("turns.loss"), lambda x: x.isNotNull()).alias("loss_spans"),
                           lists.alias("attachments"))
            .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; attachments stay placeholders."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    inner = lambda p: F.substring_index(p, END, 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(inner(p), SEP, 1)).alias("role"),
        unescape(F.substring_index(inner(p), SEP, -1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one turn after the other."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))
