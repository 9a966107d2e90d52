"""Chat formatting with typed content parts, in DataFrame functions only.

A message is a list of parts. The visitor turns a text part into escaped text
and an image, audio or document part into a numbered placeholder; it records
each attachment's reference and the tokens that the placeholder expands to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
START, END = "<|im_start|>", "<|im_end|>\n"
END_PATTERN = r"<\|im_end\|>\n"

#: Tokens that one attachment of a kind stands for unless its part says otherwise.
EXPANDED_TOKENS = {"image": 256, "audio": 188, "document": 512}

PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    """Every control string starts with ``<|``; escaped text never holds it. Backslashes are doubled first, so this can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role ends at the first line end, so its own are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A message that is plain text, as a list of parts; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _visit(part: Column, at: Column) -> Column:
    """struct(body, kind, ref, tokens) of one part; kinds that are not known stay visible as placeholders."""
    kind = F.coalesce(part.kind, F.lit("text"))
    is_text = kind == "text"
    tokens = F.coalesce(part.tokens, *[F.when(kind == k, F.lit(n).cast("bigint")) for k, n in EXPANDED_TOKENS.items()], F.lit(1).cast("bigint"))
    mark = F.concat(F.lit("<|"), escape_role(kind), F.lit(":"), at.cast("string"), F.lit("|>"))
    return F.struct(
        F.when(is_text, escape(F.coalesce(part.text, F.lit("")))).otherwise(mark).alias("body"),
        kind.alias("kind"),
        part.ref.alias("ref"),
        F.when(is_text, F.lit(0).cast("bigint")).otherwise(tokens).alias("tokens"),
    )


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None, text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss, attachments, expanded_tokens.

    loss has, for each turn in order, the start and length (in code points,
    within that turn's formatted text) of what is trained on: the whole body of
    an assistant's turn, nothing of the others. Rows are ordered by turn, then
    role and text, nulls first, so ties and repeated rows have a defined place;
    a null role is empty. An empty table gives an empty result.
    """
    visited = F.transform(parts if parts is not None else text_part(F.col(text)), _visit)
    turns = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), visited.alias("parts"))
    turns = turns.select(
        "conv_id", "turn", "role",
        F.concat_ws("", F.transform("parts", lambda p: p.body)).alias("body"),
        F.filter("parts", lambda p: p.kind != "text").alias("attached"),
    )
    message = F.struct("turn", "role", "body", "attached")
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("turns"))

    def shown(t: Column) -> Column:
        return F.concat(F.lit(START), escape_role(t.role), F.lit("\n"), t.body, F.lit(END))

    def mask(t: Column) -> Column:
        head = F.length(escape_role(t.role)) + len(START) + 1
        return F.struct(head.cast("long").alias("start"), F.when(t.role == "assistant", F.length(t.body)).otherwise(F.lit(0)).cast("long").alias("length"))

    attachments = F.flatten(F.transform("turns", lambda t, i: F.transform(t.attached, lambda p: F.struct(i.alias("turn"), p.kind.alias("kind"), p.ref.alias("ref"), p.tokens.alias("tokens")))))
    return ordered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("turns", shown)).alias("formatted"),
        F.transform("turns", mask).alias("loss"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a.tokens))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role,text>>, escapes undone; placeholders stay in the text."""
    shown = F.slice(F.split(formatted, END_PATTERN), 1, F.greatest(F.size(F.split(formatted, END_PATTERN)) - 1, F.lit(0)))

    def parse(t: Column) -> Column:
        inner = F.substring(t, len(START) + 1, 2147483647)
        cut = F.instr(inner, F.lit("\n"))
        return F.struct(unescape_role(F.substring(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(inner, cut + 1, F.lit(2147483647))).alias("text"))

    return F.transform(shown, parse)


def trained_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, in order, escapes undone."""
    shown = F.split(formatted, END_PATTERN)
    pieces = F.zip_with(F.slice(shown, F.lit(1), F.size(loss)), loss, lambda t, m: F.when(m.length > 0, unescape(F.substring(t, (m.start + 1).cast("int"), m.length.cast("int")))).otherwise(F.lit("")))
    return F.concat_ws("", pieces)
