"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its text alone
under the loss mask. Turns after the last assistant turn, which no reply covers, form one example more
without a mask, so the output holds every turn.

A turn is ``<|im_start|>role LF text<|im_end|> LF``. Control strings of common templates inside a text
get a backslash after their first character, and one more where there are some already; taking one away
again gives the text back. Roles are URL-encoded, which leaves plain names as they are.

An example repeats its context, so the output grows with the square of a conversation's turns; that is
what the expansion asks for. A conversation, like a document, is one record and is put together in one
task; conversations are spread by their id.

Defined cases: a null text or role is the empty text. Turns are taken by turn, then role, then text;
a null turn comes first; rows that repeat are turns that repeat. Rows with a null id are one
conversation. Only a role equal to ``target`` is trained. Extra columns are left out, since a
conversation has no one value for them. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of common chat templates, as their first character and the rest.
_ANGLE = r"\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>"
_SQUARE = r"/?INST\]"
CONTROL = rf"(<)(\\*)({_ANGLE})|(\[)(\\*)({_SQUARE})"
ESCAPED = rf"(<)\\(\\*)({_ANGLE})|(\[)\\(\\*)({_SQUARE})"


def escape(text: Column) -> Column:
    """``text`` without any control string in it; ``unescape`` gives it back."""
    return F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$4$2$5$3$6")


def examples(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant"
) -> DataFrame:
    """One row per example: conv, example (from 0), target_turn, formatted, loss_start, loss_length.

    The mask is ``loss_length`` code points of ``formatted`` from ``loss_start``, counted from 0.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = turns.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("said"))
    rendered = whole.select(
        conv,
        F.transform("said", lambda t: t["turn"]).alias("turns"),
        F.transform("said", lambda t: t["role"] == target).alias("trained"),
        F.transform("said", lambda t: F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("said", lambda t: escape(t["text"])).alias("texts"),
    )
    n = F.size("texts")
    places = F.sequence(F.lit(0), n - 1)
    ends = F.concat(
        F.filter(places, lambda i: F.get("trained", i)),
        F.when(F.element_at("trained", -1), F.array().cast("array<int>")).otherwise(F.array(n)),
    )
    at, has = F.col("at"), F.col("at") < F.size("texts")
    context = F.array_join(
        F.transform(
            F.slice("texts", F.lit(1), at), lambda t, i: F.concat(F.get("heads", i), t, F.lit(END))
        ),
        "",
    )
    head = F.when(has, F.get("heads", at)).otherwise("")
    return (
        rendered.select("*", F.posexplode(ends).alias("example", "at"))
        .select(
            conv,
            "example",
            F.get("turns", at).alias("target_turn"),
            F.concat(context, head).alias("before"),
            F.when(has, F.get("texts", at)).alias("reply"),
        )
        .select(
            conv,
            "example",
            "target_turn",
            F.concat("before", F.coalesce(F.concat("reply", F.lit(END)), F.lit(""))).alias("formatted"),
            F.length("before").alias("loss_start"),
            F.coalesce(F.length("reply"), F.lit(0)).alias("loss_length"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as an array of role and text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            F.url_decode(F.substring_index(p.substr(F.lit(len(START) + 1), F.length(p)), "\n", 1)).alias("role"),
            unescape(p.substr(F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )


def masked(formatted: Column, loss_start: Column, loss_length: Column) -> Column:
    """The text under an example's loss mask, without escapes."""
    return unescape(formatted.substr(loss_start + 1, loss_length))
