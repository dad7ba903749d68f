"""Chat formatting as relational work: sorted turn structs, merged runs, one text per conversation.

The template writes each run of turns of one role as

    <s>[INST]role[/INST]text[NEXT]text</s>

A control string inside a role or text gets a backslash after its first character, as does one
that already carries backslashes there, so that reading the output back restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.store import let

# The template's control strings.
OPEN, ROLE_OPEN, ROLE_CLOSE, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "[NEXT]", "</s>"
LEARNED_ROLE = "assistant"

_CONTROL = r"(s>|/s>|INST\]|/INST\]|NEXT\])"
_RAW = r"([<\[])(\\*)" + _CONTROL
_ESCAPED = r"([<\[])\\(\\*)" + _CONTROL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _runs(turns: Column) -> Column:
    """Adjacent turns of one role as (role, texts), escaped."""

    def of(turn: Column) -> Column:
        size = F.size(turn)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(turn, i)["role"] != F.get(turn, i - 1)["role"]))
        return let(starts, lambda at: F.transform(
            at, lambda start, k: let(
                F.slice(turn, start + 1, F.coalesce(F.get(at, k + 1), size) - start),
                lambda run: F.struct(
                    F.get(run, F.lit(0))["role"].alias("role"),
                    F.transform(run, lambda t: escape(t["text"])).alias("texts")))))

    return let(turns, of)


def _pieces(runs: Column) -> Column:
    """The output cut where the loss mask changes: (text, loss)."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(run: Column) -> Column:
        head = F.concat(F.lit(OPEN + ROLE_OPEN), escape(run["role"]), F.lit(ROLE_CLOSE))
        texts = F.transform(run["texts"], lambda t, k: F.concat(
            F.when(k == 0, F.array().cast("array<struct<text:string,loss:boolean>>"))
            .otherwise(F.array(piece(F.lit(NEXT), F.lit(False)))),
            F.array(piece(t, run["role"] == LEARNED_ROLE))))
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(texts),
                        F.array(piece(F.lit(CLOSE), F.lit(False))))

    return F.flatten(F.transform(runs, of))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, pieces) per conversation of (conv_id, turn, role, text).

    ``pieces`` cuts ``formatted`` where the loss mask changes; their texts joined give it whole.
    Rows are ordered by turn, then role and text; a missing turn comes first, and rows that repeat
    one turn are all kept. A null role or text is empty; rows without conv_id are one conversation.
    An empty table gives an empty result; other columns are not read. A conversation is one output
    row, so its turns meet in one task; whoever writes one conversation very often adds rows, not
    length.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    pieces = ordered.select("conv_id", _pieces(_runs(F.col("turns"))).alias("pieces"))
    return pieces.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        "pieces")


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted text, in order."""
    runs = F.split(formatted, F.lit(CLOSE), -1)
    runs = F.filter(runs, lambda run: run != "")

    def turns(run: Column) -> Column:
        halves = F.split(F.substring(run, len(OPEN + ROLE_OPEN) + 1, 2**31 - 1), r"\[/INST\]", 2)
        return let(halves, lambda half: F.transform(
            F.split(F.get(half, F.lit(1)), r"\[NEXT\]", -1),
            lambda text: F.struct(unescape(F.get(half, F.lit(0))).alias("role"),
                                  unescape(text).alias("text"))))

    return F.flatten(F.transform(runs, turns))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What can be read back from `format_chats`, as counts and digests."""
    learned = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"]))
    return (
        chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                     F.array_join(learned, "").alias("learned"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
                t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.char_length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
        )
    )
