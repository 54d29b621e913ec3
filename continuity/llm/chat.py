"""Preference formatting.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role
and text) is rendered once, as the prompt; what follows in each is rendered as its completion,
with the spans of characters that training may learn from: the text and the end mark of turns
by the learning role. All other characters of a completion are masked.

A turn is rendered as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line
feed. ``<|`` within a role or text is broken by a space, so no text can end its turn.

A conversation is one rendered value, so its turns meet in one row; nothing else is gathered.
Pairs are made by key, each conversation is in one pair at most.

Pairs that share a history are made from single conversations by ``swapped_replies``: the chosen
side ends with the conversation's last reply, the rejected side with that of another one.

Defined cases: turns are ordered by number, null first, equal numbers by role and text; turns
that repeat are kept. A null role or text renders empty, and equals another null. Pairs of
equal conversations have empty completions. A conversation without a partner gives no row, nor
does one without a reply, or whose partner has none, where replies are swapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuity.llm.columns import column, let

START, END = "<|im_start|>", "<|im_end|>"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _plain(turn["role"]), F.lit("\n"))


def _tail(turn: Column) -> Column:
    return F.concat(_plain(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    """The turns of an array as one text."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(_head(t), _tail(t), F.lit("\n"))), ""
    )


def learned_spans(turns: Column, role: str) -> Column:
    """Spans (start, end) of the rendered turns that are not masked, in characters."""
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + F.char_length(_head(t))
        end = begin + F.char_length(_tail(t))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            (end + 1).alias("at"),
            F.when(t["role"].eqNullSafe(role), F.concat(state["spans"], span))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns both arrays begin with."""
    same = F.zip_with(
        chosen,
        rejected,
        lambda a, b: a.isNotNull() & b.isNotNull()
        & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]),
    )
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_pairs(
    turns: DataFrame,
    pair: Column,
    is_chosen: Column,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected,
    and the spans to learn from in both.

    ``pair`` gives a turn's pair, null for none; ``is_chosen`` which of the two conversations it
    belongs to.
    """
    rows = turns.select(
        pair.alias("pair_id"),
        is_chosen.alias("side"),
        column(conv_id).alias("conv_id"),
        F.struct(
            column(turn).cast("bigint").alias("turn"),
            column(role).alias("role"),
            column(text).alias("text"),
        ).alias("one"),
    ).filter(F.col("pair_id").isNotNull())

    def side(chosen: bool) -> Column:
        of = F.collect_list(F.when(F.col("side") == chosen, F.col("one")))
        return F.sort_array(of).cast(_TURNS)

    def owner(chosen: bool) -> Column:
        return F.min(F.when(F.col("side") == chosen, F.col("conv_id")))

    pairs = rows.groupBy("pair_id").agg(
        owner(True).alias("chosen_id"),
        owner(False).alias("rejected_id"),
        side(True).alias("a"),
        side(False).alias("b"),
    )
    return _formatted(pairs.filter((F.size("a") > 0) & (F.size("b") > 0)), learn)


def swapped_replies(
    turns: DataFrame,
    partner: Column,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """A pair of every conversation with a reply (a turn by ``learn``), in the columns of
    ``format_pairs``; pair_id and chosen_id are its id, rejected_id the partner's.

    Both sides are its turns up to its last reply; on the rejected side the text of that reply is
    the partner's last one. ``partner`` gives a turn's partner conversation by its id; each should
    be the partner of few. Turns after the last reply are left out.
    """
    rows = turns.select(
        column(conv_id).alias("conv_id"),
        partner.alias("partner"),
        F.struct(
            column(turn).cast("bigint").alias("turn"),
            column(role).alias("role"),
            column(text).alias("text"),
        ).alias("one"),
    ).filter(F.col("conv_id").isNotNull())
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).cast(_TURNS).alias("turns"))
    is_reply = F.reverse(F.transform("turns", lambda t: t["role"].eqNullSafe(learn)))
    after = F.array_position(is_reply, True)
    upto = grouped.filter(after > 0).withColumn(
        "turns", F.slice("turns", F.lit(1), F.size("turns") - after.cast("int") + 1)
    )
    # Only replies move to the conversations that they are given to; turns move once.
    partners = rows.groupBy("conv_id").agg(F.min("partner").alias("partner"))
    replies = (
        rows.filter(F.col("one.role").eqNullSafe(learn))
        .groupBy(F.col("conv_id").alias("partner"))
        .agg(F.max("one").alias("last"))
        .select("partner", F.col("last.text").alias("reply"))
    )
    given = partners.join(replies, "partner")
    last = F.element_at("turns", -1)
    swapped = F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.col("reply").alias("text"))
    pairs = upto.join(given, "conv_id").select(
        F.col("conv_id").alias("pair_id"),
        F.col("conv_id").alias("chosen_id"),
        F.col("partner").alias("rejected_id"),
        F.col("turns").alias("a"),
        F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array(swapped)).alias("b"),
    )
    return _formatted(pairs, learn)


def _formatted(pairs: DataFrame, learn: str) -> DataFrame:
    """Prompt, completions and spans of pairs with their turns as arrays ``a`` and ``b``."""
    counted = pairs.withColumn("n_common", common_turns(F.col("a"), F.col("b")))

    def rest(name: str) -> Column:
        return F.slice(F.col(name), F.col("n_common") + 1, F.size(name))

    return counted.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common",
        render(F.slice("a", F.lit(1), F.col("n_common"))).alias("prompt"),
        let(rest("a"), render).alias("chosen"),
        let(rest("b"), render).alias("rejected"),
        learned_spans(rest("a"), learn).alias("chosen_spans"),
        learned_spans(rest("b"), learn).alias("rejected_spans"),
    )
