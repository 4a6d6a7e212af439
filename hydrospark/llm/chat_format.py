"""Preference pairs as prompt and masked completions, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Markers around a turn; the roles whose text is trained on.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = ("assistant",)


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _rendered_all(turns: str) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _tail(turns: str) -> Column:
    """The turns after the shared ones."""
    return F.slice(turns, F.col("n_prompt") + 1, F.size(turns) - F.col("n_prompt"))


def _mask(turns: str, base: Column) -> Column:
    """Spans [start, end) in code points, counted from the end of the prompt, that carry loss:
    the text and closing marker of each trained turn."""
    state = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def step(done: Column, turn: Column) -> Column:
        start = done["at"] + F.length(turn["role"]) + F.lit(len(OPEN) + len(MIDDLE))
        end = start + F.length(turn["text"]) + F.lit(len(CLOSE))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(turn["role"].isin(*TRAINED), F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans")).cast(state)

    first = F.struct(base.alias("at"), F.array().alias("spans")).cast(state)
    return F.aggregate(turns, first, step, lambda done: done["spans"])


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair of conversations: their shared prompt and two masked completions.

    ``turns`` has ``conv_id, turn, role, text``; ``pairs`` has ``pair_id, conv_id, side`` with
    one ``chosen`` and one ``rejected`` conversation each.  Turns are ordered by ``turn``
    (ties: role, then text); a null role or text counts as empty.  The prompt is the longest
    common prefix of whole turns, rendered once; the completions are the rest, and their
    masks list the spans with loss.  Equal conversations have empty completions.  A pair
    lacking a side, or a side without turns, gives an empty conversation for it.

    A row holds its two conversations, so one conversation must fit a row; conversations
    shared by many pairs are joined by ``conv_id`` without being gathered in one group.
    """
    said = turns.select("conv_id", "turn", "role", "text")
    named = pairs.where(F.col("pair_id").isNotNull()).select("pair_id", "side", F.col("conv_id"))
    return format_pairs(named.join(said.withColumn("there", F.lit(True)), "conv_id", "left"))


def format_pairs(said: DataFrame) -> DataFrame:
    """``preference_pairs`` of turns that carry their ``pair_id`` and ``side``; ``there`` is null for a side without turns."""
    turn = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = said.select("pair_id", "side", F.when(F.col("there"), turn).alias("said"))
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("said"))))
    rows = both.groupBy("pair_id").agg(side("chosen").alias("chosen"), side("rejected").alias("rejected"))
    for name in ("chosen", "rejected"):
        rows = rows.withColumn(name, F.transform(name, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a == b, F.lit(False)))
    differs = F.array_position(same, F.lit(False)).cast("int")
    rows = rows.withColumn("n_prompt", F.when(differs > 0, differs - 1).otherwise(F.size(same)))
    out = rows.select(
        "pair_id", "n_prompt", _rendered_all_of("chosen").alias("prompt"),
        _tail("chosen").alias("chosen"), _tail("rejected").alias("rejected"))
    zero = F.lit(0)
    return out.select(
        "pair_id", F.col("n_prompt").alias("prompt_turns"), "prompt",
        _rendered_all("chosen").alias("chosen"), _mask("chosen", zero).alias("chosen_mask"),
        _rendered_all("rejected").alias("rejected"), _mask("rejected", zero).alias("rejected_mask"))


def _rendered_all_of(turns: str) -> Column:
    """The shared turns, rendered."""
    return F.array_join(F.transform(F.slice(turns, F.lit(1), F.col("n_prompt")), _rendered), "")


def answer_pairs(turns: DataFrame) -> DataFrame:
    """Every conversation as a pair of its own, for ``format_pairs``: chosen is the whole conversation, rejected
    the same up to its last assistant turn, which is answered by its neighbour (2k and 2k + 1 answer for each other).

    Without such a neighbour the rejected side ends with the prompt; a conversation without an assistant
    turn is all prompt, and only a neighbour's answer may follow.  Turns that share the number of the last
    assistant turn are left out with it, of several assistant turns there the greatest text answers.
    Turns without ``conv_id`` belong to no pair.  One shuffle by conversation finds the last turns; only answers cross over.
    """
    named = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("pair_id"), F.coalesce(F.col("turn").cast("int"), F.lit(-1)).alias("turn"), "role", "text")
    answer = F.when(F.col("role") == "assistant", F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    seen = named.withColumn("last", F.max(answer).over(W.partitionBy("pair_id"))).withColumn(
        "first", F.row_number().over(W.partitionBy("pair_id").orderBy("turn", "role", "text")) == 1)
    before = F.col("last").isNull() | (F.col("turn") < F.col("last.turn"))
    as_side = lambda pair, side, turn, role, text: F.struct(
        pair.alias("pair_id"), F.lit(side).alias("side"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.lit(True).alias("there"))
    own = [F.col(c) for c in ("turn", "role", "text")]
    answered = as_side(F.col("pair_id").bitwiseXOR(F.lit(1)), "rejected", F.lit(2**31 - 1), F.lit("assistant"), F.col("last.text"))
    rows = F.array_compact(F.array(
        as_side(F.col("pair_id"), "chosen", *own), F.when(before, as_side(F.col("pair_id"), "rejected", *own)),
        F.when(F.col("first") & F.col("last").isNotNull(), answered)))
    return seen.select(F.explode(rows).alias("r")).select("r.*")


def answered_pairs(turns: DataFrame) -> DataFrame:
    """``format_pairs`` of ``answer_pairs``; pairs are those of conversations that exist."""
    made = answer_pairs(turns)
    own = F.max(F.col("side") == "chosen").over(W.partitionBy("pair_id"))
    return format_pairs(made.withColumn("own", own).where("own").drop("own"))


def id_pairs(turns: DataFrame) -> DataFrame:
    """Every conversation in one pair with its neighbour by id: 2k is chosen, 2k + 1 rejected."""
    ids = turns.select("conv_id").where(F.col("conv_id").isNotNull()).distinct()
    return ids.select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"), "conv_id",
        F.when(F.pmod(F.col("conv_id"), F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"))


def spans_text(mask) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
