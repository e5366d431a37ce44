"""Preference formatting: chosen and rejected conversations become one prompt and two masked completions.

A pair's two conversations are compared turn by turn, role and text; their longest common prefix is rendered once as the
prompt, the remaining turns of each as its completion. A turn is rendered as ``<|im_start|>role``, a line end, the text,
``<|im_end|>`` and a line end. The mask of a completion lists the spans (code points, end exclusive, ``a:b`` joined by commas) that
a loss applies to: the texts of assistant turns with their end mark.

All of it is DataFrame functions; one shuffle brings a pair's turns together, with repeated rows dropped on the map side. A
null role is ``user``, a null text empty, a null turn comes first; turns with one number are ordered by role and text. Rows with a
null conv_id are in no pair. A pair with one conversation has an empty prompt and a null completion on the other side; equal
conversations have two empty completions. Very long texts are rendered whole. A pair's distinct turns meet in one row, as its
prompt is one string; their number is that of a conversation. An empty table gives no rows. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Spans of the assistant turns' texts and end marks in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        low = s["at"] + len(OPEN) + F.length(t["role"]) + 1
        high = low + F.length(t["text"]) + len(CLOSE)
        span = F.concat_ws(":", low.cast("string"), (high - 1).cast("string"))
        return F.struct(high.alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda s: F.array_join(s["spans"], ","))


def _formatted(sides: DataFrame) -> DataFrame:
    """The pairs of sides (pair_id, c, r), arrays of (role, text), as prompt and completions; an empty array is a side that is missing."""
    differ = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False)
    shared = sides.withColumn("prompt_turns", F.when(differ == 0, F.size("c")).otherwise(differ - 1).cast("int"))
    rest = lambda side: F.when(F.size(side) > 0, F.slice(F.col(side), F.col("prompt_turns") + 1, F.greatest(F.size(side), F.lit(1))))
    cut = shared.withColumns({"prompt": F.slice("c", F.lit(1), F.col("prompt_turns")), "c": rest("c"), "r": rest("r")})
    return cut.select("pair_id", _rendered(F.col("prompt")).alias("prompt"), "prompt_turns", _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def preference_pairs(conversations: DataFrame, pair: Column, rejected: Column) -> DataFrame:
    """(pair_id, prompt, prompt_turns, chosen, rejected, chosen_mask, rejected_mask) of each pair; rejected tells the sides apart."""
    turn = F.struct(rejected.alias("side"), F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.filter(pair.isNotNull() & rejected.isNotNull()).groupBy(pair.alias("pair_id")).agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    side = lambda which: _plain(F.filter("turns", lambda t: t["side"] == which))
    return _formatted(grouped.select("pair_id", side(False).alias("c"), side(True).alias("r")))


def answer_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs that share their turns up to the last answer: each conversation is chosen, and rejected with another's last answer instead.

    The other conversation of 2n is 2n + 1 and the reverse; the pair has the number of the chosen one. Turns from the last
    assistant turn on are those that differ. A conversation without an answer, or whose neighbour has none, has no rejected side.
    Only the answers move a second time.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("pair_id")).agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    ready = grouped.withColumn("last", F.try_element_at(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(-1)))
    others = ready.filter("last is not null").select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("of"), F.col("last.text").alias("other"))
    both = ready.join(others, F.col("pair_id") == F.col("of"), "left")
    before = F.filter("turns", lambda t: t["turn"].isNull() | (t["turn"] < F.col("last.turn")))
    answer = F.struct(F.col("last.turn").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    swapped = F.sort_array(F.array_distinct(F.concat(before, F.array(answer))))
    rejected = F.when(F.col("last").isNotNull() & F.col("other").isNotNull(), _plain(swapped)).otherwise(_plain(F.slice("turns", 1, 0)))
    return _formatted(both.select("pair_id", _plain(F.col("turns")).alias("c"), rejected.alias("r")))


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2n and 2n + 1 are pair n: the even one is chosen, the odd one rejected."""
    odd = F.pmod("conv_id", F.lit(2))
    return preference_pairs(conversations, F.expr("(conv_id - pmod(conv_id, 2)) div 2"), odd == 1)
