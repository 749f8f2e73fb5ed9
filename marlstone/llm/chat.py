"""Preference formatting of conversations, by DataFrame functions alone.

Conversations 2k and 2k + 1 are the chosen and the rejected side of pair k. Turns are compared
position by position (turn number, null last, then role and text among rows that repeat it); the
first position that differs ends the common prefix. The prefix is rendered once, as ``prompt``, and
what follows on either side as the pair of completions ``chosen`` and ``rejected``. A mask lists the
ranges of a completion (first code point and the one after the last, as ``start:stop``) that count for
training: text and end mark of assistant turns, not their role header.

The result has a row for each pair and block of 1024 turn numbers, and for each 1024 rows that repeat a
turn number, so no conversation of any length becomes one row: the prompt of a pair is the
concatenation of its rows' prompts, and so are the completions. Turns are shuffled once, by pair and block.

Defined cases: null roles and texts render as empty; null turns come last, in rows with a null block; a
conversation without partner has ``paired`` false, its turns on its own side and empty masks; so has each
turn with a null conv_id, in a row of its own; equal conversations give a prompt and empty completions;
repeated rows are turns of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK_BITS = 10
#: Where null turns stand: behind every turn and every block of turns.
_NULL_TURN, _NULL_BLOCK = "9223372036854775808BD", 1 << 62
_OCCURRENCES = "10000000000BD"


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns with their pair, side and position, one exchange by pair and block."""
    turn = F.col("turn").cast("bigint")
    t = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        turn.alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.shiftright(F.col("conv_id").cast("bigint"), 1).alias("pair_id"),
        F.pmod(F.col("conv_id").cast("bigint"), F.lit(2)).alias("side"),
        F.coalesce(F.shiftright(turn, BLOCK_BITS), F.lit(_NULL_BLOCK).cast("bigint")).alias("block"),
    )
    occ = F.row_number().over(Window.partitionBy("pair_id", "block", "turn", "side").orderBy("role", "text"))
    return t.repartition("pair_id", "block").withColumn("occ", occ.cast("bigint"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, paired, block, piece, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    known = turns(conversations.filter("conv_id is not null"))
    # there is one row for each position and side, so the aggregate only puts both sides in one row
    side = lambda k, name: F.max(F.when(F.col("side") == k, F.struct("role", "text"))).alias(name)
    both = known.groupBy("pair_id", "block", "turn", "occ").agg(side(0, "a"), side(1, "b"))
    order = (F.coalesce(F.col("turn").cast("decimal(20,0)"), F.expr(_NULL_TURN)).cast("decimal(20,0)") * F.expr(_OCCURRENCES) + F.col("occ")).cast("decimal(38,0)")
    both = both.withColumn("at", order)
    same = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.role") == F.col("b.role")) & (F.col("a.text") == F.col("b.text"))
    pairs = both.groupBy("pair_id").agg(F.min(F.when(~same, F.col("at"))).alias("cut"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.collect_set("block").alias("blocks"))
    cuts = pairs.select("pair_id", "cut", (F.col("n_a") * F.col("n_b") > 0).alias("paired"), F.explode("blocks").alias("block"))
    joined = both.join(cuts, ["pair_id", "block"])
    row = lambda col, part: F.when(F.col(col).isNotNull(), F.struct(F.lit(part).alias("part"), F.col(f"{col}.role").alias("role"), F.col(f"{col}.text").alias("text")))
    before = F.col("paired") & (F.col("cut").isNull() | (F.col("at") < F.col("cut")))
    parts = F.when(before, F.array(row("a", "prompt"))).otherwise(F.filter(F.array(row("a", "chosen"), row("b", "rejected")), lambda x: x.isNotNull()))
    rows = joined.select("pair_id", "block", F.shiftright(F.col("occ") - 1, BLOCK_BITS).alias("piece"), "paired", "at", F.explode(parts).alias("s")).select("pair_id", "block", "piece", "paired", "at", "s.*")
    text = segment(F.col("role"), F.col("text"))
    ahead = F.sum(F.length(text).cast("bigint")).over(Window.partitionBy("pair_id", "block", "piece", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("segment", text).withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    trained = F.col("paired") & (F.col("role") == "assistant")
    start = F.col("ahead") + len(OPEN) + 1 + F.length("role")
    span = F.concat(start.cast("string"), F.lit(":"), (F.col("ahead") + F.length("segment")).cast("string"))

    def joined_up(condition: Column, value: Column, between: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(condition, F.struct("at", value.alias("v")))))
        return F.array_join(F.transform(found, lambda x: x["v"]), between)

    part = lambda name: F.col("part") == name
    paired = rows.groupBy("pair_id", "block", "piece").agg(
        F.first("paired").alias("paired"),
        F.count(F.when(part("prompt"), 1)).alias("prompt_turns"),
        *[joined_up(part(p), F.col("segment"), "").alias(p) for p in ("prompt", "chosen", "rejected")],
        *[joined_up(part(p) & trained, span, ",").alias(f"{p}_mask") for p in ("chosen", "rejected")],
    )
    block = F.when(F.col("block") != _NULL_BLOCK, F.col("block"))
    ids = [(F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id")]
    out = paired.select("pair_id", *ids, "paired", block.alias("block"), "piece", "prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    none, zero, empty = F.lit(None).cast("bigint"), F.lit(0).cast("bigint"), F.lit("")
    alone = conversations.filter("conv_id is null").select(
        none.alias("pair_id"), none.alias("chosen_id"), none.alias("rejected_id"), F.lit(False).alias("paired"),
        F.shiftright(F.col("turn").cast("bigint"), BLOCK_BITS).alias("block"), zero.alias("piece"), zero.alias("prompt_turns"), empty.alias("prompt"),
        segment(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("chosen"), empty.alias("rejected"), empty.alias("chosen_mask"), empty.alias("rejected_mask"),
    )
    return out.unionByName(alone)
