"""Preference formatting of conversation pairs: one shared prompt, two masked completions.

Conversation 2k is the chosen, 2k + 1 the rejected side of pair k. The longest common prefix of
turns (same role and text) is rendered once as the prompt; what follows is rendered per side, with
the spans that a loss may look at: the words of assistant turns and the mark that ends them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.arrays import sums_before

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _safe(text: Column) -> Column:
    """Texts can't write marks: the bar inside one is doubled."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<||im_start||>")), F.lit(CLOSE), F.lit("<||im_end||>"))


def _head(t):
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def _body(t):
    return F.concat(t["text"], F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """``start:end`` of each trained span in the rendered turns, in code points, comma-joined."""
    starts = sums_before(F.transform(turns, lambda t: F.length(_head(t)) + F.length(_body(t)) + 1))
    spans = F.zip_with(turns, starts, lambda t, s: F.when(t["role"] == TRAINED, F.concat_ws(":", (s + F.length(_head(t))).cast("string"), (s + F.length(_head(t)) + F.length(_body(t))).cast("string"))))
    return F.array_join(spans, ",")  # other turns are null and left out


def _from(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def format_pairs(conversations: DataFrame) -> DataFrame:
    """One row per pair: pair_id, turns shared and left, prompt, completions and their masks.

    Turns go by number, then role, then text (nulls first); repeated rows count once; a null role or
    text is rendered empty. A side without conversation leaves its columns null and nothing is
    shared; equal conversations leave two empty completions. Rows without conv_id belong to none.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), _safe(F.coalesce("text", F.lit(""))).alias("text"))
    rows = conversations.where("conv_id is not null").select(F.shiftright(F.col("conv_id").cast("bigint"), 1).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), turn.alias("t"))
    side = lambda yes: F.array_sort(F.collect_set(F.when(F.col("is_chosen") == yes, F.col("t"))))
    df = rows.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")), lambda i: (F.get("c", i)["role"] == F.get("r", i)["role"]) & (F.get("c", i)["text"] == F.get("r", i)["text"]))
    first = F.array_position(same, False)
    df = df.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    out = ["pair_id", F.col("n_prefix").cast("bigint").alias("n_prefix"), _render(F.slice("c", F.lit(1), F.col("n_prefix"))).alias("prompt")]
    for name, c in (("chosen", "c"), ("rejected", "r")):
        there, rest = F.size(c) > 0, _from(F.col(c), F.col("n_prefix"))
        out += [F.when(there, F.size(rest).cast("bigint")).alias(f"n_{name}"), F.when(there, _render(rest)).alias(name), F.when(there, _mask(rest)).alias(f"{name}_mask")]
    return df.select(*out)
