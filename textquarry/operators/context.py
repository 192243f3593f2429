"""Conversation contexts: rendering, prefix caching, strategies that shorten them, and their cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what stands behind a cut tool output.
MARKER = " ...[truncated]"


def turn_line(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(": "), text, F.lit("\n"))


def render(turns: DataFrame, by: list[str], order: str = "turn", name: str = "rendered") -> DataFrame:
    """A conversation as one text."""
    lines = F.array_sort(F.collect_list(F.struct(order, turn_line(F.col("role"), F.col("text")).alias("line"))))
    return turns.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias(name))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Equal leading code points: from 2^30 down, each power of two is added while the pieces of that length agree."""
    n = F.least(F.length(a), F.length(b))
    piece = lambda c, lo, step: F.substring(c, lo + 1, step)
    longer = lambda lo, step: F.when((step <= n - lo) & (piece(a, lo, step) == piece(b, lo, step)), lo + step).otherwise(lo)
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), longer)


def prefix_is_stable(before: Column, after: Column) -> Column:
    return F.startswith(after, before)


def cache_hit_ratio(before: Column, after: Column) -> Column:
    return F.when(F.length(before) == 0, 1.0).otherwise(common_prefix_length(before, after) / F.greatest(F.length(before), F.lit(1)))


def cap_tool_output(content: Column, limit: int, marker: str = MARKER) -> Column:
    if limit <= 0:
        raise ValueError("limit must be positive")
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit(marker))).otherwise(content)


def estimate_cost(rendered: Column, cached: Column, price_per_1k: float = 0.003, discount: float = 0.1, chars_per_token: float = 4.0) -> Column:
    """Fresh characters at the full price, those of the cached prefix at a discount."""
    per_char = price_per_1k / 1000 / chars_per_token
    cost = lambda same: (F.length(rendered) - same) * per_char + same * per_char * discount
    return F.get(F.transform(F.array(common_prefix_length(cached, rendered)), cost), 0)  # the prefix is found once


def capped_history(turns: DataFrame, limit: int, tool_role: str = "tool") -> DataFrame:
    """Row by row, so it serves streams as well."""
    return turns.withColumn("text", F.when(F.col("role") == tool_role, cap_tool_output(F.col("text"), limit)).otherwise(F.col("text")))


def summarise_old(turns: DataFrame, keep_recent: int, summary: str, role: str = "system", by: str = "conv_id") -> DataFrame:
    """All but the last turns become one summary in front; short conversations stay as they are."""
    if keep_recent < 0:
        raise ValueError("keep_recent must not be negative")
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("turn")))
    numbered = turns.select(by, "turn", "role", "text", back.alias("back"))
    kept = numbered.filter(F.col("back") <= keep_recent).drop("back")
    cut = numbered.filter(F.col("back") == keep_recent + 1).select(by, F.lit(-1).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(summary).alias("text"))
    return kept.unionByName(cut)


def planted_probe(probes: DataFrame, filler_role: str = "tool") -> DataFrame:
    """(id, fact, question, filler array) to turns: the fact, the filler with acknowledgements, the question."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    # fixed values: what the assistant says after the fact and after each filler
    fact_ack, filler_ack = F.lit("הבנתי."), F.lit("בסדר.")
    middle = F.flatten(F.transform("filler", lambda f: F.array(turn(filler_role, f), turn("assistant", filler_ack))))
    turns = F.concat(F.array(turn("user", F.col("fact")), turn("assistant", fact_ack)), middle, F.array(turn("user", F.col("question"))))
    return probes.select(F.col("id").alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def strategies(turns: DataFrame, limit: int, keep_recent: int, summary: str, tool_role: str = "tool") -> DataFrame:
    """The turns under keep_all, summarise and cap, with a column `strategy`."""
    plain = turns.select("conv_id", "turn", "role", "text")
    made = {"keep_all": plain, "summarise": summarise_old(plain, keep_recent, summary), "cap": capped_history(plain, limit, tool_role)}
    named = [df.withColumn("strategy", F.lit(name)) for name, df in made.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def saved(sizes: DataFrame, baseline: str = "keep_all") -> DataFrame:
    """(strategy, chars) with the share that each strategy saves over the baseline."""
    base = sizes.filter(F.col("strategy") == baseline).agg(F.sum("chars").alias("_base"))
    return sizes.crossJoin(F.broadcast(base)).withColumn("saved", F.round(1 - F.try_divide("chars", "_base"), 6)).drop("_base")


def recalled(contexts: DataFrame, facts: DataFrame, by: str = "conv_id") -> DataFrame:
    """(strategy, probes, recalled): in how many of a strategy's contexts (conv_id, strategy, rendered) the fact's value (conv_id, value) still stands."""
    joined = contexts.join(facts, by)
    kept = F.contains(F.lower("rendered"), F.lower("value")) & (F.length("value") > 0)
    return joined.groupBy("strategy").agg(F.count("*").alias("probes"), F.coalesce(F.sum(kept.cast("long")), F.lit(0)).alias("recalled"))
