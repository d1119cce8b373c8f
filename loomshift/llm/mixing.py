"""Mixing sources to target weights by temperature, with DataFrame operations only.

Source token shares s are raised to an exponent a in [0, 1], w = s^a / sum(s^a): 1 keeps the shares, 0 makes sources equal.
The exponent is bisected to meet a target entropy, or the smallest exponent that keeps repetition in its limit. The weights
are realised as blocks of a token budget: a source's documents stand in one hashed order, each pass over it takes them in
turn, and a block takes from each source its weight's part of the block's budget, in an order of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_SQL, cut, numbered, quoted, renamed

#: Bits that the bisection settles in one pass over the sources, and passes.
STEP_BITS, PASSES = 5, 5
BLOCK_TOKENS = 1_000_000


def token_count(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_SQL, " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def _entropies(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy of s^a / sum(s^a) for each exponent, from one aggregate over the sources."""
    logs = F.log("share")
    sums = []
    for k, a in enumerate(exponents):
        power = F.exp(F.lit(a) * logs)
        sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.lit(a) * logs).alias(f"e{k}"), F.log(F.sum(power)).alias(f"l{k}")]
    row = shares.agg(*sums).first()
    return [row[f"l{k}"] - row[f"e{k}"] / row[f"z{k}"] for k in range(len(exponents))]


def fit_exponent(shares: DataFrame, entropy_gain: float, max_repeats: float) -> float:
    """The exponent for (source, share) with positive shares.

    The target entropy lies entropy_gain of the way from that of the shares to that of equal sources. Entropy falls as the
    exponent rises, so bisection finds it; each pass settles STEP_BITS halvings by evaluating their inner points together.
    With a budget that takes the scarcest-weighted source once, the rarest source is repeated (s_max / s_min)^(1 - a)
    times, which bounds the exponent from below in closed form.
    """
    edge = shares.agg(F.min("share"), F.max("share"), F.count("*")).first()
    if not edge[2] or edge[2] == 1 or edge[0] == edge[1]:
        return 1.0
    whole, equal = _entropies(shares, [1.0, 0.0])
    target = whole + entropy_gain * (equal - whole)
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        n = 1 << STEP_BITS
        points = [low + (high - low) * k / n for k in range(1, n)]
        above = sum(h >= target for h in _entropies(shares, points))  # the first `above` points are entropic enough
        low, high = low + (high - low) * above / n, low + (high - low) * (above + 1) / n
    # repeats = (s_max / s_min)^(1 - a) <= max_repeats
    return min(1.0, max(low, 1.0 - math.log(max_repeats) / math.log(edge[1] / edge[0])))


def mixture(docs: DataFrame, entropy_gain: float = 0.25, max_repeats: float = 2.0, block_tokens: int = BLOCK_TOKENS, budget: float | None = None, seed: int = 42, source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mixture takes them, with what the mixture adds.

    Added columns: mix_source, mix_tokens, mix_weight, mix_copy (0 for a row's first use), mix_block, mix_order (a hash that
    orders the rows of a block). Columns of docs with these names are replaced. The budget in tokens defaults to the least
    that takes every document once, so nothing is lost; with a smaller one, the documents that a source's share of the
    budget does not reach are left out. Documents without words have no tokens: they come along once, in the block where
    they stand. A null source is a source of its own. Repeated rows are documents of their own: those of equal doc_id and
    text stand by their other columns, and rows equal in all are interchangeable. Names of docs may be any, and texts of any
    length. An empty table gives an empty result.

    A source's order is summed up in 65536 parts of its hash, so that no task sorts more of a source than a part.
    """
    added = ("mix_source", "mix_tokens", "mix_weight", "mix_copy", "mix_block", "mix_order")
    columns = [c for c in docs.columns if c.lower() not in added]
    source = F.col(quoted(next(c for c in docs.columns if c.lower() == source_col.lower()))).cast("string")
    hashed = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(seed))
    others = F.to_json(F.struct(*(F.col(quoted(c)) for c in columns if c.lower() != "text")))
    more = {"mix_source": F.coalesce(F.concat(F.lit("="), source), F.lit("")), "mix_tokens": token_count(F.col("text")), "key": hashed, "tie": F.xxhash64(others)}
    rows = numbered(docs, columns, *(x.alias(name) for name, x in more.items()))
    rows = rows.withColumn("hi", F.shiftrightunsigned("key", 56)).withColumn("lo", F.shiftrightunsigned("key", 48).bitwiseAND(F.lit(255)))
    parts = cut(rows.groupBy("mix_source", "hi", "lo").agg(F.sum("mix_tokens").alias("t")))
    totals = cut(parts.groupBy("mix_source").agg(F.sum("t").alias("total")).where("total > 0"))
    whole = totals.agg(F.sum("total")).first()[0] or 0
    shares = totals.select("mix_source", "total", (F.col("total") / F.lit(float(max(1, whole)))).alias("share"))
    exponent = fit_exponent(shares, entropy_gain, max_repeats)
    power = F.pow("share", F.lit(exponent))
    z = shares.agg(F.sum(power)).first()[0] or 1.0
    weights = shares.select("mix_source", "total", (power / F.lit(z)).alias("mix_weight"))
    if budget is None:
        budget = weights.agg(F.max(F.col("total") / F.col("mix_weight"))).first()[0] or 0.0
    # where each part of a source begins: by its high bits, then by its low bits within them
    upper = parts.groupBy("mix_source", "hi").agg(F.sum("t").alias("t"))
    upper = upper.select("mix_source", "hi", (F.sum("t").over(Window.partitionBy("mix_source").orderBy("hi")) - F.col("t")).alias("above"))
    lower = parts.withColumn("below", F.sum("t").over(Window.partitionBy("mix_source", "hi").orderBy("lo")) - F.col("t")).drop("t")
    begins = cut(lower.join(upper, ["mix_source", "hi"]).join(weights, "mix_source", "left").select("mix_source", "hi", "lo", (F.col("above") + F.col("below")).alias("begin"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("mix_weight", F.lit(0.0)).alias("mix_weight")))
    placed = rows.join(begins, ["mix_source", "hi", "lo"])
    run = Window.partitionBy("mix_source", "hi", "lo").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("at", F.col("begin") + F.sum("mix_tokens").over(run) - F.col("mix_tokens"))
    # copy k of a row stands at at + k * total; it is taken if that lies within the source's part of the budget
    reach = F.col("mix_weight") * F.lit(float(budget))
    passes = F.floor(reach / F.col("total") + 1e-9)
    rest = F.round(reach - passes * F.col("total"))
    copies = F.when((F.col("total") == 0) | (F.col("mix_tokens") == 0), F.lit(1)).otherwise(passes + F.when(F.col("at") < rest, 1).otherwise(0))
    taken = placed.withColumn("mix_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1))))
    block = F.when(F.col("total") == 0, F.lit(0).cast("long")).otherwise(F.floor((F.col("at") + F.col("mix_copy") * F.col("total")) / (F.col("mix_weight") * F.lit(float(block_tokens)))))
    taken = taken.withColumn("mix_block", block).withColumn("mix_order", F.xxhash64("key", "mix_copy", "mix_block"))
    taken = taken.withColumn("mix_source", F.when(F.col("mix_source") != "", F.substring("mix_source", 2, 1 << 30)))
    return renamed(taken, columns, *added)
