"""Mixing sources to target weights: exact length counts, a bounded knapsack for the remaining budget, seeded selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20240607
#: The budget that is left to the knapsack; the rest is filled in proportion.
KNAPSACK = 1 << 16


def fill(budget: int, lengths: list[int], counts: list[int]) -> list[int]:
    """How many items of each length to take so that their sum comes as near to ``budget`` from below as can be.

    Up to the knapsack's budget items are taken in proportion, longest first for
    what rounding leaves; the rest is a bounded subset-sum program over the items
    that are left, with one bit set of reachable sums for each block of items
    (1, 2, 4, ... of a length).
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    small = min(budget, KNAPSACK)
    part = (budget - small) / total if total else 0
    take = [min(c, math.floor(c * part)) for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    by_size = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in by_size:
        if left <= KNAPSACK:
            break
        if lengths[i]:
            more = min(counts[i] - take[i], max(0, left - KNAPSACK // 2) // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    mask = (1 << (left + 1)) - 1
    reach, steps = 1, []
    for i in by_size:
        free = counts[i] - take[i]
        if not lengths[i] or lengths[i] > left:
            continue
        free = min(free, left // lengths[i])
        block = 1
        while free > 0:
            n = min(block, free)
            after = (reach | (reach << (n * lengths[i]))) & mask
            if after != reach:
                steps.append((i, n, reach))
                reach = after
            free -= n
            block *= 2
        if reach >> left:
            break
    goal = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> goal & 1:
            take[i] += n
            goal -= n * lengths[i]
    return take


def _fitted(rows):
    """Of one source: its lengths with the copies that all documents get, and how many of them get one more."""
    rows = rows.sort_values("size")
    size, n = rows["size"].tolist(), rows["n"].tolist()
    whole = int(rows["source_size"].iloc[0])
    goal = round(float(rows["target"].iloc[0]))
    base = min(goal // whole, MOST) if whole else 0
    more = fill(goal - base * whole, size, n) if base < MOST else [0] * len(n)
    return rows.assign(base=base, more=more)[["source", "size", "base", "more"]]


def targets(histogram: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt out by weight, no source over ``most`` times its size.

    Sources in the order of their code points, null last, weigh as ``weights``
    repeat. In the order of cap over weight, those before some source are at
    their cap and the others share the rest by weight, so one ordered pass over
    the sources gives what repeated resharing converges to.
    """
    s = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level)
    s = s.withColumn("open", F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level")))
    s = s.withColumn("level", F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mixed(docs: DataFrame, carry: tuple[str, ...] = (), share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, and the columns to carry.

    ``size`` counts the text's words, ``taken`` the words that the mix takes of
    it: 0, 1 or ``most`` (2) times its size. Which documents of a length are taken
    is a seeded order of their ids, so reruns agree. Null texts have size 0 and
    give nothing, null sources are one source, null or repeated doc_ids are rows
    like others, an empty table gives an empty result.
    """
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), *(F.col(c).alias(f"_{c}") for c in carry))
    first = first.withColumn("h", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 52))
    if carry:
        first = first.withColumn("tie", F.xxhash64(*(f"_{c}" for c in carry)))
    else:
        first = stored(first, "sizes")
    counts = stored(first.groupBy("source", "size", "bucket").agg(F.count("*").alias("k")), "lengths")
    histogram = counts.groupBy("source", "size").agg(F.sum("k").alias("n"))
    goal = stored(targets(histogram, share, weights, most), "targets")
    goal_ = goal.withColumnRenamed("source", "source_")
    rows = histogram.join(goal_, histogram["source"].eqNullSafe(goal_["source_"])).drop("source_")
    fit = rows.groupBy("source").applyInPandas(_fitted, "source string, size long, base int, more long")
    fit = fit.select(F.col("source").alias("s1"), F.col("size").alias("z1"), "base", "more")
    # where each bucket of a length begins in the seeded order; at most 4096 rows a length
    begin = F.sum("k").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("begin", F.coalesce(begin, F.lit(0)))
    counts = counts.join(fit, counts["source"].eqNullSafe(fit["s1"]) & (counts["size"] == fit["z1"]))
    counts = counts.join(goal_, counts["source"].eqNullSafe(goal_["source_"]))
    counts = counts.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("bucket").alias("b2"), "begin", "base", "more", "source_size", "target")
    out = first.join(counts, first["source"].eqNullSafe(counts["s2"]) & (first["size"] == counts["z2"]) & (first["bucket"] == counts["b2"]))
    # rows that share an id and a size go by what they carry, so that reruns take the same ones
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id", *(["tie"] if carry else [])))
    copies = F.col("base") + F.when(F.col("begin") + rank <= F.col("more"), 1).otherwise(0)
    out = out.withColumn("taken", (F.col("size") * copies).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "taken", *(F.col(f"_{c}").alias(c) for c in carry))
