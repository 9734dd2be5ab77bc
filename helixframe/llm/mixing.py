"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Blocks of ``block_words`` words are seats.  Sources get seats by the highest quotients of their target
(votes / 1, 3, 5, ...); each source's seats are then apportioned in the same way to its shards (the shards'
words are the votes).  Inside a shard the documents stand in a seeded order, which makes one line of words, cut into blocks; the
shard takes its quota of blocks from the head of that line, whole rounds of the line first.  So at most one
document of a shard is taken in part, and no word more than ``max_repeat`` times.

The seed works through md5 of id and text, so SQL can spell it.  A source's words are near its target: it is off by half a block where seats are rounded, and by
what a shard lacks that has fewer words than blocks of quota; a source whose target is all it may give, gives all.
A few sources are apportioned on the driver; more than ``DRIVER_SOURCES`` by the same rules on the executors, where the line between the last
quotient that wins and the first that doesn't is found by bisection over sums.

Edge cases: a null source is a source of its own (last in order); null and empty texts have size 0 and are
never taken; a null id is an id; rows that repeat an id and text are rows of their own that stand next to each other; an empty table gives an empty result;
other columns pass through untouched.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from helixframe.llm.common import numbered, word_count, written

#: Rows of one shard's line that one task orders at a time.
ROWS_EACH = 4_000
#: Sources that are listed on the driver at most; more are apportioned on the executors.
DRIVER_SOURCES = 10_000
_CELL = ["no_source", "source_key", "shard"]


def water_fill(sizes: Sequence[int], weights: Sequence[float], max_repeat: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above max_repeat times its size; what is over is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
    while open_:
        per = left / sum(Fraction(weights[k]) for k in open_)
        full = {k for k in open_ if per * Fraction(weights[k]) > max_repeat * sizes[k]}
        if not full:
            for k in open_:
                out[k] = float(per * Fraction(weights[k]))
            break
        for k in full:
            out[k] = float(max_repeat * sizes[k])
            left -= max_repeat * sizes[k]
        open_ -= full
    return out


def sainte_lague(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 s + 1); ties go to the earlier party.

    Starts from the rounded-down fair shares and settles the rest with two heaps, so the work follows the number
    of parties and not the number of seats.
    """
    total = sum(Fraction(v) for v in votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    exact = [Fraction(v) for v in votes]
    got = [int(v * seats / total) for v in exact]
    give = [(-v / (2 * s + 1), k) for k, (v, s) in enumerate(zip(exact, got, strict=True)) if v]
    heapq.heapify(give)
    for _ in range(seats - sum(got)):
        _, k = heapq.heappop(give)
        got[k] += 1
        heapq.heappush(give, (-exact[k] / (2 * got[k] + 1), k))
    while True:  # fair shares may be broken by the method: move seats until no quotient left is above one that won
        nxt = min((-v / (2 * s + 1), k) for k, (v, s) in enumerate(zip(exact, got, strict=True)) if v)
        last = min((v / (2 * s - 1), -k) for k, (v, s) in enumerate(zip(exact, got, strict=True)) if s)
        if -nxt[0] < last[0] or (-nxt[0] == last[0] and nxt[1] >= -last[1]):
            return got
        got[nxt[1]] += 1
        got[-last[1]] -= 1


def shard_quotas(words: Sequence[int], target: float, seats: int, block: int, max_repeat: int) -> list[int]:
    """Words that each shard of a source takes: its blocks, and no more than max_repeat times what it has."""
    if target >= max_repeat * sum(words):
        return [max_repeat * w for w in words]
    return [min(q * block, max_repeat * w) for w, q in zip(words, sainte_lague(words, seats), strict=True)]


def _seats(total: int, block: int) -> int:
    return (2 * total + block) // (2 * block)


_PLAN = "no_source boolean, source_key string, shard int, cell_words long, source_size long, target double, quota long"


def _plan_here(cells: DataFrame, weights: Sequence[float], block: int, max_repeat: int) -> DataFrame:
    """Each cell's quota, by lists on the driver."""
    found: dict[tuple, list[tuple[int, int]]] = {}
    for r in cells.collect():
        found.setdefault((r.no_source, r.source_key), []).append((r.shard, r.words))
    names = sorted(found)
    sizes = [sum(w for _, w in found[n]) for n in names]
    targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(names))], max_repeat)
    rows = []
    for name, size, target, seats in zip(names, sizes, targets, sainte_lague(targets, _seats(sum(sizes), block)), strict=True):
        own = sorted(found[name])
        quotas = shard_quotas([w for _, w in own], target, seats, block, max_repeat)
        rows += [(*name, shard, w, size, target, q) for (shard, w), q in zip(own, quotas, strict=True)]
    return cells.sparkSession.createDataFrame(rows, _PLAN)


def _bisected(enough: Callable[[float], bool], hi: float) -> tuple[float, float]:
    """The two neighbouring numbers from 0 to hi between which ``enough`` turns from true to false."""
    lo = 0.0
    while (mid := (lo + hi) / 2) not in (lo, hi):
        lo, hi = (mid, hi) if enough(mid) else (lo, mid)
    return lo, hi


def _plan_there(cells: DataFrame, weights: Sequence[float], block: int, max_repeat: int) -> DataFrame:
    """The same for any number of sources: only sums come to the driver."""
    sizes = cells.groupBy("no_source", "source_key").agg(F.sum("words").alias("size"))
    ranked = numbered(sizes, [F.col("no_source"), F.col("source_key")], "sources")[0]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    own = written(ranked.withColumn("weight", weight).withColumn("most", (F.col("size") * max_repeat).cast("double")), "weighted")
    total, steepest = own.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max(F.col("most") / F.col("weight"))).first()
    one = lambda c: own.agg(c).first()[0] or 0
    level = _bisected(lambda x: one(F.sum(F.least("most", F.col("weight") * x))) <= total, 2 * steepest + 1)[0]
    own = own.withColumn("target", F.least("most", F.col("weight") * level))
    won = lambda q: F.floor((F.col("target") / q + 1) / 2).cast("long")
    seats = _seats(total, block)
    low, high = _bisected(lambda q: not q or one(F.sum(won(q))) >= seats, 2.0 * total + 2)
    sure = own.withColumn("sure", won(high) if total else F.lit(0))
    ties = seats - one(F.sum(won(high))) if low else 0
    tied = numbered(sure.where(won(low) > F.col("sure")), [F.col("rank")], "ties", "place")[0] if low else sure.withColumn("place", F.lit(0))
    more = tied.where(F.col("place") < ties).select("rank", F.lit(1).alias("more"))
    sure = sure.join(more, "rank", "left").withColumn("seats", F.col("sure") + F.coalesce("more", F.lit(0)))

    def divided(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("shard")
        cell["quota"] = shard_quotas([int(w) for w in cell["cell_words"]], float(cell["target"].iloc[0]), int(cell["seats"].iloc[0]), block, max_repeat)
        return cell.drop(columns="seats")

    told = cells.withColumnRenamed("words", "cell_words").join(sure.select("no_source", "source_key", F.col("size").alias("source_size"), "target", "seats"), ["no_source", "source_key"])
    return written(told.groupBy("no_source", "source_key").applyInPandas(divided, _PLAN), "plan")  # as many rows as shards each


def mix_sources(
    df: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    block_words: int = 32,
    shards: int = 8,
    max_repeat: int = 3,
    seed: int = 17,
    text: Column | None = None,
) -> DataFrame:
    """``df`` (doc_id, text, source, ...) as a struct ``row``, with size, source_size, target and taken.

    Sources by code point, null last, weigh ``weights``, repeating.  Sizes are summed over all rows.
    """
    rows = df.count()
    bits = max(0, (rows // (shards * ROWS_EACH)).bit_length())
    text = F.col("text") if text is None else text
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))).cast("binary"))
    number = lambda begin, n: F.conv(F.substring("digest", begin, n), 16, 10).cast("long")
    base = df.select(
        F.struct(*df.columns).alias("row"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        word_count(text).alias("size"),
        digest.alias("digest"),
    )
    base = base.select("row", "no_source", "source_key", "size", number(1, 15).alias("at"), F.pmod(number(17, 8), F.lit(shards)).cast("int").alias("shard"))
    base = base.withColumn("bucket", F.shiftright("at", 60 - bits).cast("int"))
    key = [*_CELL, "bucket"]
    sums = written(base.groupBy(key).agg(F.sum("size").alias("words")), "sums")
    cells = sums.groupBy(_CELL).agg(F.sum("words").alias("words"))
    few = sums.select("no_source", "source_key").distinct().limit(DRIVER_SOURCES + 1).count() <= DRIVER_SOURCES
    plan = F.broadcast(_plan_here(cells, weights, block_words, max_repeat)) if few else _plan_there(cells, weights, block_words, max_repeat)
    before = Window.partitionBy(_CELL).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(plan, _CELL)
    line = Window.partitionBy(key).orderBy("at", F.col("row.doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(line), F.lit(0))
    rounds = F.when(F.col("cell_words") > 0, F.expr("quota div cell_words")).otherwise(F.lit(0))
    rest = F.col("quota") - rounds * F.col("cell_words")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return (
        base.join(heads, key)
        .withColumn("start", start)
        .select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))
    )
