"""Attributes as known at the time of an event.

Every stored row is the known one during at most one interval of time: from the
moment both its time and its arrival have come until a row of higher precedence
is known as well. Intervals and events meet by equality only: an interval is
decomposed into dyadic time nodes (level, index), an event asks for all nodes
that enclose its time, and exact half-open bounds are checked on what joins.

Defined cases: rows without symbol, timestamp or arrival are never known; events
without symbol or time find nothing, events without id are left out of findings; a null or NaN value of the known row means
none, it does not fall back to an older row; repeated rows differ in chunk and
position, which decide last; empty tables give no attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barlake.operators.chunkrows import chunk_rows

#: By default leaves are 2**36 microseconds (19 hours) wide; 18 levels above them reach 2**54 (570 years).
LEAF_BITS, LEVELS = 36, 18
NARROWEST, WIDEST = 10, 44
FOREVER = 1 << (LEAF_BITS + LEVELS)
#: Leaves whose rows are put in order together: a leaf holds about one row of the busiest source.
BLOCK_BITS = 12
#: A node that more events than this ask for is split by event, and its intervals copied to the parts.
NODE_EVENTS = 50_000
#: Busy sources, up to so many, are shipped to every task; beyond, they are joined by key.
BUSY_ROWS = 50_000


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def leaf_bits(chunks: DataFrame) -> int:
    """Width of a leaf, as a power of two in microseconds, at which the busiest source has about one row in it.

    Read off the chunks' own bounds and counts; the width bears on speed only.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    per = chunks.groupBy("symbol").agg(F.sum("row_count").alias("n"), F.min(us("time_start")).alias("a"), F.max(us("time_end")).alias("z"))
    n, a, z = per.agg(F.max("n"), F.min("a"), F.max("z")).first()
    if not n or n < 1 or a is None or z is None or z <= a:
        return LEAF_BITS
    return min(max(((z - a) // n).bit_length() - 1, NARROWEST), WIDEST)


def known_intervals(chunks: DataFrame, bits: int = LEAF_BITS) -> DataFrame:
    """(symbol, known_from, known_to, close): disjoint half-open intervals in microseconds.

    A row stops being known when a row of higher (timestamp, txn, corr, chunk_id,
    row_pos) is known: the least start among all rows after it. That suffix
    minimum is taken within (symbol, block of 2**BLOCK_BITS leaves) and completed
    by the minimum of the later blocks, which are thousands of times fewer than rows.
    """
    rows = chunk_rows(chunks).where(F.col("symbol").isNotNull() & F.col("timestamp").isNotNull() & F.col("txn").isNotNull())
    rows = rows.select("symbol", _us("timestamp").alias("ts"), _us("txn").alias("txn"), "corr", "chunk_id", "row_pos", "close")
    rows = rows.withColumns({"block": F.shiftright("ts", bits + BLOCK_BITS), "known_from": F.greatest("ts", "txn")})
    after = W.partitionBy("symbol", "block").orderBy(*[F.col(c).desc() for c in ("ts", "txn", "corr", "chunk_id", "row_pos")]).rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("symbol", "block").agg(F.min("known_from").alias("_m"))
    later = W.partitionBy("symbol").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("symbol", "block", F.min("_m").over(later).alias("_later"))
    ended = rows.withColumn("_in", F.min("known_from").over(after)).select("symbol", "block", "known_from", "_in", "close").join(blocks, ["symbol", "block"])
    to = F.coalesce(F.least("_in", "_later"), F.lit(FOREVER))
    return ended.withColumn("known_to", to).where("known_from < known_to").select("symbol", "known_from", "known_to", "close")


def nodes_of_interval(start: Column, end: Column, levels: int = LEVELS, bits: int = LEAF_BITS) -> Column:
    """The fewest dyadic nodes (level, index) whose leaves cover [start, end); nodes above ``levels`` would not fit into it."""
    first, last = F.shiftright(start, bits), F.shiftright(end - 1, bits) + 1

    def at(level: Column) -> Column:
        wide = F.pow(F.lit(2.0), level).cast("long")
        lo, hi = F.ceil(first / wide).cast("long"), F.floor(last / wide).cast("long")
        node = lambda i: F.struct(level.alias("level"), i.alias("node"))
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        return F.when(lo < hi, F.array_compact(F.array(F.when(odd(lo), node(lo)), F.when(odd(hi) & ~(odd(lo) & (lo == hi - 1)), node(hi - 1))))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def nodes_of_instant(at: Column, levels: int = LEVELS, bits: int = LEAF_BITS) -> Column:
    """All dyadic nodes up to ``levels`` that enclose an instant."""
    leaf = F.shiftright(at, bits)
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), F.floor(leaf / F.pow(F.lit(2.0), level)).cast("long").alias("node")))


def _with_parts(df: DataFrame, busy: DataFrame | None, per_leaf: Column) -> DataFrame:
    """``df`` with ``_parts``, into how many parts the events at its node are split; ``busy``: events per busy source."""
    if busy is None:
        return df.withColumn("_parts", F.lit(1))
    return df.join(busy, "symbol", "left").withColumn("_parts", F.greatest(F.lit(1), F.ceil(per_leaf * F.pow(F.lit(2.0), "level"))).cast("int"))


def known_close(events: DataFrame, chunks: DataFrame, event_id: str = "signal_id", at: str = "decided_at", node_events: int = NODE_EVENTS) -> DataFrame:
    """(event_id, known_close): null where nothing was known. Every event comes back once, so ids must be unique.

    Intervals are clipped to the span of the events, which also bounds the levels
    that can hold a node: a year of daily rows asks for 10 keys an event. Low levels
    spread a source over time; at high ones most of its events share a node, so
    where they are more than ``node_events`` they are split by their id, and the
    few intervals that fill such a node (one at most above the leaves, as intervals
    are disjoint) are copied to each part.
    """
    bits = leaf_bits(chunks)
    asks = events.where(F.col("symbol").isNotNull() & F.col(at).isNotNull()).select(F.col(event_id).alias("_id"), "symbol", _us(at).alias("_at"))
    per = asks.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_a"), F.max("_at").alias("_z"))
    first, last, most = per.agg(F.min("_a"), F.max("_z"), F.max("_n")).first()
    first, last, most = (0, 0, 0) if first is None else (first, last, most)
    leaves = (last >> bits) - (first >> bits) + 1
    levels = min(leaves.bit_length(), 62 - bits)
    busy = None
    if most > node_events:
        busy = per.where(F.col("_n") > node_events).select("symbol", "_n")
        if per.where(F.col("_n") > node_events).limit(BUSY_ROWS + 1).count() <= BUSY_ROWS:
            busy = F.broadcast(busy)
    per_leaf = F.coalesce("_n", F.lit(0)) / float(leaves * node_events) if busy is not None else F.lit(0.0)
    spans = known_intervals(chunks, bits).withColumns({"known_from": F.greatest("known_from", F.lit(first)), "known_to": F.least("known_to", F.lit(last + 1))}).where("known_from < known_to")
    spans = spans.select("symbol", "known_from", "known_to", "close", F.inline(nodes_of_interval(F.col("known_from"), F.col("known_to"), levels, bits)))
    spans = _with_parts(spans, busy, per_leaf).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_n")
    asks = asks.select("_id", "symbol", "_at", F.inline(nodes_of_instant(F.col("_at"), levels, bits)))
    asks = _with_parts(asks, busy, per_leaf).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).drop("_parts", "_n")
    met = asks.join(spans, ["symbol", "level", "node", "_part"]).where("known_from <= _at AND _at < known_to")
    # Intervals of a source are disjoint and their nodes too, so an event meets one row at most.
    found = met.select(F.col("_id").alias(event_id), F.when(~F.isnan("close"), F.col("close")).alias("known_close"))
    return events.select(F.col(event_id)).join(found, event_id, "left")


def leaking_signals(signals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Signals whose ``close_used`` is not what was known when they were decided."""
    known = known_close(signals, chunks)
    used = F.when(~F.isnan("close_used"), F.col("close_used"))
    return signals.select("signal_id", used.alias("_used")).join(known, "signal_id").where(~F.col("_used").eqNullSafe(F.col("known_close"))).select("signal_id")
