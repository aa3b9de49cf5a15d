"""Sharding: the minimax contiguous partition of ordered atomic groups.

All of it is DataFrame functions; the driver holds summaries of bounded size and cuts there.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import written

#: Groups are ordered by so many bits of a hash of their text.
KEY_BITS = 60
#: The first summary has 2 ** FIRST_BITS ranges; each later one cuts the ranges in question in 2 ** NEXT_BITS.
FIRST_BITS, NEXT_BITS = 12, 8
#: Parts of each shard in which slots are numbered.
SLOT_PARTS = 256


@dataclass(frozen=True)
class Range:
    """Groups with keys from ``start`` on, below the next range's; ``single``: one group only."""

    start: int
    weight: int
    single: bool


def greedy(ranges: list[Range], sums: list[int], capacity: int, parts: int, whole: bool) -> list[int] | None:
    """Ends, as sums, of up to ``parts`` shards that each take all that fits; None if some don't.

    ``whole``: ranges are atomic; else only single ones are, and others can be cut anywhere.
    """
    at, ends = 0, []
    for _ in range(parts):
        if at >= sums[-1]:
            break
        k = bisect_right(sums, at + capacity)  # sums[k - 1] <= at + capacity
        reach = sums[k - 1] if k else 0
        if k < len(sums) and not whole and not ranges[k].single:
            reach = at + capacity
        if reach <= at:
            return None
        ends.append(reach)
        at = reach
    return ends if at >= sums[-1] else None


def smallest(ranges: list[Range], parts: int, whole: bool, low: int = 0) -> int:
    """The smallest feasible capacity, by binary search with the greedy check."""
    sums, total = [], 0
    for r in ranges:
        total += r.weight
        sums.append(total)
    low, high = max(low, -(-total // parts)), max(total, low)
    while low < high:
        mid = (low + high) // 2
        if greedy(ranges, sums, mid, parts, whole) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _furthest(ranges: list[Range], sums: list[int], capacity: int, parts: int, whole: bool) -> list[int]:
    """The greedy ends, feasible or not, filled up to ``parts``."""
    at, ends = 0, []
    for _ in range(parts):
        k = bisect_right(sums, at + capacity)
        reach = sums[k - 1] if k else 0
        if k < len(sums) and not whole and not ranges[k].single:
            reach = at + capacity
        at = max(at, min(reach, sums[-1]))
        ends.append(at)
    return ends


def _summary(groups: DataFrame, cut: Column) -> list[Range]:
    rows = groups.groupBy(cut.alias("cut")).agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.sum("weight").alias("weight")
    )
    return [Range(r.low, r.weight, r.low == r.high) for r in rows.orderBy("cut").collect()]


def cuts(groups: DataFrame, parts: int) -> tuple[list[int], int]:
    """(first keys of all shards but the first, their capacity) of groups (key, weight).

    The smallest capacity at which greedy filling in key order needs at most ``parts`` shards, found
    without collecting the groups: a summary of key ranges bounds it from both sides (ranges whole;
    ranges divisible); those in which a cut can lie are summarised more finely until both agree.
    """
    bits = FIRST_BITS
    ranges = _summary(groups, F.shiftright("key", KEY_BITS - bits))
    while ranges:
        low, high = smallest(ranges, parts, False), smallest(ranges, parts, True)
        sums, total = [], 0
        for r in ranges:
            total += r.weight
            sums.append(total)
        if low == high:
            break
        early, late = _furthest(ranges, sums, low, parts, True), _furthest(ranges, sums, high, parts, False)
        open_ = sorted(
            {k for a, b in zip(early, late, strict=True) for k in range(bisect_right(sums, a - 1), min(bisect_right(sums, b), len(ranges) - 1) + 1) if not ranges[k].single}
        )
        if not open_:
            break
        bits = min(KEY_BITS, bits + NEXT_BITS)
        spans, size = [], KEY_BITS - bits
        for k in open_:  # runs of neighbouring ranges become one condition
            end = ranges[k + 1].start if k + 1 < len(ranges) else 1 << KEY_BITS
            if spans and spans[-1][1] == ranges[k].start:
                spans[-1][1] = end
            else:
                spans.append([ranges[k].start, end])
        chosen = F.lit(False)
        for a, b in spans:
            chosen = chosen | ((F.col("key") >= a) & (F.col("key") < b))
        finer = _summary(groups.where(chosen), F.shiftright("key", size))
        ranges = sorted([*(r for k, r in enumerate(ranges) if k not in set(open_)), *finer], key=lambda r: r.start)
    if not ranges:
        return [], 0
    capacity = smallest(ranges, parts, True)
    sums, total, firsts, used = [], 0, [], 0
    for r in ranges:
        if used and used + r.weight > capacity:
            firsts.append(r.start)
            used = 0
        used += r.weight
    return firsts, capacity


def shard(docs: DataFrame, parts: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity.

    The law is ``bytes``. Equal texts are one group and stay together; groups stand in the order of
    a hash of their text, and the largest shard is as small as cuts in that order allow (a group over
    a part of the whole fills a shard by itself). Slots run gapless from 0 in each shard, by parts
    that a hash of the id deals out, so one hot text is numbered by many tasks; rows that share an id
    are told apart by their place in the written table, so a task that runs again gives the same
    slots. A null text counts as empty (size 8); very long texts are measured whole; repeated rows,
    and null ids, are rows like others; an empty table gives no rows; other columns are ignored. The
    driver sees key ranges, shards and counts, never groups.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        key.alias("key"),
    )
    rows = written(rows)
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("weight")))
    firsts, capacity = cuts(groups, parts)
    number = F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x <= F.col("key"))) if firsts else F.lit(0)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    part = F.pmod(F.xxhash64("doc_id", "row"), F.lit(SLOT_PARTS)).cast("int")
    dealt = written(rows.select("doc_id", "row", "size", "text_crc32", number.cast("int").alias("shard"), part.alias("part")))
    counts = dealt.groupBy("shard", "part").count()  # parts * SLOT_PARTS rows at most
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    in_part = Window.partitionBy("shard", "part").orderBy("doc_id", "row")
    numbered = dealt.withColumn("place", F.row_number().over(in_part)).join(F.broadcast(table), ["shard", "part"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(capacity).cast("long").alias("capacity"),
    )


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards of near equal bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
