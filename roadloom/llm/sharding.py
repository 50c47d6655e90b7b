"""Minimax contiguous sharding: the smallest shard capacity at which a greedy walk over ordered groups needs no more shards.

Equal texts are one atomic group, ordered by its smallest doc_id. Groups are range-partitioned in that order and numbered within their
partition; a block is a partition's groups of one number divided by a power of two, so that blocks are found by arithmetic and joined by
equality. The driver sees sums of at most BLOCKS blocks (one for each partition at least). With whole blocks kept or cut anywhere, it
brackets the best capacity, and each cut's place; only blocks where a cut may fall are split again, until those are single groups. Then
the binary search is exact. Cuts are placed at that capacity, as evenly as it allows: the walk that checks a capacity fills shards
one after another, which would leave the last ones small. Rounds grow with the logarithm of the corpus, what the driver holds does not.

Rows: a null text has 0 bytes and is grouped with empty texts. Repeated rows are placed each; null ids come first. Extra columns
are ignored; an empty table gives an empty result. More shards than groups leave the last ones empty. A group is never split, so
a group larger than the mean makes a larger shard: that is the least the order allows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import forget, partitions, stored

SHARDS = 24
#: Blocks of groups that the driver sees at a time, or one for each partition, and twice as many after a split.
BLOCKS = 20_000


def greedy(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """First item of every shard after the first, each filled up to capacity; None if that takes more shards."""
    ends = np.cumsum(sizes)
    cuts, done = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, done + capacity, side="right"))
        if at == len(sizes):
            return cuts
        cuts.append(at)
        done = int(ends[at - 1]) if at else 0
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Binary search over the capacity; a walk checks each."""
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        middle = (low + high) // 2
        if greedy(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def balanced(sizes: np.ndarray, capacity: int, shards: int) -> list[int]:
    """First item of every shard after the first: no shard over capacity, each as near as it can be to an equal share of the rest."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    least = [len(sizes)]  # least[j]: the first item from which j shards hold all that follows
    for _ in range(shards):
        least.append(int(np.searchsorted(ends, ends[least[-1]] - capacity, side="left")))
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        share = ends[at] + (ends[-1] - ends[at]) / (left + 1)
        near = int(np.searchsorted(ends, share, side="left"))
        if near and share - ends[near - 1] <= ends[near] - share:
            near -= 1
        most = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        at = max(least[left], min(near, most), at)
        cuts.append(at)
    return cuts


@dataclass
class _Blocks:
    """Consecutive groups: place of the first group, groups, their bytes and the largest; shift: of the block's number."""

    first: np.ndarray
    count: np.ndarray
    total: np.ndarray
    largest: np.ndarray
    shift: np.ndarray


#: Bits of a group's number within its partition, as Spark's row ids have them.
ROW_BITS = 33


def _open_blocks(b: _Blocks, shards: int) -> np.ndarray:
    """Blocks in which a cut of the best partition may fall, and that hold several groups."""
    high = smallest_capacity(b.total, shards)  # whole blocks are groups too: this capacity can be had
    low = max(int(b.largest.max()), -(-int(b.total.sum()) // shards))
    ends = np.concatenate([[0], np.cumsum(b.total)])
    near = far = 0  # least and most bytes before a cut: it grows with the capacity and with the cut before it
    mark = np.zeros(len(b.total), bool)
    for _ in range(shards):
        i = int(np.searchsorted(ends, near + low, side="right")) - 1  # a block's end is a group's end, too
        j = int(np.searchsorted(ends, far + high, side="right")) - 1
        near = int(ends[i])
        if near >= ends[-1]:
            break
        mark[i : j + 1] = True
        far = int(ends[-1]) if j >= len(b.total) else int(ends[j]) if b.count[j] == 1 else far + high
    return mark & (b.count > 1)


def shard(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text); the law is "bytes"."""
    spark = docs.sparkSession
    raw = F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    base = base.select("doc_id", (F.length("raw") + 8).cast("long").alias("size"), F.crc32("raw").alias("text_crc32"), F.unhex(F.sha2("raw", 256)).alias("same"))
    base = stored(base, "sizes")
    groups = base.groupBy("same").agg(F.min("doc_id").alias("lead"), F.sum("size").alias("total"), F.count("*").alias("members"))
    ordered = stored(groups.repartitionByRange(partitions(spark), F.col("lead").asc_nulls_first(), "same").sortWithinPartitions(F.col("lead").asc_nulls_first(), "same").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "groups")
    # place: partition in the upper bits, row in the lower ROW_BITS; ascending in group order

    row = F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sums = (F.min("place").alias("first"), F.count("*").alias("count"), F.sum("total").alias("total"), F.max("total").alias("largest"))
    sizes = np.array([r["count"] for r in ordered.groupBy("part").count().collect()], np.int64)
    if not len(sizes):
        kind = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
        return spark.createDataFrame([], kind)

    def taken(rows: list, shift: int) -> _Blocks:
        return _Blocks(*(np.array([r[c] for r in rows], np.int64) for c in ("first", "count", "total", "largest")), np.full(len(rows), shift))

    def joined(parts: list[_Blocks]) -> _Blocks:
        merged = [np.concatenate([getattr(p, c) for p in parts]) for c in ("first", "count", "total", "largest", "shift")]
        order = np.argsort(merged[0])
        return _Blocks(*(m[order] for m in merged))

    def finest(counts: np.ndarray, shift: int) -> int:
        """The least shift below the given one with which groups so many together make at most BLOCKS blocks."""
        while shift and (-(-counts >> (shift - 1))).sum() <= blocks:
            shift -= 1
        return shift

    shift = finest(sizes, ROW_BITS)
    now = joined([taken(ordered.groupBy("part", F.shiftright(row, shift).alias("n")).agg(*sums).collect(), shift)])
    while (open_ := _open_blocks(now, shards)).any():
        parts = [_Blocks(*(getattr(now, c)[~open_] for c in ("first", "count", "total", "largest", "shift")))]
        for shift in np.unique(now.shift[open_]).tolist():
            which = open_ & (now.shift == shift)
            first = now.first[which]
            wanted = spark.createDataFrame([(int(p), int(n)) for p, n in zip(first >> ROW_BITS, (first & ((1 << ROW_BITS) - 1)) >> shift, strict=True)], "part int, n long")
            finer = min(shift - 1, finest(now.count[which], shift))
            chosen = ordered.withColumn("n", F.shiftright(row, shift)).join(F.broadcast(wanted), ["part", "n"])  # at most BLOCKS rows
            parts.append(taken(chosen.groupBy("part", F.shiftright(row, finer).alias("n")).agg(*sums).collect(), finer))
        now = joined(parts)
    capacity = smallest_capacity(now.total, shards)
    first = [*now.first.tolist(), 1 << 62]
    starts = [first[i] for i in balanced(now.total, capacity, shards)]

    number = F.lit(0)
    for s in starts:
        number = number + F.when(F.col("place") >= s, 1).otherwise(0)
    named = ordered.select("same", "place", number.alias("shard"))
    rows = base.join(named, "same").repartitionByRange(partitions(spark), "place", F.col("doc_id").asc_nulls_first(), F.xxhash64("doc_id")).sortWithinPartitions("place", F.col("doc_id").asc_nulls_first())
    rows = stored(rows.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "rows")
    forget(base)
    forget(ordered)
    # rows of a shard stand together over consecutive partitions: a slot is the row's number in its partition and shard, plus the rows before
    heads = rows.groupBy("part", "shard").agg(F.min("at").alias("head"), F.count("*").alias("n"))
    before = heads.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.join(before.select("part", "shard", "head", "before"), ["part", "shard"])
    slot = F.col("before") + F.col("at") - F.col("head")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
