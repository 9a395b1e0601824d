"""Sharding by best-fit decreasing: indivisible groups, largest first, enter the tightest bin that still has room."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, prefix_sum, small, stored, text_or_empty


class BinTree:
    """Bins by remaining capacity in a treap, a balanced tree: insert and take-the-tightest in logarithmic time."""

    def __init__(self) -> None:
        self.root, self.random = None, random.Random(1)

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.random.random(), None, None]), high)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the bin of the smallest remaining capacity of `least` or more."""
        low, high = self._split(self.root, (least, -1))
        if high is None:
            self.root = low
            return None
        node, above = high, []
        while node[2]:
            above.append(node)
            node = node[2]
        if above:
            above[-1][2] = node[3]
        else:
            high = node[3]
        self.root = self._merge(low, high)
        return node[0]

    def _split(self, node, key):
        """The trees of the keys below `key` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _merge(self, low, high):
        if not low or not high:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high


#: A size and how many groups have it.
Class = tuple[int, int]


def best_fit_decreasing(classes: list[Class], capacity: int) -> list[tuple[int, int, int]]:
    """(size, bin, count): how many groups of each size enter which bin; sizes descending, so is the result.

    The tightest bin for a group remains the tightest for the next of the same size while it has room, so a bin takes
    as many of a class at once as fit: the result is that of placing groups one by one. Groups above the capacity get
    a bin of their own.
    """
    tree, bins, out = BinTree(), 0, []
    for size, count in classes:
        while count:
            found = tree.take(size)
            left, k = found or (max(capacity, size), bins)
            bins += found is None
            n = min(count, left // size)
            tree.insert((left - n * size, k))
            out.append((size, k, n))
            count -= n
    return out


def pack(classes: list[Class], shards: int, steps: int = 12) -> list[tuple[int, int, int]]:
    """(size, bin, count) with bins 0 to shards-1 for classes of descending size: the smallest capacity, by bisection,
    that needs no more bins.

    A group above an even share keeps a bin to itself and the rest share the other bins evenly.
    """
    alone, rest, classes = [], sum(s * n for s, n in classes), list(classes)
    while classes and len(alone) < shards - 1 and classes[0][0] * (shards - len(alone)) > rest:
        size, count = classes[0]
        alone.append((size, len(alone), 1))
        rest -= size
        classes[:1] = [(size, count - 1)] if count > 1 else []
    if not classes:
        return alone
    used = lambda placed: 1 + max(k for _, k, _ in placed)
    bins, most = shards - len(alone), classes[0][0]
    low = max(-(-rest // bins), most)
    best = best_fit_decreasing(classes, low)
    if used(best) > bins:
        high = low + most
        while used(best := best_fit_decreasing(classes, high)) > bins:
            high += max(1, rest // bins // 8)
        for _ in range(steps):
            middle = (low + high) // 2
            tried = best_fit_decreasing(classes, middle)
            if used(tried) <= bins:
                best, high = tried, middle
            else:
                low = middle
            if high - low <= max(1, rest // bins // 10_000):
                break
    return alone + [(size, k + len(alone), n) for size, k, n in best]


def bin_pack(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, size, text_crc32, law ('bytes'), shard (0 to shards-1), slot, grown_shard (null).

    Sizes are UTF-8 bytes of the text (null: none) plus 1. Documents of equal texts (null counts as empty) form a
    group that stays whole. Groups are summed in partial aggregates, so a group with a third of the rows is one item.
    Best fit needs only how many groups have which size: the driver gets one row a size, of which there are no more
    than the longest text has bytes, and groups of a size take their places by rank, found in ranges dealt to many
    tasks. Groups of many rows are joined by broadcast, the others by shuffle. slot numbers each shard's documents from
    0 in id order. A group larger than an even share fills a shard alone. Ties of size are broken by the texts' hashes.
    Repeated rows each get a slot; very long texts are only measured and hashed; an empty table gives an empty result;
    other columns of docs are ignored. Results don't depend on partitions or reruns.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.lit(1)).alias("g"), F.xxhash64(F.lit(2), text).alias("g2"))
    rows = stored(rows, "sizes")
    groups = stored(rows.groupBy("g", "g2").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    classes = sorted(((r["size"], r["count"]) for r in groups.groupBy("size").count().collect()), reverse=True)
    taken, places = {}, []
    for size, k, n in pack(classes, shards):
        start = taken.get(size, 0)
        places.append((size, start, start + n, k))
        taken[size] = start + n
    plan = docs.sparkSession.createDataFrame(places, "size long, start long, stop long, shard int")
    ranked = prefix_sum(groups, "size", ["g", "g2"], None, "rank")
    shard = stored(ranked.join(small(plan, 32), "size").where("rank >= start AND rank < stop").select("g", "g2", "n", "shard"), "shards")
    out = prefix_sum(joined(rows, shard, ["g", "g2"], 48), "shard", ["doc_id", "g", "g2"], None, "slot")
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
