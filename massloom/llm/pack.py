"""Filling of containers of fixed capacity by bounded-space online best fit.

Each task lays its items, as they come, into a fixed number of open containers. A bitset has a bit for each free space
that an open container has, so the best fit is the lowest bit at or above the item's size. If nothing fits and all
places are taken, the fullest container closes. The few containers still open at the end of a task are laid together
once more by the same rule, so that room is lost only in a handful of containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from massloom.session import durable_table

CAPACITY = 2048
OPEN = 64
#: Items that one task takes, about; the number of tasks follows from it.
ITEMS_PER_TASK = 100_000


class OpenBins:
    """At most ``most`` open containers, found by their free space in a bitset."""

    def __init__(self, capacity: int, most: int, first: int) -> None:
        self.capacity, self.most, self.next, self.bits, self.count = capacity, most, first, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _put(self, bin_id: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(bin_id)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id

    def place(self, size: int) -> int:
        """The container for an item of ``size`` (1 to capacity)."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_id, free, self.next = self.next, self.capacity, self.next + 1
        if free > size:
            self._put(bin_id, free - size)
        return bin_id

    def open_bins(self) -> dict[int, int]:
        """Open containers and the room used in them."""
        return {b: self.capacity - free for free, bins in self.by_free.items() for b in bins}


def _lay(items: DataFrame, tasks: int, capacity: int, schema: str) -> DataFrame:
    """Adds ``bin`` and, for containers that stayed open, the room ``used`` in them, to ``items`` with a ``size``."""

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        bins = OpenBins(capacity, OPEN, task << 36)
        for pdf in batches:
            yield pdf.assign(bin=[bins.place(s) for s in pdf["size"].tolist()], used=0)
        left = bins.open_bins()
        if left:  # a row without an item for each container that is still open
            last = pd.DataFrame({"bin": list(left), "used": list(left.values())})
            yield last.reindex(columns=[c.split()[0] for c in schema.split(", ")]).astype({"bin": "int64", "used": "int64"})

    return (
        items.repartition(tasks, F.xxhash64(*items.columns))
        .sortWithinPartitions(F.xxhash64(*items.columns), *items.columns)  # the order in which items come is random, and fixed
        .mapInPandas(lay, schema)
    )


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key``, ``part``, ``start``, ``length``, ``container``: where each item, or part of an item, lies.

    An item larger than ``capacity`` is cut into full containers and a remainder; no other item is divided. Items of
    size 0 or null take no room: they come out with a null ``container`` and length 0. Repeated rows are items of their
    own. An empty table gives an empty result. Within a container parts don't overlap and sum to at most ``capacity``.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = sizes.select(F.col(key).alias("item"), n.alias("n")).select(
        "item",
        F.explode(
            F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).otherwise(
                F.array(F.lit(0).cast("long"))
            )
        ).alias("start"),
        "n",
    )
    parts = parts.select("item", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).alias("size"))
    parts = durable_table(parts)
    empty = parts.where("size <= 0")
    item_type = dict(parts.dtypes)["item"]
    tasks = max(1, -(-parts.count() // ITEMS_PER_TASK))
    laid = durable_table(
        _lay(parts.where("size > 0"), tasks, capacity, f"item {item_type}, start long, size long, bin long, used long")
    )
    # The containers that stayed open, at most OPEN for each task, are items of a second round.
    still_open = laid.where("used > 0").select(F.col("bin").alias("start"), F.col("used").alias("size"))
    again = max(1, -(-tasks * OPEN // ITEMS_PER_TASK))
    joined = _lay(still_open, again, capacity, "start long, size long, bin long, used long").where("size IS NOT NULL")
    renamed = joined.select(F.col("start").alias("bin"), (-1 - F.col("bin")).alias("merged"))
    placed = (
        laid.where("used = 0")
        .join(renamed, "bin", "left")
        .select("item", "start", F.col("size").alias("length"), F.coalesce("merged", "bin").alias("container"))
    )
    nothing = empty.select("item", "start", F.lit(0).cast("long").alias("length"), F.lit(None).cast("long").alias("container"))
    return placed.unionByName(nothing).select(
        F.col("item").alias(key), (F.col("start") / capacity).cast("int").alias("part"), "start", "length", "container"
    )
