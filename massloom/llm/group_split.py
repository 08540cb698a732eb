"""Splits that keep related records together.

Records are tied by the blocks that they name, also through further records (connected components). Components are
laid into many nearly equal bins by repeated largest differencing: each group of components is differenced on its own,
the bins that come out are differenced again, until few bins are left; whole bins then go to the splits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from massloom.functions.keys import row_blocks
from massloom.functions.settings import known_energy
from massloom.operators.heavy_keys import HEAVY_SHARE, skew_join
from massloom.session import durable

#: Target shares, in the order in which ties are broken.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Entities that one task differences, and the bins that it makes of them.
GROUP, BINS = 20_000, 128
#: The border between low and high collision energies.
HIGH_ENERGY = 30.0


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for the nodes of ``links`` (``u``, ``v``): the least node of each connected component.

    Alternates two star operations: every node's larger neighbours are linked to its least neighbour, then its smaller
    ones. Each round is two joins on the shrinking set of links, kept durably; the number of rounds grows with the
    logarithm of the longest chain. A node with a large share of all links takes its least neighbour by broadcast, so its links
    stay spread over tasks. Null ends and loops are left out.
    """
    edges = links.where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    edges = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state, ends = None, 2 * edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        large = _joined(both.where("v > u"), least, ends).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _joined(large, low, ends).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, ends = now, 2 * now[0]
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _joined(edges: DataFrame, side: DataFrame, ends: int) -> DataFrame:
    """``edges`` with the ``m`` of their ``u``. Nodes with HEAVY_SHARE of all ``ends`` of links (at most 1 / HEAVY_SHARE nodes) are joined by broadcast."""
    hub = F.col("n") >= HEAVY_SHARE * ends
    hubs = F.broadcast(side.where(hub).select("u", F.col("m").alias("hub_m")))
    marked = edges.join(hubs, "u", "left")
    rest = marked.where("hub_m IS NULL").select("u", "v").join(side.where(~hub).select("u", "m"), "u")
    return marked.where("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest)


def block_components(train: DataFrame) -> DataFrame:
    """``node``, ``root`` of the blocks that share a record with another block, directly or through further records."""
    named = train.select(row_blocks(F.col("inchikey"), F.col("inchikey14")).alias("blocks")).where(F.size("blocks") > 1).distinct()
    links = named.select(F.get("blocks", 0).alias("u"), F.explode(F.slice("blocks", 2, 1 << 30)).alias("v"))
    return components(links)


def block_entities(train: DataFrame) -> DataFrame:
    """``block``, ``entity``: every block that a record names, and the least block that must share its split (itself if it is tied to none)."""
    blocks = train.select(F.explode(row_blocks(F.col("inchikey"), F.col("inchikey14"))).alias("block")).distinct()
    roots = block_components(train).distinct().withColumnRenamed("node", "block")
    return blocks.join(roots, "block", "left").select("block", F.coalesce("root", "block").alias("entity"))


def difference(weights: np.ndarray, bins: int) -> np.ndarray:
    """The bin (0 to bins - 1) of each weight by largest differencing into nearly equal bins.

    Every weight starts as a tuple of bin sums with all but one empty; the two tuples with the widest spread are
    combined, the fullest bin of one with the emptiest of the other, until one tuple is left.
    """
    n = len(weights)
    if n == 0:
        return np.zeros(0, int)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # A tuple holds its non-empty bins as (sum, member), fullest first; the others are empty.
    heap = [(-float(w), i, [(float(w), i)]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        keep = max(0, min(len(a), bins - len(b)))  # the fullest of a meet empty bins of b
        merged = a[:keep]
        rest_a, rest_b = a[keep:], b[: max(0, bins - len(a))]
        merged += rest_b
        rest_b = b[len(rest_b) :]
        for (x, i), (y, j) in zip(rest_a, reversed(rest_b), strict=True):
            parent[find(j)] = find(i)
            merged.append((x + y, i))
        merged.sort(reverse=True)
        low = merged[-1][0] if len(merged) == bins else 0.0
        if low and len(merged) == bins:
            spread = merged[0][0] - low
        else:
            spread = merged[0][0]
        count += 1
        heapq.heappush(heap, (-spread, count, merged))
    label = {find(i): k for k, (_, i) in enumerate(heap[0][2])}
    return np.array([label[find(i)] for i in range(n)])


def allocate(bins: np.ndarray, shares: dict[str, float] = SHARES) -> list[str]:
    """A split for each bin (rows: bins; columns: weight by stratum), largest bins first, each where it fits the targets best."""
    names, part = list(shares), np.array(list(shares.values()))
    total = bins.sum(0)
    target = np.outer(part / part.sum(), total)
    has = np.zeros_like(target)
    scale = np.maximum(target, 1.0)
    out = [names[0]] * len(bins)
    for k in np.argsort(-bins.sum(1), kind="stable"):
        cost = [(((has[s] + bins[k] - target[s]) ** 2 - (has[s] - target[s]) ** 2) / scale[s]).sum() for s in range(len(names))]
        s = int(np.argmin(cost))
        has[s] += bins[k]
        out[k] = names[s]
    return out


def _differenced(items: DataFrame, groups: int, level: int) -> DataFrame:
    """``entity``, ``bin``, ``low``, ``high``, ``other``: the bin of each entity within its group at this level."""

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entity", kind="stable")
        k = difference(pdf[["low", "high", "other"]].sum(axis=1).to_numpy(), BINS)
        name = pdf["g"].astype(str) + f"/{level}/" + pd.Series(k, index=pdf.index).astype(str)
        return pdf.assign(bin=name)[["entity", "bin", "low", "high", "other"]]

    dealt = items.withColumn("g", F.pmod(F.xxhash64("entity", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(lay, "entity string, bin string, low long, high long, other long")


def split_entities(entities: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """``entity``, ``split`` for ``entities`` (``entity``, and the weights ``low``, ``high``, ``other``)."""
    levels, items, n = [], entities, entities.count()
    level = 0
    while True:
        groups = max(1, -(-n // GROUP))
        laid = durable(_differenced(items, groups, level))
        levels.append(laid.select("entity", "bin"))
        items = laid.groupBy(F.col("bin").alias("entity")).agg(*(F.sum(c).alias(c) for c in ("low", "high", "other")))
        n = groups * BINS
        level += 1
        if groups == 1:
            break
    last = items.orderBy("entity").toPandas()  # at most BINS rows
    chosen = allocate(last[["low", "high", "other"]].to_numpy(float), shares) if len(last) else []
    rows = list(zip(last["entity"].tolist(), chosen, strict=True))
    final = entities.sparkSession.createDataFrame(rows, "bin string, split string")
    out = levels[-1].join(F.broadcast(final), "bin").select("entity", "split")
    for below in reversed(levels[:-1]):
        out = below.join(out.withColumnRenamed("entity", "bin"), "bin").select("entity", "split")
    return out


def split_records(train: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """``spectrum_id``, ``entity``, ``split``: records tied by a block land in the same split.

    Records that name no block are tied to nothing. Low and high collision energies (and unknown ones) are spread alike.
    Repeated rows count as often as they occur. An empty table gives an empty result. The shares are met up to the
    weight of the largest entities, which are never divided.
    """
    blocks = row_blocks(F.col("inchikey"), F.col("inchikey14"))
    energy = known_energy(F.col("collision_energy"))
    rows = train.select(
        "spectrum_id", F.coalesce(F.get(blocks, 0), F.concat(F.lit("row:"), F.col("spectrum_id").cast("string"))).alias("node"),
        F.when(energy.isNull(), "other").when(energy < HIGH_ENERGY, "low").otherwise("high").alias("stratum"),
    )
    weights = rows.groupBy("node").agg(*(F.count_if(F.col("stratum") == s).alias(s) for s in ("low", "high", "other")))
    roots = block_components(train)
    nodes = weights.join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("entity"), "low", "high", "other"
    )
    nodes = durable(nodes)
    entities = nodes.groupBy("entity").agg(*(F.sum(c).alias(c) for c in ("low", "high", "other")))
    placed = nodes.select("node", "entity").join(split_entities(entities, shares), "entity")
    return skew_join(rows.select("spectrum_id", "node"), placed, "node").select("spectrum_id", "entity", "split")


def tied_blocks(train: DataFrame) -> DataFrame:
    """``block_a`` < ``block_b``: the pairs of different blocks that must share a split."""
    c = block_components(train).distinct()
    return (
        c.select(F.col("node").alias("block_a"), "root")
        .join(c.select(F.col("node").alias("block_b"), "root"), "root")
        .where("block_a < block_b")
        .select("block_a", "block_b")
    )
