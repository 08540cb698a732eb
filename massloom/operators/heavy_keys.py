"""Per-key results when a few keys hold most rows.

Heavy keys are found by a mergeable frequent-items sketch, routed by a broadcast join against the (bounded) table of
heavy keys, and reduced in two steps so that no task holds all rows of one of them. The remaining keys go through an
ordinary shuffle. The union of both parts is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from massloom.session import durable

#: A key with this share of the rows is heavy at least, so at most 1 / HEAVY_SHARE keys are where tasks are few; and the least share
#: that is heavy however many tasks there are, which bounds the keys that are sent to all of them.
HEAVY_SHARE, LEAST_SHARE = 0.002, 0.00002
#: Counters of the sketch; its error is below 4 / SKETCH_ITEMS of the rows.
SKETCH_ITEMS = 8192


def heavy_share(df: DataFrame) -> float:
    """The share of rows from which a key is heavy: half of what a task of an even shuffle holds, HEAVY_SHARE at most."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_SHARE, min(HEAVY_SHARE, 0.5 / tasks))


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """One column, ``key``: the keys that hold at least ``share`` of the rows with a key (and perhaps some just below).

    The sketch never under-reports: a key of ``share`` of the rows is always among them. At most 2 / share keys come
    out, whatever the size of ``df``. Null keys are none. An empty table gives no key.
    """
    most = int(2 / share)
    keyed = df.where(F.col(key).isNotNull()).select(key)
    found = keyed.agg(
        F.expr(f"approx_top_k({key}, {most}, {max(SKETCH_ITEMS, 4 * most)})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    slack = 4.0 / max(SKETCH_ITEMS, 4 * most)
    item = F.explode("top").alias("t")
    return (
        found.select(item, "n")
        .where(F.col("t.count") >= F.col("n") * F.lit(share - slack))
        .select(F.col("t.item").alias(key))
    )


def exact_median_in_buckets(df: DataFrame, key: str, value: str, width: float = 0.1) -> DataFrame:
    """``key``, ``median``: the exact median of each of a few heavy keys, with no task holding all values of a key.

    Values are counted (combined on the map side), the counts are summed by buckets of ``width``, and only the buckets
    that hold the middle ranks are looked at value by value.
    """
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("bucket", F.floor(F.col(value) / width))
    buckets = counted.groupBy(key, "bucket").agg(F.sum("n").alias("n"))
    upto = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(key)
    buckets = buckets.select(
        key, "bucket", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("all")
    )
    lo, hi = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)  # ranks from 0
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    middle = buckets.where(holds(lo) | holds(hi)).select(key, "bucket", "before", "all")  # at most two rows a key
    inside = W.partitionBy(key, "bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = counted.join(F.broadcast(middle), [key, "bucket"]).withColumn(
        "before", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    return (
        ranked.where(holds(lo) | holds(hi))
        .groupBy(key)
        .agg(((F.min(value) + F.max(value)) / 2).alias("median"))
    )


def per_key_summary(df: DataFrame, key: str, value: str, seen: Column, share: float | None = None) -> DataFrame:
    """Per key: ``n_rows``, ``median`` of ``value`` and ``seen_values``, the distinct values of ``seen``, sorted.

    Rows with a null key belong to no key. Null and NaN values count as rows but not for the median; a key without a
    value has a null median and, without a seen value, an empty array. Repeated rows count as often as they occur.
    Other columns of ``df`` don't matter, whatever their names. An empty table gives an empty result.
    """
    rows = df.select(
        F.col(key).alias("hk_key"),
        F.when(~F.isnan(value), F.col(value)).alias("hk_value"),
        seen.alias("hk_seen"),
    ).where(F.col("hk_key").isNotNull())
    heavy = durable(heavy_keys(rows, "hk_key", share or heavy_share(rows)))  # found once, used by both parts
    flagged = rows.join(F.broadcast(heavy.withColumn("is_heavy", F.lit(True))), "hk_key", "left")
    few, rest = flagged.where("is_heavy"), flagged.where("is_heavy IS NULL")

    rest_part = rest.groupBy("hk_key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr("percentile(hk_value, 0.5)").alias("median"),
        F.array_sort(F.collect_set("hk_seen")).alias("seen_values"),
    )
    # A heavy key is spread by what was seen with it, counted there, and put together from those few counts.
    spread = few.groupBy("hk_key", "hk_seen").agg(F.count(F.lit(1)).alias("n"))
    totals = spread.groupBy("hk_key").agg(
        F.sum("n").alias("n_rows"), F.array_sort(F.collect_set("hk_seen")).alias("seen_values")
    )
    heavy_part = totals.join(exact_median_in_buckets(few, "hk_key", "hk_value"), "hk_key", "left").select(
        "hk_key", "n_rows", "median", "seen_values"
    )
    return rest_part.unionByName(heavy_part).withColumnRenamed("hk_key", key)


def skew_join(rows: DataFrame, side: DataFrame, key: str, share: float | None = None) -> DataFrame:
    """Left join of ``rows`` with ``side`` (one row per ``key``) when a few keys hold most of ``rows``.

    The part of ``side`` for the heavy keys (at most 2 / share of them) is broadcast to their rows, which stay where
    they are; the rest goes through an ordinary shuffle. Rows with a null key, or without a partner, get nulls.
    """
    heavy = durable(heavy_keys(rows, key, share or heavy_share(rows)))
    marked = rows.join(F.broadcast(heavy.withColumn("sj_heavy", F.lit(True))), key, "left")
    few = marked.where("sj_heavy").drop("sj_heavy").join(F.broadcast(side.join(F.broadcast(heavy), key, "left_semi")), key, "left")
    rest = marked.where("sj_heavy IS NULL").drop("sj_heavy").join(side, key, "left")
    return few.unionByName(rest)
