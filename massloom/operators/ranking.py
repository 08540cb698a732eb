"""Scores within a query: statistics, fusion, ranks and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


# Priors by source, the steps and weights of the fused score, and the bounds of the clipped z-score.
PRIORS = {"TRAIN": 0.05, "COCONUT": 0.02}
PPM_SCALE, DIRECT_GATE, DIRECT_STRONG, DIRECT_WEIGHT, STRONG_BONUS, ANALOG_WEIGHT, BIT_WEIGHT = 100.0, 0.1, 0.7, 2.0, 2.0, 1.5, 0.10
LEAST_SPREAD, CLIP = 0.5, 2.5


def z_score(x: Column, *by: str) -> Column:
    """Population z-score; 0 where the spread is at most 1e-9."""
    per = W.partitionBy(*by)
    return standardised(x, F.avg(x).over(per), F.stddev_pop(x).over(per))


def standardised(x: Column, mean: Column, sd: Column) -> Column:
    """``z_score`` with the mean and the spread at hand."""
    return F.when(sd > 1e-9, (x - mean) / sd).otherwise(0.0)


def clipped_z(x: Column, *by: str, floor: float = LEAST_SPREAD, clip: float = CLIP) -> Column:
    """z-score with a least spread, clipped to both sides."""
    per = W.partitionBy(*by)
    return clipped(x, F.avg(x).over(per), F.stddev_pop(x).over(per), floor, clip)


def clipped(x: Column, mean: Column, sd: Column, floor: float = LEAST_SPREAD, clip: float = CLIP) -> Column:
    """``clipped_z`` with the mean and the spread at hand."""
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - mean) / F.greatest(sd, F.lit(floor))))


def min_max(x: Column, *by: str) -> Column:
    """0 for the least and 1 for the greatest value; 0 if all are equal."""
    per = W.partitionBy(*by)
    return within_bounds(x, F.min(x).over(per), F.max(x).over(per))


def within_bounds(x: Column, lo: Column, hi: Column) -> Column:
    """``min_max`` with the least and the greatest value at hand."""
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)


def rank_share(order: list[Column], *by: str) -> Column:
    """1 for the first and 0 for the last row in a total order; 1 for a single row."""
    per = W.partitionBy(*by)
    return share_of_place(F.row_number().over(per.orderBy(*order)), F.count(F.lit(1)).over(per))


def share_of_place(place: Column, n: Column) -> Column:
    """``rank_share`` with the row's place and the number of rows at hand."""
    return F.when(n > 1, 1 - (place - 1) / (n - 1)).otherwise(1.0)


def source_prior(sources: Column) -> Column:
    """0.05 for entries known from TRAIN alone, 0.02 for those of COCONUT alone, else 0."""
    alone = lambda s: (F.size(sources) == 1) & F.array_contains(sources, s)
    return F.when(alone("TRAIN"), PRIORS["TRAIN"]).when(alone("COCONUT"), PRIORS["COCONUT"]).otherwise(0.0)


def fused_score(ppm: Column, prior: Column, direct: Column, analog: Column, z: Column, w: float = BIT_WEIGHT) -> Column:
    """-ppm/100 + prior + 2 direct (from 0.1 on; 2 more from 0.7 on) + 1.5 analog + w z."""
    strong = F.when(direct >= DIRECT_STRONG, STRONG_BONUS).otherwise(0.0)
    hit = F.when(direct >= DIRECT_GATE, DIRECT_WEIGHT * direct + strong).otherwise(0.0)
    return -ppm / PPM_SCALE + prior + hit + ANALOG_WEIGHT * analog + w * z


def top_k(df: DataFrame, by: str, order: list[Column], k: int = 25) -> DataFrame:
    """The first ``k`` rows of each group in a total order, with ``rank``. Partial limits are pushed below the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def ranking_metrics(rank: Column, k: int = 25) -> list[Column]:
    """Aggregates over one row per query; a null rank means the truth wasn't retrieved."""
    hit = lambda n: F.round(F.avg(F.when(rank <= n, 1.0).otherwise(0.0)), 6)
    return [
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(rank <= k, 1.0 / rank).otherwise(0.0)), 6).alias("mrr"),
        hit(1).alias("hit_1"),
        hit(5).alias("hit_5"),
        hit(k).alias("hit_k"),
    ]
