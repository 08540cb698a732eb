"""Best rows per group, molecule tables, purges against a benchmark and reproducible splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from massloom.functions.chem import near_energy


def best_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order. The limit of one row is applied before the shuffle."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("rn = 1").drop("rn")


def representatives(df: DataFrame, key: str, weight: str, tie: str) -> DataFrame:
    """Per key the row with the greatest ``weight`` (nulls last), ties by the least ``tie``: one aggregate, no sort."""
    best = F.max_by(F.struct(tie, weight), F.struct(F.coalesce(F.col(weight), F.lit(-(1 << 31))), -F.col(tie)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("b")).select(key, f"b.{tie}", f"b.{weight}")


def molecule_table(df: DataFrame, key: str, mass: str, mode: str) -> DataFrame:
    """Per key: exact median of ``mass``, commonest ``mode`` (ties to the last in the alphabet) and the number of rows.

    Modes are counted per (key, mode) on the map side first, so a hot key moves as a few counts.
    """
    keyed = df.where(F.col(key).isNotNull())
    counted = keyed.where(F.col(mode).isNotNull()).groupBy(key, mode).agg(F.count(F.lit(1)).alias("n"))
    commonest = counted.groupBy(key).agg(F.max_by(mode, F.struct("n", mode)).alias("mode"))
    median = keyed.groupBy(key).agg(F.round(F.expr(f"percentile({mass}, 0.5)"), 5).alias(f"median_{mass.split('_')[0]}"), F.count(F.lit(1)).alias("n_spectra"))
    return median.join(commonest, key, "left")


def purge(library: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``library`` without what ``benchmark`` withholds, by anti-joins.

    Keys of the groups C2 and C3 go wholly; of a C1 key the rows whose energy is near that of the query go, and those with
    the query's peaks whatever their energy; its other siblings stay. Rows without a key stay, except withheld spectra.
    Peaks are compared if both sides have ``digests`` (see ``peaks.digests``), the withheld spectra are known if the
    benchmark has ``source_spectrum_id``.
    """
    wholly = benchmark.where("query_group IN ('C2', 'C3')").select("inchikey").distinct()
    c1 = benchmark.where("query_group = 'C1'")
    by_peaks, by_id = "digests" in library.columns and "digests" in benchmark.columns, "source_spectrum_id" in benchmark.columns
    held = [F.col("inchikey").alias("c1_key"), F.col("energy").alias("c1_energy"), *([F.col("digests").alias("c1_digests")] if by_peaks else [])]
    same = near_energy(F.col("energy"), F.col("c1_energy"))
    if by_peaks:
        same = same | F.coalesce(F.arrays_overlap("digests", "c1_digests"), F.lit(False))
    kept = library.join(wholly, "inchikey", "left_anti")
    kept = kept.join(c1.select(*held).distinct(), (F.col("inchikey") == F.col("c1_key")) & same, "left_anti").drop("digests")
    return kept.join(c1.select(F.col("source_spectrum_id").alias("spectrum_id")).distinct(), "spectrum_id", "left_anti") if by_id else kept


def hash_split(df: DataFrame, key: str, folds: int) -> DataFrame:
    """Adds ``fold``: the same for all rows of a key, on every engine that knows MD5."""
    return df.withColumn("fold", F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") % folds)
