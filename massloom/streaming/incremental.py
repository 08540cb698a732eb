"""Incremental forms of batch results: the same aggregates kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from massloom.session import shared_folder


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder of files, or one file)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def run_to_end(result: DataFrame, by: list[str], name: str, fingerprint: str) -> DataFrame:
    """Runs an aggregating stream, grouped by ``by``, over all files there are, and gives the table of its last state.

    Progress and state lie under ``name`` in the shared folder, so a run of the same name goes on where the last one ended, and
    reads only files that are new. ``fingerprint`` says what is computed: a name that holds another one is refused. Every batch writes
    the groups that it changed; the table has the latest row of each group. An empty stream gives an empty table.
    """
    spark = result.sparkSession
    at = f"{shared_folder(spark)}/stream-{name}"
    _claim(spark, at, fingerprint)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{at}/state/batch={batch}")

    run = result.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    values = [c for c in result.columns if c not in by]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.schema.fields)
    states = spark.read.schema(f"{fields}, batch int").option("basePath", f"{at}/state").parquet(f"{at}/state")
    latest = states.groupBy(*by).agg(F.max_by(F.struct(*values), "batch").alias("s"))
    return latest.select(*by, "s.*")


def _claim(spark: SparkSession, at: str, fingerprint: str) -> None:
    """Notes what the stream at ``at`` computes, or refuses if it computes something else."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/about")):
        held = spark.read.text(f"{at}/about").first()[0]
        if held != fingerprint:
            raise ValueError(f"the stream at {at} computes {held!r}, not {fingerprint!r}")
    else:
        spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.text(f"{at}/about")
        spark.createDataFrame([], "none int").write.mode("ignore").parquet(f"{at}/state/batch=-1")


def windowed_counts(stream: DataFrame, time: str, length: str, late: str, *by: str) -> DataFrame:
    """Rows per window of event time and ``by``. State of windows older than ``late`` behind the newest event may be dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
