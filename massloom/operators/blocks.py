"""A stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from massloom.operators.ranking import top_k


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def block_search(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, blocks: int) -> DataFrame:
    """The ``k`` rows of greatest cosine for each query vector, without the query itself; ties by key.

    Rows are dealt to blocks, each query visits every block and keeps ``k`` there, so what moves grows with the queries
    times the blocks, and no task holds more than a block.
    """
    q = queries.select(F.col(key).alias("bs_q"), F.col(vector).alias("bs_qv"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bs_block"))
    r = rows.select(F.col(key).alias("bs_r"), F.col(vector).alias("bs_rv"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("bs_block"))
    pairs = q.join(r, "bs_block").where("bs_q != bs_r").select(F.col("bs_q").alias(key), F.col("bs_r").alias("other"), F.round(cosine("bs_qv", "bs_rv"), 6).alias("cosine"))
    return top_k(pairs, key, [F.desc_nulls_last("cosine"), F.asc("other")], k)
