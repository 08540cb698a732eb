"""Queries of the training-data problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from massloom.llm.encode import decode_ids, encode_texts
from massloom.llm.group_split import block_entities, split_records, tied_blocks
from massloom.llm.neighbours import neighbours
from massloom.llm.overlap import overlap_report, overlaps
from massloom.llm.pack import CAPACITY, pack
from massloom.llm.skeleton import same_look_classes, same_look_pairs, with_skeleton
from massloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of spectra with a cosine of at least 0.92: the part of all lists of ten that lies there."""
    near = neighbours(table(spark, sf_dir, "train"), "spectrum_id", "ms2_mzs", "ms2_intensities", k=10, least=0.92)
    return near.select(
        F.least("id", "other").alias("spectrum_id_a"), F.greatest("id", "other").alias("spectrum_id_b")
    ).distinct()


def p2_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar spectra of every spectrum whose id is divisible by 100, against all spectra.

    Most true neighbours have a cosine of 0.3 to 0.5, so up to 128 lists are searched, pruned by the distance ratio.
    """
    near = neighbours(
        table(spark, sf_dir, "train"), "spectrum_id", "ms2_mzs", "ms2_intensities",
        k=10, queries=F.col("id") % 100 == 0, stored=3, searched=128,
    )
    return near.select(F.col("id").alias("spectrum_id"), "rank", F.col("other").alias("neighbour_id"), F.round("cos", 5).alias("cosine"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation records whose structure occurs in train."""
    return p3_overlaps(spark, sf_dir).where("by_key OR by_structure").select("split", "source_library", "spectrum_id")


def p3_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlapping evaluation records, how they were found and how far they are covered."""
    return overlaps(table(spark, sf_dir, "external_spectra"), table(spark, sf_dir, "train"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted per split and source."""
    return overlap_report(table(spark, sf_dir, "external_spectra"), table(spark, sf_dir, "train"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of short keys that must share a split."""
    return tied_blocks(table(spark, sf_dir, "train"))


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every short key and the entity that it belongs to: membership instead of pairs."""
    return block_entities(table(spark, sf_dir, "train"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every spectrum."""
    return split_records(table(spark, sf_dir, "train"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra and entities of each split, counted exactly."""
    return shares(p5_splits(spark, sf_dir))


def shares(splits: DataFrame) -> DataFrame:
    """``n_spectra`` and ``n_entities`` of each split; rows are counted per entity first, so a large split is no hot key."""
    entities = splits.groupBy("split", "entity").agg(F.count(F.lit(1)).alias("n"))
    return entities.groupBy("split").agg(F.sum("n").alias("n_spectra"), F.count("entity").alias("n_entities"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return decode_ids(p6_ids(spark, sf_dir), "doc_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every speech, or part of one."""
    return pack(_sizes(spark, sf_dir), "doc_id", "n_tokens")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are, and the share of their room that is used."""
    used = p7_containers(spark, sf_dir).where("container IS NOT NULL").groupBy("container").agg(F.sum("length").alias("used"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 4).alias("fill"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents whose texts look the same but are not the same characters."""
    pairs = same_look_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a visible character and its class of equal look: membership instead of pairs."""
    return same_look_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in the consistent form."""
    return with_skeleton(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "skeleton")


QUERIES = {f.__name__: f for f in (p2_found, p2_knn, p3_found, p3_overlaps, p3_report, p5_found, p5_blocks, p5_splits, p5_shares, p6_ids, p6_decoded, p7_containers, p7_fill, p8_found, p8_classes, p8_forms)}

_BLOCKS = r"""WITH RECURSIVE b AS (SELECT spectrum_id, list_distinct(list_concat(list_transform(regexp_extract_all(upper(inchikey), '\b([A-Z]{14}-[A-Z]{10}-[A-Z])\b', 1), lambda k: left(k, 14)),
  CASE WHEN regexp_matches(upper(inchikey14), '^\s*([A-Z][A-Z0-9 ]*[=:]\s*)?[A-Z]{14}\s*$') THEN [regexp_extract(upper(inchikey14), '([A-Z]{14})\s*$', 1)] ELSE [] END)) AS bs FROM train),
 n AS (SELECT DISTINCT unnest(bs) AS block FROM b),
 l AS (SELECT DISTINCT x.block AS u, y.block AS v FROM (SELECT spectrum_id, unnest(bs) AS block FROM b WHERE len(bs) > 1) x JOIN (SELECT spectrum_id, unnest(bs) AS block FROM b WHERE len(bs) > 1) y
  USING (spectrum_id) WHERE x.block <> y.block),
 reach(u, v) AS (SELECT u, v FROM l UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u)
"""

SQL = {
    "p5_found": _BLOCKS + "SELECT u AS block_a, v AS block_b FROM reach WHERE u < v",
    "p5_blocks": _BLOCKS + "SELECT block, coalesce(least(block, min(v)), block) AS entity FROM n LEFT JOIN reach ON u = block GROUP BY block",
    "p2_found": """WITH p AS (SELECT spectrum_id, floor(unnest(ms2_mzs))::INT AS d, unnest(ms2_intensities) AS i FROM train
  WHERE len(ms2_mzs) = len(ms2_intensities) AND len(ms2_mzs) > 0),
 v AS (SELECT spectrum_id, d, sum(i) AS x FROM p GROUP BY 1, 2), n AS (SELECT spectrum_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1),
 u AS (SELECT spectrum_id, d, x / n AS x FROM v JOIN n USING (spectrum_id) WHERE n > 0)
 SELECT a.spectrum_id AS spectrum_id_a, b.spectrum_id AS spectrum_id_b FROM u a JOIN u b ON a.d = b.d AND a.spectrum_id < b.spectrum_id
 GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.92""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
