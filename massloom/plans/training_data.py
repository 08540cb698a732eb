"""Queries of the general training-data problems (1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from massloom.functions.keys import single_key
from massloom.functions.settings import known_energy
from massloom.operators.heavy_keys import per_key_summary
from massloom.operators.impute import completed, filled_fields, held_out_accuracy, unanimous_fills
from massloom.sources.tables import table


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "train").select(
        single_key(F.col("inchikey")).alias("key"), "precursor_mz", "collision_energy"
    )
    return per_key_summary(train, "key", "precursor_mz", known_energy(F.col("collision_energy")))


def p1_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per molecule: spectra, median precursor, energies seen."""
    return _summary(spark, sf_dir).select(
        F.col("key").alias("inchikey"),
        F.col("n_rows").alias("n_spectra"),
        F.round("median", 5).alias("median_precursor"),
        F.array_join(F.transform("seen_values", lambda e: F.format_string("%.1f", e)), ",").alias("energies"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that hold at least 2 percent of all rows of train."""
    everything = table(spark, sf_dir, "train").count()
    return _summary(spark, sf_dir).where(F.col("n_rows") * 50 >= everything).select(F.col("key").alias("inchikey"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps for which all known values of the group agree, with the value."""
    return unanimous_fills(table(spark, sf_dir, "train"))


def p4_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap with its fill and where it came from."""
    return filled_fields(table(spark, sf_dir, "train"))


def p4_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the three fields completed and marked."""
    return completed(table(spark, sf_dir, "train"))


def p4_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden known values per field: how many the model fills right, and how many the group's commonest value would."""
    return held_out_accuracy(table(spark, sf_dir, "train"))


QUERIES = {f.__name__: f for f in (p1_found, p1_keys, p4_found, p4_fills, p4_completed, p4_accuracy)}

_KEYED = r"""
WITH t AS (SELECT *, list_distinct(regexp_extract_all(upper(inchikey), '\b([A-Z]{14}-[A-Z]{10}-[A-Z])\b', 1)) AS ks FROM train),
keyed AS (SELECT *, CASE WHEN len(ks) = 1 THEN ks[1] END AS k FROM t)
"""

SQL = {
    "p1_found": _KEYED
    + """SELECT k AS inchikey FROM keyed WHERE k IS NOT NULL GROUP BY k HAVING count(*) * 50 >= (SELECT count(*) FROM train)""",
    "p1_keys": _KEYED
    + """SELECT k AS inchikey, count(*) AS n_spectra,
 round(quantile_cont(CASE WHEN NOT isnan(precursor_mz) THEN precursor_mz END, 0.5), 5) AS median_precursor,
 coalesce(array_to_string(list_transform(list_sort(list_distinct(list(CASE WHEN collision_energy > 0 AND collision_energy <= 200 THEN collision_energy END))), lambda x: printf('%.1f', x)), ','), '') AS energies
FROM keyed WHERE k IS NOT NULL GROUP BY k""",
    "p4_found": _KEYED
    + r""", r AS (SELECT spectrum_id, session_id, k, precursor_mz AS mz,
  CASE WHEN collision_energy > 0 AND collision_energy <= 200 THEN printf('%.1f', collision_energy) END AS e,
  CASE WHEN regexp_full_match(regexp_replace(adduct, '\s', '', 'g'), '\[[^\[\]?]+\][0-9]*[+-]') THEN regexp_replace(adduct, '\s', '', 'g') END AS a,
  CASE WHEN lower(trim(ionization_mode, E' \t')) IN ('p', 'pos', 'positive') THEN 'positive'
       WHEN lower(trim(ionization_mode, E' \t')) IN ('n', 'neg', 'negative') THEN 'negative' END AS m
  FROM keyed),
s AS (SELECT session_id, min(e) AS e1, max(e) AS e2, min(m) AS m1, max(m) AS m2 FROM r WHERE session_id IS NOT NULL GROUP BY 1),
ga AS (SELECT g.spectrum_id, min(o.a) AS a1, max(o.a) AS a2 FROM r g JOIN r o
  ON g.session_id = o.session_id AND g.k = o.k AND abs(g.mz - o.mz) <= 0.01 + 1e-9
  WHERE g.a IS NULL AND o.a IS NOT NULL GROUP BY 1)
SELECT spectrum_id, 'collision_energy' AS field, e1 AS value FROM r JOIN s USING (session_id) WHERE e IS NULL AND e1 = e2
UNION ALL SELECT spectrum_id, 'ionization_mode', m1 FROM r JOIN s USING (session_id) WHERE m IS NULL AND m1 = m2
UNION ALL SELECT spectrum_id, 'adduct', a1 FROM ga WHERE a1 = a2""",
}
