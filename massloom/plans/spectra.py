"""Queries over spectra: masses, formulas, settings, peak lists, bins, duplicates, purges and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from massloom.functions import chem, peaks as pk
from massloom.functions.keys import readable_keys, single_key
from massloom.functions.settings import known_adduct, known_energy, known_mode
from massloom.operators.dedup import best_per_group, hash_split, molecule_table, purge, representatives
from massloom.operators.heavy_keys import skew_join
from massloom.operators.similarity import near_identical, whole_vectors
from massloom.sources.tables import table


def _peaks() -> Column:
    return pk.peaks(F.col("ms2_mzs"), F.col("ms2_intensities"))


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "train")


def neutral_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neutral mass of every spectrum with a readable adduct, by the dimension parsed from train's own adducts."""
    train = _train(spark, sf_dir).select("spectrum_id", "precursor_mz", known_adduct(F.col("adduct")).alias("adduct"))
    dimension = chem.adduct_dimension(train).where("n_m IS NOT NULL")
    m = chem.neutral_mass(*(F.col(c) for c in ("precursor_mz", "n_m", "adds", "losses", "charge", "sgn")))
    return train.join(dimension, "adduct").select("spectrum_id", "adduct", F.round(m, 4).alias("neutral_mass"))


def adduct_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adducts of train, parsed."""
    adducts = _train(spark, sf_dir).select(known_adduct(F.col("adduct")).alias("adduct"))
    d = chem.adduct_dimension(adducts).where("n_m IS NOT NULL")
    return d.select("adduct", "n_m", F.round("adds", 4).alias("adds"), F.round("losses", 4).alias("losses"), "charge", "sgn")


def formula_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass, unsaturation, verdict of the composition rules and Hill form of every catalog formula."""
    counts = chem.element_counts(F.col("formula"))
    return table(spark, sf_dir, "candidates").select(
        "candidate_id",
        F.round(chem.formula_mass(F.col("formula")), 5).alias("mass"),
        chem.rdbe(counts).alias("rdbe"),
        chem.formula_verdict(counts).alias("verdict"),
        chem.hill_formula(counts).alias("hill"),
    ).where("mass IS NOT NULL")


def catalog_mass_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of the recorded mass of a catalog entry from that of its formula."""
    mass = chem.formula_mass(F.col("formula"))
    c = table(spark, sf_dir, "candidates").where("exact_mass IS NOT NULL AND formula IS NOT NULL")
    return c.select("candidate_id", F.round(chem.ppm_error(F.col("exact_mass"), mass), 2).alias("ppm"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per instrument family, polarity and energy bin: spectra."""
    return (
        _train(spark, sf_dir)
        .select(
            chem.instrument_family(F.col("instrument_type")).alias("family"),
            F.coalesce(chem.polarity(known_mode(F.col("ionization_mode"))), F.lit(0)).alias("polarity"),
            chem.energy_bin(known_energy(F.col("collision_energy"))).alias("energy_bin"),
        )
        .groupBy("family", "polarity", "energy_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def peak_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that are left, and their summed relative intensity, under the profiles A to D."""
    t = _train(spark, sf_dir).where(F.size(_peaks()) > 0).select("spectrum_id", "precursor_mz", _peaks().alias("ps"))
    forms = [
        F.struct(F.lit(name).alias("profile"), pk.profile(F.col("ps"), F.coalesce("precursor_mz", F.lit(-10.0)), name).alias("kept"))
        for name in pk.PROFILES
    ]
    return t.select("spectrum_id", F.explode(F.array(*forms)).alias("f")).select(
        "spectrum_id",
        F.col("f.profile").alias("profile"),
        F.size("f.kept").alias("n_peaks"),
        F.round(F.aggregate("f.kept", F.lit(0.0), lambda a, p: a + p["i"]), 5).alias("intensity"),
    )


def peak_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that are left, and their summed relative intensity, under the variants of preparation (the two that only search otherwise are left out)."""
    t = _train(spark, sf_dir).where(F.size(_peaks()) > 0).select("spectrum_id", "precursor_mz", _peaks().alias("ps"))
    forms = [
        F.struct(F.lit(name).alias("variant"), pk.variant(F.col("ps"), F.coalesce("precursor_mz", F.lit(-10.0)), name).alias("kept"))
        for name in pk.VARIANTS
    ]
    return t.select("spectrum_id", F.explode(F.array(*forms)).alias("f")).select(
        "spectrum_id", F.col("f.variant").alias("variant"), F.size("f.kept").alias("n_peaks"),
        F.round(F.aggregate("f.kept", F.lit(0.0), lambda a, p: a + p["i"]), 5).alias("intensity"),
    )


def isotope_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of every spectrum that are no isotope companion of a stronger peak."""
    t = _train(spark, sf_dir).where(F.size(_peaks()) > 0)
    return t.select("spectrum_id", F.size(pk.drop_isotopes(_peaks())).alias("n_peaks"))


def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy of every spectrum."""
    t = _train(spark, sf_dir).where(F.size(_peaks()) > 0)
    return t.select("spectrum_id", F.round(pk.spectral_entropy(_peaks()), 6).alias("entropy"))


def entropy_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest entropy-weighted share, and entropy after weighting, of every spectrum."""
    t = _train(spark, sf_dir).where(F.size(_peaks()) > 0).select("spectrum_id", pk.entropy_weighted(_peaks()).alias("w"))
    return t.select("spectrum_id", F.round(pk.base_peak(F.col("w")), 6).alias("top"), F.round(pk.spectral_entropy(F.col("w")), 6).alias("entropy"))


def coarse_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest and summed relative intensity per spectrum and 1 Da bin."""
    p = _train(spark, sf_dir).where(F.size(_peaks()) > 0).select("spectrum_id", F.explode(pk.normalize(_peaks())).alias("p"))
    b = p.select("spectrum_id", pk.coarse_bin(F.col("p.mz")).alias("bin"), F.col("p.i").alias("i")).where("bin IS NOT NULL")
    return b.groupBy("spectrum_id", "bin").agg(F.round(F.max("i"), 6).alias("highest"), F.round(F.sum("i"), 6).alias("total"))


def merged_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks per spectrum once neighbours closer than 0.005 are one, in window form of the adjacent-gap rule."""
    p = _train(spark, sf_dir).where(F.size(_peaks()) > 0).select("spectrum_id", F.explode(_peaks()).alias("p"))
    p = p.select("spectrum_id", F.col("p.mz").alias("mz"))
    gap = F.col("mz") - F.lag("mz").over(W.partitionBy("spectrum_id").orderBy("mz"))
    return p.withColumn("gap", gap).groupBy("spectrum_id").agg(F.count_if(F.col("gap").isNull() | (F.col("gap") >= 0.005)).alias("n_peaks"))


def best_per_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum with most peaks of each molecule and energy bin."""
    t = _train(spark, sf_dir).select("spectrum_id", single_key(F.col("inchikey")).alias("inchikey"), "num_peaks",
        chem.energy_bin(known_energy(F.col("collision_energy"))).alias("energy_bin"))
    return best_per_group(t.where("inchikey IS NOT NULL"), ["inchikey", "energy_bin"], [F.desc_nulls_last("num_peaks"), F.asc("spectrum_id")])


def richest_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of each molecule: most peaks, then least id."""
    t = _train(spark, sf_dir).select("spectrum_id", single_key(F.col("inchikey")).alias("inchikey"), "num_peaks")
    return representatives(t, "inchikey", "num_peaks", "spectrum_id")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median precursor, commonest polarity and number of spectra of each molecule."""
    t = _train(spark, sf_dir).select(single_key(F.col("inchikey")).alias("inchikey"), "precursor_mz", known_mode(F.col("ionization_mode")).alias("mode"))
    return molecule_table(t, "inchikey", "precursor_mz", "mode")


def catalog_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures of catalog, train and evaluation splits together, with all their sources."""
    c = table(spark, sf_dir, "candidates").select("inchikey", F.explode("source").alias("source"))
    t = _train(spark, sf_dir).select(F.explode(readable_keys(F.col("inchikey"))).alias("inchikey"), F.lit("TRAIN").alias("source"))
    e = table(spark, sf_dir, "external_spectra").select(F.explode(readable_keys(F.col("inchikey"))).alias("inchikey"), F.col("source_library").alias("source"))
    every = c.unionByName(t).unionByName(e).distinct()  # distinct first: a hot key has few sources
    return every.groupBy("inchikey").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def purged_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train without what the benchmark withholds: keys of C2 and C3, and for C1 the rows of the same key at a near energy or with the query's peaks."""
    t = _train(spark, sf_dir).select("spectrum_id", single_key(F.col("inchikey")).alias("inchikey"), known_energy(F.col("collision_energy")).alias("energy"),
        pk.digests(F.col("ms2_mzs"), F.col("ms2_intensities")).alias("digests"))
    b = table(spark, sf_dir, "benchmark_queries").select("query_group", F.col("true_inchikey").alias("inchikey"), F.col("observed_collision_energy").alias("energy"),
        "source_spectrum_id", pk.digests(F.col("observed_ms2_mzs"), F.col("observed_ms2_intensities")).alias("digests"))
    return purge(t, b)


def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values that evaluation splits share with train, by level."""
    t, e = _train(spark, sf_dir), table(spark, sf_dir, "external_spectra")
    keys = lambda df, c: df.select(F.explode(readable_keys(F.col(c))).alias("v"))
    levels = {
        "full key": (keys(t, "inchikey"), keys(e, "inchikey")),
        "first block": tuple(x.select(F.substring("v", 1, 14).alias("v")) for x in (keys(t, "inchikey"), keys(e, "inchikey"))),
        "notation": (t.select(F.trim("normalized_smiles").alias("v")).where("v != ''"), e.select(F.trim("canonical_smiles").alias("v")).where("v != ''")),
        "formula": (t.select(F.col("molecular_formula").alias("v")), e.select(F.col("formula").alias("v"))),
    }
    parts = [
        a.where("v IS NOT NULL").intersect(b.where("v IS NOT NULL")).agg(F.count(F.lit(1)).alias("n_shared")).select(F.lit(level).alias("level"), "n_shared")
        for level, (a, b) in levels.items()
    ]
    out = parts[0]
    for p in [*parts[1:], _shared_spectra(t, e)]:
        out = out.unionByName(p)
    return out


def _shared_spectra(t: DataFrame, e: DataFrame) -> DataFrame:
    """The level of spectra: those of the evaluation splits with a cosine of at least 0.999 to one of train, whatever their keys."""
    vectors = lambda df, mz, i: whole_vectors(df.select("spectrum_id", pk.peaks(F.col(mz), F.col(i)).alias("ps")), "spectrum_id", "ps").withColumn("digest", F.md5(F.to_json("vec")))
    of_train, held_out = vectors(t, "ms2_mzs", "ms2_intensities"), vectors(e, "peaks_mz", "peaks_intensity")
    once = lambda df: df.select("digest", "vec").dropDuplicates(["digest"])
    found = near_identical(once(held_out), once(of_train)).select(F.col("digest_a").alias("digest")).distinct()
    return held_out.join(found, "digest", "left_semi").agg(F.count(F.lit(1)).alias("n_shared")).select(F.lit("spectrum").alias("level"), "n_shared")


def molecule_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible molecule-disjoint split of train by a digest of the key, counted per fold."""
    t = _train(spark, sf_dir).select("spectrum_id", single_key(F.col("inchikey")).alias("inchikey")).where("inchikey IS NOT NULL")
    return hash_split(t, "inchikey", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n_spectra"), F.countDistinct("inchikey").alias("n_keys"))


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows of one key, with ``held`` for the tenth of the molecules of at least two spectra that a digest of the key draws."""
    t = _train(spark, sf_dir).select("spectrum_id", single_key(F.col("inchikey")).alias("inchikey")).where("inchikey IS NOT NULL")
    several = t.groupBy("inchikey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("inchikey")
    held = hash_split(several, "inchikey", 10).where("fold = 0").select("inchikey", F.lit(True).alias("held"))
    return skew_join(t, held, "inchikey").withColumn("held", F.coalesce("held", F.lit(False)))


def validation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query spectrum of each held-out molecule, drawn by a digest of its id, and whether it's for tuning or frozen (one in five)."""
    drawn = F.struct(F.md5(F.col("spectrum_id").cast("string")), "spectrum_id")
    q = _held_out(spark, sf_dir).where("held").groupBy("inchikey").agg(F.min_by("spectrum_id", drawn).alias("spectrum_id"))
    part = F.when(F.conv(F.substring(F.md5("inchikey"), 8, 7), 16, 10).cast("long") % 5 == 0, "frozen").otherwise("tuning")
    return q.select("inchikey", "spectrum_id", part.alias("part"))


def protocol_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library that each protocol leaves to search: A without the query spectra, B without the held-out molecules, C without their first blocks."""
    t = _held_out(spark, sf_dir)
    queries = validation_queries(spark, sf_dir).select("spectrum_id")
    blocks = t.where("held").select(F.substring("inchikey", 1, 14).alias("block")).distinct()
    libraries = {
        "A": t.join(queries, "spectrum_id", "left_anti"),
        "B": t.where("NOT held"),
        "C": t.withColumn("block", F.substring("inchikey", 1, 14)).join(blocks, "block", "left_anti"),
    }
    out = None
    for name, lib in libraries.items():
        per = lib.groupBy("inchikey").agg(F.count(F.lit(1)).alias("n"))  # a hot molecule is counted first
        part = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_spectra"), F.count(F.lit(1)).alias("n_molecules")).select(F.lit(name).alias("protocol"), "n_spectra", "n_molecules")
        out = part if out is None else out.unionByName(part)
    return out


def session_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: spectra, and those ingested before they were acquired."""
    t = _train(spark, sf_dir).where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ingested_at") < F.col("acquired_at")).alias("n_early"))
    s = table(spark, sf_dir, "sessions").select("session_id", "ingest_lib", F.col("finished_at").isNull().alias("open_end"))
    return s.join(t, "session_id", "left").select("session_id", "ingest_lib", "open_end", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_early", F.lit(0)).alias("n_early"))


QUERIES = {
    f.__name__: f
    for f in (
        neutral_mass, adduct_dimension, formula_features, catalog_mass_error, settings, peak_profiles, peak_variants, isotope_free,
        spectral_entropy, entropy_weighted, coarse_bins, merged_peaks, best_per_energy, richest_spectrum, molecules,
        catalog_sources, purged_library, leakage_audit, molecule_split, validation_queries, protocol_libraries, session_delays,
    )
}

_KEYS = r"list_distinct(regexp_extract_all(upper({0}), '\b([A-Z]{{14}}-[A-Z]{{10}}-[A-Z])\b', 1))"
_TRAIN = f"""
WITH t0 AS (SELECT *, {_KEYS.format("inchikey")} AS ks FROM train),
t AS (SELECT * EXCLUDE (inchikey, adduct, ionization_mode, collision_energy), CASE WHEN len(ks) = 1 THEN ks[1] END AS inchikey,
 CASE WHEN regexp_full_match(regexp_replace(adduct, '\\s', '', 'g'), '\\[[^\\[\\]?]+\\][0-9]*[+-]') THEN regexp_replace(adduct, '\\s', '', 'g') END AS adduct,
 CASE WHEN lower(trim(ionization_mode, E' \\t')) IN ('p', 'pos', 'positive') THEN 'positive'
      WHEN lower(trim(ionization_mode, E' \\t')) IN ('n', 'neg', 'negative') THEN 'negative' END AS mode,
 CASE WHEN collision_energy > 0 AND collision_energy <= 200 THEN collision_energy END AS energy FROM t0)
"""
_PEAKS = """
WITH ok AS (SELECT spectrum_id, precursor_mz, ms2_mzs, ms2_intensities FROM train WHERE len(ms2_mzs) = len(ms2_intensities) AND len(ms2_mzs) > 0),
p AS (SELECT spectrum_id, precursor_mz, unnest(ms2_mzs) AS mz, unnest(ms2_intensities) AS i FROM ok),
n AS (SELECT *, i / max(i) OVER (PARTITION BY spectrum_id) AS r FROM p)
"""
_FORMULA = """
WITH f AS (SELECT candidate_id, formula, exact_mass, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 1)) AS e,
  unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 2)) AS k FROM candidates WHERE formula IS NOT NULL),
g AS (SELECT candidate_id, exact_mass, e, sum(CASE WHEN k = '' THEN 1 ELSE k::INT END)::INT AS n FROM f GROUP BY ALL),
m(e, w) AS (VALUES ('H', 1.00782503223e0), ('C', 12e0), ('N', 14.00307400443e0), ('O', 15.99491461957e0), ('F', 18.99840316273e0),
 ('P', 30.97376199842e0), ('S', 31.9720711744e0), ('Cl', 34.968852682e0), ('Br', 78.9183376e0), ('I', 126.9044719e0)),
s AS (SELECT candidate_id, exact_mass, sum(n * w) AS mass, coalesce(sum(n) FILTER (e = 'C'), 0) AS c, coalesce(sum(n) FILTER (e = 'H'), 0) AS h,
 coalesce(sum(n) FILTER (e = 'N'), 0) AS nn, coalesce(sum(n) FILTER (e = 'O'), 0) AS o, coalesce(sum(n) FILTER (e = 'P'), 0) AS p,
 coalesce(sum(n) FILTER (e = 'S'), 0) AS s, coalesce(sum(n) FILTER (e IN ('F', 'Cl', 'Br', 'I')), 0) AS x,
 string_agg(e || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY CASE e WHEN 'C' THEN 0 WHEN 'H' THEN 1 ELSE 2 END, e) AS hill
 FROM g JOIN m USING (e) GROUP BY ALL)
"""
_HELD = ", hk AS (SELECT inchikey FROM t WHERE inchikey IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND ('0x' || left(md5(inchikey), 7))::BIGINT % 10 = 0) "
_BIN = "CASE WHEN energy IS NULL THEN -9999 ELSE round_even(energy / 5, 0)::INT END"

SQL = {
    "neutral_mass": _TRAIN
    + """SELECT spectrum_id, adduct, round((charge * precursor_mz + sgn * charge * 0.00054858e0 - adds + losses) / n_m, 4) AS neutral_mass FROM t JOIN adducts USING (adduct)""",
    "adduct_dimension": _TRAIN
    + "SELECT adduct, n_m, round(adds, 4) AS adds, round(losses, 4) AS losses, charge, sgn FROM adducts WHERE adduct IN (SELECT adduct FROM t)",
    "formula_features": _FORMULA
    + """SELECT candidate_id, round(mass, 5) AS mass, c + 1 - h / 2.0e0 + nn / 2.0e0 + p / 2.0e0 - x / 2.0e0 AS rdbe, hill,
 CASE WHEN c <= 0 THEN 'no carbon' WHEN (h + nn + p + x) % 2 <> 0 THEN 'odd valence sum'
  WHEN c * 4 + h + nn * 5 + o * 2 + p * 5 + s * 6 + x < 2 * (CASE WHEN s > 0 THEN 6 WHEN p > 0 OR nn > 0 THEN 5 ELSE 4 END) THEN 'valence sum too low'
  WHEN c + 1 - h / 2.0 + nn / 2.0 + p / 2.0 - x / 2.0 < -0.5 THEN 'negative unsaturation'
  WHEN c + 1 - h / 2.0 + nn / 2.0 + p / 2.0 - x / 2.0 > 40 THEN 'excessive unsaturation'
  WHEN h / c < 0.1 OR h / c > 3.2 THEN 'H/C' WHEN nn / c > 1.5 THEN 'N/C' WHEN o / c > 1.5 THEN 'O/C' WHEN p / c > 0.4 THEN 'P/C'
  WHEN s / c > 0.8 THEN 'S/C' WHEN x / c > 1.5 THEN 'halogen/C' ELSE 'valid' END AS verdict FROM s""",
    "catalog_mass_error": _FORMULA
    + "SELECT candidate_id, round(abs(exact_mass - mass) / mass * 1e6, 2) AS ppm FROM s WHERE exact_mass IS NOT NULL",
    "settings": _TRAIN
    + f"""SELECT CASE WHEN lower(instrument_type) LIKE '%timstof%' THEN 'timsTOF'
 WHEN regexp_matches(lower(instrument_type), 'orbitrap|qft|ftms|hybrid ft|itft|exactive') THEN 'Orbitrap'
 WHEN lower(instrument_type) LIKE '%tof%' THEN 'QTOF' WHEN regexp_matches(lower(instrument_type), 'trap|qq') THEN 'IT' ELSE 'other' END AS family,
 CASE mode WHEN 'negative' THEN -1 WHEN 'positive' THEN 1 ELSE 0 END AS polarity, {_BIN} AS energy_bin, count(*) AS n FROM t GROUP BY ALL""",
    "peak_profiles": _PEAKS
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY i DESC, mz) AS k FROM n), q(profile, least, drop_precursor) AS
 (VALUES ('A', 0.0, false), ('B', 0.01, false), ('C', 0.01, true)),
 j0 AS (SELECT o.spectrum_id, q.profile, a.r, a.mz, a.mz IS NOT NULL AND a.k <= 100 AND a.r >= q.least AND NOT (q.drop_precursor AND abs(a.mz - coalesce(a.precursor_mz, -10)) <= 0.5) AS kept
   FROM ok o CROSS JOIN q JOIN a USING (spectrum_id)),
 c AS (SELECT * FROM j0 WHERE profile = 'C' AND kept),
 j AS (SELECT spectrum_id, profile, r, kept FROM j0 UNION ALL SELECT spectrum_id, 'D', r, kept AND NOT EXISTS (SELECT 1 FROM c WHERE c.spectrum_id = x.spectrum_id
   AND abs(x.mz - c.mz - 1.003355) <= 0.015 AND x.r < 0.9 * c.r) FROM j0 x WHERE profile = 'C')
 SELECT spectrum_id, profile, count(*) FILTER (kept)::INT AS n_peaks, round(coalesce(sum(r) FILTER (kept), 0), 5) AS intensity FROM j GROUP BY ALL""",
    "peak_variants": _PEAKS
    + """, q(variant, least, drop_precursor, drop_isotopes) AS (VALUES ('1A', 0.0, false, false), ('1B', 0.01, false, false), ('1C', 0.01, true, false), ('1D', 0.01, true, true)),
 a AS (SELECT n.spectrum_id, variant, mz, r, drop_isotopes FROM n CROSS JOIN q WHERE r >= least AND NOT (drop_precursor AND abs(mz - coalesce(precursor_mz, -10)) <= 0.5)),
 b AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id, variant ORDER BY r DESC, mz) AS k FROM a x WHERE NOT drop_isotopes OR NOT EXISTS (SELECT 1 FROM a y
   WHERE y.spectrum_id = x.spectrum_id AND y.variant = x.variant AND abs(x.mz - 1.00335 - y.mz) <= 0.005 AND x.r <= y.r))
 SELECT o.spectrum_id, q.variant, count(b.mz)::INT AS n_peaks, round(coalesce(sum(r), 0), 5) AS intensity FROM ok o CROSS JOIN q
 LEFT JOIN b ON b.spectrum_id = o.spectrum_id AND b.variant = q.variant AND k <= 100 GROUP BY ALL""",
    "isotope_free": _PEAKS
    + """SELECT a.spectrum_id, count(*)::INT AS n_peaks FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.spectrum_id = a.spectrum_id
 AND abs(a.mz - b.mz - 1.003355) <= 0.015 AND a.i < 0.9 * b.i) GROUP BY 1""",
    "spectral_entropy": _PEAKS
    + """, s AS (SELECT spectrum_id, i / sum(i) OVER (PARTITION BY spectrum_id) AS q FROM p) SELECT spectrum_id, round(-sum(q * ln(q)), 6) AS entropy FROM s GROUP BY 1""",
    "entropy_weighted": _PEAKS
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY i DESC, mz) AS rn FROM n WHERE r >= 0.002),
 s AS (SELECT *, i / sum(i) OVER (PARTITION BY spectrum_id) AS q FROM k WHERE rn <= 100),
 e AS (SELECT *, -sum(q * ln(q)) OVER (PARTITION BY spectrum_id) AS s FROM s),
 w AS (SELECT spectrum_id, CASE WHEN s < 3 THEN pow(q, 0.25 + 0.25 * s) ELSE q END AS w FROM e),
 v AS (SELECT spectrum_id, w / sum(w) OVER (PARTITION BY spectrum_id) AS v FROM w)
 SELECT spectrum_id, round(max(v), 6) AS top, round(-sum(v * ln(v)), 6) AS entropy FROM v GROUP BY 1""",
    "coarse_bins": _PEAKS
    + """SELECT spectrum_id, floor(mz - 20)::BIGINT AS bin, round(max(r), 6) AS highest, round(sum(r), 6) AS total FROM n
 WHERE floor(mz - 20) >= 0 AND floor(mz - 20) < 1480 GROUP BY 1, 2""",
    "merged_peaks": _PEAKS
    + """, g AS (SELECT spectrum_id, mz - lag(mz) OVER (PARTITION BY spectrum_id ORDER BY mz) AS gap FROM p)
 SELECT spectrum_id, count(*) FILTER (gap IS NULL OR gap >= 0.005) AS n_peaks FROM g GROUP BY 1""",
    "best_per_energy": _TRAIN
    + f"""SELECT spectrum_id, inchikey, num_peaks, energy_bin FROM (SELECT *, {_BIN} AS energy_bin,
 row_number() OVER (PARTITION BY inchikey, {_BIN} ORDER BY num_peaks DESC NULLS LAST, spectrum_id) AS rn FROM t WHERE inchikey IS NOT NULL) WHERE rn = 1""",
    "richest_spectrum": _TRAIN
    + """SELECT inchikey, spectrum_id, num_peaks FROM (SELECT *, row_number() OVER (PARTITION BY inchikey ORDER BY num_peaks DESC NULLS LAST, spectrum_id) AS rn
 FROM t WHERE inchikey IS NOT NULL) WHERE rn = 1""",
    "molecules": _TRAIN
    + """, c AS (SELECT inchikey, mode, count(*) AS n FROM t WHERE mode IS NOT NULL GROUP BY ALL),
 m AS (SELECT inchikey, arg_max(mode, (n, mode)) AS mode FROM c GROUP BY 1)
 SELECT inchikey, round(quantile_cont(precursor_mz, 0.5), 5) AS median_precursor, any_value(m.mode) AS mode, count(*) AS n_spectra
 FROM t LEFT JOIN m USING (inchikey) WHERE inchikey IS NOT NULL GROUP BY inchikey""",
    "catalog_sources": f"""WITH u AS (SELECT inchikey, unnest(source) AS source FROM candidates UNION SELECT unnest({_KEYS.format("inchikey")}), 'TRAIN' FROM train
 UNION SELECT unnest({_KEYS.format("inchikey")}), source_library FROM external_spectra)
 SELECT inchikey, count(*) AS n_sources, string_agg(source, ',' ORDER BY source) AS sources FROM u GROUP BY 1""",
    "purged_library": _TRAIN
    + """SELECT spectrum_id, inchikey, energy FROM t WHERE inchikey IS NULL OR (
 inchikey NOT IN (SELECT true_inchikey FROM benchmark_queries WHERE query_group IN ('C2', 'C3') AND true_inchikey IS NOT NULL)
 AND NOT EXISTS (SELECT 1 FROM benchmark_queries b WHERE b.query_group = 'C1' AND b.true_inchikey = t.inchikey AND abs(b.observed_collision_energy - t.energy) <= 5))""".replace(
        "FROM t WHERE inchikey IS NULL OR (", """FROM t WHERE spectrum_id NOT IN (SELECT source_spectrum_id FROM benchmark_queries WHERE query_group = 'C1' AND source_spectrum_id IS NOT NULL) AND (inchikey IS NULL OR (
 NOT EXISTS (SELECT 1 FROM benchmark_queries b WHERE b.query_group = 'C1' AND b.true_inchikey = t.inchikey AND len(t.ms2_mzs) > 0
  AND list_transform(list_sort(b.observed_ms2_mzs), lambda x: printf('%.3f', x)) = list_transform(list_sort(t.ms2_mzs), lambda x: printf('%.3f', x))) AND""") + ")",
    "leakage_audit": f"""WITH tk AS (SELECT DISTINCT unnest({_KEYS.format("inchikey")}) AS v FROM train), ek AS (SELECT DISTINCT unnest({_KEYS.format("inchikey")}) AS v FROM external_spectra),
 tb AS (SELECT id, floor(mz)::BIGINT AS bin, sum(i) AS v FROM (SELECT spectrum_id AS id, unnest(ms2_mzs) AS mz, unnest(ms2_intensities) AS i FROM train WHERE len(ms2_mzs) = len(ms2_intensities)) GROUP BY 1, 2),
 eb AS (SELECT id, floor(mz)::BIGINT AS bin, sum(i)::DOUBLE AS v FROM (SELECT spectrum_id AS id, unnest(peaks_mz)::DOUBLE AS mz, unnest(peaks_intensity)::DOUBLE AS i FROM external_spectra WHERE len(peaks_mz) = len(peaks_intensity)) GROUP BY 1, 2),
 tn AS (SELECT id, sqrt(sum(v * v)) AS n FROM tb GROUP BY 1), en AS (SELECT id, sqrt(sum(v * v)) AS n FROM eb GROUP BY 1)
 SELECT 'full key' AS level, (SELECT count(*) FROM (SELECT v FROM tk INTERSECT SELECT v FROM ek)) AS n_shared
 UNION ALL SELECT 'first block', (SELECT count(*) FROM (SELECT left(v, 14) FROM tk INTERSECT SELECT left(v, 14) FROM ek))
 UNION ALL SELECT 'notation', (SELECT count(*) FROM (SELECT trim(normalized_smiles) AS v FROM train WHERE trim(normalized_smiles) <> '' INTERSECT SELECT trim(canonical_smiles) FROM external_spectra))
 UNION ALL SELECT 'formula', (SELECT count(*) FROM (SELECT molecular_formula AS v FROM train WHERE molecular_formula IS NOT NULL INTERSECT SELECT formula FROM external_spectra))
 UNION ALL SELECT 'spectrum', (SELECT count(DISTINCT e) FROM (SELECT a.id AS e, b.id AS t FROM eb a JOIN tb b USING (bin) JOIN en ON en.id = a.id JOIN tn ON tn.id = b.id GROUP BY a.id, b.id, en.n, tn.n
  HAVING round(sum(a.v * b.v) / (en.n * tn.n), 6) >= 0.999))""",
    "molecule_split": _TRAIN
    + """SELECT (('0x' || left(md5(inchikey), 7))::INT % 5)::BIGINT AS fold, count(*) AS n_spectra, count(DISTINCT inchikey) AS n_keys FROM t WHERE inchikey IS NOT NULL GROUP BY 1""",
    "validation_queries": _TRAIN
    + _HELD
    + """SELECT inchikey, arg_min(spectrum_id, (md5(spectrum_id::VARCHAR), spectrum_id)) AS spectrum_id, CASE WHEN ('0x' || substr(md5(inchikey), 8, 7))::BIGINT % 5 = 0 THEN 'frozen' ELSE 'tuning' END AS part
 FROM t JOIN hk USING (inchikey) GROUP BY inchikey""",
    "protocol_libraries": _TRAIN
    + _HELD
    + """SELECT 'A' AS protocol, count(*) AS n_spectra, count(DISTINCT inchikey) AS n_molecules FROM t WHERE inchikey IS NOT NULL
  AND spectrum_id NOT IN (SELECT arg_min(spectrum_id, (md5(spectrum_id::VARCHAR), spectrum_id)) FROM t JOIN hk USING (inchikey) GROUP BY inchikey)
 UNION ALL SELECT 'B', count(*), count(DISTINCT inchikey) FROM t WHERE inchikey IS NOT NULL AND inchikey NOT IN (SELECT inchikey FROM hk)
 UNION ALL SELECT 'C', count(*), count(DISTINCT inchikey) FROM t WHERE inchikey IS NOT NULL AND left(inchikey, 14) NOT IN (SELECT left(inchikey, 14) FROM hk)""",
    "session_delays": """SELECT s.session_id, s.ingest_lib, s.finished_at IS NULL AS open_end, count(t.spectrum_id) AS n, count(*) FILTER (t.ingested_at < t.acquired_at) AS n_early
 FROM sessions s LEFT JOIN train t USING (session_id) GROUP BY ALL""",
}
