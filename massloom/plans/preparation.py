"""Queries that prepare data: eligible and cleaned spectra, feature vectors, cohorts with their gate, and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from massloom.functions import chem, peaks as pk
from massloom.functions.keys import readable_keys, single_key
from massloom.functions.settings import known_adduct, known_energy
from massloom.operators import bandjoin as bj
from massloom.plans import identification as ident
from massloom.sources.tables import table

# What is taken off where no adduct can be read, the shift of the instrument, bounds of eligible spectra.
PLAIN_LOSS, SHIFT_PPM, PRECURSORS, LEAST_PEAKS, TRUE_WITHIN, LEAST_POOL, LEAST_RECALL = 1.007825, 1.4, (30.0, 2000.0), 3, 0.05, 5, 0.99
# The layout of the feature vector: bins of 1 Da, then precursor (in 1000), mode and energy (in 100; 30 if unknown).
FEATURE_META, UNKNOWN_ENERGY = pk.COARSE_BINS, 30.0
COHORT_SHARES = 20  # a key's digest modulo this: 0 and 1 may be C1, 2 and 3 are C2, 4 is validation


def observed_mass(spectra: DataFrame, adducts: DataFrame, precursor: str = "precursor_mz", adduct: str = "adduct") -> DataFrame:
    """Adds ``mass`` and ``mass_by`` (``adduct`` or ``precursor``): the neutral mass, or the precursor less a proton where no adduct is read.

    Null where neither gives a positive mass. ``adducts`` has nine rows.
    """
    dim = adducts.select(F.col("adduct").alias("om_adduct"), "n_m", "adds", "losses", "charge", F.col("sgn").alias("om_sgn"))
    j = spectra.withColumn("om_adduct", known_adduct(F.col(adduct))).join(F.broadcast(dim), "om_adduct", "left")
    read = chem.neutral_mass(F.col(precursor), *(F.col(c) for c in ("n_m", "adds", "losses", "charge", "om_sgn")))
    plain = F.when(F.col(precursor) > PLAIN_LOSS, F.col(precursor) - PLAIN_LOSS)
    by = F.when(read.isNotNull(), "adduct").when(plain.isNotNull(), "precursor")
    return j.withColumns({"mass": F.coalesce(read, plain), "mass_by": by}).drop("om_adduct", "n_m", "adds", "losses", "charge", "om_sgn")


def _train_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "train").select(
        "spectrum_id", single_key(F.col("inchikey")).alias("inchikey"), "precursor_mz", "adduct", known_energy(F.col("collision_energy")).alias("energy"),
        F.coalesce(F.size(pk.peaks(F.col("ms2_mzs"), F.col("ms2_intensities"))), F.lit(0)).alias("n_peaks"))
    t = observed_mass(t, table(spark, sf_dir, "adducts"))
    return t.withColumn("eligible", F.coalesce(F.col("precursor_mz").between(*PRECURSORS), F.lit(False)) & (F.col("n_peaks") >= LEAST_PEAKS))


def eligible_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spectrum of train with its mass, where that comes from, the mass less the shift of the instrument, and whether it is eligible."""
    shifted = F.col("mass") * (1 - SHIFT_PPM / 1e6)
    return _train_masses(spark, sf_dir).select("spectrum_id", F.round("mass", 4).alias("mass"), "mass_by", F.round(shifted, 4).alias("shifted"), "eligible")


def clean_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation spectra cleaned for a library: peaks left and their summed intensity; null where fewer than three are left."""
    e = table(spark, sf_dir, "external_spectra").select("spectrum_id", pk.cleaned(pk.peaks(F.col("peaks_mz"), F.col("peaks_intensity"))).alias("ps"))
    total = F.aggregate("ps", F.lit(0.0), lambda a, p: a + p["i"])
    return e.select("spectrum_id", F.when(F.col("ps").isNotNull(), F.size("ps")).alias("n_peaks"), F.round(total, 5).alias("total"))


def spectrum_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vector of every usable spectrum of train, as rows: 1,480 bins at unit length (those above 0), then three settings."""
    ps = pk.peaks(F.col("ms2_mzs"), F.col("ms2_intensities"))
    t = table(spark, sf_dir, "train").where(F.size(ps) > 0).select("spectrum_id", "precursor_mz", known_adduct(F.col("adduct")).alias("adduct"), known_energy(F.col("collision_energy")).alias("energy"), ps.alias("ps"))
    bins = t.select("spectrum_id", "ps").repartition("spectrum_id").select("spectrum_id", F.explode("ps").alias("p"))
    bins = bins.select("spectrum_id", pk.coarse_bin(F.col("p.mz")).alias("index"), "p.i").where("index IS NOT NULL")
    bins = bins.groupBy("spectrum_id", "index").agg(F.sum("i").alias("v"))
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("spectrum_id")))
    bins = bins.withColumn("value", F.when(length > 0, F.col("v") / length)).where("value > 0")
    mode = F.when(F.col("adduct").rlike(r"\d*-$"), 0.0).otherwise(1.0)
    settings = F.array(F.col("precursor_mz") / 1000, mode, F.coalesce("energy", F.lit(UNKNOWN_ENERGY)) / 100)
    meta = t.select("spectrum_id", F.posexplode(settings).alias("at", "value")).select("spectrum_id", (F.col("at") + FEATURE_META).cast("long").alias("index"), "value")
    return bins.select("spectrum_id", "index", "value").unionByName(meta).select("spectrum_id", "index", F.round("value", 8).alias("value"))


def _digest(c: str, offset: int = 1) -> Column:
    return F.conv(F.substring(F.md5(c), offset, 7), 16, 10).cast("long")


def _cohort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cohort``, ``inchikey``, ``query_spectrum``, ``mass``, ``precursor``: one query spectrum per key of C1, C2, C3 and validation."""
    known = ident.catalog(spark, sf_dir).select("inchikey", "exact_mass")
    t = _train_masses(spark, sf_dir).where("eligible AND inchikey IS NOT NULL AND mass_by = 'adduct'").join(known, "inchikey")
    t = t.where(F.abs(F.col("mass") - F.col("exact_mass")) <= TRUE_WITHIN).withColumn("drawn", F.struct(F.md5(F.col("spectrum_id").cast("string")), "spectrum_id"))
    # One aggregate per key: a hot key moves as one partial row per task.
    row = F.min_by(F.struct(F.col("spectrum_id").cast("string").alias("query_spectrum"), "energy", "mass", F.col("precursor_mz").alias("precursor")), "drawn").alias("q")
    keys = t.groupBy("inchikey").agg(F.count(F.lit(1)).alias("n"), F.min("energy").alias("lo"), F.max("energy").alias("hi"), row)
    apart = F.greatest(F.col("hi") - F.col("q.energy"), F.col("q.energy") - F.col("lo")) > 5
    sibling = F.coalesce(apart, F.lit(False)) | (F.col("q.energy").isNull() & (F.col("n") >= 2))
    part = _digest("inchikey") % COHORT_SHARES
    cohort = F.when((part <= 1) & sibling, "C1").when(part.between(2, 3), "C2").when(part == 4, "validation")
    own = keys.select(cohort.alias("cohort"), "inchikey", "q.query_spectrum", "q.mass", "q.precursor").where("cohort IS NOT NULL")

    block = F.substring("inchikey", 1, 14).alias("block")
    seen = table(spark, sf_dir, "train").select(F.explode(readable_keys(F.col("inchikey"))).alias("inchikey")).select(block).distinct()
    e = table(spark, sf_dir, "external_spectra").where(F.size(pk.peaks(F.col("peaks_mz"), F.col("peaks_intensity"))) > 0)
    e = e.select(F.col("spectrum_id").alias("query_spectrum"), single_key(F.col("inchikey")).alias("inchikey"), "precursor_mz", F.col("precursor_type").alias("adduct"))
    e = observed_mass(e.where("inchikey IS NOT NULL"), table(spark, sf_dir, "adducts")).withColumn("block", block)
    e = e.join(known, "inchikey").where(F.abs(F.col("mass") - F.col("exact_mass")) <= TRUE_WITHIN).join(seen, "block", "left_anti")
    drawn = F.struct(F.md5("query_spectrum"), "query_spectrum")
    new = e.groupBy("inchikey").agg(F.min_by(F.struct("query_spectrum", "mass", F.col("precursor_mz").alias("precursor")), drawn).alias("q"))
    new = new.select(F.lit("C3").alias("cohort"), "inchikey", "q.*")
    sized = _pools(new, spark, sf_dir).where((F.col("pool") >= LEAST_POOL) & (F.col("hit") == 1)).select("query_spectrum")
    return own.unionByName(new.join(sized, "query_spectrum", "left_semi"))


def _pools(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_spectrum``, ``pool``, ``hit``: candidates in the union of windows, and whether the truth is among them."""
    c = ident.catalog(spark, sf_dir).select(F.col("inchikey").alias("cand_key"), "exact_mass")
    pairs = bj.band_join(rows, bj.union_windows(F.col("mass"), F.col("precursor")), c, "exact_mass")
    return pairs.groupBy("query_spectrum").agg(F.count(F.lit(1)).alias("pool"), F.max((F.col("inchikey") == F.col("cand_key")).cast("int")).alias("hit"))


def benchmark_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark drawn by digests: C1 (the molecule has a spectrum at another energy in train), C2 (withheld wholly), C3 (evaluation
    spectra of molecules whose first block train doesn't know) and validation, one query spectrum per molecule.

    Queries are of molecules of the catalog whose mass is met within 0.05; those of C3 have at least five candidates and the truth among them.
    """
    return _cohort_rows(spark, sf_dir).select("cohort", "inchikey", "query_spectrum")


def cohort_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cohort: queries, keys that another cohort has too, recall of the truth by mass, and whether it passes (0.99 and nothing shared)."""
    rows = _cohort_rows(spark, sf_dir)
    shared = rows.groupBy("inchikey").agg(F.countDistinct("cohort").alias("k")).where("k > 1").select("inchikey", F.lit(1).alias("shared"))
    per = rows.join(_pools(rows, spark, sf_dir), "query_spectrum", "left").join(shared, "inchikey", "left")
    recall = F.avg(F.coalesce("hit", F.lit(0)))
    n_shared = F.count("shared")
    return per.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), n_shared.alias("n_shared"), F.round(recall, 6).alias("recall"), ((recall >= LEAST_RECALL) & (n_shared == 0)).alias("passes")
    )


def stratified(df: DataFrame, stratum: str, key: str, folds: int = 5) -> DataFrame:
    """Adds ``fold``: rows of each stratum dealt in turn, in the order of the digest of ``key`` (unique), so folds differ by one row at most.

    Rows are numbered within 256 parts of a stratum and parts by their counts, so no stratum is sorted in one task. A null stratum is one of its own.
    """
    d = df.withColumn("st_digest", F.md5(F.col(key).cast("string"))).withColumn("st_part", F.substring("st_digest", 1, 2))
    counts = d.groupBy(stratum, "st_part").agg(F.count(F.lit(1)).alias("st_n"))
    before = F.coalesce(F.sum("st_n").over(W.partitionBy(stratum).orderBy("st_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(stratum).alias("st_s"), F.col("st_part").alias("st_p"), before.alias("st_before"))
    place = F.row_number().over(W.partitionBy(stratum, "st_part").orderBy("st_digest", key)) - 1
    numbered = d.withColumn("st_place", place).join(offsets, F.col(stratum).eqNullSafe(F.col("st_s")) & (F.col("st_part") == F.col("st_p")))
    return numbered.withColumn("fold", F.pmod(F.col("st_place") + F.col("st_before"), F.lit(folds)).cast("int")).drop(
        "st_digest", "st_part", "st_s", "st_p", "st_before", "st_place"
    )


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of the benchmark queries, alike in every cohort."""
    q = table(spark, sf_dir, "benchmark_queries").select("query_id", "query_group")
    return stratified(q, "query_group", "query_id").select("query_id", "query_group", "fold")


QUERIES = {f.__name__: f for f in (eligible_spectra, clean_external, spectrum_features, benchmark_cohorts, cohort_gate, stratified_folds)}

_KEY = r"list_distinct(regexp_extract_all(upper(inchikey), '\b([A-Z]{14}-[A-Z]{10}-[A-Z])\b', 1))"
_MASSES = (
    ident._Q
    + f"""em AS (SELECT spectrum_id, ks[1] AS inchikey, len(ks) AS nk, precursor_mz, CASE WHEN collision_energy > 0 AND collision_energy <= 200 THEN collision_energy END AS energy,
 (a.charge * precursor_mz + a.sgn * a.charge * 0.00054858e0 - a.adds + a.losses) / a.n_m AS am, CASE WHEN precursor_mz > 1.007825e0 THEN precursor_mz - 1.007825e0 END AS pm,
 coalesce(precursor_mz BETWEEN 30 AND 2000, false) AND coalesce(len(ms2_mzs) = len(ms2_intensities) AND len(ms2_mzs) >= 3, false) AS eligible FROM t0 LEFT JOIN adducts a ON t0.ad = a.adduct),
ms AS (SELECT *, CASE WHEN am > 0 THEN am ELSE pm END AS mass, CASE WHEN am > 0 THEN 'adduct' WHEN pm IS NOT NULL THEN 'precursor' END AS mass_by FROM em),
dr AS (SELECT ms.inchikey, spectrum_id, energy, ms.mass, precursor_mz FROM ms JOIN c ON c.inchikey = ms.inchikey WHERE eligible AND nk = 1 AND mass_by = 'adduct' AND abs(ms.mass - c.mass) <= 0.05),
kk AS (SELECT inchikey, count(*) AS n, min(energy) AS lo, max(energy) AS hi FROM dr GROUP BY 1),
kq AS (SELECT dr.*, n, lo, hi, ('0x' || left(md5(inchikey), 7))::BIGINT % 20 AS part FROM dr JOIN kk USING (inchikey) QUALIFY row_number() OVER (PARTITION BY inchikey ORDER BY md5(spectrum_id::VARCHAR), spectrum_id) = 1),
own AS (SELECT CASE WHEN part <= 1 AND (coalesce(greatest(hi - energy, energy - lo) > 5, false) OR energy IS NULL AND n >= 2) THEN 'C1' WHEN part BETWEEN 2 AND 3 THEN 'C2' WHEN part = 4 THEN 'validation' END AS cohort,
 inchikey, spectrum_id::VARCHAR AS query_spectrum, mass, precursor_mz AS precursor FROM kq),
seen AS (SELECT DISTINCT left(k, 14) AS block FROM (SELECT unnest(ks) AS k FROM t0)),
ex0 AS (SELECT spectrum_id AS query_spectrum, {_KEY} AS ks, precursor_mz AS precursor, regexp_replace(precursor_type, '\\s', '', 'g') AS ad FROM external_spectra WHERE len(peaks_mz) = len(peaks_intensity) AND len(peaks_mz) > 0),
ex1 AS (SELECT query_spectrum, ks[1] AS inchikey, precursor, (a.charge * precursor + a.sgn * a.charge * 0.00054858e0 - a.adds + a.losses) / a.n_m AS am,
 CASE WHEN precursor > 1.007825e0 THEN precursor - 1.007825e0 END AS pm FROM ex0 LEFT JOIN adducts a ON ex0.ad = a.adduct WHERE len(ks) = 1),
ex2 AS (SELECT query_spectrum, ex1.inchikey, precursor, CASE WHEN am > 0 THEN am ELSE pm END AS mass FROM ex1 JOIN c ON c.inchikey = ex1.inchikey
 WHERE abs(CASE WHEN am > 0 THEN am ELSE pm END - c.mass) <= 0.05 AND left(ex1.inchikey, 14) NOT IN (SELECT block FROM seen)
 QUALIFY row_number() OVER (PARTITION BY ex1.inchikey ORDER BY md5(query_spectrum), query_spectrum) = 1),
al AS (SELECT * FROM own WHERE cohort IS NOT NULL UNION ALL SELECT 'C3', inchikey, query_spectrum, mass, precursor FROM ex2),
po AS (SELECT query_spectrum, count(*) AS pool, max((al.inchikey = c.inchikey)::INT) AS hit FROM al JOIN c ON
 c.mass BETWEEN al.mass * (1 - 100.0e0 / 1e6) AND al.mass * (1 + 100.0e0 / 1e6)
 OR c.mass BETWEEN (al.mass + 1.003354835e0) * (1 - 30.0e0 / 1e6) AND (al.mass + 1.003354835e0) * (1 + 30.0e0 / 1e6)
 OR al.mass > 1.003354835e0 AND c.mass BETWEEN (al.mass - 1.003354835e0) * (1 - 30.0e0 / 1e6) AND (al.mass - 1.003354835e0) * (1 + 30.0e0 / 1e6)
 OR abs(precursor - round(precursor)) <= 0.01e0 AND c.mass BETWEEN al.mass - 0.5e0 AND al.mass + 0.5e0 GROUP BY 1),
co AS (SELECT al.*, hit FROM al LEFT JOIN po USING (query_spectrum) WHERE cohort <> 'C3' OR pool >= 5 AND hit = 1)
"""
)

SQL = {
    "eligible_spectra": _MASSES + "SELECT spectrum_id, round(mass, 4) AS mass, mass_by, round(mass * (1 - 1.4e0 / 1e6), 4) AS shifted, eligible FROM ms",
    "clean_external": """WITH ok AS (SELECT spectrum_id, peaks_mz, peaks_intensity FROM external_spectra WHERE len(peaks_mz) = len(peaks_intensity)),
 p AS (SELECT spectrum_id, mz::DOUBLE AS mz, i::DOUBLE AS i FROM (SELECT spectrum_id, unnest(peaks_mz) AS mz, unnest(peaks_intensity) AS i FROM ok)),
 n AS (SELECT spectrum_id, mz, i / max(i) OVER (PARTITION BY spectrum_id) AS r FROM p),
 k AS (SELECT * FROM n x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.spectrum_id = x.spectrum_id AND abs(x.mz - 1.00335 - y.mz) <= 0.005 AND x.r <= y.r)),
 s AS (SELECT spectrum_id, mz, sqrt(r) / sqrt(sum(r) OVER w) AS v, count(*) OVER w AS left_over, row_number() OVER (PARTITION BY spectrum_id ORDER BY r DESC, mz) AS place FROM k WINDOW w AS (PARTITION BY spectrum_id)),
 g AS (SELECT spectrum_id, count(*)::INT AS n_peaks, round(sum(v), 5) AS total FROM s WHERE left_over >= 3 AND place <= 60 GROUP BY 1)
 SELECT spectrum_id, n_peaks, total FROM external_spectra LEFT JOIN g USING (spectrum_id)""",
    "spectrum_features": r"""WITH ok AS (SELECT * FROM train WHERE len(ms2_mzs) = len(ms2_intensities) AND len(ms2_mzs) > 0),
 p AS (SELECT spectrum_id, unnest(ms2_mzs) AS mz, unnest(ms2_intensities) AS i FROM ok),
 b AS (SELECT spectrum_id, floor(mz - 20)::BIGINT AS index, sum(i) AS v FROM p WHERE mz >= 20 AND mz < 1500 GROUP BY 1, 2),
 u AS (SELECT spectrum_id, index, v / sqrt(sum(v * v) OVER (PARTITION BY spectrum_id)) AS value FROM b)
 SELECT spectrum_id, index, round(value, 8) AS value FROM u WHERE value > 0
 UNION ALL SELECT spectrum_id, 1480, round(precursor_mz / 1000, 8) FROM ok
 UNION ALL SELECT spectrum_id, 1481, CASE WHEN regexp_full_match(regexp_replace(adduct, '\s', '', 'g'), '\[[^\[\]?]+\][0-9]*-') THEN 0.0e0 ELSE 1.0e0 END FROM ok
 UNION ALL SELECT spectrum_id, 1482, round(CASE WHEN collision_energy > 0 AND collision_energy <= 200 THEN collision_energy ELSE 30.0e0 END / 100, 8) FROM ok""",
    "benchmark_cohorts": _MASSES + "SELECT cohort, inchikey, query_spectrum FROM co",
    "cohort_gate": _MASSES
    + """, sh AS (SELECT inchikey FROM co GROUP BY 1 HAVING count(DISTINCT cohort) > 1)
 SELECT cohort, count(*) AS n, count(sh.inchikey) AS n_shared, round(avg(coalesce(hit, 0)), 6) AS recall, avg(coalesce(hit, 0)) >= 0.99 AND count(sh.inchikey) = 0 AS passes FROM co LEFT JOIN sh USING (inchikey) GROUP BY 1""",
    "stratified_folds": """SELECT query_id, query_group, ((row_number() OVER (PARTITION BY query_group ORDER BY md5(query_id), query_id) - 1) % 5)::INT AS fold FROM benchmark_queries""",
}
