"""Queries of the identification pipeline: retrieval by mass, search by spectrum, fusion, ranking, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from massloom.functions import chem, peaks as pk
from massloom.functions.keys import single_key
from massloom.functions.settings import known_adduct, known_energy
from massloom.operators import bandjoin as bj, ranking as rk, similarity as sim
from massloom.session import durable_table
from massloom.sources.tables import table

HITS = 80


def queries_with_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark queries with their neutral mass, by the adduct table (nine rows)."""
    q = table(spark, sf_dir, "benchmark_queries").withColumn("adduct", known_adduct(F.col("observed_adduct")))
    q = q.join(table(spark, sf_dir, "adducts"), "adduct")
    mass = chem.neutral_mass(*(F.col(c) for c in ("observed_precursor_mz", "n_m", "adds", "losses", "charge", "sgn")))
    return q.select(
        "query_id", "query_group", "source_spectrum_id", "true_inchikey", F.col("observed_precursor_mz").alias("precursor"),
        F.col("observed_collision_energy").alias("energy"), "sgn", mass.alias("neutral_mass"),
        pk.peaks(F.col("observed_ms2_mzs"), F.col("observed_ms2_intensities")).alias("qps"),
    )


def masses(q: DataFrame) -> DataFrame:
    return q.select("query_id", "query_group", "true_inchikey", "precursor", "neutral_mass")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries with a mass: the recorded one, else that of the formula."""
    mass = F.coalesce("exact_mass", chem.formula_mass(F.col("formula")))
    c = table(spark, sf_dir, "candidates").withColumn("exact_mass", mass)
    return c.where("exact_mass > 0").select("candidate_id", "inchikey", "canonical_smiles", "exact_mass", "source", "fp")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train spectra with one key, a readable adduct and peaks, with their neutral mass."""
    t = table(spark, sf_dir, "train").where("size(ms2_mzs) > 0 AND size(ms2_mzs) = size(ms2_intensities)").select(
        "spectrum_id", single_key(F.col("inchikey")).alias("inchikey"), "precursor_mz", known_adduct(F.col("adduct")).alias("adduct"),
        known_energy(F.col("collision_energy")).alias("lib_energy"), pk.peaks(F.col("ms2_mzs"), F.col("ms2_intensities")).alias("ps"),
    ).where("inchikey IS NOT NULL")
    t = t.join(table(spark, sf_dir, "adducts").withColumnRenamed("sgn", "lib_sgn"), "adduct")
    mass = chem.neutral_mass(*(F.col(c) for c in ("precursor_mz", "n_m", "adds", "losses", "charge", "lib_sgn")))
    return t.select("spectrum_id", "inchikey", "lib_energy", "lib_sgn", "ps", mass.alias("lib_mass")).where("lib_mass IS NOT NULL")


def _union(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Pairs of queries and catalog entries in the union of windows; with the fingerprint if ``more`` names it."""
    q, c = masses(queries_with_mass(spark, sf_dir)), catalog(spark, sf_dir)
    pairs = bj.band_join(q, bj.union_windows(F.col("neutral_mass"), F.col("precursor")), c if "fp" in more else c.drop("fp"), "exact_mass")
    return pairs.withColumn("ppm", chem.ppm_error(F.col("exact_mass"), F.col("neutral_mass")))


def retrieval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in the union of the mass, isotope and whole-number windows."""
    return _union(spark, sf_dir).select("query_id", "candidate_id", F.round("ppm", 3).alias("ppm"))


def retrieval_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by tier of the mass deviation."""
    pairs = bj.tiered(masses(queries_with_mass(spark, sf_dir)), catalog(spark, sf_dir))
    return pairs.select("query_id", "candidate_id", "tier", "weight")


def retrieval_progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the first window that holds enough; where none does, also those an isotope step off, then the nearest by mass."""
    pairs = bj.progressive(masses(queries_with_mass(spark, sf_dir)), catalog(spark, sf_dir).select("candidate_id", "exact_mass"))
    return pairs.select("query_id", "candidate_id", "weight")


def retrieval_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates within 8.5 ppm, or within 30 ppm where there are none."""
    return bj.narrow_or_wide(masses(queries_with_mass(spark, sf_dir)), catalog(spark, sf_dir)).select("query_id", "candidate_id")


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of queries whose truth is retrieved, and pool sizes, by cohort and overall."""
    q = masses(queries_with_mass(spark, sf_dir)).select("query_id", "query_group")
    per = _union(spark, sf_dir).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("pool"), F.max((F.col("inchikey") == F.col("true_inchikey")).cast("int")).alias("hit")
    )
    every = q.join(per, "query_id", "left").withColumns({"pool": F.coalesce("pool", F.lit(0)), "hit": F.coalesce("hit", F.lit(0))})
    return every.rollup("query_group").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.expr("percentile(pool, 0.95)"), 4).alias("pool_p95")
    )


def _mass_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = -F.col("ppm") / 100.0 + rk.source_prior(F.col("source"))
    return _union(spark, sf_dir).withColumn("score", F.round(score, 6))


def top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best candidates of each query by mass and prior."""
    best = rk.top_k(_mass_scores(spark, sf_dir), "query_id", [F.desc("score"), F.asc("candidate_id")])
    return best.select("query_id", "candidate_id", "score", "rank")


def _truth_rank(ranked: DataFrame, q: DataFrame) -> DataFrame:
    """One row per query with the rank of its truth (null: not among the ranked)."""
    hit = ranked.where("inchikey = true_inchikey").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return q.select("query_id", "query_group").join(hit, "query_id", "left")


def mass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics of the ranking by mass, by cohort and overall."""
    best = rk.top_k(_mass_scores(spark, sf_dir), "query_id", [F.desc("score"), F.asc("candidate_id")])
    per = _truth_rank(best, masses(queries_with_mass(spark, sf_dir)))
    return per.rollup("query_group").agg(*rk.ranking_metrics(F.col("rank")))


def score_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each candidate's score within its query."""
    s = F.col("score")
    return _mass_scores(spark, sf_dir).select(
        "query_id", "candidate_id",
        F.round(rk.z_score(s, "query_id"), 4).alias("z"),
        F.round(rk.clipped_z(s, "query_id"), 4).alias("clipped"),
        F.round(rk.min_max(s, "query_id"), 4).alias("min_max"),
        F.round(rk.rank_share([F.desc("score"), F.asc("candidate_id")], "query_id"), 4).alias("rank_share"),
        F.round(s - F.max(s).over(W.partitionBy("query_id")), 4).alias("to_best"),
        F.round(F.log(F.count(F.lit(1)).over(W.partitionBy("query_id")).cast("double")), 4).alias("log_pool"),
    )


def _eligible(q: DataFrame, lib: DataFrame, ppm: float = 20.0) -> DataFrame:
    """Pairs of queries and library spectra of near mass and equal polarity, without the query's own spectrum."""
    pairs = bj.band_join(q.where("neutral_mass > 0"), F.array(bj.window(F.col("neutral_mass"), ppm)), lib, "lib_mass")
    return pairs.where("sgn = lib_sgn AND spectrum_id != source_spectrum_id")


#: Widths (Da) of the mass buckets in which spectra meet: for near masses, and for analogs.
NEAR_WIDTH, ANALOG_WITHIN = 0.5, 200.0


def near_bins(q: DataFrame, lib: DataFrame) -> DataFrame:
    """``query_id``, ``spectrum_id``, what both carry, and ``vq``, ``v`` of each bin shared by spectra within 20 ppm, of one polarity and not the same."""
    m = F.col("neutral_mass")
    w = bj.window(m, 20.0)
    asked = sim.asked_buckets(q.where(m > 0), w["lo"], w["hi"], NEAR_WIDTH)
    held = lib.withColumn("bucket", F.floor(F.col("lib_mass") / NEAR_WIDTH))
    held = held.join(asked.select("bucket").distinct(), "bucket", "left_semi")  # spectra that no query's window touches aren't spread
    a = sim.binned(asked, "query_id", "qps", "source_spectrum_id", "energy", "sgn", "lo", "hi", "bucket").withColumnRenamed("v", "vq")
    b = sim.binned(held, "spectrum_id", "ps", "inchikey", "lib_energy", "lib_sgn", "lib_mass", "bucket")
    return sim.bins_met(a, b, "lib_mass").where("sgn = lib_sgn AND spectrum_id != source_spectrum_id")


def near_hits(q: DataFrame, lib: DataFrame, best: int = 1, digits: int | None = None) -> DataFrame:
    """Per query and molecule the ``best`` spectra by cosine among those within 20 ppm, of one polarity and not the query's own (see ``best_hits``)."""
    m = F.col("neutral_mass")
    w = bj.window(m, 20.0)
    signed = lambda sgn: F.col("bucket") * 2 + (F.col(sgn) > 0).cast("int")
    asked = sim.asked_buckets(q.where(m > 0), w["lo"], w["hi"], NEAR_WIDTH).withColumn("bucket", signed("sgn"))
    held = lib.withColumn("bucket", F.floor(F.col("lib_mass") / NEAR_WIDTH)).withColumn("bucket", signed("lib_sgn"))
    asked = asked.select("query_id", "source_spectrum_id", "energy", "lo", "hi", "bucket", F.col("qps").alias("ps"))
    held = held.drop("lib_sgn")
    return sim.best_hits(asked, held, best=best, digits=digits)


def direct_hits(spark: SparkSession, sf_dir: str, lib: DataFrame | None = None) -> DataFrame:
    """Per query and molecule: the best fine-bin cosine among library spectra (``lib``, if it is at hand) of near mass."""
    hits = near_hits(queries_with_mass(spark, sf_dir), library(spark, sf_dir) if lib is None else lib)
    return hits.groupBy("query_id", "inchikey").agg(F.max("cosine").alias("direct"))


def direct_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best cosine per query and molecule of near mass."""
    return direct_hits(spark, sf_dir).select("query_id", "inchikey", F.round("direct", 6).alias("cosine"))


def entropy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned spectral-entropy similarity per query and library spectrum of near mass."""

    def shares(df: DataFrame, ps: str) -> DataFrame:  # intensities as shares; spectra without intensity have none
        total = F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["i"])
        length = F.sqrt(F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["i"] * p["i"]))
        return df.withColumn("scale", length / total).where(total > 0)

    q, lib = shares(queries_with_mass(spark, sf_dir), "qps"), shares(library(spark, sf_dir), "ps")
    met = near_bins(q, lib).join(q.select("query_id", F.col("scale").alias("q_scale")), "query_id").join(lib.select("spectrum_id", F.col("scale").alias("l_scale")), "spectrum_id")
    gain = sim.entropy_gain(F.col("vq") * F.col("q_scale"), F.col("v") * F.col("l_scale"))
    return met.groupBy("query_id", "spectrum_id").agg(F.round(F.sum(gain) / F.log(F.lit(4.0)), 6).alias("similarity"))


def pair_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modified cosine of queries with library spectra of near mass, on the pairs of the band join."""
    pairs = _eligible(queries_with_mass(spark, sf_dir), library(spark, sf_dir), ppm=50.0)
    value = sim.modified_cosine(F.col("qps"), F.col("ps"), F.col("neutral_mass") - F.col("lib_mass"))
    return pairs.select("query_id", "spectrum_id", F.round(value, 6).alias("modified_cosine"))


def greedy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with library spectra within 20 ppm: greedy one-to-one cosine, matched peaks, the spectrum's key and both energies."""
    pairs = _eligible(queries_with_mass(spark, sf_dir), library(spark, sf_dir))
    pairs = pairs.select(
        "query_id", "spectrum_id", "inchikey", "energy", "lib_energy", pk.unit_length(F.col("qps")).alias("a"), pk.unit_length(F.col("ps")).alias("b"),
        (F.col("neutral_mass") - F.col("lib_mass")).alias("delta"),
    )
    return sim.greedy_cosine(pairs, "a", "b", "delta").withColumn("greedy_cosine", F.round("greedy_cosine", 6))


def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one cosine of the same pairs."""
    return greedy_hits(spark, sf_dir).select("query_id", "spectrum_id", "greedy_cosine", "n_matched")


def truth_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tanimoto similarity of each retrieved candidate to the query's truth."""
    c = catalog(spark, sf_dir)
    truth = c.select(F.col("inchikey").alias("true_inchikey"), F.col("fp").alias("true_fp"))
    pairs = _union(spark, sf_dir).select("query_id", "candidate_id", "true_inchikey").join(truth, "true_inchikey")
    pairs = pairs.join(c.select("candidate_id", "fp"), "candidate_id")
    return pairs.select("query_id", "candidate_id", F.round(sim.tanimoto(F.col("fp"), F.col("true_fp")), 6).alias("tanimoto"))


def _analog_hits(spark: SparkSession, sf_dir: str, lib: DataFrame | None = None) -> DataFrame:
    """Per query the ``HITS`` best library molecules of any mass within 200 Da with a cosine of at least 0.15; ``strength`` is cosine^2 times energy and mass decay."""
    q, lib = queries_with_mass(spark, sf_dir), library(spark, sf_dir) if lib is None else lib
    m = F.col("neutral_mass")
    asked = sim.asked_buckets(q.where(m.isNotNull()), m - ANALOG_WITHIN, m + ANALOG_WITHIN, ANALOG_WITHIN)
    asked = asked.select("query_id", "source_spectrum_id", "energy", "neutral_mass", "lo", "hi", "bucket", F.col("qps").alias("ps"))
    held = lib.withColumn("bucket", F.floor(F.col("lib_mass") / ANALOG_WITHIN)).drop("lib_sgn")
    hits = sim.best_hits(asked, held, neighbours=True, least=0.15, top=HITS)
    gap = F.coalesce(F.abs(F.col("energy") - F.col("lib_energy")), F.lit(0.0))
    decay = F.exp(-gap / 20.0) * F.exp(-F.abs(F.col("neutral_mass") - F.col("lib_mass")) / 100.0)
    hits = hits.select("query_id", "inchikey", "spectrum_id", "cosine", (F.col("cosine") * F.col("cosine") * decay).alias("strength"))
    best = F.max_by(F.struct("cosine", "strength"), F.struct("cosine", -F.col("spectrum_id")))
    hits = hits.repartition("query_id").groupBy("query_id", "inchikey").agg(best.alias("h")).select("query_id", F.col("inchikey").alias("hit_key"), "h.*")
    return rk.top_k(hits, "query_id", [F.desc(F.round("cosine", 9)), F.asc("hit_key")], HITS)


def _hit_fingerprints(spark: SparkSession, sf_dir: str, c: DataFrame, lib: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``strength``, ``hit_fp`` of the analog hits that the catalog ``c`` has."""
    hits = _analog_hits(spark, sf_dir, lib).select("query_id", "hit_key", "strength")
    return hits.join(c.select(F.col("inchikey").alias("hit_key"), F.col("fp").alias("hit_fp")), "hit_key")


def _analog_agreement(spark: SparkSession, sf_dir: str, pool: DataFrame | None = None, lib: DataFrame | None = None) -> DataFrame:
    """Candidates of each query (those of ``pool``, else of the union of windows) against the bits of its analog hits."""
    c = catalog(spark, sf_dir)
    hits = _hit_fingerprints(spark, sf_dir, c, lib)
    pool = _union(spark, sf_dir, "fp") if pool is None else pool
    if "fp" not in pool.columns:
        pool = pool.select("query_id", "candidate_id").join(c.select("candidate_id", "fp"), "candidate_id")
    return sim.analog_agreement(pool, hits)


def analog_scores(spark: SparkSession, sf_dir: str, pool: DataFrame | None = None, lib: DataFrame | None = None) -> DataFrame:
    """Per query and candidate: the best strength times Tanimoto over the analog hits."""
    return _analog_agreement(spark, sf_dir, pool, lib).select("query_id", "candidate_id", "analog")


def _bit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the fingerprints of a query's candidates agree with the bits that its analogs let expect, and how they rank (see ``bits_in_pools``)."""
    q, c = queries_with_mass(spark, sf_dir), catalog(spark, sf_dir)
    windows = bj.disjoint(bj.union_windows(F.col("neutral_mass"), F.col("precursor")))
    return sim.bits_in_pools(q.select("query_id", windows.alias("windows")), _hit_fingerprints(spark, sf_dir, c), c, "exact_mass")


def bit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agreement of candidates with the expected bits, standardised within the query: three spreads, by size once more, by rank, and the rank that ties share."""
    b, size, mean, sd, lo, hi, size_mean, size_sd = map(F.col, ("bits", "size", "mean", "sd", "lo", "hi", "size_mean", "size_sd"))
    return _bit_scores(spark, sf_dir).select(
        "query_id", "candidate_id", F.round(rk.standardised(b, mean, sd), 4).alias("z"),
        F.round(rk.clipped(b, mean, sd), 4).alias("clipped"), F.round(rk.within_bounds(b, lo, hi), 4).alias("min_max"),
        F.round(rk.standardised(b / size, size_mean, size_sd), 4).alias("z_by_size"),
        F.round(1 - rk.share_of_place(F.col("place"), F.col("n")), 4).alias("rank_from_0"), "shared_rank",
    )


# From this direct cosine on a query's best hit comes first, by this much.
DECISIVE, DECISIVE_BONUS = 0.85, 10.0


def fused_with_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best candidates by the fused score with the expected bits; a decisive direct hit comes first."""
    z = rk.standardised(F.col("bits"), F.col("mean"), F.col("sd"))
    b = _bit_scores(spark, sf_dir).select("query_id", "candidate_id", z.alias("z"))
    f = _fused(spark, sf_dir).join(b, ["query_id", "candidate_id"], "left")
    per = W.partitionBy("query_id").orderBy(F.desc(F.round("direct", 9)), "candidate_id")
    decisive = (F.row_number().over(per) == 1) & (F.round("direct", 9) >= DECISIVE)
    score = F.col("score") + rk.BIT_WEIGHT * F.coalesce("z", F.lit(0.0)) + F.when(decisive, DECISIVE_BONUS).otherwise(0.0)
    best = rk.top_k(f.withColumn("score", F.round(score, 6)), "query_id", [F.desc("score"), F.asc("candidate_id")])
    return best.select("query_id", "candidate_id", "score", "rank")


def analog_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analog_scores(spark, sf_dir).select("query_id", "candidate_id", F.round("analog", 6).alias("analog"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = durable_table(_union(spark, sf_dir, "fp").drop("canonical_smiles"))  # used twice
    lib = durable_table(sim.fine_vectors(library(spark, sf_dir), "ps"))  # read, cleaned and binned once for both searches
    joined = pairs.drop("fp").join(direct_hits(spark, sf_dir, lib), ["query_id", "inchikey"], "left").join(analog_scores(spark, sf_dir, pairs, lib), ["query_id", "candidate_id"], "left")
    joined = joined.withColumns({"direct": F.coalesce("direct", F.lit(0.0)), "analog": F.coalesce("analog", F.lit(0.0))})
    score = rk.fused_score(F.col("ppm"), rk.source_prior(F.col("source")), F.col("direct"), F.col("analog"), F.lit(0.0))
    return joined.withColumn("score", F.round(score, 6))


def fused_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best candidates of each query by mass, prior, direct hits and analogs."""
    best = rk.top_k(_fused(spark, sf_dir), "query_id", [F.desc("score"), F.asc("candidate_id")])
    return best.select("query_id", "candidate_id", "score", "rank")


def fused_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics of the fused ranking, by cohort and overall."""
    best = rk.top_k(_fused(spark, sf_dir), "query_id", [F.desc("score"), F.asc("candidate_id")])
    return _truth_rank(best, masses(queries_with_mass(spark, sf_dir))).rollup("query_group").agg(*rk.ranking_metrics(F.col("rank")))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each threshold: queries that the library answers (best cosine at or above it), and the share answered right."""
    hits = direct_hits(spark, sf_dir).withColumn("cosine", F.round("direct", 6))
    best = rk.top_k(hits, "query_id", [F.desc("cosine"), F.asc("inchikey")], 1).select("query_id", "cosine", "inchikey")
    q = masses(queries_with_mass(spark, sf_dir)).select("query_id", "true_inchikey")
    per = q.join(best, "query_id", "left").withColumn("right", (F.col("inchikey") == F.col("true_inchikey")).cast("double"))
    swept = per.withColumn("tau", F.explode(F.array(*(F.lit(x / 10) for x in range(1, 10)))))
    answered = F.col("cosine") >= F.col("tau")
    return swept.groupBy("tau").agg(
        F.count_if(answered).alias("n_answered"), F.round(F.coalesce(F.avg(F.when(answered, F.coalesce("right", F.lit(0.0)))), F.lit(0.0)), 6).alias("precision")
    )


def popularity_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates within 20 ppm by how many library spectra their molecule has, without what the benchmark withholds.

    Withheld are the molecules of the groups C2 and C3 and the source spectrum of every query.
    """
    held = table(spark, sf_dir, "benchmark_queries")
    keys = held.where("query_group IN ('C2', 'C3')").select(F.col("true_inchikey").alias("inchikey")).distinct()
    own = held.select(F.col("source_spectrum_id").alias("spectrum_id")).distinct()
    left = library(spark, sf_dir).select("spectrum_id", "inchikey").join(keys, "inchikey", "left_anti").join(own, "spectrum_id", "left_anti")
    counts = left.groupBy("inchikey").agg(F.count(F.lit(1)).alias("n_spectra"))
    pairs = bj.band_join(masses(queries_with_mass(spark, sf_dir)).where("neutral_mass > 0"), F.array(bj.window(F.col("neutral_mass"), 20.0)), catalog(spark, sf_dir).drop("fp"), "exact_mass")
    pairs = pairs.join(counts, "inchikey", "left").withColumn("n_spectra", F.coalesce("n_spectra", F.lit(0)))
    best = rk.top_k(pairs, "query_id", [F.desc("n_spectra"), F.asc("inchikey"), F.asc("candidate_id")])
    return best.select("query_id", "candidate_id", "n_spectra", "rank")


def _same_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query the library molecules within 20 ppm and of its polarity by their median mass, the 25 with most spectra."""
    m = F.col("neutral_mass")
    lib = library(spark, sf_dir).groupBy("inchikey", "lib_sgn").agg(F.expr("percentile(lib_mass, 0.5)").alias("lib_mass"), F.count(F.lit(1)).alias("n"))
    q = queries_with_mass(spark, sf_dir).where(m > 0).select("query_id", "neutral_mass", "sgn")
    near = bj.band_join(q, F.array(bj.window(m, 20.0)), lib, "lib_mass").where("sgn = lib_sgn")
    near = near.join(catalog(spark, sf_dir).select("inchikey", "canonical_smiles"), "inchikey")
    return rk.top_k(near, "query_id", [F.desc("n"), F.asc("inchikey")])


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per query: 25 structures joined by semicolons, padded by library molecules of its mass, by the most frequent molecules, then by ``CCO``."""
    ranked = rk.top_k(_mass_scores(spark, sf_dir), "query_id", [F.desc("score"), F.asc("candidate_id")])
    place = lambda p: F.struct(F.lit(p).alias("p"), F.col("rank"), F.col("canonical_smiles").alias("s")).alias("x")
    own = ranked.select("query_id", place(0)).unionByName(_same_mass(spark, sf_dir).select("query_id", place(1)))
    counts = library(spark, sf_dir).groupBy("inchikey").agg(F.count(F.lit(1)).alias("n"))
    popular = counts.join(catalog(spark, sf_dir).select("inchikey", "canonical_smiles"), "inchikey")
    popular = popular.orderBy(F.desc("n"), "inchikey").limit(25).collect()  # the padding has 25 structures, whatever the data
    pad = [*dict.fromkeys(r["canonical_smiles"] for r in popular)]
    q = masses(queries_with_mass(spark, sf_dir)).select("query_id")
    lists = q.join(own, "query_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("own"))
    every = F.concat(F.transform("own", lambda x: x["s"]), F.array(*map(F.lit, pad)).cast("array<string>"))
    fill = F.array_repeat(F.lit("CCO"), 25)
    return lists.select("query_id", F.array_join(F.slice(F.concat(F.array_distinct(every), fill), 1, 25), ";").alias("smiles"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_union, retrieval_tiered, retrieval_progressive, retrieval_pool, retrieval_recall, top25, mass_metrics,
        score_statistics, direct_search, entropy_search, pair_cosines, greedy_pairs, truth_similarity, analog_propagation,
        fused_ranking, fused_metrics, bit_scores, fused_with_bits, threshold_sweep, popularity_ranking, submission,
    )
}

_Q = r"""
WITH el(e, w) AS (VALUES ('H', 1.00782503223e0), ('C', 12e0), ('N', 14.00307400443e0), ('O', 15.99491461957e0), ('F', 18.99840316273e0),
 ('P', 30.97376199842e0), ('S', 31.9720711744e0), ('Cl', 34.968852682e0), ('Br', 78.9183376e0), ('I', 126.9044719e0)),
fm AS (SELECT candidate_id, sum(w * CASE WHEN k = '' THEN 1 ELSE k::INT END) AS fmass FROM (SELECT candidate_id,
 unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\d*)', 1)) AS e, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\d*)', 2)) AS k
 FROM candidates WHERE exact_mass IS NULL) JOIN el USING (e) GROUP BY 1),
c AS (SELECT candidate_id, inchikey, canonical_smiles, coalesce(exact_mass, fmass) AS mass, source, fp FROM candidates LEFT JOIN fm USING (candidate_id)
 WHERE coalesce(exact_mass, fmass) > 0),
q AS (SELECT query_id, query_group, source_spectrum_id, true_inchikey, observed_precursor_mz AS precursor, observed_collision_energy AS energy, a.sgn,
 (a.charge * observed_precursor_mz + a.sgn * a.charge * 0.00054858e0 - a.adds + a.losses) / a.n_m AS m, observed_ms2_mzs AS qm, observed_ms2_intensities AS qi
 FROM benchmark_queries JOIN adducts a ON regexp_replace(observed_adduct, '\s', '', 'g') = a.adduct),
w AS (SELECT query_id, m * (1 - 100.0e0 / 1e6) AS lo, m * (1 + 100.0e0 / 1e6) AS hi FROM q WHERE m > 0
 UNION ALL SELECT query_id, (m + 1.003354835e0) * (1 - 30.0e0 / 1e6), (m + 1.003354835e0) * (1 + 30.0e0 / 1e6) FROM q WHERE m > 0
 UNION ALL SELECT query_id, (m - 1.003354835e0) * (1 - 30.0e0 / 1e6), (m - 1.003354835e0) * (1 + 30.0e0 / 1e6) FROM q WHERE m > 1.003354835e0
 UNION ALL SELECT query_id, m - 0.5e0, m + 0.5e0 FROM q WHERE m > 0 AND abs(precursor - round(precursor)) <= 0.01e0),
u AS (SELECT DISTINCT w.query_id, c.candidate_id FROM w JOIN c ON c.mass BETWEEN w.lo AND w.hi),
p AS (SELECT u.query_id, u.candidate_id, c.inchikey, c.canonical_smiles, c.source, c.mass, c.fp, q.m, q.true_inchikey, q.query_group, abs(c.mass - q.m) / q.m * 1e6 AS ppm
 FROM u JOIN c USING (candidate_id) JOIN q USING (query_id)),
s AS (SELECT *, round(-ppm / 100.0e0 + CASE WHEN source = ['TRAIN'] THEN 0.05e0 WHEN source = ['COCONUT'] THEN 0.02e0 ELSE 0.0e0 END, 6) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rnk FROM s),
t0 AS (SELECT *, list_distinct(regexp_extract_all(upper(inchikey), '\b([A-Z]{14}-[A-Z]{10}-[A-Z])\b', 1)) AS ks, regexp_replace(adduct, '\s', '', 'g') AS ad FROM train),
lib AS (SELECT spectrum_id, ks[1] AS inchikey, CASE WHEN collision_energy > 0 AND collision_energy <= 200 THEN collision_energy END AS lib_energy, a.sgn AS lib_sgn,
 ms2_mzs AS lm, ms2_intensities AS li, (a.charge * precursor_mz + a.sgn * a.charge * 0.00054858e0 - a.adds + a.losses) / a.n_m AS lib_mass
 FROM t0 JOIN adducts a ON t0.ad = a.adduct WHERE len(ks) = 1 AND len(ms2_mzs) = len(ms2_intensities) AND len(ms2_mzs) > 0 AND precursor_mz IS NOT NULL),
"""
_BINS = """
qp AS (SELECT query_id, unnest(qm) AS mz, unnest(qi) AS i FROM q), lp AS (SELECT spectrum_id, unnest(lm) AS mz, unnest(li) AS i FROM lib),
qn AS (SELECT query_id, sqrt(sum(i * i)) AS n, sum(i) AS t FROM qp GROUP BY 1), ln_ AS (SELECT spectrum_id, sqrt(sum(i * i)) AS n, sum(i) AS t FROM lp GROUP BY 1),
qb AS (SELECT query_id, floor((mz - 20.0e0) / 0.01e0)::BIGINT AS bin, sum(i / n) AS v, sum(i / t) AS a FROM qp JOIN qn USING (query_id) GROUP BY 1, 2),
lb AS (SELECT spectrum_id, floor((mz - 20.0e0) / 0.01e0)::BIGINT AS bin, sum(i / n) AS v, sum(i / t) AS b FROM lp JOIN ln_ USING (spectrum_id) GROUP BY 1, 2),
e AS (SELECT query_id, spectrum_id, inchikey FROM q JOIN lib ON lib_mass BETWEEN m * (1 - 20.0e0 / 1e6) AND m * (1 + 20.0e0 / 1e6)
 WHERE m > 0 AND sgn = lib_sgn AND spectrum_id <> source_spectrum_id),
d AS (SELECT query_id, e.inchikey, max(cosv) AS direct FROM (SELECT query_id, spectrum_id, sum(qb.v * lb.v) AS cosv FROM qb JOIN lb USING (bin) GROUP BY 1, 2)
 JOIN e USING (query_id, spectrum_id) GROUP BY 1, 2),
"""
_ANALOG = """
qw AS (SELECT query_id, bin + k AS bin, sum(v) AS v FROM qb CROSS JOIN (VALUES (-1), (0), (1)) o(k) WHERE bin + k >= 0 AND bin + k < 148000 GROUP BY 1, 2),
h0 AS (SELECT query_id, spectrum_id, sum(qw.v * lb.v) AS cosv FROM qw JOIN lb USING (bin) GROUP BY 1, 2 HAVING sum(qw.v * lb.v) >= 0.15),
h1 AS (SELECT query_id, lib.inchikey AS hit_key, cosv, energy, lib_energy, m, lib_mass, row_number() OVER (PARTITION BY query_id, lib.inchikey ORDER BY cosv DESC, spectrum_id) AS k
 FROM h0 JOIN q USING (query_id) JOIN lib USING (spectrum_id) WHERE spectrum_id <> source_spectrum_id AND abs(m - lib_mass) <= 200),
h2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosv, 9) DESC, hit_key) AS top FROM h1 WHERE k = 1),
h AS (SELECT query_id, c.fp AS hit_fp, cosv * cosv * exp(-coalesce(abs(energy - lib_energy), 0.0e0) / 20.0e0) * exp(-abs(m - lib_mass) / 100.0e0) AS strength
 FROM h2 JOIN c ON c.inchikey = hit_key WHERE top <= 80),
an AS (SELECT query_id, candidate_id, max(strength * coalesce(list_sum(list_transform(list_zip(fp, hit_fp), lambda z: bit_count(z[1] & z[2]))) * 1.0e0
 / nullif(list_sum(list_transform(list_zip(fp, hit_fp), lambda z: bit_count(z[1] | z[2]))), 0), 0)) AS analog FROM p JOIN h USING (query_id) GROUP BY 1, 2),
"""
_FUSED = (
    _Q
    + _BINS
    + _ANALOG
    + """f AS (SELECT p.*, round(-ppm / 100.0e0 + CASE WHEN source = ['TRAIN'] THEN 0.05e0 WHEN source = ['COCONUT'] THEN 0.02e0 ELSE 0.0e0 END
 + CASE WHEN direct >= 0.1 THEN 2.0e0 * direct + CASE WHEN direct >= 0.7 THEN 2.0e0 ELSE 0 END ELSE 0 END + 1.5e0 * coalesce(analog, 0), 6) AS score
 FROM p LEFT JOIN d USING (query_id, inchikey) LEFT JOIN an USING (query_id, candidate_id)),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rnk FROM f)
"""
)
_BITS = """bo AS (SELECT query_id, candidate_id, strength, list_sum(list_transform(p.fp, lambda x: bit_count(x))) AS n, list_sum(list_transform(list_zip(p.fp, hit_fp), lambda z: bit_count(z[1] & z[2]))) AS ov
 FROM p JOIN h USING (query_id)),
bs AS (SELECT query_id, candidate_id, coalesce(sum(strength * (2 * ov - n)) / nullif(sum(strength), 0), 0) / sqrt(greatest(max(n), 1)) AS bits, sqrt(greatest(max(n), 1)) AS size FROM bo GROUP BY 1, 2),
bw AS (SELECT *, avg(bits / size) OVER w AS size_mean, stddev_pop(bits / size) OVER w AS size_sd, count(*) OVER w AS n_pool, rank() OVER (PARTITION BY query_id ORDER BY round(bits, 9) DESC) AS shared_rank,
 row_number() OVER (PARTITION BY query_id ORDER BY round(bits, 9) DESC, candidate_id) AS place, avg(bits) OVER w AS mean, stddev_pop(bits) OVER w AS sd, min(bits) OVER w AS lo, max(bits) OVER w AS hi FROM bs WINDOW w AS (PARTITION BY query_id)),
bz AS (SELECT query_id, candidate_id, CASE WHEN sd > 1e-9 THEN (bits - mean) / sd ELSE 0 END AS z, greatest(-2.5e0, least(2.5e0, (bits - mean) / greatest(sd, 0.5e0))) AS clipped,
 CASE WHEN hi > lo THEN (bits - lo) / (hi - lo) ELSE 0 END AS min_max,
 CASE WHEN size_sd > 1e-9 THEN (bits / size - size_mean) / size_sd ELSE 0 END AS z_by_size, CASE WHEN n_pool > 1 THEN (place - 1) * 1.0e0 / (n_pool - 1) ELSE 0 END AS rank_from_0, shared_rank FROM bw),
"""
_GREEDY = """
gq AS (SELECT query_id, unnest(range(len(qm))) AS pos, unnest(qm) AS mz, unnest(qi) AS i FROM q),
gl AS (SELECT spectrum_id, unnest(range(len(lm))) AS pos, unnest(lm) AS mz, unnest(li) AS i FROM lib),
gqn AS (SELECT query_id, sqrt(sum(i * i)) AS n FROM gq GROUP BY 1), gln AS (SELECT spectrum_id, sqrt(sum(i * i)) AS n FROM gl GROUP BY 1),
ge AS (SELECT query_id, spectrum_id, inchikey, energy, lib_energy, m - lib_mass AS delta FROM q JOIN lib ON lib_mass BETWEEN m * (1 - 20.0e0 / 1e6) AND m * (1 + 20.0e0 / 1e6)
 WHERE m > 0 AND sgn = lib_sgn AND spectrum_id <> source_spectrum_id),
gs AS (SELECT query_id, spectrum_id, k, k * delta AS shift FROM ge CROSS JOIN (VALUES (0), (1), (-1)) o(k) WHERE k = 0 OR abs(delta) >= 1e-4),
gnear AS (SELECT query_id, spectrum_id, k, b.pos AS pos, a.pos AS qpos, a.i / gqn.n * b.i / gln.n AS v FROM gs JOIN gq a USING (query_id) JOIN gl b USING (spectrum_id) JOIN gqn USING (query_id)
 JOIN gln USING (spectrum_id) WHERE abs(a.mz + shift - b.mz) <= 0.015 QUALIFY row_number() OVER (PARTITION BY query_id, spectrum_id, k, b.pos ORDER BY abs(a.mz + shift - b.mz), a.mz, a.pos) = 1),
gonce AS (SELECT * FROM gnear QUALIFY row_number() OVER (PARTITION BY query_id, spectrum_id, k, qpos ORDER BY pos) = 1),
gv AS (SELECT query_id, spectrum_id, k, sum(v) AS dot, count(*)::INT AS n FROM gonce GROUP BY 1, 2, 3),
gbest AS (SELECT *, row_number() OVER (PARTITION BY query_id, spectrum_id ORDER BY round(dot, 9) DESC, abs(k), k DESC) AS r FROM gv),
gp AS (SELECT query_id, spectrum_id, inchikey, abs(energy - lib_energy) AS gap, round(least(coalesce(dot, 0), 1), 6) AS greedy_cosine, coalesce(n, 0)::INT AS n_matched
 FROM ge LEFT JOIN (SELECT * FROM gbest WHERE r = 1) USING (query_id, spectrum_id)),
"""
_METRICS = """SELECT query_group, count(*) AS n, round(avg(CASE WHEN rnk <= 25 THEN 1.0e0 / rnk ELSE 0 END), 6) AS mrr,
 round(avg(CASE WHEN rnk <= 1 THEN 1.0e0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rnk <= 5 THEN 1.0e0 ELSE 0 END), 6) AS hit_5,
 round(avg(CASE WHEN rnk <= 25 THEN 1.0e0 ELSE 0 END), 6) AS hit_k FROM x GROUP BY ROLLUP (query_group)"""
_END = "z_ AS (SELECT 1) "

SQL = {
    "retrieval_union": _Q + _END + "SELECT query_id, candidate_id, round(ppm, 3) AS ppm FROM p",
    "retrieval_tiered": _Q
    + _END
    + """SELECT query_id, candidate_id, min(tier)::INT AS tier, max(weight)::DOUBLE AS weight FROM (
 SELECT query_id, candidate_id, 1 AS tier, 1.0 AS weight FROM q JOIN c ON mass BETWEEN m * (1 - 20e-6) AND m * (1 + 20e-6) WHERE m > 0
 UNION ALL SELECT query_id, candidate_id, 2, 0.9 FROM q JOIN c ON mass BETWEEN m * (1 - 50.0e0 / 1e6) AND m * (1 + 50.0e0 / 1e6) WHERE m > 0
 UNION ALL SELECT query_id, candidate_id, 3, 0.85 FROM q JOIN c ON mass BETWEEN (m + 1.003354835e0) * (1 - 20.0e0 / 1e6) AND (m + 1.003354835e0) * (1 + 20.0e0 / 1e6) WHERE m > 0
 UNION ALL SELECT query_id, candidate_id, 3, 0.85 FROM q JOIN c ON mass BETWEEN (m - 1.003354835e0) * (1 - 20.0e0 / 1e6) AND (m - 1.003354835e0) * (1 + 20.0e0 / 1e6) WHERE m > 1.003354835e0)
 GROUP BY 1, 2""",
    "retrieval_progressive": _Q
    + """g0 AS (SELECT query_id, candidate_id, abs(mass - m) / m * 1e6 AS ppm, mass BETWEEN (m + 1.003354835e0) * (1 - 20.0e0 / 1e6) AND (m + 1.003354835e0) * (1 + 20.0e0 / 1e6)
  OR m > 1.003354835e0 AND mass BETWEEN (m - 1.003354835e0) * (1 - 20.0e0 / 1e6) AND (m - 1.003354835e0) * (1 + 20.0e0 / 1e6) AS off FROM q JOIN c ON mass BETWEEN m - 2 AND m + 2 WHERE m > 0),
 g AS (SELECT * FROM g0 WHERE ppm <= 100 OR off),
 n AS (SELECT query_id, CASE WHEN count(*) FILTER (ppm <= 20) >= 25 THEN 20 WHEN count(*) FILTER (ppm <= 50) >= 25 THEN 50 ELSE 100 END AS chosen, count(*) FILTER (ppm <= 100) < 25 AS short FROM g GROUP BY 1),
 k AS (SELECT query_id, candidate_id, CASE WHEN ppm > chosen THEN 0.3 WHEN chosen = 20 THEN 1.0 WHEN chosen = 50 THEN 0.7 ELSE 0.4 END AS weight
  FROM g JOIN n USING (query_id) WHERE ppm <= chosen OR off AND short),
 few AS (SELECT query_id, m FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM k GROUP BY 1) USING (query_id) WHERE m > 0 AND coalesce(n, 0) < 25),
 o AS (SELECT candidate_id, row_number() OVER (ORDER BY mass, candidate_id) AS place FROM c),
 lower_ AS (SELECT query_id, count(candidate_id) AS below FROM few LEFT JOIN c ON mass < m GROUP BY 1),
 nn AS (SELECT query_id, candidate_id FROM lower_ JOIN o ON place > below - 30 AND place <= below + 30)
 SELECT query_id, candidate_id, weight::DOUBLE AS weight FROM k
 UNION ALL SELECT query_id, candidate_id, 0.1::DOUBLE FROM nn ANTI JOIN k USING (query_id, candidate_id)""",
    "retrieval_pool": _Q
    + """g AS (SELECT query_id, candidate_id, abs(mass - m) / m * 1e6 AS ppm FROM q JOIN c ON mass BETWEEN m * (1 - 30.0e0 / 1e6) AND m * (1 + 30.0e0 / 1e6) WHERE m > 0)
 SELECT query_id, candidate_id FROM g WHERE ppm <= 8.5 OR query_id NOT IN (SELECT query_id FROM g WHERE ppm <= 8.5)""",
    "retrieval_recall": _Q
    + """x AS (SELECT query_id, q.query_group, count(candidate_id) AS pool, coalesce(max((inchikey = q.true_inchikey)::INT), 0) AS hit FROM q LEFT JOIN p USING (query_id) GROUP BY 1, 2)
 SELECT query_group, count(*) AS n, round(avg(hit), 6) AS recall, round(quantile_cont(pool, 0.95), 4) AS pool_p95 FROM x GROUP BY ROLLUP (query_group)""",
    "top25": _Q + _END + "SELECT query_id, candidate_id, score, rnk AS rank FROM r WHERE rnk <= 25",
    "mass_metrics": _Q
    + """x AS (SELECT q.query_id, q.query_group, min(rnk) AS rnk FROM q LEFT JOIN (SELECT * FROM r WHERE rnk <= 25 AND inchikey = true_inchikey) r USING (query_id) GROUP BY 1, 2) """
    + _METRICS,
    "score_statistics": _Q
    + """g AS (SELECT *, avg(score) OVER v AS mean, stddev_pop(score) OVER v AS sd, min(score) OVER v AS lo, max(score) OVER v AS hi, count(*) OVER v AS n FROM r WINDOW v AS (PARTITION BY query_id))
 SELECT query_id, candidate_id, round(CASE WHEN sd > 1e-9 THEN (score - mean) / sd ELSE 0 END, 4) AS z,
 round(greatest(-2.5e0, least(2.5e0, (score - mean) / greatest(sd, 0.5e0))), 4) AS clipped, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 4) AS min_max,
 round(CASE WHEN n > 1 THEN 1 - (rnk - 1) * 1.0e0 / (n - 1) ELSE 1 END, 4) AS rank_share, round(score - hi, 4) AS to_best, round(ln(n), 4) AS log_pool FROM g""",
    "direct_search": _Q + _BINS + _END + "SELECT query_id, inchikey, round(direct, 6) AS cosine FROM d",
    "entropy_search": _Q
    + _BINS
    + """g AS (SELECT query_id, spectrum_id, sum((a + b) * ln(a + b) - a * ln(a) - b * ln(b)) / ln(4.0e0) AS s FROM qb JOIN lb USING (bin) GROUP BY 1, 2)
 SELECT query_id, spectrum_id, round(s, 6) AS similarity FROM g JOIN e USING (query_id, spectrum_id)""",
    "pair_cosines": _Q
    + """qp AS (SELECT query_id, unnest(qm) AS mz, unnest(qi) AS i FROM q), lp AS (SELECT spectrum_id, unnest(lm) AS mz, unnest(li) AS i FROM lib),
 qn AS (SELECT query_id, sqrt(sum(i * i)) AS n FROM qp GROUP BY 1), ln_ AS (SELECT spectrum_id, sqrt(sum(i * i)) AS n FROM lp GROUP BY 1),
 e AS (SELECT query_id, spectrum_id, m - lib_mass AS delta FROM q JOIN lib ON lib_mass BETWEEN m * (1 - 50.0e0 / 1e6) AND m * (1 + 50.0e0 / 1e6)
  WHERE m > 0 AND sgn = lib_sgn AND spectrum_id <> source_spectrum_id),
 sh AS (SELECT query_id, spectrum_id, k, k * delta AS shift FROM e CROSS JOIN (VALUES (0), (1), (-1)) o(k)),
 v AS (SELECT query_id, spectrum_id, k, coalesce(sum(CASE WHEN abs(a.mz + shift - b.mz) <= 0.01 THEN a.i * b.i END), 0) AS dot
  FROM sh JOIN qp a USING (query_id) JOIN lp b USING (spectrum_id) GROUP BY 1, 2, 3)
 SELECT query_id, spectrum_id, round(max(dot / (qn.n * ln_.n)), 6) AS modified_cosine FROM v JOIN qn USING (query_id) JOIN ln_ USING (spectrum_id) GROUP BY 1, 2""",
    "greedy_pairs": _Q + _GREEDY + _END + "SELECT query_id, spectrum_id, greedy_cosine, n_matched FROM gp",
    "truth_similarity": _Q
    + _END
    + """SELECT query_id, p.candidate_id, round(coalesce(list_sum(list_transform(list_zip(p.fp, t.fp), lambda z: bit_count(z[1] & z[2]))) * 1.0e0
 / nullif(list_sum(list_transform(list_zip(p.fp, t.fp), lambda z: bit_count(z[1] | z[2]))), 0), 0), 6) AS tanimoto FROM p JOIN c t ON t.inchikey = p.true_inchikey""",
    "analog_propagation": _Q + _BINS + _ANALOG + _END + "SELECT query_id, candidate_id, round(analog, 6) AS analog FROM an",
    "fused_ranking": _FUSED + "SELECT query_id, candidate_id, score, rnk AS rank FROM fr WHERE rnk <= 25",
    "fused_metrics": _FUSED
    + """, x AS (SELECT q.query_id, q.query_group, min(rnk) AS rnk FROM q LEFT JOIN (SELECT * FROM fr WHERE rnk <= 25 AND inchikey = true_inchikey) USING (query_id) GROUP BY 1, 2) """
    + _METRICS,
    "bit_scores": _Q + _BINS + _ANALOG + _BITS + _END + "SELECT query_id, candidate_id, round(z, 4) AS z, round(clipped, 4) AS clipped, round(min_max, 4) AS min_max, round(z_by_size, 4) AS z_by_size, round(rank_from_0, 4) AS rank_from_0, shared_rank FROM bz",
    "fused_with_bits": _FUSED
    + ", "
    + _BITS
    + """fd AS (SELECT f.query_id, f.candidate_id, score, z, round(coalesce(direct, 0), 9) AS dd FROM f LEFT JOIN d ON d.query_id = f.query_id AND d.inchikey = f.inchikey LEFT JOIN bz ON bz.query_id = f.query_id AND bz.candidate_id = f.candidate_id),
 fe AS (SELECT query_id, candidate_id, round(score + 0.1e0 * coalesce(z, 0) + CASE WHEN dd >= 0.85 AND row_number() OVER (PARTITION BY query_id ORDER BY dd DESC, candidate_id) = 1 THEN 10.0e0 ELSE 0 END, 6) AS score FROM fd)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM fe) WHERE rank <= 25""",
    "threshold_sweep": _Q
    + _BINS
    + """b AS (SELECT query_id, round(direct, 6) AS cosv, inchikey, row_number() OVER (PARTITION BY query_id ORDER BY round(direct, 6) DESC, inchikey) AS k FROM d),
 x AS (SELECT q.query_id, cosv, coalesce((b.inchikey = q.true_inchikey)::INT, 0) AS ok FROM q LEFT JOIN b ON b.query_id = q.query_id AND k = 1)
 SELECT (tau / 10.0)::DOUBLE AS tau, count(*) FILTER (cosv >= tau / 10.0) AS n_answered, round(coalesce(avg(ok) FILTER (cosv >= tau / 10.0), 0), 6) AS precision
 FROM x CROSS JOIN range(1, 10) g(tau) GROUP BY g.tau""",
    "popularity_ranking": _Q
    + """n AS (SELECT inchikey, count(*) AS n_spectra FROM lib WHERE lib_mass > 0
  AND NOT EXISTS (SELECT 1 FROM benchmark_queries b WHERE b.true_inchikey = lib.inchikey AND b.query_group IN ('C2', 'C3'))
  AND NOT EXISTS (SELECT 1 FROM benchmark_queries b WHERE b.source_spectrum_id = lib.spectrum_id) GROUP BY 1),
 g AS (SELECT query_id, candidate_id, inchikey, coalesce(n_spectra, 0) AS n_spectra FROM q JOIN c ON mass BETWEEN m * (1 - 20.0e0 / 1e6) AND m * (1 + 20.0e0 / 1e6) LEFT JOIN n USING (inchikey) WHERE m > 0)
 SELECT query_id, candidate_id, n_spectra, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_spectra DESC, inchikey, candidate_id) AS rank FROM g) WHERE rank <= 25""",
    "submission": _Q
    + """n AS (SELECT inchikey, count(*) AS n FROM lib WHERE lib_mass > 0 GROUP BY 1),
 pop AS (SELECT canonical_smiles AS s, row_number() OVER (ORDER BY n DESC, inchikey) AS k FROM n JOIN c USING (inchikey)),
 own AS (SELECT query_id, canonical_smiles AS s, rnk AS k FROM r WHERE rnk <= 25
  UNION ALL SELECT query_id, s, 100 + k FROM (SELECT query_id, canonical_smiles AS s, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, c.inchikey) AS k FROM q
   JOIN (SELECT inchikey, lib_sgn, quantile_cont(lib_mass, 0.5) AS lm, count(*) AS n FROM lib WHERE lib_mass > 0 GROUP BY 1, 2) l ON l.lib_sgn = q.sgn AND l.lm BETWEEN m * (1 - 20.0e0 / 1e6) AND m * (1 + 20.0e0 / 1e6)
   JOIN c ON c.inchikey = l.inchikey WHERE m > 0) WHERE k <= 25
  UNION ALL SELECT query_id, s, 200 + k FROM q CROSS JOIN pop WHERE k <= 25),
 ded AS (SELECT query_id, s, min(k) AS k FROM own GROUP BY 1, 2),
 num AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS i FROM ded)
 SELECT query_id, string_agg(s, ';' ORDER BY i) AS smiles FROM num WHERE i <= 25 GROUP BY 1""",
}
