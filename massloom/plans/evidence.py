"""Queries over evidence per molecule, grids of weights, baselines and library construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from massloom.functions import chem
from massloom.functions.keys import readable_keys, single_key
from massloom.functions.settings import known_energy
from massloom.operators import bandjoin as bj, ranking as rk
from massloom.operators.dedup import best_per_group
from massloom.plans import identification as ident
from massloom.sources.tables import table

# When evidence is full (matched peaks, supporting spectra), the decay over energies, the share of an
# unknown gap, the bonus of a second library, and the blend of the two best spectra.
FULL_PEAKS, FULL_SUPPORT, ENERGY_DECAY, UNKNOWN_GAP, SECOND_LIBRARY, LEAST_COSINE = 6.0, 5.0, 20.0, 0.6, 0.15, 0.1
BLEND, NEAR_ONE, NEAR_TWO, CONSISTENT, CONSISTENT_FROM = (0.65, 0.35), 1.10, 1.12, 1.08, 0.30

#: Weights of similarity, matched peaks, energy agreement and multiplicity, and the boost of their square.
WEIGHTS, BOOST = (0.6, 0.15, 0.1, 0.15), 4.5


def spectrum_hits(spark: SparkSession, sf_dir: str, best: int) -> DataFrame:
    """Per query and molecule at least the ``best`` library spectra of near mass: cosine, shared bins, and the gap between the energies; ``n_supporting`` adds up to the number of spectra met."""
    hits = ident.near_hits(ident.queries_with_mass(spark, sf_dir), ident.library(spark, sf_dir), best, digits=9)
    hits = hits.select("query_id", "spectrum_id", "inchikey", "energy", "lib_energy", F.round("cosine", 9).alias("cosine"), "n_matched", "n_supporting")
    return hits.withColumn("energy_gap", F.abs(F.col("energy") - F.col("lib_energy")))


def evidence_score(cosine: Column, matched: Column, gap: Column, supporting: Column, sources: Column) -> Column:
    """Boosted square of the weighted parts, each between 0 and 1; 0 below a cosine of 0.1. An unknown energy gap counts 0.6."""
    peaks = F.least(F.lit(1.0), matched / FULL_PEAKS)
    energy = F.when(gap.isNotNull() & ~F.isnan(gap), F.exp(-gap / ENERGY_DECAY)).otherwise(UNKNOWN_GAP)
    several = F.log1p(F.greatest(F.lit(1), supporting).cast("double")) / F.log1p(F.lit(FULL_SUPPORT))
    several = F.least(F.lit(1.0), F.least(F.lit(1.0), several) + F.when(sources >= 2, SECOND_LIBRARY).otherwise(0.0))
    parts = (F.least(F.lit(1.0), cosine), peaks, energy, several)
    raw = sum((w * p for w, p in zip(WEIGHTS[1:], parts[1:], strict=True)), WEIGHTS[0] * parts[0])
    return F.when(cosine >= LEAST_COSINE, BOOST * raw * raw).otherwise(0.0)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence score of each molecule that a query hits: its best spectrum, how many support it, from how many libraries."""
    libs = table(spark, sf_dir, "train").select(single_key(F.col("inchikey")).alias("inchikey"), "ingest_lib").where("inchikey IS NOT NULL")
    libs = libs.groupBy("inchikey").agg(F.countDistinct("ingest_lib").alias("n_sources"))
    best = F.max_by(F.struct("cosine", "n_matched", "energy_gap"), F.struct("cosine", -F.col("spectrum_id")))
    hits = spectrum_hits(spark, sf_dir, 1).groupBy("query_id", "inchikey").agg(best.alias("b"), F.sum("n_supporting").alias("n_supporting"))
    hits = hits.join(libs, "inchikey")
    score = evidence_score(F.col("b.cosine"), F.col("b.n_matched"), F.col("b.energy_gap"), F.col("n_supporting"), F.col("n_sources"))
    return hits.select("query_id", "inchikey", "n_supporting", F.round(score, 6).alias("evidence"))


def blended(top: DataFrame, *more: Column) -> DataFrame:
    """``query_id``, ``inchikey``, ``blend`` of the two best spectra (``k`` 1 and 2), and the aggregates ``more`` over them."""
    nth = lambda k: F.max(F.when(F.col("k") == k, F.col("cosine")))
    near = F.max((F.coalesce(F.col("energy_gap") <= 5, F.lit(False))).cast("int"))
    g = top.groupBy("query_id", "inchikey").agg(nth(1).alias("c1"), nth(2).alias("c2"), near.alias("near"), *more)
    one = F.col("c1") * F.when(F.col("near") == 1, NEAR_ONE).otherwise(1.0)
    both = (BLEND[0] * F.col("c1") + BLEND[1] * F.col("c2")) * F.when(F.col("near") == 1, NEAR_TWO).otherwise(1.0) * F.when(F.col("c2") > CONSISTENT_FROM, CONSISTENT).otherwise(1.0)
    return g.withColumn("blend", F.when(F.col("c2").isNull(), one).otherwise(both)).drop("c1", "c2", "near")


def two_best_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query and molecule: 0.65 of the best and 0.35 of the second cosine, with bonuses for a near energy and for consistency."""
    per = W.partitionBy("query_id", "inchikey").orderBy(F.desc("cosine"), "spectrum_id")
    top = spectrum_hits(spark, sf_dir, 2).withColumn("k", F.row_number().over(per)).where("k <= 2")
    return blended(top).withColumn("blend", F.round("blend", 6))


def multiplicity_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many spectra support a query's best molecule: queries, and how often it is right."""
    scored = evidence(spark, sf_dir)
    best = rk.top_k(scored, "query_id", [F.desc("evidence"), F.asc("inchikey")], 1)
    q = ident.masses(ident.queries_with_mass(spark, sf_dir)).select("query_id", "true_inchikey")
    band = F.when(F.col("n_supporting") >= 5, "5+").when(F.col("n_supporting") >= 2, "2-4").otherwise("1")
    right = (F.col("inchikey") == F.col("true_inchikey")).cast("int")
    return best.join(q, "query_id").groupBy(band.alias("support")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(right, F.lit(0))), 6).alias("precision"))


def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics for each weight of the analog part, all weights in one job."""
    f = ident._fused(spark, sf_dir).withColumn("w", F.explode(F.array(*(F.lit(w) for w in (0.0, 0.5, 1.0, 1.5, 3.0)))))
    f = f.withColumn("score", F.round(F.col("score") + (F.col("w") - 1.5) * F.col("analog"), 6))
    rank = F.row_number().over(W.partitionBy("query_id", "w").orderBy(F.desc("score"), "candidate_id"))
    hit = f.withColumn("rank", rank).where("rank <= 25 AND inchikey = true_inchikey").groupBy("query_id", "w").agg(F.min("rank").alias("rank"))
    q = ident.masses(ident.queries_with_mass(spark, sf_dir)).select("query_id")
    every = q.withColumn("w", F.explode(F.array(*(F.lit(w) for w in (0.0, 0.5, 1.0, 1.5, 3.0)))))
    return every.join(hit, ["query_id", "w"], "left").groupBy("w").agg(*rk.ranking_metrics(F.col("rank")))


def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected reciprocal rank of the truth if each query's pool were put in random order: the closed form over pool sizes."""
    pool = ident._union(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("inchikey") == F.col("true_inchikey")).cast("int")).alias("hit"))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(25)).cast("int")), F.lit(0.0), lambda a, r: a + 1.0 / r)
    return pool.select("query_id", "n", F.round(F.when(F.col("hit") == 1, harmonic / F.col("n")).otherwise(0.0), 6).alias("expected_rr"))


def isomer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By cohort and overall: how often the truth outscores an isomer in the pool, over all such pairs."""
    f = ident._fused(spark, sf_dir).join(table(spark, sf_dir, "candidates").select("candidate_id", "formula"), "candidate_id").where("formula IS NOT NULL")
    truth = f.where("inchikey = true_inchikey").select("query_id", F.col("formula"), F.col("score").alias("true_score"))
    pairs = f.where("inchikey != true_inchikey").join(truth, ["query_id", "formula"])
    pairs = pairs.select("query_id", (F.col("true_score") > F.col("score")).cast("int").alias("right"))
    every = ident.masses(ident.queries_with_mass(spark, sf_dir)).select("query_id", "query_group").join(pairs, "query_id", "left")
    return every.rollup("query_group").agg(F.count("right").alias("n_pairs"), F.round(F.avg("right"), 6).alias("accuracy"))


def isotope_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates within 20 ppm of the mass or an isotope step, else within 50 ppm, by direct cosine, library spectra and id."""
    m = F.col("neutral_mass")
    q, c = ident.masses(ident.queries_with_mass(spark, sf_dir)).where(m > 0), ident.catalog(spark, sf_dir).drop("fp")
    windows = lambda ppm: F.array(bj.window(m, ppm), bj.window(m + chem.ISOTOPE_STEP, ppm), F.when(m > chem.ISOTOPE_STEP, bj.window(m - chem.ISOTOPE_STEP, ppm)))
    wide = bj.band_join(q, windows(50.0), c, "exact_mass")
    near = F.lit(False)
    for step in (0.0, chem.ISOTOPE_STEP, -chem.ISOTOPE_STEP):
        near = near | F.col("exact_mass").between((m + step) * (1 - 20.0 / 1e6), (m + step) * (1 + 20.0 / 1e6))
    wide = wide.withColumn("near", near).withColumn("any_near", F.max("near").over(W.partitionBy("query_id"))).where("near OR NOT any_near")
    counts = ident.library(spark, sf_dir).groupBy("inchikey").agg(F.count(F.lit(1)).alias("n_spectra"))
    scored = wide.join(ident.direct_hits(spark, sf_dir), ["query_id", "inchikey"], "left").join(counts, "inchikey", "left")
    scored = scored.withColumns({"direct": F.round(F.coalesce("direct", F.lit(0.0)), 6), "n_spectra": F.coalesce("n_spectra", F.lit(0))})
    ranked = rk.top_k(scored, "query_id", [F.desc("direct"), F.desc("n_spectra"), F.asc("candidate_id")])
    return ranked.select("query_id", "candidate_id", "direct", "n_spectra", "rank")


def duplicate_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of train spectra with equal m/z lists to three decimals: rows and distinct single keys, by digest."""
    form = F.array_join(F.transform(F.array_sort("ms2_mzs"), lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    t = table(spark, sf_dir, "train").where(F.size("ms2_mzs") > 0).select(F.md5(form).alias("digest"), single_key(F.col("inchikey")).alias("k"))
    return t.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("n_keys")).where("n > 1")


def unified_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and evaluation spectra together, the one with most peaks per molecule and energy bin, with how many stand behind it."""
    t = table(spark, sf_dir, "train").select(F.concat(F.lit("T"), "spectrum_id").alias("id"), single_key(F.col("inchikey")).alias("inchikey"),
        known_energy(F.col("collision_energy")).alias("energy"), F.col("num_peaks").cast("int").alias("n_peaks"), F.col("ingest_lib").alias("source"))
    e = table(spark, sf_dir, "external_spectra").select(F.concat(F.lit("E"), "spectrum_id").alias("id"), single_key(F.col("inchikey")).alias("inchikey"),
        known_energy(F.col("collision_energy")).alias("energy"), F.col("peak_count").cast("int").alias("n_peaks"), F.col("source_library").alias("source"))
    every = t.unionByName(e).where("inchikey IS NOT NULL").withColumn("energy_bin", chem.energy_bin(F.col("energy")))
    counts = every.groupBy("inchikey", "energy_bin").agg(F.count(F.lit(1)).alias("n_supporting"), F.countDistinct("source").alias("n_sources"))
    best = best_per_group(every, ["inchikey", "energy_bin"], [F.desc_nulls_last("n_peaks"), F.asc("id")])
    return best.join(counts, ["inchikey", "energy_bin"]).select("inchikey", "energy_bin", "id", "n_peaks", "n_supporting", "n_sources")


def best_by_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spectrum per molecule: libraries in alphabetical order first, then a number of peaks near 40, then id."""
    t = table(spark, sf_dir, "train").select("spectrum_id", single_key(F.col("inchikey")).alias("inchikey"), "ingest_lib", "num_peaks").where("inchikey IS NOT NULL")
    return best_per_group(t, ["inchikey"], [F.asc_nulls_last("ingest_lib"), F.asc_nulls_last(F.abs(F.col("num_peaks") - 40)), F.asc("spectrum_id")])


def novel_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the evaluation splits that train doesn't name."""
    keys = lambda t: table(spark, sf_dir, t).select(F.explode(readable_keys(F.col("inchikey"))).alias("inchikey"))
    return keys("external_spectra").subtract(keys("train"))


def withheld_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query of cohort C1: spectra of its molecule at the same, a near and another energy in train (without its own)."""
    b = table(spark, sf_dir, "benchmark_queries").where("query_group = 'C1'").select("query_id", "source_spectrum_id", F.col("true_inchikey").alias("inchikey"), F.col("observed_collision_energy").alias("e"))
    t = table(spark, sf_dir, "train").select("spectrum_id", single_key(F.col("inchikey")).alias("inchikey"), known_energy(F.col("collision_energy")).alias("x"))
    # A hot key is counted per energy first; the query's own spectrum is taken off after.
    counts = t.where("inchikey IS NOT NULL").groupBy("inchikey", "x").agg(F.count(F.lit(1)).alias("n"))
    own = b.join(t.select(F.col("spectrum_id").alias("source_spectrum_id"), F.col("inchikey").alias("own_key"), F.col("x").alias("own_x")), "source_spectrum_id", "left")
    gap = F.abs(F.col("e") - F.col("x"))
    mine = F.when((F.col("own_key") == F.col("inchikey")) & F.col("own_x").eqNullSafe(F.col("x")), 1).otherwise(0)
    j = own.join(counts, "inchikey", "left").withColumn("m", F.coalesce(F.col("n"), F.lit(0)) - mine)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0))
    return j.groupBy("query_id").agg(total(gap == 0).alias("n_same"), total((gap > 0) & (gap <= 5)).alias("n_near"), total((gap > 5) | gap.isNull()).alias("n_other"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence, two_best_blend, multiplicity_precision, weight_sweep, random_baseline, isomer_accuracy, isotope_ranking,
        duplicate_spectra, unified_library, best_by_library, novel_structures, withheld_siblings,
    )
}

_HITS = (
    ident._Q
    + ident._BINS
    + """e2 AS (SELECT query_id, spectrum_id, lib.inchikey, abs(energy - lib_energy) AS gap FROM e JOIN q USING (query_id) JOIN lib USING (spectrum_id)),
hit AS (SELECT query_id, spectrum_id, e2.inchikey, gap, cosv, nm FROM (SELECT query_id, spectrum_id, round(sum(qb.v * lb.v), 9) AS cosv, count(*) AS nm FROM qb JOIN lb USING (bin) GROUP BY 1, 2)
 JOIN e2 USING (query_id, spectrum_id)),
hk AS (SELECT *, row_number() OVER (PARTITION BY query_id, inchikey ORDER BY cosv DESC, spectrum_id) AS k, count(*) OVER (PARTITION BY query_id, inchikey) AS ns FROM hit),
src AS (SELECT ks[1] AS inchikey, count(DISTINCT ingest_lib) AS n_sources FROM t0 WHERE len(ks) = 1 GROUP BY 1),
ev AS (SELECT query_id, inchikey, ns AS n_supporting, round(CASE WHEN cosv >= 0.1 THEN 4.5e0 * pow(0.6e0 * least(1, cosv) + 0.15e0 * least(1, nm / 6.0e0)
 + 0.1e0 * CASE WHEN gap IS NOT NULL THEN exp(-gap / 20.0e0) ELSE 0.6e0 END
 + 0.15e0 * least(1, least(1, ln(1 + greatest(1, ns)) / ln(6.0e0)) + CASE WHEN n_sources >= 2 THEN 0.15e0 ELSE 0 END), 2) ELSE 0 END, 6) AS evidence FROM hk JOIN src USING (inchikey) WHERE k = 1)
"""
)
_T = r"""WITH t0 AS (SELECT *, list_distinct(regexp_extract_all(upper(inchikey), '\b([A-Z]{14}-[A-Z]{10}-[A-Z])\b', 1)) AS ks FROM train),
t AS (SELECT * EXCLUDE (inchikey), CASE WHEN len(ks) = 1 THEN ks[1] END AS inchikey, CASE WHEN collision_energy > 0 AND collision_energy <= 200 THEN collision_energy END AS energy FROM t0),
x0 AS (SELECT *, list_distinct(regexp_extract_all(upper(inchikey), '\b([A-Z]{14}-[A-Z]{10}-[A-Z])\b', 1)) AS ks FROM external_spectra)
"""
_BIN = "coalesce(TRY_CAST(round_even(energy / 5, 0) AS INT), -9999)"

SQL = {
    "evidence": _HITS + "SELECT query_id, inchikey, n_supporting, evidence FROM ev",
    "two_best_blend": _HITS
    + """, b AS (SELECT query_id, inchikey, max(cosv) FILTER (k = 1) AS c1, max(cosv) FILTER (k = 2) AS c2, coalesce(bool_or(gap <= 5), false) AS near FROM hk WHERE k <= 2 GROUP BY 1, 2)
 SELECT query_id, inchikey, round(CASE WHEN c2 IS NULL THEN c1 * CASE WHEN near THEN 1.1e0 ELSE 1 END
 ELSE (0.65e0 * c1 + 0.35e0 * c2) * CASE WHEN near THEN 1.12e0 ELSE 1 END * CASE WHEN c2 > 0.3 THEN 1.08e0 ELSE 1 END END, 6) AS blend FROM b""",
    "multiplicity_precision": _HITS
    + """, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY evidence DESC, inchikey) AS r FROM ev)
 SELECT CASE WHEN n_supporting >= 5 THEN '5+' WHEN n_supporting >= 2 THEN '2-4' ELSE '1' END AS support, count(*) AS n, round(avg(coalesce((b.inchikey = q.true_inchikey)::INT, 0)), 6) AS precision
 FROM b JOIN q USING (query_id) WHERE r = 1 GROUP BY 1""",
    "weight_sweep": ident._FUSED
    + """, ww AS (SELECT unnest([0.0e0, 0.5e0, 1.0e0, 1.5e0, 3.0e0]) AS w),
 g AS (SELECT f.query_id, f.inchikey, f.true_inchikey, f.candidate_id, w, round(f.score + (w - 1.5e0) * coalesce(an.analog, 0), 6) AS s2 FROM f LEFT JOIN an USING (query_id, candidate_id) CROSS JOIN ww),
 gr AS (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY s2 DESC, candidate_id) AS rnk FROM g),
 hh AS (SELECT query_id, w, min(rnk) AS rnk FROM gr WHERE rnk <= 25 AND inchikey = true_inchikey GROUP BY 1, 2),
 x AS (SELECT q.query_id, ww.w, rnk FROM q CROSS JOIN ww LEFT JOIN hh ON hh.query_id = q.query_id AND hh.w = ww.w)
 SELECT w, count(*) AS n, round(avg(CASE WHEN rnk <= 25 THEN 1.0e0 / rnk ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rnk <= 1 THEN 1.0e0 ELSE 0 END), 6) AS hit_1,
 round(avg(CASE WHEN rnk <= 5 THEN 1.0e0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rnk <= 25 THEN 1.0e0 ELSE 0 END), 6) AS hit_k FROM x GROUP BY w""",
    "random_baseline": ident._Q
    + """g AS (SELECT query_id, count(*) AS n, coalesce(max((inchikey = true_inchikey)::INT), 0) AS hit FROM p GROUP BY 1)
 SELECT query_id, n, round(CASE WHEN hit = 1 THEN list_sum(list_transform(range(1, least(n, 25) + 1), lambda r: 1.0e0 / r)) / n ELSE 0 END, 6) AS expected_rr FROM g""",
    "isomer_accuracy": ident._FUSED
    + """, g AS (SELECT f.*, d.formula FROM f JOIN candidates d USING (candidate_id) WHERE d.formula IS NOT NULL),
 pair AS (SELECT a.query_id, (b.score > a.score)::INT AS ok FROM g a JOIN g b ON a.query_id = b.query_id AND a.formula = b.formula AND a.inchikey <> a.true_inchikey AND b.inchikey = b.true_inchikey)
 SELECT query_group, count(ok) AS n_pairs, round(avg(ok), 6) AS accuracy FROM q LEFT JOIN pair USING (query_id) GROUP BY ROLLUP (query_group)""",
    "isotope_ranking": ident._Q
    + ident._BINS
    + """st AS (SELECT unnest([0.0e0, 1.003354835e0, -1.003354835e0]) AS st),
 wi AS (SELECT query_id, candidate_id, c.inchikey, bool_or(c.mass BETWEEN (m + st) * (1 - 20.0e0 / 1e6) AND (m + st) * (1 + 20.0e0 / 1e6)) AS near
  FROM q CROSS JOIN st JOIN c ON c.mass BETWEEN (m + st) * (1 - 50.0e0 / 1e6) AND (m + st) * (1 + 50.0e0 / 1e6) WHERE m > 0 GROUP BY ALL),
 n AS (SELECT inchikey, count(*) AS n_spectra FROM lib WHERE lib_mass > 0 GROUP BY 1),
 g AS (SELECT query_id, candidate_id, round(coalesce(direct, 0), 6) AS direct, coalesce(n_spectra, 0) AS n_spectra FROM wi LEFT JOIN d USING (query_id, inchikey) LEFT JOIN n USING (inchikey)
  WHERE near OR query_id NOT IN (SELECT query_id FROM wi WHERE near)),
 r_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY direct DESC, n_spectra DESC, candidate_id) AS rank FROM g) SELECT query_id, candidate_id, direct, n_spectra, rank FROM r_ WHERE rank <= 25""",
    "duplicate_spectra": _T
    + """, g AS (SELECT md5(array_to_string(list_transform(list_sort(ms2_mzs), lambda x: round(x * 1000)::BIGINT), ',')) AS digest, inchikey FROM t WHERE len(ms2_mzs) > 0)
 SELECT digest, count(*) AS n, count(DISTINCT inchikey) AS n_keys FROM g GROUP BY 1 HAVING count(*) > 1""",
    "unified_library": _T
    + f""", u AS (SELECT 'T' || spectrum_id AS id, inchikey, energy, num_peaks::INT AS n_peaks, ingest_lib AS source FROM t
  UNION ALL SELECT 'E' || spectrum_id, CASE WHEN len(ks) = 1 THEN ks[1] END, CASE WHEN NOT isnan(collision_energy) AND collision_energy > 0 AND collision_energy <= 200 THEN collision_energy::DOUBLE END, peak_count::INT, source_library FROM x0),
 b AS (SELECT *, {_BIN} AS energy_bin FROM u WHERE inchikey IS NOT NULL),
 n AS (SELECT inchikey, energy_bin, count(*) AS n_supporting, count(DISTINCT source) AS n_sources FROM b GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY inchikey, energy_bin ORDER BY n_peaks DESC NULLS LAST, id) AS k FROM b)
 SELECT inchikey, energy_bin, id, n_peaks, n_supporting, n_sources FROM r JOIN n USING (inchikey, energy_bin) WHERE k = 1""",
    "best_by_library": _T
    + """SELECT spectrum_id, inchikey, ingest_lib, num_peaks FROM (SELECT *, row_number() OVER (PARTITION BY inchikey ORDER BY ingest_lib ASC NULLS LAST, abs(num_peaks - 40) ASC NULLS LAST, spectrum_id) AS k
 FROM t WHERE inchikey IS NOT NULL) WHERE k = 1""",
    "novel_structures": _T + "SELECT unnest(ks) AS inchikey FROM x0 EXCEPT SELECT unnest(ks) FROM t0",
    "withheld_siblings": _T
    + """, b AS (SELECT query_id, source_spectrum_id, true_inchikey, observed_collision_energy AS e FROM benchmark_queries WHERE query_group = 'C1')
 SELECT query_id, count(*) FILTER (spectrum_id IS NOT NULL AND abs(e - energy) = 0) AS n_same, count(*) FILTER (abs(e - energy) > 0 AND abs(e - energy) <= 5) AS n_near,
 count(*) FILTER (spectrum_id IS NOT NULL AND (abs(e - energy) > 5 OR e IS NULL OR energy IS NULL)) AS n_other
 FROM b LEFT JOIN t ON t.inchikey = b.true_inchikey AND t.spectrum_id <> b.source_spectrum_id GROUP BY 1""",
}
