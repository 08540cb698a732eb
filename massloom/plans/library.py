"""Queries over sources, streams, vectors, formula search, hard negatives and learned rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from massloom.functions import chem, peaks as pk
from massloom.functions.keys import single_key
from massloom.operators import bandjoin as bj, ranking as rk
from massloom.operators.blocks import block_search
from massloom.operators.learning import calibrated, group_folds, meta_ranked
from massloom.plans import identification as ident
from massloom.session import shared_folder
from massloom.sources.spectra_text import read_mgf, read_msp, write_mgf, write_msp
from massloom.sources.tables import table
from massloom.streaming.incremental import file_stream, run_to_end, windowed_counts


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "external_spectra")
    return e.select(
        "spectrum_id", F.trim("inchikey").alias("inchikey"), F.trim("canonical_smiles").alias("smiles"), "precursor_mz",
        F.col("precursor_type").alias("adduct"), pk.peaks(F.col("peaks_mz"), F.col("peaks_intensity")).alias("peaks"),
    ).where(F.size("peaks") > 0)


def msp_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation spectra written as MSP text and read again."""
    path = f"{shared_folder(spark)}/msp-{uuid.uuid4().hex}"
    write_msp(_external(spark, sf_dir), path)
    back = read_msp(spark, path)
    return back.select("spectrum_id", "inchikey", F.round("precursor_mz", 4).alias("precursor_mz"), "num_peaks", F.size("peaks").alias("n_read"))


def mgf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation spectra written as MGF text and read again."""
    path = f"{shared_folder(spark)}/mgf-{uuid.uuid4().hex}"
    write_mgf(_external(spark, sf_dir), path)
    back = read_mgf(spark, path)
    top = F.round(pk.base_peak(F.col("peaks")), 2)
    return back.select("spectrum_id", "adduct", F.round("precursor_mz", 4).alias("precursor_mz"), F.size("peaks").alias("n_read"), top.alias("highest"))


#: The columns of the domain tables by kind: text or whole number, number, list of numbers, list of whole numbers or texts, time.
CONTENT = {
    "train": {
        "plain": "spectrum_id accession session_id inchikey inchikey14 normalized_smiles molecular_formula adduct ionization_mode instrument_type ingest_lib num_peaks",
        "number": "precursor_mz collision_energy", "numbers": "ms2_mzs ms2_intensities", "time": "acquired_at ingested_at",
    },
    "external_spectra": {
        "plain": "spectrum_id split source_library canonical_smiles inchikey precursor_charge precursor_type ion_mode formula peak_count",
        "number": "precursor_mz collision_energy neutral_mass", "numbers": "peaks_mz peaks_intensity", "time": "added_at",
    },
    "candidates": {"plain": "candidate_id inchikey inchikey14 canonical_smiles formula", "number": "exact_mass", "plains": "source fp"},
    "sessions": {"plain": "session_id instrument_type ingest_lib", "time": "started_at finished_at"},
    "benchmark_queries": {
        "plain": "query_id query_group source_spectrum_id observed_adduct true_inchikey true_smiles withheld_exact_query",
        "number": "observed_precursor_mz observed_collision_energy observed_collision_energy_raw", "numbers": "observed_ms2_mzs observed_ms2_intensities",
    },
}


def _as_text(kind: str, c: Column) -> Column:
    """A value as text that doesn't depend on how an engine writes numbers: numbers in thousandths (NaN as null), times in microseconds."""
    number = lambda x: F.when(~F.isnan(x), F.floor(x.cast("double") * 1000).cast("string"))
    forms = {
        "plain": lambda: c.cast("string"), "number": lambda: number(c), "time": lambda: F.unix_micros(c.cast("timestamp")).cast("string"),
        "numbers": lambda: F.array_join(F.transform(c, number), ",", "~"),
        "plains": lambda: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "~"),
    }
    return F.coalesce(forms[kind](), F.lit("~"))


def table_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and an order-free checksum of the whole content of every domain table, from one pass each."""
    parts = []
    for name, kinds in CONTENT.items():
        text = F.concat_ws("|", *(_as_text(kind, F.col(c)) for kind, names in kinds.items() for c in names.split()))
        part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        rows = table(spark, sf_dir, name).select(part.alias("part"))
        parts.append(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("part").alias("checksum")).select(F.lit(name).alias("name"), "n_rows", "checksum"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stream_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra and highest number of peaks of each molecule, kept up to date by a stream over train's files."""
    s = file_stream(spark, f"{sf_dir}/train.parquet").select(single_key(F.col("inchikey")).alias("inchikey"), "num_peaks").where("inchikey IS NOT NULL")
    state = s.groupBy("inchikey").agg(F.count(F.lit(1)).alias("n_spectra"), F.max("num_peaks").alias("most_peaks"))
    return run_to_end(state, ["inchikey"], f"molecules-{uuid.uuid4().hex}", "count and most peaks by single key")


def stream_acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra per library and window of 30 days of acquisition, from a stream with late rows."""
    s = file_stream(spark, f"{sf_dir}/train.parquet").select(F.col("acquired_at").cast("timestamp").alias("acquired_at"), "ingest_lib").where("acquired_at IS NOT NULL")
    windows = windowed_counts(s, "acquired_at", "30 days", "3650 days", "ingest_lib")
    counts = run_to_end(windows, ["w", "ingest_lib"], f"acquisitions-{uuid.uuid4().hex}", "rows by 30 days and library")
    return counts.select(F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("starts"), "ingest_lib", "n")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their summed value per type and hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("starts"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: sessions of events set off by pauses of more than a day, and the longest one's events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    per = W.partitionBy("user_id").orderBy("t", "event_id")
    begins = (F.col("t") - F.lag("t").over(per) > 86_400_000_000) | F.lag("t").over(per).isNull()
    numbered = e.withColumn("b", begins.cast("int")).withColumn("s", F.sum("b").over(per))
    sizes = numbered.groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings of every one whose id is divisible by 100, against all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return block_search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, blocks)


def window_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of every spectrum up to its precursor, as square roots of relative intensity; of more than 128 those that ``diverse_peaks`` keeps."""
    ps = pk.peaks(F.col("ms2_mzs"), F.col("ms2_intensities"))
    upto = pk.keep_relative(F.filter(ps, lambda p: p["mz"] <= F.col("precursor_mz") + 1.5), 0.001)
    t = table(spark, sf_dir, "train").where(F.size(ps) > 0).select("spectrum_id", upto.alias("ps")).where(F.size("ps") > 0)
    return diverse_peaks(t).select("spectrum_id", "n_peaks", F.round("total", 5).alias("total"))


def diverse_peaks(t: DataFrame, cap: int = 128, per_window: int = 8, width: float = 50.0) -> DataFrame:
    """``n_peaks`` and ``total``, the sum of square roots, of ``ps`` per ``spectrum_id``.

    Up to ``cap`` peaks a list is whole and stays where it lies. Of a longer one the ``per_window`` highest of each window
    come first, then the others by intensity, up to ``cap`` (so what the windows leave free is filled again).
    """
    total = F.aggregate("ps", F.lit(0.0), lambda a, p: a + F.sqrt(p["i"]))
    whole = t.where(F.size("ps") <= cap).select("spectrum_id", F.size("ps").cast("long").alias("n_peaks"), total.alias("total"))
    p = t.where(F.size("ps") > cap).select("spectrum_id", F.explode("ps").alias("p")).withColumn("window", F.floor(F.col("p.mz") / width))
    rank = F.row_number().over(W.partitionBy("spectrum_id", "window").orderBy(F.desc("p.i"), "p.mz"))
    first = F.when(F.col("k") <= per_window, 0).otherwise(1)
    place = F.row_number().over(W.partitionBy("spectrum_id").orderBy(first, F.desc("p.i"), "p.mz"))
    kept = p.withColumn("k", rank).withColumn("place", place).where(F.col("place") <= cap)
    return whole.unionByName(kept.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("n_peaks"), F.sum(F.sqrt("p.i")).alias("total")))


# The most atoms of each element besides carbon and hydrogen, below 500 Da and from there on.
MOST_ATOMS = {"S": (2, 4), "P": (2, 5), "O": (11, 23), "N": (9, 17)}
HEAVY_FROM = 500.0


def formula_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best formulas of C, H, N, O, P and S within 20 ppm of each query's mass that keep the composition rules."""
    q = ident.masses(ident.queries_with_mass(spark, sf_dir)).where("neutral_mass > 0").select("query_id", F.col("neutral_mass").alias("m"))
    # Few rows become many, so they are spread by a fixed number of partitions, which isn't made smaller.
    spread = q.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")
    return rk.top_k(formulas_near(spread, most_atoms=MOST_ATOMS), "query_id", [F.asc("ppm"), F.asc("formula")], 50)


def formulas_near(q: DataFrame, ppm: float = 20.0, most_atoms: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``query_id``, ``formula``, ``ppm``: every formula of C, H, N, O, P and S within ``ppm`` of the mass ``m`` that keeps the composition rules.

    S, P, O and N go as far as the mass and the rules allow, or up to ``most_atoms`` (below HEAVY_FROM and from there on): each of
    their atoms needs its share of a carbon and each carbon a tenth of a hydrogen at least. Hydrogen follows from what is left, is at most 3.2 a carbon and bounded by the unsaturation.
    """
    w = chem.ELEMENT_MASS
    unit, room = w["C"] + 0.1 * w["H"], 1e-6
    per_carbon = {"S": 0.8, "P": 0.4, "O": 1.5, "N": 1.5}
    q = q.select("query_id", "m", (F.col("m") * (1 + ppm / 1e6)).alias("left"), F.lit(0.0).alias("carbons"))
    for e, share in per_carbon.items():
        n = F.col(e.lower())
        bound = F.when(F.col("m") < HEAVY_FROM, most_atoms[e][0]).otherwise(most_atoms[e][1]) if most_atoms else F.lit(None)
        most = F.least(F.col("left") / (w[e] + unit / share), (F.col("left") - F.col("carbons") * unit) / w[e], bound.cast("double"))
        q = q.withColumn(e.lower(), F.explode(F.sequence(F.lit(0), F.greatest(F.floor(most + room), F.lit(0)).cast("int"))))
        q = q.withColumns({"left": F.col("left") - n * w[e], "carbons": F.greatest("carbons", n / share)})
    low = F.col("left") - F.col("m") * (2 * ppm / 1e6)
    least = F.greatest(F.lit(1.0), F.col("carbons"), low / (w["C"] + 3.2 * w["H"]), (low - w["H"] * (3 + F.col("n") + F.col("p"))) / (w["C"] + 2 * w["H"]))
    least, most = F.ceil(least - room).cast("int"), F.floor(F.col("left") / unit + room).cast("int")
    q = q.where(least <= most).withColumn("c", F.explode(F.sequence(least, most)))
    heavy = sum((F.col(e.lower()) * w[e] for e in "NOPS"), F.col("c") * w["C"])
    q = q.withColumn("heavy", heavy).withColumn("h", F.round((F.col("m") - F.col("heavy")) / w["H"]).cast("int"))
    q = q.withColumn("ppm", F.abs(F.col("heavy") + F.col("h") * w["H"] - F.col("m")) / F.col("m") * 1e6).where((F.col("h") >= 0) & (F.col("ppm") <= ppm))
    counts = F.map_from_arrays(F.array(*(F.lit(e) for e in "CHNOPS")), F.array(*(F.col(e) for e in "chnops")))
    q = q.where(chem.formula_verdict(counts) == "valid")
    return q.select("query_id", chem.hill_formula(counts).alias("formula"), F.round("ppm", 4).alias("ppm"))


def isomer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per catalog formula: entries, connectivities and sources."""
    c = table(spark, sf_dir, "candidates").where("formula IS NOT NULL")
    return c.groupBy("formula").agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct("inchikey14").alias("n_blocks"), F.max(F.size("source")).alias("most_sources"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 5 wrong candidates of each query: isomers of the truth first, then candidates of near mass, in the order of a digest."""
    c = ident.catalog(spark, sf_dir).select("candidate_id", "inchikey", "exact_mass")
    f = table(spark, sf_dir, "candidates").select("candidate_id", "formula")
    truth = c.join(f, "candidate_id").select(F.col("inchikey").alias("true_inchikey"), F.col("formula").alias("true_formula"))
    q = ident.masses(ident.queries_with_mass(spark, sf_dir)).where("neutral_mass > 0").join(truth, "true_inchikey")
    near = bj.band_join(q, F.array(bj.window(F.col("neutral_mass"), 100.0)), c, "exact_mass").join(f, "candidate_id")
    near = near.where("inchikey != true_inchikey")
    tier = F.when(F.col("formula") == F.col("true_formula"), 1).otherwise(2)
    drawn = F.md5(F.concat_ws("/", "query_id", F.col("candidate_id").cast("string")))
    ranked = rk.top_k(near.withColumns({"tier": tier, "drawn": drawn}), "query_id", [F.asc("tier"), F.asc("drawn")], 5)
    return ranked.select("query_id", "candidate_id", "tier", "rank")


def routed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mass ranking, with the library's best molecule put first where its cosine is at least 0.45."""
    hits = ident.direct_hits(spark, sf_dir).withColumn("cosine", F.round("direct", 6))
    best = rk.top_k(hits.where("cosine >= 0.45"), "query_id", [F.desc("cosine"), F.asc("inchikey")], 1).select("query_id", F.col("inchikey").alias("hit"))
    scored = ident._mass_scores(spark, sf_dir).join(best, "query_id", "left")
    first = F.coalesce(F.col("inchikey") == F.col("hit"), F.lit(False))
    ranked = rk.top_k(scored.withColumn("first", first), "query_id", [F.desc("first"), F.desc("score"), F.asc("candidate_id")])
    return ranked.select("query_id", "candidate_id", "first", "rank")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each query with the features that rankings learn from, and whether they are right."""
    f = ident._fused(spark, sf_dir)
    per = W.partitionBy("query_id")
    return f.select(
        "query_id", "candidate_id", "true_inchikey", "ppm", "direct", "analog", "score",
        F.size("source").cast("double").alias("n_sources"),
        (F.col("score") - F.max("score").over(per)).alias("to_best"),
        F.log(F.count(F.lit(1)).over(per).cast("double")).alias("log_pool"),
        (F.col("inchikey") == F.col("true_inchikey")).cast("double").alias("label"),
    )


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that a candidate is right, by a logistic fit to its fused score."""
    return calibrated(_features(spark, sf_dir), "score", "label").select("query_id", "candidate_id", F.round("probability", 6).alias("probability"))


def meta_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates ranked by boosted trees that never saw the query's molecule (folds by molecule)."""
    names = ["ppm", "direct", "analog", "n_sources", "to_best", "log_pool"]
    folded = group_folds(_features(spark, sf_dir), "true_inchikey", 3)
    scored = meta_ranked(folded, names, "label", 3)
    return rk.top_k(scored, "query_id", [F.desc("probability"), F.asc("candidate_id")]).select("query_id", "candidate_id", F.round("probability", 6).alias("probability"), "rank")


QUERIES = {
    f.__name__: f
    for f in (
        msp_round_trip, mgf_round_trip, table_manifest, stream_molecules, stream_acquisitions, event_windows, user_sessions,
        embedding_neighbours, window_peaks, formula_search, isomer_counts, hard_negatives, routed_ranking, calibrated_scores, meta_ranking,
    )
}

_NUMBER = "TRY_CAST(floor({0}::DOUBLE * 1000) AS BIGINT)::VARCHAR"
_TEXT = {
    "plain": "{0}::VARCHAR", "number": _NUMBER, "time": "epoch_us({0})::VARCHAR", "numbers": "array_to_string(list_transform({0}, lambda x: coalesce(" + _NUMBER.replace("{0}", "x") + ", '~')), ',')",
    "plains": "array_to_string(list_transform({0}, lambda x: coalesce(x::VARCHAR, '~')), ',')",
}


def _manifest_sql(name: str, kinds: dict[str, str]) -> str:
    text = ", ".join(f"coalesce({_TEXT[kind].format(c)}, '~')" for kind, names in kinds.items() for c in names.split())
    return f"SELECT '{name}' AS name, count(*) AS n_rows, sum(('0x' || left(md5(concat_ws('|', {text})), 8))::BIGINT)::BIGINT AS checksum FROM {name}"


_VALID = """c > 0 AND (h + n + p) % 2 = 0 AND c + 1 - h / 2.0e0 + n / 2.0e0 + p / 2.0e0 BETWEEN -0.5 AND 40 AND h / c >= 0.1 AND h / c <= 3.2 AND n / c <= 1.5 AND o / c <= 1.5
 AND p / c <= 0.4 AND s / c <= 0.8 AND c * 4 + h + n * 5 + o * 2 + p * 5 + s * 6 >= 2 * (CASE WHEN s > 0 THEN 6 WHEN p > 0 OR n > 0 THEN 5 ELSE 4 END)"""

SQL = {
    "msp_round_trip": """SELECT spectrum_id, nullif(trim(inchikey), '') AS inchikey, round(precursor_mz, 4) AS precursor_mz, len(peaks_mz)::INT AS num_peaks, len(peaks_mz)::INT AS n_read
 FROM external_spectra WHERE len(peaks_mz) = len(peaks_intensity) AND len(peaks_mz) > 0""",
    "mgf_round_trip": """SELECT spectrum_id, coalesce(nullif(regexp_extract(precursor_type, '(\\[[^\\]]+\\]\\d*[+-])', 1), ''), '[M+H]+') AS adduct, round(precursor_mz, 4) AS precursor_mz,
 len(peaks_mz)::INT AS n_read, round(list_max(peaks_intensity)::DOUBLE, 2) AS highest FROM external_spectra WHERE len(peaks_mz) = len(peaks_intensity) AND len(peaks_mz) > 0""",
    "table_manifest": " UNION ALL ".join(_manifest_sql(t, k) for t, k in CONTENT.items()),
    "stream_molecules": """WITH t AS (SELECT list_distinct(regexp_extract_all(upper(inchikey), '\\b([A-Z]{14}-[A-Z]{10}-[A-Z])\\b', 1)) AS ks, num_peaks FROM train)
 SELECT ks[1] AS inchikey, count(*) AS n_spectra, max(num_peaks) AS most_peaks FROM t WHERE len(ks) = 1 GROUP BY 1""",
    "stream_acquisitions": """SELECT (floor(epoch(acquired_at) / 2592000) * 2592000)::BIGINT AS starts, ingest_lib, count(*) AS n FROM train WHERE acquired_at IS NOT NULL GROUP BY 1, 2""",
    "event_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS starts, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "user_sessions": """WITH g AS (SELECT user_id, event_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 86400000000, true) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT user_id, sum(b::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
 SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY 1""",
    "embedding_neighbours": """WITH p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
 FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC NULLS LAST, other) AS rank FROM p) SELECT vec_id, other, cosine, rank FROM r WHERE rank <= 10""",
    "window_peaks": """WITH p AS (SELECT spectrum_id, precursor_mz, unnest(ms2_mzs) AS mz, unnest(ms2_intensities) AS i FROM train WHERE len(ms2_mzs) = len(ms2_intensities) AND len(ms2_mzs) > 0),
 n AS (SELECT *, i / max(i) OVER (PARTITION BY spectrum_id) AS r FROM p WHERE mz <= precursor_mz + 1.5),
 k AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id, floor(mz / 50) ORDER BY r DESC, mz) AS k, count(*) OVER (PARTITION BY spectrum_id) AS size FROM n WHERE r >= 0.001),
 o AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY k > 8, r DESC, mz) AS place FROM k)
 SELECT spectrum_id, count(*) AS n_peaks, round(sum(sqrt(r)), 5) AS total FROM o WHERE size <= 128 OR place <= 128 GROUP BY 1""",
    "formula_search": ident._Q
    + f"""b AS (SELECT query_id, m, m * (1 + 20.0e0 / 1e6) AS top, CASE WHEN m < 500 THEN 2 ELSE 5 END AS mp, CASE WHEN m < 500 THEN 2 ELSE 4 END AS ms, CASE WHEN m < 500 THEN 9 ELSE 17 END AS mn,
  CASE WHEN m < 500 THEN 11 ELSE 23 END AS mo FROM q WHERE m > 0),
 g AS (SELECT query_id, m, top, p, s, n, o, top - p * 30.97376199842e0 - s * 31.9720711744e0 - n * 14.00307400443e0 - o * 15.99491461957e0 AS l
  FROM b JOIN range(0, 6) a1(p) ON p <= mp JOIN range(0, 5) a2(s) ON s <= ms JOIN range(0, 18) a3(n) ON n <= mn JOIN range(0, 24) a4(o) ON o <= mo
  WHERE p * 30.97376199842e0 + s * 31.9720711744e0 + n * 14.00307400443e0 + o * 15.99491461957e0 <= top),
 cc AS (SELECT *, unnest(range(1, (floor(l / 12.0e0) + 1)::BIGINT)) AS c FROM g WHERE l >= 12),
 hh AS (SELECT *, c * 12.0e0 + n * 14.00307400443e0 + o * 15.99491461957e0 + p * 30.97376199842e0 + s * 31.9720711744e0 AS heavy FROM cc),
 e AS (SELECT *, round((m - heavy) / 1.00782503223e0)::INT AS h FROM hh),
 f AS (SELECT query_id, abs(heavy + h * 1.00782503223e0 - m) / m * 1e6 AS ppm, 'C' || CASE WHEN c > 1 THEN c::VARCHAR ELSE '' END || CASE WHEN h = 0 THEN '' WHEN h = 1 THEN 'H' ELSE 'H' || h END
  || CASE WHEN n = 0 THEN '' WHEN n = 1 THEN 'N' ELSE 'N' || n END || CASE WHEN o = 0 THEN '' WHEN o = 1 THEN 'O' ELSE 'O' || o END || CASE WHEN p = 0 THEN '' WHEN p = 1 THEN 'P' ELSE 'P' || p END
  || CASE WHEN s = 0 THEN '' WHEN s = 1 THEN 'S' ELSE 'S' || s END AS formula FROM e WHERE h >= 0 AND {_VALID}),
 r_ AS (SELECT query_id, formula, round(ppm, 4) AS ppm, row_number() OVER (PARTITION BY query_id ORDER BY round(ppm, 4), formula) AS rank FROM f WHERE ppm <= 20)
 SELECT query_id, formula, ppm, rank FROM r_ WHERE rank <= 50""",
    "isomer_counts": "SELECT formula, count(*) AS n_entries, count(DISTINCT inchikey14) AS n_blocks, max(len(source))::INT AS most_sources FROM candidates WHERE formula IS NOT NULL GROUP BY 1",
    "hard_negatives": ident._Q
    + """tr AS (SELECT c.inchikey AS true_inchikey, d.formula AS true_formula FROM c JOIN candidates d USING (candidate_id)),
 g AS (SELECT query_id, c.candidate_id, CASE WHEN d.formula = true_formula THEN 1 ELSE 2 END AS tier, md5(query_id || '/' || c.candidate_id) AS drawn
  FROM q JOIN tr USING (true_inchikey) JOIN c ON c.mass BETWEEN m * (1 - 100.0e0 / 1e6) AND m * (1 + 100.0e0 / 1e6) JOIN candidates d ON d.candidate_id = c.candidate_id
  WHERE m > 0 AND c.inchikey <> q.true_inchikey),
 r_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, drawn) AS rank FROM g) SELECT query_id, candidate_id, tier, rank FROM r_ WHERE rank <= 5""",
    "routed_ranking": ident._Q
    + ident._BINS
    + """b AS (SELECT query_id, inchikey AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(direct, 6) DESC, inchikey) AS k FROM d WHERE round(direct, 6) >= 0.45) WHERE k = 1),
 g AS (SELECT query_id, candidate_id, coalesce(inchikey = hit, false) AS first, score FROM s LEFT JOIN b USING (query_id)),
 r_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, score DESC, candidate_id) AS rank FROM g) SELECT query_id, candidate_id, first, rank FROM r_ WHERE rank <= 25""",
}
