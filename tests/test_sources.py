"""Text formats, streams, purge and block search on small inline inputs."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from massloom.operators.blocks import block_search
from massloom.operators.dedup import best_per_group, hash_split, purge
from massloom.operators.learning import calibrated, group_folds, meta_ranked
from massloom.sources.spectra_text import read_mgf, read_msp, write_msp
from massloom.streaming.incremental import file_stream, run_to_end, windowed_counts

MSP = (
    "Name: Caffeine\r\nDB#: X1\r\nInChIKey: RYYVLZVUVIJVGH-UHFFFAOYSA-N\r\nPrecursor_type: [M+H]+\r\nPrecursorMZ: 195.0877\r\nCollision_energy: 10, 20 eV\r\n"
    'Comments: "SMILES=CN1C=NC2=C1C(=O)N(C)C(=O)N2C" "x=y"\r\nNum Peaks: 2\r\n138.0662 100\r\n110.0713\t40.5\r\n\r\n'
    "Name: No peaks\nNum Peaks: 0\n\nname: bare\nsmiles: CCO\nNum Peaks: 1\n 50.5 1e3\n\n\n"
)
MGF = (
    "BEGIN IONS\nPEPMASS=195.0877 12\nNAME=Caffeine [M+H]+\nSMILES=CCO\nIONMODE=Positive\nSPECTRUMID=S1\n138.0662 100\n110.0713 40\nEND IONS\n\n"
    "BEGIN IONS\nPEPMASS=100.5\nNAME=thing\nIONMODE=negative\nTITLE=S2\n50 1\nEND IONS\nBEGIN IONS\nSPECTRUMID=S3\nEND IONS\n"
)


def test_msp(spark, tmp_path):
    (tmp_path / "a.msp").write_bytes(MSP.replace("\r\n\r\n", "\n\n").encode())
    got = {r["name"]: r for r in read_msp(spark, str(tmp_path)).collect()}
    assert set(got) == {"Caffeine", "bare"}
    c = got["Caffeine"]
    assert (c["spectrum_id"], c["precursor_mz"], c["collision_energy"], c["num_peaks"]) == ("X1", 195.0877, 15.0, 2)
    assert c["smiles"].startswith("CN1C=NC2") and [p["i"] for p in c["peaks"]] == [100.0, 40.5]
    assert got["bare"]["smiles"] == "CCO" and got["bare"]["precursor_mz"] is None and got["bare"]["peaks"][0]["i"] == 1000.0


def test_msp_round_trip_with_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None, None, None, None, [(1.5, 2.0)]), ("b", "K", "C", 2.0, "[M]+", [(1.0, 0.5), (2.25, 1.0)])],
        "spectrum_id string, inchikey string, smiles string, precursor_mz double, adduct string, peaks array<struct<mz:double,i:double>>")
    write_msp(df, str(tmp_path / "o"))
    back = {r["spectrum_id"]: r for r in read_msp(spark, str(tmp_path / "o")).collect()}
    assert back["a"]["inchikey"] is None and back["b"]["precursor_mz"] == 2.0 and [tuple(p) for p in back["b"]["peaks"]] == [(1.0, 0.5), (2.25, 1.0)]


def test_mgf(spark, tmp_path):
    (tmp_path / "a.mgf").write_text(MGF)
    got = {r["spectrum_id"]: r for r in read_mgf(spark, str(tmp_path)).collect()}
    assert set(got) == {"S1", "S2"} and got["S1"]["adduct"] == "[M+H]+" and got["S2"]["adduct"] == "[M-H]-"
    assert got["S1"]["precursor_mz"] == 195.0877 and len(got["S1"]["peaks"]) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, f"2024-01-0{1 + i % 5} 00:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("t", F.to_timestamp("t"))
    df.repartition(6).write.parquet(str(tmp_path / "x.parquet"))
    counts = lambda d: d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    stream = file_stream(spark, str(tmp_path / "x.parquet"), files_per_batch=1)
    name = uuid.uuid4().hex
    run = lambda s: run_to_end(counts(s), ["k"], name, "counts")
    assert sorted(map(tuple, run(stream).collect())) == sorted(map(tuple, counts(df).collect()))
    assert sorted(map(tuple, run(stream).collect())) == sorted(map(tuple, counts(df).collect()))  # goes on with nothing new
    df.where("k = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "x.parquet"))
    assert sorted(map(tuple, run(stream).collect())) == [(0, 20), (1, 40), (2, 20)]  # the changed group is replaced, the others stay
    with pytest.raises(ValueError, match="computes 'counts'"):
        run_to_end(counts(stream), ["k"], name, "sums")
    late = windowed_counts(file_stream(spark, str(tmp_path / "x.parquet")), "t", "1 day", "10 days", "k")
    windows = run_to_end(late, ["w", "k"], uuid.uuid4().hex, "windows")
    assert windows.agg(F.sum("n")).first()[0] == 80 and windows.count() == 15


def test_purge_case(spark):
    lib = spark.createDataFrame([(1, "A", 20.0), (2, "A", 24.0), (3, "A", 40.0), (4, "B", 20.0), (5, "C", 1.0), (6, None, 1.0), (7, "A", None)], "id int, inchikey string, energy double")
    bench = spark.createDataFrame([("C1", "A", 20.0), ("C2", "C", None)], "query_group string, inchikey string, energy double")
    assert sorted(r["id"] for r in purge(lib, bench).collect()) == [3, 4, 6, 7]
    assert purge(lib.limit(0), bench).count() == 0 and purge(lib, bench.limit(0)).count() == 7


def test_purge_of_equal_peaks(spark):
    from massloom.functions.peaks import digests

    peaks = "mz array<double>, i array<double>"
    rows = [(1, "A", None, [50.0, 60.5], [1.0, 0.5]), (2, "A", 90.0, [50.0, 60.5], [7.0, 7.0]), (3, "A", 90.0, [50.0, 61.0], [1.0, 0.5]), (4, "B", None, [50.0, 60.5], [1.0, 0.5]),
            (5, None, None, [1.0], [1.0]), (6, "A", None, [], []), (7, "A", None, None, None), (8, None, None, [50.0, 60.5], [1.0, 0.5])]
    lib = spark.createDataFrame(rows, f"spectrum_id int, inchikey string, energy double, {peaks}")
    asked = [("C1", "A", 20.0, 8, [50.0, 60.5], [1.0, 0.5]), ("C1", "A", 20.0, None, [], [])]
    bench = spark.createDataFrame(asked, f"query_group string, inchikey string, energy double, source_spectrum_id int, {peaks}")
    told = lambda df: df.withColumn("digests", digests(F.col("mz"), F.col("i"))).drop("mz", "i")
    left = purge(told(lib), told(bench))
    assert sorted(r["spectrum_id"] for r in left.collect()) == [3, 4, 5, 6, 7] and left.columns == ["spectrum_id", "inchikey", "energy"]


def test_best_and_split(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("b", 4, None)], "k string, id int, n int")
    assert sorted(r["id"] for r in best_per_group(df, ["k"], [F.desc_nulls_last("n"), F.asc("id")]).collect()) == [1, 4]
    folds = hash_split(df, "k", 5).select("k", "fold").distinct().collect()
    assert len(folds) == 2 and all(0 <= r["fold"] < 5 for r in folds)


def test_block_search(spark):
    vectors = [[math.cos(a), math.sin(a)] for a in (0.0, 0.1, 0.2, 3.0)] + [[0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<float>")
    got = block_search(df.where("vec_id = 0"), df, "vec_id", "embedding", 3, 4).orderBy("rank").collect()
    assert [r["other"] for r in got] == [1, 2, 3]


def test_learning(spark):
    rows = [(f"g{i % 9}", float(i % 10), float(i % 10 > 5)) for i in range(180)]
    df = spark.createDataFrame(rows, "g string, x double, label double")
    p = {r["x"]: r["probability"] for r in calibrated(df, "x", "label").collect()}
    assert p[9.0] > 0.8 > 0.3 > p[0.0]
    same = calibrated(df.where("label = 1"), "x", "label").select("probability").distinct().collect()
    assert [r[0] for r in same] == [1.0] and calibrated(df.limit(0), "x", "label").count() == 0
    out = meta_ranked(group_folds(df, "g", 2), ["x"], "label", 2, trees=2).collect()
    assert len(out) == 180 and all((r["probability"] > 0.5) == (r["label"] == 1.0) for r in out)


def test_sinks_and_names(spark, tmp_path):
    import pytest

    from massloom.sources.sinks import manifest, write_counted, write_ordered_csv
    from massloom.sources.tables import require_columns, with_common_names

    df = spark.createDataFrame([(i, f"s{i}" if i % 3 else None) for i in range(30)], "k int, canonical_smiles string")
    counts = write_counted(df.where("k >= 5"), str(tmp_path / "t"), without=F.col("canonical_smiles").isNull())
    assert counts == {"rows": 25, "without": 8} and spark.read.parquet(str(tmp_path / "t")).count() == 25
    write_ordered_csv(df, "k", str(tmp_path / "c"))
    assert [r["k"] for r in spark.read.csv(str(tmp_path / "c"), header=True, inferSchema=True).orderBy("k").collect()] == list(range(30))
    assert manifest("t", counts, split="a") == '{"counts": {"rows": 25, "without": 8}, "split": "a", "table": "t"}'
    assert with_common_names(df).columns == ["k", "normalized_smiles"] and require_columns(df, "k") is df
    with pytest.raises(ValueError, match="nope"):
        require_columns(df, "nope")
