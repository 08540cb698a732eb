"""Preparation and pipeline operators against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window as W, functions as F

import __spark_entry__ as entry
from massloom.functions import chem, peaks as pk
from massloom.operators import bandjoin as bj, similarity as sim
from massloom.operators.similarity import near_identical, whole_vectors
from massloom.plans.pipeline import calibrated_parts, plain_evidence, sure_bonus
from massloom.plans.preparation import observed_mass, stratified

ADDUCTS = "adduct string, n_m int, adds double, losses double, charge int, sgn int"


def test_near_identical_loses_no_pair(spark):
    rng = random.Random(3)
    base = [[(rng.uniform(20, 60), rng.uniform(1, 100)) for _ in range(rng.randint(1, 12))] for _ in range(25)]
    near = [[(m, i * rng.uniform(0.96, 1.04)) for m, i in ps] for ps in base]
    flat = [[(30.5, 1.0), (31.5, 1.0 + e)] for e in (0.0, 0.01, 0.02, -0.02)]
    lists = base + near + flat + [base[0], None, [], [(25.0, 0.0)]]
    df = spark.createDataFrame([(k, ps) for k, ps in enumerate(lists)], "id int, ps array<struct<mz:double,i:double>>")
    v = whole_vectors(df, "id", "ps").withColumn("digest", F.col("id").cast("string")).withColumn("slot", F.lit("other"))
    vectors = {r["id"]: {x["bin"]: x["v"] for x in r["vec"]} for r in v.collect()}
    assert set(vectors) == set(range(len(base) * 2 + len(flat) + 1))
    cosine = lambda a, b: round(sum(x * b.get(k, 0.0) for k, x in a.items()), 6)
    want = {(str(a), str(b)) for a in vectors for b in vectors if cosine(vectors[a], vectors[b]) >= 0.999}
    got = [(r["digest_a"], r["digest_b"]) for r in near_identical(v, v).collect()]
    assert sorted(got) == sorted(want) and len(want) > len(vectors)
    assert near_identical(v.limit(0), v).count() == 0


@pytest.mark.parametrize("folds", [2, 5])
def test_stratified_folds_are_even(spark, folds):
    rows = [(i, ["a", "b", None][i % 7 % 3], "x") for i in range(300)]
    got = stratified(spark.createDataFrame(rows, "id int, s string, fold_name string"), "s", "id", folds).collect()
    assert len(got) == 300 and {r["fold_name"] for r in got} == {"x"}
    for s in ("a", "b", None):
        sizes = Counter(r["fold"] for r in got if r["s"] == s)
        assert set(sizes) == set(range(folds)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert stratified(spark.createDataFrame([], "id int, s string"), "s", "id").count() == 0


def test_observed_mass_falls_back(spark):
    rows = [(100.0, "[M+H]+"), (100.0, " [M+H] + "), (100.0, "unknown"), (100.0, None), (0.5, None), (None, "[M+H]+"), (float("nan"), "[M+H]+")]
    df = spark.createDataFrame([(i, *r, 7) for i, r in enumerate(rows)], "k int, precursor_mz double, adduct string, sgn int")
    got = {r["k"]: r for r in observed_mass(df, spark.createDataFrame([("[M+H]+", 1, 1.00782503223, 0.0, 1, 1)], ADDUCTS)).collect()}
    assert [got[k]["mass_by"] for k in range(6)] == ["adduct", "adduct", "precursor", "precursor", None, None]
    assert got[0]["mass"] == pytest.approx(100 + chem.ELECTRON_MASS - 1.00782503223) and got[2]["mass"] == pytest.approx(98.992175)
    assert got[4]["mass"] is None and got[5]["mass"] is None and got[0]["sgn"] == 7 and len(got) == 7


def test_cleaned_lists(spark):
    def clean(ps):
        return spark.createDataFrame([(ps,)], "ps array<struct<mz:double,i:double>>").select(pk.cleaned(F.col("ps"))).first()[0]

    got = clean([(50.0, 4.0), (51.00335, 4.0), (60.0, 9.0), (70.0, 16.0)])
    assert [p["mz"] for p in got] == [50.0, 60.0, 70.0]
    assert [p["i"] for p in got] == pytest.approx([x / math.sqrt(29) for x in (2, 3, 4)])
    assert clean([(50.0, 4.0), (51.00335, 3.0), (60.0, 9.0)]) is None and clean(None) is None and clean([]) is None
    assert clean([(50.0, 0.0), (60.0, 0.0), (70.0, 0.0)]) is None
    many = clean([(100.0 + 2 * i, 1.0 + i) for i in range(500)])
    assert len(many) == 60 and many[0]["mz"] == 100.0 + 2 * 440


def pool(spark, masses, queries, enough=25):
    c = spark.createDataFrame([(i, float(m), 1) for i, m in enumerate(masses)], "candidate_id int, exact_mass double, bucket int")
    q = spark.createDataFrame(queries, "query_id string, neutral_mass double")
    out = {}
    for r in bj.pipeline_pool(q, c, enough=enough).collect():
        out.setdefault(r["query_id"], {})[r["candidate_id"]] = r["tier_weight"]
    return out


def test_pipeline_pool_widens_until_enough(spark):
    m = 500.0
    ppm = lambda x: m * (1 + x / 1e6)
    masses = [ppm(1), ppm(-5), ppm(30), ppm(-40), ppm(80), m - 1.003355, m + 1.003355, 100.0, 900.0]
    ask = lambda k: pool(spark, masses, [("q", m), ("null", None), ("zero", 0.0)], k)
    assert ask(2) == {"q": dict.fromkeys((0, 1), 1.0)}
    assert ask(4) == {"q": dict.fromkeys(range(4), 0.5)}
    assert ask(5) == {"q": dict.fromkeys(range(5), 0.25)}
    assert ask(6) == {"q": dict.fromkeys(range(6), 0.25)}
    assert ask(7) == {"q": dict.fromkeys(range(9), 0.1)}
    assert pool(spark, [m - 1.003355] * 3, [("q", m)], 3) == {"q": dict.fromkeys(range(3), 0.5)}
    assert pool(spark, [], [("q", m)]) == {} and pool(spark, [m, m], [("q", m)]) == {"q": {0: 0.1, 1: 0.1}}


def test_scores_at_their_bounds(spark):
    df = spark.createDataFrame([(0.7, 4), (0.7, 3), (0.69, 9), (0.05, 6), (0.0, 0)], "c double, n int")
    got = df.select(sure_bonus(F.col("c"), F.col("n")), plain_evidence(F.col("c"), F.col("n"))).collect()
    assert [r[0] for r in got] == pytest.approx([2.4, 0, 0, 0, 0])
    raw = 0.769 * 0.7 + 0.231 * 4 / 6
    assert got[0][1] == pytest.approx(4.5 * raw * raw) and got[3][1] == 0 and got[4][1] == 0
    parts = calibrated_parts(F.lit(1.4), F.lit(-10.0), F.lit(2), F.lit(-99.0), weights=(1.0, 1.0, 2.0))
    row = spark.range(1).select(*(c.alias(n) for n, c in parts.items())).first()
    assert row["by_library"] == 1.0 and row["by_mass"] == pytest.approx(0.5 / math.e) and row["by_score"] == pytest.approx(1 / (1 + math.exp(15)))
    assert row["fusion"] == pytest.approx(0.25 + 0.125 / math.e + 0.5 / (1 + math.exp(15)))


@pytest.mark.parametrize("name", ["bit_scores", "direct_search", "fused_ranking", "threshold_sweep", "two_best_blend"])
def test_pairs_of_spectra_are_not_shuffled(spark, name):
    """Pairs grow as queries times spectra: they are reduced in the task where they meet."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "bin#" not in plan and not re.search(r"Aggregate \[query_id#\d+, spectrum_id#", plan)


def test_fused_score_reads_the_library_once(spark, monkeypatch):
    from massloom.plans import identification as ident

    asked, library = [], ident.library
    monkeypatch.setattr(ident, "library", lambda *a: asked.append(a) or library(*a))
    ident._fused(spark, "/root/testdata/sf0.001")
    assert len(asked) == 1


@pytest.mark.parametrize("name", ["bit_scores"])
def test_pairs_with_candidates_are_not_shuffled(spark, name):
    """Nothing but projections follows the operator that makes the pairs of queries and candidates."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString().splitlines()
    first = next(i for i, line in enumerate(plan) if "InArrow" in line)
    assert all("Project" in line for line in plan[:first])


def test_bits_in_pools_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sim, "ASKING_A_POOL", 1)  # the cell of several queries is cut
    span = lambda *w: [{"lo": float(lo), "hi": float(hi)} for lo, hi in w]
    asked = [("a", span((99, 99.1), (99.95, 100.05), (101, 101.1))), ("b", span((99.2, 104.0))), ("c", span((99.95, 100.05))), ("none", None), ("empty", []), ("far", span((900, 901)))]
    q = spark.createDataFrame(asked, "query_id string, windows array<struct<lo:double,hi:double>>")
    rows = [(1, 99.95, [5, -1]), (2, 100.05, [5, -1]), (3, 100.0, None), (4, 99.05, [3]), (5, 101.05, [0, 7]), (6, 99.5, [1, 2]), (7, 103.9, [6, 0]), (8, None, [1]), (9, 500.0, [1]), (10, 100.06, [9, 9])]
    c = spark.createDataFrame(rows, "candidate_id bigint, x double, fp array<bigint>")
    h = spark.createDataFrame([("a", 0.9, [5, 0]), ("a", 0.2, [1, 7]), ("a", 0.1, None), ("b", 0.0, [1, 1]), ("c", 0.5, [3, 3]), ("far", 1.0, [1])], "query_id string, strength double, hit_fp array<bigint>")
    got = sim.bits_in_pools(q, h, c, "x")
    pairs = q.select("query_id", F.explode("windows").alias("w")).join(c, F.col("x").between(F.col("w.lo"), F.col("w.hi"))).select("query_id", "candidate_id", "fp")
    per = W.partitionBy("query_id")
    want = sim.analog_agreement(pairs, h).withColumn("r", F.round("bits", 9)).select(
        "query_id", "candidate_id", "bits", "size", F.avg("bits").over(per), F.stddev_pop("bits").over(per), F.min("bits").over(per), F.max("bits").over(per),
        F.avg(F.col("bits") / F.col("size")).over(per), F.stddev_pop(F.col("bits") / F.col("size")).over(per), F.count("*").over(per),
        F.row_number().over(per.orderBy(F.desc("r"), "candidate_id")), F.rank().over(per.orderBy(F.desc("r"))),
    )
    key = lambda df: {(r[0], r[1]): list(r)[2:] for r in df.collect()}
    got, want = key(got), key(want)
    assert {q: sorted(c for p, c in got if p == q) for q in "abc"} == {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 5, 6, 7, 10], "c": [1, 2, 3]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
