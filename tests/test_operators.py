"""Operators against brute force on small tables, with nulls, ties, repeated rows, empty tables and clashing names."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from massloom.functions import peaks as pk
from massloom.operators import bandjoin as bj, ranking as rk, similarity as sim
from massloom.operators.heavy_keys import heavy_share, heavy_keys, per_key_summary, skew_join
from massloom.operators.impute import completed, filled_fields, held_out_accuracy, unanimous_fills

SCHEMA = "key string, v double, s double, hk_key string, n_rows int, bucket int"


def summary(spark, rows, share=0.05):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return {r["key"]: (r["n_rows"], r["median"], r["seen_values"]) for r in per_key_summary(df, "key", "v", F.col("s"), share).collect()}


def test_per_key_summary_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot", round(rng.uniform(0, 3), 2), float(rng.randint(1, 3))) for _ in range(700)]
    rows += [(f"k{rng.randint(0, 60)}", round(rng.uniform(0, 900), 4), None) for _ in range(300)]
    rows += [(None, 1.0, 1.0), ("hot", None, None), ("lone", None, 5.0), ("nan", float("nan"), 1.0)] + rows[:5]
    got = summary(spark, rows)
    keys = {k for k, *_ in rows if k}
    assert set(got) == keys
    for k in keys:
        own = [r for r in rows if r[0] == k]
        vs = [v for _, v, _ in own if v is not None and v == v]
        assert got[k][0] == len(own)
        assert got[k][1] is None if not vs else got[k][1] == pytest.approx(median(vs))
        assert got[k][2] == sorted({s for *_, s in own if s is not None})


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([("a",)] * 90 + [(f"b{i}",) for i in range(10)] + [(None,)] * 500, "key string")
    assert [r[0] for r in heavy_keys(df, "key", 0.5).collect()] == ["a"]
    assert heavy_keys(df.limit(0), "key").count() == 0 and summary(spark, []) == {}


def test_heavy_share_follows_the_tasks(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        shares = []
        for n in ("8", "5000", "1000000"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            shares.append(heavy_share(spark.range(1)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert shares == [0.002, 0.0001, 0.00002]


def test_skew_join_keeps_all_rows(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("c", 3)], "k string, i int")
    side = spark.createDataFrame([("a", 1), ("b", 2)], "k string, w int")
    got = sorted((r["k"] or "", r["i"], r["w"]) for r in skew_join(rows, side, "k", 0.3).collect() if r["k"] != "a")
    assert got == [("", 2, None), ("b", 1, 2), ("c", 3, None)] and skew_join(rows, side, "k", 0.3).where("w = 1").count() == 50


K = "ABCDEFGHIJKLMN-UHFFFAOYSA-N"
TRAIN = "spectrum_id long, session_id long, inchikey string, precursor_mz double, adduct string, ionization_mode string, collision_energy double, n int, vals string"


def train(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TRAIN)


def test_unanimous_fills(spark):
    rows = [
        (1, 1, K, 100.0, "[M+H]+", "positive", 20.0),
        (2, 1, K, 100.01, None, "N/A", -1.0),  # all three can be closed
        (3, 1, K, 100.03, "M?", None, float("nan")),  # too far for the adduct
        (4, 2, K, 100.0, "[M+H]+", "pos", 20.0),
        (5, 2, K, 100.0, "[M+Na]+", "NEG", 30.0),
        (6, 2, K.lower(), 100.0, None, None, None),  # known values disagree
        (7, None, K, 100.0, None, None, None),  # no group
        (8, 3, f"{K} | {K[:13]}X-UHFFFAOYSA-N", 100.0, None, "p", 35.0),  # two keys
        (9, 3, None, None, "[M-H]-", None, None),
    ]
    got = sorted(tuple(r) for r in unanimous_fills(train(spark, rows)).collect())
    assert got == [
        (2, "adduct", "[M+H]+"), (2, "collision_energy", "20.0"), (2, "ionization_mode", "positive"),
        (3, "collision_energy", "20.0"), (3, "ionization_mode", "positive"),
        (9, "collision_energy", "35.0"), (9, "ionization_mode", "positive"),
    ]
    fills = {(r["spectrum_id"], r["field"]): (r["value"], r["filled_from"]) for r in filled_fields(train(spark, rows)).collect()}
    assert fills[7, "adduct"][1] == "model" and fills[6, "adduct"][0] in ("[M+H]+", "[M+Na]+")
    done = {r["spectrum_id"]: r for r in completed(train(spark, rows)).collect()}
    assert len(done) == 9 and done[1]["adduct_filled"] is None and done[2]["adduct_filled"] == "group"
    assert all(r[c] is not None for r in done.values() for c in ("adduct", "ionization_mode", "collision_energy"))


def test_imputation_edges(spark):
    assert filled_fields(train(spark, [])).count() == 0
    nothing = [(1, 1, None, None, None, None, None), (1, 1, None, None, None, None, None)]
    got = filled_fields(train(spark, nothing)).collect()
    assert len(got) == 6 and {r["value"] for r in got} == {None}


def test_model_fill_beats_chance(spark):
    """Where only the other fields of a record speak, the model finds the value that goes with them."""
    rng = random.Random(3)
    rows = [(i, 10_000 + i, None, None, *rng.choice([("[M+H]+", "positive"), ("[M-H]-", "negative")]), 20.0) for i in range(400)]
    held = {i: rows[i][4] for i in range(0, 400, 4)}
    rows = [r[:4] + (None,) + r[5:] if r[0] in held else r for r in rows]
    got = {r["spectrum_id"]: r["value"] for r in filled_fields(train(spark, rows)).where("field = 'adduct'").collect()}
    assert sum(got[i] == v for i, v in held.items()) >= 0.95 * len(held)


def test_every_valid_value_can_be_decoded(spark):
    """2,000 energies, each told by its session: none is lost to another one. Too many values are refused."""
    rows = [(i, i // 2, None, None, "[M+H]+", "positive", (i // 2 + 1) / 10 if i % 2 else None) for i in range(4000)]
    got = {r["spectrum_id"]: r["value"] for r in filled_fields(train(spark, rows)).where("field = 'collision_energy'").collect()}
    assert got == {i: f"{(i // 2 + 1) / 10:.1f}" for i in range(0, 4000, 2)}
    many = spark.range(20_000).selectExpr("id AS spectrum_id", "id AS session_id", "'x' AS inchikey", "1D AS precursor_mz", "concat('[M+', id, ']+') AS adduct", "'p' AS ionization_mode", "1D AS collision_energy")
    with pytest.raises(ValueError, match="more than"):
        filled_fields(many)


def test_factors_decide_where_the_group_disagrees(spark):
    """A session with both modes: the adduct of the record says which one is missing, whatever is commoner."""
    rng = random.Random(8)
    rows = [(i, i // 20, None, None, *((("[M+H]+", "positive"), ("[M-H]-", "negative"))[rng.random() < 0.3]), 20.0) for i in range(2000)]
    held = {i: rows[i][5] for i in range(0, 2000, 5)}
    rows = [r[:5] + (None,) + r[6:] if r[0] in held else r for r in rows]
    fills = {r["spectrum_id"]: r for r in filled_fields(train(spark, rows)).where("field = 'ionization_mode'").collect()}
    open_ones = {i: v for i, v in held.items() if fills[i]["n_values"] == 2}
    assert len(open_ones) > 350 and sum(fills[i]["value"] == v for i, v in open_ones.items()) >= 0.98 * len(open_ones)
    by_field = {r["field"]: r for r in held_out_accuracy(train(spark, rows)).collect()}
    assert by_field["ionization_mode"]["n_model_right"] > by_field["ionization_mode"]["n_commonest_right"]


def test_band_join_equals_brute_force(spark):
    rng = random.Random(5)
    masses = [rng.uniform(100, 104) for _ in range(200)] + [None, 101.0]
    asked = [(i, rng.uniform(100, 104), rng.choice([100.0, 101.004, 102.37])) for i in range(40)] + [(90, -5.0, 1.0), (91, None, None), (92, float("nan"), 1.0)]
    q = spark.createDataFrame(asked, "query_id int, m double, precursor double")
    c = spark.createDataFrame(list(enumerate(masses)), "candidate_id int, mass double")
    got = {(r["query_id"], r["candidate_id"]) for r in bj.band_join(q, bj.union_windows(F.col("m"), F.col("precursor")), c, "mass").collect()}
    joined = bj.band_join(q, bj.union_windows(F.col("m"), F.col("precursor")), c, "mass")
    assert joined.count() == len(got)
    step = 1.003354835
    want = set()
    for i, m, p in asked:
        if m is None or not m > 0:
            continue
        w = [(m * (1 - 1e-4), m * (1 + 1e-4))] + [((m + s) * (1 - 3e-5), (m + s) * (1 + 3e-5)) for s in (step, -step)]
        w += [(m - 0.5, m + 0.5)] if abs(p - round(p)) <= 0.01 else []
        want |= {(i, j) for j, x in enumerate(masses) if x is not None and any(lo <= x <= hi for lo, hi in w)}
    assert got == want


def progressive_by_hand(m, rows, enough):
    """Weight per id, as stated: windows, then one isotope step off, then the nearest in the order of mass and id."""
    got = {}
    for ppm, weight in ((20, 1.0), (50, 0.7), (100, 0.4)):
        got = {i: weight for i, x in rows if abs(x - m) / m * 1e6 <= ppm}
        if len(got) >= enough:
            return got
    for c in (m - bj.ISOTOPE_STEP, m + bj.ISOTOPE_STEP):
        got = {i: 0.3 for i, x in rows if c > 0 and abs(x - c) <= c * 20e-6} | got
    if len(got) < enough:
        order = sorted((x, i) for i, x in rows)
        at = sum(x < m for x, _ in order)
        got = {i: 0.1 for _, i in order[max(0, at - 30) : at + 30]} | got
    return got


def test_progressive_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, round(rng.uniform(100, 400), 4)) for i in range(300)] + [(300 + i, 250.0 + i * 1e-4) for i in range(30)]
    rows += [(400 + i, 500.0 + i * 1e-3) for i in range(4)] + [(420 + i, 500.0 + bj.ISOTOPE_STEP) for i in range(21)] + [(450 + i, 320.5) for i in range(40)]
    asked = {"many": 250.0, "isotopes": 500.0, "few": 180.25, "lowest": 1.0, "highest": 900.0, "ties": 320.51, "equal": rows[7][1]}
    catalog = spark.createDataFrame([*rows, (999, None)], "candidate_id int, exact_mass double")
    queries = spark.createDataFrame([*asked.items(), ("none", None)], "query_id string, neutral_mass double")
    found = bj.progressive(queries, catalog).collect()
    got = {q: {r["candidate_id"]: r["weight"] for r in found if r["query_id"] == q} for q in asked}
    assert len(found) == sum(map(len, got.values()))
    assert got == {q: progressive_by_hand(m, rows, 25) for q, m in asked.items()}
    assert len(got["isotopes"]) == 25 and got["isotopes"][420] == 0.3 and len(got["highest"]) == 30
    assert bj.progressive(queries, catalog.limit(0)).count() == 0 and bj.progressive(queries.limit(0), catalog).count() == 0


def test_diverse_peaks(spark):
    from massloom.plans.library import diverse_peaks

    rng = random.Random(6)
    lists = {"small": [(100 + i * 0.1, 1.0) for i in range(128)], "one window": [(100 + i * 0.1, rng.choice([0.25, 0.5, 1.0])) for i in range(140)],
             "refilled": [(rng.uniform(50, 300), rng.random()) for _ in range(400)], "cut": [(rng.uniform(0, 2000), rng.random()) for _ in range(900)], "lone": [(5.0, 0.25)]}

    def by_hand(ps):
        order = sorted(ps, key=lambda p: (-p[1], p[0]))
        if len(ps) > 128:
            seen, first = {}, []
            for p in order:
                w = p[0] // 50
                seen[w] = seen.get(w, 0) + 1
                first += [p] if seen[w] <= 8 else []
            order = (first + [p for p in order if p not in set(first)])[:128]
        return len(order), sum(math.sqrt(i) for _, i in order)

    df = spark.createDataFrame(list(lists.items()), "spectrum_id string, ps array<struct<mz:double,i:double>>")
    got = {r["spectrum_id"]: (r["n_peaks"], r["total"]) for r in diverse_peaks(df).collect()}
    assert set(got) == set(lists) and got["small"] == (128, 128.0) and got["refilled"][0] == 128
    assert all(got[k] == pytest.approx(by_hand(ps)) for k, ps in lists.items())


def test_similarities(spark):
    a = [(100.0, 0.5), (200.0, 1.0), (300.0, 0.2)]
    b = [(110.0, 1.0)]
    df = spark.createDataFrame([(1, a, a, 0.0), (2, a, b, 0.0), (3, a, [], 0.0), (4, a, [(m + 5, i) for m, i in a], -5.0)], "k int, q array<struct<mz:double,i:double>>, r array<struct<mz:double,i:double>>, d double")
    got = {r["k"]: r["c"] for r in df.select("k", sim.modified_cosine(F.col("q"), F.col("r"), F.col("d")).alias("c")).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] == 0.0 and got[4] == pytest.approx(1.0)
    unit = df.select("k", pk.unit_length(F.col("q")).alias("q"), pk.unit_length(F.col("r")).alias("r"), "d")
    greedy = {r["k"]: (r["greedy_cosine"], r["n_matched"]) for r in sim.greedy_cosine(unit, "q", "r", "d").collect()}
    assert greedy[1] == (pytest.approx(1.0), 3) and greedy[3] == (0.0, 0) and greedy[4][0] == pytest.approx(1.0)
    taken = [(100.0, 1.0), (100.01, 1.0)], [(100.004, 1.0), (100.003, 1.0), (100.011, 1.0), (100.09, 1.0)]  # two ask for the first peak
    once = spark.createDataFrame([(1, *taken, None), (2, None, a, 1.0), (3, a, None, float("nan"))], "k int, q array<struct<mz:double,i:double>>, r array<struct<mz:double,i:double>>, d double")
    got = {r["k"]: (r["greedy_cosine"], r["n_matched"]) for r in sim.greedy_cosine(once, "q", "r", "d").collect()}
    assert got == {1: (1.0, 2), 2: (0.0, 0), 3: (0.0, 0)}
    shares = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.5), (2, 7, 1.0)], "q int, bin long, v double")
    same = sim.binned_entropy_similarity(shares, shares.withColumnRenamed("q", "r"), "q", "r").collect()
    assert {(r["q"], r["r"]) for r in same} == {(1, 1), (2, 2)} and all(r["similarity"] == pytest.approx(1.0) for r in same)


def test_tanimoto(spark):
    df = spark.createDataFrame([([3, 0], [1, 0]), ([0, 0], [0, 0]), ([-1, 5], [-1, 5])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(sim.tanimoto(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 1.0]


def test_metrics(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (30,)], "rank int")
    r = df.agg(*rk.ranking_metrics(F.col("rank"))).first()
    assert (r["n"], r["mrr"], r["hit_1"], r["hit_5"], r["hit_k"]) == (4, 0.375, 0.25, 0.5, 0.5)


def test_statistics_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 3.0)], "q string, x double")
    got = df.select("q", rk.z_score(F.col("x"), "q").alias("z"), rk.min_max(F.col("x"), "q").alias("m"), rk.rank_share([F.desc("x")], "q").alias("r")).collect()
    assert {(r["q"], r["z"], r["m"]) for r in got} == {("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", -1.0, 0.0), ("c", 1.0, 1.0)}
    assert [r["r"] for r in got if r["q"] == "a"] == [1.0] and math.isclose(sum(r["r"] for r in got if r["q"] == "c"), 1.0)


@pytest.mark.parametrize("neighbours, least, best, top", [(False, None, 2, None), (True, 0.15, 1, 3)])
def test_best_hits_of_many_cells(spark, monkeypatch, neighbours, least, best, top):
    for name, n in (("CELL", 8), ("ASKING", 5), ("HELD_AT_A_TIME", 3), ("ASKED_AT_A_TIME", 2)):
        monkeypatch.setattr(sim, name, n)
    rng = random.Random(4)
    peaks = lambda: [(20 + 0.01 * rng.randint(0, 12) + 0.004, float(rng.randint(1, 9))) for _ in range(4)] + [(5.0, 1.0)]
    lib = [(i, f"m{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}", 100 + rng.random(), peaks()) for i in range(60)] + [(90, "m1", 100.5, [(20.004, 0.0)]), (91, "m1", 100.5, [])]
    asked = [(f"q{i}", rng.randint(0, 59), 100 + rng.random(), peaks()) for i in range(14)]
    q = spark.createDataFrame([(k, s, m - 0.3, m + 0.3, b, p) for k, s, m, p in asked for b in (199, 200, 201) if m - 0.3 < (b + 1) / 2 and m + 0.3 >= b / 2],
        "query_id string, source_spectrum_id long, lo double, hi double, bucket long, ps array<struct<mz:double,i:double>>")
    r = spark.createDataFrame([(*x[:3], int(x[2] * 2), x[3]) for x in lib], "spectrum_id long, inchikey string, lib_mass double, bucket long, ps array<struct<mz:double,i:double>>")

    def vector(ps, around):
        size, v = math.sqrt(sum(i * i for _, i in ps)), {}
        for mz, i in ps:
            b = math.floor((mz - 20.0) / 0.01)
            if size and b >= 0:
                for k in around:
                    v[b + k] = v.get(b + k, 0) + i / size
        return {b: x for b, x in v.items() if b >= 0}

    want, count = {}, {}
    for k, s, m, p in asked:
        a, per = vector(p, (-1, 0, 1) if neighbours else (0,)), {}
        for i, key, mass, ps in lib:
            b = vector(ps, (0,))
            shared = a.keys() & b.keys()
            c = round(sum(a[x] * b[x] for x in shared), 9)
            if m - 0.3 <= mass <= m + 0.3 and i != s and shared and (least is None or c >= least):
                per.setdefault(key, []).append((-c, i))
        count |= {(k, key): len(x) for key, x in per.items()}
        kept = sorted((min(x), key) for key, x in per.items())
        kept = {key for _, key in sorted(((x[0], key) for x, key in kept))[:top]}
        want |= {(k, key): sorted(x)[:best] for key, x in per.items() if key in kept}
    got, n = {}, {}
    for h in sim.best_hits(q, r, neighbours, least, best, top, 9).collect():
        got.setdefault((h["query_id"], h["inchikey"]), []).append((-h["cosine"], h["spectrum_id"]))
        n[h["query_id"], h["inchikey"]] = n.get((h["query_id"], h["inchikey"]), 0) + h["n_supporting"]
    if top is None:
        assert n == count
    for k, key in want:  # each cell gives its own best; the best of them are those of all
        assert sorted(got[k, key])[:best] == [(pytest.approx(c), i) for c, i in want[k, key]]
