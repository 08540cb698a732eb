"""Keys, settings, formulas and peak lists against stated cases."""

import math

import pytest
from pyspark.sql import functions as F

from massloom.functions import chem, keys, peaks as pk, settings


def values(spark, texts, f, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t")).alias("x")).collect()]


K1, K2 = "ABCDEFGHIJKLMN-UHFFFAOYSA-N", "NMLKJIHGFEDCBA-UHFFFAOYSA-M"


def test_readable_keys(spark):
    texts = [K1, K1.lower(), f" InChIKey={K1}", f"\tinchikey:{K1} ", f"{K1} | {K2}", f"{K2};{K1}", f"{K1},{K1}", "N/A", "", None, K1[:-2], "X" + K1]
    got = values(spark, texts, keys.readable_keys)
    assert got == [[K1]] * 4 + [[K1, K2]] * 2 + [[K1]] + [[]] * 5
    assert values(spark, texts, keys.single_key)[4] is None


def test_short_key(spark):
    assert values(spark, ["abcdefghijklmn", " ABCDEFGHIJKLMN ", "ABC", "", None, K1], keys.short_key) == ["ABCDEFGHIJKLMN"] * 2 + [None] * 4


def test_settings(spark):
    assert values(spark, [20.0, 0.0, -1.0, 200.0, 9999.0, float("nan"), None], settings.known_energy, "double") == [20.0, None, None, 200.0, None, None, None]
    assert values(spark, [27.5, 10.0, None], settings.energy_text, "double") == ["27.5", "10.0", None]
    adducts = ["[M+H]+", " [M + 2H]2+ ", "[M]?", "M?", "N/A", "", None, "[M-H]-", "[M+H"]
    assert values(spark, adducts, settings.known_adduct) == ["[M+H]+", "[M+2H]2+", None, None, None, None, None, "[M-H]-", None]
    modes = ["Positive", " P", "NEG", "negative ", "N", "N/A", "not recorded", "unknown", "", None, "none"]
    assert values(spark, modes, settings.known_mode) == ["positive", "positive", "negative", "negative", "negative"] + [None] * 6


def test_formulas(spark):
    texts = ["C8H10N4O2", "C8H11N4O2", "C2H10", "C10H46", "", None, "Xx2", "C2H4C1", "c6h6"]
    mass = values(spark, texts, chem.formula_mass)
    assert mass[0] == pytest.approx(194.080376, abs=1e-5) and mass[4:7] == [None, None, None] and mass[8] is None
    verdicts = values(spark, texts, lambda c: chem.formula_verdict(chem.element_counts(c)))
    assert verdicts[0] == "valid" and verdicts[1] == "odd valence sum" and "valid" not in verdicts[2:4] and verdicts[4] is None
    assert values(spark, ["H4C2", "O2C1H0", "ClNa"], lambda c: chem.hill_formula(chem.element_counts(c))) == ["C2H4", "CO2", "ClNa"]
    assert values(spark, texts[:1], lambda c: chem.rdbe(chem.element_counts(c))) == [6.0]
    assert values(spark, ["C2H4C1"], lambda c: chem.element_counts(c)) == [{"C": 3, "H": 4}]


def test_adducts(spark):
    df = spark.createDataFrame([("[M+2H]2+",), ("[2M+Na]+",), ("[M-H2O-H]-",), ("[Cat]2+",), ("[M]0+",), ("[Mx]+",), ("[M]+",), (None,)], "adduct string")
    got = {r["adduct"]: r for r in chem.adduct_dimension(df).collect()}
    assert (got["[M+2H]2+"]["n_m"], got["[M+2H]2+"]["charge"]) == (1, 2)
    assert got["[M+2H]2+"]["adds"] == pytest.approx(2 * chem.ELEMENT_MASS["H"])
    assert (got["[2M+Na]+"]["n_m"], got["[2M+Na]+"]["sgn"]) == (2, 1)
    assert got["[M-H2O-H]-"]["losses"] == pytest.approx(19.01839, abs=1e-4)
    assert all(got[a]["n_m"] is None for a in ("[Cat]2+", "[M]0+", "[Mx]+")) and got["[M]+"]["adds"] == 0.0


def test_energy_text_and_bins(spark):
    assert values(spark, ["10, 20 eV", "35", "-5", "none", None, "10;20;60"], chem.energy_of_text) == [15.0, 35.0, 5.0, None, None, 20.0]
    assert values(spark, [12.5, 17.5, None, float("nan")], chem.energy_bin, "double") == [2, 4, -9999, -9999]


def peak_list(spark, mzs, xs, f):
    df = spark.createDataFrame([(mzs, xs)], "m array<double>, x array<double>")
    return df.select(f(pk.peaks(F.col("m"), F.col("x"))).alias("y")).first()[0]


def test_peak_lists(spark):
    m, x = [100.0, 101.00335, 200.0, 300.0], [10.0, 2.0, 40.0, 0.0]
    assert [p["i"] for p in peak_list(spark, m, x, pk.normalize)] == [0.25, 0.05, 1.0, 0.0]
    assert [p["mz"] for p in peak_list(spark, m, x, lambda p: pk.top_peaks(p, 2))] == [200.0, 100.0]
    assert [p["mz"] for p in peak_list(spark, m, x, pk.drop_isotopes)] == [100.0, 200.0, 300.0]
    assert [p["mz"] for p in peak_list(spark, m, x, lambda p: pk.drop_precursor(p, F.lit(200.4)))] == [100.0, 101.00335, 300.0]
    total = 52.0
    want = -sum(v / total * math.log(v / total) for v in (10, 2, 40))
    assert peak_list(spark, m, x, pk.spectral_entropy) == pytest.approx(want)
    weighted = peak_list(spark, m, x, pk.entropy_weighted)
    assert sum(p["i"] for p in weighted) == pytest.approx(1.0) and len(weighted) == 3
    assert math.hypot(*(p["i"] for p in peak_list(spark, m, x, pk.unit_length))) == pytest.approx(1.0)
    assert [p["i"] for p in peak_list(spark, [1.0, 1.004, 1.02], [1.0, 3.0, 2.0], pk.merged)] == [3.0, 2.0]


def test_peak_list_edges(spark):
    assert peak_list(spark, [], [], pk.normalize) == [] and peak_list(spark, [], [], pk.spectral_entropy) == 0.0
    assert peak_list(spark, [1.0], [], pk.normalize) is None and peak_list(spark, None, [1.0], pk.normalize) is None
    assert [p["i"] for p in peak_list(spark, [5.0], [0.0], pk.unit_length)] == [0.0]
    assert peak_list(spark, [5.0], [2.0], pk.fingerprint) == peak_list(spark, [5.0], [2.0], pk.fingerprint)


def test_formulas_near_a_mass(spark):
    from itertools import product

    from massloom.plans.library import formulas_near

    w = chem.ELEMENT_MASS
    m = 180.0634
    want = {}
    for s, p, o, n, c in product(range(6), range(6), range(12), range(13), range(1, 16)):
        heavy = c * w["C"] + n * w["N"] + o * w["O"] + p * w["P"] + s * w["S"]
        for h in range(max(0, int((m - heavy) / w["H"]) - 1), int((m - heavy) / w["H"]) + 3) if heavy < m + 1 else ():
            off = abs(heavy + h * w["H"] - m) / m * 1e6
            x = c + 1 - h / 2 + n / 2 + p / 2
            shares = h / c >= 0.1 and h / c <= 3.2 and n / c <= 1.5 and o / c <= 1.5 and p / c <= 0.4 and s / c <= 0.8
            if off <= 20 and (h + n + p) % 2 == 0 and -0.5 <= x <= 40 and shares and 4 * c + h + 5 * n + 2 * o + 5 * p + 6 * s >= 2 * (6 if s else 5 if p or n else 4):
                want["".join(e + (str(k) if k > 1 else "") for e, k in zip("CHNOPS", (c, h, n, o, p, s)) if k)] = round(off, 4)
    rich = {"C10H16N5O13P3": 11.0, "C24H42O21": -19.0, "C20H40N20": 3.0, "C12H25NO2S6": 8.0}
    mass = lambda f: spark.range(1).select(chem.formula_mass(F.lit(f))).first()[0]
    rows = [("q", m)] + [(f, mass(f) * (1 + d / 1e6)) for f, d in rich.items()] + [("null", None)]
    found = formulas_near(spark.createDataFrame(rows, "query_id string, m double"))
    got = {r["formula"]: r["ppm"] for r in found.where("query_id = 'q'").collect()}
    assert got == pytest.approx(want, abs=2e-4) and "C6H12O6" in got and any("P" in f for f in got)
    assert {r["formula"] for r in found.where("query_id = formula").collect()} == set(rich)
