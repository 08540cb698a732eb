"""Masses, formulas and adducts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Monoisotopic masses of the elements (public tables), by atomic number.
ELEMENT_MASS = {
    "H": 1.00782503223, "D": 2.01410177811, "He": 4.00260325413, "Li": 7.0160034366, "Be": 9.012183065, "B": 11.00930536,
    "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "F": 18.99840316273, "Ne": 19.9924401762, "Na": 22.9897692820,
    "Mg": 23.9850416996, "Al": 26.98153863, "Si": 27.9769265327, "P": 30.97376199842, "S": 31.9720711744,
    "Cl": 34.968852682, "Ar": 39.9623831237, "K": 38.9637064864, "Ca": 39.962590863, "Ti": 47.94794198, "V": 50.94395704,
    "Cr": 51.94050623, "Mn": 54.9380443, "Fe": 55.93493633, "Co": 58.93319429, "Ni": 57.93534241, "Cu": 62.92959772,
    "Zn": 63.92914201, "Ga": 68.9255735, "Ge": 73.921177761, "As": 74.92159457, "Se": 79.9165218, "Br": 78.9183376,
    "Kr": 83.9114977, "Rb": 86.909180531, "Sr": 87.9056125, "Zr": 89.9047044, "Mo": 97.90540482, "Ru": 101.9043493,
    "Rh": 102.9055043, "Pd": 105.9034804, "Ag": 106.9050916, "Cd": 113.9033585, "In": 114.9038785, "Sn": 119.9021947,
    "Sb": 120.903812, "Te": 129.906222748, "I": 126.9044719, "Xe": 131.9041550856, "Cs": 132.905451961, "Ba": 137.9052472,
    "Pt": 194.9647911, "Au": 196.96656879, "Hg": 201.970643, "Tl": 204.9744275, "Pb": 207.9766521, "Bi": 208.9803987,
    "U": 238.05078826,
}
ELECTRON_MASS = 0.00054858
ISOTOPE_STEP = 1.003354835
HALOGENS = ("F", "Cl", "Br", "I")
FORMULA_TOKEN = r"([A-Z][a-z]?)(\d*)"
ORBITRAP_WORDS = ("orbitrap", "qft", "ftms", "hybrid ft", "itft", "exactive")
ADDUCT_TOKEN = r"^\[(\d*)M((?:[+-][A-Za-z0-9]+)*)\](\d*)([+-])$"


def element_counts(formula: Column) -> Column:
    """Formula to ``map<string,int>``; null for null, empty or malformed text. Repeated elements add up."""
    elements = F.regexp_extract_all(formula, F.lit(FORMULA_TOKEN), 1)
    counts = F.transform(
        F.regexp_extract_all(formula, F.lit(FORMULA_TOKEN), 2), lambda n: F.when(n == "", 1).otherwise(n.try_cast("int"))
    )
    whole = formula.rlike(rf"^(?:{FORMULA_TOKEN})+$")
    pairs = F.arrays_zip(elements.alias("e"), counts.alias("n"))
    names = F.array_distinct(elements)
    total = lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda a, p: a + p["n"])
    return F.when(whole, F.map_from_arrays(names, F.transform(names, total)))


def mass_table() -> Column:
    return F.create_map(*(F.lit(x) for pair in ELEMENT_MASS.items() for x in pair))


def formula_mass(formula: Column) -> Column:
    """Monoisotopic mass of a formula; null for null, empty or malformed text or an unknown element."""
    elements = F.regexp_extract_all(formula, F.lit(FORMULA_TOKEN), 1)
    counts = F.regexp_extract_all(formula, F.lit(FORMULA_TOKEN), 2)
    table = mass_table()
    part = lambda e, n: F.try_element_at(table, e) * F.when(n == "", 1.0).otherwise(n.try_cast("double"))
    masses = F.zip_with(elements, counts, part)
    return F.when(formula.rlike(rf"^(?:{FORMULA_TOKEN})+$"), F.aggregate(masses, F.lit(0.0), lambda a, m: a + m))


def count_of(counts: Column, element: str) -> Column:
    return F.coalesce(F.try_element_at(counts, F.lit(element)), F.lit(0))


def hill_formula(counts: Column) -> Column:
    """Formula text in Hill order (carbon, hydrogen, then by name; by name alone without carbon); elements of 0 are left out."""
    kept = F.filter(F.map_entries(counts), lambda e: e["value"] > 0)
    has_carbon = count_of(counts, "C") > 0
    place = lambda e: F.when(has_carbon & (e["key"] == "C"), 0).when(has_carbon & (e["key"] == "H"), 1).otherwise(2)
    ordered = F.array_sort(F.transform(kept, lambda e: F.struct(place(e).alias("p"), e["key"].alias("e"), e["value"].alias("n"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat(x["e"], F.when(x["n"] > 1, x["n"].cast("string")).otherwise(""))), "")


def _halogens(counts: Column) -> Column:
    return reduce(lambda a, b: a + b, (count_of(counts, x) for x in HALOGENS))


def rdbe(counts: Column) -> Column:
    """Rings and double bonds: C + 1 - H/2 + N/2 + P/2 - halogens/2."""
    c, h, n, p = (count_of(counts, x) for x in "CHNP")
    return c + 1 - h / 2.0 + n / 2.0 + p / 2.0 - _halogens(counts) / 2.0


def formula_verdict(counts: Column) -> Column:
    """``valid``, or the first of the heuristic composition rules that a formula breaks."""
    c, h, n, o, p, s = (count_of(counts, x) for x in "CHNOPS")
    x = _halogens(counts)
    valences = c * 4 + h + n * 5 + o * 2 + p * 5 + s * 6 + x
    largest = F.when(s > 0, 6).when((p > 0) | (n > 0), 5).otherwise(4)
    r = rdbe(counts)
    carbons = F.greatest(c, F.lit(1))
    return (
        F.when(counts.isNull(), F.lit(None).cast("string"))
        .when(c <= 0, "no carbon")
        .when((h + n + p + x) % 2 != 0, "odd valence sum")
        .when(valences < 2 * largest, "valence sum too low")
        .when(r < -0.5, "negative unsaturation")
        .when(r > 40.0, "excessive unsaturation")
        .when((h / carbons < 0.1) | (h / carbons > 3.2), "H/C")
        .when(n / carbons > 1.5, "N/C")
        .when(o / carbons > 1.5, "O/C")
        .when(p / carbons > 0.4, "P/C")
        .when(s / carbons > 0.8, "S/C")
        .when(x / carbons > 1.5, "halogen/C")
        .otherwise("valid")
    )


def adduct_dimension(adducts: DataFrame, column: str = "adduct") -> DataFrame:
    """The distinct adducts of ``column`` with ``n_m``, ``adds``, ``losses``, ``charge`` and ``sgn``; null parts if unreadable.

    ``[2M+Na]+`` reads as two molecules plus Na, one charge. A group may carry a leading count (``2H``).
    """
    text = F.regexp_replace(column, r"\s+", "")
    part = lambda i: F.regexp_extract(text, ADDUCT_TOKEN, i)
    one = lambda x: F.when(x == "", 1).otherwise(x.try_cast("int"))
    groups = lambda sign: F.regexp_extract_all(part(2), F.lit(rf"\{sign}([A-Za-z0-9]+)"), 1)

    def mass(group: Column) -> Column:
        times, rest = F.regexp_extract(group, r"^(\d*)", 1), F.regexp_replace(group, r"^\d+", "")
        return one(times) * formula_mass(rest)

    total = lambda sign: F.aggregate(F.transform(groups(sign), mass), F.lit(0.0), lambda a, m: a + m)
    read = text.rlike(ADDUCT_TOKEN)
    return (
        adducts.select(F.col(column).alias("adduct"))
        .where(F.col("adduct").isNotNull())
        .distinct()
        .select(
            "adduct",
            F.when(read, one(part(1))).alias("n_m"),
            F.when(read, total("+")).alias("adds"),
            F.when(read, total("-")).alias("losses"),
            F.when(read, one(part(3))).alias("charge"),
            F.when(read, F.when(part(4) == "+", 1).otherwise(-1)).alias("sgn"),
        )
        .withColumns(
            {c: F.when((F.col("n_m") > 0) & (F.col("charge") > 0) & F.col("adds").isNotNull() & F.col("losses").isNotNull(), F.col(c))
             for c in ("n_m", "adds", "losses", "charge", "sgn")}
        )
    )


def neutral_mass(precursor: Column, n_m: Column, adds: Column, losses: Column, charge: Column, sgn: Column) -> Column:
    """Mass of the neutral molecule; null where it isn't a finite positive number."""
    m = (charge * precursor + sgn * charge * ELECTRON_MASS - adds + losses) / n_m
    return F.when((m > 0) & (m < float("inf")), m)


def ppm_error(observed: Column, expected: Column) -> Column:
    """Relative deviation in parts per million; null for an expected mass of 0."""
    return F.when(expected != 0, F.abs(observed - expected) / expected * 1e6)


def polarity(mode: Column) -> Column:
    """-1 for a mode that says negative, else 1; null stays null."""
    return F.when(F.lower(mode).contains("neg"), -1).when(mode.isNotNull(), 1)


def instrument_family(text: Column) -> Column:
    """One of five families of instruments, ``other`` for null."""
    t = F.lower(text)
    has = lambda *words: reduce(lambda a, b: a | b, (t.contains(w) for w in words))
    return (
        F.when(has("timstof"), "timsTOF")
        .when(has(*ORBITRAP_WORDS), "Orbitrap")
        .when(has("tof"), "QTOF")
        .when(has("trap", "qq"), "IT")
        .otherwise("other")
    )


def energy_of_text(text: Column) -> Column:
    """Median of the absolute numbers in a text such as ``10, 20 eV``; null without a number."""
    numbers = F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double")))
    n = F.size(numbers)
    at = lambda i: F.try_element_at(numbers, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def energy_bin(energy: Column, unknown: int = -9999) -> Column:
    """Bin of 5 eV, halves to the even number; ``unknown`` for a missing energy."""
    return F.when(energy.isNotNull() & ~F.isnan(energy), F.bround(energy / 5).cast("int")).otherwise(unknown)


def near_energy(a: Column, b: Column, within: float = 5.0) -> Column:
    """Both energies are known and at most ``within`` apart."""
    return F.coalesce(F.abs(a - b) <= within, F.lit(False))
