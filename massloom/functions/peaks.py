"""Peak lists as arrays of structs (``mz``, ``i``), and functions on them that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The range and width of the fine bins, the number of 1 Da bins.
BIN_START, BIN_WIDTH, BINS = 20.0, 0.01, 148_000
COARSE_BINS = 1480


def peaks(mzs: Column, intensities: Column) -> Column:
    """``array<struct<mz,i>>`` from two parallel arrays; null if either is null or their lengths differ."""
    pair = lambda m, x: F.struct(m.cast("double").alias("mz"), x.cast("double").alias("i"))
    return F.when(F.size(mzs) == F.size(intensities), F.zip_with(mzs, intensities, pair))


def _with_i(p: Column, i: Column) -> Column:
    return F.struct(p["mz"].alias("mz"), i.alias("i"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def base_peak(ps: Column) -> Column:
    return F.array_max(F.transform(ps, lambda p: p["i"]))


def normalize(ps: Column) -> Column:
    """Intensities over the highest one; unchanged if that isn't above 0."""
    scaled = lambda ps, top: F.when(top > 0, F.transform(ps, lambda p: _with_i(p, p["i"] / top))).otherwise(ps)
    return let(ps, lambda x: let(base_peak(x), lambda top: scaled(x, top)))


def keep_relative(ps: Column, least: float) -> Column:
    """Normalized, without peaks below ``least`` of the highest."""
    return F.filter(normalize(ps), lambda p: p["i"] >= least)


def drop_precursor(ps: Column, precursor: Column, within: float = 0.5) -> Column:
    return F.filter(ps, lambda p: F.abs(p["mz"] - precursor) > within)


def top_peaks(ps: Column, n: int) -> Column:
    """The ``n`` highest peaks, highest first, ties by m/z."""
    ordered = F.array_sort(F.transform(ps, lambda p: F.struct((-p["i"]).alias("r"), p["mz"].alias("mz"), p["i"].alias("i"))))
    return F.transform(F.slice(ordered, 1, n), lambda p: F.struct(p["mz"].alias("mz"), p["i"].alias("i")))


def by_mz(ps: Column) -> Column:
    return F.array_sort(ps)


def unit_length(ps: Column) -> Column:
    """Intensities over the root of the sum of their squares; an all-zero list stays."""
    scaled = lambda ps, n: F.when(n > 0, F.transform(ps, lambda p: _with_i(p, p["i"] / n))).otherwise(ps)
    return let(ps, lambda x: let(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, p: a + p["i"] * p["i"])), lambda n: scaled(x, n)))


def square_root(ps: Column) -> Column:
    return F.transform(ps, lambda p: _with_i(p, F.sqrt(F.greatest(p["i"], F.lit(0.0)))))


def drop_isotopes(ps: Column, step: float = 1.003355, within: float = 0.015, below: float = 0.9) -> Column:
    """Drops a peak that lies one isotope step above another peak and has less than ``below`` of its intensity.

    Every peak is held against all peaks of the list (no chaining), so the result doesn't depend on their order.
    """
    child = lambda x, p: F.exists(x, lambda q: (F.abs(p["mz"] - q["mz"] - step) <= within) & (p["i"] < below * q["i"]))
    return let(ps, lambda x: F.filter(x, lambda p: ~child(x, p)))


# The isotope step of the variants and how near it must be met; the variants: least relative intensity, precursor and isotopes dropped or not.
VARIANT_STEP, VARIANT_WITHIN = 1.00335, 0.005
VARIANTS = {"1A": (0.0, False, False), "1B": (0.01, False, False), "1C": (0.01, True, False), "1D": (0.01, True, True)}


def drop_companions(ps: Column) -> Column:
    """Drops a peak that lies one isotope step above a peak of at least its intensity."""
    lower = lambda x, p: F.exists(x, lambda q: (F.abs(p["mz"] - VARIANT_STEP - q["mz"]) <= VARIANT_WITHIN) & (p["i"] <= q["i"]))
    return let(ps, lambda x: F.filter(x, lambda p: ~lower(x, p)))


def variant(ps: Column, precursor: Column, name: str, cap: int = 100) -> Column:
    """A peak list prepared as a variant says, the steps first and the ``cap`` highest last. A peak that isn't above its lower isotope companion goes.

    Companions are looked for from above, so a lower one is always still there: no chaining.
    """
    least, no_precursor, no_isotopes = VARIANTS[name]
    out = keep_relative(ps, least)
    if no_precursor:
        out = drop_precursor(out, precursor)
    if no_isotopes:
        out = drop_companions(out)
    return by_mz(top_peaks(out, cap))


# The four profiles of preparation, from the plainest: least relative intensity, precursor and isotopes dropped or not.
PROFILES = {"A": (0.0, False, False), "B": (0.01, False, False), "C": (0.01, True, False), "D": (0.01, True, True)}


def profile(ps: Column, precursor: Column, name: str, cap: int = 100) -> Column:
    """A prepared peak list: the ``cap`` highest peaks, then the steps of the profile, in order of m/z."""
    least, no_precursor, no_isotopes = PROFILES[name]
    out = keep_relative(top_peaks(ps, cap), least)
    if no_precursor:
        out = drop_precursor(out, precursor)
    if no_isotopes:
        out = drop_isotopes(out)
    return by_mz(out)


def cleaned(ps: Column, cap: int = 60, least: int = 3) -> Column:
    """Isotope companions dropped, square roots at unit length, then the ``cap`` highest, in order of m/z.

    Null if fewer than ``least`` peaks are left, or none with an intensity.
    """
    usable = lambda x: (F.size(x) >= least) & (base_peak(x) > 0)
    return let(drop_companions(normalize(ps)), lambda x: F.when(usable(x), by_mz(top_peaks(unit_length(square_root(x)), cap))))


def spectral_entropy(ps: Column) -> Column:
    """Shannon entropy of the intensities as shares; 0 for an empty or all-zero list."""
    term = lambda q: F.when(q > 0, q * F.log(q)).otherwise(0.0)
    entropy = lambda x, total: F.when(total > 0, F.aggregate(x, F.lit(0.0), lambda a, p: a - term(p["i"] / total))).otherwise(0.0)
    return let(ps, lambda x: let(_total(x), lambda total: entropy(x, total)))


def _total(ps: Column) -> Column:
    return F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["i"])


def entropy_weighted(ps: Column, floor: float = 0.002, cap: int = 100) -> Column:
    """Shares of intensity, flattened for lists of low entropy S < 3 by the power 0.25 + 0.25 S, summing to 1."""
    flat = lambda s: F.when(s < 3, 0.25 + 0.25 * s).otherwise(1.0)
    raised = lambda x, total, power: F.transform(x, lambda p: _with_i(p, F.pow(p["i"] / total, power)))
    shares = lambda x, total: F.transform(x, lambda p: _with_i(p, p["i"] / total))
    weighted = let(
        top_peaks(keep_relative(ps, floor), cap),
        lambda x: let(_total(x), lambda total: let(flat(spectral_entropy(x)), lambda power: raised(x, total, power))),
    )
    return by_mz(let(weighted, lambda x: let(_total(x), lambda total: shares(x, total))))


def fine_bin(mz: Column) -> Column:
    """Index of the fine bin; null outside the binned range."""
    b = F.floor((mz - BIN_START) / BIN_WIDTH)
    return F.when((b >= 0) & (b < BINS), b)


def coarse_bin(mz: Column) -> Column:
    """Index of the 1 Da bin from 20 on; null outside the binned range."""
    b = F.floor(mz - BIN_START)
    return F.when((b >= 0) & (b < COARSE_BINS), b)


def fingerprint(ps: Column, digits: int = 4) -> Column:
    """A digest of the peaks in order of m/z, rounded to ``digits``; equal lists have equal digests."""
    form = lambda p: F.concat(F.format_number(p["mz"], digits), F.lit(":"), F.format_number(p["i"], digits))
    return F.sha2(F.array_join(F.transform(by_mz(ps), form), ","), 256)


def digests(mzs: Column, intensities: Column) -> Column:
    """What tells that two spectra are the same: the digest of their peaks and that of their m/z alone, to 3 digits. None for empty lists."""
    ps = peaks(mzs, intensities)
    alone = F.sha2(F.array_join(F.transform(F.array_sort(mzs), lambda m: F.format_number(m, 3)), ","), 256)
    both = F.array(F.when(F.size(ps) > 0, fingerprint(ps)), F.when(F.size(mzs) > 0, alone))
    return F.array_compact(both)


def arrays_near(a: Column, b: Column, within: float = 1e-4) -> Column:
    """Equally long, and no pair of values further apart than ``within``."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= within), lambda ok: ok)


def merged(ps: Column, gap: float = 0.005) -> Column:
    """Neighbouring peaks closer than ``gap`` become one, the higher of the two; in order of m/z."""

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.when(p["i"] > last["i"], p).otherwise(last)))
        return F.when((F.size(acc) > 0) & (p["mz"] - last["mz"] < gap), joined).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(by_mz(ps), F.array().cast("array<struct<mz:double,i:double>>"), step)
