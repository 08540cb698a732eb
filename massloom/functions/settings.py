"""Reading of the recorded settings of a spectrum: what is known, and what is missing openly or in disguise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Which entries count as known.
ADDUCT_FORM = r"^\[[^\[\]?]+\](?:\d*[+-]|[+-]\d+|\+{2,}|-{2,})$"
POSITIVE_FORM = r"^(?:p|pos|positive|\+)\.?(?: ?ion)?(?: ?mode)?$"
NEGATIVE_FORM = r"^(?:n|neg|negative|-)\.?(?: ?ion)?(?: ?mode)?$"
MAX_ENERGY = 200.0


def known_energy(col: Column) -> Column:
    """The collision energy if it is above 0 and at most 200, else null (also for NaN)."""
    x = col.cast("double")
    return F.when((x > 0) & (x <= MAX_ENERGY) & ~F.isnan(x), x)


def energy_text(col: Column) -> Column:
    """A known collision energy with one decimal, else null."""
    known = known_energy(col)
    return F.when(known.isNotNull(), F.format_string("%.1f", known))


def known_adduct(col: Column) -> Column:
    """The adduct without blanks if it is a bracketed ion with its charge behind it, else null."""
    bare = F.regexp_replace(col, r"[\s\xa0]+", "")
    return F.when(bare.rlike(ADDUCT_FORM), bare)


def known_mode(col: Column) -> Column:
    """``positive`` or ``negative`` if the entry names or abbreviates it, else null."""
    bare = F.lower(F.regexp_replace(col, r"^[\s\xa0]+|[\s\xa0]+$", ""))
    return F.when(bare.rlike(POSITIVE_FORM), "positive").when(bare.rlike(NEGATIVE_FORM), "negative")
