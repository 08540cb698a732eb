"""Reading of structure keys that are spelled in several ways.

A key is readable if, apart from case, surrounding blanks and a label before it, it has the form of 14, 10 and 1
letters joined by hyphens; a short key is 14 letters. Readable keys come out bare and in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The forms of a full and of a short key.
FULL_KEY = r"(?<![A-Z0-9-])([A-Z]{14}-[A-Z]{10}-[A-Z])(?![A-Z0-9-])"
SHORT_KEY = r"^\s*(?:[A-Z][A-Z0-9 ]*[=:]\s*)?([A-Z]{14})\s*$"


def readable_keys(col: Column) -> Column:
    """The distinct readable keys in a field, sorted; an empty array if there is none or the field is null."""
    found = F.regexp_extract_all(F.upper(col), F.lit(FULL_KEY), 1)
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def single_key(col: Column) -> Column:
    """The key of a field that holds exactly one readable key, else null."""
    keys = readable_keys(col)
    return F.when(F.size(keys) == 1, F.element_at(keys, 1))


def short_key(col: Column) -> Column:
    """The readable short key (first block) of a field, else null."""
    found = F.regexp_extract(F.upper(col), SHORT_KEY, 1)
    return F.when(found != "", found)


def row_blocks(inchikey: Column, inchikey14: Column) -> Column:
    """The distinct first blocks that a row names: those of all readable keys and of the readable short key."""
    full = F.transform(readable_keys(inchikey), lambda k: F.substring(k, 1, 14))
    short = short_key(inchikey14)
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(full, F.array(short)))))
