"""Filling of missing fields from the other records of the same group by low-rank alternating least squares.

The matrix has one row per record and one column per distinct valid value of a field (``adduct=[M+H]+``, ``energy=35.0`` ...).
A known field gives a one-hot block of observed cells, and only observed cells fit the r-vectors of the columns. To decode a
missing field, the record's r-vector follows from its known fields and, with less weight, from the shares of the values
that its group holds; the value with the highest predicted cell wins, among those of the group or, if the group
holds none, among all valid values.

The distinct values of all fields are numbered and sent to the tasks; a table with more than MOST_VALUES of them is refused.
A row's factors follow from its own cells alone, so a sweep is one pass over the records without a shuffle of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from massloom.functions.keys import single_key
from massloom.functions.settings import energy_text, known_adduct, known_mode
from massloom.operators.heavy_keys import skew_join
from massloom.session import durable_table

FIELDS = ("collision_energy", "adduct", "ionization_mode")
#: Columns of the matrix, at most: the distinct valid values of all fields. Bounds what is sent to the tasks.
MOST_VALUES = 16_384
RANK, SWEEPS, RIDGE = 6, 3, 0.05
#: Weight of the group's shares beside that of an observed cell, when a missing field is decoded.
EVIDENCE = 0.1
MZ_TOLERANCE = 0.01


def known_fields(df: DataFrame) -> DataFrame:
    """The records with what is known of the three fields, as text."""
    return df.select(
        "spectrum_id",
        "session_id",
        single_key(F.col("inchikey")).alias("k"),
        F.when(~F.isnan("precursor_mz"), F.col("precursor_mz")).alias("mz"),
        energy_text(F.col("collision_energy")).alias("collision_energy"),
        known_adduct(F.col("adduct")).alias("adduct"),
        known_mode(F.col("ionization_mode")).alias("ionization_mode"),
    )


def valid_values(rec: DataFrame) -> dict[str, list[str]]:
    """The distinct values of each field in alphabetical order; more than MOST_VALUES in all are an error."""
    every = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FIELDS))).alias("x")
    found = rec.select(every).select("x.*").where("v IS NOT NULL").distinct().limit(MOST_VALUES + 1).collect()
    if len(found) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct values in {', '.join(FIELDS)}")
    return {f: sorted(r["v"] for r in found if r["f"] == f) for f in FIELDS}


def numbered(rec: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """``rec`` with the number of each known value in place of its text."""
    for f in FIELDS:
        table = rec.sparkSession.createDataFrame(list(enumerate(values[f])), f"n int, {f} string")  # at most MOST_VALUES rows
        rec = rec.join(F.broadcast(table), f, "left").drop(f).withColumnRenamed("n", f)
    return rec


def _group_shares(known: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: ``vals``, the distinct known values with their counts (few: a field has few valid values)."""
    return (
        known.groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "n"))).alias("vals"))
    )


def _adduct_shares(rec: DataFrame) -> DataFrame:
    """Per (session, key, m/z) with an adduct gap: the adducts of the rows of that session and key within tolerance.

    A band join on buckets of the tolerance's width. Both sides are reduced to distinct (session, key, m/z) first, so
    copies and hot groups meet once.
    """
    keyed = rec.where("session_id IS NOT NULL AND k IS NOT NULL AND mz IS NOT NULL")
    bucket = F.floor(F.col("mz") / MZ_TOLERANCE)
    gaps = keyed.where("adduct IS NULL").select("session_id", "k", "mz").distinct()
    gaps = gaps.withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    known = (
        keyed.where("adduct IS NOT NULL")
        .groupBy("session_id", "k", "mz", "adduct")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("session_id", "k", F.col("mz").alias("mz2"), "adduct", "n", bucket.alias("b"))
    )
    near = F.abs(F.col("mz") - F.col("mz2")) <= MZ_TOLERANCE + 1e-9  # decimals of the file, not of the binary form
    return (
        gaps.join(known, ["session_id", "k", "b"])
        .where(near)
        .groupBy("session_id", "k", "mz", "adduct")
        .agg(F.sum("n").alias("n"))
        .groupBy("session_id", "k", "mz")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("adduct").alias("v"), "n"))).alias("adduct_vals"))
    )


def encoded_records(rec: DataFrame) -> DataFrame:
    """The ``numbered`` records with the group's values and counts for the fields that are missing."""
    in_session = rec.where("session_id IS NOT NULL")
    energies, modes = (
        _group_shares(in_session.where(F.col(f).isNotNull()), ["session_id"], f).withColumnRenamed("vals", f"{f}_vals")
        for f in ("collision_energy", "ionization_mode")
    )
    out = skew_join(rec, energies.join(modes, "session_id", "full"), "session_id")
    gaps = out.where("adduct IS NULL AND session_id IS NOT NULL AND k IS NOT NULL AND mz IS NOT NULL")
    rest = out.where("NOT (adduct IS NULL AND session_id IS NOT NULL AND k IS NOT NULL AND mz IS NOT NULL)")
    with_adduct = gaps.join(_adduct_shares(rec), ["session_id", "k", "mz"], "left")
    none = F.lit(None).cast("array<struct<v:int,n:bigint>>").alias("adduct_vals")
    both = with_adduct.unionByName(rest.select("*", none))
    keep = ["spectrum_id", "session_id", *FIELDS]
    return both.select(*keep, *(F.when(F.col(f).isNull(), F.col(f"{f}_vals")).alias(f"{f}_vals") for f in FIELDS))


def _cells(df: DataFrame) -> DataFrame:
    """``<field>_v`` and ``<field>_w``: the values that the group holds and their shares, where the field is missing."""
    value = lambda c: F.transform(c, lambda e: e["v"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, e: a + e["n"])
    share = lambda c, t: F.transform(c, lambda e: e["n"] / t)
    for f in FIELDS:
        vals = F.col(f"{f}_vals")
        df = df.withColumns({f"{f}_v": value(vals), f"{f}_w": share(vals, total(vals))})
    return df.select("spectrum_id", *FIELDS, *(f"{f}_{x}" for f in FIELDS for x in "vw"))


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists (null: 0) and their entries, one behind the other."""
    length = np.array([0 if x is None else len(x) for x in lists], int)
    return length, np.concatenate([x for x in lists if x is not None and len(x)] or [np.zeros(0)])


def _row_factors(pdf: pd.DataFrame, y: list[np.ndarray], evidence: float) -> tuple[np.ndarray, list]:
    """The r-vectors of the rows for given column vectors of each field, and per field what the group holds: rows and values.

    An observed field counts 1, the group's shares of a missing one ``evidence``.
    """
    n, r = len(pdf), y[0].shape[1]
    a = np.broadcast_to(RIDGE * np.eye(r), (n, r, r)).copy()
    b = np.zeros((n, r))
    held = []
    for f, block in zip(FIELDS, y, strict=True):
        gram = block.T @ block  # all columns of a field are cells, most of them 0
        known = pdf[f].notna().to_numpy()
        a[known] += gram
        b[known] += block[pdf[f].to_numpy(float)[known].astype(int)]
        rows, idx = np.zeros(0, int), np.zeros(0, int)
        if evidence:
            length, idx = _flat(pdf[f"{f}_v"])
            idx, w = idx.astype(int), _flat(pdf[f"{f}_w"])[1]
            rows = np.repeat(np.arange(n), length)
            a[length > 0] += evidence * gram
            for d in range(r):
                b[:, d] += evidence * np.bincount(rows, w * block[idx, d], n)
        held.append((rows, idx))
    return np.linalg.solve(a, b[:, :, None])[:, :, 0], held


def fit_columns(cells: DataFrame, sizes: list[int], rank: int = RANK, sweeps: int = SWEEPS) -> list[np.ndarray]:
    """The r-vectors of the columns of each field, from the observed cells of all records. What comes back from a sweep is bounded by MOST_VALUES."""
    rng = np.random.default_rng(7)
    y = [rng.normal(0, 0.3, (size, rank)) for size in sizes]
    for _ in range(sweeps):

        def sums(batches: Iterator[pd.DataFrame], y: list[np.ndarray] = y) -> Iterator[pd.DataFrame]:
            gram, target = [np.zeros((rank, rank)) for _ in FIELDS], [np.zeros((size, rank)) for size in sizes]
            for pdf in batches:
                x, _ = _row_factors(pdf, y, 0.0)
                for i, f in enumerate(FIELDS):
                    known = pdf[f].notna().to_numpy()
                    gram[i] += x[known].T @ x[known]
                    np.add.at(target[i], pdf[f].to_numpy(float)[known].astype(int), x[known])
            used = [np.flatnonzero(t.any(1)) for t in target]
            yield pd.DataFrame({
                "field": [*range(len(FIELDS)), *(i for i, u in enumerate(used) for _ in u)],
                "at": [*([-1] * len(FIELDS)), *(int(j) for u in used for j in u)],
                "part": [*(g.ravel().tolist() for g in gram), *(t for i, u in enumerate(used) for t in target[i][u].tolist())],
            })

        parts = cells.select(*FIELDS).mapInPandas(sums, "field int, at long, part array<double>")
        total = (
            parts.select("field", "at", F.posexplode("part").alias("d", "v"))
            .groupBy("field", "at", "d")
            .agg(F.sum("v").alias("v"))
            .toPandas()  # at most fields * r^2 + MOST_VALUES * r numbers
        )
        new = [np.zeros_like(b) for b in y]
        for i, b in enumerate(new):
            own = total[total["field"] == i]
            target = own[own["at"] >= 0]
            b[target["at"].astype(int), target["d"].astype(int)] = target["v"]
            gram = own[own["at"] < 0].sort_values("d")["v"].to_numpy()
            g = gram.reshape(rank, rank) if len(gram) else np.zeros((rank, rank))
            new[i] = np.linalg.solve(g + RIDGE * np.eye(rank), b.T).T
        y = new
    return y


def filled_fields(df: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """One row per gap: ``spectrum_id``, ``field``, ``value``, ``filled_from`` and ``n_values``.

    ``filled_from`` is ``group`` if the group of the record holds known values of the field (``n_values`` distinct
    ones), or ``model`` if it holds none and the value was decoded among all valid values (``n_values`` is 0). A field
    without any valid value in the table stays open: its gaps come out with a null value and ``filled_from`` null.
    Ties go to the first value in alphabetical order. Repeated rows count as often as they occur; rows without a
    session have no group; an empty table gives an empty result; extra columns don't matter. More than MOST_VALUES
    distinct valid values are refused with an error.
    """
    rec = known_fields(df)
    values = valid_values(rec)
    enc = durable_table(_cells(encoded_records(numbered(rec, values))))
    y = fit_columns(enc, [len(values[f]) for f in FIELDS])
    gaps = enc.where(" OR ".join(f"{f} IS NULL" for f in FIELDS))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, held = _row_factors(pdf, y, evidence)
            for i, f in enumerate(FIELDS):
                gap = pdf[f].isna().to_numpy()
                rows, idx = held[i]
                n_values = np.bincount(rows, minlength=len(pdf))
                best = np.full(len(pdf), -1)
                if len(values[f]):
                    alone = np.flatnonzero(gap & (n_values == 0))
                    for s in range(0, len(alone), 1024):
                        best[alone[s : s + 1024]] = (x[alone[s : s + 1024]] @ y[i].T).argmax(1)
                score = np.einsum("ij,ij->i", x[rows], y[i][idx])
                order = np.lexsort((idx, -score, rows))  # the best value of each row comes first
                first = np.unique(rows[order], return_index=True)
                best[first[0]] = idx[order][first[1]]
                at = np.flatnonzero(gap)
                named = np.array([*values[f], None], object)  # -1: no valid value
                source = np.where(n_values[at] > 0, "group", np.where(best[at] >= 0, "model", None))
                yield pd.DataFrame({
                    "spectrum_id": pdf["spectrum_id"].to_numpy()[at], "field": f, "value": pd.Series(named[best[at]], dtype=object),
                    "filled_from": pd.Series(source, dtype=object), "n_values": n_values[at].astype("int32"),
                })

    schema = f"spectrum_id {dict(enc.dtypes)['spectrum_id']}, field string, value string, filled_from string, n_values int"
    return gaps.mapInPandas(decode, schema)


def held_out_accuracy(df: DataFrame, one_in: int = 10) -> DataFrame:
    """Per field: known values that were hidden (``n``), how many the model decoded right, and how many the group's commonest value is.

    Of the records with a group, one in ``one_in`` by a digest of its id hides one of its fields, by the same digest. The
    commonest value is that of all other known values of the session (ties to the first in the alphabet), for the adduct as well.
    """
    rec = known_fields(df)
    h = F.pmod(F.xxhash64(F.lit("held"), "spectrum_id"), F.lit(one_in * len(FIELDS)))
    hides = lambda i: F.coalesce((h == i * one_in) & F.col("session_id").isNotNull() & F.col(FIELDS[i]).isNotNull(), F.lit(False))
    raw = {"collision_energy": F.col("collision_energy").cast("double"), "adduct": F.col("adduct"), "ionization_mode": F.col("ionization_mode")}
    # The fills read the fields from the table, so the hidden ones are hidden there.
    hidden = rec.select(
        "spectrum_id", "session_id", F.col("k").alias("inchikey"), F.col("mz").alias("precursor_mz"),
        *(F.when(~hides(i), raw[f]).alias(f) for i, f in enumerate(FIELDS)),
    )
    truth = rec.select("spectrum_id", "session_id", *(F.struct(hides(i).alias("hidden"), F.col(f).alias("v")).alias(f) for i, f in enumerate(FIELDS)))
    every = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("x")) for f in FIELDS))).alias("c")
    truth = truth.select("spectrum_id", "session_id", every).where("c.x.hidden").select("spectrum_id", "session_id", "c.field", F.col("c.x.v").alias("truth"))
    seen = known_fields(hidden).where("session_id IS NOT NULL")
    seen = seen.select("session_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in FIELDS))).alias("c")).where("c.v IS NOT NULL")
    counted = seen.groupBy("session_id", "c.field", "c.v").agg(F.count(F.lit(1)).alias("n"))
    commonest = counted.groupBy("session_id", "field").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("commonest"))
    both = truth.join(filled_fields(hidden).select("spectrum_id", "field", "value"), ["spectrum_id", "field"], "left").join(commonest, ["session_id", "field"], "left")
    right = lambda c: F.count_if(F.coalesce(F.col(c) == F.col("truth"), F.lit(False)))
    return both.groupBy("field").agg(F.count(F.lit(1)).alias("n"), right("value").alias("n_model_right"), right("commonest").alias("n_commonest_right"))


def unanimous_fills(df: DataFrame) -> DataFrame:
    """``spectrum_id``, ``field``, ``value``: the fills for which all known values of the group agree.

    One value is then left to decode to, so these fills are the same whatever the factors are.
    """
    return filled_fields(df).where("filled_from = 'group' AND n_values = 1").select("spectrum_id", "field", "value")


def completed(df: DataFrame) -> DataFrame:
    """``df``'s records with the three fields completed, and for each a mark: null (recorded), ``group`` or ``model``."""
    rec = known_fields(df).select("spectrum_id", *FIELDS)
    fills = (
        filled_fields(df)
        .groupBy("spectrum_id")
        .agg(
            *(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"fill_{f}") for f in FIELDS),
            *(F.max(F.when(F.col("field") == f, F.col("filled_from"))).alias(f"{f}_filled") for f in FIELDS),
        )
    )
    out = rec.join(fills, "spectrum_id", "left")
    return out.select(
        "spectrum_id",
        *(F.coalesce(F.col(f), F.col(f"fill_{f}")).alias(f) for f in FIELDS),
        *(f"{f}_filled" for f in FIELDS),
    )
