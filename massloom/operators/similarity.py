"""Similarity of spectra: sparse products over bins as joins, and pairwise measures on pairs that a join has made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from massloom.functions.peaks import BIN_START, BIN_WIDTH, BINS, fine_bin, let
from massloom.session import durable

#: Spectra and queries of one cell, about; how many of each are multiplied at a time.
CELL, ASKING, HELD_AT_A_TIME, ASKED_AT_A_TIME = 131_072, 65_536, 2048, 128
#: Rows of a table that is sent to all tasks, at most; a longer one is joined by a shuffle.
MOST_BROADCAST = 100_000
#: Width (Da) of the cells in which queries meet their candidates, and queries of one cell at most, about.
POOL_WIDTH, ASKING_A_POOL = 2.0, 4096


def binned(spectra: DataFrame, key: str, ps: str, *carried: str, neighbours: bool = False) -> DataFrame:
    """``key``, ``carried``, ``bin``, ``v``: intensities at unit length summed per fine bin; with ``neighbours`` also one bin to each side.

    ``carried`` columns belong to the spectrum and go with each of its bins.
    """
    lengths = spectra.select(key, *carried, ps, _length(F.col(ps)).alias("length")).where("length > 0")  # once per spectrum, not per peak
    rows = lengths.select(key, *carried, F.explode(ps).alias("p"), "length")
    rows = rows.select(key, *carried, fine_bin(F.col("p.mz")).alias("bin"), (F.col("p.i") / F.col("length")).alias("v"))
    rows = rows.where("bin IS NOT NULL")
    if neighbours:
        rows = rows.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).where("bin >= 0 AND bin < 148000")
    return rows.groupBy(key, *carried, "bin").agg(F.sum("v").alias("v"))


def asked_buckets(queries: DataFrame, lo: Column, hi: Column, width: float) -> DataFrame:
    """``queries`` with the mass window ``lo`` to ``hi`` and a row for each mass ``bucket`` that it touches; queries without a window are left out."""
    windows = queries.withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    return windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))


def bins_met(queries: DataFrame, library: DataFrame, mass: str) -> DataFrame:
    """Bins that a query (``lo``, ``hi``, ``bucket``, ``bin``, ``vq``) shares with a spectrum (``bucket``, ``bin``, ``v``) whose mass is in its window.

    Mass bucket and bin are one join key, so only spectra of near mass meet; a spectrum has one bucket, so each shared bin comes once.
    """
    return queries.join(library, ["bucket", "bin"]).where(F.col(mass).between(F.col("lo"), F.col("hi")))


def fine_vectors(spectra: DataFrame, ps: str) -> DataFrame:
    """``spectra`` with ``bins`` and ``vals`` in place of ``ps``: its fine bins, ascending, and the sum of intensities at unit length in each.

    Spectra without length are left out; peaks outside the range are counted in the length only.
    """
    kept = [c for c in spectra.columns if c != ps]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(b.column("mzs")), 0).to_numpy(zero_copy_only=False))
            mz, i = (b.column(c).flatten() for c in ("mzs", "ints"))
            empty = np.bincount(row, i.is_null().to_numpy(zero_copy_only=False), b.num_rows) > 0
            mz, i = (x.to_numpy(zero_copy_only=False).astype(float) for x in (mz, i))
            length = np.sqrt(np.bincount(row, i * i, b.num_rows))
            use = np.flatnonzero(~empty & ~(length <= 0))
            at = np.floor((mz - BIN_START) / BIN_WIDTH)
            v = i / np.where(length <= 0, 1.0, length)[row]
            fine = (at >= 0) & (at < BINS)
            row, at, v = row[fine], at[fine].astype(np.int64), v[fine]
            order = np.argsort(row * BINS + at, kind="stable")
            row, at, v = _added_up(row[order], at[order], v[order])
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at.astype(np.int32), v)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *lists], names=[*kept, "bins", "vals"]).take(pa.array(use))

    types = ", ".join(f"{c} {t}" for c, t in spectra.dtypes if c != ps)
    return spectra.select(*kept, F.col(ps)["mz"].alias("mzs"), F.col(ps)["i"].alias("ints")).mapInArrow(build, f"{types}, bins array<int>, vals array<double>")


def _added_up(row: np.ndarray, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of equal row and bin, which lie side by side, as one."""
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])][: len(row)])
    return row[new], at[new], np.add.reduceat(v, new) if len(new) else v


def best_hits(
    queries: DataFrame, library: DataFrame, neighbours: bool = False, least: float | None = None, best: int = 1, top: int | None = None, digits: int | None = None
) -> DataFrame:
    """For each query and molecule the ``best`` spectra by ``cosine`` (ties by id), with ``n_matched`` shared bins and ``n_supporting``.

    ``queries`` have ``query_id``, ``source_spectrum_id``, a mass window ``lo`` to ``hi``, peaks ``ps`` and a row for each ``bucket``; ``library``
    has ``spectrum_id``, ``inchikey``, ``lib_mass``, ``ps`` (or its ``fine_vectors``) and one ``bucket``. Spectra meet in a query's window if they share a bin
    (with ``neighbours``, or one beside it), not with their own, and count from a cosine of ``least`` on. With ``digits`` cosines are rounded first. With ``top``
    a query has its ``top`` best molecules only (by the cosine to nine digits, then by key).

    Whole spectra are shuffled, not their bins, and pairs are multiplied and reduced in the task where they meet. A bucket with many spectra or queries
    is cut into cells; each gives its own best, so a query and molecule may have rows of several cells: choose among them again, and add up ``n_supporting``.
    """
    pieces = lambda c, size: F.ceil(F.col(c) / size).cast("int").alias(f"{c}_blocks")
    hot = F.map_from_entries(F.collect_list(F.when(F.col("n") > CELL // 4, F.struct("inchikey", F.ceil(F.col("n") / (CELL // 4))))))  # they are dealt to cells
    many = library.groupBy("bucket", "inchikey").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("held"), hot.alias("hot"))
    many = many.join(queries.groupBy("bucket").agg(F.count(F.lit(1)).alias("asking")), "bucket")
    many = durable(many.select("bucket", pieces("held", CELL), pieces("asking", ASKING), "hot"))
    many = F.broadcast(many) if many.count() <= MOST_BROADCAST else many
    cut = lambda df: df.join(many, "bucket")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda h, c: F.pmod(h, F.col(c)).cast("int")
    part = F.pmod(F.xxhash64("spectrum_id"), F.coalesce(F.try_element_at("hot", "inchikey"), F.lit(1)))
    asked = cut(fine_vectors(queries, "ps")).withColumn("ask_block", own(F.xxhash64("query_id"), "asking_blocks")).withColumn("block", every("held_blocks"))
    held = cut(library if "bins" in library.columns else fine_vectors(library, "ps")).withColumn("block", own(F.xxhash64("inchikey", part), "held_blocks")).withColumn("ask_block", every("asking_blocks"))
    cell = ["bucket", "block", "ask_block"]
    work = {*cell, "ps", "bins", "vals", "lo", "hi", "source_spectrum_id"}
    kept_q, kept_r = ([c for c in df.columns if c not in work] for df in (queries, library))

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        a, b, cosine, n, supporting = _best_of_cell(q.combine_chunks(), r.combine_chunks(), neighbours, least, best, top, digits)
        columns = {c: q.column(c).take(pa.array(a)) for c in kept_q} | {c: r.column(c).take(pa.array(b)) for c in kept_r}
        return pa.table(columns | {"cosine": pa.array(cosine), "n_matched": pa.array(n), "n_supporting": pa.array(supporting)})

    types = dict(queries.dtypes) | dict(library.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*kept_q, *kept_r)) + ", cosine double, n_matched bigint, n_supporting bigint"
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, *more: df.select(*cell, *more, "bins", "vals").repartition(tasks, *cell).groupBy(*cell)
    return dealt(asked, *kept_q, "lo", "hi", "source_spectrum_id").cogroup(dealt(held, *kept_r)).applyInArrow(compare, schema)


def _entries(t: pa.Table, rows: np.ndarray, neighbours: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in ``rows``, bin and value of the entries of the given rows; with ``neighbours`` also in the bins to both sides."""
    bins, vals = (t.column(c).take(pa.array(rows)).combine_chunks() for c in ("bins", "vals"))
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(bins).to_numpy(zero_copy_only=False))
    at, v = bins.flatten().to_numpy(zero_copy_only=False).astype(np.int64), vals.flatten().to_numpy(zero_copy_only=False)
    if neighbours:
        row, at, v = np.tile(row, 3), np.concatenate([at - 1, at, at + 1]), np.tile(v, 3)
        order = np.argsort(row * (BINS + 2) + at, kind="stable")
        row, at, v = _added_up(row[order], at[order], v[order])
        fine = (at >= 0) & (at < BINS)
        row, at, v = row[fine], at[fine], v[fine]
    return row, at, v


def _first(sorted_by: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first ``n`` of their group, groups being runs of equal values."""
    starts = np.flatnonzero(np.r_[True, sorted_by[1:] != sorted_by[:-1]][: len(sorted_by)])
    return np.arange(len(sorted_by)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_by)])) < n


def _best_of_cell(q: pa.Table, r: pa.Table, neighbours: bool, least: float | None, best: int, top: int | None, digits: int | None) -> tuple[np.ndarray, ...]:
    """Rows of ``q`` and ``r``, cosine, shared bins and supporting spectra of the hits that ``best_hits`` keeps of one cell."""
    none = np.zeros(0, np.int64)
    if not q.num_rows or not r.num_rows:
        return none, none, none.astype(float), none, none
    number = lambda t, c: t.column(c).to_numpy().astype(float)
    keys = r.column("inchikey").combine_chunks().dictionary_encode()
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    place = np.empty(len(keys.dictionary), np.int64)
    place[pc.sort_indices(keys.dictionary).to_numpy()] = np.arange(len(place))
    key, ids, mass = place[keys.indices.to_numpy()], r.column("spectrum_id").to_numpy(), number(r, "lib_mass")
    order = np.argsort(mass, kind="stable")
    parts = [order[s : s + HELD_AT_A_TIME] for s in range(0, len(order), HELD_AT_A_TIME)]
    parts = [p[np.lexsort((ids[p], key[p]))] for p in parts]  # near masses together, then spectra of one molecule
    indexed = []
    for p in parts:
        row, at, v = _entries(r, p, False)
        by_bin = np.argsort(at, kind="stable")
        indexed.append((row[by_bin].astype(np.int32), v[by_bin], np.r_[0, np.cumsum(np.bincount(at, minlength=BINS))].astype(np.int32)))
    lo, hi, source = number(q, "lo"), number(q, "hi"), q.column("source_spectrum_id").to_numpy(zero_copy_only=False)
    asked, out = np.argsort(lo, kind="stable"), []
    for s in range(0, len(asked), ASKED_AT_A_TIME):
        some, found = asked[s : s + ASKED_AT_A_TIME], []
        qrow, qbin, qv = _entries(q, some, neighbours)
        for p, (row, v, starts) in zip(parts, indexed, strict=True):
            if mass[p].max() < lo[some].min() or mass[p].min() > hi[some].max():
                continue
            from_, n = starts[qbin], starts[qbin + 1] - starts[qbin]
            total = int(n.sum())
            if not total:
                continue
            at = np.arange(total) + np.repeat(from_ - (np.cumsum(n) - n), n)
            pair = np.repeat(qrow * len(p), n) + row[at]
            cosine = np.bincount(pair, np.repeat(qv, n) * v[at], len(some) * len(p))
            if least is None:
                shared = np.bincount(pair, minlength=len(cosine))
                hit = np.flatnonzero(shared)
                shared = shared[hit]
            else:
                hit = np.flatnonzero(~(cosine < least))  # NaN comes after all numbers
                shared = None
            a, b = np.divmod(hit, len(p))
            a, b, c = some[a], p[b], cosine[hit]
            m = mass[b]
            fine = ((m >= lo[a]) | np.isnan(m)) & ((m <= hi[a]) | np.isnan(hi[a])) & (ids[b] != source[a]) & (source[a] == source[a])
            a, b, c = a[fine], b[fine], c[fine]
            c = c if digits is None else np.round(c, digits)
            shared = np.zeros(len(a), np.int64) if shared is None else shared[fine]
            if len(a):
                found.append(_best_of_runs(a, b, c, shared, np.ones(len(a), np.int64), key, best))
        if found:
            a, b, c, shared, supporting = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((ids[b], -_rankable(c), key[b], a))
            a, b, c, shared, supporting = (x[by] for x in (a, b, c, shared, supporting))
            if len(found) > 1:
                a, b, c, shared, supporting = _best_of_runs(a, b, c, shared, supporting, key, best)
            if top is not None:
                by = np.lexsort((key[b], -np.round(_rankable(c), 9), a))
                by = by[_first(a[by], top)]
                a, b, c, shared, supporting = (x[by] for x in (a, b, c, shared, supporting))
            out.append((a, b, c, shared, supporting))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none.astype(float), none, none)


def _rankable(c: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(c), np.inf, c)


def _best_of_runs(a: np.ndarray, b: np.ndarray, c: np.ndarray, shared: np.ndarray, supporting: np.ndarray, key: np.ndarray, best: int) -> tuple[np.ndarray, ...]:
    """The ``best`` rows of each run of equal ``a`` and key of ``b`` by ``c`` (the first of equal ones); the first has the run's sum of ``supporting``."""
    k = key[b]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (k[1:] != k[:-1])])
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(a)]))
    left, total, chosen = _rankable(c), np.add.reduceat(supporting, starts), []
    for i in range(best):
        most = np.maximum.reduceat(left, starts)
        at = np.flatnonzero((left == most[run]) & (left > -np.inf))
        at = at[np.r_[True, run[at][1:] != run[at][:-1]][: len(at)]]
        chosen.append((at, total[run[at]] if i == 0 else np.zeros(len(at), np.int64)))
        left[at] = -np.inf
    at, supporting = (np.concatenate(x) for x in zip(*chosen, strict=True))
    back = np.argsort(run[at], kind="stable")
    at = at[back]
    return a[at], b[at], c[at], shared[at], supporting[back]


def _length(ps: Column) -> Column:
    return F.sqrt(F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["i"] * p["i"]))


def matched_cosine(q: Column, r: Column, shift: Column, within: float = 0.01) -> Column:
    """Sum over all peak pairs within ``within`` after ``shift`` of the products of intensities, over the lengths.

    A peak may meet several peaks, so the value can exceed 1; 0 if a list has no length.
    """
    meets = lambda p: F.aggregate(F.filter(q, lambda x: F.abs(x["mz"] + shift - p["mz"]) <= within), F.lit(0.0), lambda a, x: a + x["i"])
    dot = F.aggregate(r, F.lit(0.0), lambda a, p: a + p["i"] * meets(p))
    size = _length(q) * _length(r)
    return F.when(size > 0, dot / size).otherwise(0.0)


def modified_cosine(q: Column, r: Column, delta: Column, within: float = 0.01) -> Column:
    """The best of no shift and a shift by the difference of the precursors to either side."""
    return F.greatest(matched_cosine(q, r, F.lit(0.0), within), matched_cosine(q, r, delta, within), matched_cosine(q, r, -delta, within))


def entropy_gain(a: Column, b: Column) -> Column:
    """f(a + b) - f(a) - f(b) with f(x) = x ln x: what a bin with the shares a and b adds to the similarity, times ln 4."""
    f = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    return f(a + b) - f(a) - f(b)


def binned_entropy_similarity(queries: DataFrame, library: DataFrame, query_key: str, library_key: str) -> DataFrame:
    """``query_key``, ``library_key``, ``similarity``: 1 - (2 S(AB) - S(A) - S(B)) / ln 4 over shared bins, from sums only.

    With shares a and b that each sum to 1, all bins that aren't shared add up to what the shared ones leave, so the
    similarity is the sum over shared bins of f(a + b) - f(a) - f(b), f(x) = x ln x, over ln 4.
    """
    share = lambda df, key, name: df.groupBy(key, "bin").agg(F.sum("v").alias(name))
    a, b = share(queries, query_key, "a"), share(library, library_key, "b")
    gain = entropy_gain(F.col("a"), F.col("b"))
    return a.join(b, "bin").groupBy(query_key, library_key).agg((F.sum(gain) / F.log(F.lit(4.0))).alias("similarity"))


def greedy_cosine(pairs: DataFrame, q: str, r: str, delta: str, within: float = 0.015) -> DataFrame:
    """Adds ``greedy_cosine`` and ``n_matched`` to pairs of unit-length peak lists: each peak is used once.

    Each library peak asks for the query peak nearest to it, if that is within ``within`` (ties to the lower m/z); of several
    that ask for one peak the first in the list has it, and the others stay without. The best of the shifts 0, +delta and
    -delta counts, the first of equal ones. Null or empty lists give 0. The pairs come from a join, and stay in its partitions.
    """

    def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        p = lists.flatten()
        return np.repeat(np.arange(len(lists)), length), *(p.field(c).to_numpy(zero_copy_only=False) for c in ("mz", "i"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(s, 2000) for x in batches for s in range(0, x.num_rows, 2000)):
            qrow, qmz, qi = flat(b.column(q))
            rrow, rmz, ri = flat(b.column(r))
            d = b.column(delta).to_numpy(zero_copy_only=False).astype(float)
            best, count = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            for sign in (0, 1, -1):
                shift = sign * np.where(np.abs(d) >= 1e-4, d, 0.0)  # NaN, null and small: no shift
                mz = qmz + shift[qrow]
                order = np.lexsort((mz, qrow))
                row, mz, i = qrow[order], mz[order], qi[order]
                at = _nearest(row, mz, rrow, rmz)
                fine = np.flatnonzero((at >= 0) & (np.abs(mz[at] - rmz) <= within)) if len(mz) else np.zeros(0, int)
                _, first = np.unique(at[fine], return_index=True)
                used = fine[first]
                dot = np.bincount(rrow[used], i[at[used]] * ri[used], b.num_rows)
                n = np.bincount(rrow[used], minlength=b.num_rows)
                better = dot > best + 1e-9
                best, count = np.where(better, dot, best), np.where(better, n, count).astype(np.int32)
            kept = [c for c in b.schema.names if c not in (q, r)]
            columns = [b.column(c) for c in kept] + [pa.array(np.minimum(best, 1.0)), pa.array(count)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "greedy_cosine", "n_matched"])

    keep = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c not in (q, r))
    return pairs.mapInArrow(score, f"{keep}, greedy_cosine double, n_matched int")


def _nearest(row: np.ndarray, mz: np.ndarray, rrow: np.ndarray, rmz: np.ndarray) -> np.ndarray:
    """For each (``rrow``, ``rmz``) the place of the nearest ``mz`` of the same row (ascending in both); -1 if the row has none."""
    if not len(mz):
        return np.full(len(rmz), -1)
    room = 4.0 * (max(np.abs(mz).max(), np.abs(rmz).max() if len(rmz) else 0.0) + 1.0)  # rows lie apart on one axis
    key, asked = row * room + mz, rrow * room + rmz
    right = np.searchsorted(key, asked)
    left = np.searchsorted(key, key[np.maximum(right - 1, 0)])  # the first of equal ones
    gap = lambda at: np.where((at < len(mz)) & (row[np.minimum(at, len(mz) - 1)] == rrow), np.abs(mz[np.minimum(at, len(mz) - 1)] - rmz), np.inf)
    to_left, to_right = np.where(right > 0, gap(left), np.inf), gap(right)
    return np.where(np.isinf(to_left) & np.isinf(to_right), -1, np.where(to_left <= to_right, left, right))


def bit_total(words: Column) -> Column:
    """Bits set in a fingerprint of words."""
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over all bits of two fingerprints of words; 0 if neither has a bit."""
    both = bit_total(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = bit_total(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(either > 0, both / either).otherwise(0.0)


def _word_rows(words: pa.ChunkedArray) -> np.ndarray:
    """A row of words for each fingerprint, as wide as the longest; null ones have no bit."""
    lists = words.combine_chunks()
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(length) - length
    out = np.zeros((len(length), max(int(length.max(initial=0)), 1)), np.int64)
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(row)) - starts[row]] = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
    return out


def _spread(words: np.ndarray) -> np.ndarray:
    """Rows of words as rows of zeros and ones."""
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32)


def _bit_rows(words: pa.ChunkedArray) -> np.ndarray:
    """A row of zeros and ones for each fingerprint of words; null ones have no bit."""
    return _spread(_word_rows(words))


def _agreed(x: np.ndarray, y: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits that rows of ``x`` and hits ``y`` share; by ``strength``, the shared less the other bits of a row; the number of its bits."""
    w = min(x.shape[1], y.shape[1])
    both = (x[:, :w] @ y[:, :w].T).astype(float)
    n = x.sum(1).astype(float)
    return both, (strength * (2 * both - n[:, None])).sum(1), n


def _expected(agreed: np.ndarray, counts: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bits`` and ``size`` of ``analog_agreement``."""
    total, size = strength.sum(), np.sqrt(np.maximum(counts, 1))
    return np.zeros(len(size)) if total <= 0 else agreed / total / size, size


def analog_agreement(pool: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id``, ``candidate_id``, ``analog``, ``bits``, ``size`` of candidates (``query_id``, ``candidate_id``, ``fp``) whose query has hits (``query_id``, ``strength``, ``hit_fp``).

    ``analog`` is the best strength times Tanimoto. A bit's expectation is twice the share of the hits that have it, by strength, less one; ``bits`` is
    the sum over a candidate's bits by ``size``, the root of their number. Overlaps are one product of matrices per query; pairs are never rows.
    """

    def score(own: pa.Table, hit: pa.Table) -> pa.Table:
        if not own.num_rows or not hit.num_rows:
            own = own.slice(0, 0)
            return pa.table({"query_id": own.column("query_id"), "candidate_id": own.column("candidate_id"), **{c: pa.array([], pa.float64()) for c in ("analog", "bits", "size")}})
        y, strength = _bit_rows(hit.column("hit_fp")), hit.column("strength").to_numpy()
        analogs, agreed, counts = [], [], []
        for s in range(0, own.num_rows, 4096):
            both, a, n = _agreed(_bit_rows(own.column("fp").slice(s, 4096)), y, strength)
            either = n[:, None] + y.sum(1).astype(float) - both
            analogs.append((strength * np.where(either > 0, both / np.maximum(either, 1), 0.0)).max(1))
            agreed.append(a)
            counts.append(n)
        bits, size = _expected(np.concatenate(agreed), np.concatenate(counts), strength)
        return pa.table({"query_id": own.column("query_id"), "candidate_id": own.column("candidate_id"), "analog": np.concatenate(analogs), "bits": bits, "size": size})

    types = dict(pool.dtypes)
    schema = f"query_id {types['query_id']}, candidate_id {types['candidate_id']}, analog double, bits double, size double"
    left, right = pool.select("query_id", "candidate_id", "fp"), hits.select("query_id", "strength", "hit_fp")
    return left.groupBy("query_id").cogroup(right.groupBy("query_id")).applyInArrow(score, schema)


def bits_in_pools(queries: DataFrame, hits: DataFrame, catalog: DataFrame, mass: str) -> DataFrame:
    """``bits`` and ``size`` as of ``analog_agreement`` for the rows of ``catalog`` (``candidate_id``, ``mass``, ``fp``) in the windows of a query with hits, and what ranks them.

    ``queries`` have ``query_id`` and disjoint ascending ``windows``; ``hits`` are those of ``analog_agreement``. Added are the query's ``mean``, ``sd``,
    ``lo``, ``hi`` of ``bits``, ``size_mean`` and ``size_sd`` of ``bits`` by ``size``, its number ``n``, and ``place`` (ties of ``bits`` to nine digits by
    ``candidate_id``) and ``shared_rank``. Pairs grow as queries times candidates and are never shuffled: a query goes to one cell of near mass, a candidate to
    all cells whose queries can reach it, and a task reads a cell's candidates, then its queries one by one. A cell with many queries is cut, and its candidates repeated.
    """
    asked = queries.where(F.size("windows") > 0).withColumns({"lo": F.get("windows", 0)["lo"], "hi": F.element_at("windows", -1)["hi"]})
    asked = asked.withColumn("cell", F.floor(F.col("lo") / POOL_WIDTH))
    reach = asked.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.ceil(F.count(F.lit(1)) / ASKING_A_POOL).cast("int").alias("blocks"))
    reach = durable(reach)
    small = reach.count() <= MOST_BROADCAST
    sent = lambda df: F.broadcast(df) if small else df
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block")
    asked = asked.join(sent(reach.select("cell", "blocks")), "cell").select("query_id", "cell", block, F.col("windows.lo").alias("los"), F.col("windows.hi").alias("his"))
    own = hits.groupBy("query_id").agg(F.collect_list(F.struct("strength", "hit_fp")).alias("h"))
    asked = asked.join(own, "query_id").select(*asked.columns, F.col("h.strength").alias("strengths"), F.col("h.hit_fp").alias("hit_fps"))
    near = reach.withColumn("near", F.explode(F.sequence(F.floor(F.col("lo") / POOL_WIDTH), F.floor(F.col("hi") / POOL_WIDTH))))
    held = catalog.select("candidate_id", F.col(mass).cast("double").alias("mass"), "fp").withColumn("near", F.floor(F.col("mass") / POOL_WIDTH))
    held = held.join(sent(near), "near").where(F.col("mass").between(F.col("lo"), F.col("hi")))
    held = held.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "candidate_id", "mass", "fp")
    rows = held.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", "asks")
    names = ["query_id", "candidate_id", "bits", "size", "mean", "sd", "lo", "hi", "size_mean", "size_sd", "n", "place", "shared_rank"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, pool, out, waiting = None, [], None, [], 0
        for b in batches:
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("cell", "block", "asks")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1 if b.num_rows else np.zeros(0, int)
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if s == e:
                    continue
                run = b.slice(s, e - s)
                if at != tuple(key[:2, s]):
                    at, parts, pool = tuple(key[:2, s]), [], None
                if not key[2, s]:
                    parts.append(run.select(["candidate_id", "mass", "fp"]))
                    continue
                if not parts:
                    continue
                pool = pool or _by_mass(pa.Table.from_batches(parts))
                for i in range(run.num_rows):
                    some = _ranked_pool(pool, *(run.column(c).slice(i, 1).flatten() for c in ("los", "his", "strengths", "hit_fps")))
                    if some:
                        out.append([pa.repeat(run.column("query_id")[i], len(some[0])), *some])
                        waiting += len(some[0])
                    if waiting >= 10_000:
                        yield from pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names=names) for x in out]).combine_chunks().to_batches(max_chunksize=10_000)
                        out, waiting = [], 0
        if out:
            yield from pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names=names) for x in out]).combine_chunks().to_batches(max_chunksize=10_000)

    ids = f"query_id {dict(queries.dtypes)['query_id']}, candidate_id {dict(catalog.dtypes)['candidate_id']}"
    return rows.mapInArrow(score, f"{ids}, {', '.join(f'{c} double' for c in names[2:10])}, n bigint, place int, shared_rank int")


def _by_mass(held: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Masses, ascending, and with them words of the fingerprints, ids and the places of the ids in order."""
    held = held.sort_by("mass")
    ids = held.column("candidate_id").combine_chunks()
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return held.column("mass").to_numpy(), _word_rows(held.column("fp")), ids, order


def _ranked_pool(pool: tuple, los: pa.Array, his: pa.Array, strengths: pa.Array, hit_fps: pa.Array) -> list[pa.Array] | None:
    """The columns of ``bits_in_pools`` after the query's id for one query."""
    mass, words, ids, order = pool
    starts, ends = (np.searchsorted(mass, x.to_numpy(), side) for x, side in ((los, "left"), (his, "right")))
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
    if not len(rows):
        return None
    y, strength = _bit_rows(pa.chunked_array([hit_fps])), strengths.to_numpy(zero_copy_only=False)
    agreed, counts = zip(*(_agreed(_spread(words[rows[s : s + 4096]]), y, strength)[1:] for s in range(0, len(rows), 4096)), strict=True)
    bits, size = _expected(np.concatenate(agreed), np.concatenate(counts), strength)
    rounded = np.round(_rankable(bits), 9)
    by = np.lexsort((order[rows], -rounded))
    place, shared, sorted_ = np.empty(len(by), np.int32), np.empty(len(by), np.int32), rounded[by]
    place[by] = np.arange(1, len(by) + 1)
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    shared[by] = np.maximum.accumulate(np.where(new, np.arange(1, len(by) + 1), 0))
    by_size = bits / size
    of_query = [np.full(len(rows), x) for x in (bits.mean(), bits.std(), bits.min(), bits.max(), by_size.mean(), by_size.std())]
    return [ids.take(pa.array(rows)), *map(pa.array, (bits, size, *of_query, np.full(len(rows), len(rows)), place, shared))]


def whole_vectors(spectra: DataFrame, key: str, ps: str) -> DataFrame:
    """``key``, ``vec``: intensities summed per whole Dalton at unit length, in order of the bin. Lists that are null, empty or all zero have none.

    The lists are shuffled once, by ``key``, and spread out after.
    """
    rows = spectra.where(F.size(ps) > 0).select(key, ps).repartition(key).select(key, F.explode(ps).alias("p"))
    sums = rows.groupBy(key, F.floor("p.mz").alias("bin")).agg(F.sum("p.i").alias("v"))
    lists = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("vec"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    unit = F.transform("vec", lambda x: F.struct(x["bin"].alias("bin"), F.round(x["v"] / F.col("n"), 9).alias("v")))
    return lists.where("n > 0").select(key, unit.alias("vec"))


def near_identical(a: DataFrame, b: DataFrame, least: float = 0.999) -> DataFrame:
    """``digest_a``, ``digest_b``, ``cosine``: all pairs of distinct unit vectors (``digest``, ``vec``) whose cosine is at least ``least``.

    Such vectors are at most d = sqrt(2 - 2 least) apart, so in the highest bin of one the other's value differs by at most d and is
    within 2 d of its own highest; and put in order, their values are no further apart either. Vectors meet on that bin and the slots
    of that value and of the second highest: few entries each, and no pair is missed.
    """
    d = (2 - 2 * least) ** 0.5 + 1e-6  # room for the rounding of values
    values = F.slice(F.sort_array(F.transform("vec", lambda x: x["v"]), asc=False), 1, 8)
    second = F.coalesce(F.get("ordered", 1), F.lit(0.0))
    around = lambda c: F.explode(F.array(F.floor(c / d) - 1, F.floor(c / d), F.floor(c / d) + 1))
    highest = F.array_max(F.transform("vec", lambda x: F.struct(x["v"].alias("v"), (-x["bin"]).alias("b"))))
    asked = a.select(F.col("digest").alias("digest_a"), F.col("vec").alias("va"), highest.alias("h"), values.alias("ordered"))
    asked = asked.select("digest_a", "va", F.col("ordered").alias("oa"), second.alias("s2"), (-F.col("h.b")).alias("bin"), around(F.col("h.v")).alias("slot")).withColumn("slot2", around(F.col("s2")))
    held = b.select(F.col("digest").alias("digest_b"), F.col("vec").alias("vb"), values.alias("ordered"))
    held = held.select("digest_b", "vb", F.col("ordered").alias("ob"), second.alias("s2"), F.explode(F.filter("vb", lambda x: x["v"] >= F.get("ordered", 0) - 2 * d)).alias("x"))
    held = held.select("digest_b", "vb", "ob", F.col("x.bin").alias("bin"), F.floor(F.col("x.v") / d).alias("slot"), F.floor(F.col("s2") / d).alias("slot2"))
    apart = F.zip_with("oa", "ob", lambda x, y: F.pow(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)), 2))
    pairs = asked.join(held, ["bin", "slot", "slot2"]).where(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) <= d * d)
    product = lambda by_bin: F.aggregate("va", F.lit(0.0), lambda s, x: s + x["v"] * F.coalesce(F.try_element_at(by_bin, x["bin"]), F.lit(0.0)))
    dot = let(F.map_from_entries("vb"), product)
    return pairs.select("digest_a", "digest_b", F.round(dot, 6).alias("cosine")).where(F.col("cosine") >= least)
