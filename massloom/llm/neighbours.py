"""The most similar vectors of every vector, by balanced posting lists.

Centroids are fitted on a bounded sample (oversized clusters are split until lists are about equally long). A layered
graph of near centroids, held in memory, finds the nearest centroids of each vector; those whose distance is within a
ratio of the nearest one's are its lists. A vector is stored in the first few of them (boundary vectors in several) and
looks for its neighbours in all of them. Beyond ``FAN`` lists each list has centroids of its own, fitted in Spark from a bounded
sample of the list, and so on: the number of lists grows with the vectors and the depth with its logarithm. A vector goes down
all levels in one task and counts for the nearest lists of the last, so it is written and shuffled as often as with one level.
Within a list all comparisons are one product of matrices. Lists longer than a block are cut into blocks, and so are the
vectors that search them: each pair of a stored and a searching block is compared on its own, so no comparison holds more
than about two blocks however hot a list is.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from massloom.session import durable, durable_table

#: Vectors of one list, about; centroids of one level at most (which bounds what a task holds of them).
LIST_LENGTH, FAN = 250, 2048
#: A list is named by the list above it times NAMES, plus its place there (at most FAN).
NAMES = 2048
#: Sampled vectors for each centroid when centroids are fitted, and rounds of fitting.
SAMPLE_PER_LIST, ROUNDS = 12, 2
#: A centroid keeps its heaviest dimensions only, and all centroids of a level together the heaviest of the sample.
CENTROID_DIMENSIONS, DIMENSIONS = 96, 4096
#: Lists in which a vector is stored, lists that it searches, and the distance ratio that prunes both.
STORED, SEARCHED, RATIO = 2, 6, 1.35
#: Lists of one level in which a vector looks for lists of the next, at least; MB of centroids below the first level that a task keeps ready.
OPENED, READY_MB = 6, 200
#: Stored or searching vectors of one block, about, and the dimensions that are compared at a time.
BLOCK, DIMENSIONS_AT_A_TIME = 4096, 2048
#: Graph: near centroids of a centroid, nodes kept while searching, vectors that search together, and how many times
#: fewer nodes each layer has than the one below. The top layer has at most TOP nodes, and every search begins there.
DEGREE, BEAM, TOGETHER, THINNER, TOP = 12, 16, 256, 8, 32
#: Rows of a table that is sent to all tasks, at most; a longer one is joined by a shuffle.
MOST_BROADCAST = 100_000
#: Vectors, counted once for each list that they are in, that one task compares, about.
ENTRIES_PER_TASK = 100_000


def usable(mzs: Column, intensities: Column) -> Column:
    """Both arrays are there, not empty and equally long."""
    return (F.size(mzs) > 0) & (F.size(mzs) == F.size(intensities))


def peak_vectors(spectra: DataFrame, key: str, mzs: str, intensities: str) -> DataFrame:
    """``id``, ``dims``, ``vals``: for each whole Dalton of a usable spectrum the sum of the intensities, at length 1.

    Peaks with a null or NaN part are left out; a spectrum of length 0 has no direction, so it has no vector. ``dims``
    (int32, ascending) and ``vals`` (float32) are the packed entries that aren't 0.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column("m").offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), lengths)
            m = b.column("m").flatten().to_numpy(zero_copy_only=False).astype(float)
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
            good = np.isfinite(m) & np.isfinite(x) & (np.abs(m) < 2**31 - 1)
            row, dim, x = row[good], np.floor(m[good]).astype(np.int64), x[good]
            order = np.lexsort((dim, row))
            row, dim, x = row[order], dim[order], x[order]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (dim[1:] != dim[:-1])][: len(row)])
            total = np.add.reduceat(x, new) if len(new) else x
            row, dim = row[new], dim[new].astype(np.int32)
            norm = np.sqrt(np.bincount(row, total**2, b.num_rows))
            fine = norm > 0
            val = (total / np.where(fine, norm, 1)[row]).astype(np.float32)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            kept = np.flatnonzero(fine)
            cut = lambda a: pa.array([a[ends[i] : ends[i + 1]].tobytes() for i in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(kept)), cut(dim), cut(val)], names=["id", "dims", "vals"])

    rows = spectra.where(usable(F.col(mzs), F.col(intensities))).select(
        F.col(key).alias("id"), F.col(mzs).cast("array<double>").alias("m"), F.col(intensities).cast("array<double>").alias("x")
    )
    return rows.mapInArrow(build, f"id {dict(spectra.dtypes)[key]}, dims binary, vals binary")


class Sparse:
    """Rows of packed vectors: where each starts, its dimensions and its values."""

    def __init__(self, dims: pa.Array, vals: pa.Array) -> None:
        packed = dims.to_pylist()
        self.starts = np.r_[0, np.cumsum([len(d) // 4 for d in packed])].astype(np.int64)
        self.dims = np.frombuffer(b"".join(packed), np.int32)
        self.vals = np.frombuffer(b"".join(vals.to_pylist()), np.float32)
        self.n = len(packed)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.starts))

    def only(self, rows: np.ndarray) -> Sparse:
        """The given rows."""
        out, length = Sparse.__new__(Sparse), np.diff(self.starts)[rows]
        out.n, out.starts = len(rows), np.r_[0, np.cumsum(length)]
        at = np.repeat(self.starts[rows] - out.starts[:-1], length) + np.arange(out.starts[-1])
        out.dims, out.vals = self.dims[at], self.vals[at]
        return out

    def dense(self, space: np.ndarray) -> np.ndarray:
        """The rows over the ascending dimensions ``space``; other dimensions are left out."""
        out = np.zeros((self.n, len(space)), np.float32)
        at = np.minimum(np.searchsorted(space, self.dims), max(len(space) - 1, 0))
        known = space[at] == self.dims if len(space) else np.zeros(len(self.dims), bool)
        out[self.rows()[known], at[known]] = self.vals[known]
        return out


class Centroids:
    """Centroids over their own dimensions, with the layered graph by which the nearest are found.

    Each layer holds every ``THINNER``-th node of the one below at random, linked to its ``DEGREE`` nearest of the layer, both ways.
    """

    def __init__(self, space: np.ndarray, matrix: np.ndarray) -> None:
        self.space, self.matrix = space, matrix
        drawn = np.random.default_rng(1).permutation(len(matrix))
        sizes = [len(matrix)]
        while sizes[-1] > TOP:
            sizes.append(-(-sizes[-1] // THINNER))
        self.layers = [(np.sort(drawn[:m]), self._links(matrix[np.sort(drawn[:m])])) for m in reversed(sizes)]

    @staticmethod
    def _links(matrix: np.ndarray) -> np.ndarray:
        m = len(matrix)
        degree = min(DEGREE, m)
        linked = np.zeros((m, m), bool)
        for s in range(0, m, 512):
            near = np.argpartition(-(matrix[s : s + 512] @ matrix.T), degree - 1, axis=1)[:, :degree]
            linked[np.arange(s, s + len(near))[:, None], near] = True
        return linked | linked.T

    def nearest(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """For each dense row of ``x``, ``want`` near centroids and their cosines, nearest first, by a search along the graph."""
        want = min(want, len(self.matrix))
        nodes, score = np.zeros((len(x), want), np.int32), np.zeros((len(x), want), np.float32)
        entry = (x @ self.matrix[self.layers[0][0]].T).argmax(1)
        order = np.argsort(entry, kind="stable")  # vectors that enter at the same node search together
        for s in range(0, len(x), TOGETHER):
            part = order[s : s + TOGETHER]
            nodes[part], score[part] = self._walk(x[part], want)
        return nodes, score

    def _walk(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        known = self.layers[0][0]
        for depth, (members, linked) in enumerate(self.layers):
            last = depth == len(self.layers) - 1
            beam = max(BEAM, want) if last else BEAM
            known = np.searchsorted(members, known)  # what the layer above found is in this one, too
            seen, done = np.zeros(len(members), bool), np.zeros(len(members), bool)
            seen[known] = True
            score = x @ self.matrix[members[known]].T
            while True:
                best = known[np.unique(_greatest(score, beam))]
                front = best[~done[best]]
                if not len(front):
                    break
                done[front] = True
                new = np.flatnonzero(linked[front].any(0) & ~seen)
                seen[new] = True
                known, score = np.concatenate([known, new]), np.concatenate([score, x @ self.matrix[members[new]].T], 1)
            if not last:
                known = members[np.sort(best)]
        top = _greatest(score, want)
        value = np.take_along_axis(score, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        return members[known[np.take_along_axis(top, order, 1)]], np.take_along_axis(value, order, 1)

    def packed(self) -> bytes:
        r, c = np.nonzero(self.matrix)
        return pickle.dumps((self.space, self.matrix.shape, r.astype(np.int32), c.astype(np.int32), self.matrix[r, c]))

    @staticmethod
    def unpacked(data: bytes) -> Centroids:
        space, shape, r, c, v = pickle.loads(data)
        matrix = np.zeros(shape, np.float32)
        matrix[r, c] = v
        return Centroids(space, matrix)


def _greatest(score: np.ndarray, n: int) -> np.ndarray:
    """The columns of the ``n`` greatest values of each row, in no order."""
    if score.shape[1] <= n:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    return np.argpartition(-score, n - 1, axis=1)[:, :n]


def fit_centroids(sample: Sparse, k: int, seed: int = 3) -> Centroids:
    """About ``k`` centroids of a sample, from clusters of about equal size."""
    space, at = np.unique(sample.dims, return_inverse=True)
    if len(space) > DIMENSIONS:
        heaviest = np.argsort(-np.bincount(at, sample.vals.astype(float) ** 2, len(space)), kind="stable")[:DIMENSIONS]
        space = np.sort(space[heaviest])
    rng = np.random.default_rng(seed)
    k = max(1, min(k, sample.n))
    x = sample.dense(space)
    c = x[rng.choice(sample.n, k, replace=False)]
    fair = sample.n / k
    for _ in range(ROUNDS):
        label = np.concatenate([(x[s : s + 2048] @ c.T).argmax(1) for s in range(0, sample.n, 2048)])
        size = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        bounds = np.r_[0, np.cumsum(size)]
        new = []
        for j in range(k):
            own = order[bounds[j] : bounds[j + 1]]
            if not len(own):
                continue
            parts = int(np.ceil(len(own) / (3 * fair)))  # an oversized cluster becomes several
            new += [x[p].mean(0) for p in np.array_split(rng.permutation(own), parts)] if parts > 1 else [x[own].mean(0)]
        c = np.stack(new)
        if c.shape[1] > CENTROID_DIMENSIONS:
            floor = np.partition(c, -CENTROID_DIMENSIONS, axis=1)[:, -CENTROID_DIMENSIONS, None]
            c = np.where(c >= floor, c, 0)
        c = (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        k = len(c)
    return Centroids(space, c)


class Tree:
    """Centroids of the first level, and for each level below a mapping from lists to their own packed centroids."""

    def __init__(self, top: Centroids, below: list[dict[int, bytes]]) -> None:
        self.top, self.below, self.ready, self.held = top, below, {}, 0

    def _node(self, depth: int, name: int) -> Centroids:
        if (depth, name) not in self.ready:
            if self.held > READY_MB * 1e6:
                self.ready, self.held = {}, 0
            node = Centroids.unpacked(self.below[depth][name])
            self.ready[depth, name], self.held = node, self.held + node.matrix.nbytes
        return self.ready[depth, name]

    def lists_of(self, data: Sparse, wants: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """As ``lists_of``, by the lists of the last level, named below those above."""
        opened = wants if not self.below else np.maximum(wants, OPENED)
        wide = max(most, OPENED) if self.below else most
        first = [lists_of(data.only(np.arange(s, min(s + 4096, data.n))), self.top, opened[s : s + 4096], wide, ratio) for s in range(0, data.n, 4096)]
        lists, count, far = (np.concatenate(x) for x in zip(*first, strict=True))
        lists = lists.astype(np.int64)
        for depth in range(len(self.below)):
            known = np.isfinite(far)
            row, name, gap = np.nonzero(known)[0], lists[known], far[known]
            row, name, gap = self._below(data, depth, row, name, gap, opened)
            order = np.lexsort((name, gap, row))
            row, name, gap = row[order], name[order], gap[order]
            starts = np.searchsorted(row, np.arange(data.n))
            place = np.arange(len(row)) - starts[row]
            keep = place < (wants if depth == len(self.below) - 1 else opened)[row]
            row, name, gap, place = row[keep], name[keep], gap[keep], place[keep]
            lists, far = np.zeros((data.n, wide), np.int64), np.full((data.n, wide), np.inf)
            lists[row, place], far[row, place] = name, gap
            count = (far <= ratio * far[:, :1] + 1e-6).sum(1)
        return lists, count

    def _below(self, data: Sparse, depth: int, row: np.ndarray, name: np.ndarray, gap: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, ...]:
        """Vectors, lists of the next level below the given ones, and distances; a list without centroids of its own stays one list."""
        order = np.argsort(name, kind="stable")
        row, name, gap = row[order], name[order], gap[order]
        bounds = np.r_[np.flatnonzero(np.r_[True, name[1:] != name[:-1]][: len(name)]), len(name)]
        rows, names, gaps = [], [], []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            own, above = row[s:e], int(name[s])
            if above not in self.below[depth]:
                rows.append(own), names.append(np.full(e - s, above * NAMES)), gaps.append(gap[s:e])
                continue
            node = self._node(depth, above)
            found, cos = node.nearest(data.only(own).dense(node.space), int(opened[own].max()))
            rows.append(np.repeat(own, found.shape[1])), names.append(above * NAMES + found.ravel().astype(np.int64)), gaps.append(1 - np.clip(cos.ravel(), -1, 1))
        return np.concatenate(rows), np.concatenate(names), np.concatenate(gaps)


def fitted_below(vectors: DataFrame, tree: Tree, n: int, list_length: int) -> dict[int, bytes]:
    """Packed centroids for every list of the last level of ``tree`` that is nearest to more than four times ``list_length`` vectors.

    Only a sample of the vectors is placed and shuffled for it, once each; a task fits at most SAMPLE_PER_LIST * FAN of them, about.
    """
    share = min(1.0, SAMPLE_PER_LIST / list_length)
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("id", "dims", "vals")
    shared = vectors.sparkSession.sparkContext.broadcast((tree.top.packed(), tree.below))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(Centroids.unpacked(shared.value[0]), shared.value[1])
        for b in batches:
            if b.num_rows:
                lists, _ = own.lists_of(Sparse(b.column("dims"), b.column("vals")), np.ones(b.num_rows, int), 1, 1.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists[:, 0])], names=[*b.schema.names, "list"])

    types = ", ".join(f"{c} {t}" for c, t in some.dtypes)
    placed = durable_table(some.mapInArrow(place, f"{types}, list bigint"))
    fan = F.least(F.lit(FAN), F.ceil(F.col("n") / share / list_length)).cast("int")
    longer = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * list_length * share)
    longer = durable(longer.select("list", "n", fan.alias("fan")))
    drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.col("fan") * SAMPLE_PER_LIST / F.col("n")) * (1 << 30)
    sample = placed.join(small_enough(longer), "list").where(drawn)

    def fit(t: pa.Table) -> pa.Table:
        found = fit_centroids(Sparse(t.column("dims").combine_chunks(), t.column("vals").combine_chunks()), int(t.column("fan")[0].as_py()))
        return pa.table({"list": t.column("list").slice(0, 1), "centroids": pa.array([found.packed()], pa.binary())})

    got = sample.select("list", "fan", "dims", "vals").groupBy("list").applyInArrow(fit, "list bigint, centroids binary").toArrow()
    return dict(zip(got.column("list").to_pylist(), got.column("centroids").to_pylist(), strict=True))


def lists_of(data: Sparse, centroids: Centroids, wants: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector its nearest lists, nearest first, how many of them count (at most ``wants``, within the distance ratio), and the distances."""
    x = data.dense(centroids.space)
    lists, far = np.zeros((len(x), most), np.int32), np.full((len(x), most), np.inf)
    for want in np.unique(wants):
        rows = np.flatnonzero(wants == want)
        found, cos = centroids.nearest(x[rows], int(want))
        w = found.shape[1]
        lists[rows[:, None], np.arange(w)], far[rows[:, None], np.arange(w)] = found, 1 - np.clip(cos, -1, 1)
    return lists, (far <= ratio * far[:, :1] + 1e-6).sum(1), far  # nearest first, so what counts is a head of the list


def assigned(vectors: DataFrame, n: int, stored: int, searched: int, ratio: float, list_length: int) -> DataFrame:
    """A row of ``vectors`` (with ``asks``) for each ``list`` that it is ``stored`` in or, if it asks, searches."""
    k = min(FAN, max(1, n // list_length))
    most = SAMPLE_PER_LIST * k + 100
    share = min(1.0, (1.2 * most + 200) / max(n, 1))
    rows = vectors.select("dims", "vals", F.xxhash64("id").alias("h")).where(
        F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    )
    got = rows.orderBy("h").limit(most).select("dims", "vals").toArrow()  # at most SAMPLE_PER_LIST * FAN + 100 rows
    if not got.num_rows:
        return vectors.select("*", F.lit(True).alias("stored"), F.lit(0).cast("long").alias("list"))
    sample = Sparse(got.column("dims").combine_chunks(), got.column("vals").combine_chunks())
    tree = Tree(fit_centroids(sample, k), [])
    for _ in range(1, levels(n, list_length)):
        tree = Tree(tree.top, [*tree.below, fitted_below(vectors, tree, n, list_length)])
    shared = vectors.sparkSession.sparkContext.broadcast((tree.top.packed(), tree.below))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(Centroids.unpacked(shared.value[0]), shared.value[1])
        for b in batches:
            if b.num_rows:
                asks = b.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                wants = np.where(asks, max(stored, searched), stored)
                lists, count = own.lists_of(Sparse(b.column("dims"), b.column("vals")), wants, max(stored, searched), ratio)
                yield _entries(b, lists, count, np.full(len(asks), stored))

    types = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    placed = vectors.mapInArrow(place, f"{types}, lists array<bigint>, n_stored int")
    return list_entries(durable_table(placed))


def _entries(b: pa.RecordBatch, lists: np.ndarray, count: np.ndarray, stored: np.ndarray) -> pa.RecordBatch:
    """``b`` with its ``lists``, of which the first ``n_stored`` store the vector."""
    keep = np.arange(lists.shape[1]) < count[:, None]
    named = lists[keep]
    chosen = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(named, pa.int64()))
    n_stored = pa.array(np.minimum(count, stored), pa.int32())
    return pa.RecordBatch.from_arrays([*b.columns, chosen, n_stored], names=[*b.schema.names, "lists", "n_stored"])


def list_entries(placed: DataFrame) -> DataFrame:
    """A row for each list that a vector is ``stored`` in (the first ``n_stored`` of its ``lists``) or searches."""
    at = placed.select("id", "dims", "vals", "asks", "n_stored", F.posexplode("lists").alias("rank", "list"))
    return at.select("id", "dims", "vals", "asks", (F.col("rank") < F.col("n_stored")).alias("stored"), "list").where("stored OR asks")


def list_lengths(at: DataFrame) -> DataFrame:
    """``list``, ``held``, ``asking``: vectors that each list stores, and that search it. Kept, for it is used several times."""
    return durable(at.groupBy("list").agg(F.count_if("stored").alias("held"), F.count_if("asks").alias("asking")))


def small_enough(df: DataFrame) -> DataFrame:
    """``df``, to be sent to all tasks if it has few rows (it is kept already, so counting costs little)."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def levels(n: int, list_length: int) -> int:
    """Levels of lists for ``n`` vectors: as many as are needed for lists of about ``list_length``."""
    depth, room = 1, FAN * list_length
    while room * 4 < n:
        depth, room = depth + 1, room * FAN
    return depth


def dealt_to_blocks(at: DataFrame, lengths: DataFrame) -> DataFrame:
    """``at`` with a row for each ``list``, ``block`` and ``ask_block`` that a vector takes part in, ``stored`` and ``asks`` in it.

    A stored vector has one block and meets every ask block of its list; a searching one has one ask block and meets every block.
    """
    pieces = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int").alias(f"{c}_blocks")
    blocks = lengths.where((F.col("held") > BLOCK) | (F.col("asking") > BLOCK)).select("list", pieces("held"), pieces("asking"))
    at = at.join(small_enough(durable(blocks)), "list", "left").fillna(1, ["held_blocks", "asking_blocks"])
    h = F.xxhash64("id")
    at = at.withColumns({"own": F.pmod(h, "held_blocks").cast("int"), "own_ask": F.pmod(h, "asking_blocks").cast("int")})
    cell = lambda block, ask: F.struct(block.alias("block"), ask.alias("ask_block"))
    none = F.array().cast("array<struct<block:int,ask_block:int>>")
    as_stored = F.transform(F.sequence(F.lit(0), F.col("asking_blocks") - 1), lambda i: cell(F.col("own"), i))
    as_asking = F.transform(F.sequence(F.lit(0), F.col("held_blocks") - 1), lambda i: cell(i, F.col("own_ask")))
    cells = F.array_union(F.when(F.col("stored"), as_stored).otherwise(none), F.when(F.col("asks"), as_asking).otherwise(none))
    return at.withColumn("cell", F.explode(cells)).select(
        "id", "dims", "vals", "list", "cell.block", "cell.ask_block",
        (F.col("stored") & (F.col("own") == F.col("cell.block"))).alias("stored"),
        (F.col("asks") & (F.col("own_ask") == F.col("cell.ask_block"))).alias("asks"),
    )


def search_lists(dealt: DataFrame, k: int, least: float) -> DataFrame:
    """``id``, ``other``, ``cos``: per list and searching vector, the ``k`` best stored ones of each block with at least ``least``."""
    id_type = dict(dealt.dtypes)["id"]

    def compare(t: pa.Table) -> pa.Table:
        ids = t.column("id").combine_chunks()
        here, asks = t.column("stored").to_numpy(), t.column("asks").to_numpy()
        data, ask = np.flatnonzero(here), np.flatnonzero(asks)
        out_a, out_b, out_c = [], [], []
        if len(data) and len(ask):
            all_rows = Sparse(t.column("dims"), t.column("vals"))
            space = np.unique(all_rows.dims)
            spaces = [space[i : i + DIMENSIONS_AT_A_TIME] for i in range(0, len(space), DIMENSIONS_AT_A_TIME)]
            dense = all_rows.dense(spaces[0])
            stored = np.ascontiguousarray(dense[data].T)
            for s in range(0, len(ask), 1024):
                part = ask[s : s + 1024]
                cos = dense[part] @ stored
                for more in spaces[1:]:
                    cos += all_rows.only(part).dense(more) @ all_rows.only(data).dense(more).T
                same = np.searchsorted(data, part)
                same_ok = (same < len(data)) & (data[np.minimum(same, len(data) - 1)] == part)
                cos[np.flatnonzero(same_ok), same[same_ok]] = -2
                if cos.shape[1] > k:
                    best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                else:
                    best = np.broadcast_to(np.arange(cos.shape[1]), cos.shape)
                value = np.take_along_axis(cos, best, 1)
                r, c = np.nonzero(value >= max(least, -1.0))
                out_a.append(part[r])
                out_b.append(data[best[r, c]])
                out_c.append(value[r, c].astype(float))
        cat = lambda x, d: np.concatenate(x) if x else np.zeros(0, d)
        a, b, c = cat(out_a, int), cat(out_b, int), cat(out_c, float)
        return pa.table({"id": ids.take(pa.array(a, pa.int64())), "other": ids.take(pa.array(b, pa.int64())), "cos": pa.array(c)})

    return dealt.groupBy("list", "block", "ask_block").applyInArrow(compare, f"id {id_type}, other {id_type}, cos double").where("id != other")


def neighbours(
    spectra: DataFrame, key: str, mzs: str, intensities: str, k: int = 10, least: float = -1.0, queries: Column | None = None,
    stored: int = STORED, searched: int = SEARCHED, ratio: float = RATIO, list_length: int = LIST_LENGTH,
) -> DataFrame:
    """``id``, ``other``, ``cos``, ``rank``: for every usable spectrum its ``k`` most similar others.

    With ``queries``, a condition on ``id``, only for the spectra for which it holds, against all.

    Only neighbours with a cosine of at least ``least`` come out. Ties are ranked by ``other``. Spectra that aren't usable
    are neither searched nor found. Copies are neighbours of each other with cosine 1. A ``key`` that occurs in several
    rows is no neighbour of itself; its rows take places of their own in a search, so a list may then hold fewer than ``k``
    others. Cosines are exact to about 1e-6; the search is
    approximate: recall grows with ``stored``, ``searched`` and ``ratio``. An empty table gives an empty result.
    """
    vectors = peak_vectors(spectra, key, mzs, intensities)
    vectors = vectors.withColumn("asks", F.coalesce(queries if queries is not None else F.lit(True), F.lit(False)))
    n = spectra.where(usable(F.col(mzs), F.col(intensities))).count()
    at = assigned(vectors, n, stored, searched, ratio, list_length)
    lengths = list_lengths(at)
    entries = lengths.agg(F.sum(F.greatest("held", "asking"))).first()[0] or 0
    tasks = max(int(spectra.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // ENTRIES_PER_TASK))
    dealt = dealt_to_blocks(at, lengths).repartition(tasks, "list", "block", "ask_block")  # tasks stay equally large as rows grow
    found = search_lists(dealt, k, least)
    best = found.groupBy("id", "other").agg(F.max("cos").alias("cos"))  # a pair may meet in several lists
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cos"), "other"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
