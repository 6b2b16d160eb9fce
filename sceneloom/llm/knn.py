"""Most similar vectors for every vector (problem 3).

Vectors of unit length are projected to ``M`` numbers by a fixed matrix of normal
deviates. The projection is 2-stable: whatever the direction, each number of the
difference of two vectors at distance d is normal with variance d squared, so the
squared projected distance over the squared true one follows a chi-square law with M
degrees of freedom. A kd-tree over the projections is the index. Its upper levels,
fitted on a bounded sample, cut the space into cells that are tasks; its lower levels
are built inside each task. A row is searched in its own leaf first, then in the other
leaves; in each leaf the points whose projected distance passes the chi-square test
are verified by their true distance. The search stops at leaves so far that a point
as near as the k-th best so far (or as the similarity asked for) would lie there with
a small probability only.

How far a leaf may be follows from the same law: a true neighbour differs from the row
by M normal deviates, but only what crosses the sides of a box counts as distance to
the box. That part has no closed form; ``Tree.law`` takes its quantiles from draws: a
unit vector of similarity s to one projected to x projects to s x plus sqrt(1 - s s)
times normal deviates. So the test fits any data and any tree. It is far narrower than the chi-square law of the whole distance, which no split of a
low-dimensional space would pass.

Rows are sent to the cells that this test can't rule out. In a self-join each pair may
be found from either side, so each side's test may be the narrower.

Equal vectors (after scaling to unit length, to 13 bits) form a class and are searched
once; a class gives its members' neighbours from the k + 1 smallest ids of each class,
so that copies don't multiply. Similarities carry an error of about 1e-5, as vectors
travel as 16-bit numbers.

Defined results: vectors that are null, of another length, zero or not finite take no
part, as do rows without id; of repeated rows of an id the latest counts; equal
similarities are ordered by id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint

#: Numbers of a projection, and the probability that the chi-square test keeps a true neighbour.
M, P = 16, 0.999
#: The probability that a box with a true neighbour is visited, where a pair can be found from one side, and from both.
BOX_P, BOX_P_BOTH = 0.99, 0.975
#: Rows that the upper kd-tree is fitted on; every row is indexed.
SAMPLE = 20_000
#: Fewest cells; rows of a cell; rows of a leaf; rows that are searched at a time.
CELLS, CELL_ROWS, LEAF, BATCH = 8, 200_000, 512, 16_384
#: Similarities at which the law of boxes is taken, and draws for each.
LAW_AT, DRAWS = (-0.5, 0.0, 0.2, 0.4, 0.6, 0.8, 0.9, 0.95, 0.98, 1.0), 4_000
#: Rows whose true neighbours are looked up to fit how far boxes may be, and pairs needed for it.
PROBES, LEAST_PAIRS = 256, 50


def chi_square(p: float, m: int) -> float:
    """Quantile of the chi-square law (Wilson and Hilferty's approximation)."""
    a = 2 / (9 * m)
    return m * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


@cache
def projection(dims: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(20_24).standard_normal((dims, m)).astype(np.float32)


def decode(q: pa.Array, scale: pa.Array, dims: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(q.to_pylist()), np.int16).reshape(-1, dims)
    return flat.astype(np.float32) * (scale.to_numpy(zero_copy_only=False).astype(np.float32) / 32767)[:, None]


def _prepare(dims: int):
    odd = (np.random.default_rng(7).integers(0, 1 << 62, dims, np.int64) * 2 + 1).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, loaded = (batch.column(i) for i in range(3))
            size = np.array([-1 if v is None else v for v in pa.compute.list_value_length(vectors).to_pylist()])
            use = np.flatnonzero((size == dims) & ~np.asarray(pa.compute.is_null(ids)))
            flat = pa.compute.list_flatten(vectors.take(pa.array(use)))
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max(axis=1, initial=0, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            fine = np.isfinite(x).all(axis=1)
            use, x = use[fine], x[fine]
            top = np.abs(x).max(axis=1, initial=0)
            q = np.rint(x / top[:, None] * 32767).astype(np.int16)
            rounded = np.rint(x * 8192).astype(np.int64).view(np.uint64)
            key = (rounded * odd).sum(axis=1, dtype=np.uint64)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
            at = pa.array(use)
            yield pa.record_batch(
                [ids.take(at), pa.array(key.view(np.int64)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(top.astype(np.float32)), loaded.take(at)],
                names=["id", "cls", "q", "scale", "loaded"],
            )

    return run


class Tree:
    """A kd-tree: splits of the projected space into ``cells`` boxes, each at a quantile of the widest axis."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.cells, m = max(1, cells), points.shape[1]
        self.low, self.high = np.full((self.cells, m), -np.inf, np.float32), np.full((self.cells, m), np.inf, np.float32)
        self.root = self._split(points, 0, self.cells)

    def _split(self, points: np.ndarray, first: int, count: int):
        """Cells first..first+count-1 share the points, in proportion. A node is a cell, or (axis, cut, below, above)."""
        if count == 1:
            return first
        left = count // 2
        axis = int(np.argmax(points.var(axis=0))) if len(points) else 0
        cut = np.float32(np.quantile(points[:, axis], left / count)) if len(points) else np.float32(0)
        below = points[:, axis] <= cut
        self.high[first : first + left, axis] = np.minimum(self.high[first : first + left, axis], cut)
        self.low[first + left : first + count, axis] = np.maximum(self.low[first + left : first + count, axis], cut)
        return axis, cut, self._split(points[below], first, left), self._split(points[~below], first + left, count - left)

    def cell(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not isinstance(node, tuple):
                out[at] = node
                continue
            axis, cut, below, above = node
            under = points[at, axis] <= cut
            todo += [(below, at[under]), (above, at[~under])]
        return out

    def visits(self, points: np.ndarray, limit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, points): those whose squared distance to the cell's box is at most their limit, which may shrink on the way."""
        n, m = points.shape
        todo = [(self.root, np.arange(n), np.zeros((n, m), np.float32), np.zeros(n, np.float32))]
        while todo:
            node, at, gaps, far = todo.pop()
            if not isinstance(node, tuple):
                near = far <= limit[at]
                if near.any():
                    yield node, at[near]
                continue
            axis, cut, below, above = node
            beyond = points[at, axis] - cut
            for child, gap in ((below, np.maximum(beyond, 0)), (above, np.maximum(-beyond, 0))):
                wider = np.maximum(gaps[:, axis], gap)
                total = far - gaps[:, axis] ** 2 + wider**2
                near = np.flatnonzero(total <= limit[at])
                if near.size:
                    part = gaps[near]
                    part[:, axis] = wider[near]
                    todo.append((child, at[near], part, total[near]))

    def law(self, points: np.ndarray, p: float, seed: int = 5) -> np.ndarray:
        """For each similarity of ``LAW_AT``: the squared distance to its box within which a point so similar lies with probability p."""
        if self.cells == 1 or not len(points):
            return np.full(len(LAW_AT), np.inf)
        rng = np.random.default_rng(seed)
        x = points[rng.integers(0, len(points), DRAWS)]
        noise = rng.standard_normal(x.shape).astype(np.float32)
        out = []
        for s in LAW_AT:
            c = self.cell(np.float32(s) * x + np.float32((1 - s * s) ** 0.5) * noise)
            gap = np.maximum(0, np.maximum(self.low[c] - x, x - self.high[c]))
            out.append(np.quantile((gap * gap).sum(axis=1), p))
        return np.array(out)


class Reach:
    """How far a box may be that has a neighbour of a given similarity.

    The wider of two laws: that of draws (``Tree.law``), and the distances, in units of the true ones, at which the
    true neighbours of a few rows of the index lie. In clustered data neighbours lie more across the sides of boxes
    than draws do.
    """

    def __init__(self, tree: Tree, vectors: np.ndarray, points: np.ndarray, k: int, floor: float | None, p: float) -> None:
        self.law, self.ratio = tree.law(points, p), 0.0
        if tree.cells == 1 or len(points) <= k:
            return
        pick = np.random.default_rng(3).choice(len(points), min(PROBES, len(points)), replace=False)
        s = vectors[pick] @ vectors.T
        s[np.arange(len(pick)), pick] = -9
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(s, near, axis=1)
        x, y = np.nonzero((sims >= (-2.0 if floor is None else floor)) & (sims < 1 - 1e-5))
        if len(x) < LEAST_PAIRS:
            return
        c, at = tree.cell(points[near[x, y]]), points[pick[x]]
        gap = np.maximum(0, np.maximum(tree.low[c] - at, at - tree.high[c]))
        self.ratio = float(np.quantile((gap * gap).sum(axis=1) / (2 - 2 * sims[x, y]), p))

    def __call__(self, similarity: np.ndarray | float) -> np.ndarray:
        if not np.isfinite(self.law).all():
            return np.full(np.shape(similarity), np.inf, np.float32)
        return np.maximum(np.interp(similarity, LAW_AT, self.law), self.ratio * (2 - 2 * np.asarray(similarity))).astype(np.float32)


def _route(tree: Tree, dims: int, far: float):
    """Rows to the cells that may hold neighbours of theirs: (task, home, cls, q, scale, asks). Every row goes to its own cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, q, scale, asks = (batch.column(i) for i in range(4))
            p = decode(q, scale, dims) @ projection(dims)
            home, asking = tree.cell(p), np.flatnonzero(asks.to_numpy(zero_copy_only=False))
            rows, tasks, own = [np.arange(len(p))], [home], [np.ones(len(p), bool)]
            for cell, at in tree.visits(p[asking], np.full(len(asking), far, np.float32)):
                at = asking[at]
                at = at[home[at] != cell]
                rows.append(at)
                tasks.append(np.full(len(at), cell))
                own.append(np.zeros(len(at), bool))
            take = pa.array(np.concatenate(rows))
            yield pa.record_batch(
                [pa.array(np.concatenate(tasks).astype(np.int32)), pa.array(np.concatenate(own)), cls.take(take), q.take(take), scale.take(take), asks.take(take)], names=["task", "home", "cls", "q", "scale", "asks"]
            )

    return run


class Best:
    """The k best neighbours of each of n points, from pairs that come in any order."""

    def __init__(self, n: int, k: int, floor: float) -> None:
        self.k, self.kth, self.parts, self.held = k, np.full(n, floor, np.float32), [], 0

    def add(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> None:
        keep = s >= self.kth[a]
        if keep.any():
            self.parts.append((a[keep], b[keep], s[keep]))
            self.held += int(keep.sum())
            if self.held > 2 * self.k * len(self.kth) + 100_000:
                self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        a, b, s = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        full = rank == self.k - 1
        self.kth[a[full]] = s[full]
        keep = rank < self.k
        self.parts, self.held = [(a[keep], b[keep], s[keep])], int(keep.sum())
        return self.parts[0]


class Index:
    """The rows of one cell: their kd-tree, and the search of other rows in it."""

    def __init__(self, cls: np.ndarray, vectors: np.ndarray, k: int, floor: float | None, box_p: float, leaf: int) -> None:
        self.cls, self.k, self.floor = cls, k, floor
        p = vectors @ projection(vectors.shape[1])
        self.tree = Tree(p, -(-len(p) // leaf))
        self.reach, self.point = Reach(self.tree, vectors, p, k, floor, box_p), chi_square(P, M)
        place = self.tree.cell(p)
        order = np.argsort(place, kind="stable")
        self.leaves = np.split(order, np.searchsorted(place[order], np.arange(1, self.tree.cells)))
        norm = (p * p).sum(axis=1)
        self.held = [(vectors[h], np.concatenate([p[h], np.ones((len(h), 1), np.float32), norm[h, None]], axis=1)) for h in self.leaves]

    def _meet(self, best: Best, leaf: int, at: np.ndarray, v: np.ndarray, p: np.ndarray, norm: np.ndarray, cls: np.ndarray) -> None:
        """Verify the points of a leaf for some rows."""
        h, (vh, packed) = self.leaves[leaf], self.held[leaf]
        if not len(h) or not len(at):
            return
        limit = (self.point * (2 - 2 * best.kth[at])).astype(np.float32)
        need = None
        if limit.max() < 2 * self.point:
            left = np.concatenate([-2 * p[at], (norm[at] - limit)[:, None], np.ones((len(at), 1), np.float32)], axis=1)
            near = np.flatnonzero((left @ packed.T).ravel() <= 0)
            if near.size < 0.02 * len(at) * len(h):
                need = np.divmod(near, len(h))
        if need is None:
            s = v[at] @ vh.T
            hit = s >= best.kth[at][:, None]
            if hit.sum() > 4 * self.k * len(at):
                some = min(self.k + 1, len(h))  # one more, as a row may meet itself
                hit = np.zeros_like(hit)
                np.put_along_axis(hit, np.argpartition(-s, some - 1, axis=1)[:, :some], True, axis=1)
            need = np.nonzero(hit)
            sims = s[need]
        else:
            sims = np.einsum("ij,ij->i", v[at[need[0]]], vh[need[1]])
        a, b = at[need[0]], h[need[1]]
        other = self.cls[b] != cls[a]
        if other.any():
            best.add(a[other], b[other], sims[other])

    def search(self, cls: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cls, other, similarity): the best rows of the cell for each of these rows."""
        best = Best(len(v), self.k, -2.0 if self.floor is None else self.floor - 2e-5)
        p = v @ projection(v.shape[1])
        norm = (p * p).sum(axis=1)
        first = self.tree.cell(p)
        order = np.argsort(first, kind="stable")
        for leaf, at in enumerate(np.split(order, np.searchsorted(first[order], np.arange(1, self.tree.cells)))):
            self._meet(best, leaf, at, v, p, norm, cls)
        best.shrink()
        limit = self.reach(best.kth)
        for leaf, at in self.tree.visits(p, limit):
            self._meet(best, leaf, at[first[at] != leaf], v, p, norm, cls)
            if best.held > best.k * len(v):
                best.shrink()
                limit[:] = self.reach(best.kth)
        a, b, s = best.shrink()
        return cls[a], self.cls[b], s


_SENT = pa.schema([("task", pa.int32()), ("home", pa.bool_()), ("cls", pa.int64()), ("q", pa.binary()), ("scale", pa.float32()), ("asks", pa.bool_())])


def _verify(k: int, floor: float | None, dims: int, box_p: float, leaf: int, most: int):
    """The search of the rows sent to a cell, whose own rows come first; other rows are searched as they come."""

    def unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return rows["cls"].to_numpy(), decode(rows["q"].combine_chunks(), rows["scale"].combine_chunks(), dims)

    def found(index: Index, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for start in range(0, rows.num_rows, most):
            a, b, s = index.search(*unpack(rows.slice(start, most)))
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(s.astype(np.float64))], names=["cls", "other", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, index, own, waiting = None, None, [], []

        def settle() -> Iterator[pa.RecordBatch]:
            """Index the own rows, and search those of them that ask."""
            nonlocal index, own
            if own:
                rows, own = pa.Table.from_batches(own, _SENT), []
                index = Index(*unpack(rows), k, floor, box_p, leaf)
                yield from found(index, rows.filter(rows["asks"]))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            yield from settle()
            if waiting and index is not None:
                yield from found(index, pa.Table.from_batches(waiting, _SENT))
            waiting = []

        for batch in batches:
            while batch.num_rows:
                first = batch.column(0)[0].as_py()
                if first != task:
                    yield from flush()
                    task, index = first, None
                same = int(np.argmax(np.append(batch.column(0).to_numpy() != first, True)))
                part, batch = batch.slice(0, same), batch.slice(same)
                home = int(np.argmax(np.append(~batch_home(part), True)))
                if home:
                    own.append(part.slice(0, home))
                if home < part.num_rows:
                    waiting.append(part.slice(home))
                    if sum(b.num_rows for b in waiting) >= most:
                        yield from flush()
        yield from flush()

    return run


def batch_home(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).to_numpy(zero_copy_only=False).astype(bool)


def similar_vectors(df: DataFrame, id_column: str, vector: str, k: int = 10, floor: float | None = None, dims: int = 64, loaded_at: str | None = None, asks: str | None = None) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar other ids of each id.

    ``floor``: lowest similarity of a neighbour; without it every id gets k, which costs more, as far vectors
    leave the chi-square test little to rule out. ``asks``: a condition on the id column; only these ids get
    neighbours, from all rows. ``loaded_at``: which of repeated rows is the latest.
    """
    order = F.unix_micros(F.col(loaded_at).cast("timestamp")) if loaded_at else F.lit(0).cast("long")
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"), order.alias("loaded"))
    rows = checkpoint(rows.mapInArrow(_prepare(dims), "id string, cls bigint, q binary, scale float, loaded bigint"))
    count = rows.count()
    members = rows.groupBy("id").agg(F.max(F.struct("loaded", "cls")).alias("x")).select("id", F.col("x.cls").alias("cls")).withColumn("asks", F.expr(asks) if asks else F.lit(True))
    used = members.groupBy("cls").agg(F.max("asks").alias("asks"), F.count(F.lit(1)).alias("n"))
    classes = rows.groupBy("cls").agg(F.first("q").alias("q"), F.first("scale").alias("scale")).join(used, "cls").select("cls", "q", "scale", "asks")

    cells = max(CELLS, -(-count // CELL_ROWS))
    every = max(1, count // SAMPLE)
    sample = rows.where(F.pmod("cls", F.lit(every)) == 0).groupBy("cls").agg(F.first("q").alias("q"), F.first("scale").alias("scale")).limit(4 * SAMPLE).toArrow().combine_chunks()
    vectors = decode(sample["q"].combine_chunks(), sample["scale"].combine_chunks(), dims) if sample.num_rows else np.zeros((0, dims), np.float32)
    points = vectors @ projection(dims)
    tree = Tree(points, cells)

    both = floor is not None and asks is None
    box_p = BOX_P_BOTH if both else BOX_P
    far = float(Reach(tree, vectors, points, k, floor, box_p)(floor)) if floor is not None else np.inf
    sent = classes.mapInArrow(_route(tree, dims, far), "task int, home boolean, cls bigint, q binary, scale float, asks boolean")
    pairs = sent.repartitionById(cells, F.col("task")).sortWithinPartitions("task", F.desc("home")).mapInArrow(_verify(k, floor, dims, box_p, LEAF, BATCH), "cls bigint, other bigint, similarity double")
    if floor is not None:
        pairs = pairs.where(F.col("similarity") >= floor)
    if both:  # a pair that only one side has found serves the other as well
        pairs = pairs.select("cls", "other", "similarity", F.explode(F.array(F.lit(False), F.lit(True))).alias("turn")).select(F.when(F.col("turn"), F.col("other")).otherwise(F.col("cls")).alias("cls"), F.when(F.col("turn"), F.col("cls")).otherwise(F.col("other")).alias("other"), "similarity")
    by_class = Window.partitionBy("cls").orderBy(F.desc("similarity"), "other")
    # the two sides of a pair may differ in the last bit of the similarity
    pairs = pairs.groupBy("cls", "other").agg(F.max("similarity").alias("similarity"))
    nearest = pairs.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k).drop("r")

    # back to ids: members of a class are each other's neighbours, and stand for their class in the lists of others
    own = used.where("n > 1").select("cls", F.col("cls").alias("other"), F.lit(1.0).alias("similarity"))
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("cls").alias("other"), F.col("id").alias("neighbour"))
    ranked = (
        nearest.unionByName(own)
        .join(first, "other")
        .withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("similarity"), "neighbour")))
        .where(F.col("r") <= k + 1)
        .groupBy("cls")
        .agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "similarity"))).alias("list"))
    )
    listed = members.where("asks").join(ranked, "cls").select("id", F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("list"))
    return listed.select("id", F.posexplode("list").alias("pos", "x")).select("id", F.col("x.neighbour").alias("neighbour"), F.col("x.similarity").alias("similarity"), (F.col("pos") + 1).alias("rank"))
