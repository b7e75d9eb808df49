"""Exact top-k by inner product with two cover trees (operator 8).

The top level of the data's tree is shared by the whole cluster: a bounded sample of
vectors are pivots, every vector belongs to the cell of the pivot nearest by angle, and
each cell has a covering radius.  Below it a cover tree is built over the rows of each
cell: a node's children stand at least a scale apart, lie within its radius, and carry
what covers all that is below them.  Queries are indexed the same way.

A ball of centre c, radius r, angle a and norms up to M holds no vector whose inner
product with a query q exceeds either of

* q.c + |q| r (the ball) and
* |q| M cos(max(0, angle(q, c) - a)) (the cone, which is what lifting all norms to M
  and searching the nearest neighbour by angle comes to),

the second with the group's own angle taken off too where q is a group of queries.  A pair
of nodes is dropped when the lesser bound lies below the worst k-th score of the query
group; in a group small enough to be scored, each query drops nodes by its own k-th
score.  Nodes are visited best bound first.  Single points are scored exactly, in
integers.

A query first searches the cell it lies in itself.  The k-th score found there goes with
it to the other cells: only those whose ball or cone may still beat it are asked at all,
and their tasks start from it.  A cell with many rows is dealt over several tasks by
hash, so one place may hold most rows.

How much falls depends on the data.  Vectors that crowd together are skipped by cells
and nodes; among vectors spread evenly over a high-dimensional sphere every covering
radius is as large as the distances, nothing can be skipped by any such bound, and the
work is that of a full comparison in blocks.  ``scored`` names a column that tells how
many rows were scored for the query, pivots not counted.

Defined cases: vectors null, or that hold a null or non-finite component, take no
part; a query is compared with vectors of its own length and never with rows of
its own id; fewer candidates than k give them all; ties go to the smaller id, an
unknown (null) id being the largest; repeated rows of data are candidates each,
repeated queries count once; an empty table gives an empty one.  Scores are compared
as exact integers of any size; ``score`` is null where it doesn't fit 64 bits, and
``score_text`` always has its digits.  Other columns of the table, whatever their names,
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import hash_bound, materialise

#: Points of a leaf, queries that go down together (each by its own bounds), ratio of scales, share of the norms that rounding may take.
LEAF, TOGETHER, BASE, SLACK = 48, 512, 1.5, 1e-7
#: Rows that a tree is built over, cells of the matrix of one task, pivots a table has at most, rows a pivot stands for.
TREE_ROWS, GROUP_CELLS, QUERY_CELLS, PIVOTS, PIVOT_ROWS = 4096, 1 << 22, 1 << 20, 256, 2048
_NO_ID = int(np.iinfo(np.int64).max)
#: The score of nothing, where scores fit 64 bits and where they may not.
_NONE, _LESS = -_NO_ID, -(1 << 2400)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _angles(dots: np.ndarray, norms) -> np.ndarray:
    """Angles of inner products, given the products of the norms; a zero vector has the angle 0 to all."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.arccos(np.clip(np.nan_to_num(dots / norms, nan=1.0, posinf=1.0, neginf=1.0), -1.0, 1.0))


def bounds(dots, q_norm, far, q_radius, c_norm, radius, angle, q_angle, most):
    """The lesser of the ball's and the cone's bound on inner products of a group of queries and a node.

    ``dots`` are those of the centres, ``far`` the angles between them; ``q_norm`` is
    the greatest norm of the group and ``most`` that of the node.
    """
    ball = dots + q_radius * c_norm + (q_norm + 0.0) * radius
    left = np.maximum(0.0, far - angle - q_angle - SLACK)
    cone = np.where(left < np.pi / 2, q_norm * most * np.cos(left), 0.0)
    return np.minimum(ball, cone) + SLACK * (q_norm * most + 1.0)


class CoverTree:
    """Nodes in arrays: centre row, radius, angle, greatest norm, children and points of their own."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, base: float = BASE):
        self.x = x.astype(np.float64)
        self.norm = _norms(self.x)
        self.centre, self.radius, self.angle, self.most, self.children, self.points = [], [], [], [], [], []
        if len(x):
            far = _norms(self.x - self.x[0])
            todo = [(self.node(0, far, np.arange(len(x))), far)]
            while todo:
                self._split(*todo.pop(), todo, leaf, base)

    def node(self, centre: int, distances: np.ndarray, points: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(distances.max()) if len(points) > 1 else 0.0)
        dots = self.x[points] @ self.x[centre]
        self.angle.append(float(_angles(dots, self.norm[points] * self.norm[centre]).max()) if self.norm[centre] else np.pi)
        self.most.append(float(self.norm[points].max()))
        self.children.append(None)
        self.points.append(points)
        return len(self.centre) - 1

    def _split(self, node: int, far: np.ndarray, todo: list, leaf: int, base: float) -> None:
        """Give ``node`` a net of children one scale down, each with the points nearest in turn."""
        points = self.points[node]
        if len(points) <= leaf or self.radius[node] == 0:
            return
        scale, kids, lone = self.radius[node] / base, [], []
        centre = self.centre[node]
        while len(points):
            near = far <= scale
            mine, at = points[near], far[near]
            if len(mine) > 1:
                kids.append((centre, at, mine))
            else:
                lone.append(centre)
            points = points[~near]
            if len(points):
                centre = int(points[0])
                far = np.sqrt(np.maximum(self.norm[points] ** 2 - 2 * (self.x[points] @ self.x[centre]) + self.norm[centre] ** 2, 0))
                far[0] = 0
        self.children[node] = [self.node(c, at, mine) for c, at, mine in kids]
        # Points that cover nothing but themselves stay here and are scored together.
        self.points[node] = np.array(lone, dtype=np.int64)
        todo += [(child, at) for child, (_, at, _) in zip(self.children[node], kids, strict=True)]

    def below(self, node: int) -> np.ndarray:
        if self.children[node] is None:
            return self.points[node]
        return np.concatenate([self.points[node], *(self.below(c) for c in self.children[node])])


class Best:
    """The k best (score, id) of each query so far, what a row must reach to matter, and how many rows were scored."""

    def __init__(self, n: int, k: int, kind, floor: np.ndarray | None = None):
        self.score = np.full((n, k), _NONE if kind is np.int64 else _LESS, dtype=kind)
        self.id = np.full((n, k), _NO_ID, dtype=np.int64)
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.scored = np.zeros(n, dtype=np.int64)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        kth = self.score[rows, -1]
        known = kth.astype(np.float64) if kth.dtype != object else np.array([float(max(x, -(1 << 1000))) for x in kth])
        return np.maximum(np.where(kth == (_NONE if kth.dtype != object else _LESS), -np.inf, known), self.floor[rows])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[rows], scores], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        k = self.score.shape[1]
        if s.dtype != object and s.shape[1] > 4 * k:  # everything from the k-th score up, ties too
            worst = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            width = int((s >= worst[:, None]).sum(axis=1).max())
            pick = np.argpartition(s, s.shape[1] - width, axis=1)[:, -width:]
            s, i = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
        order = np.argsort(i, axis=1, kind="stable")
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _whole(rows: list) -> np.ndarray:
    """Vectors of whole numbers as exact integers: 64-bit ones where they and all products fit, else Python's."""
    x = np.asarray(rows, dtype=np.float64)
    if x.size and np.abs(x).max() >= 1 << 31:
        return np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)
    return x.astype(np.int64)


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, tree_rows: int = TREE_ROWS, leaf: int = LEAF, floor: np.ndarray | None = None) -> Best:
    """The k best data rows of every query that reach its ``floor``, by trees of ``tree_rows`` rows."""
    most = max((int(np.abs(a).max()) if a.size else 0) for a in (queries, data))
    top = most * most * max(1, queries.shape[1])
    kind = np.int64 if top < 1 << 62 else object
    if kind is np.int64:
        queries, data = queries.astype(np.int64), data.astype(np.int64)
    best = Best(len(queries), k, kind, floor)
    qx = queries.astype(np.float64) if top < 1 << 53 else queries.astype(kind)
    tree, together = CoverTree(queries, max(leaf, min(TOGETHER, tree_rows))), max(leaf, min(TOGETHER, tree_rows))
    for at in range(0, len(data), tree_rows) if len(queries) else ():
        rows = data[at : at + tree_rows]
        _Visit(tree, qx, query_ids, CoverTree(rows, leaf), rows.astype(qx.dtype), ids[at : at + tree_rows], best, kind, together).run()
    return best


class _Visit:
    """Pairs of a query node and data nodes, from the roots down."""

    def __init__(self, qt: CoverTree, qx, query_ids, dt: CoverTree, dx, ids, best: Best, kind, leaf: int):
        self.qt, self.qx, self.query_ids, self.dt, self.dx, self.ids, self.best, self.kind, self.leaf = qt, qx, query_ids, dt, dx, ids, best, kind, leaf
        self.centre, self.radius, self.angle, self.most = (np.array(a) for a in (dt.centre, dt.radius, dt.angle, dt.most))

    def score(self, rows: np.ndarray, points: np.ndarray) -> None:
        for at in range(0, len(points), 2048):
            some = points[at : at + 2048]
            got = self.qx[rows] @ self.dx[some].T
            got = got.astype(np.int64) if self.kind is np.int64 else got
            own = self.query_ids[rows][:, None] == self.ids[some][None, :]
            if own.any():
                got = got.copy()
                got[own] = _NONE if self.kind is np.int64 else _LESS
            self.best.scored[rows] += len(some)
            self.best.add(rows, got, np.where(own, _NO_ID, np.broadcast_to(self.ids[some], got.shape)))

    def bound(self, centre: int, radius: float, angle: float, most: float, nodes: np.ndarray) -> np.ndarray:
        """Bounds between one query node and data nodes."""
        f, qt, dt = self.centre[nodes], self.qt, self.dt
        dots = dt.x[f] @ qt.x[centre]
        far = _angles(dots, dt.norm[f] * qt.norm[centre])
        return bounds(dots, most, far, radius, dt.norm[f], self.radius[nodes], np.where(dt.norm[f] > 0, self.angle[nodes], np.pi), angle if qt.norm[centre] else np.pi, self.most[nodes])

    def run(self) -> None:
        todo, qt, dt = [(0, np.array([0]))], self.qt, self.dt
        while todo:
            q, nodes = todo.pop()
            rows = qt.below(q)
            while len(nodes):
                got = self.bound(qt.centre[q], qt.radius[q], qt.angle[q], qt.most[q], nodes)
                order = np.argsort(-got, kind="stable")
                nodes = nodes[order][got[order] >= self.best.worst(rows).min()]
                if not len(nodes) or len(rows) <= self.leaf:
                    break
                if qt.children[q] is not None and len(nodes) > 1:
                    break
                self.open(rows, nodes)
                nodes = np.array([x for n in nodes for x in dt.children[n] or ()], dtype=np.int64)
            if not len(nodes):
                continue
            if len(rows) <= self.leaf:
                self.each(rows, nodes)
                continue
            todo += [(x, nodes) for x in qt.children[q]]
            if len(lone := qt.points[q]):
                for at in range(0, len(lone), self.leaf):
                    some = lone[at : at + self.leaf]
                    todo.append((qt.node(int(some[0]), _norms(qt.x[some] - qt.x[some[0]]), some), nodes))

    def open(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        """Score what stands alone in the nodes for all rows of a query node that can't be split."""
        if own := [dt_points for n in nodes if len(dt_points := self.dt.points[n])]:
            self.score(rows, np.concatenate(own))

    def each(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        """A few queries, each with its own bounds, down the nodes, best first."""
        qt, dt = self.qt, self.dt
        q, norm = qt.x[rows], qt.norm[rows][:, None]
        while len(nodes):
            f = self.centre[nodes]
            dots = q @ dt.x[f].T
            far = _angles(dots, norm * dt.norm[f])
            got = bounds(dots, norm, far, 0.0, dt.norm[f], self.radius[nodes], np.where(dt.norm[f] > 0, self.angle[nodes], np.pi), np.where(norm > 0, 0.0, np.pi), self.most[nodes])
            follow, together = [], []
            wanted = got >= self.best.worst(rows)[:, None]
            for j in np.argsort(-got.max(axis=0), kind="stable"):
                n = int(nodes[j])
                asks = wanted[:, j]
                if not asks.any():
                    continue
                if len(dt.points[n]):
                    if asks.all() and len(dt.points[n]) < 256:
                        together.append(dt.points[n])  # small ones of all rows meet in one product
                        if sum(map(len, together)) >= 512:
                            self.score(rows, np.concatenate(together))
                            together = []
                            wanted &= got >= self.best.worst(rows)[:, None]
                    else:
                        self.score(rows[asks], dt.points[n])
                        wanted &= got >= self.best.worst(rows)[:, None]
                follow += dt.children[n] or ()
            if together:
                self.score(rows, np.concatenate(together))
            nodes = np.array(follow, dtype=np.int64)


def usable(vector: str) -> Column:
    """The vector has components and all are finite numbers."""
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))


def _matrix(table: pa.Table | pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _nearest(pivots: np.ndarray, norms: np.ndarray):
    """Cell, distance, angle and norm of rows (v, ...) of one length."""

    def of(x: np.ndarray):
        own = _norms(x)
        cell, angle = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for at in range(0, len(x), 4096):
            far = _angles(x[at : at + 4096] @ pivots.T, own[at : at + 4096, None] * norms)
            cell[at : at + 4096] = far.argmin(axis=1)
            angle[at : at + 4096] = far.min(axis=1)
        return cell, _norms(x - pivots[cell]), angle, own

    return of


def _placed(rows: DataFrame, pivots: dict) -> DataFrame:
    """``rows`` with the cell of each vector, its distance and angle from the pivot and its norm."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        finders = {d: _nearest(p, _norms(p)) for d, p in shared.value.items()}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                x = _matrix(some) if d else np.zeros((some.num_rows, 0))
                cell, far, angle, norm = finders[int(d)](x)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(angle), pa.array(norm)], names=[*some.schema.names, "cell", "far", "angle", "norm"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, asks boolean, dim int, same long, cell int, far double, angle double, norm double")


def _pivots(rows: DataFrame, counts: dict, most: int, per: int) -> dict:
    """At most ``most`` different vectors of each length, those with the smallest hashes."""
    out: dict[int, list] = {}
    for dim, n in counts.items():
        wanted = max(1, min(most, n // per))
        share, here = min(1.0, 8 * wanted / n), rows.filter(F.col("dim") == dim)
        while True:
            few = here.filter(F.col("same") <= hash_bound(share)) if share < 1 else here
            got = few.select("same", "v").groupBy("same").agg(F.min("v").alias("v")).orderBy("same").limit(wanted).collect()
            if share >= 1 or len(got) >= wanted:
                break
            share = min(1.0, share * 64)
        out[dim] = np.array([r["v"] for r in got], dtype=np.float64).reshape(len(got), -1)
    return out


def _asked(cells: dict, pivots: dict, schema: str):
    """Arrow function: each query once for every task of the other cells that may hold a row that reaches its floor."""

    def run(batches):
        for batch in batches:
            dims, at, to, part = np.asarray(batch.column("dim")), [], [], []
            for d in np.unique(dims):
                here = np.flatnonzero(dims == d)
                some = batch.take(pa.array(here))
                x, (number, radius, angle, norm, parts) = _matrix(some) if d else np.zeros((len(here), 0)), cells[int(d)]
                p = pivots[int(d)][number]
                own, c_norm = _norms(x)[:, None], _norms(p)
                dots = x @ p.T
                got = bounds(dots, own, _angles(dots, own * c_norm), 0.0, c_norm, radius, np.where(c_norm > 0, angle, np.pi), np.where(own > 0, 0.0, np.pi), norm)
                floor = np.asarray(some.column("floor").fill_null(-np.inf), dtype=np.float64)
                wanted = (got >= floor[:, None]) & (number[None, :] != np.asarray(some.column("cell"))[:, None])
                q, c = np.nonzero(wanted)
                times = parts[c]
                at.append(np.repeat(here[q], times))
                to.append(np.repeat(number[c], times))
                part.append(np.concatenate([np.arange(n) for n in times]) if len(times) else np.zeros(0, dtype=np.int64))
            if at and len(rows := np.concatenate(at)):
                cell, salt = np.concatenate(to).astype(np.int32), np.concatenate(part).astype(np.int32)
                for s in range(0, len(rows), 4096):
                    some = batch.take(pa.array(rows[s : s + 4096]))
                    columns = {n: some.column(n) for n in ("vec_id", "v", "dim", "same", "floor")} | {"cell": pa.array(cell[s : s + 4096]), "part": pa.array(salt[s : s + 4096])}
                    yield pa.RecordBatch.from_arrays([columns[n] for n in schema], names=list(schema))

    return run


def top_k(df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "vector", k: int = 5, tree_rows: int = TREE_ROWS, pivots: int = PIVOTS, pivot_rows: int = PIVOT_ROWS, scored: str | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``, ``score_text`` of each query's k best rows.

    ``vector`` is an array of whole numbers (as integers or doubles).  ``scored`` names a
    further column: how many rows were scored for the query.
    """
    spark = df.sparkSession
    found = F.col(vector).cast("array<double>")
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), found.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.select("*", F.size("v").alias("dim"), F.xxhash64("v").alias("same"))
    count = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    kind = "query_id long, rank int, vec_id long, score long, score_text string" + (f", {scored} long" if scored else "")
    if not count:
        return spark.createDataFrame([], kind)
    nets = _pivots(rows, count, pivots, pivot_rows)
    placed = materialise(_placed(rows, nets))
    # One row a cell: what covers it, and over how many tasks its rows are dealt.
    cells: dict = {}
    stats = placed.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.max("angle").alias("angle"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect()
    for d in count:
        mine = sorted((r for r in stats if r["dim"] == d), key=lambda r: r["cell"])
        per = max(tree_rows, GROUP_CELLS // max(d, 1))
        cells[d] = (np.array([r["cell"] for r in mine]), np.array([r["far"] for r in mine]), np.array([r["angle"] for r in mine]), np.array([r["norm"] for r in mine]), np.array([-(-r["n"] // per) for r in mine]))
    parts = spark.createDataFrame([(int(d), int(c), int(n)) for d, (number, _, _, _, deal) in cells.items() for c, n in zip(number, deal, strict=True)], "dim int, cell int, parts int")
    data = placed.join(F.broadcast(parts), ["dim", "cell"]).select(*(F.col(c).alias(f"row_{c}") for c in ("vec_id", "v", "dim", "cell")), F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int").alias("row_part"))
    asks = placed.filter("asks").select("vec_id", "v", "dim", "same", "cell").distinct()
    home = asks.join(F.broadcast(parts), ["dim", "cell"]).select("vec_id", "v", "dim", "same", F.lit(None).cast("double").alias("floor"), "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = materialise(_met(home, data, k, tree_rows))
    # The k-th score at home goes with a query to every other cell that may beat it.
    order = Window.partitionBy("query_id", "same").orderBy(F.desc("reach"))
    floor = near.filter("vec_id is not null").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == k).select(F.col("query_id").alias("floor_id"), F.col("same").alias("floor_same"), F.col("reach").alias("floor"))
    armed = asks.join(floor, asks["vec_id"].eqNullSafe(F.col("floor_id")) & (asks["same"] == F.col("floor_same")), "left").select("vec_id", "v", "dim", "same", "floor", "cell")
    names = ("vec_id", "v", "dim", "same", "floor", "cell", "part")
    abroad = armed.mapInArrow(_asked(cells, nets, names), "vec_id long, v array<double>, dim int, same long, floor double, cell int, part int")
    far = _met(abroad, data, k, tree_rows)
    every = near.unionByName(materialise(far)) if scored else near.unionByName(far)
    # Exact order: by the number of digits behind the sign where scores don't fit 64 bits.
    order = Window.partitionBy("query_id", "same").orderBy(F.desc("size_key"), F.desc("sort_text"), "vec_id")
    best = every.filter("vec_id is not null").withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    out = best.select(F.when(F.col("query_id") != _NO_ID, F.col("query_id")).alias("query_id"), "same", "rank", F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), F.col("score_text").try_cast("long").alias("score"), "score_text")
    if not scored:
        return out.drop("same")
    sums = every.groupBy(F.when(F.col("query_id") != _NO_ID, F.col("query_id")).alias("q"), F.col("same").alias("s")).agg(F.sum("scored").alias(scored))
    return out.join(sums, out["query_id"].eqNullSafe(F.col("q")) & (out["same"] == F.col("s"))).drop("q", "s", "same")


def _keys(scores) -> tuple[list, list, list, list]:
    """For sorting as text: a signed size, digits (complemented below zero), the number and its nearest double."""
    texts = [str(int(x)) for x in scores]
    size = [len(t) if t[0] != "-" else -len(t) for t in texts]
    flip = str.maketrans("0123456789", "9876543210")
    return size, [t if t[0] != "-" else t[1:].translate(flip) for t in texts], texts, [float(int(x)) if abs(int(x)) < 1 << 1000 else (np.inf if x > 0 else -np.inf) for x in scores]


_FOUND = "query_id long, same long, vec_id long, size_key int, sort_text string, score_text string, reach double, scored long"


def _met(queries: DataFrame, data: DataFrame, k: int, tree_rows: int) -> DataFrame:
    """Queries and rows of the same part of a cell: the best rows of each query, and a row that tells how many were scored."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict = {n.split()[0]: [] for n in _FOUND.split(", ")}
        number = lambda column: column.combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        if asked.num_rows and held.num_rows:
            held = held.sort_by("row_vec_id")
            qid, same, width = number(asked.column("vec_id")), asked.column("same").to_numpy(), asked.column("dim")[0].as_py()
            q, d = (_whole(_matrix(t, c)) if width else np.zeros((t.num_rows, 0), dtype=np.int64) for t, c in ((asked, "v"), (held, "row_v")))
            if q.dtype != d.dtype:
                q, d = q.astype(object), d.astype(object)
            floor = asked.column("floor").combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
            per = max(1024, QUERY_CELLS // max(width, 1))
            for a in range(0, len(q), per):
                best = search(qid[a : a + per], q[a : a + per], number(held.column("row_vec_id")), d, k, tree_rows, floor=floor[a : a + per])
                hit = best.score != (_NONE if best.score.dtype != object else _LESS)
                at, _ = np.nonzero(hit)
                size, sort, text, reach = _keys(best.score[hit].tolist())
                none = [None] * (n := len(best.scored))
                for name, v in zip(out, (qid[a + at], same[a + at], best.id[hit], size, sort, text, reach, [0] * len(at)), strict=True):
                    out[name] += list(v)
                for name, v in zip(out, (qid[a : a + per], same[a : a + per], none, none, none, none, none, best.scored), strict=True):
                    out[name] += list(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64())
        return pa.table({n: pa.array(v, kind) for (n, v), kind in zip(out.items(), kinds, strict=True)})

    return queries.groupBy("dim", "cell", "part").cogroup(data.groupBy("row_dim", "row_cell", "row_part")).applyInArrow(run, _FOUND)
