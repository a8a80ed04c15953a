"""Exact top-k by inner product as a Voronoi kNN join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.session import keep

#: Pivots at most, sampled rows and their bytes at most, queries and data rows of one task.
PIVOTS, SAMPLE, SAMPLE_BYTES, QUERIES, SLICE = 2048, 16_384, 64 << 20, 4096, 16_384
#: Comparisons that cost as much as sending a row once more.
SHIP = 1000
#: Numbers held at once while a batch is worked on.
STEP = 4_000_000


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


@dataclass
class _Space:
    """Vectors lifted so that the largest inner product is the least distance: data get a coordinate that brings
    all to one length, queries are scaled to that length, which changes no query's order, and get a zero."""

    dims: int
    dtype: str
    square: float
    #: The sampled rows, lifted, and their ids; pivots are centres of them.
    sample: np.ndarray | None = None
    sample_ids: np.ndarray | None = None
    pivots: np.ndarray | None = None

    @property
    def slack(self) -> float:
        """More than distances lose to rounding."""
        return 1e-6 * (1 + np.sqrt(self.square))

    def vectors(self, raw) -> np.ndarray:
        return np.frombuffer(b"".join(raw), self.dtype).reshape(-1, self.dims)

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        v = v.astype(np.float64)
        square = (v * v).sum(1)
        if query:
            v *= np.sqrt(self.square / np.where(square > 0, square, 1))[:, None]
            last = np.zeros(len(v))
        else:
            last = np.sqrt(np.maximum(self.square - square, 0))
        return np.hstack([v, last[:, None]])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.empty(len(x), np.int64)
        step = max(1, STEP // len(self.pivots))
        for at in range(0, len(x), step):
            cell[at : at + step] = ((self.pivots**2).sum(1) - 2 * x[at : at + step] @ self.pivots.T).argmin(1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))

    def reach(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """For each query a distance within which it has k rows that are not its own: that of the k-th best sampled row."""
        out = np.full(len(q), np.inf)
        step = max(1, STEP // max(1, len(self.sample)))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            score = part @ self.sample.T
            score[ids[at : at + step, None] == self.sample_ids[None]] = -np.inf
            if score.shape[1] >= k:
                least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                some = np.isfinite(least)
                square = (part * part).sum(1) + self.square - 2 * np.where(some, least, 0)
                out[at : at + step] = np.where(some, np.sqrt(np.maximum(square, 0)) + self.slack, np.inf)
        return out


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Centres of the sample after a few rounds of k-means; where they stand affects the cost only."""
    x = np.unique(x, axis=0)
    out = x[np.random.default_rng(3).permutation(len(x))[:n]]
    for _ in range(4):
        at = ((out**2).sum(1) - 2 * x @ out.T).argmin(1)
        order = np.argsort(at, kind="stable")
        own, first, size = np.unique(at[order], return_index=True, return_counts=True)
        out[own] = np.add.reduceat(x[order], first, axis=0) / size[:, None]
    return out


def _packed(space: _Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = b.column(1), b.num_rows
            size = np.diff(flat.offsets.to_numpy()[: n + 1]) if n else np.zeros(0, int)
            values = flat.flatten().to_numpy(zero_copy_only=False)
            v = np.zeros((n, space.dims), space.dtype)
            row = np.repeat(np.arange(n), size)
            v[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["vec_id", "v"])

    return run


def _cells(space: _Space, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = space.nearest(space.lift(space.vectors(b.column(1).to_pylist()), query)) if b.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int64()), pa.array(dist, pa.float64())], names=["vec_id", "v", "cell", "dist"])

    return run


_RING = "cell long, n long, low binary, high binary"


def _rings(space: _Space, k: int):
    """For each cell of queries its number of them and, for each data cell, the least and largest distance from the pivot at
    which a row matters to any: by the triangle inequality a row within a query's reach lies that much nearer to or farther
    from a pivot than the query does, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            ids, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
            step = max(1, STEP // len(space.pivots))
            for at in range(0, b.num_rows, step):
                q = space.lift(space.vectors(b.column(1).slice(at, step).to_pylist()), True)
                far, to = space.reach(ids[at : at + step], q, k)[:, None], _distances(q, space.pivots)
                order = np.argsort(cell[at : at + step], kind="stable")
                own, first, n = np.unique(cell[at : at + step][order], return_index=True, return_counts=True)
                low, high = np.minimum.reduceat((to - far)[order], first, axis=0), np.maximum.reduceat((to + far)[order], first, axis=0)
                for c, m, x, y in zip(own.tolist(), n.tolist(), low, high, strict=True):
                    _widen(held, c, m, x - space.slack, y + space.slack)
        yield from _written(held)

    return run


def _widen(held: dict[int, list], cell: int, n: int, low: np.ndarray, high: np.ndarray) -> None:
    if cell in held:
        old = held[cell]
        held[cell] = [old[0] + n, np.minimum(old[1], low), np.maximum(old[2], high)]
    else:
        held[cell] = [n, low, high]


def _written(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
    for cell, (n, low, high) in held.items():
        columns = [[cell], [n], [low.astype(np.float32).tobytes()], [high.astype(np.float32).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["cell", "n", "low", "high"])


def _joined_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for b in batches:
        for cell, n, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
            _widen(held, cell, n, np.frombuffer(low, np.float32), np.frombuffer(high, np.float32))
    yield from _written(held)


@dataclass
class _Plan:
    """Cells of queries in groups: ``low`` and ``high`` hold the rings of the cells, those of a group together from ``first`` on."""

    cells: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray
    queries: list[int]

    def needed(self, cell: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """(group, row): whether the row lies in the ring of any cell of the group."""
        inside = (self.low[:, cell] <= dist) & (dist <= self.high[:, cell])
        return np.logical_or.reduceat(inside, self.first, axis=0)

    def steps(self, n: int) -> Iterator[slice]:
        step = max(1, STEP // len(self.cells))
        return (slice(at, at + step) for at in range(0, n, step))


def _grouped(space: _Space, sizes: dict[int, int], low: dict[int, np.ndarray], high: dict[int, np.ndarray], rows: int, queries: int) -> _Plan:
    """Cells whose rings hold much the same rows go together, as long as a row sent once less saves more than the added
    comparisons cost. What a group needs is judged by the sampled rows."""
    cells = np.array(sorted(sizes))
    at, dist = space.nearest(space.sample)
    inside = np.stack([(low[c][at] <= dist) & (dist <= high[c][at]) for c in cells.tolist()])
    between = _distances(space.pivots[cells], space.pivots[cells])
    groups: list[tuple[list[int], int, np.ndarray]] = []
    left, now = np.ones(len(cells), bool), 0
    cost = lambda n, held: rows * held.mean() * (SHIP + n)
    for _ in range(len(cells)):
        # along a chain of nearest cells
        left[now] = False
        n = sizes[int(cells[now])]
        if groups:
            own, m, held = groups[-1]
            both = held | inside[now]
            if n + m <= queries and cost(n + m, both) <= cost(m, held) + cost(n, inside[now]):
                groups[-1] = ([*own, now], n + m, both)
            else:
                groups.append(([now], n, inside[now]))
        else:
            groups.append(([now], n, inside[now]))
        if left.any():
            now = int(np.where(left, between[now], np.inf).argmin())
    order = [i for own, _, _ in groups for i in own]
    first = np.cumsum([0, *(len(own) for own, _, _ in groups)])[:-1]
    stacked = [np.stack([x[int(cells[i])] for i in order]) for x in (low, high)]
    return _Plan(cells[order], first, *stacked, [n for _, n, _ in groups])


def _counted(plan: _Plan):
    """Rows that each group needs, over a whole partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plan.first), np.int64)
        for b in batches:
            cell, dist = b.column(0).to_numpy(), b.column(1).to_numpy()
            for part in plan.steps(b.num_rows):
                total += plan.needed(cell[part], dist[part]).sum(1)
        grp = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(total[grp])], names=["grp", "n"])

    return run


def _needed(plan: _Plan, slices: np.ndarray):
    """Rows with every group that needs them, in the group's slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in plan.steps(b.num_rows):
                rows = b.slice(part.start, part.stop - part.start)
                ids = rows.column(0).to_numpy()
                group, row = np.nonzero(plan.needed(rows.column(2).to_numpy(), rows.column(3).to_numpy()))
                mixed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
                # repeated ids share a slice, equal rows of one id may be many: the row's place parts them
                slice_ = (mixed[row] + row) % slices[group]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(slice_, pa.int64()), rows.column(0).take(at), rows.column(1).take(at)], names=["grp", "slice", "vec_id", "v"])

    return run


def _solved(space: _Space, k: int, kind: str):
    def run(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            data = data.sort_values("vec_id", kind="stable")
            ids = data["vec_id"].to_numpy()
            x, q = space.vectors(data["v"]).astype(kind), space.vectors(asked["v"]).astype(kind)
            step = max(1, STEP // len(x))
            for at in range(0, len(q), step):
                scores = q[at : at + step] @ x.T
                for own, s in zip(asked["vec_id"].to_numpy()[at : at + step], scores, strict=True):
                    lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
                    s = np.concatenate([s[:lo], s[hi:]])
                    if not len(s):
                        continue
                    best = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    best = best[np.argsort(-s[best], kind="stable")][:k]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[np.where(best < lo, best, best + hi - lo)], "score": s[best].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def quantised(col: str | Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds null or non-finite components."""
    col = F.col(col) if isinstance(col, str) else col
    value = F.transform(col, lambda x: x.cast("double"))
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(col.isNotNull() & fine, F.transform(value, lambda x: F.floor(x * scale).cast("long")))


def knn_join(data: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, queries: int = QUERIES, slice_rows: int = SLICE, report: dict | None = None) -> DataFrame:
    """``(query_id, rank int, vec_id, score)``: the k rows of largest inner product for each query row, exactly.

    ``data`` has ``vec_id long`` and ``vec array<long>``; queries are its rows where ``is_query`` holds, and rows
    of the query's own id are no candidates. Queries and data are assigned to the nearest of a number of pivots that grows
    with the root of the rows, up to ``pivots``. The k-th best of a bounded sample bounds how far each query must look, and
    that gives each cell of queries a ring around every pivot, outside which no row can matter. A row goes only to the groups
    of cells with a ring that holds it. Groups are cut into chunks of queries and hashed slices of the rows that they
    need, so a cell of a third of all rows is many small tasks, and each gives k rows a query to the last ranking.
    ``report`` takes the numbers of ``rows``, ``queries``, ``groups``, rows ``sent`` and ``compared`` pairs.
    Cases: rows with null id or vector take no part; of equal scores the smaller vec_id is first;
    shorter vectors count as filled up with zeros; a query of zeros ranks all rows equal; repeated candidate rows are each
    ranked; a repeated query id asks once, with its largest vector; fewer than k candidates are all returned; no rows give
    none; further columns of ``data`` are ignored. Inner products must fit a long.
    """
    spark, schema = data.sparkSession, "query_id long, rank int, vec_id long, score long"
    rows = keep(data.where("vec_id is not null and vec is not null").select("vec_id", "vec", F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    s = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))), F.max(square)).first()
    n, asked, dims, largest, top = s[0], s[1], max(1, s[2] or 0), s[3] or 0, s[4] or 0.0
    if not asked:
        return spark.createDataFrame([], schema)
    dtype = next(t for t in ("<i1", "<i2", "<i4", "<i8") if largest <= np.iinfo(t).max)
    # the narrowest type in which every sum is exact
    exact = "float32" if top < 2**24 else "float64" if top < 2**53 else "int64"
    space = _Space(dims, dtype, top)
    packed = lambda df: df.select("vec_id", "vec").mapInArrow(_packed(space), "vec_id long, v binary")
    sample = packed(rows.orderBy(F.xxhash64("vec_id"), "vec").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (dims + 1)))))).collect()
    space.sample, space.sample_ids = space.lift(space.vectors([bytes(r.v) for r in sample]), False), np.array([r.vec_id for r in sample])
    space.pivots = _pivots(space.sample, max(1, min(pivots, int(n**0.5))))
    celled = "vec_id long, v binary, cell long, dist double"
    points = keep(packed(rows).mapInArrow(_cells(space, False), celled), "cells")
    ask = rows.where("asks").groupBy("vec_id").agg(F.max("vec").alias("vec"))
    ask = keep(packed(ask).mapInArrow(_cells(space, True), celled), "query-cells")
    rings = ask.mapInArrow(_rings(space, k), _RING).repartition("cell").mapInArrow(_joined_rings, _RING).collect()
    sizes = {r.cell: r.n for r in rings}
    low, high = ({r.cell: np.frombuffer(bytes(r[name]), np.float32) for r in rings} for name in ("low", "high"))
    plan = _grouped(space, sizes, low, high, n, queries)
    needs = np.zeros(len(plan.first), np.int64)
    for r in points.select("cell", "dist").mapInArrow(_counted(plan), "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect():
        needs[r.grp] = r.n
    slices, chunks = np.maximum(1, -(-needs // slice_rows)), np.array([-(-m // queries) for m in plan.queries])
    if report is not None:
        report |= {"rows": n, "queries": sum(sizes.values()), "groups": len(needs), "sent": int((needs * chunks).sum()), "compared": int((needs * np.array(plan.queries)).sum())}
    group = np.searchsorted(plan.first, np.arange(len(plan.cells)), "right") - 1
    of_cell = [(int(c), int(g), int(chunks[g]), int(slices[g])) for c, g in zip(plan.cells, group, strict=True)]
    of_cell = spark.createDataFrame(of_cell, "cell long, grp long, chunks int, slices long")
    chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
    each = F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)
    ask = ask.join(F.broadcast(of_cell), "cell").select("grp", chunk.alias("chunk"), "vec_id", "v", F.explode(each).alias("slice"))
    near = points.mapInArrow(_needed(plan, slices), "grp long, slice long, vec_id long, v binary")
    if chunks.max() > 1:
        many = of_cell.select("grp", "chunks").distinct()
        near = near.join(F.broadcast(many), "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    else:
        near = near.withColumn("chunk", F.lit(0))
    keys = ["grp", "chunk", "slice"]
    part = near.groupBy(keys).cogroup(ask.groupBy(keys)).applyInPandas(_solved(space, k, exact), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
