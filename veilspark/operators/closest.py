"""Exact nearest rows of one table in another, by a metric index: pivots, cells and rings, cut by the triangle inequality.

1. At most PIVOTS rows, those of the least hashes, are pivots. Every distinct row of the searched table goes to its nearest pivot's cell, and within it to a ring of like distances to the pivot; rings are cut at
   mergeable quantiles. A ring's least and greatest distance, and its rows, are counted by aggregation: at most PIVOTS x RINGS short rows, whatever the tables hold.
2. A query first meets one ring, that of its nearest pivot whose distances are most like its own. The closest row there bounds its answer.
3. By that bound it goes to those rings alone that can hold a closer row: with d its distance to a ring's pivot, all rows of the ring are at least d - greatest and least - d away, and by the bisecting plane of two
   pivots at least (d^2 - d0^2) / 2 |p p0|.

Both tables stay on the executors. Queries and rows meet by (ring, share of the rows, share of the queries), shares of at most GROUP rows, so that a ring into which a third of all rows falls is no larger group than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import settle

PIVOTS, RINGS, RING_ROWS, GROUP = 1000, 32, 1000, 10_000
_SLACK = 1e-9


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.nan_to_num(np.asarray(column.flatten(), dtype=float).reshape(rows, -1) if rows else np.empty((0, 1)))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y, for bounds: off by rounding, at most some 1e-8 of the rows' length."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)), pa.array(x.ravel()))


@dataclass
class _Index:
    """pivots; for each ring, by cell and distance, its cell, least and greatest distance and rows."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def __post_init__(self) -> None:
        length = float(np.sqrt((self.pivots * self.pivots).sum(1)).max(initial=1.0))
        self.between = _apart(self.pivots, self.pivots)
        self.between[self.between < 1e-4 * length] = np.inf  # too near for their plane to tell anything
        self.length = length

    def slack(self, far: np.ndarray | float) -> np.ndarray | float:
        """What rounding may take from a bound of a row that is `far` from a pivot."""
        return _SLACK + 1e-7 * (self.length + far)

    def home(self, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of distances to the pivots the ring of the nearest pivot whose distances are most like, and the distance to that pivot."""
        near = far.argmin(1)
        d = far[np.arange(len(far)), near]
        scale = 2 * float(max(self.high.max(), d.max(initial=0))) + 1
        at = np.searchsorted(self.cell * scale + self.high, near * scale + d)
        return np.clip(at, np.searchsorted(self.cell, near, "left"), np.searchsorted(self.cell, near, "right") - 1), d

    def reach(self, far: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, ring) of all rings that can hold a row closer than best."""
        near = far.argmin(1)
        own = far[np.arange(len(far)), near][:, None]
        plane = (far * far - own * own) / (2 * self.between[near])
        d, limit = far[:, self.cell], (best + self.slack(far.max(1)))[:, None]
        return np.nonzero((d - self.high < limit) & (self.low - d < limit) & (plane[:, self.cell] < limit))


def _assigned(real: DataFrame, pivots: np.ndarray) -> DataFrame:
    """v with p, its nearest pivot, and d, the distance to it."""
    shared = real.sparkSession.sparkContext.broadcast(pivots)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                x = _matrix(b.column("v").slice(at, 2000), min(2000, b.num_rows - at))
                far = _apart(x, shared.value)
                p = far.argmin(1)
                yield pa.RecordBatch.from_arrays([_vectors(x), pa.array(p), pa.array(far[np.arange(len(x)), p])], ["v", "p", "d"])

    return real.mapInArrow(task, "v array<double>, p long, d double")


def _index(real: DataFrame) -> tuple[_Index, DataFrame] | None:
    """The index, and the searched rows with their ring."""
    n = real.count()
    most = min(PIVOTS, max(1, round(n**0.5)))
    pivots = np.nan_to_num(np.array([r["v"] for r in real.orderBy(F.xxhash64("v")).limit(most).collect()], float))
    if not n:
        return None
    placed = settle(_assigned(real, pivots))
    cuts = [(k + 1) / RINGS for k in range(RINGS - 1)]
    found = placed.groupBy("p").agg(F.count("*").alias("n"), F.percentile_approx("d", cuts, 2000).alias("q")).collect()
    bounds = {}
    for r in found:
        rings = min(RINGS, -(-r["n"] // RING_ROWS))
        bounds[r["p"]] = np.unique([r["q"][min(k * RINGS // rings, RINGS - 1) - 1] for k in range(1, rings)])
    shared = real.sparkSession.sparkContext.broadcast(bounds)

    def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, d = b.column("p").to_numpy(), b.column("d").to_numpy()
            ring = np.zeros(len(p), np.int64)
            for cell in np.unique(p).tolist():
                of = p == cell
                ring[of] = np.searchsorted(shared.value[cell], d[of], "left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p * RINGS + ring)], [*b.schema.names, "g"])

    rows = settle(placed.mapInArrow(ringed, "v array<double>, p long, d double, g long"))
    stats = sorted(map(tuple, rows.groupBy("g").agg(F.min("d"), F.max("d"), F.count("*")).collect()))
    g, low, high, size = (np.array(c) for c in zip(*stats, strict=True))
    shared_g = real.sparkSession.sparkContext.broadcast(g)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("d"), pa.array(np.searchsorted(shared_g.value, b.column("g").to_numpy()))], ["v", "d", "g"])

    return _Index(pivots, g // RINGS, low, high, size), rows.mapInArrow(numbered, "v array<double>, d double, g long")


def _asked(queries: DataFrame, index: _Index) -> DataFrame:
    """i and v with g, the query's home ring, and d, its distance to that ring's pivot."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = _matrix(part.column("v"), part.num_rows)
                g, d = shared.value.home(_apart(x, shared.value.pivots))
                yield pa.RecordBatch.from_arrays([part.column("i"), _vectors(x), pa.array(g), pa.array(d)], ["i", "v", "g", "d"])

    return queries.mapInArrow(task, "i long, v array<double>, g long, d double")


def _spread(queries: DataFrame, index: _Index) -> DataFrame:
    """Queries with a bound, once for each other ring that can hold a closer row."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        step = max(1, min(2000, 4_000_000 // len(ix.cell)))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x, best = _matrix(part.column("v"), part.num_rows), part.column("best").to_numpy()
                far = _apart(x, ix.pivots)
                k, g = ix.reach(far, best)
                other = g != part.column("g").to_numpy()[k]
                k, g = k[other], g[other]
                for s in range(0, len(k), 20_000):
                    kk, gg = k[s : s + 20_000], g[s : s + 20_000]
                    yield pa.RecordBatch.from_arrays([part.column("i").take(pa.array(kk)), _vectors(x[kk]), pa.array(far[kk, ix.cell[gg]]), pa.array(best[kk]), pa.array(gg)], ["i", "v", "d", "best", "g"])

    return queries.mapInArrow(task, "i long, v array<double>, d double, best double, g long")


def _search(rows: pa.Table, queries: pa.Table, slack) -> pa.Table:
    """For each query the least distance to rows whose distance to the pivot lets them be closer than its bound; and how many rows were compared."""
    n, m = rows.num_rows, queries.num_rows
    best, compared = np.full(m, np.inf), np.zeros(m, np.int64)
    if n and m:
        y, dy = _matrix(rows.column("v").combine_chunks(), n), rows.column("d").to_numpy()
        order = dy.argsort(kind="stable")
        y, dy = y[order], dy[order]
        x, dx, bound = _matrix(queries.column("v").combine_chunks(), m), queries.column("d").to_numpy(), queries.column("best").to_numpy()
        turn = dx.argsort(kind="stable")
        for at in range(0, m, 128):
            own = turn[at : at + 128]
            more = bound[own] + slack(dx[own])
            low, high = np.searchsorted(dy, (dx[own] - more).min(), "left"), np.searchsorted(dy, (dx[own] + more).max(), "right")
            for a in range(low, high, 4000):
                z = y[a : min(a + 4000, high)]
                compared[own] += len(z)
                q = x[own]
                norm = (q * q).sum(1)[:, None] + (z * z).sum(1)[None]
                square = norm - 2 * q @ z.T
                # What rounding may have taken for the least is measured again by differences, so that equal rows are 0 apart.
                k, j = np.nonzero(square <= (square + 1e-12 * (1 + norm)).min(1)[:, None] + 1e-12 * (1 + norm))
                np.minimum.at(best, own[k], np.sqrt(((q[k] - z[j]) ** 2).sum(1)))
    return pa.table({"i": queries.column("i"), "best": best, "compared": compared})


def _met(rows: DataFrame, queries: DataFrame, index: _Index, block: int) -> DataFrame:
    """i, best and compared, by ring and shares of bounded size."""
    size = queries.groupBy("g").agg(F.count("*").alias("n")).collect()
    asked = np.zeros(len(index.cell), np.int64)  # rings that no query goes to are not moved
    for r in size:
        asked[r["g"]] = -(-r["n"] // block)
    held = np.maximum(-(-index.rows // block), 1)
    shared = rows.sparkSession.sparkContext.broadcast((held, asked))

    def dealt(of_rows: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, other = shared.value if of_rows else shared.value[::-1]
            for b in batches:
                g, h = b.column("g").to_numpy(), b.column("h").to_numpy()
                take = np.repeat(np.arange(len(g)), other[g])
                nth = np.arange(len(take)) - np.repeat(np.cumsum(other[g]) - other[g], other[g])
                own = (h % mine[g])[take]
                a, c = (own, nth) if of_rows else (nth, own)
                for s in range(0, len(take), 20_000):
                    t = slice(s, s + 20_000)
                    out = b.drop_columns(["h"]).take(pa.array(take[t]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(a[t]), pa.array(c[t])], [*out.schema.names, "a", "c"])

        return task

    share = lambda *by: F.pmod(F.xxhash64(*by), F.lit(1 << 40)).alias("h")
    left = rows.select("v", "d", "g", share("v")).mapInArrow(dealt(True), "v array<double>, d double, g long, a long, c long")
    right = queries.select("i", "v", "d", "best", "g", share("i")).mapInArrow(dealt(False), "i long, v array<double>, d double, best double, g long, a long, c long")
    slack = index.slack
    return left.groupBy("g", "a", "c").cogroup(right.groupBy("g", "a", "c")).applyInArrow(lambda x, y: _search(x, y, slack), "i long, best double, compared long")


def closest(real: DataFrame, queries: DataFrame, block: int = GROUP) -> DataFrame:
    """i (a number of the query's row), dcr (the distance to the closest row of `real`) and compared (rows of `real` that it was measured against). Both tables have an array v of doubles, of one width.

    Missing and non-finite components count as 0. Without a row of `real` there are no distances. Repeated rows of `real` are one; repeated queries are answered each.
    block: the greatest share of a ring's rows, and of its queries, that one group holds.
    """
    numbered = settle(queries.select(F.monotonically_increasing_id().alias("i"), F.col("v").cast("array<double>").alias("v")))
    index = _index(settle(real.select(F.col("v").cast("array<double>").alias("v")).distinct()))
    if index is None:
        return real.sparkSession.createDataFrame([], "i long, dcr double, compared long")
    ix, rows = index
    asked = settle(_asked(numbered, ix))
    once = settle(_met(rows, asked.withColumn("best", F.lit(float("inf"))), ix, block).groupBy("i").agg(F.min("best").alias("best"), F.sum("compared").alias("compared")))
    again = _met(rows, settle(_spread(asked.drop("d").join(once.select("i", "best"), "i"), ix)), ix, block)
    both = once.unionByName(again).groupBy("i").agg(F.min("best").alias("dcr"), F.sum("compared").alias("compared"))
    return both.where(F.col("dcr") < float("inf"))
