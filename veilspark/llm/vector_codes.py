"""Product codes of vectors by the filtering form of Lloyd's algorithm.

Vectors become integers, floor(scale * x), and are cut into consecutive parts. Every partition builds a kd-tree over each part of its vectors, once, with the bounding box, count and sum of every node; the trees are
written to the shared folder. A round hands the codebooks (bounded: parts x entries) to the tasks. Going down a tree, an entry is struck out where another is nearer to the whole box; where one is left, the whole
subtree is its own, by the node's cached count and sum. Only counts and sums come back, so a round moves a few thousand numbers a task, whatever the number of vectors. All of it is integer arithmetic, so neither
partitions nor retries change a result; equal distances go to the lower index.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import cut, discard, hot_values, salted_join

#: Vectors in a leaf; components in a chunk that shares one tree a part.
LEAF, CHUNK = 24, 1 << 18


@dataclass
class Tree:
    """order: points by position; nodes: start, stop, left child, right child (0: a leaf), with low, high and sums by node."""

    order: np.ndarray
    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Tree:
        order, nodes, at = np.arange(len(points), dtype=np.int32), [[0, len(points), 0, 0]], 0
        low, high, sums = [], [], []
        while at < len(nodes):
            a, b = nodes[at][:2]
            own = points[order[a:b]]
            low.append(own.min(0))
            high.append(own.max(0))
            sums.append(own.sum(0, dtype=np.int64))
            wide = high[-1] - low[-1]
            axis = int(wide.argmax()) if len(wide) else 0
            if b - a > LEAF and len(wide) and wide[axis] > 0:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
                nodes[at][2:] = len(nodes), len(nodes) + 1
                nodes += [[a, a + mid, 0, 0], [a + mid, b, 0, 0]]
            at += 1
        return cls(order, np.array(nodes, np.int32), np.array(low), np.array(high), np.array(sums))

    def filtered(self, points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest entry of each point, count of each entry, sums of each entry)."""
        own, norm = points[self.order], (centres * centres).sum(1)
        # Products of floats are exact where every sum stays below 2 ** 52.
        reach = max(int(abs(centres).max(initial=0)), int(abs(own).max(initial=0)))
        exact = np.float64 if 4 * max(points.shape[1], 1) * reach * reach < 1 << 52 else np.int64
        left, right = own.astype(exact), centres.astype(exact)
        entry, count, sums = np.zeros(len(own), np.int32), np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        stack = [(0, np.arange(len(centres)))]
        while stack:
            node, open_ = stack.pop()
            a, b, l, r = self.nodes[node].tolist()
            if len(open_) > 1:
                low, high, c = self.low[node], self.high[node], centres[open_]
                best = int((4 * norm[open_] - 4 * (c @ (low + high))).argmin())
                towards = c - c[best]
                # How much nearer than the best entry another comes at its own corner of the box.
                gain = 2 * (np.where(towards > 0, high, low) * towards).sum(1) - (norm[open_] - norm[open_[best]])
                open_ = open_[(gain > 0) | ((gain == 0) & (open_ <= open_[best]))]
            if len(open_) == 1:
                entry[a:b] = open_[0]
                count[open_[0]] += b - a
                sums[open_[0]] += self.sums[node]
            elif l:
                stack += [(l, open_), (r, open_)]
            else:
                near = open_[(norm[open_] - 2 * (left[a:b] @ right[open_].T)).argmin(1)]
                entry[a:b] = near
                np.add.at(count, near, 1)
                np.add.at(sums, near, own[a:b])
        out = np.empty_like(entry)
        out[self.order] = entry
        return out, count, sums


@dataclass
class Codebooks:
    """entries: for each part an array (entries, width) of integers; trees: the table that rows are still read from, if there is one."""

    entries: list[np.ndarray]
    scale: int
    trees: DataFrame | None = None

    def sha256(self) -> str:
        """Of all decimal integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def _bounds(width: int, parts: int) -> list[tuple[int, int]]:
    return [(width * j // parts, width * (j + 1) // parts) for j in range(parts)]


def _reach(width: int) -> int:
    """Integers beyond this would bring the error of a vector over 63 bits."""
    return 1 << ((61 - math.ceil(math.log2(max(width, 1)))) // 2 - 1)


def _chunks(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    most = min(4096, max(64, CHUNK // max(width, 1)))
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for at in range(0, batch.num_rows, most):
            piece, fit = batch.slice(at, most), sizes[at : at + most] == width
            good, odd = piece.filter(pa.array(fit)), piece.filter(pa.array(~fit))
            n = good.num_rows
            reach = _reach(width)
            points = np.clip(good.column("v").flatten().to_numpy(zero_copy_only=False), -reach, reach).reshape(n, width)
            kind = np.int16 if abs(points).max(initial=0) < 1 << 15 else np.int32
            trees = [vars(Tree.of(points[:, a:b])) for a, b in _bounds(width, parts)] if n else []
            rows = [pa.ListArray.from_arrays(pa.array([0, x.num_rows], pa.int32()), x.column("row")) for x in (good, odd)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([pickle.dumps((points.astype(kind), trees), 5)], pa.binary())], ["rows", "odd", "trees"])


def _read(value: bytes) -> tuple[np.ndarray, list[Tree]]:
    points, trees = pickle.loads(value)  # noqa: S301 (written by _chunks)
    return points.astype(np.int64), [Tree(**t) for t in trees]


def _sums(trees: DataFrame, books: list[np.ndarray]) -> list:
    """(part, entry, count, sums) over all trees: at most parts x entries rows."""
    bounds, width = _bounds(sum(b.shape[1] for b in books), len(books)), max(b.shape[1] for b in books)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        for batch in batches:
            for value in batch.column("trees"):
                points, found = _read(value.as_py())
                for j, tree in enumerate(found):
                    _, c, s = tree.filtered(points[:, slice(*bounds[j])], books[j])
                    count[j] += c
                    sums[j][:, : s.shape[1]] += s
        for j, c in enumerate(count):
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used), j, np.int64)), pa.array(used), pa.array(c[used]), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[j][used].ravel())),
            ], ["part", "entry", "n", "s"])

    rows = trees.select("trees").mapInArrow(task, "part long, entry long, n long, s array<long>")
    return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s")).collect()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, Codebooks]:
    """(rows with code and error, the codebooks). Rows keep all columns but the vector; columns named code and error are replaced.

    Rows whose vector is null or holds null or non-finite components are dropped. A codebook starts as that part of the `entries` (256 at most) least ids, ascending, null ids last, equal ids by components; repeated
    rows each count. The width is that of the least id's vector: rows of another width stay, with null code and error. A width that `parts` does not divide gives parts whose widths differ by one. Integers
    saturate where a vector's error would pass 63 bits (beyond 2 ** 26 at width 64). Without any vector there are no rows and the codebooks are empty.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = [c for c in vectors.columns if c not in (vec_col, "code", "error")]
    far = float(1 << 40)
    integers = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-far)), F.lit(far))).cast("long"))
    clean = vectors.where(x.isNotNull() & ~bad).select(F.struct(*kept).alias("row"), F.col(id_col).alias("id"), integers.alias("v"))
    first = lambda df: [r["v"] for r in df.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    start = first(clean)
    row = clean.schema["row"].dataType
    kind = StructType([*[StructField(f.name, f.dataType) for f in row.fields], StructField("code", StringType()), StructField("error", LongType())])
    if not start:
        return vectors.sparkSession.createDataFrame([], kind), Codebooks([], scale)
    width = len(start[0])
    if any(len(v) != width for v in start):
        start = first(clean.where(F.size("v") == width))
    bounds, limit = _bounds(width, parts), _reach(width)
    points = np.clip(np.array(start, np.int64).reshape(len(start), width), -limit, limit)
    books = [points[:, a:b].copy() for a, b in bounds]

    made = StructType([StructField("rows", ArrayType(row)), StructField("odd", ArrayType(row)), StructField("trees", BinaryType())])
    sized = clean.select("row", "v", F.size("v").alias("size"))
    trees = cut(sized.mapInArrow(lambda batches: _chunks(batches, width, parts), made), "trees")
    for _ in range(rounds if width else 0):
        for r in _sums(trees, books):
            book = books[r["part"]]
            book[r["entry"]] = np.array(r["s"][: book.shape[1]], np.int64) // r["n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                points, found = _read(batch.column("trees")[k].as_py())
                codes, error = np.zeros((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
                for j, tree in enumerate(found):
                    own = points[:, slice(*bounds[j])]
                    codes[:, j] = near = tree.filtered(own, books[j])[0]
                    error += ((own - books[j][near]) ** 2).sum(1)
                text, step = codes.tobytes().hex(), 2 * parts
                good, odd = (batch.column(c).slice(k, 1).flatten() for c in ("rows", "odd"))
                yield pa.RecordBatch.from_arrays([*good.flatten(), pa.array([text[i : i + step] for i in range(0, step * len(good), step)], pa.string()), pa.array(error)], kind.names)
                yield pa.RecordBatch.from_arrays([*odd.flatten(), pa.nulls(len(odd), pa.string()), pa.nulls(len(odd), pa.int64())], kind.names)

    return trees.mapInArrow(assign, kind), Codebooks(books, scale, trees)


def codes_with_label_error(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **how) -> DataFrame:
    """id, code, error, label_error (the errors of all rows of a label, null labels together; null where none has an error) and the digest of the codebooks.

    Errors are summed by label before anything is shuffled; the join back is salted for labels that many rows share.
    """
    coded, books = compress(vectors.select(id_col, label_col, vec_col), id_col, vec_col, **how)
    coded = cut(coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit(""))), "codes")
    if books.trees is not None:
        discard(books.trees)
    totals = cut(coded.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labelerrors")
    hot = hot_values(totals, "__label", "n")
    out = salted_join(coded, totals.drop("n"), "__label", hot, F.xxhash64(id_col, "code"))
    return out.select(id_col, "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
