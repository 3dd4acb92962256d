"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2],   score = 1 / (1 + exp(-y))

The pairwise part takes linear time by the identity above. Features of a text: its distinct words by hash with log counts, scaled to unit length; each structure
statistic and the metadata (size) as one active bin. The model is fitted on the driver from the features of at most SAMPLE labelled
rows of each class, those with the least hash of their id; scoring reads every row once and broadcasts a model of fixed size.

Defined results: null and empty texts have the bins of an empty text and no words; rows without a label, or with a null label or id, train nothing;
several labels of one id count as their mean, rounded; if only one class is labelled the score is its label, if none 0.5;
repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from .bpe_replay import give_back

WORDS, BINS, FACTORS = 1 << 15, 24, 6
SAMPLE, EPOCHS, BATCH = 4000, 12, 64
LEAST_STEPS = 1500
#: Byte -> class: 0 other, 1 space, 2 line feed, 3 upper, 4 lower, 5 digit, 6 symbol, 7 stop, 8 call, 9 not ASCII.
KIND = np.zeros(256, np.int64)
KIND[[9, 11, 12, 13, 32]] = 1
KIND[10] = 2
KIND[65:91], KIND[97:123], KIND[48:58] = 3, 4, 5
KIND[[ord(c) for c in "#*$%&|<>@^~_=+\\/{}[]"]] = 6
KIND[[ord(c) for c in ".,;:"]] = 7
KIND[[ord(c) for c in "!?"]] = 8
KIND[128:] = 9
STATS = 14


def statistics(raw: bytes, tokens: list[bytes], counts: Counter) -> list[float]:
    """Each from 0 to 1."""
    n = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=10) if raw else np.zeros(10, np.int64)
    size, solid, words = max(1, len(raw)), max(1, len(raw) - int(n[1]) - int(n[2])), max(1, len(tokens))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(tokens, tokens[1:], strict=False)))
    return [
        min(1.0, math.log1p(len(raw)) / 14), min(1.0, math.log1p(len(tokens)) / 12), min(1.0, math.log1p(len(lines)) / 9), min(1.0, solid / words / 24) if tokens else 0.0,
        n[3] / solid, n[5] / solid, min(1.0, n[6] / words), min(1.0, n[7] / words), min(1.0, n[8] / words), n[9] / size,
        len(counts) / words, max(counts.values(), default=0) / words, 1 - len(set(lines)) / max(1, len(lines)), 1 - pairs / max(1, len(tokens) - 1) if len(tokens) > 1 else 0.0,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values."""
    raw = (text or "").encode("utf-8", "replace")
    tokens = raw.lower().split()
    counts = Counter(tokens)
    stats = statistics(raw, tokens, counts)
    crc = zlib.crc32
    idx = np.fromiter((crc(w) for w in counts), np.int64, len(counts)) & (WORDS - 1)
    val = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    val *= 1 / max(1e-12, math.sqrt(float(val @ val)))
    bins = np.array([WORDS + k * BINS + min(BINS - 1, int(math.sqrt(max(0.0, s)) * BINS)) for k, s in enumerate(stats)])
    return np.r_[bins, idx].astype(np.int32), np.r_[np.full(STATS, 1 / math.sqrt(STATS)), val].astype(np.float32)


def predict(model: tuple, idx: np.ndarray, val: np.ndarray) -> float:
    w0, w, v = model
    xv = v[idx] * val[:, None]
    s = xv.sum(axis=0)
    y = float(w0 + w[idx] @ val + 0.5 * (s @ s - (xv * xv).sum()))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, y))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.15, decay: float = 1e-4) -> tuple:
    """Adagrad on the logistic loss in small batches."""
    rng = np.random.default_rng(seed)
    size = WORDS + STATS * BINS
    w0, w, v = 0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32)
    gw, gv = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32)
    for _ in range(max(epochs, math.ceil(LEAST_STEPS / math.ceil(len(rows) / BATCH)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            idx, val = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            size_of = np.array([len(rows[i][0]) for i in part])
            start, of = np.r_[0, np.cumsum(size_of)[:-1]], np.repeat(np.arange(len(part)), size_of)
            xv = v[idx] * val[:, None]
            s = np.add.reduceat(xv, start)
            y = w0 + np.add.reduceat(w[idx] * val, start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), start))
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]).astype(np.float32)
            w0 -= rate * 0.1 * float(g.mean())
            each = g[of] * val
            used, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, each, len(used)).astype(np.float32) / len(part) + decay * w[used]
            dv_all = each[:, None] * (s[of] - xv)
            dv = np.stack([np.bincount(back, dv_all[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) / len(part) + decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
    return w0, w, v


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE):
    """The model, or a float where one class or none is labelled. learn: a condition on labels' id column."""
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    pick = lambda y: known.where(F.col("y") == y).orderBy(*order).limit(sample)
    chosen = pick(0).union(pick(1))  # 2 * sample rows at most

    kind = StructType([StructField("i", ArrayType(IntegerType())), StructField("x", ArrayType(FloatType()))])

    @pandas_udf(kind)
    def feature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = [features(t) for t in s]
            yield pd.DataFrame({"i": [g[0] for g in got], "x": [g[1] for g in got]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = rows.select("id", "y", feature("text").alias("f")).orderBy(*order, "f.i").limit(2 * sample).select("y", "f.i", "f.x").toArrow()
    y = found.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    xs = [(i, x) for a, b in zip(found.column("i").chunks, found.column("x").chunks, strict=True) for i, x in zip(_rows(a), _rows(b), strict=True)]
    model = fit(xs, y.astype(np.float32))
    del found, xs
    give_back()
    return model


def _rows(lists) -> list[np.ndarray]:
    """The rows of a list array as views of its values: the sample never becomes Python numbers."""
    ends = np.asarray(lists.offsets)
    values = np.asarray(lists.values)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def score(docs: DataFrame, model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    if isinstance(model, float):
        return docs.withColumn(out_col, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(DoubleType())
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([predict(shared.value, *features(t)) for t in s], dtype=float)
            give_back()

    return docs.withColumn(out_col, quality(F.col(text_col)))
