"""Synthetic records: fit moments and marginals with one aggregation each, sample on the executors; distances to real records; utility."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import MapType, StringType

from ..errors import ReidentificationRiskError
from ..functions.trees import flatten
from ..schema import RESOURCE_TYPES, records as as_records
from .closest import closest


@pandas_udf(MapType(StringType(), StringType()))
def _flat(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([{k: json.dumps(v) for k, v in flatten(json.loads(x or "{}")).items() if v is not None} for x in s], dtype=object)


def columns_of(records: DataFrame, most: int = 500) -> list[tuple[str, str]]:
    """(key, kind) of the records' flattened data: "number" if all its values are JSON numbers, else "text". More than `most` keys raise."""
    pairs = records.select(F.explode(_flat("data_json")).alias("k", "v"))
    kinds = pairs.groupBy("k").agg(F.min(F.rlike("v", F.lit(r"^-?\d"))).alias("n")).orderBy("k").limit(most + 1).collect()
    if len(kinds) > most:
        raise ValueError(f"more than {most} different keys")
    return [(r["k"], "number" if r["n"] else "text") for r in kinds]


def table_of(records: DataFrame, columns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Flattened records as a table: resource_type and a column for each key."""
    columns = columns_of(records) if columns is None else columns
    flat = records.select("resource_type", _flat("data_json").alias("m"))
    out = [(F.col("m")[k].try_cast("double") if kind == "number" else F.from_json(F.concat(F.lit('{"v":'), F.col("m")[k], F.lit("}")), "v string")["v"]).alias(k) for k, kind in columns]
    return flat.select("resource_type", *out)


def moments(df: DataFrame, numeric: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and the covariance matrix (each pair over the rows that have both), in one pass."""
    aggs = [F.avg(F.col(f"`{c}`")) for c in numeric] + [F.covar_samp(F.col(f"`{a}`"), F.col(f"`{b}`")) for i, a in enumerate(numeric) for b in numeric[i:]]
    row = [0.0 if x is None or x != x else float(x) for x in df.agg(*[a.alias(str(i)) for i, a in enumerate(aggs)]).first()]
    n, cov, at = len(numeric), np.zeros((len(numeric),) * 2), len(numeric)
    for i in range(n):
        for j in range(i, n):
            cov[i, j] = cov[j, i] = row[at]
            at += 1
    return np.array(row[:n]), cov


def marginal(df: DataFrame, column: str) -> DataFrame:
    """value, p: shares of the values that aren't null."""
    some = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(F.col(f"`{column}`"))).first()[0]
    return some.select("value", (F.col("n") / F.lit(max(1, total))).alias("p"))


def nearest_psd(matrix: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, 1e-8)) @ vectors.T


@dataclass(frozen=True)
class Marginals:
    """Numeric columns' quantiles on a grid of probabilities, and the normal scores of the grid: each column's rank transform and its inverse."""

    points: np.ndarray
    scores: np.ndarray

    def to_scores(self, x: np.ndarray) -> np.ndarray:
        """Normal scores of values (rows by column); equal values have that of their middle rank. NaN stays."""
        out = np.empty_like(x)
        for j, points in enumerate(self.points):
            value, first = np.unique(points, return_index=True)
            last = len(points) - 1 - np.unique(points[::-1], return_index=True)[1]
            out[:, j] = np.interp(x[:, j], value, (self.scores[first] + self.scores[last]) / 2)
        out[np.isnan(x)] = np.nan
        return out


def _double(c: str):
    """The column as a double; null for what is no finite number."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def marginals(df: DataFrame, numeric: list[str], grid: int = 400, accuracy: int = 20_000) -> Marginals:
    """By mergeable quantile sketches, all columns in one pass: ranks are off by at most 1 / accuracy of the rows, values between two quantiles of the grid are taken for evenly spread. A column without a value is 0."""
    steps = [k / grid for k in range(grid + 1)]
    row = df.agg(F.count("*").alias("n"), *[F.percentile_approx(_double(c), steps, accuracy).alias(f"q{i}") for i, c in enumerate(numeric)]).first()
    inner = [NormalDist().inv_cdf(p) for p in steps[1:-1]]
    end = NormalDist().inv_cdf(min(0.5 / grid, 1 / (row["n"] + 1)))
    points = [[0.0] * (grid + 1) if row[f"q{i}"] is None else row[f"q{i}"] for i in range(len(numeric))]
    return Marginals(np.array(points, float), np.array([end, *inner, -end]))


def score_correlations(df: DataFrame, numeric: list[str], of: Marginals) -> np.ndarray:
    """Pearson's of normal scores, each pair over the rows that have both: a task hands over one short row of sums."""
    n = len(numeric)
    shared = df.sparkSession.sparkContext.broadcast(of)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, n, n))
        for b in batches:
            z = shared.value.to_scores(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]))
            some = (~np.isnan(z)).astype(float)
            z = np.nan_to_num(z)
            total += np.stack([some.T @ some, z.T @ some, (z * z).T @ some, z.T @ z])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    values = df.select(*[_double(c).alias(f"x{i}") for i, c in enumerate(numeric)])
    summed = values.mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    if not summed:
        return np.eye(n)
    count, z, square, cross = np.array([r["v"] for r in summed]).reshape(4, n, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        var = square / count - (z / count) ** 2
        out = np.nan_to_num((cross / count - (z / count) * (z.T / count)) / np.sqrt(var * var.T), nan=0.0, posinf=0.0, neginf=0.0)
    np.fill_diagonal(out, 1.0)
    return np.clip(out, -1, 1)


def sample(df: DataFrame, n: int, seed: int = 0, preserve_correlations: bool = True, most_values: int = 10_000) -> DataFrame:
    """n rows like df's by a Gaussian copula over its numeric columns, whatever their distributions: correlated normal scores, each carried back by its column's quantiles. Other columns are drawn from their marginals.

    Draws are functions of the row's number and the seed, so a recomputed partition draws the same. Marginals with more than
    `most_values` values raise: they are identifiers, not categories.
    """
    spark = df.sparkSession
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte") or f.dataType.typeName().startswith("decimal")]
    other = [c for c in df.columns if c not in numeric]
    out = spark.range(n)

    def uniform(i: int):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    cols = []
    if numeric:
        of = marginals(df, numeric)
        factor = np.eye(len(numeric))
        if preserve_correlations and len(numeric) > 1:
            near = nearest_psd(score_correlations(df, numeric, of))
            scale = np.sqrt(np.diag(near))
            factor = np.linalg.cholesky(near / np.outer(scale, scale))
        shared = spark.sparkContext.broadcast(of)

        def back(i: int):
            @pandas_udf("double")
            def value(z: pd.Series) -> pd.Series:
                return pd.Series(np.interp(z, shared.value.scores, shared.value.points[i]))

            return value

        normal = [F.sqrt(-2 * F.log(uniform(2 * i))) * F.cos(2 * math.pi * uniform(2 * i + 1)) for i in range(len(numeric))]
        out = out.withColumns({f"__z{i}": z for i, z in enumerate(normal)})
        cols += [back(i)(sum((F.lit(float(factor[i, j])) * F.col(f"__z{j}") for j in range(i + 1)), F.lit(0.0))).alias(c) for i, c in enumerate(numeric)]
    for k, c in enumerate(other):
        shares = marginal(df, c).orderBy(F.desc("p"), "value").limit(most_values + 1).collect()
        if len(shares) > most_values:
            raise ValueError(f"{c} has more than {most_values} values")
        if shares:
            steps = np.cumsum([r["p"] for r in shares])
            u = uniform(10_000 + k)
            at = F.least(F.size(F.filter(F.array(*[F.lit(float(x)) for x in steps]), lambda s: s <= u)), F.lit(len(shares) - 1))  # noqa: B023
            cols.append(F.get(F.array(*[F.lit(r["value"]) for r in shares]), at).alias(c))
        else:
            cols.append(F.lit(None).cast("string").alias(c))
    return out.select(*cols)


def synthesize(records: DataFrame, n: int = 100, method: str = "gaussian_copula", seed: int = 0, preserve_correlations: bool = True, check: bool = True) -> DataFrame:
    """n synthetic records with dotted keys. method "ctgan" has no library here and falls back to the copula.

    check: raise ReidentificationRiskError where a synthetic row equals a real one or lies too close to it (see validate).
    """
    table = table_of(records)
    drawn = sample(table, n, seed, preserve_correlations)
    if check:
        validate(table, drawn)
    keys = [c for c in drawn.columns if c != "resource_type"]
    kind = F.when(F.col("resource_type").isin(*RESOURCE_TYPES), F.col("resource_type")).otherwise("Patient")
    return as_records(drawn, kind, F.to_json(F.struct(*[F.col(f"`{k}`").alias(k) for k in keys])) if keys else F.lit("{}"), "SYNTHETIC", F.lit(""), F.monotonically_increasing_id())


@dataclass(frozen=True)
class Risk:
    exact_match_rate: float = 0.0
    min_dcr: float = 0.0
    mean_dcr: float = 0.0
    median_dcr: float = 0.0
    high_risk_count: int = 0
    passed: bool = True


def scaled(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables' columns from 0 to 1 over their union, as an array v; missing values count as 0."""
    own = [F.col(f"`{c}`") for c in columns]
    both = real.select(*own).unionByName(synthetic.select(*own))
    row = both.agg(*[f(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    low = [row[f"lo{i}"] or 0.0 for i in range(len(columns))]
    span = [(row[f"hi{i}"] or 0.0) - low[i] or 1.0 for i in range(len(columns))]
    cell = lambda i, c: F.coalesce((F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) - F.lit(float(low[i]))) / F.lit(float(span[i])), F.lit(0.0))
    unit = lambda df: df.select(F.array(*[cell(i, c) for i, c in enumerate(columns)]).alias("v"))
    return unit(real), unit(synthetic)


def distance_stats(distances: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row: n, exact_match_rate, min, mean and median distance, high_risk_count."""
    return distances.agg(
        F.count("*").alias("n"), F.coalesce(F.avg((F.col("dcr") == 0).cast("double")), F.lit(0.0)).alias("exact_match_rate"), F.min("dcr").alias("min_dcr"), F.avg("dcr").alias("mean_dcr"),
        F.median("dcr").alias("median_dcr"), F.count_if(F.col("dcr") < threshold).alias("high_risk_count"),
    )


def assess(real: DataFrame, synthetic: DataFrame, threshold: float = 0.05, most_exact: float = 0.0) -> Risk:
    """Risk of two tables over their common numeric columns; never raises. Without common columns or rows: passed."""
    kinds = lambda df: {f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")}
    columns = sorted(kinds(real) & kinds(synthetic))
    if not columns:
        return Risk()
    has = lambda df: df.where(F.coalesce(*[F.col(f"`{c}`").cast("double") for c in columns]).isNotNull())
    r = distance_stats(closest(*scaled(has(real), has(synthetic), columns)), threshold).first()
    if not r["n"]:
        return Risk()
    return Risk(r["exact_match_rate"], r["min_dcr"], r["mean_dcr"], r["median_dcr"], r["high_risk_count"], r["exact_match_rate"] <= most_exact and not r["high_risk_count"])


def validate(real: DataFrame, synthetic: DataFrame, threshold: float = 0.05, most_exact: float = 0.0) -> Risk:
    risk = assess(real, synthetic, threshold, most_exact)
    if risk.exact_match_rate > most_exact:
        raise ReidentificationRiskError(f"{risk.exact_match_rate:.2%} of synthetic rows equal a real one; {most_exact:.2%} are allowed")
    if risk.high_risk_count:
        raise ReidentificationRiskError(f"{risk.high_risk_count} synthetic rows lie closer than {threshold:.4f} to a real one")
    return risk


@dataclass(frozen=True)
class Utility:
    fidelity: float = 0.0
    ml_utility: float = 0.0
    reidentification_risk: float = 0.0
    column_scores: dict = field(default_factory=dict)


def numeric_fidelity(mean_real: float, std_real: float, mean_syn: float, std_syn: float) -> float:
    near = lambda a, b: 1 - min(abs(a - b) / max(abs(a), abs(b), 1e-8), 1.0)
    return (near(mean_real, mean_syn) + near(std_real, std_syn)) / 2


def overlap(real: DataFrame, synthetic: DataFrame, column: str) -> DataFrame:
    """score: the shared mass of two marginals."""
    a, b = marginal(real, column), marginal(synthetic, column).withColumnRenamed("p", "q")
    return a.join(b, "value").agg(F.coalesce(F.sum(F.least("p", "q")), F.lit(0.0)).alias("score"))


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson's, over pairs of present values; undefined ones are 0, a constant column's own included."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.corr(F.col(f"`{columns[i]}`").cast("double"), F.col(f"`{columns[j]}`").cast("double")).alias(f"{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        x = row[f"{i}_{j}"]
        out[i, j] = out[j, i] = 0.0 if x is None or x != x else x
    return out


def evaluate(real: DataFrame, synthetic: DataFrame) -> Utility:
    """Fidelity of common columns, kept correlations, and risk; risk is computed even where validation would fail."""
    common = [c for c in real.columns if c in synthetic.columns]
    kind = {f.name: f.dataType.typeName() for f in real.schema}
    numeric = [c for c in common if kind[c] in ("double", "float", "integer", "long", "short", "byte", "boolean")]
    scores: dict = {}
    if numeric:
        stats = lambda df: df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        a, b = stats(real), stats(synthetic)
        for i, c in enumerate(numeric):
            scores[c] = numeric_fidelity(*[x[f"{k}{i}"] or 0.0 for x in (a, b) for k in "ms"])
    for c in common:
        if c not in numeric:
            scores[c] = overlap(real, synthetic, c).first()[0]
    kept = 1.0
    if len(numeric) >= 2:
        x, y = correlations(real, numeric), correlations(synthetic, numeric)
        kept = 1 - min(np.linalg.norm(x - y) / (np.linalg.norm(x) + 1e-8), 1.0)
    risk = assess(real, synthetic)
    return Utility(float(np.mean(list(scores.values()))) if scores else 0.0, float(kept), risk.exact_match_rate + max(0.0, 1 - risk.mean_dcr) * 0.01 if numeric else 0.0, scores)
