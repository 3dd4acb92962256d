"""Differentially private statistics: one aggregation for each query on the executors.

private_stats draws noise once, on the driver. release gives answers as a table, for more groups than a driver holds: there noise is a keyed function of query and group, so that a retried task or a second action gives the
same noise, which an observer could otherwise average away.
"""

from __future__ import annotations

import logging
import math
import random
import secrets
import threading
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BudgetExhaustedError
from ..schema import path, present

_SLACK, LOW = 1e-12, 0.2
log = logging.getLogger(__name__)


class Laplace:
    def __init__(self, epsilon: float, sensitivity: float = 1.0, rng: random.Random | None = None) -> None:
        if epsilon <= 0:
            raise ValueError("epsilon must be positive")
        self.scale, self.rng = sensitivity / epsilon, rng or random.SystemRandom()

    def release(self, value: float) -> float:
        u = self.rng.random() - 0.5
        return value - self.scale * math.copysign(math.log(max(1e-300, 1 - 2 * abs(u))), u)

    def release_array(self, values: Sequence[float]) -> list[float]:
        return [self.release(v) for v in values]


class Gaussian:
    def __init__(self, epsilon: float, delta: float, sensitivity: float = 1.0, rng: random.Random | None = None) -> None:
        if epsilon <= 0:
            raise ValueError("epsilon must be positive")
        if not 0 < delta < 1:
            raise ValueError("delta must lie between 0 and 1")
        self.sigma, self.rng = sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon, rng or random.SystemRandom()

    def release(self, value: float) -> float:
        return value + self.rng.gauss(0, self.sigma)

    def release_array(self, values: Sequence[float]) -> list[float]:
        return [self.release(v) for v in values]


@dataclass(frozen=True)
class Spend:
    label: str
    epsilon: float
    delta: float
    epsilon_left: float


@dataclass
class Budget:
    """A ledger with sequential composition, on the driver."""

    total_epsilon: float
    total_delta: float = 0.0
    entries: list[Spend] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.total_epsilon <= 0:
            raise ValueError("epsilon must be positive")
        self._lock = threading.Lock()

    @property
    def epsilon_spent(self) -> float:
        return math.fsum(e.epsilon for e in self.entries)

    @property
    def delta_spent(self) -> float:
        return math.fsum(e.delta for e in self.entries)

    @property
    def epsilon_remaining(self) -> float:
        return max(0.0, self.total_epsilon - self.epsilon_spent)

    def can_afford(self, epsilon: float, delta: float = 0.0) -> bool:
        return self.epsilon_spent + epsilon <= self.total_epsilon + _SLACK and self.delta_spent + delta <= self.total_delta + _SLACK

    def spend(self, epsilon: float, delta: float = 0.0, label: str = "") -> float:
        with self._lock:
            if not self.can_afford(epsilon, delta):
                raise BudgetExhaustedError(self.epsilon_remaining)
            left = max(0.0, self.total_epsilon - self.epsilon_spent - epsilon)
            self.entries.append(Spend(label, epsilon, delta, left))
            if left < LOW * self.total_epsilon:
                log.warning("privacy budget is low: %.4f of %.4f left", left, self.total_epsilon)
            return left

    @property
    def low(self) -> bool:
        return self.epsilon_remaining < LOW * self.total_epsilon

    def reset(self) -> None:
        with self._lock:
            self.entries.clear()

    def to_df(self, spark) -> DataFrame:
        rows = [(i, e.label, e.epsilon, e.delta, e.epsilon_left) for i, e in enumerate(self.entries)]
        return spark.createDataFrame(rows, "seq int, label string, epsilon double, delta double, epsilon_left double")


@dataclass(frozen=True)
class Count:
    field: str = ""
    group_by: str | None = None


@dataclass(frozen=True)
class Mean:
    field: str
    low: float = 0.0
    high: float = 1000.0
    group_by: str | None = None


@dataclass(frozen=True)
class Histogram:
    field: str
    bins: int = 10


@dataclass(frozen=True)
class Result:
    values: dict
    epsilon_used: float
    epsilon_remaining: float | None = None


def counts_record(resource_type: Column, data_json: Column, name: str) -> Column:
    """The field is there, or its name is part of the record's type (the empty name is part of every one)."""
    return F.coalesce(present(path(data_json, name)), F.lit(False)) | F.contains(F.lower(resource_type), F.lit(name.strip().lower()))


def group_key(value: Column) -> Column:
    """Missing and empty values are "ungrouped"; booleans read True and False."""
    return F.coalesce(F.when(value == "true", "True").when(value == "false", "False").when(value != "", value), F.lit("ungrouped"))


def number(value: Column) -> Column:
    """A number, null for what isn't one; true and false are 1 and 0."""
    return F.when(value == "true", F.lit(1.0)).when(value == "false", F.lit(0.0)).when(~F.rlike(value, F.lit("[dDfF]\\s*$")), value.try_cast("double"))


def clamped(value: Column, low: float, high: float) -> Column:
    """Null stays null; greatest() and least() alone would pass over it."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def true_count(df: DataFrame, condition: Column, group: Column | None = None) -> DataFrame:
    if group is None:
        return df.agg(F.count_if(condition).alias("n"))
    return df.where(condition).groupBy(group.alias("key")).agg(F.count("*").alias("n"))


def true_mean(df: DataFrame, value: Column, low: float, high: float, group: Column | None = None) -> DataFrame:
    """Values are clamped before averaging; without any the mean is 0, and a group without any is absent."""
    if group is None:
        return df.agg(F.coalesce(F.avg(clamped(value, low, high)), F.lit(0.0)).alias("mean"))
    return df.where(value.isNotNull()).groupBy(group.alias("key")).agg(F.avg(clamped(value, low, high)).alias("mean"))


def true_histogram(df: DataFrame, value: Column) -> DataFrame:
    return df.where(value.isNotNull() & (value != "")).groupBy(value.alias("key")).agg(F.count("*").alias("n"))


def keyed_uniform(key: Column, *parts: Column) -> Column:
    """A number in (0, 1) with 52 random bits, a function of the key and the parts alone; parts can't run into each other."""
    text = F.concat_ws("|", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (c.cast("string") for c in parts)])
    bits = F.substring(F.sha2(F.concat(key, F.sha2(F.concat(key, text), 256)), 256), 1, 13)
    return (F.conv(bits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def keyed_laplace(value: Column, scale: Column, key: Column, *parts: Column) -> Column:
    """value with Laplace noise of that scale, by the inverse of its distribution."""
    u = keyed_uniform(key, *parts) - 0.5
    return value - scale * F.signum(u) * F.log1p(-2 * F.abs(u))


def _text_only(data_json: Column, name: str) -> Column:
    """The field's value where it is a JSON string."""
    v = F.try_variant_get(F.try_parse_json(data_json), "$." + name, "variant") if name else F.lit(None)
    return F.when(F.schema_of_variant(v) == "STRING", path(data_json, name))


def private_stats(records: DataFrame, epsilon: float, queries: Sequence[Count | Mean | Histogram], budget: Budget | None = None, rng: random.Random | None = None, per_group_sensitivity: bool = True) -> Result:
    """Answer queries with Laplace noise, epsilon shared evenly. The budget is charged for each query before it runs.

    Keys: "count:F", "mean:F", "histogram:F", and "...|group_by:G" with a dict by group. A mean's sensitivity divides by the number of
    values in its group; per_group_sensitivity=False divides by the number of all records, which noises groups too little.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    each, out = epsilon / max(1, len(queries)), {}
    data, n_records = F.col("data_json"), None
    whole = lambda x: max(0, round(x))
    for q in queries:
        kind, group = type(q).__name__.lower(), getattr(q, "group_by", None)
        name = f"{kind}:{q.field}" + (f"|group_by:{group}" if group else "")
        if budget is not None:
            budget.spend(each, label=name)
        by = group_key(path(data, group)) if group else None
        if isinstance(q, Count):
            rows = true_count(records, counts_record(F.col("resource_type"), data, q.field), by).collect()
            noise = Laplace(each, 1.0, rng)
            out[name] = {r["key"]: whole(noise.release(r["n"])) for r in rows} if group else whole(noise.release(rows[0]["n"]))
        elif isinstance(q, Histogram):
            noise = Laplace(each, 1.0, rng)
            out[name] = {r["key"]: whole(noise.release(r["n"])) for r in true_histogram(records, _text_only(data, q.field)).collect()}
        else:
            value = number(path(data, q.field))
            if not per_group_sensitivity and n_records is None:
                n_records = records.count()
            view = records.withColumn("__v", value)
            view = view.where(F.col("__v").isNotNull()) if group else view
            keyed = view.groupBy(by.alias("key")) if group else view.groupBy()
            rows = keyed.agg(F.coalesce(F.avg(clamped(F.col("__v"), q.low, q.high)), F.lit(0.0)).alias("mean"), F.count("__v").alias("n")).collect()
            release = lambda r: round(Laplace(each, (q.high - q.low) / max(1, r["n"] if per_group_sensitivity else n_records), rng).release(r["mean"]), 4)  # noqa: B023, E731
            out[name] = {r["key"]: release(r) for r in rows} if group else release(rows[0])
    return Result(out, epsilon, budget.epsilon_remaining if budget else None)


def query_name(q: Count | Mean | Histogram) -> str:
    group = getattr(q, "group_by", None)
    return f"{type(q).__name__.lower()}:{q.field}" + (f"|group_by:{group}" if group else "")


def _true_answers(records: DataFrame, q: Count | Mean | Histogram) -> DataFrame:
    """key (null where there are no groups), the true value and its sensitivity. Hot groups are aggregated before they are shuffled."""
    data, group = F.col("data_json"), getattr(q, "group_by", None)
    by = group_key(path(data, group)) if group else None
    alone = F.lit(None).cast("string")
    if isinstance(q, Histogram):
        return true_histogram(records, _text_only(data, q.field)).select("key", F.col("n").cast("double").alias("value"), F.lit(1.0).alias("sensitivity"))
    if isinstance(q, Count):
        rows = true_count(records, counts_record(F.col("resource_type"), data, q.field), by)
        return rows.select((F.col("key") if group else alone).alias("key"), F.col("n").cast("double").alias("value"), F.lit(1.0).alias("sensitivity"))
    view = records.select(number(path(data, q.field)).alias("v"), (by if group else alone).alias("key"))
    mean = [F.coalesce(F.avg(clamped(F.col("v"), q.low, q.high)), F.lit(0.0)).alias("value"), (F.lit(float(q.high - q.low)) / F.greatest(F.count("v"), F.lit(1))).alias("sensitivity")]
    return view.where(F.col("v").isNotNull()).groupBy("key").agg(*mean) if group else view.agg(*mean).select(alone.alias("key"), "value", "sensitivity")


def release(records: DataFrame, epsilon: float, queries: Sequence[Count | Mean | Histogram], budget: Budget | None = None, secret: str | None = None) -> DataFrame:
    """private_stats as a table: query, key (null for an answer without groups) and value, a row a group; nothing of it reaches the driver. Counts are whole and not negative, means have four decimals.

    The noise of an answer is a function of the secret, the query and the group: equal on recomputation, and drawn anew only for another secret. Without one a secret of this release alone is made; it is joined as a row of a
    local table, so that no plan shows it. A secret must not serve for two states of the data: the difference of two answers would be without noise. The same query named twice is one answer, charged twice.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    if not queries:
        raise ValueError("no queries")
    if secret is not None and len(secret) < 16:
        raise ValueError("a secret has 16 characters or more")
    each = epsilon / len(queries)
    if budget is not None:
        for q in queries:
            budget.spend(each, label=query_name(q))
    keys = records.sparkSession.createDataFrame([(query_name(q), secret or k) for k in (secrets.token_hex(32),) for q in dict.fromkeys(queries)], "query string, secret string")
    out = None
    for q in dict.fromkeys(queries):
        rows = _true_answers(records, q).withColumn("query", F.lit(query_name(q))).withColumn("whole", F.lit(not isinstance(q, Mean)))
        out = rows if out is None else out.unionByName(rows)
    # One short row a query.
    noisy = keyed_laplace(F.col("value"), F.col("sensitivity") / each, F.col("secret"), F.col("query"), F.coalesce(F.concat(F.lit("="), "key"), F.lit("")))
    value = out.join(F.broadcast(keys), "query").withColumn("noisy", noisy)
    return value.select("query", "key", F.when(F.col("whole"), F.greatest(F.round("noisy"), F.lit(0.0))).otherwise(F.round("noisy", 4)).alias("value"))
