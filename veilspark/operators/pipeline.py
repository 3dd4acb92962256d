"""Orchestration: ingest, de-identify with lineage, and synthesise."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PipelineConfigError
from ..schema import merge
from . import lineage, synthesis
from .deidentify import Config, deidentify, ensure_salt

#: A source is anything with ingest(spark) -> records, or such a function.
Source = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class PipelineConfig:
    deidentify: bool = True
    deid: Config = field(default_factory=Config)
    track_lineage: bool = True
    generate_synthetic: bool = False
    synthetic_n: int = 100
    synthetic_method: str = "gaussian_copula"
    validate_synthetic: bool = True
    seed: int = 0


@dataclass(frozen=True)
class PipelineResult:
    raw: DataFrame
    clean: DataFrame | None = None
    audit: DataFrame | None = None
    lineage: DataFrame | None = None
    synthetic: DataFrame | None = None


def ingest(spark: SparkSession, sources: Sequence) -> DataFrame:
    """Records of all sources in their order."""
    return merge([(s.ingest if hasattr(s, "ingest") else s)(spark) for s in sources], spark)


def run(spark: SparkSession, sources: Sequence, config: PipelineConfig | None = None) -> PipelineResult:
    config = config or PipelineConfig()
    if config.generate_synthetic and not config.deidentify:
        raise PipelineConfigError("synthetic data are made from de-identified records only")
    raw = ingest(spark, sources)
    told = F.create_map(F.lit("source_format"), F.col("source_format"), F.lit("source_uri"), F.col("source_uri"))
    nodes = lineage.of_records(raw, "ingest", 0, metadata=told) if config.track_lineage else None
    clean = log = synthetic = None
    if config.deidentify:
        clean, log = deidentify(raw, ensure_salt(config.deid), once=True)
        if config.track_lineage:
            before = clean.join(raw.select("id", F.col("checksum").alias("__before")), "id", "left")
            nodes = nodes.unionByName(lineage.of_records(before, "deidentify", 1, before=F.col("__before")))
            nodes = lineage.linked(nodes)
    if config.generate_synthetic:
        synthetic = synthesis.synthesize(clean, config.synthetic_n, config.synthetic_method, config.seed, check=config.validate_synthetic)
    return PipelineResult(raw, clean, log, nodes, synthetic)
