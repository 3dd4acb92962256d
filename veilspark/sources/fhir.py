"""FHIR bundles from files, and from a server by a Spark data source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FHIRValidationError, IngestError
from ..schema import RESOURCE_TYPES, empty, records
from . import framed
from .fhir_server import FHIRServer


def bundle_records(df: DataFrame, json_col: str, uri_col: str | None = None) -> DataFrame:
    """Bundles as JSON text -> a record for each entry with a known type: entry.resource, or the entry itself where it has none."""
    entries = df.select((F.col(uri_col) if uri_col else F.lit("")).alias("uri"), F.posexplode(F.from_json(F.get_json_object(json_col, "$.entry"), "array<string>")).alias("n", "e"))
    inner = F.get_json_object("e", "$.resource")
    rows = entries.select("uri", "n", F.coalesce(inner, F.col("e")).alias("j"))
    return records(rows, F.get_json_object("j", "$.resourceType"), F.col("j"), "FHIR_R4", F.col("uri"), F.col("n"))


def _entry_records(entries: DataFrame) -> DataFrame:
    """uri, n and text of entries -> records; an entry that is no JSON has none."""
    rows = entries.select("uri", "n", _as_json(F.col("text")).alias("e")).select("uri", "n", F.coalesce(F.get_json_object("e", "$.resource"), F.col("e")).alias("j"))
    return records(rows, F.get_json_object("j", "$.resourceType"), F.col("j"), "FHIR_R4", F.col("uri"), F.col("n"))


def _as_json(text: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), 0)


def read_bundles(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Bundle files of any size, each read by as many tasks as it has byte ranges; see framed.

    strict: jobs first look for files whose brackets or strings are not closed, that hold no JSON object, an entry that is none, or no Bundle, and raise.
    """
    try:
        entries, files = framed.entries(spark, path)
    except Exception as e:
        raise IngestError(f"can't read {path}", detail=str(e)[:300]) from e
    if strict:
        bad, other = files.agg(F.count_if(~F.col("ok")), F.count_if(F.col("ok") & ~F.col("name").eqNullSafe("Bundle"))).first()
        bad = bad or entries.where(_as_json(F.col("text")).isNull()).select("uri").distinct().count()
        if bad:
            raise IngestError(f"{bad} file(s) in {path} hold no JSON")
        if other:
            raise FHIRValidationError(f"{other} file(s) in {path} hold no Bundle")
    return _entry_records(entries)


@dataclass
class Auth:
    token: str = ""


@dataclass
class FHIRSource:
    """A bundle file or folder (a path ending in .json) or a server's address. options: further ones of the data source, see fhir_server."""

    url: str
    auth: Auth = field(default_factory=Auth)
    resource_types: tuple[str, ...] = RESOURCE_TYPES
    page_size: int = 100
    options: dict[str, str] = field(default_factory=dict)

    def _options(self, spark: SparkSession, known: list[str]) -> dict[str, str]:
        spark.dataSource.register(FHIRServer)
        return {"url": self.url, "types": ",".join(known), "count": str(self.page_size), "token": self.auth.token, **self.options}

    def ingest(self, spark: SparkSession) -> DataFrame:
        if self.url.endswith(".json") and not self.url.startswith(("http://", "https://")):
            return read_bundles(spark, self.url)
        known = [t for t in self.resource_types if t in RESOURCE_TYPES]
        if not known:
            return empty(spark)
        return _of_server(spark.read.format("fhir_server").options(**self._options(spark, known)).load())

    def stream(self, spark: SparkSession) -> DataFrame:
        """Records of a server as they are updated; each update of a resource is a record."""
        known = [t for t in self.resource_types if t in RESOURCE_TYPES]
        return _of_server(spark.readStream.format("fhir_server").options(**self._options(spark, known)).load())


def _of_server(rows: DataFrame) -> DataFrame:
    return records(rows, F.col("resource_type"), F.col("data_json"), "FHIR_R4", F.col("uri"), F.col("n"))
