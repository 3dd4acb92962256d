"""Command line: ingest, deidentify, synthesize, audit. Datasets are Parquet folders, folders of JSON lines, or one JSON file of records."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import UnsupportedFormatError, VeilError
from .operators import audit, compliance, synthesis
from .operators.deidentify import Config, deidentify, ensure_salt
from .schema import RECORDS, read_json, write_json
from .sources.documents import read_documents
from .sources.fhir import FHIRSource
from .sources.hl7 import read_hl7
from .sources.tables import read_csv

_SUFFIXES = {".csv": "csv", ".json": "fhir", ".hl7": "hl7", ".hl7v2": "hl7", ".pdf": "pdf"}


def read_source(spark: SparkSession, path: str, kind: str = "auto") -> DataFrame:
    kind = _SUFFIXES.get(Path(path).suffix.lower(), "") if kind == "auto" else kind
    readers = {"csv": lambda: read_csv(spark, path), "fhir": lambda: FHIRSource(path).ingest(spark), "hl7": lambda: read_hl7(spark, path), "pdf": lambda: read_documents(spark, path)}
    if kind not in readers:
        raise UnsupportedFormatError(f"can't tell the format of {path}")
    return readers[kind]()


def load(spark: SparkSession, path: str) -> DataFrame:
    """.json: one file of records; .jsonl: a folder of JSON lines; else Parquet."""
    if path.endswith(".json"):
        return read_json(spark, path)
    return spark.read.schema(RECORDS).json(path) if path.endswith(".jsonl") else spark.read.parquet(path)


def save(df: DataFrame, path: str) -> None:
    if path.endswith(".json"):
        write_json(df, path)
    else:
        (df.write.mode("overwrite").json if path.endswith(".jsonl") else df.write.mode("overwrite").parquet)(path)


def summary_text(log: DataFrame) -> str:
    s = audit.summary_dict(log)
    return "\n".join(["Audit Log Summary", f"  Total entries: {s['total_entries']}", f"  PHI removed: {s['phi_removed']}", *[f"  By {k}: {s[f'by_{k}']}" for k in ("layer", "category", "action")]])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veilspark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="read a source into records")
    a.add_argument("source")
    a.add_argument("--format", default="auto", choices=["auto", "csv", "fhir", "hl7", "pdf"])
    a.add_argument("--out", required=True)
    a = sub.add_parser("deidentify", help="remove PHI from records")
    a.add_argument("data")
    a.add_argument("--out", required=True)
    a.add_argument("--audit")
    a.add_argument("--salt", default="")
    a.add_argument("--no-date-shift", action="store_true")
    a = sub.add_parser("synthesize", help="sample synthetic records")
    a.add_argument("data")
    a.add_argument("--out", required=True)
    a.add_argument("-n", type=int, default=100)
    a.add_argument("--method", default="gaussian_copula", choices=["gaussian_copula", "ctgan"])
    a.add_argument("--seed", type=int, default=0)
    a.add_argument("--no-check", action="store_true", help="keep rows however close they are to real ones")
    a = sub.add_parser("audit", help="show an audit log")
    a.add_argument("log")
    a.add_argument("--format", default="summary", choices=["summary", "json", "markdown"])
    o = p.parse_args(argv)
    spark = SparkSession.builder.appName("veilspark").getOrCreate()
    try:
        if o.command == "ingest":
            save(read_source(spark, o.source, o.format), o.out)
        elif o.command == "deidentify":
            clean, log = deidentify(load(spark, o.data), ensure_salt(Config(date_shift=not o.no_date_shift, date_shift_salt=o.salt)), once=bool(o.audit))
            save(clean, o.out)
            if o.audit:
                (audit.save_json if o.audit.endswith(".json") else lambda x, p: x.write.mode("overwrite").parquet(p))(log, o.audit)
        elif o.command == "synthesize":
            save(synthesis.synthesize(load(spark, o.data), o.n, o.method, o.seed, check=not o.no_check), o.out)
        else:
            log = audit.from_json(spark, o.log) if o.log.endswith(".json") else audit.read(spark, o.log)
            shows = {"summary": summary_text, "json": audit.to_json, "markdown": lambda x: compliance.to_markdown(compliance.report(x, x.select("record_id").distinct().count()))}
            print(shows[o.format](log))
    except VeilError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
