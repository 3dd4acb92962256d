"""Clinical documents: text, or files whose text an extractor finds; patient, ICD-10 conditions and the document itself by heuristics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..errors import IngestError
from ..schema import records

# How names, births, record numbers and ICD-10 codes are written. Repeats are possessive, which long texts need in Java.
NAME = r"(?iU)(?:Patient|Name)\s*:\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+)"
BORN = r"(?iU)(?:DOB|Date of Birth|Birth\s*Date)\s*:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
NUMBER = r"(?iU)(?:MRN|Medical Record|Record Number)\s*:?\s*([A-Z0-9-]+)"
ICD10 = r"\b([A-TV-Z]\d{2}(?:\.\d{1,4})?)\b"


def text_records(df: DataFrame, text_col: str, uri_col: str) -> DataFrame:
    t = F.col(text_col)
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    words = F.split(F.trim(first(NAME)), r"(?U)\s+")
    n = F.size(words)
    name = F.when(first(NAME).isNotNull(), F.array(F.struct(F.when(n > 1, F.slice(words, 1, F.greatest(n - 1, F.lit(1)))).otherwise(words).alias("given"), F.when(n > 1, F.element_at(words, -1)).otherwise(F.lit("")).alias("family"))))
    patient = F.to_json(F.struct(F.lit("Patient").alias("resourceType"), name.alias("name"), first(BORN).alias("birthDate"), first(NUMBER).alias("id")))
    row = lambda kind, j: F.struct(F.lit(kind).alias("t"), j.alias("j"))
    some = F.coalesce(first(NAME), first(BORN), first(NUMBER)).isNotNull()
    codes = F.array_distinct(F.regexp_extract_all(t, F.lit(ICD10), F.lit(1)))
    conditions = F.transform(codes, lambda c: row("Condition", F.to_json(F.struct(F.lit("Condition").alias("resourceType"), F.struct(F.lit("ICD-10-CM").alias("system"), c.alias("code")).alias("code")))))
    whole = F.to_json(F.struct(F.lit("DocumentReference").alias("resourceType"), t.alias("content"), F.concat(F.lit("Full text extracted from "), F.col(uri_col)).alias("description")))
    every = F.concat(F.filter(F.array(F.when(some, row("Patient", patient))), lambda x: x.isNotNull()), conditions, F.array(row("DocumentReference", whole)))
    rows = df.where(t.isNotNull()).select(F.col(uri_col).alias("uri"), F.posexplode(every).alias("k", "r"))
    return records(rows, F.col("r.t"), F.col("r.j"), "PDF", F.col("uri"), F.col("k"))


def plain_text(content: bytes) -> str:
    """The text layer by pdfplumber where it is installed, else the bytes read as UTF-8 without what isn't."""
    try:
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return "\n".join(p.extract_text() or "" for p in pdf.pages)
    except Exception:
        return content.decode("utf-8", "ignore")


def read_documents(spark: SparkSession, path: str, extractor: Callable[[bytes], str] = plain_text) -> DataFrame:
    """Files by path or pattern; extractor is any function from a file's bytes to its text (OCR, for instance)."""

    @pandas_udf(StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([extractor(bytes(x)) for x in s], dtype=object)

    try:
        files = spark.read.format("binaryFile").load(path)
    except Exception as e:
        raise IngestError(f"no document at {path}", detail=str(e)[:300]) from e
    return text_records(files.select(text("content").alias("text"), F.col("path").alias("uri")), "text", "uri")
