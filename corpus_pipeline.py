"""Corpus pipeline: quality, line dedup, near-dedup, mixing, tokens. Every stage is written to the shared folder and read again.

Every stage takes empty tables, nulls in any column, empty and very long texts, repeated rows and further columns, whatever their names; but the last, all return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe_replay, fm_quality, line_dedup, mixing
from veilspark.llm.common import cut, discard, table
from veilspark.llm.near_copies import keep_one
from veilspark.llm.queries import remainder, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: those with a score of 0.5 or more.

    Null and empty texts are scored as empty texts, and so kept or rejected alike; repeats of a row share its fate; a null id trains nothing and is scored; without labels all documents stay.
    """
    model = fm_quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return fm_quality.score(rows, model).where(F.col("score") >= 0.5).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source, however little is left of one; n_chars follows the text.

    Null texts stay null (with a null n_chars), empty ones empty; a null source is a source of its own; repeats of a row count as pages each and stay.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", "text")
    out = line_dedup.dedup_lines(rows, F.col("source"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more) the document with the least id.

    Rows without an id come after all others, and where none of a group has one that of the least hash of its text stays; repeats of the row that stays are one. Null, empty and blank texts are one group.
    """
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources has them: never, once or twice.

    Null, empty and blank texts have size 0 and are taken as their source's rate says; a null source is a source of its own, after all others; repeats of a row are taken alike.
    """
    return mixing.repeat_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of each document, their number, and whether they decode to its text. Null and empty texts have no ids, which decode to the empty text."""
    import public_tokenizers

    ranks = tokenizer("byte_bpe_50k.tiktoken")
    out = bpe_replay.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, decoded_col="decoded", at_spaces=True)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("decodes"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", tokens)]

#: SQL has neither the classifier nor the blocks of fingerprints; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
