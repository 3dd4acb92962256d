import base64
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from veilspark.llm import bpe_replay

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_same_as_the_library():
    rng = random.Random(2)
    parts = ["a", "aa", "the", "ing", "  ", "**", "==", "ha", "'ll", "\n\n", "0000", "é", "漢", "🙂", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 126), rng.randint(160, 700), rng.randint(0x4E00, 0x4F00)])) for _ in range(rng.randint(0, 90))) for _ in range(800)]
    parts += [" ", "\n", " a", " \n", "\r\n", "   ", "\xa0", "\u2003", "\x1c", "<|endoftext|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for keep, at_spaces in ((10, False), (10, True), (100_000, True)):
        e = bpe_replay.Encoder(RANKS, P.PATTERN, keep, at_spaces)
        for at in range(0, len(texts), 400):
            ids, sizes = e.encode(pa.array(texts[at : at + 400]))
            got = [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]]
            assert got == [REAL.encode_ordinary(t) for t in texts[at : at + 400]]


def test_columns(docs, empty, spark):
    out = bpe_replay.encode(docs, PATH, P.PATTERN)
    rows = out.select("*", bpe_replay.decode(F.col("token_ids"), PATH, spark).alias("raw")).collect()
    assert len(rows) == docs.count()
    assert all(r.token_ids == REAL.encode_ordinary(r.text or "") and bytes(r.raw) == (r.text or "").encode() for r in rows)
    for at_spaces in (False, True):
        both = bpe_replay.encode(docs, PATH, P.PATTERN, decoded_col="raw", at_spaces=at_spaces).collect()
        assert all(bytes(r.raw) == (r.text or "").encode() and r.token_ids == REAL.encode_ordinary(r.text or "") for r in both) and set(docs.columns) < set(both[0].asDict())


def test_columns_of_the_outputs_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "one two", 5, "old"), (1, "one two", 5, "old"), (None, None, None, None)], "doc_id int, text string, token_ids int, raw string")
    rows = bpe_replay.encode(df, PATH, P.PATTERN, decoded_col="raw", at_spaces=True).collect()
    assert sorted(len(r.token_ids) for r in rows) == [0, 2, 2] and {bytes(r.raw) for r in rows} == {b"one two", b""}


def test_empty_table(empty):
    assert bpe_replay.encode(empty, PATH, P.PATTERN).count() == 0
