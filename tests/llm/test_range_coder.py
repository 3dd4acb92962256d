import array
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import range_coder

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(PATH, encoding="utf-8") as f:
        return range_coder.Library(f.read())


@pytest.mark.parametrize("n", [0, 1, 7, 300, 301, 1500, 5000])
@pytest.mark.parametrize("block", [300, 2048])
def test_round_trip(n, block):
    rng = np.random.default_rng(n)
    pattern = np.tile(rng.integers(0, 50000, 40), n // 40 + 1)[:n]
    for ids in ((rng.zipf(1.3, n) % 50257), np.full(n, 50256), np.zeros(n), rng.integers(0, 65536, n), np.arange(n) % 65536, pattern):
        blocks = range_coder.encode_blocks(ids.astype(np.int64), block=block)
        assert (range_coder.decode_blocks(blocks) == ids).all()


def test_blocks_are_independent():
    ids = np.random.default_rng(1).zipf(1.3, 3000) % 50257
    blocks = range_coder.encode_blocks(ids, block=500)
    assert (range_coder.decode_blocks([blocks[3]]) == ids[1500:2000]).all()


def test_compresses_and_finds_damage():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50000, 300)
    ids = words[np.minimum(rng.zipf(1.2, 20000), 300) - 1]
    blocks = range_coder.encode_blocks(ids)
    plain = sum(len(zlib.compress(ids[at : at + 2048].astype("<u2").tobytes())) for at in range(0, len(ids), 2048))
    assert sum(map(len, blocks)) < plain
    repeats = range_coder.encode_blocks(np.tile(np.arange(50) * 977 % 50257, 40))
    assert sum(map(len, repeats)) < 700  # contexts of one and two ids
    with pytest.raises(ValueError):
        range_coder.decode_blocks([blocks[0][:20] + bytes([blocks[0][20] ^ 1]) + blocks[0][21:]])


def test_files_hold_the_librarys_ids(docs, empty, spark):
    t = Tokenizer.from_file(PATH)
    more = spark.createDataFrame([(7, "an <|endoftext|> end"), (7, "an"), (8, "<|endoftext|>" * 3), (None, "a"), (None, None)], "doc_id long, text string")
    every = docs.unionByName(more, allowMissingColumns=True)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in every.collect()))
    want, at = [], 0
    for has, k, _, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want.append((str(k if has else None), at, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        at += len(ids)
    for part_chars in (1 << 20, 3000):
        files = range_coder.write_ids(every, PATH, part_chars=part_chars)
        got = range_coder.read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
        assert sorted((str(r.doc_id), r.start, r.n_tokens, r.c) for r in got) == sorted(want)
    assert range_coder.read_ids(range_coder.write_ids(empty, PATH)).count() == 0


@pytest.mark.parametrize("wrong", [-1, 65536])
def test_ids_that_blocks_cannot_hold_are_refused(wrong):
    with pytest.raises(ValueError):
        range_coder.encode_blocks(np.array([1, wrong, 2], np.int64))


def test_pieces_give_the_ids_of_whole_texts(library):
    rng = random.Random(4)
    bits = ["a", "word", "Über", " ", " ", "  ", "   ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", " ", " ", "​", "\x1c", "\x85", "'s", "'", "12", "!?", "漢字", "🙂", "<|endoftext|>", "<|endoftext", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += ["an <|endoftext|> end", "<|endoftext|><|endoftext|>  x", "a  <|endoftext|>\n\nb <|endoftext|", "", " ", "\n", "x" * 5000, "y " * 5000]
    t = Tokenizer.from_file(PATH)
    assert library.apart
    ids, sizes = library.encode(pa.array([*texts, None]))
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]]
    assert got == [*[t.encode(x, add_special_tokens=False).ids for x in texts], []]
    assert 50256 in got[4000]


def test_other_definitions_are_encoded_whole():
    path = P.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        other = range_coder.Library(f.read())
    t = Tokenizer.from_file(path)
    texts = ["Two  words", "", "a\nb", None]
    ids, sizes = other.encode(pa.array(texts))
    assert not other.apart and [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_workers_keep_the_library_from_task_to_task(docs, spark, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        definition = f.read()
    one = range_coder.kept_library(definition)
    texts = pa.array(["some words", "other words", "an <|endoftext|> end", None])
    first = [x.tolist() for x in one.encode(texts)]
    monkeypatch.setattr(one.pieces, "of_pieces", None)  # nothing is new the second time
    again = range_coder.kept_library("".join(definition))
    assert again is one and [x.tolist() for x in again.encode(texts)] == first

    def uses(batches):
        for b in batches:
            info = range_coder.kept_library.cache_info()
            yield pa.RecordBatch.from_arrays([pa.array([info.misses] * len(b), pa.int64()), pa.array([info.hits] * len(b), pa.int64())], ["made", "again"])

    range_coder.write_ids(docs, PATH, part_chars=100)
    got = spark.range(0, 64, 1, 64).mapInArrow(uses, "made long, again long").collect()
    assert max(r.made for r in got) == 1 and max(r.again for r in got) > 0


def test_signs_at_words_make_no_new_pieces(library):
    t = Tokenizer.from_file(PATH)
    asked = []
    one = range_coder.Library(open(PATH, encoding="utf-8").read())
    inner = one.pieces.of_pieces
    one.pieces.of_pieces = lambda new: asked.extend(new) or inner(new)
    words = ["plain", "Über", "weiß", "naïve", "x×y", "don't", "l'été", "a_b", "3.5", "x1"]
    texts = [f" {w}{s} {s}{w}\n{w}{s}{w}" for w in words for s in ("", *"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'", "...", "…", "’s", "'s,", "''")]
    ids, sizes = one.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert {" plain", "plain", "\n"} <= {*asked} and not {" plain,", " weiß.", "\nplain"} & {*asked}  # whole pieces before
    rng = random.Random(5)
    bits = ["a", "Ab", "é", "ÿ", "×", "÷", "ł", "漢", "1", "½", "'", "'s", "'ll", "’", ",", ".", "!?", "_", "…", "­", " ", " ", "  ", "\n", "\t", " ", "​", "🙂"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    ids, sizes = one.encode(pa.array(texts)[7:])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [t.encode(x, add_special_tokens=False).ids for x in texts[7:]]
    assert [x.tolist() for x in one.encode(pa.array(["", None, ""]))] == [[], [0, 0, 0]]
    assert [len(x) for x in one.encode(pa.array([], pa.string()))] == [0, 0]


def test_blocks_hold_their_distribution():
    rng = np.random.default_rng(8)
    ids = np.sort(rng.integers(0, 50257, 700))[np.minimum(rng.zipf(1.4, 4 * 2048) - 1, 699)]
    blocks = range_coder.encode_blocks(ids)
    for i, b in enumerate(blocks):
        mine = ids[i * 2048 : (i + 1) * 2048]
        p = b[range_coder.HEAD_SIZE :]
        planes = np.frombuffer(zlib.decompress(p[4 : 4 + int.from_bytes(p[:4], "little")]), np.uint8).reshape(4, -1).astype(int)
        names, counts = np.unique(mine, return_counts=True)
        assert (np.cumsum(planes[0] + (planes[1] << 8)) == names).all() and (planes[2] + (planes[3] << 8) + 1 == counts).all()
    assert (range_coder.decode_blocks(blocks[::-1]) == ids.reshape(-1, 2048)[::-1].reshape(-1)).all()
