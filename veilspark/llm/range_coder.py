"""Token ids as files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Within a block an id is known by its number: its place among the block's distinct ids. Three orders predict it. Orders 2 and 1 each expect one number, the last one
seen after the same two ids or the same id, and count how often in a row they were right; order 0 is the distribution of all ids of the block. The mix of the three drives a
carry-less range coder with a 64-bit low end and 32-bit output words. An id is coded in two steps: the first tells whose prediction holds (order 2's, order 1's or
neither's), under shares that are adapted for each state of trust in the orders; the second is the number in order 0's distribution, if neither holds.
Each block of BLOCK ids starts from a fresh model, has order 0's distribution (its distinct ids and their counts) before its words, and carries a CRC-32, so any block is
read, or found damaged, by itself.

One numpy step codes one id of every block of a group at once, so blocks are lanes and Python's cost is shared.

File format: Parquet rows of (part, first, doc_ids, lengths, blocks); a row is a group of whole documents in id order, `first` its first id's position in
the part, parts are in order of ids. A block is b"CMR3", its number of ids, its payload's CRC-32 (little-endian unsigned 32 bits each) and the payload: the size of the
distribution in bytes (32 bits), the distribution (deflated: low bytes of the distinct ids' differences, their high bytes, low and high bytes of the counts less one) and the 32-bit words.

Defined results: null and empty texts are the end id alone; null ids come first; rows with equal ids follow each other by text;
an empty table writes no row; extra columns are ignored; a damaged block raises ValueError when read; ids of 65536 or more raise ValueError when written.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .pieces import ODD, Finer, slices

BLOCK, GROUP, LANES = 2048, 6 << 20, 3072
KEEP, TOGETHER = 1_000_000, 20_000
HEAD, HEAD_SIZE = "<4sII", 12
NUMBERS, NUMBER_BITS, PAIRS = 2048, 11, 1024
#: The mix: shares out of TOTAL, of LEAST at least for what is seen next to never; they move by a RATE-th power of two of the way.
TOTAL, LEAST, RATE = 4096, 16, 5
ORDER2, ORDER1, NEITHER = 0, 1, 2
U = np.uint64
BITS, LAST, WORD, LOWER, NAME_BITS, NAME_LAST = U(12), U(TOTAL - 1), U(32), U(0xFFFFFFFF), U(NUMBER_BITS), U(NUMBERS - 1)


def _mix() -> np.ndarray:
    """Shares that the mix begins with, by trust in order 2 (0 to 3) and order 1 (0, 1): where each symbol's begins, and their total."""
    rows = [[0, two, two + (1 - two) * one, 1] for two in (0.01, 0.15, 0.4, 0.7) for one in (0.08, 0.3)]
    return (np.array(rows) * TOTAL).astype(np.int16).view(np.int64).reshape(-1)


#: Where they move when a symbol was seen. A row of four is one item of 64 bits, which numpy moves faster.
AIMS = np.array([[0, TOTAL - 2 * LEAST, TOTAL - LEAST, TOTAL], [0, LEAST, TOTAL - LEAST, TOTAL], [0, LEAST, 2 * LEAST, TOTAL]], np.int16).view(np.int64).reshape(-1)


class Model:
    """The orders and mixes of n blocks, in step with each other."""

    def __init__(self, n: int) -> None:
        lane = np.arange(n)
        self.n = n
        self.mix = np.tile(_mix(), n)
        self.guesses = np.zeros(n * (NUMBERS + PAIRS), np.int16)  # a number, and from bit 12 on how often it was right
        self.of_one, self.of_two, self.of_mix, self.of_bound = lane * NUMBERS, lane * PAIRS + n * NUMBERS, lane * 8, lane * 4
        self.at, self.x, self.was = np.empty(2 * n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)

    def guess(self, a: np.ndarray) -> None:
        """What is expected after the number a, and after it and the one before."""
        n, at, x = self.n, self.at, self.x
        np.add(self.of_one, a, out=at[:n])
        np.multiply(a, 0x9E3779B1, out=x)
        x += self.was
        x >>= 15
        x &= PAIRS - 1
        np.add(self.of_two, x, out=at[n:])
        np.multiply(a, 0x85EBCA77, out=self.was)
        self.e = e = self.guesses.take(at).reshape(2, n)
        self.expected = e & 4095  # by order 1, by order 2
        trust = e[1] >> 12
        trust += trust
        trust += e[0] >> 13
        self.at_mix = self.of_mix + trust
        self.row = self.mix.take(self.at_mix).view(np.int16).reshape(-1, 4)

    def bounds(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bound and width of a symbol in the mix."""
        flat, at = self.row.reshape(-1), self.of_bound + symbol
        start = flat.take(at)
        at += 1
        return start.astype(U), (flat.take(at) - start).astype(U)

    def learn(self, number: np.ndarray, symbol: np.ndarray) -> None:
        d = AIMS.take(symbol).view(np.int16).reshape(-1, 4)
        d -= self.row
        d >>= RATE
        d += self.row
        self.mix[self.at_mix] = d.view(np.int64).reshape(-1)
        more = np.minimum(self.e + np.int16(4096), self.e | np.int16(12288))
        self.guesses[self.at] = np.where(self.expected == number, more, number | np.int16(4096)).reshape(-1)


def _settle(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks whose span is short of 32 bits move on by a word; a span that straddles a word's end is cut off there."""
    due = (span < U(1 << 32)).nonzero()[0]
    a = low.take(due)
    span[due] = np.minimum(span.take(due), U(1 << 32) - (a & LOWER)) << WORD
    low[due] = a << WORD
    return due, a


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of each id in its block; all blocks' distinct ids, one block after another, their counts, and how many a block has."""
    n, length = ids.shape
    keys = ids.astype(np.uint32) << np.uint32(NUMBER_BITS)
    keys |= np.arange(length, dtype=np.uint32)
    keys.sort(axis=1)
    ordered = keys >> np.uint32(NUMBER_BITS)
    head = np.ones(ids.shape, bool)
    np.not_equal(ordered[:, 1:], ordered[:, :-1], out=head[:, 1:])
    rank = np.cumsum(head, axis=1, dtype=np.int16)
    rank -= np.int16(1)
    keys &= np.uint32(NUMBERS - 1)
    numbers = np.empty(n * length, np.int16)
    numbers[(keys + np.arange(0, n * length, length, dtype=np.int64)[:, None]).reshape(-1)] = rank.reshape(-1)
    heads = head.reshape(-1).nonzero()[0]
    return numbers.reshape(n, length), ordered.reshape(-1).take(heads).astype(np.int64), np.diff(np.r_[heads, n * length]), rank[:, -1].astype(np.int64) + 1


def _shares(counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order 0 of blocks: by number its lower bound (from bit 12 on) and width, out of NUMBERS; where each block's begin."""
    first = np.cumsum(sizes) - sizes
    length = np.add.reduceat(counts, first)
    width = counts * np.repeat(NUMBERS // length, sizes)
    width[first + sizes - 1] += NUMBERS % length
    start = (np.cumsum(width) - width) % NUMBERS  # every block has NUMBERS in all
    return (start << 12 | width).astype(np.uint32), first


def encode_lanes(ids: np.ndarray) -> list[bytes]:
    """ids (blocks, length) -> the payload of each block."""
    n, length = ids.shape
    model, lane = Model(n), np.arange(n)
    low, span = np.zeros(n, U), np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    out = np.zeros((n, length + 8), np.uint32)  # one word an id at most
    flat, spot = out.reshape(-1), lane * out.shape[1]
    numbers, names, counts, sizes = _distinct(ids)
    shares, first = _shares(counts, sizes)
    shares = shares.take(numbers + first[:, None])
    x = np.zeros(n, np.int64)
    for number, share in zip(np.ascontiguousarray(numbers.T), np.ascontiguousarray(shares.T), strict=True):
        model.guess(x)
        x = number.astype(np.int64)
        right = (model.expected == number).view(np.int8)
        symbol = ((NEITHER - right[0]) * (1 - right[1])).astype(np.int64)
        start, width = model.bounds(symbol)
        span >>= BITS
        start *= span
        low += start
        span *= width
        share = np.where(symbol == NEITHER, share, np.uint32(NUMBERS)).astype(U)
        span >>= NAME_BITS
        start = share >> BITS
        start *= span
        low += start
        share &= LAST
        span *= share
        model.learn(number, symbol)
        due, was = _settle(low, span)
        s = spot.take(due)
        flat[s] = was >> WORD
        spot[due] = s + 1
    flat[spot] = low >> WORD
    flat[spot + 1] = low & LOWER
    used = spot - lane * out.shape[1] + 2
    step = np.diff(names, prepend=0)
    step[first] = names[first]
    counts -= 1
    planes = np.stack([step & 255, step >> 8, counts & 255, counts >> 8]).astype(np.uint8)
    heads = [zlib.compress(planes[:, a : a + k].tobytes(), 1) for a, k in zip(first.tolist(), sizes.tolist(), strict=True)]
    return [struct.pack("<I", len(h)) + h + out[i, : used[i]].tobytes() for i, h in enumerate(heads)]


def decode_lanes(payloads: list[bytes], length: int) -> np.ndarray:
    n = len(payloads)
    model = Model(n)
    heads = [4 + struct.unpack_from("<I", p)[0] for p in payloads]
    tables = [np.frombuffer(zlib.decompress(p[4:h]), np.uint8).reshape(4, -1) for p, h in zip(payloads, heads, strict=True)]
    sizes = np.array([t.shape[1] for t in tables])
    step, above, counts, more = np.concatenate(tables, axis=1).astype(np.int64)
    step += above << 8
    counts += (more << 8) + 1
    shares, first = _shares(counts, sizes)
    names = np.cumsum(step)
    names = (names - np.repeat(names[first] - step[first], sizes)).astype(np.uint16)
    slots = np.repeat((np.arange(len(step)) - np.repeat(first, sizes)).astype(np.int16), shares & 4095)
    most = max(len(p) - h for p, h in zip(payloads, heads, strict=True)) // 4 + 1
    words = np.zeros((n, most), np.uint32)
    for i, (p, h) in enumerate(zip(payloads, heads, strict=True)):
        words[i, : (len(p) - h) // 4] = np.frombuffer(p, np.uint32, offset=h)
    flat, spot = words.reshape(-1), np.arange(n) * most
    low, span = np.zeros(n, U), np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    above = flat.take(spot).astype(U) << WORD | flat.take(spot + 1)  # the code less the low end
    spot += 2
    of_slot = np.arange(n) * NUMBERS
    out = np.empty((length, n), np.int16)
    x = np.zeros(n, np.int64)
    for t in range(length):
        model.guess(x)
        span >>= BITS
        v = np.minimum(above // span, LAST).astype(np.int16)
        symbol = (v >= model.row[:, 1]).astype(np.int64)
        symbol += v >= model.row[:, 2]
        start, width = model.bounds(symbol)
        start *= span
        low += start
        above -= start
        span *= width
        span >>= NAME_BITS
        v = np.minimum(above // span, NAME_LAST).view(np.int64)
        v += of_slot
        found = slots.take(v)
        neither = symbol == NEITHER
        number = np.where(neither, found, np.where(symbol == ORDER1, model.expected[0], model.expected[1]))
        share = np.where(neither, shares.take(first + found), np.uint32(NUMBERS)).astype(U)
        start = share >> BITS
        start *= span
        low += start
        above -= start
        share &= LAST
        span *= share
        model.learn(number, symbol)
        due, _ = _settle(low, span)
        s = spot.take(due)
        above[due] = above.take(due) << WORD | flat.take(s, mode="clip")
        spot[due] = s + 1
        out[t] = number
        x = number.astype(np.int64)
    return names.take(out.T + first[:, None])


def _lanes(n: int) -> int:
    """So many of n blocks go together: LANES at most, and about as many each time."""
    return max(1, -(-n // -(-n // LANES)))


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """All ids of a group -> its blocks. The last one is filled up with zeros for coding; its head tells its length."""
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 16):
        raise ValueError("an id outside 0..65535")
    if not 0 < block <= NUMBERS:
        raise ValueError(f"a block holds 1 to {NUMBERS} ids")
    n = -(-len(ids) // block)
    if n == 0:
        return []
    length = min(block, len(ids))
    grid = np.zeros(n * length, np.int64)
    grid[: len(ids)] = ids
    grid, out = grid.reshape(n, length), []
    lanes = _lanes(n)
    for at in range(0, n, lanes):
        for i, p in enumerate(encode_lanes(grid[at : at + lanes]), at):
            out.append(struct.pack(HEAD, b"CMR3", min(length, len(ids) - i * length), zlib.crc32(p)) + p)
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    sizes, payloads = [], []
    for b in blocks:
        mark, n, crc = struct.unpack_from(HEAD, b)
        p = b[HEAD_SIZE:]
        if mark != b"CMR3" or zlib.crc32(p) != crc:
            raise ValueError("damaged block")
        sizes.append(n)
        payloads.append(p)
    if not blocks:
        return np.empty(0, np.int64)
    length, lanes = max(sizes), _lanes(len(blocks))
    out = []
    for at in range(0, len(blocks), lanes):
        grid = decode_lanes(payloads[at : at + lanes], length)
        out += [row[:n] for row, n in zip(grid, sizes[at : at + lanes], strict=True)]
    return np.concatenate(out).astype(np.int64)


#: Words of these are one match of the library's pattern, with the space before them.
PLAIN = r"\A ?[A-Za-zÀ-ÖØ-öø-ÿ]+\z"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level definition."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Library:
    """Ids by the tokenizers library in its default state. Of a byte-level BPE definition each distinct piece of the texts is encoded once, plain words by the library with the definition's
    model and a cut at spaces in place of its pattern; other definitions, and texts that hold added tokens, are encoded whole."""

    def __init__(self, definition: str, keep: int = KEEP) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        of = json.loads(definition)
        split, letters = of.get("pre_tokenizer") or {}, _byte_letters()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        feed = self.text("\n")
        self.apart = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not of.get("normalizer") and len(feed) == 1
        self.apart = self.apart and of["model"]["type"] == "BPE" and vocabulary.keys() >= {*letters}
        self.feed = feed[0] if feed else -1
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        if self.apart:
            plain = of | {"pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "added_tokens": []}
            self.plain = Tokenizer.from_str(json.dumps(plain))
            self.letters = str.maketrans({chr(b): x for b, x in enumerate(letters)} | {"\n": " "})
            self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.width[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.pieces = Finer(self.of_pieces, self.text, added, keep)

    def text(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def of_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        every, sizes = pa.array(new, pa.string()), np.zeros(len(new), np.int64)
        is_plain = np.asarray(pc.match_substring_regex(every, PLAIN), bool)
        groups = []
        for at, of in ((is_plain.nonzero()[0], self.of_plain), ((~is_plain).nonzero()[0], self.of_others)):
            for a in range(0, len(at), TOGETHER):
                ids, sizes[at[a : a + TOGETHER]] = of(every.take(pa.array(at[a : a + TOGETHER])))
                groups.append((at[a : a + TOGETHER], ids))
        start = np.cumsum(sizes) - sizes
        out = np.empty(sizes.sum(), np.int32)
        for at, ids in groups:
            size = sizes[at]
            out[np.repeat(start[at] - np.cumsum(size) + size, size) + np.arange(len(ids))] = ids
        return out, sizes

    def of_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words go in one text of byte letters; which ids are whose is told by their bytes."""
        text = "\n".join(words.to_numpy(zero_copy_only=False)).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        upto, ends = np.cumsum(self.width.take(ids)), np.cumsum(np.asarray(pc.binary_length(words), np.int64))
        last = np.minimum(np.searchsorted(upto, ends), len(ids) - 1)
        if (upto[last] != ends).any() or upto[-1] != ends[-1]:
            raise ValueError("the tokenizer's ids and the words' bytes disagree")
        return ids, np.diff(np.r_[-1, last])

    def of_others(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Line feeds are one id; pieces with other white space than their first character are encoded one by one, others in one text, parted by line feeds, which are a token of their own there."""
        new = pieces.to_pylist()
        odd = np.asarray(pc.match_substring_regex(pa.array([p[1:] if p[:1] == " " and len(p) > 1 else p for p in new], pa.string()), ODD), bool).tolist()
        some = [p for p, x in zip(new, odd, strict=True) if not x]
        together = np.array(self.text("\n".join(some)), np.int32)
        feeds = (together == self.feed).nonzero()[0]
        if len(feeds) != max(len(some) - 1, 0):
            raise ValueError("the tokenizer does not part pieces at line feeds")
        parts = iter(zip([0, *(feeds + 1).tolist()], [*feeds.tolist(), len(together)], strict=True))
        ids = [np.array(self.text(p), np.int32) if x else together[slice(*next(parts))] for p, x in zip(new, odd, strict=True)]
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of each."""
        if self.apart:
            return self.pieces.encode(texts)
        got = [np.array(self.text(t) if t else [], np.int32) for t in texts.to_pylist()]
        return np.concatenate([np.empty(0, np.int32), *got]), np.fromiter(map(len, got), np.int64, len(got))


@lru_cache(maxsize=1)
def kept_library(definition: str) -> Library:
    """The library of a Python worker, with the pieces that it knows, from task to task."""
    return Library(definition)


GROUPS = "part int, first long, doc_ids array<long>, lengths array<long>, blocks array<binary>"


def write_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, part_chars: int = 12 << 20) -> DataFrame:
    """Encode whole texts, each with the end id after it, write groups of blocks in ascending order of ids; returns the written table. The number of parts follows the size of the texts."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library, part, first = kept_library(shared.value), TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[np.ndarray] = []
        have = 0

        def group() -> pa.RecordBatch:
            nonlocal first, have
            blocks = encode_blocks(np.concatenate(held))
            row = [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))]
            first += have
            have = 0
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(row, ["part", "first", "doc_ids", "lengths", "blocks"])

        for b in batches:
            keys, at = b.column(0).to_pylist(), 0
            for texts in slices(b.column(1)):
                flat, sizes = library.encode(texts)
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, end)
                ends += np.arange(1, len(ends) + 1)
                for key, x, y in zip(keys[at : at + len(texts)], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    if have and have + y - x > GROUP:
                        yield group()
                    ids.append(key)
                    held.append(flat[x:y])
                    have += y - x
                at += len(texts)
        if held:
            yield group()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / part_chars))
    # Rows of one id, or without one, are parted by how their texts begin, which is also how they are ordered.
    dealt = rows.withColumn("head", F.substring("text", 1, 32)).repartitionByRange(parts, "id", "head").sortWithinPartitions("id", "text")
    return cut(dealt.select("id", "text").mapInArrow(code, GROUPS), "tokenids")


def read_ids(groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the files: id, start, n_tokens, ids (little-endian unsigned 32 bits each) of every document."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = decode_blocks(row["blocks"]).astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("blocks and index disagree")
                for at in range(0, len(ends), 500):
                    e = ends[at : at + 500]
                    s = np.r_[ends[at - 1] if at else 0, e[:-1]]
                    raw = [ids[x:y].tobytes() for x, y in zip(s, e, strict=True)]
                    columns = [pa.array([row["part"]] * len(e), pa.int32()), pa.array(row["doc_ids"][at : at + 500], pa.int64()), pa.array(s + row["first"]), pa.array(e - s), pa.array(raw, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "id", "at", "n_tokens", "ids"])

    sizes = groups.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    out = groups.mapInArrow(decoded, "part int, id long, at long, n_tokens long, ids binary")
    return out.join(F.broadcast(before), "part").select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
