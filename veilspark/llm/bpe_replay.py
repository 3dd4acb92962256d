"""Byte-level BPE by corpus-level merge replay, and decoding.

The distinct pretokens of a batch of documents are laid out in one symbol sequence with links between neighbours. An inverted index
leads from a token pair (by the rank of what it merges to) to its positions over all those words. Ranks are taken in order; each
merge is applied at all its positions and only the two neighbours that it touched enter the index anew. Documents are then put together from
the encoded pretokens. Pretokens of earlier batches are kept until there are `keep`, so memory is bounded; no result depends on it.

Defined results: null and empty texts have no ids; rows and extra columns pass unchanged; a column that has the output's
name is replaced.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .pieces import Known, Pieces, slices

NONE = np.int64(-1)
KEEP, TOGETHER, PART = 100_000, 40_000, 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """(a << 20 | b) -> id for every split of every token into two tokens."""
    out, get = {}, ranks.get
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a = get(token[:i])
            if a is not None and (b := get(token[i:])) is not None:
                out[a << 20 | b] = rank
    return out


class Merges:
    """The vocabulary as arrays: ids of bytes, and the sorted pair keys (a << 20 | b) with what they merge to."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = pair_table(ranks)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.sorted = keys[order]
        self.keys, self.to = np.r_[self.sorted, -2], np.r_[np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Ranks of which two merges can want the same symbol: tokens that begin as they end.
        self.doubles = {r for t, r in ranks.items() if any(t[:n] == t[-n:] for n in range(1, len(t)))}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none; a negative id stands for a word's end, and makes a negative key, which no pair has."""
        key = left << 20 | right
        at = self.sorted.searchsorted(key)
        return np.where(self.keys[at] == key, self.to[at], NONE)


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """All ids of pieces one after another, and the number of ids of each."""
    raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
    ends = np.r_[0, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)]
    sym = merges.byte_id[raw]
    sym[ends] = -1
    after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
    pair = np.r_[merges.rank(sym[:-1], sym[1:]), -1]  # of each position with the one after it
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Positions into the index, by the rank of their pair."""
        rank = pair[at]
        if len(at) > 1:
            order = rank.argsort(kind="stable")
            at, rank = at[order], rank[order]
            bounds = [0, *((rank[1:] != rank[:-1]).nonzero()[0] + 1).tolist(), len(at)]
        else:
            bounds = [0, len(at)] if len(at) else [0]
        for a, b in itertools.pairwise(bounds):
            r = int(rank[a])
            if r in index:
                index[r].append(at[a:b])
            else:
                index[r] = [at[a:b]]
                heapq.heappush(queue, r)

    enter((pair >= 0).nonzero()[0])
    while queue:
        rank = heapq.heappop(queue)
        found = index.pop(rank)
        i = np.concatenate(found) if len(found) > 1 else found[0]
        i = i[pair[i] == rank]  # the others were touched by an earlier merge; one that is there twice is merged alike twice
        if not len(i):
            continue
        if rank in merges.doubles and len(i) > 1:
            i = np.unique(i)
            chained = after[i[:-1]] == i[1:]
            if chained.any():  # in a row of the same pair, as in aaaa, every second one merges
                first = np.maximum.accumulate(np.where(np.r_[True, ~chained], np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - first) % 2 == 0]
        j = after[i]
        k = after[j]
        sym[i], sym[j], pair[j] = rank, -2, -1
        after[i], before[k] = k, i
        h = before[i]
        near = np.concatenate((h[sym[h] >= 0], i))
        new = merges.rank(sym[near], sym[after[near]])
        pair[near] = new
        enter(near[new >= 0])
    alive = sym >= 0
    upto = np.r_[0, np.cumsum(alive)]
    return sym[alive].astype(np.int32), upto[ends[1:]] - upto[ends[:-1]]


def give_back() -> None:
    """Freed memory back to the system: Python workers outlive their task, and what they hold counts against the executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


class Encoder:
    """Ids of batches of texts by one replay over the distinct pretokens that are new in a batch. at_spaces: the pattern takes a space only before a word or in a run of
    white space, so texts are first cut into pieces at spaces and line feeds, and only new pieces are matched with the pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = KEEP, at_spaces: bool = False) -> None:
        import regex

        self.ranks, self.merges, self.find = ranks, Merges(ranks), regex.compile(pattern).findall
        feed = ranks.get(b"\n")
        self.pieces = Pieces(self.of_pieces, self.of_text, [], keep) if at_spaces and feed is not None and self.find("\na\n b") == ["\n", "a", "\n", " b"] else None

    def of_pretokens(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pretokens, and the number of ids of each."""
        raw = [w.encode() for w in new]
        whole = np.array([self.ranks.get(w, -1) for w in raw], np.int64)
        rest = [w for w, r in zip(raw, whole, strict=True) if r < 0]
        done = [replay(rest[at : at + TOGETHER], self.merges) for at in range(0, len(rest), TOGETHER)]
        sizes = np.ones(len(new), np.int64)
        if done:
            sizes[whole < 0] = np.concatenate([d[1] for d in done])
        out = np.repeat(whole.astype(np.int32), sizes)
        if done:
            out[np.repeat(whole < 0, sizes)] = np.concatenate([d[0] for d in done])
        return out, sizes

    def of_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number = Known()
        found = [self.find(p if p[:1] == "\n" else " " + p) for p in new]
        codes = np.fromiter((number[w] for ws in found for w in ws), np.int64)
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat, size = self.of_pretokens(list(number))
        each, start = size[codes], np.r_[0, np.cumsum(size)]
        upto = np.cumsum(each)
        ids = flat[np.arange(upto[-1] if len(codes) else 0) + np.repeat(start[codes] - upto + each, each)]
        upto = np.r_[0, upto][np.cumsum(n)]
        return ids, np.diff(np.r_[0, upto])

    def of_text(self, text: str) -> np.ndarray:
        return self.of_pretokens(self.find(text))[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and the number of ids of each."""
        if self.pieces:
            return self.pieces.encode(texts)
        number = Known()
        codes = [np.fromiter(map(number.__getitem__, self.find(t)), np.int64) if t else np.empty(0, np.int64) for t in texts.to_pylist()]
        flat, size = self.of_pretokens(list(number))
        start, p = np.r_[0, np.cumsum(size)], np.concatenate([np.empty(0, np.int64), *codes])
        each = size[p]
        upto = np.cumsum(each)
        ids = flat[np.arange(upto[-1] if len(p) else 0) + np.repeat(start[p] - upto + each, each)]
        ends = np.r_[0, upto][np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))]
        return ids, np.diff(np.r_[0, ends])


def _table(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Bytes by id."""
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        out[i] = b
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", keep: int = KEEP, decoded_col: str | None = None, at_spaces: bool = False) -> DataFrame:
    """docs with the ids of each whole text, and, where decoded_col names a column, the bytes that these ids decode to.

    The rank file is a fixed vocabulary, read on the driver and broadcast. Decoding in the same worker saves sending the ids back and forth. at_spaces: see Encoder.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = StructType([StructField("ids", ArrayType(IntegerType())), *([StructField("raw", BinaryType())] if decoded_col else [])])

    @arrow_udf(kind)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, piece = Encoder(shared.value, pattern, keep, at_spaces), np.array(_table(shared.value), object)
        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.struct([pa.field(n, t) for n, t in zip(names, types, strict=True)]))
            for texts in slices(batch.cast(pa.string()), PART):
                ids, sizes = encoder.encode(texts)
                ends = np.r_[0, np.cumsum(sizes)]
                columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded_col:
                    parts = piece[ids].tolist()
                    columns.append(pa.array([b"".join(parts[a:b]) for a, b in itertools.pairwise(ends.tolist())], pa.binary()))
                    del parts
                yield pa.StructArray.from_arrays(columns, names)
                del ids, columns
                give_back()

    names, types = (["ids", "raw"], [pa.list_(pa.int32()), pa.binary()]) if decoded_col else (["ids"], [pa.list_(pa.int32())])
    out = docs.select(*[c for c in docs.columns if c not in (out_col, decoded_col)], coded(F.col(text_col).cast("string")).alias("__coded"))
    return out.select("*", F.col("__coded.ids").alias(out_col), *([F.col("__coded.raw").alias(decoded_col)] if decoded_col else [])).drop("__coded")


def decode(ids: Column, ranks_path: str, spark) -> Column:
    """The bytes of an array of ids; null for null."""
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @pandas_udf(BinaryType())
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        piece = _table(shared.value).__getitem__
        for s in batches:
            yield pd.Series([None if x is None else b"".join(map(piece, x.tolist())) for x in s], dtype=object)

    return raw(ids)
