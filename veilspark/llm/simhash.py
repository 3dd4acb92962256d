"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint's 64 bits are cut into `blocks` pieces. Two fingerprints within `distance` bits agree on at least
blocks - distance pieces, so each combination of that many pieces is a join key and no close pair is missed.
Candidates are compared inside a key only. Work is on distinct fingerprints, so copies cost one row. A key that holds
more than `small` of them is not paired: its members go to a second set of finer keys whose free bits are so few that a key holds
at most 2**14 fingerprints by construction; those are linked by flipping one or two free bits, in linear time.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows are kept, one result each;
a null id gets a fingerprint and its component's least id (null if the component has none); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import cut, hot_values, salted_join
from .components import components, named_components

BITS = 64
COARSE, FINE = 5, 10


def fingerprint(text: str | None, shingle: int = 3, chunk: int = 1 << 16) -> int:
    """Signed 64-bit SimHash of the whole text. Bits are counted over `chunk` shingles at a time."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(tokens) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, chunk):
        part = tokens[at : min(at + chunk, n) + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle)), strict=False) if len(tokens) >= shingle else [tokens]
        h = np.fromiter((digest(b" ".join(r), 42) for r in rows), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _factors(n: int) -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(b"factors").digest(8 * n), "<u8") | np.uint64(1)


FACTORS = _factors(1024)
BYTES, SHIFTS = np.uint64(0x0101010101010101), np.arange(8, dtype=np.uint64)[:, None]


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64 * words bits over the hashes (unsigned): of each hash every word is a mix of its own, and a bit is set if it is in over half. The first words are the same whatever their number."""
    factors = FACTORS[:words] if words <= len(FACTORS) else _factors(words)
    ones = np.zeros((words, 8, 8), np.int64)
    for at in range(0, len(hashes), 255):  # a byte counts so far
        x = hashes[at : at + 255, None] * factors
        x ^= x >> np.uint64(32)
        votes = x[:, None, :] >> SHIFTS
        votes &= BYTES
        ones += np.add.reduce(votes, axis=0).view(np.uint8).reshape(8, words, 8).transpose(1, 2, 0)
    return np.packbits(2 * ones.reshape(-1) > len(hashes), bitorder="little").view(np.uint64)


@pandas_udf(LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([fingerprint(t) for t in s], dtype="int64")


def masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of all combinations of blocks - distance pieces, as unsigned integers."""
    ends = [round(i * BITS / blocks) for i in range(blocks + 1)]
    piece = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(ends)]
    return [sum(piece[i] for i in c) for c in itertools.combinations(range(blocks), blocks - distance)]


def _pairwise_roots(x: np.ndarray, distance: int) -> np.ndarray:
    """For each of x (sorted) the least member that links reach inside x; all pairs of a small x are compared."""
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
    at, label = np.arange(len(x)), np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            return x[at[label]]
        label = new


def _cube_roots(x: np.ndarray, free: int, distance: int) -> np.ndarray:
    """The same for members that differ only in the bits of `free`: each looks up its neighbours, so time is linear."""
    bits = [i for i in range(BITS) if free >> i & 1]
    code = sum((((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k) for k, b in enumerate(bits))
    none = len(x)
    label = np.full(1 << len(bits), none, np.int64)
    label[code] = np.arange(none)
    flips = [sum(1 << k for k in c) for d in range(1, distance + 1) for c in itertools.combinations(range(len(bits)), d)]
    mine = label[code].copy()
    while True:
        new = mine.copy()
        for f in flips:
            np.minimum(new, label[code ^ f], out=new)
        if (new == mine).all():
            return x[mine]
        mine = new
        label[code] = mine


def _links(keys: list[int], distance: int, small: int | None):
    """Arrow function over rows (c, fp) sorted by key: links (a, b) to a least member; (fp, null) for members of keys above `small`."""
    full = (1 << BITS) - 1
    mask = np.array(keys, np.uint64)

    def roots(c: int, x: np.ndarray) -> np.ndarray:
        return _pairwise_roots(x, distance) if len(x) <= 256 else _cube_roots(x, full & ~keys[c], distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_x, over = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def emit(a: list, b: list, whole: list) -> pa.RecordBatch:
            a, b, whole = (np.concatenate([np.empty(0, np.uint64), *v]) for v in (a, b, whole))
            left = pa.array(np.concatenate([a, whole]).view(np.int64))
            return pa.RecordBatch.from_arrays([left, pa.concat_arrays([pa.array(b.view(np.int64)), pa.nulls(len(whole), pa.int64())])], ["a", "b"])

        def closed(c: np.ndarray, x: np.ndarray, last: bool):
            """Handle all runs but, unless last, the final one; give back what is left open."""
            nonlocal over
            a, b, whole = [], [], []
            v = x & mask[c]
            start = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (v[1:] != v[:-1])]) if len(c) else np.empty(0, np.int64)
            size = np.diff(np.r_[start, len(c)])
            done = len(start) if last else len(start) - 1
            for k in np.flatnonzero((size > 1) | (np.arange(len(start)) == 0)):
                s, n = start[k], size[k]
                key, x1 = (int(c[s]), int(v[s])), x[s : s + n]
                if k >= done and not (small and n > small):
                    continue
                if over == key or (small and n > small):
                    whole.append(x1)
                    over = key
                elif n > 1:
                    x1 = np.unique(x1)
                    r = roots(key[0], x1)
                    a.append(x1[x1 != r])
                    b.append(r[x1 != r])
            rest = len(c) if last or not len(start) else start[-1]
            if not last and len(start) and over == (int(c[start[-1]]), int(v[start[-1]])) and done < len(start):
                if not (small and size[-1] > small):  # a continuation of a key that is already over
                    whole.append(x[start[-1] :])
                rest = len(c)
            return emit(a, b, whole), c[rest:], x[rest:]

        for batch in batches:
            held_c = np.r_[held_c, np.asarray(batch.column(0), dtype=np.int64)]
            held_x = np.r_[held_x, np.asarray(batch.column(1), dtype=np.int64).view(np.uint64)]
            if len(held_c):
                out, held_c, held_x = closed(held_c, held_x, last=False)
                yield out
        if len(held_c):
            yield closed(held_c, held_x, last=True)[0]

    return run


def _keyed(fps: DataFrame, keys: list[int], distance: int, small: int | None) -> DataFrame:
    signed = [m - (1 << 64) if m >> 63 else m for m in keys]
    rows = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("c", "v"), "fp")
    return rows.repartition("c", "v").sortWithinPartitions("c", "v", "fp").select("c", "fp").mapInArrow(_links(keys, distance, small), "a long, b long")


def links(fps: DataFrame, distance: int = 2, small: int = 256) -> DataFrame:
    """fps (fp), distinct -> (a, b): enough links for the components of all pairs within `distance` bits."""
    first = cut(_keyed(fps, masks(COARSE, distance), distance, small), "simlinks")
    crowded = first.where("b is null").select(F.col("a").alias("fp")).distinct()
    finer = _keyed(crowded, masks(FINE, distance), distance, None)
    return first.where("b is not null").union(finer)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the least id that links reach)."""
    prints = cut(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp")), "simhash")
    reps = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simreps")
    named = named_components(reps, components(links(reps.select("fp"), distance)))
    hot = hot_values(reps, "fp", "n")
    out = salted_join(prints, named, "fp", hot, F.xxhash64("id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
