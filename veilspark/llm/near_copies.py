"""SimHash near-dedup at a similarity of word shingles: a fingerprint of all shingles, blocks of its bits, Hamming check, exact Jaccard similarity, components.

Every bit of a fingerprint is what most of the text's distinct shingles have there (`simhash.long_fingerprint`); a shingle is `shingle` words (ASCII letters in lower case; the whole text where it has fewer words).
Two sets of Jaccard similarity s have a cosine of 2 s / (1 + s) at least, so a bit differs with probability acos(2 s / (1 + s)) / pi at most: 0.151 at 0.8. That is some ten of 64 bits, too many for
blocks that are sure to agree by the pigeonhole principle and still selective. So fingerprints are long: besides CHECK bits they have as many blocks of `width` bits as leave a pair at the similarity
with probability LOSS without a common one. Blocks are narrow (about 2**ROOM texts to a block's value), since in a block the CHECK bits of all members are compared: only pairs
within RADIUS of them go on, and link if the sets themselves reach `similarity`. Sets of four or five shingles are too small for these shares; they have their subsets of four as blocks too.
Work is on distinct texts, so copies cost one row.

Groups are not paired off. In a block every member looks up its neighbours (members within RADIUS) in numpy, and what leaves the task is a row a member: its nearest neighbour and their number. The member with the most
neighbours, over all its blocks, is a block's head. First each text is compared with three others at most: its nearest neighbour, the most central of its blocks' heads, and the head with which it shares most blocks. Then
with its nearest neighbour in another component. Last, members of a block that are still in different components are compared, but for pairs that cannot be close: two sets as close as s differ in at most
(1 - s) / (1 + s) of their sizes' sum, and where their sizes, or the parities of the numbers of shingles in PARITY classes of hashes, differ more often than that, the sets do. Both are seen within the task, so only pairs
that may be close are rows. Pairs within a component need no test. So no link between components is missed. A block of over CROWD members is not searched at first (all members are kept), and last in parts: those outside
its commonest component meet each part of it.

Defined results: null and empty texts are copies of each other; repeated rows are kept by near_duplicates, one result each, and are one row for keep_one; a null id gets its component's least id (null if
the component has none); extra columns are ignored by near_duplicates and pass keep_one. Texts and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType

from .bpe_replay import give_back
from .common import cut, discard, hot_values, salted_join
from .components import components, named_components
from .simhash import long_fingerprint

SHINGLE, SIMILARITY = 5, 0.8
CHECK, RADIUS, LOSS = 128, 38, 5e-5
ROOM, SMALL, CROWD, PARITY = 3, 64, 4096, 1024


def layout(texts: int, similarity: float) -> tuple[int, int]:
    """Width and number of the blocks for so many texts."""
    width = min(max(12, math.ceil(math.log2(max(texts, 2))) - ROOM), 40)
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return width, math.ceil(math.log(LOSS) / math.log1p(-(same**width)))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; none for a text without words."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    rows = zip(*(tokens[i:] for i in range(shingle)), strict=False) if len(tokens) >= shingle else [tokens]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(r), 5) for r in rows), np.uint64))


def print_of(found: np.ndarray, words: int) -> bytes:
    """The fingerprint; after it, for a set of four or five shingles, a number for each subset of four."""
    import xxhash

    more = [xxhash.xxh64_intdigest(np.array(c).tobytes(), 7) for c in itertools.combinations(found, 4)] if len(found) in (4, 5) else []
    return np.r_[long_fingerprint(found, words), np.array(more, np.uint64)].tobytes()


def _column(of, kind):
    @pandas_udf(kind)
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([of(t) for t in s], dtype=object)
            give_back()

    return column


def _blocks(width: int, blocks: int, words: int):
    """Arrow function over (fp, print): a row (k, fp, check bits) for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, number = 1 << np.arange(width), np.arange(blocks) << 40
        for batch in batches:
            for at in range(0, len(batch), 500):
                fps, prints = np.asarray(batch.column(0)[at : at + 500]), batch.column(1)[at : at + 500].to_pylist()
                x = np.frombuffer(b"".join(p[: 8 * words] for p in prints), np.uint8).reshape(len(prints), 8 * words)
                bits = np.unpackbits(x[:, CHECK // 8 :], axis=1, count=blocks * width, bitorder="little")
                keys = bits.reshape(len(prints), blocks, width) @ power + number
                more = [np.frombuffer(p, np.int64, offset=8 * words) | np.iinfo(np.int64).min for p in prints]
                of = np.r_[np.repeat(np.arange(len(prints)), blocks), np.repeat(np.arange(len(prints)), [len(m) for m in more])]
                check = x[:, : CHECK // 8].copy().view(np.int64)[of]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.r_[keys.reshape(-1), *more], fps[of], check[:, 0].copy(), check[:, 1].copy())], ["k", "fp", "c0", "c1"])

    return run


def _whole(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first `keys` columns, in parts that end where a key does. A column of lists becomes a matrix."""

    def array(x: pa.Array) -> np.ndarray:
        return np.asarray(x.flatten()).reshape(len(x), -1) if pa.types.is_list(x.type) else np.asarray(x)

    held: list[np.ndarray] = []
    for batch in batches:
        if not len(batch):
            continue
        new = [array(x) for x in batch.columns]
        held = [np.concatenate([h, x]) for h, x in zip(held, new, strict=True)] if held else new
        other = np.any([x[:-1] != x[-1] for x in held[:keys]], axis=0).nonzero()[0]
        if len(other):
            yield [h[: other[-1] + 1] for h in held]
            held = [h[other[-1] + 1 :] for h in held]
    if held:
        yield held


def _sizes(k: np.ndarray) -> np.ndarray:
    """The size of each member's block."""
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return np.repeat(sizes := np.diff(np.r_[start, len(k)]), sizes)


def _close(k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Pairs of rows of one block within RADIUS, with their distance; c holds the check bits, a row of words for each member."""
    found, step = [np.empty((3, 0), np.int64)], 1
    while len(i := np.flatnonzero(k[step:] == k[:-step])):
        d = np.bitwise_count(c[i] ^ c[i + step]).sum(axis=1)
        i, d = i[d <= RADIUS], d[d <= RADIUS]
        found.append(np.array([i, i + step, d], np.int64))
        step += 1
    return np.concatenate(found, axis=1)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp, check bits) sorted by k: pairs (a, b) within RADIUS of blocks of at most SMALL members; of larger ones (k, a, null, size) for each member. All pairs of a block: what `_neighbours` is held against."""
    for k, fp, *c in _whole(batches):
        size = _sizes(k)
        large, at = size > SMALL, np.flatnonzero(size <= SMALL)
        i, j, _ = _close(k[at], np.array(c).view(np.uint64).T[at])
        a, b = np.sort(np.array([fp[at][i], fp[at][j]]), axis=0)
        none = pa.nulls(int(large.sum()), pa.int64())
        rows = [[pa.nulls(len(a), pa.int64()), pa.array(k[large])], [pa.array(a), pa.array(fp[large])], [pa.array(b), none], [pa.nulls(len(a), pa.int64()), pa.array(size[large])]]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in rows], ["k", "a", "b", "n"])


def _neighbours(batches: Iterator[pa.RecordBatch], crowd: int = CROWD) -> Iterator[pa.RecordBatch]:
    """Rows (k, fp, check bits) sorted by k -> (k, a, b, d, near, n) for each member that has neighbours in its block: the nearest, its distance, their number, and the block's size. Of a block of over `crowd` members
    all are given, without a nearest one and with its size as their number."""
    for k, fp, *c in _whole(batches):
        size, c = _sizes(k), np.array(c).view(np.uint64).T
        near, best = np.where(size > crowd, size, 0), np.full(len(k), -1)

        def note(i: np.ndarray, j: np.ndarray, d: np.ndarray, near: np.ndarray = near, best: np.ndarray = best, fp: np.ndarray = fp) -> None:
            near += np.bincount(i, minlength=len(near))
            order = np.lexsort((fp[j], d, i))
            first = order[np.r_[True, i[order][1:] != i[order][:-1]]] if len(i) else order
            best[i[first]] = j[first]

        at = np.flatnonzero((size > 1) & (size <= min(SMALL, crowd)))
        i, j, d = _close(k[at], c[at])
        note(at[np.r_[i, j]], at[np.r_[j, i]], np.r_[d, d])
        middle = np.flatnonzero((size > SMALL) & (size <= crowd))
        for block in np.split(middle, np.flatnonzero(np.diff(k[middle])) + 1) if len(middle) else ():
            for part in np.split(block, range(256, len(block), 256)):
                d = sum(np.bitwise_count(c[part, w][:, None] ^ c[block, w][None, :]).astype(np.int64) for w in range(c.shape[1]))
                i, j = (d <= RADIUS).nonzero()
                other = part[i] != block[j]
                note(part[i[other]], block[j[other]], d[i[other], j[other]])
        on = near.nonzero()[0]
        b = best[on]
        none, d = b < 0, np.bitwise_count(c[on] ^ c[b]).sum(axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(fp[on]), pa.array(fp[b], mask=none), pa.array(d, mask=none), pa.array(near[on]), pa.array(size[on])], ["k", "a", "b", "d", "near", "n"])


def _across(similarity: float, nearest: bool):
    """Arrow function over (k, part, fp, root, n, outside, inside, bits) sorted by k and part: pairs (a, b, d) of members of different roots whose check bits (first in bits) are within RADIUS and whose sizes n and parities
    (the rest of bits) let the sets reach the similarity; d is how much of the difference so allowed the parities use. `outside` (0 or 1; -1: not known, and found here) is for members outside the block's commonest
    component, one of which every pair has as a; only members `inside` are b. With `nearest` only the least d of each a is given."""
    share, words, together = (1 - similarity) / (1 + similarity), CHECK // 64, 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part, fp, root, n, outside, inside, bits in _whole(batches, 2):
            bits = bits.view(np.uint64)
            start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (part[1:] != part[:-1])])
            mixed = (np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)).nonzero()[0]
            out = [np.empty((3, 0), np.int64)]
            for s, e in zip(start[mixed].tolist(), np.r_[start[1:], len(k)][mixed].tolist(), strict=True):
                if outside[s] < 0:
                    names, count = np.unique(root[s:e], return_counts=True)
                    x = s + (root[s:e] != names[count.argmax()]).nonzero()[0]
                else:
                    x = s + (outside[s:e] == 1).nonzero()[0]
                y = s + (inside[s:e] == 1).nonzero()[0]
                for some in np.split(x, range(256, len(x), 256)):
                    apart = sum(np.bitwise_count(bits[some, w][:, None] ^ bits[y, w][None, :]).astype(np.int16) for w in range(words))
                    i, j = ((apart <= RADIUS) & (root[some][:, None] != root[y][None, :])).nonzero()
                    i, j = some[i], y[j]
                    most = share * (n[i] + n[j]) + 1e-6
                    fit = abs(n[i] - n[j]) <= most
                    i, j, most = i[fit], j[fit], most[fit]
                    odd = np.concatenate([np.empty(0, np.int64), *(np.bitwise_count(bits[i[at : at + together], words:] ^ bits[j[at : at + together], words:]).sum(axis=1).astype(np.int64) for at in range(0, len(i), together))])
                    fit = odd <= most
                    i, j, d = i[fit], j[fit], (1000 * odd[fit] / most[fit]).astype(np.int64)
                    if nearest and len(i):
                        order = np.lexsort((fp[j], d, i))
                        first = order[np.r_[True, i[order][1:] != i[order][:-1]]]
                        i, j, d = i[first], j[first], d[first]
                    out.append(np.array([fp[i], fp[j], d]))
            a, b, d = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], ["a", "b", "d"])

    return run


def parities(found: np.ndarray) -> np.ndarray:
    """Of each class of hashes whether an odd number is there. Where two sets' parities differ, so do the sets."""
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose fingerprints are within RADIUS and whose sets have at least this Jaccard similarity."""
    hot = {c: hot_values(pairs.groupBy(c).count(), c, "count", least=200) for c in "ab"}
    both = salted_join(pairs, sets.select(F.col("fp").alias("b"), F.col("c").alias("d"), F.col("s").alias("t")), "b", hot["b"], F.col("a"), how="inner")
    both = salted_join(both, sets.select(F.col("fp").alias("a"), "c", "s"), "a", hot["a"], F.col("b"), how="inner")
    both = both.where(sum((F.bit_count(F.col("c")[j].bitwiseXOR(F.col("d")[j])) for j in range(CHECK // 64)), F.lit(0)) <= RADIUS)
    both = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("same"), (F.size("s") + F.size("t")).alias("sizes"))
    return both.where((F.col("sizes") == 0) | (F.try_divide(F.col("same"), F.col("sizes") - F.col("same")) >= similarity)).select("a", "b")


def _row_keys(id_col: Column, text_col: Column) -> dict[str, Column]:
    """What tells rows apart: the id, whether it is null, and the text."""
    return {"__kid": F.coalesce(id_col.cast("string"), F.lit("")), "__nul": id_col.isNull(), "fp": F.xxhash64(F.coalesce(text_col, F.lit("")))}


def _mixed(held: DataFrame, placed: DataFrame, crowd: int) -> DataFrame:
    """The rows that `_across` takes: of the members (k, a, n) with their roots. Crowded blocks go in parts, which members outside the commonest component all meet."""
    rows = held.select("k", F.col("a").alias("fp"), F.col("n").alias("size")).join(placed, "fp")
    of = ["k", "part", "fp", "root", "n", "outside", "inside", "bits"]
    zero, one, unknown = (F.lit(x).cast("int") for x in (0, 1, -1))
    few = rows.where(F.col("size") <= crowd).withColumns({"part": zero, "outside": unknown, "inside": one})
    crowded = rows.where(F.col("size") > crowd)
    main = crowded.groupBy("k", "root").count().groupBy("k").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    hot = hot_values(crowded.groupBy("k").count(), "k", "count")
    crowded = salted_join(crowded, main, "k", hot, F.col("fp"), how="inner").withColumn("outside", (F.col("root") != F.col("main")).cast("int"))
    parts = F.ceil(F.col("size") / crowd)
    own = F.pmod(F.xxhash64("fp"), parts)
    crowded = crowded.withColumn("part", F.explode(F.when(F.col("outside") == 1, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(own))))
    crowded = crowded.withColumns({"inside": (F.col("part") == own).cast("int"), "part": F.col("part").cast("int")})
    return few.select(of).union(crowded.select(of)).repartition("k", "part").sortWithinPartitions("k", "part")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: id, fp), (distinct texts: fp, least id, n), (links' roots: a, root)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(k) for k, c in _row_keys(F.col(id_col), F.col(text_col)).items()])
    width, blocks = layout(docs.count(), similarity)
    words = -(-(CHECK + blocks * width) // 64)
    prints = rows.select("fp", "id", _column(lambda t: print_of(shingles(t, shingle), words), BinaryType())("text").alias("print"))
    reps = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("print").alias("print")), "prints")
    keyed = reps.select("fp", "print").mapInArrow(_blocks(width, blocks, words), "k long, fp long, c0 long, c1 long")
    held = cut(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(lambda batches: _neighbours(batches, crowd), "k long, a long, b long, d long, near long, n long"), "blocks")
    crowded = hot_values(held.groupBy("k").agg(F.count("*").alias("n")), "k", "n", least=200)
    central = held.join(held.groupBy("a").agg(F.sum("near").alias("c")), "a")
    heads = central.groupBy("k").agg(F.max(F.struct("c", "a")).alias("head"))
    shared = salted_join(held.select("k", "a"), heads, "k", crowded, F.col("a"), how="inner")
    by_head = shared.where("a <> head.a").groupBy("a", "head").agg(F.count("*").alias("n")).groupBy("a")
    by_head = by_head.agg(F.array_distinct(F.array(F.max("head").getField("a"), F.max_by("head", F.struct("n", "head")).getField("a"))).alias("b"))
    first = by_head.select("a", F.explode("b").alias("b")).union(held.where("b is not null").groupBy("a").agg(F.min(F.struct("d", "b")).getField("b").alias("b")))
    # One row of each text that has a neighbour or a crowded block; its set is made from the text itself.
    chosen = reps.select("fp", F.coalesce(F.col("least").cast("string"), F.lit("")).alias("__kid"), F.col("least").isNull().alias("__nul"))
    chosen = chosen.join(held.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi")
    texts = rows.select("text", "__kid", "__nul", "fp").join(chosen, ["__kid", "__nul", "fp"], "left_semi")
    check, at = CHECK // 64, (CHECK + PARITY) // 64
    made = texts.select("fp", _column(lambda t: np.r_[long_fingerprint(x := shingles(t, shingle), check).view(np.int64), parities(x), x.view(np.int64)], ArrayType(LongType()))("text").alias("x")).dropDuplicates(["fp"])
    sets = cut(made.select("fp", F.slice("x", 1, check).alias("c"), F.slice("x", 1, at).alias("bits"), F.expr(f"slice(x, {at + 1}, size(x))").alias("s")), "shingles")

    def either(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def placed(root: DataFrame) -> DataFrame:
        return sets.select("fp", F.size("s").cast("long").alias("n"), "bits").join(root.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "n", "bits", F.coalesce("root", "fp").alias("root"))

    tried = cut(either(first), "tried")
    root = components(_near(tried, sets, similarity))
    for nearest in (True, False):
        pairs = _mixed(held, placed(root), crowd).mapInArrow(_across(similarity, nearest), "a long, b long, d long")
        if nearest:
            pairs = pairs.groupBy("a").agg(F.min(F.struct("d", "b")).getField("b").alias("b"))
        pairs = cut(either(pairs).join(tried, ["a", "b"], "left_anti"), "across")
        root = components(root.select("a", F.col("root").alias("b")).union(_near(pairs, sets, similarity)))
        discard(pairs)
    for done in (held, sets, tried):
        discard(done)
    return rows.select("id", "fp"), reps.select("fp", "least", "n"), root


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: id, component_id (the least id that links reach)."""
    prints, reps, root = _grouped(docs, id_col, text_col, shingle, similarity, crowd)
    out = salted_join(prints, named_components(reps, root), "fp", hot_values(reps, "fp", "n"), F.xxhash64("id"))
    return out.select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of each group of near-duplicates the row with the least id, rows without an id last (then that of the least hash of its text); repeats of that row are one."""
    _, reps, root = _grouped(docs, id_col, text_col, shingle, similarity)
    placed = reps.join(root.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    stay = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("__nul"), "least", "fp")).alias("s"))
    stay = stay.select(F.coalesce(F.col("s.least").cast("string"), F.lit("")).alias("__kid"), "s.__nul", "s.fp")
    tagged = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(k) for k, c in _row_keys(F.col(id_col), F.col(text_col)).items()])
    return tagged.dropDuplicates(["__kid", "__nul", "fp"]).join(stay, ["__kid", "__nul", "fp"], "left_semi").select("row.*")
