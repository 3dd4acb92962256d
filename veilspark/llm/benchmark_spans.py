"""Benchmark decontamination by a generalised suffix automaton of the items' words.

Items are cut into blocks of bounded size (a long item into overlapping pieces, which have the same windows); tasks build an automaton a block. It is broadcast, at most BLOCK words of it, and documents stream past it where
they lie: the state tells the longest run of words that ends here and stands in some item, so nothing of the documents is shuffled. A benchmark of more than one block is taken as a query set, block after block.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Every word inside an occurrence of a window is hit.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, lower_ascii
from .pieces import slices

#: A word: ASCII digits and lower-case letters and all that is not ASCII. In UTF-8 every other byte separates.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN = bytes((b | 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: Words of a block's items, and of a piece of an item; blocks that one pass over the documents takes; bytes of text that are split at a time.
BLOCK, PIECE, TOGETHER, PART = 200_000, 20_000, 4, 4 << 20

KIND = "n_words long, first array<int>, upto array<int>, items array<string>, cleaned string"


class Automaton:
    """A generalised suffix automaton over word numbers, with the items of every window.

    step: state * (number of words) + word -> state. owners: first state of a window -> items; short: state -> (length, items) of items shorter than a window; nearest: the state itself, or the nearest suffix with such items.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.word = window, {}
        for _, words in items:
            for w in words:
                self.word.setdefault(w, len(self.word))
        self.step, self.link, self.length = {}, [-1], [0]
        self.moves: list[dict[int, int]] = [{}]
        coded = [(i, [self.word[w] for w in words]) for i, words in items if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self._mark(coded)
        self.step = {s * len(self.word) + w: t for s, moves in enumerate(self.moves) for w, t in moves.items()}
        del self.moves

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.moves.append(moves)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        """The state of (the text of last) + w."""
        met = self.moves[last].get(w)
        if met is not None:
            return self._split(last, w, met)
        new, at = self._new(self.length[last] + 1, {}, 0), last
        while at >= 0 and w not in self.moves[at]:
            self.moves[at][w] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, w, self.moves[at][w])
        return new

    def _split(self, at: int, w: int, to: int) -> int:
        """`to`, or its copy for the texts that are no longer than that of `at` and w."""
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._new(self.length[at] + 1, dict(self.moves[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.moves[at].get(w) == to:
            self.moves[at][w] = copy
            at = self.link[at]
        return copy

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        owners: dict[int, set[str]] = {}
        short: dict[int, tuple[int, set[str]]] = {}
        for item, ids in coded:
            at = 0
            for n, w in enumerate(ids, 1):
                at = self.moves[at][w]
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                if n >= self.window:
                    owners.setdefault(at, set()).add(item)
            if len(ids) < self.window:
                short.setdefault(at, (len(ids), set()))[1].add(item)
        self.owners, self.short = ({k: sorted(v) for k, v in owners.items()}, {k: (n, sorted(v)) for k, (n, v) in short.items()})
        self.least = min([self.window] * bool(owners) + [n for n, _ in short.values()], default=0)
        # By length, so that a suffix comes before what it ends.
        self.full, self.nearest = [0] * len(self.link), [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.full[s] = 0 if self.length[s] < self.window else s if self.length[up] < self.window else self.full[up]
            self.nearest[s] = s if s in short else self.nearest[up]

    def numbers(self, text: bytes) -> np.ndarray:
        """The words' numbers, -1 for those in no item."""
        plain, at, out = text.translate(PLAIN), 0, []
        while at < len(plain):
            end = plain.find(b" ", at + PART)
            end = len(plain) if end < 0 else end
            words = plain[at:end].split()
            out.append(np.fromiter(map(self.word.get, words, [-1] * len(words)), np.int32, len(words)))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def search(self, ids: np.ndarray) -> tuple[list[list[int]], set[str]]:
        """([first, last word] of the hit stretches, in order and apart; the items whose windows occur)."""
        hits, found, seen = [], set(), set()
        edges = np.flatnonzero(np.diff(np.r_[0, (ids >= 0).astype(np.int8), 0]))
        runs = edges.reshape(-1, 2)
        step, link, length, words, window = self.step.get, self.link, self.length, len(self.word), self.window
        # Words in no item end every match, so only runs of the others that can hold a window are gone through.
        for a, b in runs[runs[:, 1] - runs[:, 0] >= self.least].tolist() if self.least else []:
            state = size = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                to = step(state * words + w)
                while to is None:
                    state = link[state]
                    size = length[state]
                    to = step(state * words + w)
                state, size = to, size + 1
                span = 0
                if size >= window:
                    span = size
                    if (full := self.full[state]) not in seen:
                        seen.add(full)
                        found.update(self.owners[full])
                near = self.nearest[state]
                while near:
                    n, items = self.short[near]
                    if n <= size:
                        span = max(span, n)
                        found.update(items)
                    near = self.nearest[link[near]]
                if span:
                    first = i - span + 1
                    while hits and hits[-1][1] >= first - 1:
                        first = min(first, hits.pop()[0])
                    hits.append([first, i])
        return hits, found


def _blocks(items: DataFrame, item_id: str, text_col: str, window: int, block: int, piece: int) -> DataFrame | None:
    """The pickled automata, built by tasks (None without a word); each has about `block` words of distinct (item, piece) rows."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(ITEM_WORD), F.lit(0))
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0).distinct()
    step = max(piece - window + 1, 1)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)), F.lit(step))
    parts = cut(named.select("item", F.posexplode(F.transform(starts, lambda s: F.slice("w", s, step + window - 1))).alias("k", "w")), "items")
    total = parts.agg(F.sum(F.size("w"))).first()[0]
    if not total:
        return None
    n = -(-total // block)

    def build(rows):
        made = Automaton([(r.item, [w.encode() for w in r.w]) for r in rows.itertuples()], window)
        return rows.iloc[:1][["b"]].assign(made=[pickle.dumps(vars(made), 5)])

    dealt = parts.withColumn("b", F.pmod(F.xxhash64("item", "k", "w"), F.lit(n)))
    return cut(dealt.groupBy("b").applyInPandas(build, "b long, made binary"), "automata")


def _without(text: bytes, hits: list[list[int]]) -> bytes:
    """The text without the hit stretches, from a first word's start to a last word's end."""
    spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(PLAIN))]
    out, at = [], 0
    for a, b in hits:
        out.append(text[at : spans[a][0]])
        at = spans[b][1]
    return b"".join([*out, text[at:]])


def _joined(a: list, b: list) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted([*a, *b]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _searcher(shared, clean: bool):
    kind = pa.struct([("n_words", pa.int64()), ("first", pa.list_(pa.int32())), ("upto", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("cleaned", pa.string())])

    @arrow_udf(KIND)
    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = Automaton.__new__(Automaton)
        vars(automaton).update(pickle.loads(shared.value))  # noqa: S301 (built by this module)
        for texts, before in batches:
            out, at = [], 0
            for part in slices(texts, PART) if len(texts) else []:
                for text, old in zip(part, before.slice(at, len(part)), strict=True):
                    raw, old = text.as_py() or b"", old.as_py()
                    ids = automaton.numbers(raw)
                    hits, items = automaton.search(ids)
                    if old:
                        hits, items = _joined(hits, map(list, zip(old["first"], old["upto"], strict=True))), items | set(old["items"])
                    cleaned = _without(raw, hits).decode() if clean and hits else None
                    out.append({"n_words": len(ids), "first": [a for a, _ in hits], "upto": [b for _, b in hits], "items": sorted(items), "cleaned": cleaned})
                at += len(part)
            yield pa.array(out, kind)

    return search


def _found(docs: DataFrame, items: DataFrame, item_id: str, text_col: str, item_text: str, window: int, block: int, piece: int, clean: bool) -> DataFrame:
    """docs as `row`, with `text` and `__m`: what KIND says, of all blocks together (null without any item)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast(f"struct<{KIND.replace(' ', ':').replace(',:', ',')}>").alias("__m"))
    automata = _blocks(items, item_id, item_text, window, block, piece)
    if automata is None:
        return rows
    names = [r["b"] for r in automata.select("b").collect()]
    for k, b in enumerate(names):
        made = automata.where(F.col("b") == b).select("made").first()["made"]
        shared = docs.sparkSession.sparkContext.broadcast(made)
        search = _searcher(shared, clean and k == len(names) - 1)
        rows = rows.withColumn("__m", search(F.col("text").cast("binary"), F.col("__m")))
        if k % TOGETHER == TOGETHER - 1 and k < len(names) - 1:
            rows = cut(rows, "spans")
    return rows


def _n_hit(m: Column) -> Column:
    return F.aggregate(F.zip_with(m["first"], m["upto"], lambda a, b: (b - a + 1).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def matches(
    docs: DataFrame, items: DataFrame, item_id: str = "item_id", text_col: str = "text", item_text: str = "text", window: int = 10, block: int = BLOCK, piece: int = PIECE
) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window), spans (first and last hit word of each stretch, from 0) and items (ids of the items with occurring windows, as strings in order).

    Null and empty texts have no words. Rows of one id are one item, null ids the item "". Every row of docs is one row; columns of these four names are replaced. Without items nothing is hit.
    """
    m = F.col("__m")
    rows = _found(docs, items, item_id, text_col, item_text, window, block, piece, False)
    words = F.size(F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(ITEM_WORD), F.lit(0))).cast("long")
    new = {
        "n_words": F.when(m.isNull(), words).otherwise(m["n_words"]), "n_hit": F.coalesce(_n_hit(m), F.lit(0).cast("long")), "spans": F.coalesce(F.zip_with(m["first"], m["upto"], lambda a, b: F.struct(a.alias("first"), b.alias("upto"))), F.array().cast("array<struct<first:int,upto:int>>")),
        "items": F.coalesce(m["items"], F.array().cast("array<string>")),
    }
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[c.alias(k) for k, c in new.items()])


def decontaminate(
    docs: DataFrame, items: DataFrame, item_id: str = "item_id", text_col: str = "text", item_text: str = "text", window: int = 10, most_covered: float = 0.5, block: int = BLOCK, piece: int = PIECE
) -> DataFrame:
    """docs without the stretches that hold windows; a document of which over `most_covered` of the words are hit goes whole. Null and empty texts stay as they are."""
    m = F.col("__m")
    rows = _found(docs, items, item_id, text_col, item_text, window, block, piece, True)
    stay = rows.where(m.isNull() | (_n_hit(m) <= most_covered * m["n_words"]))
    return stay.select(*[(F.coalesce(m["cleaned"], F.col("row")[c]) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
