"""Unigram language model whose words rest on a subword lattice, and whose documents on a hidden class.

A token is a word or the end of a text. A document belongs to one of a few classes (the common values of a column of the training
rows, such as the language), which the score does not see: it is the marginal
    P(text) = sum over classes z of P(z) * product of P_z(token).
With counts c_z of N_z training tokens and V_z distinct words in class z, and a discount D_z from the counts of counts,
    P_z(word) = (max(c_z - D_z, 0) + (D_z * V_z + 1) * P_all(word)) / (N_z + 1.5),   P_z(end) = (c_z(end) + 0.5) / (N_z + 1.5),
P_all the same over all classes' words with the lattice below it,
    P_all(word) = (max(c - D, 0) + (D * V + 1) * P_lattice(word)) / (words + 1).
So a word has arcs for itself, where training rows have it, and for all its segmentations into pieces of a public vocabulary, and its probability is the sum of all. P_lattice is the marginal over the
segmentations, by a forward recursion in log space. Piece weights start from that vocabulary's own scores; under them each piece's expected count over all segmentations of the distinct training words is taken by
forward and backward sums, and the scores' weights are added as PRIOR of the counts' sum. Characters outside the vocabulary are spelt in its byte pieces.

Counting, piece statistics and word scores are distributed by word. Scoring reads the text once: the HEAD commonest words are
broadcast (a bounded number of words and bytes); the others are joined by word, with salt for the few that are frequent and too long for the head.

Defined results: null and empty texts are one end token; rows with equal ids are scored each for itself; a null id trains; a null class counts as a class, and
classes of less than CLASS_SHARE of the training rows count as one; without training rows words are the lattice's alone; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join

END = b"\n"
HEAD, HEAD_BYTES, FLUSH, TOGETHER = 250_000, 16 << 20, 400_000, 20_000
#: What the vocabulary's own scores weigh beside expected counts; the least share of rows that makes a class of its own.
PRIOR, CLASS_SHARE = 0.25, 0.02
MARK = "▁"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_out, z, text) -> (word, z, c): training counts by class, and 0 for words met in held-out rows only."""
    seen: dict[int, Counter] = defaultdict(Counter)
    held: set = set()

    def flush() -> pa.RecordBatch:
        rest = [w for w in held if not any(w in c for c in seen.values())]
        words, zs, cs = rest, [0] * len(rest), [0] * len(rest)
        for z, c in seen.items():
            words += c
            zs += repeat(z, len(c))
            cs += c.values()
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(zs, pa.int32()), pa.array(cs, pa.int64())], ["word", "z", "c"])
        seen.clear()
        held.clear()
        return out

    for b in batches:
        for out, z, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            tokens = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split()
            if out:
                held.update(tokens)
                held.add(END)
            else:
                seen[z].update(tokens)
                seen[z][END] += 1
            if sum(map(len, seen.values())) + len(held) > FLUSH:
                yield flush()
    yield flush()


class Lattice:
    """Weights of a vocabulary's pieces over words, each written as a mark and its characters. A word is a piece that begins with the mark and pieces inside words, then the stop:
    the next piece would begin with a mark. Characters that are no piece are spelt in byte pieces. All words of a batch are treated together, node by node from their beginnings."""

    def __init__(self, pieces: list[tuple[int, str]], log_p: np.ndarray, raw: np.ndarray, raw_ids: np.ndarray, stop: float) -> None:
        import ahocorasick

        self.log_p, self.raw, self.raw_ids, self.stop = log_p, raw, raw_ids, stop
        self.find = ahocorasick.Automaton()
        self.length = np.zeros(len(log_p), np.int64)
        for i, text in pieces:
            self.find.add_word(text, i)
            self.length[i] = len(text)
        self.find.make_automaton()

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(start, end, piece, log weight) of every arc, with -1 - code point for spelt characters; each node's distance from its word's beginning; first and last nodes."""
        text = "\n".join([MARK + w.replace(MARK, "\uffff").replace("\n", "\uffff") for w in words]) + "\n"
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1
        last = np.cumsum(n + 1) - 1
        first = last - n
        found = np.array(list(self.find.iter(text)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        start = end - self.length[piece]
        inner = np.ones(len(text), bool)
        inner[first] = inner[last] = False
        inner[start[self.length[piece] == 1]] = False
        spelt = inner.nonzero()[0]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[spelt].astype(np.int64)
        distinct, back = np.unique(codes, return_inverse=True)
        spell = np.array([self.raw[list(chr(c).encode("utf-8", "surrogatepass"))].sum() for c in distinct.tolist()], float)
        start, end = np.r_[start, spelt], np.r_[end, spelt + 1]
        weight = np.r_[self.log_p[piece], spell[back] if len(back) else np.empty(0)]
        return start, end, np.r_[piece, -1 - codes], weight, np.arange(len(text) + 1) - np.repeat(np.r_[first, last[-1] + 1], np.r_[n + 1, 1]), first, last

    @staticmethod
    def _sums(into: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        """into[end] = log of the sum of exp(into[start] + weight), in ascending order of step[end]."""
        order = np.lexsort((end, step[end]))
        start, end, weight = start[order], end[order], weight[order]
        steps = step[end]
        new = np.r_[True, end[1:] != end[:-1]].nonzero()[0] if len(end) else np.empty(0, np.int64)
        bounds = np.r_[np.r_[True, steps[1:] != steps[:-1]].nonzero()[0], len(end)] if len(end) else np.zeros(1, np.int64)
        at = np.searchsorted(new, bounds)
        for k in range(len(bounds) - 1):
            a, b = bounds[k], bounds[k + 1]
            heads = new[at[k] : at[k + 1]]
            into[end[heads]] = np.logaddexp.reduceat(into[start[a:b]] + weight[a:b], heads - a)

    def log_probs(self, words: list[str]) -> np.ndarray:
        """The marginal log probability of each word over all its segmentations."""
        if not words:
            return np.empty(0)
        start, end, _, weight, step, first, last = self.arcs(words)
        alpha = np.full(len(step), -np.inf)
        alpha[first] = 0.0
        self._sums(alpha, start, end, weight, step)
        return alpha[last] + self.stop

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece is expected in the words' segmentations, by forward and backward sums."""
        out = np.zeros(len(self.log_p))
        if not words:
            return out
        start, end, piece, weight, step, first, last = self.arcs(words)
        alpha, beta = np.full(len(step), -np.inf), np.full(len(step), -np.inf)
        alpha[first], beta[last] = 0.0, 0.0
        self._sums(alpha, start, end, weight, step)
        self._sums(beta, end, start, weight, -step)
        total = np.repeat(alpha[last], last - first + 1)
        share = np.exp(alpha[start] + weight + beta[end] - np.r_[total, 0.0][start])
        known = piece >= 0
        out += np.bincount(piece[known], share[known], len(out))
        spelt, back = np.unique(-1 - piece[~known], return_inverse=True)
        for code, n in zip(spelt.tolist(), np.bincount(back, share[~known], len(spelt)), strict=True):
            np.add.at(out, self.raw_ids[list(chr(code).encode("utf-8", "surrogatepass"))], n)
        return out


def _vocabulary(model: bytes) -> tuple[list[tuple[int, str]], np.ndarray, np.ndarray]:
    """Of a sentencepiece model: the pieces (number, text), the weight that its scores give each number, and the numbers of the 256 byte pieces.
    Scores fall by one a rank, so a piece weighs 1 / (10 - score); byte pieces weigh a thousandth of the whole together."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = sp.get_piece_size()
    pieces, weight, raw = [], np.zeros(size + 1), np.zeros(256, np.int64)
    for i in range(size):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            raw[int(text[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or MARK in text[1:]):
            pieces.append((i, text))
            weight[i] = 1.0 / (10.0 - sp.get_score(i))
    if MARK not in {t for _, t in pieces}:  # a word's bare beginning is always there
        pieces.append((size, MARK))
        weight[size] = weight.min(initial=1e-3, where=weight > 0)
    weight /= weight.sum()
    weight[raw] = 1e-3 / 256
    return pieces, weight / weight.sum(), raw


def build_lattice(model: bytes, counts: dict[int, float] | None = None) -> Lattice:
    """Pieces weigh what the vocabulary's scores say, or, with expected counts from a corpus, those with the scores' weights added as PRIOR of their sum."""
    pieces, weight, raw = _vocabulary(model)
    if counts:
        seen = np.zeros(len(weight))
        seen[list(counts)] = list(counts.values())
        weight = seen / seen.sum() + PRIOR * weight
    begins = np.array([i for i, t in pieces if t[0] == MARK])
    with np.errstate(divide="ignore"):
        log_p = np.log(weight / weight.sum())
        log_p[begins] = np.log(weight[begins] / weight[begins].sum())
    return Lattice(pieces, log_p, log_p[raw], raw, math.log(weight[begins].sum() / weight.sum()))


def score(docs: DataFrame, model_path: str, held_out, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", head: int = HEAD) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). held_out: a condition on docs; such rows train nothing."""
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    kind = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col else F.lit("")
    rows = docs.select(F.coalesce(held_out, F.lit(False)).alias("held_out"), kind.alias("kind"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = rows.where(~F.col("held_out")).groupBy("kind").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    named = [r["kind"] for r in sizes.where(F.col("count") >= max(1, total * CLASS_SHARE)).orderBy(F.desc("count"), "kind").collect()]  # 1 / CLASS_SHARE of them at most
    n_class = len(named) + 1  # the last one is for all others
    z = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(named)], F.lit(n_class - 1))
    by_class = [F.sum(F.when(F.col("z") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(n_class)]
    found = rows.select("held_out", z.alias("z"), "text").mapInArrow(_counts, "word binary, z int, c long")
    counts = cut(found.groupBy("word").agg(F.sum("c").alias("c"), *by_class), "lmcounts")
    is_word = F.col("word") != F.lit(END)
    columns = ["c", *[f"c{i}" for i in range(n_class)]]
    stats = counts.agg(
        F.count_if(F.col("c") > 0).alias("v"),
        *[a.alias(f"{k}_{x}") for k in columns for x, a in (
            ("n", F.coalesce(F.sum(k), F.lit(0))), ("end", F.coalesce(F.sum(F.when(~is_word, F.col(k))), F.lit(0))), ("v", F.count_if((F.col(k) > 0) & is_word)),
            ("n1", F.count_if((F.col(k) == 1) & is_word)), ("n2", F.count_if((F.col(k) == 2) & is_word)))],
    ).first().asDict()
    n, v = stats["c_n"], stats["v"]
    d = {k: min(0.95, max(0.1, stats[f"{k}_n1"] / max(1, stats[f"{k}_n1"] + 2 * stats[f"{k}_n2"]))) for k in columns}
    n_z, end_z, d_z = (np.array([f(k) for k in columns[1:]], float) for f in (lambda k: stats[f"{k}_n"], lambda k: stats[f"{k}_end"], d.get))
    share_z = np.log((d_z * np.array([stats[f"{k}_v"] for k in columns[1:]]) + 1) / (n_z + 1.5))
    share = math.log((d["c"] * stats["c_v"] + 1) / (n - stats["c_end"] + 1))
    prior = np.log((end_z + 1e-9) / (end_z + 1e-9).sum())  # the end's count is the number of documents

    def piece_counts(batches):
        start = build_lattice(model.value)
        total = np.zeros(len(start.log_p))
        for b in batches:
            words = [w.decode("utf-8", "replace") for w in b.column(0).to_pylist()]
            for at in range(0, len(words), TOGETHER):
                total += start.expected(words[at : at + TOGETHER])
        micro = np.rint(total * 1e6).astype(np.int64)  # whole numbers add up alike in any order
        at = micro.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(micro[at])], ["piece", "n"])

    pieces = counts.where((F.col("c") > 0) & is_word).select("word").mapInArrow(piece_counts, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    learned = {r[0]: r[1] / 1e6 for r in pieces.collect()}  # at most a row for each piece

    def word_scores(batches):
        lattice = build_lattice(model.value, learned)
        for b in batches:
            words = b.column(0).to_pylist()
            texts = ["" if w == END else w.decode("utf-8", "replace") for w in words]
            c = np.array([np.asarray(b.column(i)) for i in range(1, n_class + 2)], float)
            with np.errstate(divide="ignore"):
                known = np.log(np.maximum(c[0] - d["c"], 0) / (n - stats["c_end"] + 1))
                sub = np.concatenate([np.empty(0), *[lattice.log_probs(texts[at : at + TOGETHER]) for at in range(0, len(texts), TOGETHER)]])
                whole = np.logaddexp(known, share + sub)
                out = np.logaddexp(np.log(np.maximum(c[1:].T - d_z, 0) / (n_z + 1.5)), share_z + whole[:, None])
            ends = np.array([w == END for w in words], bool)
            out[ends] = np.log((end_z + 0.5) / (n_z + 1.5))
            base = np.log10((c[0] + 1) / (n + v + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base), *[pa.array(np.ascontiguousarray(x)) for x in out.T]], names_w)

    lps = [f"p{i}" for i in range(n_class)]
    names_w = ["word", "c", "base", *lps]
    scored = cut(counts.select("word", *columns).mapInArrow(word_scores, f"word binary, c long, base double, {', '.join(f'{p} double' for p in lps)}"), "lmwords")
    # The head: words whose count is at least the least power of 2**(1/8) that no more than `head` words, of HEAD_BYTES in all, reach.
    known = scored.where(F.col("c") > 0)
    level = F.floor(F.log2("c") * 8)
    levels = sorted(known.groupBy(level.alias("level")).agg(F.count("*"), F.sum(F.length("word"))).collect(), reverse=True)
    least, have, size = 1 << 62, 0, 0
    for lv, k, long in levels:
        have, size = have + k, size + long
        if have > head or size > HEAD_BYTES:
            break
        least = lv
    top = known.where((level >= least) & is_word).toArrow()
    names = top.column("word").to_pylist()
    table = np.array([np.r_[top.column(k).to_numpy(), 0] for k in ("base", *lps)]).T
    known_of = np.r_[np.ones(len(names), np.int64), 0]
    end = np.r_[math.log10((stats["c_end"] + 1) / (n + v + 1)), np.log((end_z + 0.5) / (n_z + 1.5))]
    shared = spark.sparkContext.broadcast((names, table, known_of, end, int(stats["c_end"] > 0)))
    fields = ["row", "id", "held_out", "n_tokens", "n_known", "base", *lps, "word", "tf"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * (n_class + 1), pa.binary(), pa.int64()]

    def text_scores(batches):
        from pyspark import TaskContext

        words, table, known_of, end, end_known = shared.value
        find, last = {w: i for i, w in enumerate(words)}.get, len(words)
        row = TaskContext.get().partitionId() << 36
        out: list[list] = [[] for _ in fields]
        for b in batches:
            for held, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                tokens = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower().split()
                at = np.fromiter(map(find, tokens, repeat(last)), np.int64, len(tokens))
                row += 1
                total = table[at].sum(axis=0) + end
                one = (row, key, held, len(tokens) + 1, int(known_of[at].sum()) + end_known, *total.tolist(), None, None)
                for x, y in zip(out, one, strict=True):
                    x.append(y)
                tail = Counter([tokens[i] for i in np.flatnonzero(at == last)])
                out[0] += [row] * len(tail)
                for x in out[1:-2]:
                    x += [None] * len(tail)
                out[-2] += tail
                out[-1] += tail.values()
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], fields)
                    out = [[] for _ in fields]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], fields)

    schema = f"row long, id long, held_out boolean, n_tokens long, n_known long, base double, {', '.join(f'{p} double' for p in lps)}, word binary, tf long"
    both = cut(rows.select("held_out", "id", "text").mapInArrow(text_scores, schema), "lmtexts")
    sums = ["n_known", "base", *lps]
    hot = [bytes(r[0]) for r in known.where((level < least) & is_word & (F.col("c") > max(1000, n * 0.0005))).select("word").collect()]  # frequent, but too long for the head; 2000 at most
    tail = salted_join(both.where("word is not null").select("row", "word", "tf"), scored, "word", hot, F.col("row"), how="inner")
    tail = tail.select("row", F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0)).alias("n_known"), *[(F.col("tf") * F.col(k)).alias(k) for k in sums[1:]])
    rest = tail.groupBy("row").agg(*[F.lit(None).alias(k) for k in ("id", "held_out", "n_tokens")], *[F.sum(k).alias(k) for k in sums])
    every = both.where("word is null").select("row", "id", "held_out", "n_tokens", *sums).unionByName(rest)
    out = every.groupBy("row").agg(*[F.max(k).alias(k) for k in ("id", "held_out", "n_tokens")], *[F.sum(k).alias(k) for k in sums])
    # The marginal over classes, by log-sum-exp.
    terms = [F.col(p) + F.lit(float(x)) for p, x in zip(lps, prior, strict=True)]
    most = F.greatest(*terms) if len(terms) > 1 else terms[0]
    out = out.withColumn("most", most).withColumn("lp", F.col("most") + F.log(sum((F.exp(t - F.col("most")) for t in terms), F.lit(0.0))))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("lp") / math.log(10)).alias("score"))
