"""What each filter removes in each order of a set of filters: a permutation trie, gone through depth first.

A node of the trie is a state, the set of filters applied so far; its survivors are a persisted DataFrame of documents, filtered from those of its parent. Orders that agree on a set share its state: the walk goes
through each unordered set once, so n filters need 2 ** n states for n! orders. At every state the next filters' removals are counted on the survivors themselves, a pass a state, and written to the shared folder.
A lost executor's survivors are filtered anew from the table of verdicts. Counts never reach the driver.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAPS, cut, discard, hot_values, salted_join

_COUNTS = ("n_in", "removed", "good_lost", "toxic_lost")


def repeats(docs: DataFrame, id_col: str, text_col: str, out_col: str, spread: Column) -> DataFrame:
    """docs with whether a row of lesser id has the same text. Null is the empty text; rows without an id come after all with one, and repeats of one id are not less than each other.

    Only texts that occur under two ids at least are joined back, by their digest, salted by `spread` where many rows have them.
    """
    keyed = docs.withColumn("__text", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    count = keyed.groupBy("__text").agg(F.min(id_col).alias("__least"), F.max(F.col(id_col)).alias("__most"), F.max(F.col(id_col).isNull()).alias("__none"), F.count("*").alias("n"))
    # With no id at all, nothing is less.
    several = cut(count.where((F.col("__least") != F.col("__most")) | (F.col("__none") & F.col("__least").isNotNull())), "repeats")
    hot = hot_values(several, "__text", "n")
    out = salted_join(keyed, several.select("__text", "__least"), "__text", hot, spread)
    later = F.col("__least").isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) > F.col("__least")))
    return out.select(*docs.columns, later.alias(out_col))


def marked(docs: DataFrame, labels: DataFrame, id_col: str, marks: list[str], spread: Column) -> DataFrame:
    """docs with each mark: whether a row of labels with this id has it at 1. Rows without an id, or without labels, have none."""
    by_id = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.coalesce(F.max(F.col(m) == 1), F.lit(False)).alias(f"__{m}") for m in marks])
    counts = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"))
    hot = hot_values(counts, id_col, "n")
    # Rows without an id would all go to one task.
    named = salted_join(docs.where(F.col(id_col).isNotNull()), by_id, id_col, hot, spread)
    named = named.select(*docs.columns, *[F.coalesce(f"__{m}", F.lit(False)).alias(m) for m in marks])
    return named.union(docs.where(F.col(id_col).isNull()).select("*", *[F.lit(False).alias(m) for m in marks]))


def _states(verdicts: DataFrame, filters: list[str]) -> list[DataFrame]:
    """For each state but the full one a written table: part, state (bits of the filters applied), next (number of the next filter), and the counts of that edge."""
    seen, out = {0}, []

    def visit(state: int, survivors: DataFrame) -> None:
        open_ = [k for k in range(len(filters)) if not state >> k & 1]
        of = lambda k: [F.count_if(filters[k]), F.count_if(F.col(filters[k]) & F.col("good")), F.count_if(F.col(filters[k]) & F.col("toxic"))]
        counts = survivors.groupBy("part").agg(F.count("*").alias("n_in"), *[F.array(*of(k)).alias(f"f{k}") for k in open_])
        edges = F.explode(F.array(*[F.struct(F.lit(k).alias("next"), F.col(f"f{k}").alias("c")) for k in open_]))
        counts = counts.select("part", F.lit(state).alias("state"), "n_in", edges.alias("e"))
        out.append(cut(counts.select("part", "state", F.col("e.next").alias("next"), "n_in", *[F.col("e.c")[i].alias(c) for i, c in enumerate(_COUNTS[1:])]), "edges"))
        for k in open_:
            child = state | 1 << k
            if child in seen or len(open_) == 1:
                continue
            seen.add(child)
            rows = survivors.where(~F.col(filters[k])).persist()
            visit(child, rows)
            rows.unpersist()

    base = verdicts.persist()
    visit(0, base)
    base.unpersist()
    return out


def audit(docs: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """A row for each part, order of the filters and step, with the counts of documents kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, zeros included.

    filters: name -> whether a document fails (null: it passes); at most 7, since there is a row for every order. Parts without a document have no rows; a null part is "". Every row of docs counts.
    """
    names = list(filters)
    if not 0 < len(names) <= 7:
        raise ValueError("1 to 7 filters")
    columns = [f"f{k}" for k in range(len(names))]
    no = F.lit(False)
    verdicts = cut(docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(good, no).alias("good"), F.coalesce(toxic, no).alias("toxic"), *[F.coalesce(c, no).alias(k) for k, c in zip(columns, filters.values(), strict=True)]), "verdicts")
    tables = _states(verdicts, columns)
    edges = tables[0]
    for more in tables[1:]:
        edges = edges.union(more)
    edges = cut(edges, "trie")
    for done in (verdicts, *tables):
        discard(done)

    orders = list(permutations(range(len(names))))
    steps = [(o, i, sum(1 << k for k in o[:i]), o[i]) for o in orders for i in range(len(names))]
    # At its first step every filter sees all documents; at its last only those that no other fails.
    first = edges.where("state = 0").select("part", "next", F.col("n_in").alias("n_all"), F.col("removed").alias("fails"))
    others = F.array(*[F.lit((1 << len(names)) - 1 - (1 << k)) for k in range(len(names))])
    alone = edges.where(F.col("state") == others[F.col("next")]).select("part", "next", F.col("removed").alias("unique_fails"))
    weight = {}
    for _, _, state, k in steps:
        weight[state, k] = weight.get((state, k), 0) + 1
    times = F.create_map(*[F.lit(x) for (state, k), n in weight.items() for x in (state * 8 + k, n)])
    shapley = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.element_at(times, F.col("state") * 8 + F.col("next"))).alias("shapley"))
    of_filter = first.join(alone, ["part", "next"], "left").join(shapley, ["part", "next"], "left")
    listed = F.array(*[F.struct(F.lit("".join(names[k] for k in o)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(state).alias("state"), F.lit(k).alias("next")) for o, i, state, k in steps])
    rows = first.select("part").distinct().select("part", F.explode(listed).alias("s")).select("part", "s.*")
    joined = rows.join(of_filter, ["part", "next"]).join(edges, ["part", "state", "next"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    removed = count("removed")
    return joined.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (count("n_in") - removed).alias("kept"), removed.alias("removed"), (count("fails") - removed).alias("redundant"), count("unique_fails").alias("unique_fails"),
        count("good_lost").alias("good_lost"), count("toxic_lost").alias("toxic_lost"), count("shapley").alias("shapley"),
    )


def corpus_filters(text: Column, repeat: Column) -> dict[str, Column]:
    """The five conditions of failure: A short, B repetitive, C shouting, D symbols, E a copy of a lesser id's text. Null is the empty text."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, GAPS), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 100, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"), "C": 100 * F.regexp_count(whole, F.lit("[A-Z]")).cast("long") > 10 * F.length(whole).cast("long"),
        "D": F.rlike(whole, F.lit("[#$%&*|]")), "E": repeat,
    }


def audit_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the five filters over documents (doc_id, text, lang) with labels (doc_id, quality, toxic). Texts are read once; what is shuffled is verdicts and digests."""
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    tested = rows.select("doc_id", F.col("lang").alias("part"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), *[c.alias(k) for k, c in corpus_filters(F.col("text"), F.lit(False)).items() if k != "E"])
    # Numbers of rows deal out hot keys even where rows are alike; the table keeps them, so a retried task deals as before.
    tested = cut(tested.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "tests")
    full = marked(repeats(tested, "doc_id", "digest", "E", F.col("deal")), labels.select("doc_id", "quality", "toxic"), "doc_id", ["quality", "toxic"], F.col("deal"))
    return audit(full, {k: F.col(k) for k in "ABCDE"}, F.col("part"), F.col("quality"), F.col("toxic"))
