import hashlib
import random
import re

import duckdb
import pytest

from veilspark.llm import benchmark_spans, queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    """(n_words, hit positions, item ids), by comparing every window with every place."""
    w, hit, found = words(text), set(), set()
    for item, other in items:
        x = words(other)
        n = min(window, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(w), hit, sorted(found)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    d = "/root/testdata/sf0.01"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    rel = con.sql(queries.OP12)
    df = queries.op12_benchmark_spans(spark, d)
    assert df.columns == rel.columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rel.fetchall()))


def fixture():
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "ab", "ü1", "漢字"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(1, 40))) for i in range(30) if i % 4] + [(100, "one Two"), (101, "two"), (102, "x y z one two three four five six seven"), (103, ""), (104, None), (105, "!!!"), (None, "no id here, at all"), (100, "second text of it")]
    items += [(102, "x y z one two three four five six seven")] * 2
    texts = [say(rng.randint(0, 80)) for _ in range(60)] + [t for _, t in items] + ["ONE-two;three", "no\x00id\x00here at\nall", "K" * 50, "é" * 9, "x y z one two three four five six", "pre x Y z one two three four five six seven post " * 3]
    return [(i, t) for i, t in enumerate(texts)], items


@pytest.mark.parametrize("block,piece", [(200_000, 20_000), (60, 12)])
def test_fixture_equals_brute_force(spark, block, piece):
    texts, items = fixture()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in [*texts, texts[3]]], "doc_id long, text string, row string, n_words int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, word int").repartition(3)
    rows = benchmark_spans.matches(docs, bench, block=block, piece=piece).collect()
    assert len(rows) == len(texts) + 1 and set(rows[0].asDict()) == {"doc_id", "text", "row", "n_words", "n_hit", "spans", "items"}
    for r in rows:
        n, hit, found = brute(r.text, items)
        assert (r.n_words, r.n_hit, list(r["items"])) == (n, len(hit), found), r.text
        assert {p for s in r.spans for p in range(s["first"], s["upto"] + 1)} == hit
        assert all(a["upto"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_spans_and_covered_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before, {item.upper()}! After it there is more of the text, as much as it takes to stay in.", item, "nothing to see", None, "", f"{item} and {item}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    out = {r.doc_id: r.text for r in benchmark_spans.decontaminate(docs, bench).collect()}
    assert out == {0: "Before, ! After it there is more of the text, as much as it takes to stay in.", 2: "nothing to see", 3: None, 4: ""}
    assert benchmark_spans.decontaminate(docs, bench, most_covered=1.0).count() == 6
    assert {r.doc_id: r.text for r in benchmark_spans.decontaminate(docs, bench.limit(0)).collect()} == dict(enumerate(texts))


def test_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "same line other")], "item_id long, text string")
    assert benchmark_spans.matches(empty, bench).count() == 0
    none = benchmark_spans.matches(docs, bench.limit(0)).collect()
    assert len(none) == docs.count() and all(r.n_hit == 0 and r["items"] == [] and r.n_words == len(words(r.text)) for r in none)
    some = {r.doc_id: r for r in benchmark_spans.matches(docs, bench).collect()}
    assert all((r.n_words, r.n_hit) == (brute(r.text, [(1, "same line other")])[0], len(brute(r.text, [(1, "same line other")])[1])) for r in some.values())
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(9)
    items = [(str(i), [rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 30))]) for i in range(12)]
    made = benchmark_spans.Automaton(items, 5)
    text = [rng.choice([b"a", b"b"]) for _ in range(400)]
    hits, found = made.search(made.numbers(b" ".join(text)))
    want = [brute(" ".join(x.decode() for x in text), [(i, b" ".join(w).decode()) for i, w in items], 5)]
    assert {p for a, b in hits for p in range(a, b + 1)} == want[0][1] and sorted(found) == want[0][2]
