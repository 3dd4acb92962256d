import random

from veilspark.operators import lineage

KIND = "node_id string, record_id string, parent_ids array<string>, seq long"


def brute(rows):
    """{(node, ancestor): least distance}, by walking from every node; parents that are no nodes count as ancestors."""
    parents = {n: p or [] for n, _, p, _ in rows}
    out = {}
    for n in parents:
        level, d = {n}, 0
        while level:
            for x in level:
                out.setdefault((n, x), d)
            level, d = {p for x in level for p in parents.get(x, []) if (n, p) not in out}, d + 1
    return out


def found(df):
    return {(r.node_id, r.ancestor_id): r.distance for r in df.collect()}


def test_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows, by_record = [], {}
        for k in range(60):
            record = f"r{rng.randint(0, 7)}"
            old = [r[0] for r in rows]
            given = [None, [], [rng.choice(old)], rng.sample(old, min(3, len(old))) * 2, ["gone", rng.choice(old)]][rng.choice([0, 0, 0, 1, 2, 3, 4])] if old else None
            before = by_record.get(record)
            rows.append((f"n{k}", record, given or ([before] if before else []), k))
            by_record[record] = f"n{k}"
        nodes = spark.createDataFrame(rows, KIND)
        of = lineage.labels(nodes)
        want = brute(rows)
        assert found(lineage.trace_all(nodes)) == want
        for n in ("n59", "n30"):
            assert {r.ancestor_id: r.distance for r in lineage.ancestors(of, n).collect()} == {a: d for (m, a), d in want.items() if m == n}


def test_chains_have_labels_as_many_as_nodes(spark):
    rows = [(f"{r}-{k}", f"r{r}", [f"{r}-{k - 1}"] if k else [], k) for r in range(5) for k in range(200)]
    of = lineage.labels(spark.createDataFrame(rows, KIND))
    assert of.places.count() == 1000 and of.jumps.count() == 0
    assert lineage.ancestors(of, "3-199").count() == 200


def test_shortcuts_and_empty(spark):
    rows = [("a", "r", [], 0), ("b", "r", ["a"], 1), ("c", "r", ["b"], 2), ("d", "r", ["c", "a"], 3), ("e", "s", ["d", "b"], 0)]
    got = found(lineage.trace_all(spark.createDataFrame(rows, KIND)))
    assert got == brute(rows) and (got["d", "a"], got["e", "a"]) == (1, 2)
    assert lineage.trace_all(spark.createDataFrame([], KIND)).count() == 0
