import re
from collections import Counter

from veilspark.llm import mixing


def brute_targets(sizes):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(keys)
    while open_:
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if weight[k] * level > 2 * sizes[k]}
        if not full:
            return out | {k: weight[k] * level for k in open_}
        for k in full:
            out[k] = 2.0 * sizes[k]
            left -= out[k]
        open_ -= full
    return out


def test_targets_and_taken(docs):
    rows = mixing.mix(docs).collect()
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    want = brute_targets(sizes)
    assert len(rows) == docs.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_repeated_rows_are_the_mix(docs):
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in mixing.mix(docs).collect():
        if r.size:
            taken[r.doc_id] += r.taken // r.size
    got = Counter(r.doc_id for r in out.collect() if (r.text or "").split())
    assert got == +taken


def test_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.repeat_rows(empty).count() == 0
