import random
import re
from itertools import combinations

import xxhash

from veilspark.llm import simhash
from veilspark.llm.components import components


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]) if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints):
    """Least member of each component of pairs within two bits."""
    up = {x: x for x in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in prints}


def test_fingerprints_and_components(docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, f"{brute(r.text):016x}") for r in rows)
    root = roots({int(r.fingerprint, 16) for r in got})
    least = {}
    for r in got:
        if r.doc_id is not None:
            k = root[int(r.fingerprint, 16)]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(root[int(r.fingerprint, 16)]) for r in got)


def test_chunks_do_not_change_a_fingerprint():
    text = " ".join(str(i % 97) for i in range(1000))
    assert simhash.fingerprint(text, chunk=64) == simhash.fingerprint(text)


def test_crowded_blocks_lose_no_link(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(14), rng.randint(0, 5))) for _ in range(900)}
    prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)} | {rng.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    for small in (8, 256):
        found = {r.a: r.root for r in components(simhash.links(df, small=small)).collect()}
        groups = {}
        for x in prints:
            groups.setdefault(found.get(signed(x), signed(x)), set()).add(x)
        want = {}
        for x, r in roots(prints).items():
            want.setdefault(r, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_and_none(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.a: r.root for r in components(path).collect()} == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components(path.limit(0)).count() == 0


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
