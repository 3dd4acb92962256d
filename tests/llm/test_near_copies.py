import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from veilspark.llm import near_copies, simhash

DATA = "/root/testdata/sf0.01"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def roots(texts):
    """Least member of each component of pairs of five-word Jaccard similarity 0.8 or more, and the pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    having, up, pairs = defaultdict(list), {k: k for k in texts}, []

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k in sorted(sets):
        for other, same in Counter(o for s in sets[k] for o in having[s]).items():
            if 10 * same >= 8 * (len(sets[k]) + len(sets[other]) - same):
                pairs.append((other, k))
                a, b = find(other), find(k)
                up[max(a, b)] = min(a, b)
        for s in sets[k]:
            having[s].append(k)
    return {k: find(k) for k in texts}, pairs


def planted():
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(60):  # three replaced words: at most 15 of 196 shingles
        base = say(200)
        texts.append(base)
        near = list(base)
        for at in rng.sample(range(200), 3):
            near[at] = "other"
        texts.append(near)
    crowd, passage = say(300), say(120)
    for i in range(150):  # a large group of near copies
        texts.append([*crowd[: i % 290], f"x{i}", *crowd[i % 290 + 1 :]])
    texts += [passage + say(150) for _ in range(40)]  # a shared passage only
    chain = say(100)
    for i in range(12):  # each near the next one only
        texts.append(chain)
        chain = [*chain[8:], *say(8)]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("data", ["planted", "sf0.01"])
def test_stage_finds_what_brute_force_finds(spark, data):
    if data == "planted":
        texts = planted()
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    else:
        docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
        texts = {r.doc_id: r.text for r in docs.collect()}
    want, pairs = roots(texts)
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs).collect()}
    assert pairs and all(got[a] == got[b] for a, b in pairs)
    assert got == want
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, DATA).collect()) == sorted(k for k, r in want.items() if k == r)


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(2)
    for n, d in ((5, 1), (150, 20), (150, 60), (3000, 900)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.r_[a[d:], rng.integers(0, 1 << 63, d).astype(np.uint64)]
        apart = np.bitwise_count((near_copies.parities(a) ^ near_copies.parities(b)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))
    assert near_copies.parities(np.empty(0, np.uint64)).sum() == 0


def test_a_cloud_round_a_missing_text_is_not_paired_off(spark):
    """Copies of a text that is not there, with one to eight changed words each: groups are those of brute force."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = {}
    for i in range(300):
        t = list(base)
        for at in rng.sample(range(150), 1 + i % 8):
            t[at] = f"z{rng.randrange(300)}"
        texts[i] = " ".join(t)
    want, _ = roots(texts)
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_nulls_repeats_and_empty(spark, docs, empty):
    got = near_copies.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    group = dict.fromkeys(r.component_id for r in got if r.doc_id in {x.doc_id for x in docs.where(F.trim(F.coalesce("text", F.lit(""))) == "").collect()})
    assert len(group) == 1
    assert near_copies.near_duplicates(empty).count() == 0


def test_fingerprint_is_what_most_of_all_shingles_have():
    for n in (1, 2, 7, 255, 256, 700):
        found = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
        votes = [0] * 320
        for h in found.tolist():
            for j in range(5):
                x = h * int(simhash.FACTORS[j]) % (1 << 64)
                x ^= x >> 32
                for i in range(64):
                    votes[64 * j + i] += x >> i & 1
        want = sum((2 * v > n) << i for i, v in enumerate(votes)).to_bytes(40, "little")
        assert near_copies.print_of(found, 5)[:40] == want
        assert simhash.long_fingerprint(found, 2).tobytes() == want[:16]


def test_distance_of_fingerprints_follows_similarity():
    """Sets at 0.8 differ in 0.151 of the bits, and share blocks as often as the layout has it; others are beyond the radius."""
    width, blocks = near_copies.layout(100_000, 0.8)
    words = -(-(near_copies.CHECK + blocks * width) // 64)
    rng, check, shared, far = np.random.default_rng(5), [], [], []
    for _ in range(200):
        h = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
        a, b, c = (np.unpackbits(simhash.long_fingerprint(x, words).view(np.uint8), bitorder="little") for x in (h[:450], h[50:], h[450:]))
        check.append((a != b)[: near_copies.CHECK].sum())
        far.append((a != c)[: near_copies.CHECK].sum())
        shared.append((~(a != b)[near_copies.CHECK :][: blocks * width].reshape(blocks, width).any(axis=1)).sum())
    assert max(check) <= near_copies.RADIUS < min(far) and abs(np.mean(check) / near_copies.CHECK - 0.151) < 0.01
    assert abs(np.mean(shared) + np.log(near_copies.LOSS)) < 0.8


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_blocks_give_the_pairs_within_the_radius(rows):
    rng = random.Random(rows)
    members = sorted((rng.choice([1, 2, 3, 3, 3, 9]), i, rng.getrandbits(63), 0) for i in range(200))
    members = [(k, i, c & 7 if i % 3 else c, d) for k, i, c, d in members]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*members[at : at + rows], strict=True)], list("kfcd")) for at in range(0, len(members), rows)]
    got = [r for b in near_copies._members(iter(batches)) for r in b.to_pylist()]
    size = Counter(k for k, *_ in members)
    assert max(size.values()) > near_copies.SMALL > min(size.values())
    want = {(i, j) for k, i, c, _ in members for m, j, d, _ in members if k == m and i < j and size[k] <= near_copies.SMALL and (c ^ d).bit_count() <= near_copies.RADIUS}
    pairs = [(r["a"], r["b"]) for r in got if r["b"] is not None]
    assert want and sorted(pairs) == sorted(want)
    assert sorted((r["k"], r["a"], r["n"]) for r in got if r["b"] is None) == sorted((k, i, size[k]) for k, i, *_ in members if size[k] > near_copies.SMALL)


def test_texts_of_eight_and_nine_words_are_linked(spark):
    texts = {2 * i + j: " ".join(f"w{i}x{n}" for n in range(8 + j)) for i in range(400) for j in (0, 1)}
    got = near_copies.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in texts}


@pytest.mark.parametrize(("rows", "crowd"), [(1, 4096), (7, 90), (1000, 4096), (1000, 40)])
def test_neighbours_are_those_of_all_pairs(rows, crowd):
    rng = random.Random(rows)
    members = sorted((rng.choice([1, 2, 3, 3, 3, 9]), i, rng.getrandbits(63), 0) for i in range(300))
    members = [(k, i, c & 7 if i % 3 else c, d) for k, i, c, d in members]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*members[at : at + rows], strict=True)], list("kfcd")) for at in range(0, len(members), rows)]
    got = {(r["k"], r["a"]): (r["b"], r["d"], r["near"], r["n"]) for b in near_copies._neighbours(iter(batches), crowd) for r in b.to_pylist()}
    size, want = Counter(k for k, *_ in members), {}
    for k, i, c, _ in members:
        near = sorted(((c ^ e).bit_count(), j) for m, j, e, _ in members if k == m and i != j and (c ^ e).bit_count() <= near_copies.RADIUS)
        if size[k] > crowd:
            want[k, i] = (None, None, size[k], size[k])
        elif near:
            want[k, i] = (near[0][1], near[0][0], len(near), size[k])
    assert got == want and max(size.values()) > near_copies.SMALL > min(size.values())


@pytest.mark.parametrize("crowd", [16, 4096])
def test_pairs_compared_grow_with_the_texts_not_with_their_square(spark, monkeypatch, crowd):
    """A cloud whose blocks are small: its members meet each other in one block or another, but few pairs are rows; groups are those of brute force."""
    rng, compared, near = random.Random(5), [], near_copies._near
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    texts = {}
    for i in range(500):
        t = list(base)
        for at in rng.sample(range(200), 1 + i % 3):
            t[at] = f"z{i}x{at}"
        texts[i] = " ".join(t)
    monkeypatch.setattr(near_copies, "_near", lambda pairs, *a: compared.append(pairs.count()) or near(pairs, *a))
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **({"crowd": crowd} if crowd < 4096 else {})).collect()}
    want, pairs = roots(texts)
    assert got == want and len(pairs) > 10_000
    assert sum(compared) <= 8 * len(texts)


def test_crowded_blocks_in_parts_lose_nothing(spark):
    texts = planted()
    want, _ = roots(texts)
    got = near_copies.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), crowd=10).collect()
    assert {r.doc_id: r.component_id for r in got} == want
