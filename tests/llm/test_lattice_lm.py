import math
import zlib
from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F

from veilspark.llm import lattice_lm

MODEL = P.path("piece_bpe_32k.model")


def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def test_base_score_and_counts(docs):
    got = lattice_lm.score(docs, MODEL, held(), head=20).collect()
    split = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in docs.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in split if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(t), sum(w in c for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in split)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.held_out == out(r.doc_id) and r.score < 0 and math.isfinite(r.score) for r in got)
    again = lattice_lm.score(docs, MODEL, held(), head=10_000).collect()
    assert sorted(round(r.score, 6) for r in again) == sorted(round(r.score, 6) for r in got)


def segmentations(word, lat, texts):
    """(probability, pieces) of every segmentation of a word, by recursion."""
    inner, out = {t: i for i, t in texts if t[0] != "▁"}, []

    def walk(at, p, used):
        if at == len(word):
            out.append((p * math.exp(lat.stop), used))
            return
        for upto in range(at + 1, len(word) + 1):
            i = inner.get(word[at:upto])
            if i is not None:
                walk(upto, p * math.exp(lat.log_p[i]), [*used, i])
        if word[at] not in inner:
            ids = [int(lat.raw_ids[b]) for b in word[at].encode()]
            walk(at + 1, p * math.prod(math.exp(lat.raw[b]) for b in word[at].encode()), [*used, *ids])

    for i, t in texts:
        if t[0] == "▁" and word.startswith(t[1:]):
            walk(len(t) - 1, math.exp(lat.log_p[i]), [i])
    return out


WORDS = ["the", "thanedble", "über", "a", "漢字x", "zzq", "\U0001f642é", "ing", "x" * 9, "the"]


def test_lattice_is_the_sum_of_all_segmentations():
    model = open(MODEL, "rb").read()
    texts, _, _ = lattice_lm._vocabulary(model)
    for counts in (None, {i: 3.0 + i % 5 for i in range(300, 20_000, 7)}):
        lat = lattice_lm.build_lattice(model, counts)
        every = [segmentations(w, lat, texts) for w in WORDS]
        assert all(math.isclose(math.exp(x), sum(p for p, _ in e), rel_tol=1e-9) for x, e in zip(lat.log_probs(WORDS), every, strict=True))
        want = Counter()
        for e in every:
            for p, used in e:
                for i in used:
                    want[i] += p / sum(q for q, _ in e)
        got = lat.expected(WORDS)
        assert all(math.isclose(got[i], n, rel_tol=1e-6, abs_tol=1e-12) for i, n in want.items()) and math.isclose(got.sum(), sum(want.values()))
    assert len(lat.log_probs([])) == 0 and lat.expected([]).sum() == 0
    assert all(math.isfinite(x) for x in lat.log_probs(["a▁b", "a\nb", "w" * 30_000, ""]))


def test_piece_weights_sum_to_one():
    model = open(MODEL, "rb").read()
    texts, weight, _ = lattice_lm._vocabulary(model)
    assert math.isclose(weight.sum(), 1)
    for counts in (None, {300: 5, 1000: 7}):
        lat = lattice_lm.build_lattice(model, counts)
        first = {i for i, t in texts if t[0] == "▁"}
        p = [math.exp(x) for x in lat.log_p]
        assert abs(sum(p[i] for i in first) - 1) < 1e-9
        assert abs(sum(x for i, x in enumerate(p) if i not in first) + math.exp(lat.stop) - 1) < 1e-9


def test_the_vocabularys_scores_count():
    """Beside expected counts the scores hold PRIOR of the weight: a piece that no training word has keeps its share."""
    model = open(MODEL, "rb").read()
    _, weight, _ = lattice_lm._vocabulary(model)
    lat = lattice_lm.build_lattice(model, {1000: 100.0})
    unseen, share = next(i for i in range(2000, 3000) if weight[i] > 0 and not math.isclose(lat.log_p[i], 0)), lattice_lm.PRIOR / (1 + lattice_lm.PRIOR)
    assert math.exp(lat.log_p[unseen]) >= 0.99 * share * weight[unseen]


def test_no_training_rows_and_empty(docs, empty):
    r = lattice_lm.score(docs.limit(5), MODEL, F.lit(True)).collect()
    assert len(r) == 5 and all(x.train_tokens == 0 and x.n_known == 0 and math.isfinite(x.score) for x in r)
    assert lattice_lm.score(empty, MODEL, held()).count() == 0


def test_score_is_the_documented_marginal(docs):
    rows = [((r.text or "").encode().lower().split(), r.lang or "", r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs.collect()]
    classes = sorted({k for _, k, out in rows if not out})
    c_z = {k: Counter(w for t, x, out in rows if not out and x == k for w in t) for k in classes}
    ends = {k: sum(not out and x == k for _, x, out in rows) for k in classes}
    c = sum(c_z.values(), Counter())
    model, seen = open(MODEL, "rb").read(), [w.decode() for w in c]
    lat = lattice_lm.build_lattice(model, dict(enumerate(lattice_lm.build_lattice(model).expected(seen))))
    every = sorted({w for t, *_ in rows for w in t})
    lattice = dict(zip(every, lat.log_probs([w.decode() for w in every]), strict=True))
    n1 = lambda x, k: sum(v == k for v in x.values())
    d = lambda x: min(0.95, max(0.1, n1(x, 1) / max(1, n1(x, 1) + 2 * n1(x, 2))))

    def p(z, w):
        whole = (max(c[w] - d(c), 0) + (d(c) * len(c) + 1) * math.exp(lattice[w])) / (sum(c.values()) + 1)
        return (max(c_z[z][w] - d(c_z[z]), 0) + (d(c_z[z]) * len(c_z[z]) + 1) * whole) / (sum(c_z[z].values()) + ends[z] + 1.5)

    memo = {(z, w): math.log(p(z, w)) for w in {w for t, *_ in rows if len(t) < 300 for w in t} for z in classes}
    want = []
    for t, *_ in rows:
        if len(t) < 300:
            terms = [math.log(ends[z] / sum(ends.values())) + math.log((ends[z] + 0.5) / (sum(c_z[z].values()) + ends[z] + 1.5)) + sum(memo[z, w] for w in t) for z in classes]
            want.append(round((max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms))) / math.log(10), 5))
    got = [round(r.score, 5) for r in lattice_lm.score(docs, MODEL, held()).collect() if r.n_tokens <= 300]
    assert all(abs(a - b) < 1e-4 for a, b in zip(sorted(got), sorted(want), strict=True))
