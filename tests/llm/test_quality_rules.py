import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veilspark.llm import quality_rules


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    cover = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_counts(docs):
    got = quality_rules.judge(docs).collect()
    want = sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_thresholds_follow_the_group(spark):
    clean = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    wordy = lambda i: " ".join(f"{'long' * 6}{i}x{j}" for j in range(80))
    rows = [(i, clean(i), "en", "a") for i in range(300)] + [(1000 + i, wordy(i), "de", "b") for i in range(300)] + [(2000, wordy(7), "en", "a"), (2001, "#* " + " #".join(clean(9).split()), "en", "a")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sorted(i for i in got if not got[i]) == [2000, 2001]


def test_small_groups_lean_on_their_own_rows_too(spark):
    """Thirty rows of a source are enough to move its fence; the same text is kept there and not elsewhere."""
    short = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    wordy = lambda i: " ".join(f"{'long' * 6}{i}x{j}" for j in range(80))
    rows = [(i, short(i), "en", "a") for i in range(300)] + [(1000 + i, wordy(i), "en", "b") for i in range(60)] + [(2000, wordy(99), "en", "a"), (2001, wordy(99), "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert not got[2000] and got[2001]
    m = quality_rules.measures(df, "doc_id", "text", "lang", "source").withColumn("lk", F.col("lang")).withColumn("key", F.col("source"))
    limits = {r.key: r for r in quality_rules.thresholds(m).collect()}
    assert limits["b"].f_m_length > limits["a"].f_m_length + 5


def brute_fences(values, prior, reach, spread):
    """values: (lang, source, value) -> fence by lang and source; sketches as lists of exact bucket values."""
    bucket = lambda v: -10_000 if v <= 1e-9 else math.ceil(math.log(v) / math.log(quality_rules.GROWTH))
    back = lambda b: 0.0 if b == -10_000 else quality_rules.GROWTH ** (b - 0.5)
    share = lambda c: {b: n / sum(c.values()) for b, n in c.items()}
    mix = lambda c, above: {b: (c.get(b, 0) + prior * s) / (sum(c.values()) + prior) for b, s in above.items()}
    every = share(Counter(bucket(v) for *_, v in values))
    langs = {lang: mix(Counter(bucket(v) for x, _, v in values if x == lang), every) for lang in {x for x, *_ in values}}
    out = {}
    for key in {v[:2] for v in values}:
        s, upto, q = mix(Counter(bucket(v) for *k, v in values if tuple(k) == key), langs[key[0]]), 0.0, {}
        for b in sorted(s):
            upto += s[b]
            for level in (0.25, 0.5):
                if upto >= level - 1e-9:
                    q.setdefault(level, back(b))
        out[key] = q[0.5] + reach * (q[0.5] - q[0.25]) + spread
    return out


def test_fences_as_brute_force(docs):
    m = quality_rules.measures(docs, "doc_id", "text", "lang", "source").withColumn("lk", F.coalesce("lang", F.lit("?"))).withColumn("key", F.concat_ws("/", "lk", F.coalesce("source", F.lit("?"))))
    rows = m.collect()
    got = {r.key: r for r in quality_rules.thresholds(m).collect()}
    for name, spread in quality_rules.SPREAD.items():
        want = brute_fences([(r.lk, r.key, r[name]) for r in rows], quality_rules.PRIOR, quality_rules.REACH, spread)
        assert got.keys() == {k for _, k in want}
        assert all(abs(got[k][f"f_{name}"] - v) < 1e-6 for (_, k), v in want.items())


def test_empty(empty):
    assert quality_rules.judge(empty).count() == 0
