import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, key string, size int, score double, word string, b int, row long, text_sha256 string"


def rows():
    """Nulls in every column, empty, blank and long texts, ties, repeats, and columns whose names clash with the operators' own."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [say(rng.randint(1, 120)) for _ in range(40)]
    base = " ".join(rng.choice(vocabulary) for _ in range(200))
    texts += [base] * 5 + [base.replace(" ", "\n", 3), base + " end"]
    texts += [None, "", "  \n\t ", "Ünï çödé 漢字 🙂  x", "one two", "ONE two", "a\x00b c", say(6000), "same line\nother\nsame line", "x " * 300, "#$% " * 60]
    texts += ["site line\n" + say(60) for _ in range(12)]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, (None, "en", "de")[i % 3], (None, "s1", "s1", "s2", "s1")[i % 5], None if t is None else len(t), "x", "k", 1, 0.5, "w", 2, 3, "y"))
    out.append((None, "a text without an id here", "en", "s1", 1, None, None, None, None, None, None, None, None))
    out += [out[3], out[3]]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
