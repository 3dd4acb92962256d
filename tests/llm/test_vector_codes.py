import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from veilspark.llm import queries, vector_codes
from veilspark.llm.common import table


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows (id, vector, label) -> ({id: (code, error, label_error)} for kept rows, digest), in plain loops over whole distance matrices."""
    kept = [(i, [math.floor(scale * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v, _ in kept], np.int64)
    own = [x[:, x.shape[1] * j // parts : x.shape[1] * (j + 1) // parts] for j in range(parts)]
    books = [p[:entries].copy() for p in own]
    near = lambda p, b: ((p[:, None, :] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for p, b in zip(own, books, strict=True):
            at = near(p, b).argmin(1)
            for e in set(at.tolist()):
                b[e] = [math.floor(int(s) / 1) // int((at == e).sum()) for s in p[at == e].sum(0)]
    at = np.stack([near(p, b).argmin(1) for p, b in zip(own, books, strict=True)], 1)
    error = sum(((p - b[at[:, j]]) ** 2).sum(1) for j, (p, b) in enumerate(zip(own, books, strict=True)))
    total = defaultdict(int)
    for (_, _, lab), e in zip(kept, error.tolist(), strict=True):
        total[lab] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted((str(i), "".join(f"{c:02x}" for c in a), e, total[lab]) for (i, _, lab), a, e in zip(kept, at.tolist(), error.tolist(), strict=True)), digest


def got(df):
    rows = df.collect()
    return sorted((str(r[0]), r["code"], r["error"], r["label_error"]) for r in rows), {r["codebooks_sha256"] for r in rows}


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    want, digest = brute([(r.vec_id, r.embedding, r.label) for r in table(spark, d, "embeddings").collect()])
    rows, digests = got(queries.op11_vector_codes(spark, d))
    assert rows == want and digests == {digest}


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 1024], [None, 1, 2][i % 3]) for i in range(300)]  # many ties
    rows += [(1000 + i, [0.25] * 8, 1) for i in range(200)] + [(None, [0.5] * 8, None), (7, [1.5] * 8, 9), (7, [1.5] * 8, 9), (-5, [-0.0001] * 8, 4)]
    rows += [(2000, None, 1), (2001, [None] + [0.1] * 7, 1), (2002, [float("nan")] + [0.1] * 7, 1), (2003, [float("inf")] * 8, None)]
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_odd_rows_ties_and_any_partitioning(spark, parts):
    rows = odd_rows()
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(parts)
    for entries in (256, 16, 1):
        want, digest = brute(rows, entries=entries)
        assert got(vector_codes.codes_with_label_error(df, entries=entries)) == (want, {digest})


def test_other_widths_extra_columns_and_empty(spark):
    kind = "vec_id long, embedding array<double>, label int, row string, v int, size int, code string"
    df = spark.createDataFrame([(1, [0.5, 1.0, 2.0], 1, "a", 1, 2, "c"), (2, [1.0], 1, "b", 3, 4, "c"), (3, [1e30, -1e30, 0.0], 2, "c", 5, 6, "c"), (4, [], None, "d", 7, 8, "c")], kind)
    out, books = vector_codes.compress(df, parts=2)
    rows = {r.vec_id: r for r in out.collect()}
    assert out.columns == ["vec_id", "label", "row", "v", "size", "code", "error"] and [b.shape for b in books.entries] == [(2, 1), (2, 2)]
    assert (rows[1].code, rows[1].error, rows[1].row, rows[1].v) == ("0000", 0, "a", 1) and rows[3].code == "0101"
    assert (rows[2].code, rows[2].error, rows[2].size) == (None, None, 4) and rows[4].code is None
    out, books = vector_codes.compress(spark.createDataFrame([], kind))
    assert out.count() == 0 and books.entries == [] and vector_codes.codes_with_label_error(spark.createDataFrame([], kind)).count() == 0


def test_boxes_strike_out_entries():
    """On clustered points whole subtrees go to one entry: far fewer leaves are searched than there are, and the result is that of all distances."""
    rng = np.random.default_rng(1)
    points = (rng.integers(-1000, 1000, (8, 4))[rng.integers(0, 8, 3000)] + rng.integers(-5, 6, (3000, 4))).astype(np.int64)
    centres, tree = points[:64].copy(), vector_codes.Tree.of(points)
    entry, count, sums = tree.filtered(points, centres)
    assert (entry == ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all()
    assert count.sum() == 3000 and (sums.sum(0) == points.sum(0)).all()
    far = np.array([[0] * 4, [10**6] * 4], np.int64)
    whole = tree.filtered(points, far)
    assert whole[1].tolist() == [3000, 0] and (whole[2][0] == tree.sums[0]).all()
