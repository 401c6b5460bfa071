import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import hard_negatives as h

SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize(("m", "k", "n"), [(1, 1, 1), (7, 64, 5), (33, 64, 65), (64, 7, 100), (0, 4, 3), (70, 0, 40)])
def test_strassen_is_the_product(m, k, n):
    rng = np.random.default_rng(m + k + n)
    for top, kind in ((1000, np.int64), (1 << 28, np.int64), (1 << 60, object)):
        a, b = (rng.integers(-top, top, s).astype(kind) for s in ((m, k), (k, n)))
        want = a.astype(object) @ b.astype(object) if k else np.zeros((m, n), dtype=object)
        assert (h.strassen(a, b, leaf=2) == want).all()


def test_large_scores_are_exact_or_raise():
    a, b = np.array([[3 << 61, 1]], dtype=object), np.array([[1, 5], [0, 7]], dtype=object)
    with pytest.raises(OverflowError):
        h.scores(a * 8, b)
    assert h.scores(np.array([[1 << 40, 1]]), np.array([[1 << 20, 5]])).tolist() == [[(1 << 60) + 5]]


@pytest.mark.parametrize("top", [50, 1 << 61])
def test_best_first(top):
    rng = np.random.default_rng(1)
    s, ok = rng.integers(-5, 5, (20, 37)) * (top // 5), rng.random((20, 37)) < 0.7
    got, order = h.best_first(s, ok)
    for k in range(20):
        want = sorted(np.flatnonzero(ok[k]), key=lambda c: (-s[k, c], c))
        assert order[k, : len(want)].tolist() == want
        assert got[k, : len(want)].tolist() == [s[k, c] for c in want]


def brute(rows, every=5, n_pos=5, n_neg=3):
    good = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        good[i] = min(good.get(i, (label, x)), (label, x))
    ints = {i: (label, [math.floor(256 * v) for v in x]) for i, (label, x) in good.items()}
    out = []
    for a in ints:
        if a % every:
            continue
        score = {b: sum(p * q for p, q in zip(ints[a][1], ints[b][1], strict=False)) for b in ints if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if ints[b][0] == ints[a][0]][:n_pos]:
            got = [b for b in order if ints[b][0] != ints[a][0] and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(got[:n_neg])]
    return sorted(out)


def made(seed=3, n=230):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = 0 if rng.random() < 0.4 else rng.randrange(5)
        rows.append((i, label, [rng.choice([0.0, 0.25, rng.uniform(-1, 1), label / 5]) for _ in range(9)]))
    rows += [(i, 1, rows[10][2]) for i in range(300, 330)]  # copies: ties by id
    rows += [rows[20]] * 40  # repeated rows
    rows += [(25, 3, [0.5] * 9), (25, 3, [0.25] * 9)]  # an id with other vectors
    rows += [(400, 2, [0.7] * 4), (405, 2, []), (410, 77, [0.3] * 9)]  # short, empty, alone with its label
    rows += [(500, None, [1.0] * 9), (505, 1, None), (None, 1, [1.0] * 9)]
    rows += [(510 + k, 1, [0.5] * 8 + [v]) for k, v in enumerate([None, float("nan"), float("inf"), -float("inf")])]
    rows += [(600, 3, [-0.0] * 9), (605, 3, [-1.0] * 9)]
    return rows


def got(df, **kw):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in h.mine(df, F.col("id") % 5 == 0, **kw).collect())


@pytest.mark.parametrize("block", [8192, 37])
def test_equals_brute_force(spark, block):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "x": F.lit(1), "_a": F.lit(2)})
    want = brute(rows)
    assert len(want) > 100
    assert got(df.repartition(5), block=block) == want


def test_one_of_each_repeated_id(spark):
    rows = [(k, k % 2, [1.0 + k / 64, 0.5]) for k in range(12)] * 3 + [(5, 0, [2.0, 2.0]), (5, 0, [1.5, 2.0])]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nothing_to_mine(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, 1, [1.0]), (1, 2, [0.7])], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, 1, [1.0]), (1, 1, [0.5])], SCHEMA)) == []


def test_huge_components(spark):
    rows = [(0, 1, [2.0**50, 1.0]), (5, 1, [2.0**-9, 3.0]), (6, 1, [1.0, 2.0]), (7, 2, [0.75, 1.0]), (8, 2, [0.5, 0.0])]
    rows = [(i, c, [x[0], x[1] * 4]) for i, c, x in rows]
    with pytest.raises(Exception, match="does not fit"):
        got(spark.createDataFrame([*rows, (9, 1, [2.0**60, 0.0])], SCHEMA))
    assert got(spark.createDataFrame(rows[1:], SCHEMA)) == brute(rows[1:])
