"""Hard negatives of anchors: exact integer similarities by Strassen's multiplication, bounded heaps that merge.

A component x counts as floor(scale * x), and a score is the inner product of two such vectors, an exact integer. Anchors and
candidates are dealt into blocks by a hash of their id, each pair of blocks meets in one task, and a tile of scores is multiplied by
Strassen's seven products a level, sides of odd length padded with zeros. All additions are those of 64-bit integers, which wrap: they
form a ring, so the result is right whenever the true score fits 64 bits. Where the components are too large to be sure of that, the
same recursion runs on Python's integers, and a score that does not fit a long raises.

Two passes make the product once between them. The first multiplies anchors with candidates of their own label; of a tile each anchor
keeps a heap of its best positives, and heaps merge by keeping the first of their union (a window with a group limit, which Spark
applies before and after the shuffle). The second multiplies anchors with all other candidates; an anchor's heap there is one window
a positive, the best negatives whose score lies in a range of shares of the positive's. No heap grows with the table; a block has some
BLOCK rows whatever the input and the labels, so a label that a third of all rows have is dealt out like any other.

Defined cases: rows with a null id or label, a null vector, or a null, NaN or infinite component take no part. Vectors of unequal length are
padded with zeros; an empty vector scores 0. Of rows that repeat an id, the one of least (label, vector) counts. Ties go to the smaller
id. An anchor without another row of its label, and a positive whose window holds nothing, gives no rows; so does an empty table.
Extra columns are ignored. Ids and labels are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import written

#: Rows of a block of anchors or of candidates, about; anchors whose scores stand in memory at a time; the side below which tiles are multiplied outright.
BLOCK, STRIP, LEAF = 8192, 256, 32
_LAST = np.iinfo(np.int64).max


def _largest(a: np.ndarray) -> int:
    return max(int(a.max()), -int(a.min())) if a.size else 0


def _outright(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b; in doubles where every partial sum is a whole number that they hold exactly."""
    if a.dtype == np.int64 and _largest(a) * _largest(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(a: np.ndarray) -> np.ndarray:
    """a with sides of even length, zeros where it has none."""
    if not (a.shape[0] % 2 or a.shape[1] % 2):
        return a
    out = np.zeros([n + n % 2 for n in a.shape], dtype=a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of int64 or of Python integers."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _outright(a, b)
    a, b = _even(a), _even(b)
    p, q, r = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    (a11, a12), (a21, a22) = ((x[:, :q], x[:, q:]) for x in (a[:p], a[p:]))
    (b11, b12), (b21, b22) = ((x[:, :r], x[:, r:]) for x in (b[:q], b[q:]))
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * p, 2 * r), dtype=a.dtype)
    out[:p, :r] = m1 + m4 - m5 + strassen(a12 - a22, b21 + b22, leaf)
    out[:p, r:] = m3 + m5
    out[p:, :r] = m2 + m4
    out[p:, r:] = m1 - m2 + m3 + strassen(a21 - a11, b11 + b12, leaf)
    return out[:m, :n]


def whole(vectors: pd.Series, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each vector, one a row, zeros up to dims: int64, or Python integers if one is too large for it."""
    x = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        x[k, : len(v)] = v
    x = np.floor(scale * x)
    if not x.size or np.abs(x).max() < 1 << 62:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b, as int64."""
    if a.dtype == b.dtype == np.int64 and _largest(a) * _largest(b) * max(1, a.shape[1]) <= _LAST:
        return strassen(a, b.T)
    s = strassen(a.astype(object), b.T.astype(object))
    if _largest(s) > _LAST:
        raise OverflowError("a score does not fit a long")
    return s.astype(np.int64)


def best_first(s: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the scores that are ok in falling order, ties from the left, and their columns; what is not ok comes last."""
    bits = s.shape[1].bit_length()
    if _largest(s) < 1 << (62 - bits):
        keys = np.where(ok, (-s << bits) | np.arange(s.shape[1]), _LAST)
        keys.sort(axis=1)
        return -(keys >> bits), np.minimum(keys & ((1 << bits) - 1), s.shape[1] - 1)
    order = np.argsort(np.where(ok, ~s, _LAST), axis=1, kind="stable")
    return np.take_along_axis(s, order, axis=1), order


def _strips(n: int) -> Iterator[slice]:
    return (slice(k, k + STRIP) for k in range(0, n, STRIP))


def _width(anchors: pd.DataFrame, others: pd.DataFrame) -> int:
    return max((len(v) for x in (anchors["x"], others["x"]) for v in x), default=0)


def positive_heaps(anchors: pd.DataFrame, others: pd.DataFrame, most: int, scale: int) -> Iterator[pd.DataFrame]:
    """Each anchor's best rows of its own label in one block."""
    others, dims = others.sort_values(["label", "id"]), _width(anchors, others)
    for label, mine in anchors.groupby("label"):
        same = others[others["label"] == label]
        ids, b = same["id"].to_numpy(), whole(same["x"], dims, scale)
        asked, a = mine["id"].to_numpy(), whole(mine["x"], dims, scale)
        for part in _strips(len(asked) if len(ids) else 0):
            ok = asked[part, None] != ids
            s, order = best_first(scores(a[part], b), ok)
            row, col = np.nonzero(np.arange(min(most, len(ids))) < ok.sum(axis=1)[:, None])
            yield pd.DataFrame({"anchor_id": asked[part][row], "positive_id": ids[order[row, col]], "positive_score": s[row, col]})


def window_heaps(anchors: pd.DataFrame, others: pd.DataFrame, most: int, low: int, high: int, scale: int) -> Iterator[pd.DataFrame]:
    """For each anchor and positive the best rows of other labels in one block whose score is from low to high hundredths of the positive's."""
    others, dims = others.sort_values("id"), _width(anchors, others)
    ids, labels, b = others["id"].to_numpy(), others["label"].to_numpy(), whole(others["x"], dims, scale)
    asked, own, a = anchors["id"].to_numpy(), anchors["label"].to_numpy(), whole(anchors["x"], dims, scale)
    held = anchors["positives"].tolist()
    for part in _strips(len(asked) if len(ids) else 0):
        ok = own[part, None] != labels
        s, order = best_first(scores(a[part], b), ok)
        size, lines = ok.sum(axis=1), np.arange(len(ok))
        for j in range(max(len(h) for h in held[part])):
            has = np.array([len(h) > j for h in held[part]])
            of = [h[j] if len(h) > j else {"id": 0, "score": 0} for h in held[part]]
            pid, p = np.array([x["id"] for x in of]), np.array([x["score"] for x in of])
            hundreds, rest = np.divmod(p, 100)
            least, last = low * hundreds - (-low * rest) // 100, high * hundreds + (high * rest) // 100
            first = (s > last[:, None]).sum(axis=1)
            for k in range(most):
                at = np.minimum(first + k, s.shape[1] - 1)
                hit = has & (first + k < size) & (s[lines, at] >= least)
                yield pd.DataFrame({
                    "anchor_id": asked[part][hit], "positive_id": pid[hit], "positive_score": p[hit],
                    "negative_id": ids[order[lines, at]][hit], "negative_score": s[lines, at][hit],
                })


def _in_blocks(anchors: DataFrame, others: DataFrame, blocks: tuple[int, int], heaps: Callable[..., Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The heaps of every pair of a block of anchors with a block of others."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({n: np.array([], dtype=np.int64) for n in names}), *(heaps(left, right) if len(left) and len(right) else ())])

    block = lambda df, n: df.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = block(anchors, blocks[0]).withColumnRenamed("_own", "_a").withColumn("_c", every(blocks[1]))
    # columns of their own: both sides may come from the same rows
    right = block(others.select(*[F.col(c).alias(c) for c in ("id", "label", "x")]), blocks[1]).withColumnRenamed("_own", "_c").withColumn("_a", every(blocks[0]))
    return left.groupBy("_a", "_c").cogroup(right.groupBy("_a", "_c")).applyInPandas(run, schema)


def vectors(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, x) of the rows that take part, one an id."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"))
    rows = rows.filter("id is not null and label is not null and x is not null").filter(~bad)
    twice = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated-ids")
    if twice.isEmpty():
        return rows
    one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")
    return rows.join(twice, "id", "left_anti").unionByName(one)


def mine(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first `positives` rows
    of the same label, the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    is_anchor is a condition on the column id."""
    rows = vectors(df, id_col, label_col, vector_col)
    n = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    blocks = max(1, -(-n[1] // block)), max(1, -(-n[0] // block))
    anchors = rows.filter(is_anchor)
    found = _in_blocks(anchors, rows, blocks, lambda a, b: positive_heaps(a, b, positives, scale), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= positives)
    held = written(pairs.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives")), "positives")
    asked = anchors.join(held.withColumnRenamed("anchor_id", "id"), "id")
    fields = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    windows = _in_blocks(asked, rows, blocks, lambda a, b: window_heaps(a, b, negatives, low, high, scale), fields)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return windows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
