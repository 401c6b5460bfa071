"""Benchmark decontamination with SimHash windows of the items' sizes and a multi-index over Hamming blocks.

Words are lower-cased runs of letters and digits; shingles are five words, as 64-bit hashes.

1. A bitmap holds the shingles of the benchmark. Positions of a document whose shingle is in it are its hits; a document without
   hits cannot hold a copy of an item, since a similarity above zero takes a common shingle.
2. Windows of an item's size begin at the hits that are shingles of that item (moved back at the document's end). No other
   window can do better: moving a window right until it begins with a shared shingle loses none. A start is left out if its left
   neighbour is shared and the window's last shingle is not: the window one to the left is then as good or better.
3. Each window and each item gets a 63-bit SimHash, weighted by how often a shingle occurs in it. Fingerprints within RADIUS bits
   of each other agree in at least one of RADIUS + 1 blocks, so the equi-join on (item, block number, block value) finds all of
   them; the distance is then computed, and a pair counts at its first equal block only. Blocks of three bits alone would let nearly
   every item of a window's size through, at any length of fingerprint, as a third of the bits may differ: the item that the window
   starts with is therefore part of the key.
4. Pairs within the radius are verified: weighted Jaccard similarity of the two multisets of shingles, at least THRESHOLD.

A copy at similarity 0.8 flips about 10 of 63 bits (standard deviation 3), so a radius of 20 loses less than one in a thousand of
the least similar pairs, and none of the exact ones.

Defined cases: null texts and texts of fewer than five words have no shingles, so such documents are clean and such items match
nothing. A null id is an id like any other. A document shorter than an item is one window by itself. Repeated ids, texts and items count each on their own; of one
document and item the best window is reported, the first at ties. A very long text is read whole, and its shingles go along
with each of its hits. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import BROADCAST_ROWS, small_enough, text_of, written

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 20
#: Least and most bits of the bitmap, powers of two: sixteen for each shingle of the benchmark between them (128 kB to 2 MB). A benchmark
#: beyond that lets more positions through, of which the join with the items then keeps the same.
BITMAP_BITS = (1 << 20, 1 << 24)
#: The 63 bits of a SimHash are summed three at a time, in lanes of 21 bits of a long: enough for two million shingles.
LANES, LANE_BITS = 3, 21
_LANE_MASK = sum(1 << (LANE_BITS * k) for k in range(LANES))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def shingles(w: str) -> Column:
    """Hashes of all runs of five words of an array column, in order."""
    return F.when(
        F.size(w) >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])),
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(s: str) -> Column:
    """The fingerprint of an array of shingle hashes; repeats weigh as often as they occur."""
    zero = F.array_repeat(F.lit(0).cast("long"), LANE_BITS)
    sums = F.aggregate(s, zero, lambda acc, h: F.transform(acc, lambda a, j: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(_LANE_MASK))))
    half = F.size(s)

    def bits(a: Column, j: Column) -> Column:
        lanes = [
            F.when(F.call_function("shiftrightunsigned", a, F.lit(LANE_BITS * k)).bitwiseAND(F.lit((1 << LANE_BITS) - 1)) * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), j + LANE_BITS * k)).otherwise(F.lit(0).cast("long"))
            for k in range(LANES)
        ]
        return reduce(Column.bitwiseOR, lanes)

    return F.aggregate(F.transform(sums, bits), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """Offset and width of radius + 1 blocks that cover the fingerprint."""
    edges = [LANES * LANE_BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block(f: Column, at: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", f, F.lit(at)).bitwiseAND(F.lit((1 << width) - 1))


def similarity(x: str, y: str) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets. Without repeats that is a set intersection."""
    times = lambda xs, v: F.size(F.filter(xs, lambda u: u == v))
    common = F.array_intersect(x, y)
    plain = F.size(common)
    counted = F.aggregate(common, F.lit(0), lambda acc, v: acc + F.least(times(F.col(x), v), times(F.col(y), v)))
    repeats = (F.size(F.array_distinct(x)) < F.size(x)) & (F.size(F.array_distinct(y)) < F.size(y))
    shared = F.when(repeats, counted).otherwise(plain)
    return shared / (F.size(x) + F.size(y) - shared)


def _bitmap(postings: DataFrame, size: int) -> Column:
    """The benchmark's shingles as `size` bits in a literal array of longs."""
    bit = postings.select(F.pmod("h", F.lit(size)).alias("x"))
    used = bit.groupBy(F.shiftright("x", 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(63).cast("int"))).alias("bits"))
    longs = np.zeros(size // 64, dtype=np.int64)
    for row in used.collect():
        longs[row.word] = row.bits
    return F.lit(longs)


def candidates(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc, no, n, m, at, x, g): windows of documents with the item that each begins with, its shingles and its fingerprint.

    The items' shingles are counted: up to `bound` of them, two or three dozen bytes each, may be broadcast."""
    total = items.agg(F.sum("m")).first()[0] or 0
    lean = F.broadcast if total <= bound else (lambda x: x)
    postings = items.select("no", "n", "m", F.explode(F.array_distinct("s")).alias("h"))
    size = min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << (16 * total).bit_length()))
    bitmap = _bitmap(postings, size)
    hashed = docs.select(F.col(id_col).alias("doc"), words(text_of(text_col)).alias("w")).select("doc", shingles("w").alias("s"))
    inside = lambda h: F.call_function("shiftrightunsigned", F.get(bitmap, F.shiftright(F.pmod(h, F.lit(size)), 6).cast("int")), F.pmod(h, F.lit(64)).cast("int")).bitwiseAND(1) == 1
    hits = hashed.withColumn("at", F.filter(F.transform("s", lambda h, i: F.when(inside(h), i)), lambda x: x.isNotNull()))
    # an outer explode: with a plain one, or a filter here, the optimizer moves a copy of all this below the split into words,
    # where the lambdas split the text anew for each of its words
    starts = hits.select("doc", "s", F.explode_outer("at").alias("p")).filter("p is not null").withColumn("h", F.get("s", F.col("p")))
    shared = lambda k: F.coalesce(F.array_contains("o", F.get("s", k)), F.lit(False))
    owned = starts.join(lean(postings), "h").join(lean(items.select("no", F.array_distinct("s").alias("o"))), "no")
    placed = owned.filter(~shared(F.col("p") - 1) | shared(F.col("p") + F.col("m") - 1)).select(
        "doc", "no", "n", "m", "s", F.greatest(F.lit(0), F.least(F.col("p"), F.size("s") - F.col("m"))).alias("at")
    )
    return placed.select("doc", "no", "n", "m", "at", F.expr("slice(s, at + 1, m)").alias("x")).withColumn("g", simhash("x"))


def fingerprints(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(no, item, n, m, s, f) of each item with shingles: a number of its own, words, shingles and their number, fingerprint."""
    cut = benchmark.select(F.col(item_col).alias("item"), words(text_of(item_text)).alias("w")).select("item", F.size("w").alias("n"), shingles("w").alias("s"))
    each = cut.filter(F.size("s") > 0).withColumns({"f": simhash("s"), "m": F.size("s")}).dropDuplicates(["item", "s"])
    return written(each.withColumn("no", F.monotonically_increasing_id()), "items")


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, radius: int = RADIUS, bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """Contaminated documents: doc_id, item_id, first_word, n_words (the window) and similarity, one row for each document and item."""
    items = fingerprints(benchmark, item_col, item_text)
    windows = candidates(docs, items, id_col, text_col, bound)
    cut = blocks(radius)
    rows = lambda f, *cols: [*cols, F.posexplode(F.array(*[block(F.col(f), a, b) for a, b in cut])).alias("k", "v")]
    indexed = items.select(*rows("f", "no", "f"))
    first = reduce(lambda acc, kab: F.when(block(F.col("f"), kab[1][0], kab[1][1]) == block(F.col("g"), kab[1][0], kab[1][1]), F.lit(kab[0])).otherwise(acc), reversed(list(enumerate(cut))), F.lit(-1))
    near = (
        windows.select(*rows("g", "doc", "no", "n", "at", "x", "g")).join(F.broadcast(indexed) if small_enough(indexed, bound) else indexed, ["no", "k", "v"])
        .filter(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius).filter(first == F.col("k"))
    )
    texts = items.select("no", "item", "s")
    few = (items.agg(F.sum("m")).first()[0] or 0) <= bound
    scored = near.join(F.broadcast(texts) if few else texts, "no").select("doc", "item", "n", "at", similarity("x", "s").alias("sim")).filter(F.col("sim") >= threshold)
    best = scored.groupBy("doc", "item").agg(F.max(F.struct("sim", (-F.col("at")).alias("neg"), "n")).alias("b"))
    return best.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), (-F.col("b.neg")).alias("first_word"), F.col("b.n").alias("n_words"), F.col("b.sim").alias("similarity")
    )


def without_copies(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", bound: int = BROADCAST_ROWS, **kw) -> DataFrame:
    """docs without the documents that hold a copy of an item. Rows that share an id go together; those without one can't be named
    and stay."""
    found = written(find(docs, benchmark, id_col=id_col, bound=bound, **kw).select(id_col).distinct(), "contaminated")
    return docs.join(F.broadcast(found) if small_enough(found, bound) else found, id_col, "left_anti")
