"""What each of five filters takes in every order in which they may be applied.

Every document is asked once: its failures are a mask of five bits, and documents are counted by (part, mask), at most 32 cells a
part. Whatever an order of filters keeps after some steps depends only on which filters have been applied, one of 32 sets. A
Gray-code walk visits these sets and toggles one filter at a time: each mask cell has a counter of active filters that it fails,
and a part's running survivors change by those cells whose counter leaves or reaches zero. The 32 states are stored; all steps of all
120 orders, and the sums over orders, are differences of two states.

A, B, C and D look at the text alone; E asks for the least id of an identical text, found by an aggregate over digests that
combines before the shuffle. Texts never move, only digests and counts.

Defined cases: a null text counts as empty, a null part as the empty string. Words are maximal runs of anything but U+0020 and U+0009
to U+000D, case-sensitive; a word of any length and a text of any length count as they are. A row that repeats (id and text) has no
smaller id of its text besides, so neither fails E; a row without an id never fails E and makes none fail. A document is good or toxic
if any of its labels says 1; labels without a document play no part. An empty table has no part and gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import text_of

FILTERS = "ABCDE"
STATES = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Counts that are walked: all documents of a part, good ones, toxic ones.
COUNTS = ("n", "good", "toxic")
WORD = "[^\\x20\\x09-\\x0D]+"


def conditions(text: Column) -> list[Column]:
    """Failure conditions A to D of a text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 100, 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]"),
    ]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by what they fail; bit k of mask is the k-th filter's."""
    text = text_of(F.col(text_col).cast("string"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions(text))), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("same"), bits.alias("bits"))
    # joined back by text and id together, so that a text that many documents have is no single key
    first = rows.filter("id is not null").groupBy("same").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    late = F.col("id").isNotNull() & F.col("first").isNull()
    known = rows.join(first, ["same", "id"], "left").select("id", "part", (F.col("bits") + F.when(late, 16).otherwise(0)).alias("mask")).join(said, "id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return known.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))


def walk(counts: np.ndarray) -> np.ndarray:
    """Survivors [part, set of active filters, what] of counts [part, mask, what], along the Gray code."""
    failing = np.zeros(STATES, dtype=np.int64)
    now = counts.sum(axis=1)
    out = np.empty_like(counts)
    out[:, 0] = now
    active = 0
    for step in range(1, STATES):
        toggled = step & -step
        active ^= toggled
        hit = np.flatnonzero(np.arange(STATES) & toggled)
        if active & toggled:
            now = now - counts[:, hit[failing[hit] == 0]].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            now = now + counts[:, hit[failing[hit] == 0]].sum(axis=1)
        out[:, active] = now
    return out


def states(of_cells: DataFrame) -> DataFrame:
    """(part, n, good, toxic): per part three arrays of 32 counts, what survives each set of active filters."""
    gathered = of_cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = np.zeros((len(pdf), STATES, len(COUNTS)), dtype=np.int64)
            for k, held in enumerate(pdf["cells"]):
                for c in held:
                    counts[k, c["mask"]] = [c[x] for x in COUNTS]
            left = walk(counts)
            yield pd.DataFrame({"part": pdf["part"]} | {c: list(left[:, :, k]) for k, c in enumerate(COUNTS)})

    return gathered.mapInPandas(run, "part string, " + ", ".join(f"{c} array<long>" for c in COUNTS))


def steps(of_states: DataFrame) -> DataFrame:
    """Per part, order and step what was kept, removed, removed before, failed here only, lost of good and toxic ones, and the sum of
    the filter's removals over all orders."""
    index = {f: k for k, f in enumerate(FILTERS)}
    before = [sum(1 << index[f] for f in o[:s]) for o in ORDERS for s in range(len(FILTERS))]
    which = [index[f] for o in ORDERS for f in o]
    each = of_states.select("*", F.posexplode(F.array(*[F.lit(x) for x in before])).alias("at", "before"))
    place = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at)
    each = each.select("*", place(which, F.col("at")).alias("f"), place(ORDERS, F.floor(F.col("at") / len(FILTERS)).cast("int")).alias("filter_order"), (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"))
    each = each.withColumn("bit", F.expr("shiftleft(1, f)"))
    state = lambda c, s: F.get(c, s)
    after = F.col("before").bitwiseOR(F.col("bit"))
    gone = lambda c: state(c, F.col("before")) - state(c, after)
    full = STATES - 1
    # a set of s other filters comes first in s! * (4 - s)! orders
    weight = [factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) if s < full else 0 for s in range(STATES)]
    total = F.lit(0).cast("long")
    for s in range(full):
        total = total + F.when(F.col("bit").bitwiseAND(s) == 0, weight[s] * (state("n", F.lit(s)) - state("n", F.col("bit").bitwiseOR(s)))).otherwise(0)
    return each.select(
        "part", "filter_order", "step", state("n", after).alias("kept"), gone("n").alias("removed"),
        (state("n", F.lit(0)) - state("n", F.col("bit")) - gone("n")).alias("redundant"), (state("n", full - F.col("bit")) - state("n", F.lit(full))).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), total.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    return steps(states(cells(docs, labels, id_col, text_col, part_col)))
