"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit per rule; a policy is a
named, versioned set of bits. Applying a policy, comparing two of them, or finding what a rule alone rejects is then bit
arithmetic over the ledger and never reads a text again.

Defined cases: a null text counts as the empty text (no words; it fails ``few_words``). Repeated doc_ids give one ledger row
each. Columns of the input other than id and text are ignored, whatever their names. An empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import WORD_BREAK, text_of

#: Rules in bit order: name and what fails, over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "2 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines and n_lines > 1"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: a document is kept if none of the policy's bits is set.
POLICIES: dict[str, int] = {
    "base-1": BIT["few_words"] | BIT["repeated_windows"],
    "strict-1": sum(BIT.values()),
}
BASE, DEFAULT = "base-1", "strict-1"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words: narrow columns only, without a shuffle.

    The windows of three words are 64-bit hashes; the hash's low bits and the window's position share one long, so that equal
    windows become neighbours in a sort of plain longs. Neighbours count as equal only if their words are.
    """
    cut = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("t")).select(
        "_id",
        F.array_remove(F.split("t", WORD_BREAK), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    counted = cut.select(
        "_id", "n_symbols", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.ceil(F.log2(F.size("w") + 2)).cast("int").alias("b"),
    )
    packed = counted.withColumn(
        "p",
        F.when(
            F.size("w") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("w") - 3),
                    lambda i: F.call_function("shiftleft", F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), F.col("b")).bitwiseOR(i.cast("long")),
                )
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    pos = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b")) - 1).cast("int")
    key = lambda x: F.call_function("shiftrightunsigned", x, F.col("b"))

    def same(x: Column, y: Column) -> Column:
        words = [F.get("w", pos(x) + k) == F.get("w", pos(y) + k) for k in range(3)]
        return (key(x) == key(y)) & reduce(Column.__and__, words)

    starts = packed.withColumn(
        "s", F.sort_array(F.transform(F.filter("p", lambda x, i: same(x, F.get("p", i - 1)) | same(x, F.get("p", i + 1))), pos))
    )
    covered = F.aggregate(
        F.transform("s", lambda x, i: F.least(F.lit(3), F.get("s", i + 1) - x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    row = F.struct("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))
    # a generator between: the optimizer would move a later filter on a measure below the split into words, into the lambdas
    return starts.select("_id", F.explode_outer(F.array(row)).alias("m")).select(F.col("_id").alias(id_col), "m.*")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measures() and fail_bits: bit k is set where rule k fails."""
    bits = reduce(Column.__add__, [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)])
    return measures(docs, id_col, text_col).withColumn("fail_bits", bits.cast("long"))


def kept(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policy(led: DataFrame, policy: str = DEFAULT) -> DataFrame:
    return led.withColumn("base_failed", ~kept(BASE)).withColumn("kept", kept(BASE) & kept(policy))


def ablation(led: DataFrame, policy: str = DEFAULT) -> DataFrame:
    """For each rule of a policy: how many documents it rejects, how many it alone rejects, and how many the policy keeps without it.

    The ledger is first counted by its bits (at most 2 ** rules rows), so each rule costs a pass over those few rows.
    """
    by_bits = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [(name, bit) for name, bit in BIT.items() if bit & POLICIES[policy]]
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in rules]))
    fell = by_bits.select("bits", "n", rows.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return fell.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
