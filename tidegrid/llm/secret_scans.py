"""Secret scans over an incremental blob ledger.

Every historical version of every path is addressed by its content (SHA-256). The ledger holds one row for each blob and rule
version that has been scanned, with its findings; only pairs that it lacks are scanned, each once, however many paths share the
blob. Findings are joined back to all paths. The ledger is kept by rule version. Findings follow from the pair alone, so a run that
is repeated, or that overlaps another, adds equal rows at most; readers take one of each.

Defined cases: a null text is the empty blob, a null path a path like any other. Repeated paths, and paths with several versions,
each get their blob's findings. Clashing or extra columns of the input are ignored. An empty table gives no rows. Very long texts
are scanned whole, and redacted in time that grows with their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import BROADCAST_ROWS, scratch, small_enough, text_of, written


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of one of its groups for a match to count (a failing match still uses up its text)."""

    kind: str
    pattern: str
    group: int
    least: int
    #: What a text must contain for the pattern to be worth running; it never hides a match.
    needs: str


#: The base patterns, in the order that breaks ties, and after them what this rule set adds.
BASE_RULES = [
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, "(?i)passw|secret|token|api_?key"),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, "AKIA[A-Z0-9]{14}"),
    Rule("hex", "[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
]
ADDED_RULES = [
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+", 0, 1, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ"),
    Rule("prefixed", "(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 1, "gh[pousr]_|xox[abprs]-|sk_live_"),
]
RULES = BASE_RULES + ADDED_RULES
RULE_VERSION = "secrets-1"

#: cover: the bytes (start, end) of the stretches that the spans cover, overlaps joined.
FINDINGS = "blob_id binary, n_assign long, n_access long, n_hex long, base string, spans string, cover array<struct<s:int,e:int>>, rule_version string"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan(blobs: DataFrame, rules: list[Rule] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of each blob of (blob_id, t) that has any.

    The text between the matches and the matches alternate, so a running sum of their lengths, in a window over one blob and
    kind, gives the places. Only blobs that hold what a rule needs are taken apart.
    """
    needed = [F.col("t").rlike(r.needs) for r in rules]
    any_of = needed[0]
    for x in needed[1:]:
        any_of = any_of | x
    # an exchange between: what runs below it is the scan, and repeats of a blob end here
    found = blobs.filter(any_of).dropDuplicates(["blob_id"])
    parts = [
        F.when(
            F.col("t").rlike(r.needs),
            F.struct(
                F.lit(k).alias("k"), F.lit(r.least).alias("least"),
                F.split("t", r.pattern, -1).alias("gaps"),
                F.regexp_extract_all("t", F.lit(r.pattern), F.lit(0)).alias("hits"),
                F.regexp_extract_all("t", F.lit(r.pattern), F.lit(r.group)).alias("shown"),
            ),
        )
        for k, r in enumerate(rules)
    ]
    each = found.select("blob_id", F.explode(F.array_compact(F.array(*parts))).alias("r")).select("blob_id", "r.*")
    laid = each.select("blob_id", "k", "least", F.posexplode(F.arrays_zip("gaps", "hits", "shown")).alias("i", "x")).select(
        "blob_id", "k", "i",
        F.length("x.gaps").alias("gap"), F.coalesce(F.length("x.hits"), F.lit(0)).alias("n"),
        F.octet_length("x.gaps").alias("gap_b"), F.coalesce(F.octet_length("x.hits"), F.lit(0)).alias("n_b"),
        (F.length("x.shown") >= F.col("least")).alias("ok"),
    )
    one = Window.partitionBy("blob_id", "k").orderBy("i")
    ends = {"e": F.sum(F.col("gap") + F.col("n")).over(one).cast("int"), "e_b": F.sum(F.col("gap_b") + F.col("n_b")).over(one).cast("int")}
    spans = laid.withColumns(ends).filter("ok").select("blob_id", "k", (F.col("e") - F.col("n")).alias("s"), "e", (F.col("e_b") - F.col("n_b")).alias("s_b"), "e_b")
    # a span that begins inside the stretch before it only lengthens that
    in_order = Window.partitionBy("blob_id").orderBy("s", "k", "e")
    before = F.max("e_b").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    laid_out = spans.withColumn("new", F.coalesce(F.col("s_b") >= before, F.lit(True))).withColumn("stretch", F.sum(F.col("new").cast("int")).over(in_order))
    covered = laid_out.withColumn("far", F.max("e_b").over(Window.partitionBy("blob_id", "stretch")))
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = len(BASE_RULES)
    told = lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))
    joined = lambda xs: F.array_join(F.transform(xs, told), ",")
    count = lambda k: F.count_if(F.col("k") == k).cast("long")
    return (
        covered.groupBy("blob_id")
        .agg(
            count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
            F.sort_array(F.collect_list(F.struct("s", "k", "e"))).alias("all"),
            F.sort_array(F.collect_list(F.when(F.col("new"), F.struct(F.col("s_b").alias("s"), F.col("far").alias("e"))))).alias("cover"),
        )
        .select(
            "blob_id", "n_assign", "n_access", "n_hex",
            joined(F.filter("all", lambda x: x["k"] < base)).alias("base"), joined(F.col("all")).alias("spans"), "cover", F.lit(rule_version).alias("rule_version"),
        )
    )


def carriers(versions: DataFrame, addressed: DataFrame, unseen: DataFrame, bound: int) -> DataFrame:
    """Of versions (path, t, blob_id) those that carry the unseen blobs, one path for each blob, its least. The list of those, or of
    the others, is broadcast where its counted size allows that, else the texts are joined to it by a shuffle."""
    firsts = addressed.groupBy("blob_id").agg(F.min("path").alias("path"))
    wanted = written(firsts.join(unseen, "blob_id", "left_semi"), "carriers")
    same = lambda other: versions["path"].eqNullSafe(other["path"]) & (versions["blob_id"] == other["blob_id"])
    if small_enough(wanted, bound):
        return versions.join(F.broadcast(wanted), same(wanted), "left_semi")
    pairs = addressed.distinct()
    others = written(pairs.join(wanted, pairs["path"].eqNullSafe(wanted["path"]) & (pairs["blob_id"] == wanted["blob_id"]), "left_anti"), "copies")
    if small_enough(others, bound):
        return versions.join(F.broadcast(others), same(others), "left_anti")
    return versions.join(wanted, same(wanted), "left_semi")


def scan_paths(
    docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    rules: list[Rule] = RULES, rule_version: str = RULE_VERSION, bound: int = BROADCAST_ROWS,
) -> DataFrame:
    """For each row of docs, a version of a path: its id, blob_id and that blob's findings. ledger_path: where the ledger is kept and
    grows; a new one in the shared folder if none is given. A row of the ledger with null findings records a blob that was scanned
    and holds nothing."""
    spark = docs.sparkSession
    versions = docs.select(F.col(id_col).alias("path"), text_of(text_col).alias("t")).withColumn("blob_id", blob_id(F.col("t")))
    addressed = written(versions.select("path", "blob_id"), "addresses")
    ledger_path = ledger_path or scratch(spark, "ledger")
    seen = read_ledger(spark, ledger_path).filter(F.col("rule_version") == rule_version)
    unseen = written(addressed.select("blob_id").distinct().join(seen.select("blob_id"), "blob_id", "left_anti"), "unseen")
    findings = scan(carriers(versions, addressed, unseen, bound).select("blob_id", "t"), rules, rule_version)
    fresh = unseen.join(findings.drop("rule_version"), "blob_id", "left").withColumn("rule_version", F.lit(rule_version))
    fresh.select(*[c.split()[0] for c in FINDINGS.split(", ")]).write.mode("append").partitionBy("rule_version").parquet(ledger_path)
    known = read_ledger(spark, ledger_path).filter((F.col("rule_version") == rule_version) & F.col("spans").isNotNull()).drop("rule_version").dropDuplicates(["blob_id"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return addressed.join(known, "blob_id", "left").select(
        F.col("path").alias(id_col), "blob_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"), "cover",
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(FINDINGS).parquet(path) if there else spark.createDataFrame([], FINDINGS)


def redacted(text: Column, cover: Column, mark: str = "[SECRET]") -> Column:
    """The text with every covered stretch replaced by the mark; unchanged where there is none. Bytes are cut out where they stand,
    which characters would have to be counted for from the start."""
    raw = text.cast("binary")
    done = lambda i: F.coalesce(F.get(cover, i - 1)["e"], F.lit(0))
    cut = F.transform(cover, lambda x, i: F.substring(raw, done(i) + 1, x["s"] - done(i)).cast("string"))
    last = F.element_at(cover, -1)["e"]
    pieces = F.concat(cut, F.array(F.substring(raw, last + 1, F.octet_length(text)).cast("string")))
    return F.when(F.size(cover) > 0, F.array_join(pieces, mark)).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BROADCAST_ROWS, **kw) -> DataFrame:
    """docs with the secrets of its texts replaced. Only blobs with findings are joined back, by their content."""
    found = scan_paths(docs, id_col=id_col, text_col=text_col, bound=bound, **kw)
    some = written(found.filter(F.size("cover") > 0).select("blob_id", "cover").dropDuplicates(["blob_id"]), "secrets")
    # spans take more room than ids: a tenth of the usual bound
    lean = F.broadcast(some) if small_enough(some, bound // 10) else some
    # the row in one column, whatever names it has
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), blob_id(text_of(F.col(f"`{text_col}`"))).alias("blob_id"))
    both = marked.join(lean.select("blob_id", "cover"), "blob_id", "left")
    return both.select(*[(redacted(F.col("row")[c], F.col("cover")) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
