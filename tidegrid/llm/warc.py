"""WARC archives written and read through Spark, with boundary-chain verification.

Writing. A record ends with two line breaks, which is exactly what the text writer puts after each row when they are its
separator; so archives go through Spark's own commit protocol to any file system, and a lost executor leaves no half file.
Equal payloads are stored once: the record with the largest id holds it and the others are ``revisit`` records.

Reading. Tasks split the archives at every magic string, wherever it stands, so a file of any size is read by many tasks. Each
piece is a candidate: its offset in the file and, from its header, the offset of its successor. Candidates that follow one
another without a gap form a run; pointer jumping over the runs, from the start of each file, keeps those that the chain reaches.
A magic string inside a payload is never reached, and its piece is put back into the record that holds it.

Defined cases: a null payload is an empty one. A null id has no place in an archive and its row is left out. A null url leaves
out the header. Characters of a url that could end a header line are percent-encoded. Rows with equal ids are separate records; if
several rows share the largest id of a payload, each of them is a response, and the payload's other records refer to that id. A payload of
any length is one record, read by as many tasks as it has magic strings. Extra columns are ignored. An empty table gives an empty archive and no rows. Archives are read whole or not at all: a file whose chain breaks off yields
the records before the break.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import BROADCAST_ROWS, scratch, small_enough, text_of, written

MAGIC = "WARC/1."
BREAK = "\r\n\r\n"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
SALTS = 32


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: 40 hex digits, five at a time, give four letters each."""
    digits = F.sha1(payload)
    letters = []
    for k in range(8):
        twenty = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_B32), F.shiftright(twenty, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _originals(pages: DataFrame, least: int) -> DataFrame:
    """digest and the largest id, for digests of at least that many bytes which more than one record has."""
    light = pages.filter(F.octet_length("payload") >= least).select("id", base32_sha1(F.col("payload").cast("binary")).alias("digest"))
    return written(light.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "originals")


def with_type(pages: DataFrame, least: int = 0, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(id, url, payload) with digest, and first: the id that holds an equal payload, null where the record itself does.

    The digests that repeat are counted. If they are few they go to the tasks that read the pages; if not, both sides are
    shuffled by digest and a salt, so that a payload with very many copies is spread over SALTS tasks."""
    first = _originals(pages, least)
    known = pages.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    if small_enough(first, bound):
        both = known.join(F.broadcast(first), "digest", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = known.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    return both.withColumn("first", F.when((F.octet_length("payload") >= least) & (F.col("first") != F.col("id")), F.col("first")))


def records(typed: DataFrame, date: str) -> DataFrame:
    """One string a record, without the two breaks that end it. The date is that of all records."""
    clean = F.regexp_replace(F.regexp_replace("url", "[\r\n]+", "%0A"), "[\\x00-\\x20\\x7f]", "%20")
    size = F.octet_length("payload")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    held = F.concat(F.lit(_HTTP), size.cast("string"), F.lit(BREAK), F.col("payload"))
    body = F.when(F.col("first").isNull(), held).otherwise(F.lit(""))
    line = lambda name, c: F.concat(F.lit(name + ": "), c, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC + "1\r\n"),
        line("WARC-Type", F.when(F.col("first").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", clean), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", size.cast("string")),
        F.coalesce(F.concat(line("WARC-Refers-To", urn(F.col("first"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")), F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"),
    )
    return typed.select(F.concat(head, F.lit(BREAK), body).alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0,
          bound: int = BROADCAST_ROWS, records_per_file: int = 200_000, date: str | None = None) -> None:
    """Archives of a record for each row, at path. Payloads of at least `least` bytes that are equal are stored once. The date, in
    UTC like 2001-02-03T04:05:06Z, is that of the call if none is given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(payload_col).alias("payload")).filter("id is not null")
    records(with_type(plain, least, bound), date).write.option("lineSep", BREAK).option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, split, i (order within the file's split) and the bytes after each magic string, up to the next."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("i"), F.col("value").cast("binary").alias("b"),
    )


def _placed(lengths: DataFrame) -> DataFrame:
    """Adds off, the place in the file of the magic string before each piece: lengths summed within a split, then over splits."""
    inside = Window.partitionBy("file", "split").orderBy("i")
    summed = lengths.withColumn("to", F.sum("n").over(inside))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.groupBy("file", "split").agg(F.sum("n").alias("all")).select("file", "split", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("from"))
    return summed.join(starts, ["file", "split"]).withColumn("off", F.col("from") + F.col("to") - F.col("n") - len(MAGIC))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Each piece's place, header fields, the place of its successor and, where it holds all of its record, what its payload is."""
    p = _pieces(spark, path)
    # header fields are ASCII; a piece whose head is no header gets null fields, and so no successor
    head = F.substring_index(F.col("b").cast("string"), BREAK, 1)
    field = lambda name, value: F.nullif(F.regexp_extract(F.col("head"), f"(?im)^{name}: *{value}\\r?$", 1), F.lit(""))
    fields = p.select("file", "split", "i", "b", head.alias("head")).select(
        "file", "split", "i",
        (F.octet_length("b") + len(MAGIC)).cast("long").alias("n"),
        F.octet_length("head").alias("h"),
        F.col("head").rlike("^[01]\\r\\n").alias("good"),
        field("WARC-Type", "([a-z]+)").alias("type"),
        field("WARC-Record-ID", "<urn:page:([^>\\r]+)>").alias("id"),
        field("WARC-Refers-To", "<urn:page:([^>\\r]+)>").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("digest"),
        field("WARC-Payload-Length", "([0-9]{1,18})").cast("long").alias("bytes"),
        field("Content-Length", "([0-9]{1,18})").cast("long").alias("length"),
        "b",
    )
    body = F.when((F.col("type") != "revisit") & (F.col("h") + 4 + F.col("length") + 4 == F.octet_length("b")), F.substring(F.col("b"), F.col("h") + 5, F.col("length").cast("int")))
    return fields.select(
        "file", "split", "i", "n", "h", "type", "id", "refers_to", "digest", "bytes", "length",
        F.when(F.col("good") & F.col("length").isNotNull(), F.col("h") + F.lit(len(MAGIC) + 8) + F.col("length")).alias("span"),
        body.alias("body"),
    ).select("*", *_payload(F.col("body"))).drop("body")


def _payload(body: Column) -> list[Column]:
    """What a response's body holds after its HTTP head: size and digest. Null where the body is."""
    skip = F.octet_length(F.substring_index(body.cast("string"), BREAK, 1)) + 5
    held = F.substring(body, skip, F.octet_length(body))
    return [F.octet_length(held).cast("long").alias("held"), F.when(held.isNotNull(), base32_sha1(held)).alias("held_digest")]


def reached(placed: DataFrame, rounds: int = 60) -> DataFrame:
    """The candidates that the chain from the start of their file reaches.

    Within a split, candidates of which each one's successor is the next form a run, reached from its entry on. A run's last
    successor leads into another run: that is the pointer. Each round joins every pointer to the pointer of its target, so that it
    leaps twice as far, and adds what the reached runs now point at; after log2 of the longest chain of runs nothing is left."""
    order = Window.partitionBy("file", "split").orderBy("off")
    runs = placed.withColumn("next", F.col("off") + F.col("span")).withColumn(
        "cut", F.coalesce((F.lag("next").over(order) != F.col("off")), F.lit(True)).cast("int")
    ).withColumn("run", F.sum("cut").over(order))
    nodes = written(runs.select("file", "split", "run", "off", "next", "i"), "candidates")
    tails = nodes.groupBy("file", "split", "run").agg(F.max_by("next", "off").alias("to"))
    heads = nodes.select("file", F.col("off").alias("to"), F.col("split").alias("to_split"), F.col("run").alias("to_run"))
    point = written(
        tails.filter("to is not null").join(heads, ["file", "to"]).select("file", "split", "run", "to", "to_split", "to_run"), "pointers"
    )
    hit = written(nodes.filter("off = 0").select("file", "split", "run", F.col("off").alias("entry")), "reached")
    for _ in range(rounds):
        if point.isEmpty():
            break
        new = hit.join(point, ["file", "split", "run"]).select("file", F.col("to_split").alias("split"), F.col("to_run").alias("run"), F.col("to").alias("entry"))
        hit = written(hit.unionByName(new).distinct(), "reached")
        onward = point.select("file", F.col("split").alias("to_split"), F.col("run").alias("to_run"), F.col("to").alias("far"), F.col("to_split").alias("far_split"), F.col("to_run").alias("far_run"))
        point = written(
            point.join(onward, ["file", "to_split", "to_run"]).select("file", "split", "run", F.col("far").alias("to"), F.col("far_split").alias("to_split"), F.col("far_run").alias("to_run")), "pointers"
        )
    else:
        if not point.isEmpty():
            raise RuntimeError(f"chains of runs were not followed to their ends in {rounds} rounds")
    entry = hit.groupBy("file", "split", "run").agg(F.min("entry").alias("entry"))
    return nodes.join(entry, ["file", "split", "run"]).filter(F.col("off") >= F.col("entry")).select("file", "split", "i", "off")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at path: id, record_type, refers_to, payload_bytes and payload_digest of the full payload, offset,
    and intact: whether what is stored agrees with the header's digest."""
    index = written(candidates(spark, path), "index")
    placed = _placed(index.filter("n is not null"))
    chain = written(reached(placed.select("file", "split", "i", "off", "span")), "chain")
    kept = index.join(chain, ["file", "split", "i"])
    whole = kept.filter("type = 'revisit' or held is not null")
    cut = written(kept.filter("type <> 'revisit' and held is null"), "cut")
    cols = ["file", "off", "id", "type", "refers_to", "digest", "bytes", "held", "held_digest"]
    if not cut.isEmpty():
        whole = whole.select(*cols).unionByName(_mended(spark, path, placed, cut).select(*cols))
    return whole.select(
        F.col("id"), F.col("type").alias("record_type"), F.col("refers_to"),
        F.coalesce("held", "bytes").alias("payload_bytes"), F.coalesce("held_digest", "digest").alias("payload_digest"),
        F.col("off").alias("offset"), (F.coalesce("held_digest", "digest") == F.col("digest")).alias("intact"),
    )


def _mended(spark: SparkSession, path: str, placed: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds magic strings: their pieces, read again, put back together in order. A group is one record."""
    own = F.struct(F.col("off").alias("owner"), (F.col("off") + F.col("span")).alias("end"))
    spans = cut.select("file", "split", "i", own.alias("own"))
    # the owner of a piece is the last cut record that starts at or before it, if that has not ended: in its split, or else in the
    # splits before, of which each is one row here
    splits = placed.select("file", "split").distinct().join(spans.groupBy("file", "split").agg(F.max("own").alias("own")), ["file", "split"], "left")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file", "split", F.last("own", True).over(earlier).alias("carried"))
    back = Window.partitionBy("file", "split").orderBy("off")
    owned = placed.select("file", "split", "i", "off").join(spans, ["file", "split", "i"], "left").join(carried, ["file", "split"]).select(
        "file", "split", "i", "off", F.coalesce(F.last("own", True).over(back), F.col("carried")).alias("own")
    )
    mine = written(owned.filter("own is not null and off < own.end").select("file", "split", "i", "off", "own.owner"), "owned")
    pieces = _pieces(spark, path).join(mine, ["file", "split", "i"])
    # one pass over the bytes: a string's bytes stay as they are, whatever they are
    each = F.sort_array(F.collect_list(F.struct("off", F.col("b").cast("string").alias("b"))))
    joined = pieces.groupBy("file", "owner").agg(F.array_join(each["b"], MAGIC).cast("binary").alias("b")).withColumnRenamed("owner", "off")
    both = joined.join(cut.drop("held", "held_digest"), ["file", "off"])
    body = F.substring(F.col("b"), F.col("h") + 5, F.col("length").cast("int"))
    return both.withColumn("body", body).select("*", *_payload(F.col("body")))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0,
               bound: int = BROADCAST_ROWS, path: str | None = None) -> DataFrame:
    """Writes pages to archives in the shared folder and reads these back."""
    path = path or scratch(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, payload_col, least, bound)
    return read(pages.sparkSession, path)
