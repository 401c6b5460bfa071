"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Only how many pieces there are of each length decides how they are packed, and there are at most as many lengths as a sequence has
tokens. So the packing is planned on that histogram, whatever the number of documents, in runs of sequences that look alike: pieces
longer than a third of a sequence go at most two to one, matched greedily, the longest with the longest that still fits (its partners are
partners of every shorter piece too, so no other matching makes more pairs); shorter ones, from the longest down, go into the
smallest gap that holds them, a whole run of equal gaps at a time, and into new sequences once none is left. A run's gap at least halves
each time pieces go into it, which bounds the plan: some hundred thousand runs for 4,096 tokens at the very most.

Pieces then find their places by rank: those of one length are dealt into SALTS blocks, ranked within a block, and blocks are summed
up, so that a length that a third of all pieces have is no single task's. Rows of pieces (a few dozen bytes) move, tokens don't.

Tokens are the library's own: white space separates what it encodes independently (its pattern drops white space, no merge reaches
across), so each distinct word of a worker is encoded once and looked up after that, from the ids of its parts; both tables are bounded
in bytes.

Defined cases: a null text counts as empty, and is one piece of the end mark alone. Only documents longer than a sequence are cut. A
very long text is read part by part. Repeated rows are packed each; equal rows stand in any order. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from tidegrid.llm.common import written
from tidegrid.llm.sentencepieces import slices
from tidegrid.llm.shingling import mixed

CAPACITY, END_ID = 4096, 1
#: Blocks that the pieces of one length are dealt into.
SALTS = 256
#: Bytes of each of a worker's two tables, and characters of texts, or of words, that are worked on together.
TABLE_BYTES, PART_CHARS = 128 << 20, 4 << 20
#: Longer words are not kept.
MAX_KEPT = 256
_BREAK = re.compile(r"[\x20\x09-\x0D]")
#: Characters of words that may be cut here: up to the end of Cyrillic.
_PLAIN = re.compile("[!-\u052f]+")
#: What is one part whatever the pattern's other branches.
_LETTERS = re.compile("[a-z]+")
#: Bytes of an entry of a table besides its characters and ids, about.
_ENTRY = 190


def parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of at least so many characters, cut at white space."""
    at = 0
    while len(text) - at > most:
        cut = _BREAK.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def _byte_letters() -> list[str]:
    """The letter that byte-level models have for each byte: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class _Parts(dict):
    """The ids of what the pattern finds in words, by the library's model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model, self.letters, self.bytes = model, _byte_letters(), 0

    def __missing__(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else "".join([self.letters[b] for b in part.encode()]))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= MAX_KEPT:
            self[part] = out
            self.bytes += len(part) + len(out) + _ENTRY
        return out


class Words:
    """Texts to ids, as little-endian 32-bit integers, each word and each part of words encoded once while the tables have room.

    If the tokenizer's normalizer and pattern drop white space, a text's ids are those of its words one after the other. The words of many
    texts are found and hashed to 64 bits in arrays over their bytes, and looked up in a sorted table that has a stretch of ids for
    each. A word that it lacks is cut, if it is of printable Latin, Greek or Cyrillic characters, by the pattern of the tokenizer's own
    file after its own normalizer, and its parts go to its model; any other word goes through the library as a whole. Other tokenizers
    get whole texts."""

    def __init__(self, path: str, most: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.most = Tokenizer.from_file(path), most
        told = json.loads(self.library.to_str())
        steps = told["normalizer"] and told["normalizer"].get("normalizers") or []
        cut = told["pre_tokenizer"] and told["pre_tokenizer"].get("pretokenizers") or [{}]
        self.by_words = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and cut[0].get("behavior") == "Removed" and cut[0].get("invert") and cut[-1].get("type") == "ByteLevel"
        self.pattern = regex.compile(cut[0]["pattern"]["Regex"]) if self.by_words else None
        self.parts = _Parts(self.library.model)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.first, self.n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")

    def word(self, word: str) -> bytes:
        if word.isprintable() and "<|" not in word and _PLAIN.fullmatch(word):
            low = word.lower() if word.isascii() else self.library.normalizer.normalize_str(word)
            return self.parts[low] if _LETTERS.fullmatch(low) else b"".join(map(self.parts.__getitem__, self.pattern.findall(low)))
        ids = self.library.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Words of sorted keys, none of which the table has."""
        new = [self.word(w.decode("utf-8", "surrogatepass")) for w in words]
        n = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) // 4
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(n) - n)
        self.n, self.keys = np.insert(self.n, at, n), np.insert(self.keys, at, keys)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(new), dtype="<u4")])
        if self.parts.bytes > self.most:
            self.parts = _Parts(self.library.model)

    def _together(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are looked up at once."""
        keys, starts, ends, bounds, data = hashed_words([t.encode("utf-8", "surrogatepass") for t in texts])
        if not len(keys):
            return [b""] * len(texts)
        distinct, which = np.unique(keys, return_inverse=True)
        if self.ids.nbytes + 24 * len(self.keys) > self.most:
            self._clear()
        at = np.searchsorted(self.keys, distinct)
        lacks = np.flatnonzero(np.append(self.keys, np.uint64(0))[at] != distinct) if len(self.keys) else np.arange(len(distinct))
        # hash 0 would pass for the place behind the last one
        lacks = np.union1d(lacks, np.flatnonzero(at == len(self.keys)))
        if len(lacks):
            seen = np.empty(len(distinct), dtype=np.int64)
            seen[which] = np.arange(len(which))
            self._learn(distinct[lacks], [data[starts[k] : ends[k]] for k in seen[lacks].tolist()])
            at = np.searchsorted(self.keys, distinct)
        n = self.n[at][which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.first[at][which] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        of_text = (4 * upto[bounds]).tolist()
        return [ids[a:b] for a, b in zip(of_text, of_text[1:], strict=False)]

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            if not self.by_words:
                yield np.array(self.library.encode(texts[at], add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif size > PART_CHARS:
                yield b"".join([x for part in parts(texts[at]) for x in self._together([part])])
            else:
                while to < len(texts) and size + len(texts[to]) <= PART_CHARS:
                    size += len(texts[to])
                    to += 1
                yield from self._together(texts[at:to])
            at = to


def hashed_words(data: list[bytes], most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash, start and end of each word, first word of each text and at the end their number, the bytes that starts and ends are in)."""
    joined = b" ".join(data) + b" "
    bytes_ = np.frombuffer(joined, dtype=np.uint8)
    gap = _GAP[bytes_]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    edge = edge if gap[0] else np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    value = np.zeros(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        # a polynomial in a word's bytes, as a difference of running sums, taken back by the power of its start
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + most, side="right")))
        lo, hi = int(starts[k]), int(ends[to - 1])
        up, down = _powers(hi - lo)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((bytes_[lo:hi] + np.uint64(1)) * up[: hi - lo], dtype=np.uint64)])
        value[k:to] = (sums[ends[k:to] - lo] - sums[starts[k:to] - lo]) * down[starts[k:to] - lo]
        k = to
    ends_of_text = np.cumsum(np.fromiter((len(d) + 1 for d in data), dtype=np.int64, count=len(data)))
    bounds = np.concatenate([[0], np.searchsorted(starts, ends_of_text)]).astype(np.int64)
    return mixed(value ^ (ends - starts).astype(np.uint64)), starts, ends, bounds, joined


_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_to(1 << max(19, n.bit_length()))


@lru_cache(maxsize=2)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, in 64 bits."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """The tables of a worker, which its later tasks go on with."""
    return Words(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt), with ids also token_ids: every document's ids and the end mark, cut where a document is longer than a sequence."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kinds = [("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType()), ("salt", IntegerType())]
    out_type = StructType([plain.schema["id"], *[StructField(n, k) for n, k in kinds], *([StructField("token_ids", ArrayType(IntegerType()))] if ids else [])])
    arrow_type = to_arrow_schema(out_type)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, 2 * PART_CHARS):
                of, rows, kept = [], [], []
                for k, data in enumerate(words.encoded([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])):
                    data += end
                    for p, at in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[at : at + 4 * capacity]
                        of.append(a + k)
                        rows.append((p, at // 4, len(cut) // 4, zlib.crc32(cut), (task * 31 + seen) % SALTS))
                        seen += 1
                        if ids:
                            kept.append(np.frombuffer(cut, dtype="<u4").astype(np.int32))
                cols = [batch.column(0).take(pa.array(of)), *[pa.array(c) for c in zip(*rows, strict=True)]] + ([pa.array(kept, pa.list_(pa.int32()))] if ids else [])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow_type, strict=True)], names=arrow_type.names)

    return plain.mapInArrow(run, out_type).withColumnRenamed("id", id_col)


class _Gaps:
    """Runs of sequences by the room that is left in them."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if not self.runs[gap]:
                insort(self.sizes, gap)
            self.runs[gap].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run (gap, first, count) of the smallest gap of at least that size."""
        k = bisect_left(self.sizes, least)
        if k == len(self.sizes):
            return None
        gap = self.sizes[k]
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.sizes[k]
        return gap, *run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, pieces, pieces a sequence, first sequence, offset). Ranks begin at 0;
    pieces of a row of the plan fill its sequences one after the other, each from the offset on."""
    left, used = dict(counts), dict.fromkeys(counts, 0)
    out, gaps, sequences = [], _Gaps(), 0

    def put(length: int, n: int, each: int, first: int, offset: int) -> None:
        out.append((length, used[length], n, each, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(n for n in counts if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            fits = [b for b in large[: bisect_left(large, min(a, capacity - a) + 1)] if left[b] and (b != a or left[a] > 1)]
            if not fits:
                put(a, n := left[a], 1, sequences, 0)
                gaps.add(capacity - a, sequences, n)
            else:
                b = fits[-1]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, n, 1, sequences, 0)
                put(b, n, 1, sequences, a)
                gaps.add(capacity - a - b, sequences, n)
            sequences += n
    for s in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[s]:
            run = gaps.take(s)
            if run is None:
                # new sequences, as many as the rest would fill
                run = capacity, sequences, -(-left[s] // (capacity // s))
                sequences += run[2]
            gap, first, count = run
            each = gap // s
            full = min(count, left[s] // each)
            if full:
                put(s, full * each, each, first, capacity - gap)
                gaps.add(gap - each * s, first, full)
            if full < count and left[s]:
                n = left[s]
                put(s, n, n, first + full, capacity - gap)
                gaps.add(gap - n * s, first + full, 1)
                full += 1
            gaps.add(gap, first + full, count - full)
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Per piece doc_id, piece, start (tokens of its document before it), length, ids_crc32, sequence_id and offset, and with ids its token_ids."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, id_col, text_col, capacity, end_id, ids), "pieces")
    # at most `capacity` rows, whatever the table
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = spark.createDataFrame(plan(counts, capacity), "length long, rank0 long, n long, each long, sequence0 long, at long")
    blocks = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("length").orderBy("salt"))
    blocks = blocks.withColumn("first", upto - F.col("size"))
    # only the places that a block's ranks meet
    met = (F.col("rank0") < F.col("first") + F.col("size")) & (F.col("rank0") + F.col("n") > F.col("first"))
    asked = blocks.join(F.broadcast(places), "length").filter(met)
    order = F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "piece", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("in_block", order).join(asked, ["length", "salt"])
    rank = F.col("first") + F.col("in_block") - F.col("rank0")
    placed = ranked.withColumn("r", rank).filter((F.col("r") >= 0) & (F.col("r") < F.col("n")))
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("sequence0") + F.floor(F.col("r") / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.col("r") % F.col("each") * F.col("length")).cast("long").alias("offset"), *(["token_ids"] if ids else []),
    )


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, n_tokens, token_ids, spans) of a packing with ids: what is trained on, with the documents' places in it."""
    span = F.struct("offset", "length", F.col(id_col).alias("id"), "piece", "token_ids")
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(span)).alias("s"))
    return held.select("sequence_id", "n_tokens", F.flatten("s.token_ids").alias("token_ids"), F.transform("s", lambda x: x.dropFields("token_ids")).alias("spans"))
