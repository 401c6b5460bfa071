"""SentencePiece encoding and decoding over tables of distinct chunks.

The model keeps white space as marks (U+2581) and no piece of its vocabulary has a mark after another character. A text is
therefore a row of chunks, each a run of marks and what follows up to the next mark, and no merge crosses a chunk's edge: the
pieces of a text are the pieces of its chunks in a row. Each task keeps a table of the distinct chunks that it has met, segments
a chunk when it first appears, and joins ids back to their texts by the chunks' positions. The table is bounded in bytes; once it is
full it is dropped, and chunks are segmented anew. Ids leave a task as flat Arrow arrays, a bounded slice of texts at a time. Texts are not shuffled. A model whose pieces cross marks is refused.

Decoding likewise joins the decoded chunks: bytes of byte-fallback pieces never join up across a mark.

Defined cases: a null text is the empty text, with no ids. Literal marks in a text are white space to the model, as in the
library. Very long texts are handled chunk by chunk; chunks of over MAX_KEPT characters are not kept in the table. Repeated rows
each give a row, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

MARK = "▁"
#: Bytes of a task's table, the longest chunk that it keeps, and the characters of texts that are cut up at a time.
TABLE_BYTES, MAX_KEPT, SLICE_CHARS = 32 << 20, 64, 500_000
#: What a table's entry takes besides its two strings.
_ENTRY = 110
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


@lru_cache(maxsize=2)
def processor(model: str):
    """The model, once per Python worker, after the test that its pieces stay within chunks and that texts are not rewritten."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.vocab_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces cross white space marks: {crossing[:5]}")
    if sp.decode(sp.encode(" ﬁ  x ")) != " ﬁ  x ":
        raise ValueError("the model rewrites its texts, so chunks can't be cut before that")
    return sp


class Table:
    """The distinct chunks of a task, each with its ids as decimals; and of the few that don't decode to themselves, what they decode to."""

    def __init__(self, model: str, most: int = TABLE_BYTES):
        self.sp, self.most = processor(model), most
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, str] = {}
        self.back: dict[str, str] = {}
        self.bytes = 0

    def _drop(self, c: str) -> None:
        self.bytes -= sys.getsizeof(c) + sys.getsizeof(self.ids.pop(c)) + _ENTRY
        self.back.pop(c, None)

    def learn(self, chunks: list[str]) -> None:
        # the library puts one mark before each text: that stands for the chunk's first
        ids = self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        # a single space mark ("one mark and no more") encodes as the empty text would, so it is looked up instead
        lone = self.sp.piece_to_id(MARK)
        ids = [x if c != MARK else [lone] for c, x in zip(chunks, ids, strict=True)]
        # decode() leaves out the mark that begins a text; a mark put in front keeps the chunk's own
        back = self.sp.decode([[lone, *x] for x in ids], num_threads=1)
        for c, x, t in zip(chunks, ids, back, strict=True):
            told = ",".join(map(str, x))
            self.ids[c] = told
            self.bytes += sys.getsizeof(c) + sys.getsizeof(told) + _ENTRY
            if t != c.replace(MARK, " "):
                self.back[c] = t
                self.bytes += sys.getsizeof(t) + _ENTRY

    def rows(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids joined by commas, and the decoded text."""
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        every = set().union(*cut)
        new = list(every.difference(self.ids))
        if self.bytes > self.most:
            self._clear()
            new = list(every)
        self.learn(new)
        look = self.ids.__getitem__
        for t, x in zip(texts, cut, strict=True):
            plain = self.back.keys().isdisjoint(x)
            yield ",".join(map(look, x)), t.replace(MARK, " ") if plain else "".join(self.back.get(c) or c.replace(MARK, " ") for c in x)[1:]
        for c in new:
            if len(c) > MAX_KEPT:
                self._drop(c)


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of together at most so many characters, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text in UTF-8), and
    with ids the array of ids itself, token_ids."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    fields = [plain.schema["id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    out_type = StructType(fields + ([StructField("token_ids", ArrayType(IntegerType()))] if ids else []))
    arrow_type = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(model)
        for whole in batches:
            lengths = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_CHARS):
                n, digests, backs, arrays = [], [], [], []
                for told, back in table.rows([t or "" for t in whole.column(1).slice(a, b - a).to_pylist()]):
                    arrays.append(np.fromstring(told, dtype=np.int32, sep=","))
                    n.append(len(arrays[-1]))
                    digests.append(hashlib.sha256(told.encode()).hexdigest())
                    backs.append(hashlib.sha256(back.encode()).hexdigest())
                cols = [whole.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), np.concatenate(arrays)).cast(arrow_type.field(4).type))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow_type, strict=True)], names=arrow_type.names)

    return plain.mapInArrow(run, out_type).withColumnRenamed("id", id_col)


def small_batches(pdf: pd.DataFrame, text: str, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Slices of at most so many characters of text, or of one row."""
    size = pdf[text].str.len().fillna(0).cumsum()
    for _, part in pdf.groupby((size // most).to_numpy(), sort=True):
        yield part


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id_col and text: what the library's decode gives for the ids; the empty text for null ids."""
    id_type = encoded.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = processor(model)
        for pdf in batches:
            ids = [[] if x is None else [int(i) for i in x] for x in pdf["x"]]
            yield pd.DataFrame({"id": pdf["id"], "text": sp.decode(ids, num_threads=1) if ids else []})

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("x")).mapInPandas(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)
