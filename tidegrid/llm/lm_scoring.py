"""Cross-entropy difference of two n-gram language models.

A target model is counted over the documents that are wanted more of, a background model over all documents. They are matched:
one vocabulary, words and word pairs named by 64-bit keys, the same smoothing, and background counts scaled to the target's number
of tokens. A document's score is the mean over its tokens of the background's loss less the target's: above zero it is nearer to
the target. A document's own occurrences are taken off every count that it is scored by, so that no model knows it by heart; the
models' totals stay. The smoothing assumes a vocabulary of UNIGRAMS words, or of all distinct ones if there are more.

Every word and pair has its own count, however many there are. The frequent ones, at most HOT_WORDS and HOT_PAIRS by count, are
counted first and go to every task by broadcast: their tokens are scored where they are read. All others are shuffled, once, as
n-grams distinct in their document: by the word if it is rare, by the pair if only that is. So whatever gets the same key meets in
one partition, which counts it and scores it at once, and returns sums by document. Those n-grams and sums go packed in arrays, a
batch of documents and a partition each; partitions grow in number with the input. What is gathered grows with the input.

Which n-grams are broadcast (pairs: those frequent in a sample) moves work, not results. Documents are named by a 64-bit hash of the
text and of whether they are wanted: equal ones score equally.

Defined cases: a text without words has n_tokens 0 and null losses. Without target documents the target's counts are all zero, and
its losses those of a uniform distribution. Null ids are never target. Repeated rows count and are scored each. A very long text is
a batch by itself. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import BROADCAST_ROWS, small_enough, text_of, written
from tidegrid.llm.sentencepieces import small_batches
from tidegrid.llm.shingling import mixed, word_hashes

#: The least size of vocabulary that smoothing assumes.
UNIGRAMS = 1 << 18
#: Most words and pairs that are broadcast, tokens in the sample that the pairs are picked from, and tokens a partition.
HOT_WORDS, HOT_PAIRS, SAMPLE, PART_TOKENS = 1 << 17, 1 << 18, 4_000_000, 600_000
#: Characters of texts that are read at a time.
BATCH_CHARS = 2_000_000
#: Added counts of a word, and the weight in tokens of the word model under the pair model.
ADDED, PRIOR = 0.5, 4.0
_START = np.uint64(0x1F3D5B79)
_NAMES = ("target", "background")


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, pair) keys of all tokens, and the texts' bounds; the word before a first word is the start."""
    words, bounds = word_hashes(texts)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = _START
    return words, before, mixed(before * np.uint64(3) + words), bounds


def _last(bounds: np.ndarray) -> np.ndarray:
    """Which tokens end their text."""
    out = np.zeros(bounds[-1], dtype=bool)
    out[bounds[1:][np.diff(bounds) > 0] - 1] = True
    return out


def _occurrences(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How often each (doc, x) occurs, at every place where it does."""
    order = np.lexsort((x, doc))
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(x), dtype=np.int64)
    out[order] = np.bincount(group)[group] if len(x) else 0
    return out


def _rows(key: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, as signed ones, and the sums of each."""
    keys, at = np.unique(key, return_inverse=True)
    return keys.view(np.int64), *(np.bincount(at, s, len(keys)).astype(np.int64) for s in sums)


def word_counts(docs: DataFrame) -> DataFrame:
    """(t, wanted) to (key, background, target, before, before_target) of each distinct word: occurrences, and those as the word before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in small_batches(whole, "t"):
                word, _, _, bounds = buckets(pdf["t"].tolist())
                n = np.diff(bounds)
                own = pdf["wanted"].to_numpy(dtype=bool)
                wanted, follows = np.repeat(own, n), ~_last(bounds)
                got = _rows(word, np.ones(len(word)), wanted, follows, follows & wanted)
                start = np.array([int(_START), 0, 0, (n > 0).sum(), (own & (n > 0)).sum()])
                yield pd.DataFrame({c: np.append(x, s) for c, x, s in zip(("key", "background", "target", "before", "before_target"), got, start, strict=True)})

    each = docs.select("t", "wanted").mapInPandas(run, "key long, background long, target long, before long, before_target long")
    return each.groupBy("key").agg(*(F.sum(c).alias(c) for c in each.columns[1:]))


def _frequent(table: DataFrame, weight: Column, most: int) -> DataFrame:
    """Rows of the largest weights, at most so many: those above a cut found by counting rows by order of size."""
    size = F.floor(F.log2(weight.cast("double")) * 4).cast("int")
    cut, total = math.inf, 0
    for s, n in sorted(table.filter(weight > 0).groupBy(size.alias("s")).agg(F.count(F.lit(1))).collect(), reverse=True):
        total += n
        if total > most:
            break
        cut = s
    return table.filter((weight > 0) & (size >= cut)) if cut < math.inf else table.limit(0)


def _arrays(table: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a small table, in the order of its unsigned keys."""
    got = table.toArrow()
    col = {c: got[c].to_numpy() for c in got.column_names}
    col["key"] = col["key"].astype(np.int64).view(np.uint64)
    order = np.argsort(col["key"])
    return {c: x[order] for c, x in col.items()}


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, whether it is there) of each x."""
    if not len(keys):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


@dataclass
class Models:
    """What every task knows of both models: totals, and the counts of frequent words and pairs."""

    words: dict[str, np.ndarray]
    pairs: dict[str, np.ndarray]
    tokens: dict[str, int]
    vocabulary: int

    def scale(self, name: str) -> float:
        n = self.tokens
        return 1.0 if name == "target" else (n["target"] or n["background"]) / max(1, n["background"])

    def one(self, name: str, count: np.ndarray) -> np.ndarray:
        """A word's probability from its count."""
        s = self.scale(name)
        return (count * s + ADDED) / (self.tokens[name] * s + ADDED * self.vocabulary)

    def pair_loss(self, name: str, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What the counts of a pair and its word add to the loss."""
        return -np.log(pair * self.scale(name) + PRIOR * self.one(name, word))

    def before_loss(self, name: str, count: np.ndarray) -> np.ndarray:
        """What the count of the word before adds."""
        return np.log(count * self.scale(name) + PRIOR)


def _pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: those of small numbers are runs of zeros."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    """Arrays of the same length out of their packed forms, one after the other."""
    sizes = [np.dtype(t).itemsize for t in types]
    n = len(blob) // sum(sizes)
    out, at = [], 0
    for t, s in zip(types, sizes, strict=True):
        planes = np.frombuffer(blob, dtype=np.uint8, count=n * s, offset=at).reshape(s, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += n * s
    return out


#: key (as the step from the one before), the other word (by its place if it is frequent, else its key), document, occurrences of the pair and of the word in it; 1 if the word is rare, 2 if the document is wanted, 4 if the pair ends it
_ENTRY = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint8)
_DOC = (np.uint64, np.uint32, np.float64, np.float64)
_SUM = (np.uint32, np.float64, np.float64)
_BLOBS = "part int, batch long, kind int, blob binary"


def _read(pdf: pd.DataFrame, models: Models, parts: int, batch: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of kind 0, documents with what frequent n-grams add to their losses, and of kind 1, the other n-grams by partition."""
    word, before, pair, bounds = buckets(pdf["t"].tolist())
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    wanted = np.repeat(pdf["wanted"].to_numpy(dtype=bool), n)
    w, known = _find(models.words["key"], word)
    b, known_before = _find(models.words["key"], before)
    p, known_pair = _find(models.pairs["key"], pair)
    done = known & known_pair
    # what a document wrote itself does not count for it
    own_word, own_pair = _occurrences(doc, word), _occurrences(doc, pair)
    own_before = _occurrences(doc, before)
    sums = []
    for name, c, mine in zip(_NAMES, ("before_target", "before"), (wanted, np.ones(len(doc), dtype=bool)), strict=True):
        k = known_before
        sums.append(
            np.bincount(doc[k], models.before_loss(name, models.words[c][b[k]] - own_before[k] * mine[k]), len(n))
            + np.bincount(doc[done], models.pair_loss(name, models.pairs[name][p[done]] - own_pair[done] * mine[done], models.words[name][w[done]] - own_word[done] * mine[done]), len(n))
        )
    digests = pdf["digest"].to_numpy().astype(np.int64).view(np.uint64)
    yield batch % parts, batch, 0, b"".join(map(_pack, (digests, n.astype(np.uint32), *sums)))

    left = np.flatnonzero(~done)
    left = left[np.lexsort((pair[left], doc[left]))]
    if not len(left):
        return
    new = np.ones(len(left), dtype=bool)
    new[1:] = (pair[left][1:] != pair[left][:-1]) | (doc[left][1:] != doc[left][:-1])
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(left)))
    ends = np.add.reduceat(_last(bounds)[left].astype(np.int64), start)
    at = left[start]
    rare = ~known[at]
    key = np.where(rare, word[at], pair[at])
    order = np.argsort(key)
    entry = [
        key, np.where(rare, np.where(known_before[at], b[at].astype(np.uint64), before[at]), w[at].astype(np.uint64)), doc[at].astype(np.uint32), times.astype(np.uint32), own_word[at].astype(np.uint32),
        rare.astype(np.uint8) + np.uint8(2) * wanted[at].astype(np.uint8) + np.uint8(4) * ends.astype(np.uint8),
    ]
    entry = [x[order] for x in entry]
    part = ((entry[0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for lo, hi in zip(first, np.append(first[1:], len(part)), strict=True):
        yield int(part[lo]), batch, 1, b"".join(map(_pack, (np.diff(entry[0][lo:hi], prepend=np.uint64(0)), *(x[lo:hi] for x in entry[1:]))))


def _counted(pdf: pd.DataFrame, models: Models) -> Iterator[tuple[int, int, int, bytes]]:
    """All n-grams of a partition, counted and scored: rows of kind 2, what they add to the losses of a batch's documents."""
    blobs = [_unpack(x, *_ENTRY) for x in pdf["blob"]]
    if not blobs:
        return
    for x in blobs:
        x[0] = np.cumsum(x[0], dtype=np.uint64)
    key, aux, doc, times, own, flags = (np.concatenate(x) for x in zip(*blobs, strict=True))
    where = np.repeat(np.arange(len(blobs)), [len(x[0]) for x in blobs]) * np.int64(1 << 32) + doc
    n_blobs = len(blobs)
    del blobs, doc
    order = np.lexsort((where, key))
    key, aux, times, own, flags, where = (x[order] for x in (key, aux, times.astype(np.int64), own.astype(np.int64), flags, where))
    rare, wanted = (flags & 1) > 0, (flags & 2) > 0
    follows = times - ((flags & 4) > 0)
    new_key = np.append(True, key[1:] != key[:-1])
    of_key = np.cumsum(new_key) - 1
    of_doc = np.cumsum(new_key | np.append(True, where[1:] != where[:-1])) - 1
    own_before = np.bincount(of_doc, follows)[of_doc]
    pairs = np.lexsort((aux, key))
    of_pair = np.empty(len(key), dtype=np.int64)
    of_pair[pairs] = np.cumsum(np.append(True, (key[pairs][1:] != key[pairs][:-1]) | (aux[pairs][1:] != aux[pairs][:-1]))) - 1
    place = aux[~rare].astype(np.int64)
    del order, pairs, aux
    losses = []
    for name, mine in zip(_NAMES, (wanted, np.ones(len(key), dtype=bool)), strict=True):
        n, f = times * mine, follows * mine
        word = np.bincount(of_key, n)[of_key]
        word[~rare] = models.words[name][place]
        loss = times * models.pair_loss(name, np.bincount(of_pair, n)[of_pair] - n, word - own * mine)
        loss[rare] += (follows * models.before_loss(name, np.bincount(of_key, f)[of_key] - own_before * mine))[rare]
        losses.append(loss)
    where, to = np.unique(where, return_inverse=True)
    target, background = (np.bincount(to, x) for x in losses)
    cuts = np.searchsorted(where >> 32, np.arange(n_blobs + 1))
    some = (where & 0xFFFFFFFF).astype(np.uint32)
    for batch, lo, hi in zip(pdf["batch"], cuts, cuts[1:], strict=False):
        yield 0, batch, 2, b"".join(_pack(x[lo:hi]) for x in (some, target, background))


def _frame(rows: Iterator[tuple[int, int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["part", "batch", "kind", "blob"])


def models_of(docs: DataFrame, hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS) -> Models:
    """Totals and frequent n-grams of (id, t, wanted)."""
    spark = docs.sparkSession
    counted = written(word_counts(docs), "words")
    start = F.col("key") == int(_START)
    total = counted.agg(F.sum("background"), F.sum("target"), F.count(F.when(~start, 1))).first()
    words = _arrays(_frequent(counted.filter(~start), F.col("background"), hot_words).union(counted.filter(start)))
    tokens = {"background": total[0] or 0, "target": total[1] or 0}
    keys = spark.sparkContext.broadcast(words["key"])

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in small_batches(whole, "t"):
                word, _, pair, _ = buckets(pdf["t"].tolist())
                pair = pair[_find(keys.value, word)[1]]
                yield pd.DataFrame(dict(zip(("key", "n"), _rows(pair, np.ones(len(pair))), strict=True)))

    some = docs.filter(F.pmod(F.xxhash64("id", "t"), F.lit(max(1, tokens["background"] // SAMPLE))) == 0)
    sampled = written(some.select("t").mapInPandas(candidates, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"), "sampled-pairs")
    picked = spark.sparkContext.broadcast(_arrays(_frequent(sampled, F.col("n"), hot_pairs))["key"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = picked.value
        sums = np.zeros((2, len(own)), dtype=np.int64)
        for whole in batches:
            for pdf in small_batches(whole, "t"):
                _, _, pair, bounds = buckets(pdf["t"].tolist())
                at, there = _find(own, pair)
                wanted = np.repeat(pdf["wanted"].to_numpy(dtype=bool), np.diff(bounds))
                sums[0] += np.bincount(at[there], minlength=len(own))
                sums[1] += np.bincount(at[there & wanted], minlength=len(own))
        some = np.flatnonzero(sums[0])
        yield pd.DataFrame({"key": own[some].view(np.int64), "background": sums[0][some], "target": sums[1][some]})

    each = docs.select("t", "wanted").mapInPandas(count, "key long, background long, target long")
    pairs = _arrays(written(each.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target")), "pairs"))
    return Models(words, pairs, tokens, max(UNIGRAMS, total[2]))


def score(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BROADCAST_ROWS,
    hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS, part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """For each row: its id, n_tokens, loss_target and loss_background (nats a token) and score, their difference."""
    wanted = written(target_ids.select(F.col(id_col).alias("id")).filter("id is not null").distinct().withColumn("wanted", F.lit(True)), "targets")
    plain = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    small = small_enough(wanted, bound)
    marked = plain.join(F.broadcast(wanted) if small else wanted, "id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False))).withColumn("digest", F.xxhash64("t", "wanted"))
    if not small:
        # batches are named by their place: a shuffled table has to keep its order
        marked = written(marked, "marked")
    models = models_of(marked, hot_words, hot_pairs)
    parts = max(1, math.ceil(models.tokens["background"] / part_tokens))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = TaskContext.get().partitionId() << 32
        for whole in batches:
            for pdf in small_batches(whole, "t", BATCH_CHARS):
                yield _frame(_read(pdf, shared.value, parts, batch))
                batch += 1

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        ngrams = pdf["kind"] == 1
        return pd.concat([pdf[~ngrams], _frame(_counted(pdf[ngrams], shared.value))])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        digest, n, target, background = _unpack(pdf["blob"][pdf["kind"] == 0].iloc[0], *_DOC)
        for x in pdf["blob"][pdf["kind"] == 2]:
            doc, t, b = _unpack(x, *_SUM)
            target[doc] += t
            background[doc] += b
        return pd.DataFrame({"digest": digest.view(np.int64), "n": n.astype(np.int64), "target": target, "background": background})

    sums = marked.select("t", "wanted", "digest").mapInPandas(read, _BLOBS).groupBy("part").applyInPandas(counted, _BLOBS)
    each = sums.groupBy("batch").applyInPandas(summed, "digest long, n long, target double, background double")
    mean = lambda c: F.when(F.sum("n") > 0, F.sum(c) / F.sum("n"))
    by_text = each.groupBy("digest").agg(F.max("n").alias("n_tokens"), *(mean(c).alias(f"loss_{c}") for c in _NAMES))
    scored = marked.select("id", "digest").join(written(by_text, "losses"), "digest", "left")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "loss_target", "loss_background", (F.col("loss_background") - F.col("loss_target")).alias("score"))
