"""N-gram Jaccard self-join of documents by MinHash banding.

1. Each text becomes its set of five-word n-grams (lower-cased words; a shorter text is one n-gram). Texts with equal sets form a
   class, named by a digest of the set and represented by its least id: copies go no further.
2. MinHash signatures of the representatives, cut into bands. The numbers of bands and rows are the cheapest that find a pair at
   the threshold with the target recall. The shuffle is on the band hashes: a bucket is aggregated to its least id, and each
   member is tied to that one, so a bucket of any size gives as many ties as members.
3. Ties make candidate groups (least-label propagation with pointer jumping). Within a group all pairs are verified on the full
   n-gram sets, in blocks: a large group is cut into blocks of bounded size, and each pair of blocks is one task's work. There
   only texts of like size that share a rare n-gram are compared, which loses no pair at the threshold. Pairs are counted and
   joined up there; they are never rows.
4. Verified links make the classes of the result.

So every pair of one candidate group at the threshold counts, even if its own bands all differ. The work on k texts that really are
alike grows with the square of k, in numpy, as does any exact count of their links; what merely shares a passage costs only
its reading. Rows and bytes moved grow with k times its number of blocks.

n-grams are compared by 64-bit hashes of their words, sets and classes are named by 128 bits.

Defined cases: null and empty texts have no n-grams and no links; each is a class of its own. So is a document without an id, whose
class has no name either. Repeated ids are one document per row for links, and give one result row each. Extra columns are ignored.
Ids are whole numbers: an id that does not read as one raises. A very long text is a block by itself. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import BROADCAST_ROWS, small_enough, text_of, written
from tidegrid.llm.sentencepieces import small_batches
from tidegrid.llm.shingling import distinct_sets, mixed, ngram_hashes, word_hashes

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: A block of a candidate group: at most so many texts, and so many characters, on average.
BLOCK_TEXTS, BLOCK_CHARS = 512, 4_000_000
#: Texts whose pairs are counted at once.
_TILE = 256


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def choose(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> Banding:
    """The banding with the most rows a band, so the fewest false candidates, that reaches the recall at the threshold with at most so many hashes."""
    out = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows > most:
            break
        out = Banding(bands, rows)
    if out is None:
        raise ValueError(f"no banding of {most} hashes reaches a recall of {recall} at {threshold}")
    return out


def _seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_hashes(sets: np.ndarray, bounds: np.ndarray, banding: Banding) -> np.ndarray:
    """A row of band hashes for each set; sets without members must have been left out."""
    seeds = _seeds(banding.bands * banding.rows)
    out = np.zeros((len(bounds) - 1, banding.bands), dtype=np.uint64)
    for b in range(banding.bands):
        acc = np.full(len(bounds) - 1, b + 1, dtype=np.uint64)
        for r in range(banding.rows):
            # the high half of a product with an odd seed of well-mixed values
            least = np.minimum.reduceat((sets * seeds[b * banding.rows + r]) >> np.uint64(32), bounds[:-1])
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, b] = acc
    return out


def n_gram_sets(texts: pd.Series, n: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sets(*ngram_hashes(*word_hashes(texts.tolist()), n))


def set_digests(sets: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits that name each set; null for the empty one."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out: list[bytes | None] = [None] * (len(bounds) - 1)
    if len(full):
        starts = bounds[:-1][full]
        one = np.add.reduceat(mixed(sets), starts)
        two = np.bitwise_xor.reduceat(mixed(sets + np.uint64(0x51ED270B7F4A7C15)), starts)
        for k, x, y in zip(full, one, two, strict=True):
            out[k] = int(x).to_bytes(8, "big") + int(y).to_bytes(8, "big")
    return out


def signatures(docs: DataFrame, n: int = N, banding: Banding | None = None) -> DataFrame:
    """For (id, t): row, set digest (null without n-grams), number of characters, and band hashes."""
    banding = banding or choose()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in small_batches(whole, "t", 1_000_000):
                sets, bounds = n_gram_sets(pdf["t"], n)
                full = np.flatnonzero(np.diff(bounds) > 0)
                digest, bands = set_digests(sets, bounds), [None] * len(pdf)
                if len(full):
                    for k, h in zip(full, band_hashes(sets, np.concatenate([bounds[:-1][full], bounds[-1:]]), banding).astype(np.int64), strict=True):
                        bands[k] = h
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "chars": pdf["t"].str.len().to_numpy(), "digest": digest, "bands": bands})

    return docs.select("id", "t").mapInPandas(run, "id long, chars long, digest binary, bands array<long>")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, label) of every id in edges (a, b): the least id of its component.

    Each round gives every id the least label among itself and its neighbours and then leaps to that label's own label; labels
    are written to the shared folder each round. Hubs are no trouble: a label is a partial aggregate."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        around = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"))
        new = labels.join(around, "id").select("id", F.least("label", "least").alias("next"), F.col("label").alias("old"))
        leap = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        after = written(new.join(leap, "next", "left").select("id", F.least("next", "far").alias("label"), "old"), "labels")
        moved = not after.filter("label <> old").isEmpty()
        labels = after.select("id", "label")
        if not moved:
            return labels
    raise RuntimeError(f"components were not done after {rounds} rounds")


def _sharing(size: np.ndarray, code: np.ndarray, text: np.ndarray, uses: np.ndarray, threshold: float) -> np.ndarray:
    """A number a text, the same for all texts that a chain of shared rare n-grams ties together; -1 for a text that shares none.

    Two sets at the threshold share one of the first |x| - ceil(threshold |x|) + 1 n-grams of each, in any order that both keep: here the
    rarest come first, so what all texts of a group have in common ties nobody."""
    order = np.lexsort((code, uses[code], text))
    code, text = code[order], text[order]
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    ahead = place <= size[text] - np.ceil(threshold * size[text] - 1e-6)
    code, text = code[ahead], text[ahead]
    held = np.bincount(code, minlength=len(uses)) > 1
    code, text = code[held[code]], text[held[code]]
    label = np.full(len(size), -1)
    label[text] = text
    by_code, by_text = np.argsort(code, kind="stable"), np.argsort(text, kind="stable")
    if not len(code):
        return label
    code_starts = np.flatnonzero(np.diff(code[by_code], prepend=-1))
    text_starts = np.flatnonzero(np.diff(text[by_text], prepend=-1))
    slot = np.empty(len(code), dtype=np.int64)
    slot[by_code] = np.repeat(np.arange(len(code_starts)), np.diff(code_starts, append=len(code)))
    while True:
        least = np.minimum.reduceat(label[text[by_code]], code_starts)
        new = label.copy()
        new[text[by_text][text_starts]] = np.minimum.reduceat(least[slot[by_text]], text_starts)
        if (new == label).all():
            return label
        label = new


def _similar_pairs(sets: list[np.ndarray], groups: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x < y) of one group at the threshold, only those across sides if sides are given: counted among texts that rare n-grams tie
    together, a sort by size ahead, and only as far as sizes may reach the threshold."""
    none = np.zeros(0, dtype=np.int64)
    if side is not None and (side.all() or not side.any()):
        # the other block is empty
        return none, none
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    text = np.repeat(np.arange(len(sets)), size)
    tied = _sharing(size, code, text, np.bincount(code), threshold)
    found = [(none, none)]
    order = np.lexsort((size, tied))
    order = order[tied[order] >= 0]
    for members in np.split(order, np.flatnonzero(np.diff(tied[order])) + 1) if len(order) else ():
        for at in range(0, len(members), _TILE):
            mine = members[at : at + _TILE]
            # sizes rise: what is too large for the last of these is too large for all
            reach = np.searchsorted(threshold * size[members], size[mine[-1]] + 1e-6, side="right")
            for other in range(at, int(reach), _TILE):
                theirs = members[other : min(other + _TILE, int(reach))]
                both = np.concatenate([mine, theirs]) if other > at else mine
                if len(both) > 1 and (side is None or (side[both].any() and not side[both].all())):
                    x, y = _counted([sets[k] for k in both], size[both], groups[both], None if side is None else side[both], threshold)
                    across = (x < len(mine)) & (y >= len(mine)) if other > at else np.ones(len(x), dtype=bool)
                    found.append((both[x[across]], both[y[across]]))
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    return np.minimum(x, y), np.maximum(x, y)


def _counted(sets: list[np.ndarray], size: np.ndarray, groups: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x < y) at the threshold by counting what each two texts share.

    An inverted index over the n-grams: those of few texts give their pairs one by one, those of many texts are multiplied as a matrix."""
    n = len(sets)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    text = np.repeat(np.arange(n), size)
    order = np.lexsort((text, code))
    code, text = code[order], text[order]
    uses = np.bincount(code)
    shared = np.zeros((n, n), dtype=np.float32)
    heavy = np.flatnonzero(uses > 24)
    for k in range(0, len(heavy), 4096):
        part = heavy[k : k + 4096]
        slot = np.full(len(uses), -1)
        slot[part] = np.arange(len(part))
        mine = slot[code] >= 0
        m = np.zeros((n, len(part)), dtype=np.float32)
        m[text[mine], slot[code[mine]]] = 1
        shared += m @ m.T
    light = uses[code] <= 24
    code, text = code[light], text[light]
    for step in range(1, 24):
        # the postings of a light n-gram stand side by side: compare each with the one `step` places on
        same = np.flatnonzero(code[step:] == code[:-step])
        if not len(same):
            break
        at, times = np.unique(text[same] * n + text[same + step], return_counts=True)
        shared.ravel()[at] += times
    x, y = np.nonzero(np.triu(shared, 1))
    j = shared[x, y]
    ok = (j >= threshold * (size[x] + size[y] - j) - 1e-6) & (groups[x] == groups[y])
    if side is not None:
        ok &= side[x] != side[y]
    return x[ok], y[ok]


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Of the links, as many as join the same texts up."""
    root = list(range(n))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        p, q = top(a), top(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            yield a, b


def links(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(rep, digest, weight, t, comp, block) by batch and pair of blocks, to rows of two kinds: for each text the number of
    documents it links to (b null), and links (rep, b) that join up what is linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # an id with several texts brings all of them: the class's own is the one with its digest, and once is enough
        own = [x == bytes(y) for x, y in zip(set_digests(*n_gram_sets(pdf["t"], n)), pdf["digest"], strict=True)]
        pdf = pdf[own].drop_duplicates("rep").sort_values("rep")
        sets, bounds = n_gram_sets(pdf["t"], n)
        rep, weight = pdf["rep"].to_numpy(), pdf["weight"].to_numpy()
        # pairs within a block are those of the batch (i, i)
        side = (pdf["block"] != pdf["i"]).to_numpy() if (pdf["i"] != pdf["j"]).any() else None
        x, y = _similar_pairs([sets[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], pd.factorize(pdf["comp"])[0], side, threshold)
        count = np.bincount(x, weight[y], len(rep)) + np.bincount(y, weight[x], len(rep))
        some = np.flatnonzero(count)
        joined = list(_forest(x, y, len(rep)))
        return pd.DataFrame({
            "rep": [*rep[some], *(rep[a] for a, _ in joined)], "b": pd.Series([*[None] * len(some), *(rep[b] for _, b in joined)], dtype=object),
            "n": [*count[some].astype(np.int64), *[0] * len(joined)],
        })

    return texts.groupBy("large", "key", "i", "j").applyInPandas(run, "rep binary, b binary, n long")


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
    bound: int = BROADCAST_ROWS, block_texts: int = BLOCK_TEXTS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """For each row of docs: its id, class_id (the least id of all that links tie together, itself included), set_id (the least id
    with the same n-gram set) and n_links (documents of similarity at least threshold, itself not counted)."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    signed = written(signatures(plain, n, choose(threshold, recall)), "signatures")
    classes = written(
        signed.filter("digest is not null and id is not null").groupBy("digest").agg(
            F.min("id").alias("set_id"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands"), F.max("chars").alias("chars")
        ).withColumn("rep", F.col("digest")), "classes",
    )
    rows = classes.select("rep", F.posexplode("bands").alias("k", "h"))
    buckets = rows.groupBy("k", "h").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("k", "h", "a")
    ties = rows.join(written(buckets, "buckets"), ["k", "h"]).filter("rep <> a").select("a", F.col("rep").alias("b"))
    groups = components(ties)
    members = written(groups.join(classes.drop("bands"), groups.id == classes.rep).drop("id"), "members")
    sizes = written(members.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("all")), "sizes")
    total = sizes.agg(F.sum("all"), F.sum("texts")).first()
    # groups that fit into a block share a task's batch with others; the number of batches follows the texts and characters
    batches = max(1, math.ceil((total[0] or 0) / block_chars), math.ceil((total[1] or 0) / (2 * block_texts)))
    cut = F.ceil(F.greatest(F.col("texts") / block_texts, F.col("all") / block_chars)).cast("int")
    placed = written(
        members.join(sizes, "label").withColumn("blocks", F.greatest(F.lit(1), cut)).select(
            "rep", "digest", "set_id", "weight", F.col("label").alias("comp"), "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
            (F.col("blocks") > 1).alias("large"), F.when(F.col("blocks") > 1, F.xxhash64("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(batches))).alias("key"),
        ), "placed",
    )
    texts = plain.join(F.broadcast(placed) if small_enough(placed, bound) else placed, plain.id == F.col("set_id")).drop("id", "set_id")
    pairs = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    verified = written(links(pairs.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o", "blocks"), n, threshold), "links")
    linked = verified.filter("b is null").groupBy("rep").agg(F.sum("n").alias("n"))
    labels = components(verified.filter("b is not null").select(F.col("rep").alias("a"), "b")).withColumnRenamed("id", "rep")
    named = classes.select("digest", "rep", "set_id", "weight").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    least = named.groupBy("label").agg(F.min("set_id").alias("class_id"))
    found = written(named.join(written(least, "class-ids"), "label").join(linked, "rep", "left").select(
        "digest", "set_id", "class_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links")
    ), "found")
    return signed.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(found, "digest", "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("set_id", "id").alias("set_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", bound: int = BROADCAST_ROWS, **kw) -> DataFrame:
    """docs with one document of each class, that of the least id. Rows that share an id stay or go together: they stay if one of
    them is the least of its class."""
    judged = join(docs, id_col, bound=bound, **kw).groupBy(id_col).agg(F.max(F.col(id_col) == F.col("class_id")).alias("stays"))
    dropped = written(judged.filter(~F.col("stays")).select(id_col), "near-copies")
    return docs.join(F.broadcast(dropped) if small_enough(dropped, bound) else dropped, id_col, "left_anti")
