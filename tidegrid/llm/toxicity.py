"""Toxicity by compression distance.

Two zstandard dictionaries are made of labelled texts. Both begin with the same ordinary text; the toxic one ends with the segments
that toxic texts have and ordinary ones hardly do, the ordinary one with as many neutral bytes. A text is cut into windows of words;
a window that the toxic dictionary makes shorter than the ordinary one is nearer to toxic text. The distances of all of a text's
windows are summed up in a few measures, and thresholds on these are calibrated by a logistic regression on labelled texts that
took no part in the dictionaries.

Dictionaries that zstandard itself trains on the whole texts of each class tell them apart less well, as most of a toxic text is
ordinary: the README has the figures of both, taken on rows that may be learned from. The parameters below were chosen on those too.

Training takes a bounded sample: at most SAMPLE_ROWS rows of a label, chosen by a hash of their id, of texts up to SAMPLE_CHARS
characters. Near copies among them count once. Scoring reads whole texts of any length.

Defined cases: a null or empty text has no window and gets the score of a text without toxic ones. Without any toxic or any
ordinary row to learn from, all scores are 0. Repeated rows each give a row, extra columns are ignored, an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import text_of
from tidegrid.llm.sentencepieces import small_batches

SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
#: Words in a window; bytes of ordinary text in both dictionaries; most segments of the toxic one.
WORDS, BASE_BYTES, SEGMENTS = 12, 12_000, 300
#: A segment: its least length, the least ratio of its shares in toxic and ordinary texts, and the least evidence (texts times log ratio).
SHORTEST, RATIO, EVIDENCE = 4, 8.0, 30.0
PREDICTED = 0.7
#: Per cent of the sample that the dictionaries are made of.
DICTIONARY_SHARE = 60


def _segments(text: str) -> set[str]:
    """Words, and the beginnings of words."""
    out = set()
    for w in set(re.findall(r"\w+", text.lower())):
        w = w[:24]
        out.update(w[:n] for n in range(SHORTEST, min(len(w), 13)))
        if len(w) >= SHORTEST:
            out.add(w)
    return out


def _one_of_copies(texts: list[str]) -> list[str]:
    """Texts whose least hash of a run of four words has not come before: near copies mostly share it."""
    seen: dict[int, str] = {}
    for t in texts:
        w = t.lower().split()
        seen.setdefault(min((zlib.crc32(" ".join(w[i : i + 4]).encode("utf-8", "replace")) for i in range(max(1, len(w) - 3))), default=0), t)
    return list(seen.values())


def telling(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Segments of toxic texts that ordinary ones hardly have, the most telling first; none holds another."""
    a, b = Counter(), Counter()
    for t in toxic:
        a.update(_segments(t))
    for t in ordinary:
        b.update(_segments(t))
    found = []
    for s, n in a.items():
        ratio = (n / len(toxic)) / ((b[s] + 0.5) / len(ordinary))
        if ratio >= RATIO and n * np.log(ratio) >= EVIDENCE:
            found.append((n * np.log(ratio), s))
    found.sort(key=lambda x: (-x[0], x[1]))
    chosen: list[str] = []
    for _, s in found:
        if len(chosen) < SEGMENTS and not any(o in s or s in o for o in chosen):
            # the longest segment around it that is about as common
            chosen.append(max((e for _, e in found if s in e and a[e] >= 0.9 * a[s]), key=lambda e: (len(e), e)))
    return chosen


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        how = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_LAZY2, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (self.toxic, self.ordinary)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def measures(text: str, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> list[float]:
    """Of the distances of all windows: largest, mean of the three largest, mean, shares and numbers beyond thresholds."""
    words = text.lower().split()
    d = [0]
    if words:
        cut = [" ".join(words[i : i + WORDS]).encode("utf-8", "replace") for i in range(0, len(words), WORDS)]
        short, long = toxic.compress, ordinary.compress
        d = [len(long(x)) - len(short(x)) for x in cut]
    v = np.sort(np.array(d, dtype=np.float32))
    over = [float((v >= k).sum()) for k in (1, 2, 3, 4, 6)]
    return [float(v[-1]), float(v[-3:].mean()), float(v.mean()), *(x / len(v) for x in over), *(float(np.log1p(x)) for x in over), float(np.log1p(len(v)))]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ z + penalty * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, spread, w


def _dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    toxic, ordinary = _one_of_copies(toxic), _one_of_copies(ordinary)
    base = " ".join(w for t in ordinary[:300] for w in t.lower().split()[:40]).encode("utf-8", "replace")[:BASE_BYTES]
    # what stands last in a dictionary is the cheapest to refer to
    own = (" " + " ".join(telling(toxic, ordinary)[::-1])).encode("utf-8", "replace")
    return Model(base + own, base + b"\0" * len(own), np.zeros(0), np.zeros(0), np.zeros(0))


def train(sample: pd.DataFrame) -> Model | None:
    """A model of (id, t, toxic, weight) rows, in any order; the weight is how many labelled rows a row of the sample stands for.
    DICTIONARY_SHARE of the rows make the dictionaries, the others the thresholds."""
    rows = sample.sort_values(["id", "t"])
    first = np.array([zlib.crc32(f"half {i}".encode()) % 100 < DICTIONARY_SHARE for i in rows["id"]], dtype=bool)
    texts = {(label, f): rows["t"][(rows["toxic"] == label).to_numpy() & (first == f)].tolist() for label in (0, 1) for f in (True, False)}
    if not all(texts.values()):
        return None
    model = _dictionaries(texts[1, True], texts[0, True])
    both = model.compressors()
    weights = rows.groupby("toxic")["weight"].mean()
    cal = [(t, label) for label in (0, 1) for t in texts[label, False]]
    y = np.array([label for _, label in cal])
    model.mean, model.spread, model.weights = _logistic(np.array([measures(t, *both) for t, _ in cal]), y.astype(float), (weights[y] / weights.mean()).to_numpy())
    return model


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """Of (id, t, toxic) at most about `rows` toxic and twice as many ordinary rows, with weights that restore the labels' shares."""
    fits = labelled.filter(F.col("toxic").isin(0, 1) & F.col("t").isNotNull() & (F.length("t") <= SAMPLE_CHARS))
    n = {r.toxic: r["n"] for r in fits.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30))
    few = lambda k, size: fits.filter((F.col("toxic") == k) & (pick < int(min(1.0, rows * size / n[k]) * (1 << 30))))
    # the first by the hash, whatever the order of partitions
    parts = [few(k, size).orderBy(pick, "id", "t").limit(int(rows * size * 1.2)) for k, size in ((0, 2), (1, 1)) if n.get(k)]
    got = pd.concat([p.toPandas() for p in parts]) if parts else pd.DataFrame({"id": [], "t": [], "toxic": []})
    got["weight"] = got["toxic"].map(n) / got.groupby("toxic")["toxic"].transform("size")
    return got


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its id, score and predicted."""
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        both = model.compressors() if model else None
        for whole in batches:
            for pdf in small_batches(whole, "t"):
                got = model.score(np.array([measures(t, *both) for t in pdf["t"]])) if both else np.zeros(len(pdf))
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "score": got, "predicted": (got >= PREDICTED).astype(np.int32)})

    plain = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    return plain.mapInPandas(run, f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)
