"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths slide over the bytes of a fixed-length window; each filter's largest response, cut at zero, is a
feature; a softmax over the features gives the window's languages. A filter's weights for one place of its width are a table with
a row for each byte value, so the response is a sum of table rows; for use, the tables of two neighbouring places become one table
over pairs of bytes. A text is cut into windows from its first byte to its last, and its prediction is the mean over all of them.

Training takes a bounded sample: at most SAMPLE_ROWS labelled texts, chosen by a hash of their id, the languages as even as the
table allows (more than SAMPLE_ROWS / 8 languages raise), and WINDOWS_PER_TEXT windows of each, spread over the text. Only those windows come to the driver.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned. A very long
text is read window by window, all of it. Ties go to
the language that sorts first. Repeated rows each give a row, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.sentencepieces import small_batches

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
OVERLAP = max(WIDTHS) - 1
SAMPLE_ROWS, WINDOWS_PER_TEXT = 4000, 3
EPOCHS, BATCH, RATE = 6, 64, 0.01
NONE = "und"


def held_out(id_col: Column, of: int, which: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % of == which, F.lit(False))


def windows(text: str) -> np.ndarray:
    """The windows of a text, one a row, each with the first bytes of the next; zeros after the end."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(n * WINDOW + OVERLAP, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW + OVERLAP), (WINDOW, 1))


class Network:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), dtype=np.float32)
        self._pairs = None

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        return [sum(t[k][x[:, k : k + WINDOW]] for k in range(w)) for w, t in zip(WIDTHS, self.tables, strict=True)]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adagrad on cross-entropy; only the place of a filter's largest response gets a gradient."""
        rng = np.random.default_rng(seed)
        params = [t for ts in self.tables for t in ts] + [self.out, self.bias]
        seen = [np.full(p.shape, 1e-6, dtype=np.float32) for p in params]
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                rows = order[k : k + BATCH]
                xb, n = x[rows], len(rows)
                maps = self.responses(xb)
                places = [m.argmax(axis=1) for m in maps]
                raw = np.concatenate([np.take_along_axis(m, p[:, None, :], 1)[:, 0] for m, p in zip(maps, places, strict=True)], axis=1)
                feats = np.maximum(raw, 0)
                probs = _softmax(feats @ self.out + self.bias)
                probs[np.arange(n), y[rows]] -= 1
                probs /= n
                back = (probs @ self.out.T) * (raw > 0)
                grads = []
                for j, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
                    g = back[:, j * FILTERS : (j + 1) * FILTERS]
                    for at in range(w):
                        grad = np.zeros((256, FILTERS), dtype=np.float32)
                        np.add.at(grad, (np.take_along_axis(xb, place + at, 1), np.arange(FILTERS)[None, :]), g)
                        grads.append(grad)
                grads += [feats.T @ probs, probs.sum(axis=0)]
                for p, s, g in zip(params, seen, grads, strict=True):
                    s += g * g
                    p -= RATE * 5 * g / np.sqrt(s)
        self._pairs = None

    def _paired(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables over pairs of bytes: the first two places of all widths, the last place of width 3, the last two of width 4."""
        if self._pairs is None:
            two = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
            front = np.concatenate([two(t[0], t[1]) for t in self.tables], axis=1)
            self._pairs = front, self.tables[1][2], two(self.tables[2][2], self.tables[2][3])
        return self._pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        front, third, back = self._paired()
        out = np.empty((len(x), len(self.classes)), dtype=np.float32)
        for k in range(0, len(x), 128):
            xb = x[k : k + 128]
            pair = xb[:, :-1].astype(np.int32) * 256 + xb[:, 1:]
            m = front[pair[:, :WINDOW]]
            m[:, :, FILTERS : 2 * FILTERS] += third[xb[:, 2 : 2 + WINDOW]]
            m[:, :, 2 * FILTERS :] += back[pair[:, 2 : 2 + WINDOW]]
            out[k : k + 128] = _softmax(np.maximum(m.max(axis=1), 0) @ self.out + self.bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """(lang, w) windows of some `rows` of (id, t, lang), all of the same share of a language's rows, the share larger for rare ones. No
    more than WINDOWS_PER_TEXT windows times `rows` are taken, those first by the hash that picks rows."""
    counts = {r.lang: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(rows // 8 + 1).collect()}
    if len(counts) > rows // 8:
        raise ValueError(f"a sample of {rows} texts is too small for more than {rows // 8} languages")
    if not counts:
        return pd.DataFrame({"lang": [], "w": []})
    each = rows / len(counts)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 0.9 * each / n) if n > each else 1.0)])
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30))
    few = labelled.withColumn("h", place).filter(F.col("h") < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 30))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places, langs, out = [], [], []
            for h, lang, t in zip(pdf["h"], pdf["lang"], pdf["t"], strict=True):
                w = windows(t)
                for k in sorted({len(w) * i // WINDOWS_PER_TEXT for i in range(WINDOWS_PER_TEXT)}):
                    places.append(h)
                    langs.append(lang)
                    out.append(w[k].tobytes())
            yield pd.DataFrame({"h": places, "lang": langs, "w": out})

    cuts = few.select("h", "lang", "t").mapInPandas(cut, "h long, lang string, w binary")
    return cuts.orderBy("h", "lang", "w").limit(WINDOWS_PER_TEXT * rows).drop("h").toPandas()


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    got = sample(labelled, rows)
    classes = sorted(set(got["lang"]))
    if not classes:
        return None
    # rows come in any order: sorted, the training does not depend on it
    got = got.sort_values(["lang", "w"])
    x = np.frombuffer(b"".join(map(bytes, got["w"])), dtype=np.uint8).reshape(len(got), WINDOW + OVERLAP)
    net = Network(classes)
    net.train(x, np.array([classes.index(c) for c in got["lang"]]))
    return net


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its id, lang_pred and score."""
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for whole in batches:
            for pdf in small_batches(whole, "t", 2_000_000):
                best, score = np.full(len(pdf), NONE, dtype=object), np.zeros(len(pdf))
                some = np.flatnonzero(pdf["letters"].to_numpy(dtype=bool)) if net else []
                if len(some):
                    cut = [windows(t) for t in pdf["t"].iloc[some]]
                    starts = np.cumsum([0, *map(len, cut)])
                    mean = np.add.reduceat(net.probabilities(np.concatenate(cut)), starts[:-1], axis=0) / np.diff(starts)[:, None]
                    top = mean.argmax(axis=1)
                    best[some] = [net.classes[k] for k in top]
                    score[some] = np.minimum(1.0, mean[np.arange(len(some)), top])
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "lang_pred": best, "score": score})

    text = F.col(text_col)
    plain = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letters"))
    return plain.mapInPandas(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)
