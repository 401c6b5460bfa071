import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import packing as p

PATH = public_tokenizers.path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


TEXTS = [
    "", " ", "hello World", "don't  we'll\tI'm\n\nyou've 12 345", "ÀÉÎ é ﬁ Σας ΟΔΟΣ İstanbul ß ẞ", "日本語 のテキスト", "<|endoftext|> x<|startoftext|>y <|end oftext|>",
    "a\x00b \x1c!\x1c! \x85 a\x85b  x y​z ﻿", " ́a ≮ = ̸", "😀👩‍👩‍👧‍👦 👍🏽", "word " * 3000, "x" * 5000, "!?" * 3000, "\v\f\r a\vb", "ä" * 700 + " " + "Z" * 300,
    "can'T 'S 'RE it's'd", "퟿  \U0010ffff",
]


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_words_encode_as_the_library_does(most):
    words = p.Words(PATH, most)
    rng = random.Random(4)
    odd = [" ", "\n", "\t", "a", "B", "é", "́", "'s", "'", "1", "Σ", "<|endoftext|>", "<|", " ", "\x1d", "語", ".", "‍", "ǅ", "İ"]
    texts = TEXTS + ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(800)]
    for k in range(0, len(texts), 7):
        for t, got in zip(texts[k : k + 7], words.encoded(texts[k : k + 7]), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == library(t), t[:80]


def test_long_texts_and_many_words(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abcÄé')}{rng.randrange(10**6)}" for _ in range(rng.choice([3, 400]))) for _ in range(60)]
    monkeypatch.setattr(p, "PART_CHARS", 300)
    words = p.Words(PATH, 20_000)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in words.encoded(texts)] == [library(t) for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = p.Words(path).encoded(TEXTS)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_parts_of_long_texts(monkeypatch):
    text = " ".join(f"w{k}" for k in range(500)) + " " + "y" * 300 + "\n z"
    assert [len(x) for x in p.parts("x" * 50, 20)] == [50]
    assert [w for x in p.parts(text, 20) for w in x.split()] == text.split()
    assert sum(len(x) <= 40 for x in p.parts(text, 20)) > 50
    assert list(p.parts("", 20)) == [""]


def check_plan(counts, capacity):
    """Every piece has a place, no two share a token; the number of sequences."""
    ranks, filled = {n: [] for n in counts}, {}
    for length, rank, n, each, first, at in p.plan(counts, capacity):
        ranks[length] += range(rank, rank + n)
        for k in range(n):
            filled.setdefault(first + k // each, []).append((at + k % each * length, length))
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
    for spans in filled.values():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= capacity
    assert sorted(filled) == list(range(len(filled)))
    return len(filled)


def one_by_one(counts, capacity):
    """The same packing piece by piece: greedy matching, then best fit."""
    large = sorted(n for n, c in counts.items() if 3 * n > capacity for _ in range(c))
    gaps = []
    while large:
        a = large.pop()
        b = max((x for x in large if a + x <= capacity), default=None)
        if b is not None:
            large.remove(b)
        gaps.append(capacity - a - (b or 0))
    for s in sorted((n for n, c in counts.items() if 3 * n <= capacity for _ in range(c)), reverse=True):
        best = min((k for k in range(len(gaps)) if gaps[k] >= s), key=lambda k: gaps[k], default=None)
        if best is None:
            gaps.append(capacity)
            best = -1
        gaps[best] -= s
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_the_packing_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([6, 10, 30, 64])
    counts = {n: rng.choice([1, 1, 2, 5, 40]) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))}
    n = check_plan(counts, capacity)
    assert n == one_by_one(counts, capacity)
    total = sum(k * c for k, c in counts.items())
    assert -(-total // capacity) <= n <= 1.5 * total / capacity + 2


def test_matching_makes_most_pairs():
    assert check_plan({60: 2, 50: 1, 45: 1, 40: 2, 55: 1}, 100) == 4
    assert check_plan({}, 100) == 0


def test_plan_stays_small_whatever_the_counts():
    rng = random.Random(1)
    counts = {n: rng.randrange(1, 10**9) for n in range(1, 4097)}
    assert len(p.plan(counts)) < 115_000


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, piece string").withColumns({"length": F.lit(3), "salt": F.lit("a")})


def test_packed_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(100, None, None), (None, "no id", None)] + [(7, "hello World", None)] * 50 + [(200, "a b c d e " * 5000, None)]
    got = p.pack(docs_of(spark, rows).repartition(3), PATH, ids=True).collect()
    want = []
    for i, t, _ in rows:
        ids = library(t or "") + [1]
        want += [(i, k, s, ids[s : s + 4096]) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, list(r.token_ids)) for r in got), key=key) == sorted(want, key=key)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.token_ids, dtype="<u4").tobytes()) and r.length == len(r.token_ids) for r in got)
    whole = {}
    for r in got:
        whole.setdefault(r.sequence_id, []).append((r.offset, list(r.token_ids)))
    for spans in whole.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(len(x) for _, x in spans[:k]) for k in range(len(spans))]
        assert sum(len(x) for _, x in spans) <= 4096
    lengths = {}
    for *_, x in want:
        lengths[len(x)] = lengths.get(len(x), 0) + 1
    assert len(whole) == one_by_one(lengths, 4096)
    frame = p.sequences(spark.createDataFrame(got), "doc_id").collect()
    assert {r.sequence_id: list(r.token_ids) for r in frame} == {s: [t for _, x in spans for t in x] for s, spans in whole.items()}


def test_small_capacity_with_many_equal_lengths(spark):
    rows = [(k, "a " * (k % 23), None) for k in range(700)]
    got = p.pack(docs_of(spark, rows).repartition(4), PATH, capacity=20).collect()
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 20 and sorted(v) == [(sum(n for _, n in sorted(v)[:k]), sorted(v)[k][1]) for k in range(len(v))] for v in filled.values())
    counts = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(filled) == one_by_one(counts, 20) and len(got) == sum(-(-(k % 23 + 1) // 20) for k in range(700))


def test_empty(spark):
    assert p.pack(docs_of(spark, []), PATH).collect() == []
