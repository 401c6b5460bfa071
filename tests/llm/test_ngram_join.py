import random
import re
from itertools import combinations

import numpy as np
import pytest

from tidegrid.llm import ngram_join as j
from tidegrid.llm.shingling import ngram_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(t, n=5):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    n, root = [0] * len(rows), list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
            n[a] += 1
            n[b] += 1
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    return sorted((rows[k][0], least[root[k]], n[k]) for k in range(len(rows)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = [f"w{i}é" for i in range(500)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    out, common = [], say(60)
    for k in range(40):
        base = say(rng.randint(3, 150))
        for _ in range(rng.choice([1, 1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        out.append(" ".join(say(rng.randint(0, 60)) + common))
    base = say(200)
    for _ in range(60):  # one large group of different near copies
        w = list(base)
        w[rng.randrange(200)] = rng.choice(vocab)
        out.append("\n".join(w))
    out += [None, "", None, " ", "a b", "A b", "a b c d e", "x" * 30000, "long " * 20000]
    return list(enumerate(out))


@pytest.mark.parametrize(("bound", "texts", "chars"), [(500_000, 512, 4_000_000), (0, 16, 5000)])
def test_equals_all_pairs(spark, rows, bound, texts, chars):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, comp string, rep int").repartition(3)
    got = j.join(df, bound=bound, block_texts=texts, block_chars=chars).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_repeated_ids_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a), (4, None)]
    got = j.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 4, 0)]
    assert j.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(i for i, c, _ in brute(rows) if i == c)
    for bound in (1000, 0):
        assert sorted(r.doc_id for r in j.one_of_each(df, bound=bound).collect()) == want


def test_banding_reaches_the_target_recall():
    for t, r in ((0.8, 0.999), (0.5, 0.99), (0.9, 0.9999)):
        b = j.choose(t, r)
        assert b.recall(t) >= r and b.bands * b.rows <= 128


def test_hashes_do_not_depend_on_what_else_is_in_the_batch():
    texts = ["A b  c\td e f", "", "𝄞 é x", "one", "x " * 900 + "y" * 700]
    both, bounds = word_hashes(texts)
    for most in (1, 64, 1 << 19):
        again, b2 = word_hashes(texts, most)
        assert np.array_equal(both, again) and np.array_equal(bounds, b2)
    assert np.diff(bounds).tolist() == [6, 0, 3, 1, 901]
    for k, t in enumerate(texts):
        one, b = word_hashes([t])
        assert np.array_equal(one, both[bounds[k] : bounds[k + 1]])
        g, gb = ngram_hashes(one, b, 5)
        assert gb[-1] == (1 if 0 < len(one) < 5 else max(0, len(one) - 4))


@pytest.mark.parametrize("chars", [700, 2500, 6000])
def test_few_long_near_copies_in_blocks_of_which_some_are_empty(spark, chars):
    rng = random.Random(9)
    rows = []
    for g in range(16):
        base = [f"g{g}w{k}" for k in range(400)]
        for _ in range(2 + g % 2):
            w = list(base)
            w[rng.randrange(400)] = "other"
            rows.append((len(rows), " ".join(w)))
    got = j.join(spark.createDataFrame(rows, "doc_id long, text string"), block_chars=chars).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_documents_without_an_id(spark):
    a = " ".join(f"a{i}" for i in range(50))
    df = spark.createDataFrame([(None, a), (None, a), (1, a), (2, a + " x"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in j.join(df).collect()), key=str)
    assert got == sorted([(None, None, 0)] * 3 + [(1, 1, 1), (2, 1, 1)], key=str)
    assert sorted((r.doc_id for r in j.one_of_each(df).collect()), key=str) == sorted([None, None, None, 1], key=str)


def all_pairs(sets, groups, side, threshold):
    out = []
    for a, b in combinations(range(len(sets)), 2):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        if groups[a] == groups[b] and (side is None or side[a] != side[b]) and len(x & y) >= threshold * len(x | y) - 1e-9:
            out.append((a, b))
    return out


@pytest.mark.parametrize("tile", [256, 3])
@pytest.mark.parametrize("seed", range(12))
def test_pairs_of_a_block(monkeypatch, seed, tile):
    monkeypatch.setattr(j, "_TILE", tile)
    rng = np.random.default_rng(seed)
    common = rng.choice(10**9, 40)
    sets = []
    while len(sets) < 60:
        base = rng.choice(10**9, rng.integers(1, 90))
        for _ in range(rng.integers(1, 9)):
            keep = base[rng.random(len(base)) < rng.choice([0.8, 0.9, 0.95, 1.0])]
            sets.append(np.unique(np.concatenate([keep, base[:1], common[: rng.choice([0, 5, 40])]])))
    groups = rng.integers(0, 2, len(sets))
    side = None if seed % 2 else rng.random(len(sets)) < 0.5
    x, y = j._similar_pairs(sets, groups, side, 0.8)
    want = all_pairs(sets, groups, side, 0.8)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == want and (len(want) > 5 or side is not None)


def test_texts_that_share_a_passage_are_not_compared(monkeypatch):
    rng = np.random.default_rng(3)
    common = rng.choice(10**9, 58)
    sets = [np.unique(np.concatenate([common, rng.choice(10**12, 58)])) for _ in range(400)]
    sets += [np.unique(np.concatenate([s[:-4], rng.choice(10**12, 4)])) for s in sets[:5]]
    compared = []
    counted = j._counted
    monkeypatch.setattr(j, "_counted", lambda s, *a: compared.append(len(s)) or counted(s, *a))
    x, y = j._similar_pairs(sets, np.zeros(len(sets), dtype=int), None, 0.8)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(k, 400 + k) for k in range(5)]
    assert sum(n * n for n in compared) < 1000
