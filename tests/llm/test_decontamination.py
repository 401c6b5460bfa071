import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import decontamination as d


def words(t):
    return [w for w in re.split(r"[^a-z0-9é]+", (t or "").lower()) if w]


def sh(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute(docs, items):
    """The best similarity of any window of the item's size, for all pairs that reach the threshold."""
    out = {}
    for i, t in docs:
        w = words(t)
        for k, u in items:
            x = words(u)
            if len(x) < 5 or len(w) < 5:
                continue
            best = max(jaccard(sh(w[a : a + len(x)]), sh(x)) for a in range(max(1, len(w) - len(x) + 1)))
            if best >= 0.8:
                out[i, k] = max(best, out.get((i, k), 0))
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["é", "a"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([20, 40, 41, 60])))) for k in range(12)]
    items += [(12, "a b c d e"), (13, "too short"), (14, None), (15, "x y z x y z x y z x y z x y z")]
    docs = []
    for i in range(60):
        body = say(rng.randint(0, 120))
        k = rng.randrange(12)
        x = words(items[k][1])
        if i % 3 == 0:
            edits = rng.choice([0, 0, 1, 2])
            for _ in range(edits):
                at = rng.choice([0, 1, 2, len(x) - 2, len(x) - 1, rng.randrange(len(x))])
                x[at : at + 1] = rng.choice([["new"], [], ["new", x[at]]])
            at = rng.randint(0, len(body))
            body[at:at] = x
        docs.append((i, ", ".join(body).upper() if i % 2 else " ".join(body)))
    docs += [(100, None), (101, ""), (102, "a b c d e"), (103, "x y z " * 30), (104, items[0][1]), (104, items[1][1]), (105, " ".join(words(items[2][1])[:-1]))]
    return docs, items


@pytest.mark.parametrize("bound", [500_000, 0])
def test_equals_the_best_of_all_windows(spark, planted, bound):
    docs, items = planted
    df = spark.createDataFrame([(i, t, "q", "s") for i, t in docs], "doc_id long, text string, item string, s string")
    got = {(r.doc_id, r.item_id): r.similarity for r in d.find(df, spark.createDataFrame(items, "item_id long, text string"), bound=bound).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 12
    for k, v in got.items():
        assert abs(v - want[k]) < 1e-9


def test_multi_index_finds_every_fingerprint_within_the_radius(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    for radius in (3, 20):
        cut = d.blocks(radius)
        assert sum(w for _, w in cut) == 63 and len(cut) == radius + 1
        for _ in range(200):
            other = base
            for b in rng.sample(range(63), radius):
                other ^= 1 << b
            assert any((base >> a) & ((1 << w) - 1) == (other >> a) & ((1 << w) - 1) for a, w in cut)


def test_simhash_is_the_sign_of_the_weighted_sums(spark):
    rng = random.Random(2)
    xs = [rng.getrandbits(64) - (1 << 63) for _ in range(37)] * 2 + [5]
    got = spark.createDataFrame([(xs,)], "s array<long>").select(d.simhash("s").alias("f")).first().f
    want = sum(1 << b for b in range(63) if 2 * sum((x >> b) & 1 for x in xs) > len(xs))
    assert got == want


def test_removal_and_empty_tables(spark, planted):
    docs, items = planted
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    bad = {i for i, _ in brute(docs, items)}
    assert sorted(r.doc_id for r in d.without_copies(df, it).collect()) == sorted(i for i, _ in docs if i not in bad)
    assert d.find(df.limit(0), it).count() == 0 and d.find(df, it.limit(0)).count() == 0
    assert d.without_copies(df, it.filter(F.lit(False))).count() == len(docs)


def test_null_ids_and_long_texts(spark, planted):
    _, items = planted
    long = "filler word number %d of a very long text " * 1
    text = " ".join(long % k for k in range(60_000)) + " " + items[0][1]
    df = spark.createDataFrame([(None, items[1][1]), (7, text)], "doc_id long, text string")
    it = spark.createDataFrame([(None, items[1][1]), (0, items[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in d.find(df, it).collect()}
    assert got == {(None, None): 1.0, (7, 0): 1.0}


def test_windows_meet_only_the_items_they_begin_with(spark, planted):
    docs, items = planted
    it = d.fingerprints(spark.createDataFrame(items, "item_id long, text string"))
    text = dict(items)
    own = {r.no: sh(words(text[r.item])) for r in it.collect()}
    whole = {i: words(t) for i, t in docs if i != 104}
    rows = [r for r in d.candidates(spark.createDataFrame(docs, "doc_id long, text string"), it).collect() if r.doc in whole]
    assert rows
    for r in rows:
        w = whole[r.doc][r.at : r.at + r.n]
        assert set(sh(w)) & set(own[r.no]) and len(r.x) == max(0, len(w) - 4)
