import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from tidegrid.llm import language_id, lm_scoring, queries_text, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries_text.op4_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) > 0.97


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(i, "aab aba " * 9 if i % 2 else "xxy yxy " * 9, "l1" if i % 2 else "l0") for i in range(60)], "id long, t string, lang string")
    net = language_id.fit(train)
    df = spark.createDataFrame([(1, None, 0), (1, "", 0), (2, "12 34 !", 0), (3, "aab " * 9, 0), (None, "yx" * 90000, 0)], "doc_id long, text string, letters int")
    got = [(r.doc_id, r.lang_pred, r.score > 0) for r in language_id.predict(df, net).collect()]
    assert sorted(got, key=str) == sorted([(1, "und", False), (1, "und", False), (2, "und", False), (3, "l1", True), (None, "l0", True)], key=str)
    assert language_id.fit(train.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(df, None).collect()} == {"und"}
    assert language_id.predict(df.limit(0), net).count() == 0


def test_paired_tables_give_the_plain_responses():
    net = language_id.Network(["a", "b"])
    x = language_id.windows("some words é and more " * 40)
    want = language_id._softmax(np.maximum(np.concatenate([m.max(axis=1) for m in net.responses(x)], axis=1), 0) @ net.out + net.bias)
    assert np.allclose(net.probabilities(x), want, atol=1e-5)
    text = "é" * 1000
    assert b"".join(w[: language_id.WINDOW].tobytes() for w in language_id.windows(text)).rstrip(b"\0") == text.encode()


def test_languages_equal_plain_convolutions(spark):
    rows = [(i, random.Random(i).choice(["ab ba", "xy yx", "qé éq"]) * 20 + str(i)) for i in range(90)]
    net = language_id.fit(spark.createDataFrame([(i, t, t[0]) for i, t in rows], "id long, t string, lang string"))
    docs = [(1, "ab xy " * 60), (2, "é"), (3, "qé" * 400), (4, "yx a")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(spark.createDataFrame(docs, "doc_id long, text string"), net).collect()}
    size = language_id.WINDOW
    for i, t in docs:
        data = t.encode()
        data += bytes(-len(data) % size) + bytes(8)
        shares = []
        for at in range(0, len(data) - 8, size):
            features = []
            for width, tables in zip(language_id.WIDTHS, net.tables, strict=True):
                for f in range(language_id.FILTERS):
                    features.append(max(0.0, max(sum(float(tables[k][data[at + p + k], f]) for k in range(width)) for p in range(size))))
            z = [sum(x * float(net.out[j, c]) for j, x in enumerate(features)) + float(net.bias[c]) for c in range(len(net.classes))]
            e = [math.exp(x - max(z)) for x in z]
            shares.append([x / sum(e) for x in e])
        mean = [sum(s[c] for s in shares) / len(shares) for c in range(len(net.classes))]
        assert got[i][0] == net.classes[mean.index(max(mean))] and math.isclose(got[i][1], max(mean), abs_tol=1e-4)


def test_too_many_languages_raise(spark):
    df = spark.range(60).selectExpr("id", "'abc' as t", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="too small"):
        language_id.sample(df, 400)
    assert len(language_id.sample(df, 480)["lang"].unique()) == 60


def test_toxicity_equals_plain_compressions(spark):
    rng = random.Random(2)
    say = lambda n, bad: " ".join(rng.choice(["vilest", "grubbish"]) if bad and rng.random() < 0.1 else f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(k, say(80, k % 3 == 0), int(k % 3 == 0)) for k in range(400)]
    model = toxicity.train(toxicity.sample(spark.createDataFrame(rows, "id long, t string, toxic int").repartition(3)))
    docs = [(k, say(n, bad)) for k, (n, bad) in enumerate([(5, True), (40, False), (300, True), (0, False), (25, True)])] + [(90, None), (91, "vilest"), (92, "noblanks" * 500)]
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for k, t in docs:
        words = (t or "").lower().split()
        gaps = []
        for at in range(0, len(words), toxicity.WORDS):
            window = " ".join(words[at : at + toxicity.WORDS]).encode()
            short, long = (c.compress(window) for c in model.compressors())
            gaps.append(len(long) - len(short))
        gaps = sorted(gaps) or [0]
        over = [sum(g >= k for g in gaps) for k in (1, 2, 3, 4, 6)]
        x = [gaps[-1], sum(gaps[-3:]) / len(gaps[-3:]), sum(gaps) / len(gaps), *(o / len(gaps) for o in over), *(math.log1p(o) for o in over), math.log1p(len(gaps))]
        z = sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.spread, model.weights, strict=False)) + model.weights[-1]
        want = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert math.isclose(got[k][0], want, abs_tol=1e-5) and got[k][1] == int(got[k][0] >= 0.7)


def test_the_sample_of_toxicity_does_not_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("id", "concat('text ', id) as t", "cast(id % 2 as int) as toxic")
    picked = lambda n: sorted(toxicity.sample(df.repartition(n), 100)["id"])
    assert picked(1) == picked(7) and 100 < len(picked(3)) <= 360


def test_toxicity_on_held_out_documents(spark, labels):
    rows = queries_text.op6_toxicity(spark, SF).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in held if labels[a.doc_id].toxic for b in held if not labels[b.doc_id].toxic]
    assert sum(pairs) / len(pairs) > 0.75


def test_toxicity_finds_planted_words_and_spares_clean_texts(spark):
    rng = random.Random(4)
    vocab = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdlmnrst')}{rng.choice('aeiou')}{k % 10}" for k in range(400)]
    say = lambda n, bad: " ".join(rng.choice(["vilest", "grubbish", "wretchy"]) if bad and rng.random() < 0.06 else rng.choice(vocab) for _ in range(n))
    rows = [(k, say(rng.randint(60, 300), k % 5 == 0), int(k % 5 == 0)) for k in range(900)]
    known = spark.createDataFrame([r for r in rows if r[0] % 3], "id long, t string, toxic int")
    model = toxicity.train(toxicity.sample(known))
    df = spark.createDataFrame([(k, t, 0) for k, t, _ in rows if not k % 3] + [(-1, None, 0), (-2, "", 0), (-3, "ab " * 50000, 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(got[k].predicted, y) for k, _, y in rows if not k % 3]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert not any(got[k].predicted for k in (-1, -2, -3))
    assert toxicity.train(toxicity.sample(known.limit(0))) is None and toxicity.train(toxicity.sample(known.filter("toxic = 0"))) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0


TEXTS = ["a b c a b", "A  b\nc", None, "", "x y x y x", "z", "a b c d e f g", "a b c a b"]


def exact(texts, wanted):
    """Losses from counts of the words and pairs of all other documents."""
    words = [(t or "").lower().split() for t in texts]
    toks = [list(zip([None, *w], w, strict=False)) for w in words]
    counted = {"target": wanted, "background": set(range(len(texts)))}
    kinds = {"one": lambda x: x[1], "two": lambda x: x, "before": lambda x: x[0]}
    all_ = {(name, kind): Counter(f(x) for k in counted[name] for x in toks[k]) for name in counted for kind, f in kinds.items()}
    n = {name: sum(all_[name, "one"].values()) for name in counted}
    v = max(lm_scoring.UNIGRAMS, len(all_["background", "one"]))
    out = []
    for k, mine in enumerate(toks):
        row = {}
        for name in counted:
            s = 1 if name == "target" else (n["target"] or n["background"]) / max(1, n["background"])
            own = {kind: Counter(map(f, mine)) if k in counted[name] else Counter() for kind, f in kinds.items()}
            left = lambda kind, x: (all_[name, kind][x] - own[kind][x]) * s  # noqa: B023, E731
            one = lambda b: (left("one", b) + lm_scoring.ADDED) / (n[name] * s + lm_scoring.ADDED * v)  # noqa: B023, E731
            loss = [-math.log((left("two", (a, b)) + lm_scoring.PRIOR * one(b)) / (left("before", a) + lm_scoring.PRIOR)) for a, b in mine]
            row[name] = sum(loss) / len(loss) if loss else None
        out.append(row)
    return out


@pytest.mark.parametrize(("wanted", "bound"), [({0, 6}, 1000), ({0, 6}, 0), (set(), 1000), ({0, 5}, 1000)])
def test_losses_equal_plain_counts(spark, wanted, bound):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, "q", 2)], "doc_id long, text string, wanted int").repartition(3)
    ids = spark.createDataFrame([(k,) for k in wanted] * 2 + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score(df, ids, bound=bound).collect()}
    want = exact([*TEXTS, "q"], wanted)
    for k, w in enumerate(want[:-1]):
        assert got[k].n_tokens == len((TEXTS[k] or "").split())
        for name in ("target", "background"):
            v = got[k]["loss_" + name]
            assert v is None if w[name] is None else abs(v - w[name]) < 1e-9
    assert len(got) == len(TEXTS) + 1 and lm_scoring.score(df.limit(0), ids).count() == 0


def test_no_document_is_known_by_heart(spark):
    # a wanted document of words of its own is no nearer to the target than one that was not wanted
    rows = [(0, " ".join(f"own{k}" for k in range(50))), (1, " ".join(f"new{k}" for k in range(50))), *((k, f"common words of document {k % 7}") for k in range(2, 60))]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in (0, *range(2, 30))], "doc_id long")).collect()}
    assert abs(got[0] - got[1]) < 0.01


def test_scores_tell_good_documents(spark, labels):
    rows = queries_text.op7_lm_scoring(spark, SF).filter(F.col("n_tokens") > 0).toPandas()
    rows["good"] = rows["doc_id"].map(lambda i: labels[i].quality if i in labels else None)
    mean = rows.groupby("good")["score"].mean()
    assert mean[1] > mean[0]


@pytest.mark.parametrize(("hot", "words"), [({}, 300_000), ({"hot_words": 40, "hot_pairs": 30, "part_tokens": 3000}, 2000), ({"hot_words": 0, "hot_pairs": 0, "part_tokens": 500}, 2000)])
def test_every_word_and_pair_has_its_own_count(spark, hot, words):
    rng = random.Random(5)
    often = [f"w{k}" for k in range(60)]
    # more distinct words than 2^18 in the first case, and words that repeat and follow each other
    texts = [" ".join(x for j in range(k, words, 40) for x in (f"r{j // 2 * 2}q{j}", rng.choice(often), rng.choice(often))) for k in range(40)]
    texts += [texts[0], texts[7], "w1", "only once", "w1 w2 w1 w2 only"]
    wanted = {0, 3, 40, 42, 44}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.score(df, spark.createDataFrame([(k,) for k in wanted], "doc_id long"), **hot).collect()}
    assert len(got) == len(texts)
    for k, w in enumerate(exact(texts, wanted)):
        assert got[k].n_tokens == len(texts[k].split())
        assert abs(got[k].loss_target - w["target"]) < 1e-9 and abs(got[k].loss_background - w["background"]) < 1e-9
