import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tidegrid.llm import filter_audit as a

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(i, t, firsts):
    w = WORD.findall(t)
    return {f for f, bad in zip("ABCDE", (
        len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)),
        i is not None and any(j < i for j in firsts[t]),
    ), strict=True) if bad}


def brute(docs, labels):
    firsts = {}
    for i, t, _ in docs:
        firsts.setdefault(t or "", []).extend([] if i is None else [i])
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = [(i, part or "", fails(i, t or "", firsts)) for i, t, part in docs]
    out = []
    for part in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                removed_by[f] += len(gone)
                lines.append(("".join(order), step + 1, f, len(left), len(gone), sum(f in r[2] for r in mine) - len(gone), sum(r[2] == {f} for r in mine),
                              sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out += [(part, o, s, k, g, red, u, gl, tl, removed_by[f]) for o, s, f, k, g, red, u, gl, tl in lines]
    return sorted(out)


def got(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"id": F.lit(1), "part": F.lit("x"), "mask": F.lit(2), "quality": F.lit(1)})
    out = a.audit(d.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("")))
    return sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())


def test_equals_brute_force(spark):
    rng = random.Random(5)
    say = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    vocab = [f"w{k}" for k in range(3000)] + ["Ünï x", "a b"]
    docs = []
    for k in range(150):
        t = say(rng.choice([5, 99, 100, 101, 130]), rng.choice([vocab, vocab[:40], vocab[:90]]))
        t = t.upper() if rng.random() < 0.3 else t
        t += rng.choice(["", "", " #", "|", "\x1f*"])
        docs.append((k, t, rng.choice(["de", "en", "", None])))
    docs += [(1000 + k, docs[k % 7][1], "en") for k in range(30)] + [docs[3]] * 3 + [(None, docs[4][1], None), (None, docs[4][1], "de")]
    docs += [(2000, None, "en"), (2001, "", None), (2002, " \n", "en"), (2003, "word " * 50000, "fr"), (-5, docs[9][1], "it")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 160, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (99999, 1, 1), (1003, 1, 1)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_empty(spark):
    assert got(spark, [], []) == []
    assert got(spark, [], [(1, 1, 1)]) == []
    assert got(spark, [(None, None, None)], []) == brute([(None, None, None)], [])


def test_walk_keeps_what_no_active_filter_hits():
    counts = np.random.default_rng(2).integers(0, 9, (3, 32, 2))
    left = a.walk(counts)
    for active in range(32):
        assert (left[:, active] == counts[:, [m for m in range(32) if not m & active]].sum(axis=1)).all()
