import re
from collections import Counter

import pytest

from tidegrid.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n\x0b\f\r ", "one", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n\nx\n \n", "é ü € 𝄞 𝄞𝄞 é ü €",
    "no break no break", "# * $ % & | < > ##", " lead a b c d a b c trail ", "ab c a bc ab c a bc", "w " * 3000,
    " ".join(f"w{i % 997}" for i in range(20000)), "a b\x1c c a b\x1c c",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(4, "a b c", "y", 8)], "doc_id long, text string, w string, n_words int")


def test_measures_equal_brute_force(docs):
    got = q.measures(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), r.doc_id


def test_bits_policies_and_ablation(docs):
    led = q.ledger(docs)
    rows = q.apply_policy(led).collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.fail_bits == 0)
    out = {r.rule: r for r in q.ablation(led).collect()}
    for name, bit in q.BIT.items():
        assert out[name].n_rejected == sum(bool(r.fail_bits & bit) for r in rows)
        assert out[name].n_only == sum(r.fail_bits == bit for r in rows)
        assert out[name].n_kept_without == sum(not r.fail_bits & ~bit for r in rows)


def test_empty_table(spark):
    led = q.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert led.count() == 0 and q.ablation(led).count() == len(q.RULES) * 0


@pytest.mark.parametrize("name", ["t", "w", "p", "s", "b", "lines", "_id"])
def test_ids_of_any_name(spark, name):
    df = spark.createDataFrame([(7, "a b c a b c")], "k long, text string").withColumnRenamed("k", name)
    r = q.ledger(df, name).first()
    assert r[name] == 7 and r.n_words == 6 and r.n_repeat_words == 6
