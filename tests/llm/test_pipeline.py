import corpus_pipeline as p
import public_tokenizers
import pytest
import sentencepiece
from tests.conftest import SF_SMALL
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_quality_rules import WORD
from tests.llm.test_quality_rules import brute as measures
from tests.llm.test_secret_scans import brute as secrets


def rejected(t):
    n, chars, symbols, dup, rep = measures(t)
    lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
    return n < 50 or 100 * rep > 50 * n or 2 * symbols > n or (lines > 1 and 2 * dup > lines) or chars < 2 * n or chars > 20 * n


def mark(t):
    out, done = "", 0
    for a, _, b in secrets(t):
        if a >= done:
            out += t[done:a] + "[SECRET]"
        done = max(done, b)
    return out + t[done:]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").unionByName(spark.createDataFrame([(10**6, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    out = [docs]
    for name, f in p.STAGES:
        out.append(p.written(f(spark, out[-1], SF_SMALL), name.replace(" ", "-")))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_equal_brute_force(spark, stages):
    docs, good, single, clean, safe, tokens = map(rows, stages)
    assert good.keys() == {i for i, r in docs.items() if not rejected(r.text)}
    assert single.keys() == {i for i, c, _ in near([(i, r.text) for i, r in sorted(good.items())]) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    found = p.decontamination.find(stages[2], spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()
    held = {i for i, _ in leaks([(i, r.text) for i, r in single.items() if i in {x.doc_id for x in found}], items)}
    assert held == {x.doc_id for x in found} and clean.keys() == single.keys() - held
    for i, r in single.items():
        if any(u in r.text for _, u in items):
            assert i not in clean
    assert safe.keys() == clean.keys()
    for i, r in safe.items():
        if secrets(clean[i].text):
            assert "[SECRET]" in r.text and not secrets(r.text)
        if "-----BEGIN" not in clean[i].text and "eyJ" not in clean[i].text:
            assert r.text == mark(clean[i].text) and r.n_chars == len(r.text)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert tokens.keys() == safe.keys()
    for i, r in tokens.items():
        assert list(r.token_ids) == sp.encode(safe[i].text)


def test_columns_and_empty_tables(spark, stages):
    assert len(p.STAGES) == 5
    for df in stages[1:-1]:
        assert df.columns == p.COLUMNS
    docs = stages[0].limit(0)
    for _, f in p.STAGES:
        docs = f(spark, docs, SF_SMALL)
    assert docs.count() == 0
