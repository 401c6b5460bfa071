import hashlib

import public_tokenizers
import pytest
import sentencepiece

from tidegrid.llm import sentencepieces as s

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "  a  b ", "▁x a▁b", "▁", "hello\tworld\n x\xa0y", "ﬁ ½ é é １２ ​　z", "𝄞𝄞 𝄞", "\r\n", "a\x00b",
    "x" * 5000, "word " * 3000, "<s> </s> <unk> <0x41>", "é" * 70 + " " + "é" * 70,
]


@pytest.mark.parametrize("most", [s.TABLE_BYTES, 500])
def test_rows_are_the_librarys(most):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = s.Table(MODEL, most)
    for _ in range(2):
        for t, (ids, back) in zip(TEXTS, table.rows([t or "" for t in TEXTS]), strict=True):
            want = sp.encode(t or "")
            assert (ids, back) == (",".join(map(str, want)), sp.decode(want)), repr(t)
    assert table.bytes >= 0 and all(len(c) <= s.MAX_KEPT for c in table.ids)


def test_operator_and_decode(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, t int")
    enc = s.encode(df, MODEL)
    rows = enc.collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        ids = sp.encode((TEXTS * 2)[r.doc_id] or "")
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    for r in s.decode(enc, MODEL).collect():
        assert r.text == sp.decode(sp.encode((TEXTS * 2)[r.doc_id] or ""))
    assert s.encode(df.limit(0), MODEL).count() == 0


def test_slices_cover_all_rows():
    sizes = s.np.array([3, 0, 9, 1, 1, 0, 7])
    got = list(s.slices(sizes, 5))
    assert [k for a, b in got for k in range(a, b)] == list(range(7))
    assert all(b - a == 1 or sizes[a:b].sum() <= 5 for a, b in got) and list(s.slices(sizes[:0], 5)) == []
