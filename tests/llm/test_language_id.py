import zlib
from itertools import combinations

import numpy as np
import pytest
import regex

from touchline.llm import language_id


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, language_id.train(docs)


def test_held_out_accuracy(trained):
    docs, coder = trained
    rows = language_id.identify(docs, coder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 1_000
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.99


@pytest.mark.parametrize("languages", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(languages):
    code = language_id.codewords(languages)
    assert code.shape[0] == languages and set(np.unique(code)) == {-1.0, 1.0}
    assert not (np.abs(code.sum(0)) == languages).any()
    near = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(languages), 2))
    assert near >= (1 if languages == 2 else 2)


def test_a_wrong_bit_is_corrected():
    code = language_id.codewords(4)
    coder = language_id.Coder(list("abcd"), code, np.eye(7, dtype=np.float32), np.zeros(7), np.ones(7))
    for language in range(4):
        for bit in range(7):
            margins = code[language].copy() * 3
            margins[bit] *= -1
            best, share = coder.decode(margins[None].astype(np.float32))
            assert best[0] == language and share[0] > 0.5


def test_whole_long_texts_count():
    whole = language_id.profile("a" * (1 << 20) + "xyz" * (1 << 19))
    raw = ("a" * (1 << 20) + "xyz" * (1 << 19)).encode()
    assert whole.sum() > 0 and not np.allclose(whole, language_id.profile("a" * (1 << 20)))
    small = language_id.profile("abcab")
    assert np.square(small).sum() == pytest.approx(1) and np.square(whole).sum() == pytest.approx(1)
    assert len(raw) > 2 * language_id._SLICE


def test_odd_rows(trained, odd_docs, odd_rows, no_docs):
    _, coder = trained
    found = language_id.identify(odd_docs, coder).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, *_ in odd_rows)
    texts = {i: t for i, t, *_ in odd_rows if i not in (None, 2, 6)}
    for r in found:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in texts:
            letters = bool(regex.search(r"\p{L}", texts[r.doc_id] or ""))
            assert (r.lang_pred in coder.languages) if letters else (r.lang_pred == "und" and r.score == 0)
    assert language_id.identify(no_docs, coder).count() == 0


def test_little_to_learn_from(spark, odd_docs, no_docs, make_docs):
    for docs in (no_docs, odd_docs.where("doc_id = 3"), make_docs([(i, None, "en") for i in range(10)])):
        coder = language_id.train(docs)
        assert {r.lang_pred for r in language_id.identify(odd_docs, coder).collect()} == {"und"}
    one = language_id.train(make_docs([(i, "words here", "en") for i in range(10)]))
    assert {r.lang_pred for r in language_id.identify(odd_docs, one).collect()} == {"und", "en"}
