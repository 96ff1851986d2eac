import pytest
import regex
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from touchline.llm import packing, token_counts
from touchline.llm.tokens import _PLAIN, json_file, pre_tokens, rank_file, token_ids

TOKENIZER = Tokenizer.from_file(json_file())


def n_tokens(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


def test_plain_characters_split_alike_in_both_libraries():
    pattern, split = regex.compile(PATTERN), TOKENIZER.pre_tokenizer.pre_tokenize_str
    plain = [chr(i) for i in range(0x11000) if not 0xD800 <= i <= 0xDFFF and _PLAIN.fullmatch(chr(i))]
    assert len(plain) > 20_000
    for c in plain:
        text = f"a{c}1{c} {c}{c}!{c}\n {c}"
        assert pattern.findall(text) == [text[a:b] for _, (a, b) in split(text)]


def test_pre_tokens_of_unusual_texts(odd_rows):
    for _, text, *_ in odd_rows:
        found = pre_tokens(text or "", json_file())
        assert "".join(found) == (text or "")


@pytest.mark.parametrize("sample", [1, 6_000])
def test_counts_equal_the_library(odd_docs, odd_rows, monkeypatch, sample):
    monkeypatch.setattr(token_counts.frequent_pieces, "__defaults__", (sample, token_counts.FREQUENT))
    found = token_counts.token_counts(odd_docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found), key=str) == sorted(
        ((i, len((t or "").encode()), n_tokens(t), n_tokens(t) > 1024) for i, t, *_ in odd_rows), key=str
    )


def test_documents(documents, texts_by_id):
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents).collect()}
    assert found == {i: n_tokens(t) for i, t in texts_by_id.items()}


def test_each_pre_token_is_counted_once(spark):
    rows = spark.createDataFrame([(i, t, 1) for i in range(5) for t in (" the", " zq", "!!")], "row long, pre_token string, times int")
    found = token_counts.distinct_pieces(rows, rank_file()).collect()
    assert sorted((r.pre_token, r.pieces) for r in found) == sorted((t, n_tokens(t)) for t in (" the", " zq", "!!"))


def test_empty_table(no_docs):
    assert token_counts.token_counts(no_docs).count() == 0


def test_very_long_blank_runs(make_docs):
    """Over a million blanks or newlines in a row, which the rank file's library does not take."""
    runs = [" " * 1_100_000, "\n" * 1_100_000, "\u3000" * 1_000_100]
    texts = ["a b" + runs[0] + "tail 1", runs[1] + "<|endoftext|>x", "a" + runs[2]]
    rows = list(enumerate(texts))
    wanted = [(i, n_tokens(t)) for i, t in rows]
    for _, text in rows:
        assert token_ids(text, rank_file()).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    docs = make_docs(rows)
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs).collect()) == wanted
    pieces = packing.tokenised_pieces(docs).where("start = 0").select("doc_id", "doc_tokens").collect()
    assert sorted((r.doc_id, r.doc_tokens - 1) for r in pieces) == wanted
