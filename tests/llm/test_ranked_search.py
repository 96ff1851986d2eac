"""The pipeline against a score of every document for every item."""

import math
import re
from collections import Counter

import pytest

from touchline.llm import ranked_search as module
from touchline.llm.ranked_search import search, terms_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=10):
    """(item, rank, document, score) of every item's best, sorted."""
    counts = [(row[0], Counter(words_of(row[1]))) for row in docs]
    counts = [(-(2**63) if i is None else i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = 0
            for term in words_of(text):
                if c[term]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc))
        out += [(item, rank, None if doc == -(2**63) else doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def collected(found):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str)


def item_table(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, row string, rank string")


ITEMS = [
    (1, "hello world, WORLD of words"),
    (1, "a second item of the same id: words"),
    (2, None),
    (3, " .,; "),
    (4, "É accents 0 stay nowhere"),
    (None, "token5 and3 long LONG"),
    (5, "unheard"),
    (6, "with two texts " * 30),
]


def test_terms():
    assert terms_of("Don't É-Öl x_Y 9 z　ÀÉ".encode()) == [w.encode() for w in ("don", "t", "É", "Öl", "x", "y", "9 z　ÀÉ")]
    assert terms_of(None) == terms_of(b" ,.") == []


def test_odd_rows(spark, odd_docs, odd_rows):
    assert collected(search(odd_docs, item_table(spark, ITEMS))) == brute(odd_rows, ITEMS)


def test_empty_tables(spark, no_docs, odd_docs):
    assert search(no_docs, item_table(spark, ITEMS)).count() == 0
    assert search(odd_docs, item_table(spark, [])).count() == 0


@pytest.mark.parametrize("sizes", [(4096, 4096, 256), (7, 3, 2)])
def test_many_ties_and_blocks(spark, make_docs, monkeypatch, sizes):
    """Copies tie at the cut; slices, passes and bundles of any size give the same rows."""
    for name, size in zip(("SLICE", "ITEMS", "BUNDLE"), sizes, strict=True):
        monkeypatch.setattr(module, name, size)
    texts = ["common word", "common word rare", "common " * 9 + "other", "word " * 3 + "rare other", "no match here", "", None]
    rows = [(1000 - i * 7 % 211, texts[i * i % 7] if i % 5 else f"common t{i % 11} u{i % 3} rare") for i in range(180)]
    items = [(1, "common"), (2, "rare word"), (3, "t3 u1 other other"), (4, "common word rare other t1 t2 t3 u0"), (5, "here")]
    assert collected(search(make_docs(rows), item_table(spark, items))) == brute(rows, items)


def test_given_documents(spark, documents, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    found = collected(search(documents, items))
    assert found == brute(docs, asked) and len(found) > 50
