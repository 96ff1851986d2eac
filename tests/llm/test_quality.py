import zlib

import numpy as np
import pytest

from touchline.llm import quality


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, quality.train(docs, labels, rows=3_000)


def test_held_out_accuracy(trained):
    docs, labels, machine = trained
    rows = quality.quality_scores(docs, machine).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(rows) > 500
    assert np.mean([r.predicted for r in good]) > 0.99
    assert np.mean([r.predicted for r in bad]) < 0.1
    scores = np.array([r.score for r in rows])
    ranks, truth = scores.argsort().argsort() + 1, np.array([r.quality for r in rows])
    area = (ranks[truth == 1].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (1 - truth).sum())
    assert area > 0.98


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=quality.DIM), rng.normal(size=(quality.DIM, 4)))
    at, x = quality.features("Some words, some more words | here!!\nand here", 45)
    pairs = sum(
        float(machine.factors[at[i]] @ machine.factors[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i)
    )
    assert machine.margin(at, x) == pytest.approx(0.3 + float(machine.weights[at] @ x) + pairs)


def test_odd_rows_are_scored(trained, odd_docs, odd_rows, no_docs):
    *_, machine = trained
    found = quality.quality_scores(odd_docs, machine).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, *_ in odd_rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert quality.quality_scores(no_docs, machine).count() == 0
    again = {r.doc_id: r.score for r in quality.quality_scores(odd_docs.drop("lang", "source"), machine).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in found if r.doc_id in (1, 8, 9))


def test_few_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 7)], "doc_id long, quality int")
    for docs in (odd_docs, no_docs):
        for some in (labels, labels.limit(0)):
            machine = quality.train(docs, some)
            assert quality.quality_scores(docs, machine).count() == docs.count()


def test_repeated_ids_train_once(spark, make_docs):
    """However many documents carry a labelled id, one of them is trained on, the same in any order."""
    texts = [f"word{i} and more words of text {i % 7}" for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = make_docs([(i, t) for i, t in enumerate(texts)])
    copies = make_docs([(i, t) for i, t in enumerate(texts) for _ in range(30)][::-1])
    one, two = quality.train(once, labels, rows=20), quality.train(copies, labels, rows=20)
    assert one.bias == two.bias and np.array_equal(one.weights, two.weights) and np.array_equal(one.factors, two.factors)


def test_rejected_rows_go(trained, odd_docs):
    docs, labels, _ = trained
    kept = quality.drop_rejected(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    machine = quality.train(docs, labels)
    wanted = quality.quality_scores(docs, machine).where("predicted = 1").count()
    assert quality.drop_rejected(docs, labels).count() == wanted
