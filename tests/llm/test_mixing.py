import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm.mixing import label_weights, mix, mixed_documents, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_out(sizes, pattern=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by handing out again and again what is above the limits."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: pattern[i % 3] for i, s in enumerate(names)}
    free, target, left = set(names), dict.fromkeys(names, 0.0), share * sum(sizes.values())
    while free and left > 1e-9:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if target[s] + weight[s] * level >= most * sizes[s]}
        if not full:
            for s in free:
                target[s] += weight[s] * level
            break
        for s in full:
            left -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        free -= full
    return target


def words(text):
    return len(WORD.findall(text or ""))


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 1000, "c": 7, "d": 0, None: 40, "É": 9}, {"only": 12}, {"a": 0, None: 0}],
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(
        [(s is None, s or "", n) for s, n in sizes.items()], "no_source boolean, source string, source_size long"
    )
    found = {None if r.no_source else r.source: r.target for r in source_targets(rows).collect()}
    assert found == pytest.approx(shared_out(sizes))


def check(found, rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += words(text)
    target = shared_out(sizes)
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((i, words(t)) for i, t, *_ in rows)
    by_source = defaultdict(list)
    for r in found:
        assert r.taken == r.copies * r["size"] and r.taken <= 2 * r["size"]
        by_source[r.source_size, round(r.target, 6)].append(r)
    for source, size in sizes.items():
        own = [r for r in found if (r.source_size, r.target) == (size, pytest.approx(target[source]))]
        assert own
    return target


def test_odd_rows(odd_docs, odd_rows):
    check(mix(odd_docs).collect(), odd_rows)


def test_documents_come_near_their_targets(spark, documents, sf_dir):
    weights = label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mix(documents, weights)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in documents.collect()]
    target = check(mixed.collect(), rows)
    taken = defaultdict(int)
    sources = {r[0]: r[3] for r in rows}
    sizes = defaultdict(list)
    for r in mixed.collect():
        taken[sources[r.doc_id]] += r.taken
        sizes[sources[r.doc_id]].append(r["size"])
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= max(sizes[source]) / 2 + 1
    assert mixed.collect() == mix(documents, weights).collect() or sorted(mixed.collect()) == sorted(mix(documents, weights).collect())


def test_heavier_documents_are_taken_more_often(spark, make_docs):
    rows = [(i, "w " * 10, "en", "a" if i % 2 else "b") for i in range(2_000)]
    weights = spark.createDataFrame([(i, 1.0 if i % 4 < 2 else 0.2) for i in range(2_000)], "id long, weight double")
    found = mix(make_docs(rows), weights, pattern=(1.0, 1.0), share=0.5).collect()
    heavy = sum(r.copies for r in found if r.doc_id % 4 < 2)
    assert sum(r.copies for r in found) == 1_000 and heavy > 650


def test_one_source_over_many_slices(make_docs):
    rows = [(i, "w " * (1 + i % 50), "en", "hot" if i % 3 else "b") for i in range(3_000)]
    check(mix(make_docs(rows)).collect(), rows)


def test_mixture_repeats_documents(odd_docs, no_docs):
    whole = mixed_documents(odd_docs)
    assert whole.columns == odd_docs.columns
    assert whole.count() == mix(odd_docs).agg(F.sum("copies")).first()[0]
    assert mix(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0
