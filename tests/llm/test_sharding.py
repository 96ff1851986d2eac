import zlib

import pytest

from touchline.llm.sharding import assign_shards


def check(found, rows, shards):
    total = sum(r.size for r in found)
    largest = max(r.size for r in found)
    assert len(found) == len(rows)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str
    )
    for shard in {r.shard for r in found}:
        own = [r for r in found if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= 2 * largest
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}
    in_order = sorted(found, key=lambda r: (r.shard, r.slot))
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in in_order]
    assert ids == sorted(ids)


@pytest.mark.parametrize("ranges", [4, 64])
def test_documents(documents, texts_by_id, ranges):
    found = assign_shards(documents, 16, ranges=ranges).collect()
    check(found, list(texts_by_id.items()), 16)
    sizes = [sum(r.size for r in found if r.shard == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in found)


def test_odd_rows(odd_docs, odd_rows):
    check(assign_shards(odd_docs, 3).collect(), odd_rows, 3)


def test_one_id_holds_most_rows(make_docs):
    rows = [(7 if i % 3 else i, f"text {i % 5}" * (1 + i % 7)) for i in range(900)]
    check(assign_shards(make_docs(rows), 16, ranges=32).collect(), rows, 16)


def test_overfull_range_is_subdivided(make_docs):
    rows = [(i, "x" * (5_000 if 100 <= i < 140 else 1)) for i in range(3_000)]
    found = assign_shards(make_docs(rows), 8, ranges=40).collect()
    check(found, rows, 8)


def test_empty_table(no_docs):
    assert assign_shards(no_docs).count() == 0
