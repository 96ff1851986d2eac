import hashlib
from collections import defaultdict

from touchline.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_matches_brute_force_on_odd_rows(odd_docs, odd_rows):
    found = exact_duplicates(odd_docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(odd_rows)
    kept = defaultdict(int)
    for r in found:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_matches_brute_force_on_documents(documents, texts_by_id):
    found = exact_duplicates(documents).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(texts_by_id.items())


def test_a_group_with_a_third_of_all_rows(make_docs):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(600)]
    found = exact_duplicates(make_docs(rows)).where("group_size > 1").collect()
    assert len(found) == 200 and {(r.keep_id, r.group_size) for r in found} == {(597, 200)}
    assert sum(r.kept for r in found) == 1


def test_kept_rows_have_the_documents_columns(odd_docs, no_docs, odd_rows):
    kept = drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({(t or "").translate(LOWER) for _, t, *_ in odd_rows})
    assert drop_exact_duplicates(no_docs).count() == 0 and exact_duplicates(no_docs).count() == 0
