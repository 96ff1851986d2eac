"""The audit against a simulation that runs every order over the documents."""

import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import pytest

from touchline.llm.filter_audit import audit, coalition_removals, failures, shapley_values


def fails_of(rows):
    """By row: the letters of the failed filters, from the wording of the filters."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = ""
        if len(words) < 200:
            failed += "A"
        if 100 * len(set(words)) < 50 * len(words):
            failed += "B"
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            failed += "C"
        if re.search(r"[#$%&*|]", text):
            failed += "D"
        lowest = -(10**30)
        own = lowest if doc_id is None else doc_id
        if any((other[1] or "") == text and (lowest if other[0] is None else other[0]) < own for other in rows):
            failed += "E"
        out.append(failed)
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for row, failed in zip(rows, fails_of(rows), strict=True):
        parts[row[2] or ""].append((row[0], failed))
    out = {}
    for part, docs in parts.items():
        totals = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in d[1] for d in docs) - len(gone),
                    sum(d[1] == letter for d in docs),
                    sum(d[0] in good for d in gone),
                    sum(d[0] in toxic for d in gone),
                ]
                totals[letter] += len(gone)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(totals[order[step - 1]])
    return {key: tuple(values) for key, values in out.items()}


def collected(found):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_odd_rows(spark, odd_docs, odd_rows):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (8, 0, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1)]
    assert collected(audit(odd_docs, label_table(spark, labels))) == brute(odd_rows, labels)


def test_mixed_texts(spark, make_docs):
    plain = " ".join(f"w{i}" for i in range(220))
    texts = [plain, plain.upper(), plain + " #", "same " * 300, "SAME * " * 300, "short", "Short |", plain[:-1], "é" * 40 + "AB", ""]
    rows = [(i, texts[(i * i + i // 7) % len(texts)], ["en", "de", None, ""][i % 4], "s") for i in range(160)]
    labels = [(i, i % 3 % 2, i % 5 == 0 and 1 or 0) for i in range(0, 160, 2)]
    found = collected(audit(make_docs(rows), label_table(spark, labels)))
    assert found == brute(rows, labels)
    assert len(found) == 3 * 600


def test_empty_tables(spark, no_docs, odd_docs):
    nothing = label_table(spark, [])
    assert audit(no_docs, nothing).count() == 0
    assert all(v[4] == v[5] == 0 for v in collected(audit(odd_docs, nothing)).values())


@pytest.mark.parametrize("seed", range(4))
def test_least_squares_give_the_shapley_values(seed):
    counts = {mask: (mask * 7919 + seed * 104729) % 53 for mask in range(32)}
    removals = coalition_removals(counts)
    # A removed document is shared evenly by the filters that it fails.
    wanted = [sum(Fraction(n, mask.bit_count()) for mask, n in counts.items() if mask >> i & 1) for i in range(5)]
    assert shapley_values(removals) == wanted


def test_limits_are_strict():
    words = [f"w{i}" for i in range(200)]
    assert failures(" ".join(words).encode()) == 0
    assert failures(" ".join(words[:199]).encode()) == 1
    assert failures(" ".join(words[:100] * 2).encode()) == 0  # exactly half are distinct
    assert failures(" ".join([*words[:100], *words[1:100], "w1", "w1"]).encode()) == 2
    assert failures(b"A" * 3 + b"a" * 97) == 1  # 3 of 100 is not over 3 %
    assert failures(b"A" * 4 + b"a" * 96) == 1 + 4
