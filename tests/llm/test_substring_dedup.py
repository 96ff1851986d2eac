import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from touchline.llm.substring_dedup import remove_repeats, repeated_starts, samples


def brute(rows, width):
    raws = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(raw[p : p + width] for raw in raws for p in range(len(raw) - width + 1))
    out = []
    for (i, *_), raw in zip(rows, raws, strict=True):
        covered = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if seen[raw[p : p + width]] > 1:
                covered[p : p + width] = b"\1" * width
        spans, start = [], None
        for p, c in enumerate([*covered, 0]):
            if c and start is None:
                start = p
            if not c and start is not None:
                spans.append((start, p))
                start = None
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        out.append((i, len(raw), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def collected(found):
    rows = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in found.collect()]
    return sorted(rows, key=str)


def passages(seed, n=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé\x00 ") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(word() for _ in range(20)) for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(n, "Und " * 300), (n + 1, "der " * 200 + "Und " * 100), (n + 2, "abab" * 150 + "x" + "abab" * 100), (n + 3, "z" * 700)]
    return rows


@pytest.mark.parametrize(("seed", "block", "heavy"), [(1, 20_000, 100_000), (2, 30, 100_000), (3, 20_000, 5), (4, 50, 1)])
def test_matches_brute_force(make_docs, seed, block, heavy):
    rows = passages(seed)
    found = remove_repeats(make_docs(rows), width=60, gram=20, block=block, heavy=heavy)
    assert collected(found) == brute(rows, 60)


def test_production_sizes_on_documents(documents, texts_by_id):
    rows = list(texts_by_id.items())
    assert collected(remove_repeats(documents)) == brute(rows, 200)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = [r for r in odd_rows if len(r[1] or "") < 1000]
    small = odd_docs.where("text IS NULL OR length(text) < 1000")
    assert collected(remove_repeats(small)) == brute(rows, 200)
    assert collected(remove_repeats(small, width=20, gram=8)) == brute(rows, 20)
    assert remove_repeats(no_docs).count() == 0


def test_slices_of_a_long_text_are_one_cover():
    rng = random.Random(5)
    raw = bytes(rng.choice(b"ab") for _ in range((1 << 19) + 5_000))
    positions, hashes = samples(raw)
    assert len(positions) == len(hashes) == len(set(positions.tolist()))
    gaps = np.diff(np.concatenate([[-1], positions, [len(raw) - 64 + 1]]))
    assert gaps.max() <= 200 - 64 + 1  # a sample in every run
    for at in rng.sample(range(len(positions)), 40):
        p = int(positions[at])
        lone, own = samples(raw[p - 136 : p + 200] if p >= 136 else raw[: p + 200])
        assert hashes[at] in own.tolist()


def test_sorted_block_by_brute_force():
    rng = random.Random(9)
    width, gram = 12, 4
    seen = {}
    for _ in range(300):
        lead = rng.randint(0, width - gram)
        seen[lead, bytes(rng.choice(b"\x00a") for _ in range(lead)) + b"GRAM" + bytes(rng.choice(b"\x00a") for _ in range(rng.randint(0, 8)))] = rng.choice([1, 1, 1, 2])
    leads, contexts, counts = [k[0] for k in seen], [k[1] for k in seen], list(seen.values())
    found = repeated_starts(np.array(leads), contexts, np.array(counts), width, gram)
    for d in range(width - gram + 1):
        strings = [c[a - d : a - d + width] if a >= d and len(c) - a >= width - d else None for a, c in zip(leads, contexts, strict=True)]
        times = Counter()
        for s, n in zip(strings, counts, strict=True):
            times[s] += n
        assert found[:, d].tolist() == [s is not None and times[s] > 1 for s in strings]
