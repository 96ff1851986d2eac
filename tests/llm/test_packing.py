import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import packing
from touchline.llm.tokens import json_file, rank_file, token_ids

TOKENIZER = Tokenizer.from_file(json_file())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def first_principles(lengths, capacity):
    """Best fit decreasing by looking at every open window."""
    rooms, sizes = [], sorted(lengths, reverse=True)
    for need in sizes:
        open_ = [r for r in rooms if r >= need]
        if open_:
            rooms.remove(min(open_))
            rooms.append(min(open_) - need)
        else:
            rooms.append(capacity - need)
    return sorted(rooms)


def test_tree_finds_the_tightest_window():
    rng = random.Random(3)
    for _ in range(20):
        capacity = rng.choice([16, 100, 1024])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
        window, offset = packing.best_fit(np.array(lengths), capacity)
        rooms = [capacity] * (window.max() + 1)
        for n, w in zip(lengths, window, strict=True):
            rooms[w] -= n
        assert sorted(rooms) == first_principles(lengths, capacity)
        for w in range(len(rooms)):
            own = sorted((o, n) for n, x, o in zip(lengths, window, offset, strict=True) if x == w)
            assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()


def test_ids_equal_the_tokenizers_library(documents, odd_rows):
    texts = [t or "" for _, t, *_ in odd_rows] + [r.text or "" for r in documents.limit(100).collect()]
    for text in texts:
        assert [*token_ids(text, rank_file()).tolist(), 0] == ids_of(text)


def check(found, rows, capacity):
    whole = {}
    for r in found:
        whole.setdefault((r.doc_id, r.deal), []).append(r)
    got = []
    for (doc_id, _), pieces in whole.items():
        ids = []
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.frombuffer(r.ids, "<u4").tolist()
            assert r.start == len(ids) and r.length == len(part) <= capacity
            ids += part
        assert {r.doc_tokens for r in pieces} == {len(ids)}
        got.append((doc_id, ids))
    assert sorted(got, key=str) == sorted(((i, ids_of(t)) for i, t, *_ in rows), key=str)


def test_pieces_and_sequences_hold_every_id_once(odd_docs, odd_rows):
    pieces = packing.tokenised_pieces(odd_docs)
    check(pieces.coalesce(1).collect(), odd_rows, 1024)
    packed = packing.packed_documents(odd_docs)
    by_sequence = {}
    for r in packed.collect():
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for own in by_sequence.values() for r in own) == sum(len(ids_of(t)) for _, t, *_ in odd_rows)
    for row in packing.sequences(packed).collect():
        own = sorted(by_sequence[row.sequence_id], key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert row.length == sum(r.length for r in own) <= 1024
        assert row.ids == b"".join(bytes(r.ids) for r in own)


def test_little_padding(documents):
    packed = packing.packed_documents(documents)
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert sums[0] / (1024 * sums[1]) > 0.97


def test_groups_have_their_own_sequences(documents):
    pieces = packing.tokenised_pieces(documents).drop("ids")
    packed = packing.pack(pieces, 4)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_empty_table(no_docs):
    assert packing.packed_documents(no_docs).count() == 0


def test_full_windows_meet_no_packing_task(make_docs, monkeypatch):
    """A book of many windows: only its rest comes to the frames of the packing tasks."""
    best_fit = packing.best_fit

    def rests_only(lengths, capacity):
        assert len(lengths) <= 3 and lengths.max() < capacity
        return best_fit(lengths, capacity)

    monkeypatch.setattr(packing, "best_fit", rests_only)
    rows = [(1, "word and " * 40_000), (2, "word and " * 20_000), (3, "short")]
    packed = packing.packed_documents(make_docs(rows)).collect()
    check([Row(**r.asDict(), deal=0) for r in packed], rows, 1024)
    full = [r for r in packed if r.length == 1024]
    assert len(full) > 100 and {r.offset for r in full} == {0}
    assert not {r.sequence_id for r in full} & {r.sequence_id for r in packed if r.length < 1024}
    assert len({r.sequence_id for r in full}) == len(full)



def test_blank_runs_just_below_the_long_ones_are_scanned_once():
    """Two runs one blank short of LONG_RUN and one that has it: the ids of the library, in seconds."""
    import time

    from tokenizers import Tokenizer

    from touchline.llm import tokens

    text = "a" + " " * (tokens.LONG_RUN - 1) + "b" + " " * (tokens.LONG_RUN - 1) + "c" + " " * tokens.LONG_RUN + "d"
    began = time.perf_counter()
    assert [m.span() for m in tokens._LONG_BLANKS.finditer(text)] == [(2 * tokens.LONG_RUN + 1, 3 * tokens.LONG_RUN + 1)]
    assert time.perf_counter() - began < 2
    found = tokens.token_ids(text, tokens.rank_file()).tolist()
    assert found == Tokenizer.from_file(tokens.json_file()).encode(text, add_special_tokens=False).ids
