"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Overlong documents are first cut into full windows, each a sequence of its own. The rests, longest first, each go
into the open window with the least room that still holds them, found by a segment tree
over the remaining capacity. Rests are dealt by hash into groups of bounded size that are packed
on their own: thousands of rests fill windows as well as millions would.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import map_texts, written
from touchline.llm.tokens import rank_file, token_ids

WINDOW = 1024
#: Rests (at most one a document) per packing group on average: bounds the memory of one packing task.
GROUP_ROWS = 30_000
#: Documents tokenised before their pieces are handed on.
CHUNK_ROWS = 500

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, deal long"


class CapacityTree:
    """Open windows by remaining capacity; finds the tightest one with enough room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest window with room for ``need``, removed from the tree."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.windows[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, taken longest first (ties in the given order)."""
    window_of = np.zeros(len(lengths), np.int64)
    offset_of = np.zeros(len(lengths), np.int64)
    tree, opened = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        room, window = found
        window_of[i], offset_of[i] = window, capacity - room
        if room > need:
            tree.add(room - need, window)
    return window_of, offset_of


def _pieces_of(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(c, pa.binary() if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "doc_tokens", "deal")]
    )
    row = 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            out = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", path), np.uint32(end_id)).astype("<u4")
                out += [
                    (doc_id, s, len(piece), piece.tobytes(), len(ids), row)
                    for s in range(0, len(ids), capacity)
                    for piece in [ids[s : s + capacity]]
                ]
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def tokenised_pieces(docs: DataFrame, path: str | None = None, capacity: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids, doc_tokens, deal.

    ids holds little-endian unsigned 32-bit integers, with ``end_id`` after each document; deal
    numbers the documents of a scan task. A null or empty text is the single id ``end_id``.
    """
    cut = partial(_pieces_of, path=path or rank_file(), capacity=capacity, end_id=end_id)
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES)


def _packed(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "start", "deal"], ascending=[False, True, True, True], kind="stable")
    window, offset = best_fit(rows["length"].to_numpy(), capacity)
    group = int(rows["pack_group"].iloc[0])
    return rows.assign(sequence_id=(group << 32) + window, offset=offset).drop(columns=["pack_group", "deal"])


def pack(pieces: DataFrame, groups: int, capacity: int = WINDOW) -> DataFrame:
    """``pieces`` (doc_id, start, length, deal and any others) with sequence_id and offset.

    sequence_id is unique over the groups; offset runs gapless from 0 in each sequence. Equal
    lengths are taken by doc_id, start and deal; rows that repeat a doc_id are packed each. Full
    windows are numbered after the groups' sequences and take no part in the packing tasks.
    """
    pieces = written(pieces, "pieces")
    own = (F.lit(groups << 32) + F.monotonically_increasing_id()).alias("sequence_id")
    full = pieces.where(F.col("length") == capacity).drop("deal").select("*", own, F.lit(0).cast("long").alias("offset"))
    group = F.pmod(F.xxhash64("doc_id", "start", "deal"), F.lit(groups))
    grouped = pieces.where(F.col("length") < capacity).withColumn("pack_group", group)
    kept = [f for f in pieces.schema.fields if f.name != "deal"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "sequence_id long, offset long"])

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return _packed(rows, capacity)

    return grouped.groupBy("pack_group").applyInPandas(packed, schema).unionByName(full)


def pack_groups(docs: DataFrame, rows: int = GROUP_ROWS) -> int:
    """Packing groups for the rests of ``docs``, at most one a document; the count comes from the files' metadata."""
    return max(1, -(-docs.count() // rows))


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = WINDOW) -> DataFrame:
    """Every piece of ``docs`` with its ids, sequence_id and offset.

    A null or empty text is one piece of one id, an empty table gives no rows, and other
    columns are not read.
    """
    return pack(tokenised_pieces(docs, path, capacity), pack_groups(docs), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, ids (binary), length. A sequence holds at most one window."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"])).alias("ids"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, part: n + part["length"]).alias("length"),
    )
