"""Removal of repeated byte strings by sorting suffix buckets one block at a time.

A byte goes if a string of WIDTH bytes that covers it also starts anywhere else. The suffixes that can share
such a string are found by a cover of sampled positions: in every run of WIDTH - GRAM + 1 positions the one
whose next GRAM bytes hash smallest (leftmost of equals). Equal strings hold the same sample at the same offset, so
strings that start ``d`` bytes before a sample are compared at that sample only, and a sample whose GRAM occurs once
needs no comparing. The samples' contexts (up to WIDTH - GRAM bytes before, WIDTH bytes from there on) are bucketed by gram
and sorted block by block: ranks of the right contexts, ranks of the reversed left contexts, and their longest
common prefixes decide for every ``d`` at once which strings are equal, byte by byte. Only the
contexts of repeated samples move, and a block holds a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import lookup_join, map_texts, whole_text, written

WIDTH = 200
GRAM = 64
#: Samples per sorted block on average.
BLOCK = 20_000
#: Occurrences of one gram beyond which its strings are compared by digest, a row for each string.
HEAVY = 100_000

_SLICE = 1 << 19
_POSITION = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 500


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        both.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)])))
    return both[0], both[1]


def _samples_of(raw: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the cover of one slice."""
    run, n = width - gram + 1, len(raw)
    power, inverse = _powers(_SLICE + 4096)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8) + np.uint64(1)) * power[:n], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
    for shift, factor in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        hashes ^= hashes >> np.uint64(shift)
        hashes *= np.uint64(factor)
    hashes ^= hashes >> np.uint64(31)
    m = len(hashes)
    ranked = np.full(-(-m // run) * run, ~np.uint64(0), np.uint64)
    ranked[:m] = (hashes & ~_POSITION) | np.arange(m, dtype=np.uint64)
    blocks = ranked.reshape(-1, run)
    to_end = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    from_start = np.minimum.accumulate(blocks, 1).ravel()
    runs = m - run + 1
    least = np.minimum(to_end[:runs], from_start[run - 1 : run - 1 + runs])
    positions = np.unique(least & _POSITION).astype(np.int64)
    return positions, hashes[positions].view(np.int64)


def samples(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the cover of a whole text; none if it is shorter than ``width``."""
    found = [
        (positions + at, hashes)
        for at in range(0, max(1, len(raw) - width + 1), _SLICE)
        if len(raw) >= width
        for positions, hashes in [_samples_of(raw[at : at + _SLICE + width - 1], width, gram)]
    ]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    positions, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
    return positions, np.concatenate([h for _, h in found])[first]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _cover(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("grams", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32()))])
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(at, _CHUNK)
            found = [samples(_raw(t), width, gram) for t in part.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], schema.field(n).type) for n, i in (("grams", 1), ("positions", 0))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    schema, pack = pa.schema([("row", pa.int64()), ("packed", pa.binary())]), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(at, _CHUNK)
            packed = [pack.compress(_raw(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], schema=schema)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, dict]]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64).to_pydict()
            for i, row in enumerate(part["row"]):
                yield row, unpack.decompress(part["packed"][i]), {k: v[i] for k, v in part.items()}


def _contexts(raw: bytes, marks: list[dict], width: int, gram: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(position, gram hash, lead, context, key) of each sample; key stands for (lead, context)."""
    reach = width - gram
    for mark in marks:
        at = mark["position"]
        start = max(0, at - reach)
        context = raw[start : at + width]
        yield at, mark["gram"], at - start, context, xxhash.xxh3_128_digest(context, at - start)


_CONTEXT = pa.schema([("block", pa.int32()), ("key", pa.binary()), ("lead", pa.int32()), ("context", pa.binary()), ("n", pa.int64())])
_PLACE = pa.schema([("row", pa.int64()), ("key", pa.binary()), ("positions", pa.list_(pa.int32()))])


def _combined_contexts(batches, blocks: int, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts of the samples, equal ones of nearby documents combined."""

    def ready(found: dict) -> pa.RecordBatch:
        rows = [(block, key, lead, context, n) for (key, lead, context), (block, n) in found.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTEXT)], schema=_CONTEXT)

    found: dict = {}
    for _, raw, doc in _documents(batches):
        for _, gram_hash, lead, context, key in _contexts(raw, [m for m in doc["marks"] if not m["heavy"]], width, gram):
            seen = found.get((key, lead, context))
            found[key, lead, context] = (gram_hash % blocks, 1) if seen is None else (seen[0], seen[1] + 1)
        if len(found) > 30_000:
            yield ready(found)
            found = {}
    if found:
        yield ready(found)


def _places(batches, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(row, key, positions): where each context of a document stands."""
    rows: list = []
    for row, raw, doc in _documents(batches):
        found: dict = {}
        for at, _, _, _, key in _contexts(raw, [m for m in doc["marks"] if not m["heavy"]], width, gram):
            found.setdefault(key, []).append(at)
        rows += [(row, key, positions) for key, positions in found.items()]
        if len(rows) > 30_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACE)], schema=_PLACE)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACE)], schema=_PLACE)


def _ranked(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lengths in order, common prefix with the one before) of the sorted strings."""
    lengths = np.array([len(s) for s in strings])
    wide = -(-width // 8) * 8
    matrix = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), np.uint8).reshape(len(strings), wide)
    words = matrix.view(">u8").astype(np.uint64)
    order = np.lexsort([lengths, *words.T[::-1]])
    matrix, lengths = matrix[order], lengths[order]
    common = np.zeros(len(order), np.int64)
    differ = matrix[1:] != matrix[:-1]
    common[1:] = np.where(differ.any(1), differ.argmax(1), wide)
    common[1:] = np.minimum(common[1:], np.minimum(lengths[1:], lengths[:-1]))
    return order, lengths, common


def _names(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number per string that equal prefixes of ``depth`` bytes share."""
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(common < depth)
    return names


def repeated_starts(leads: np.ndarray, contexts: list[bytes], counts: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Boolean (context, d): the string that starts ``d`` bytes before the sample occurs elsewhere.

    Contexts are distinct; one that stands for several places repeats every string it holds. Equal strings hold the
    same gram, so only contexts that share their gram's bytes with another one are sorted.
    """
    reach = width - gram
    found = np.zeros((len(contexts), reach + 1), bool)
    kinds = pd.factorize(np.array([c[a : a + gram] for a, c in zip(leads.tolist(), contexts, strict=True)], object))[0]
    shared = np.bincount(kinds)[kinds] > 1
    rights = np.array([len(c) for c in contexts]) - leads
    back = np.arange(reach + 1)
    lone = ~shared & (counts > 1)
    found[lone] = (leads[lone, None] >= back) & (rights[lone, None] >= width - back)
    if shared.any():
        some = [contexts[i] for i in np.flatnonzero(shared)]
        found[shared] = _repeated_by_sorting(leads[shared], some, counts[shared], width, gram)
    return found


def _repeated_by_sorting(leads: np.ndarray, contexts: list[bytes], counts: np.ndarray, width: int, gram: int) -> np.ndarray:
    reach = width - gram
    right = _ranked([c[a:] for a, c in zip(leads.tolist(), contexts, strict=True)], width)
    left = _ranked([c[:a][::-1] for a, c in zip(leads.tolist(), contexts, strict=True)], reach)
    rights = np.array([len(c) for c in contexts]) - leads
    found = np.zeros((len(contexts), reach + 1), bool)
    for d in range(reach + 1):
        whole = np.flatnonzero((leads >= d) & (rights >= width - d))
        pair = _names(left[0], left[2], d)[whole] * (len(contexts) + 1) + _names(right[0], right[2], width - d)[whole]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        found[whole, d] = twice | (counts[whole] > 1)
    return found


def _sorted_block(rows: pd.DataFrame, width: int, gram: int) -> pd.DataFrame:
    found = repeated_starts(rows["lead"].to_numpy(), rows["context"].tolist(), rows["n"].to_numpy(), width, gram)
    some = np.flatnonzero(found.any(1))
    packed = np.packbits(found[some], axis=1)
    out = {"key": rows["key"].iloc[some].tolist(), "n": rows["n"].iloc[some].tolist(), "starts": [p.tobytes() for p in packed]}
    return pd.DataFrame(out, columns=["key", "n", "starts"])


_STRING = pa.schema([("row", pa.int64()), ("digest", pa.binary()), ("start", pa.int32())])


def _heavy_strings(batches, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(row, digest, start) of every string of ``width`` bytes at a sample of a very frequent gram."""
    rows: list = []
    for row, raw, doc in _documents(batches):
        starts = {
            s
            for m in doc["marks"]
            if m["heavy"]
            for s in range(max(0, m["position"] - width + gram), min(m["position"], len(raw) - width) + 1)
        }
        rows += [(row, xxhash.xxh3_128_digest(raw[s : s + width]), s) for s in sorted(starts)]
        if len(rows) > 30_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STRING)], schema=_STRING)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STRING)], schema=_STRING)


_CUT = pa.schema(
    [("row", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
)


def spans_of(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _cut(batches, width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(row, spans, kept) from the document and the starts found in it."""
    rows: list = []
    size = 0
    for row, raw, doc in _documents(batches):
        change = np.zeros(len(raw) + 1, np.int64)
        starts: set[int] = set()
        for place in doc["places"]:
            back = np.flatnonzero(np.unpackbits(np.frombuffer(place["starts"], np.uint8), count=width - gram + 1))
            for at in place["positions"]:
                starts.update((at - back).tolist())
        starts.update(doc["alone"] or ())
        at = np.fromiter(starts, np.int64, len(starts))
        change[at] += 1
        np.subtract.at(change, at + width, 1)
        covered = np.cumsum(change[:-1]) > 0
        kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        rows.append((row, [{"start": a, "end": b} for a, b in spans_of(covered)], kept))
        size += len(kept)
        if size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)


def repeated_spans(
    texts: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, heavy: int = HEAVY
) -> DataFrame:
    """(row, spans, kept) of every text of (row, text) that loses bytes.

    spans are the maximal removed runs in bytes, kept the remaining bytes. ``texts`` is read several times and
    must give a row the same text each time, as a table of files does.
    """
    # Read twice below: written, so that the texts are hashed once.
    cover = written(map_texts(texts, partial(_cover, width=width, gram=gram), "row long, grams array<long>, positions array<int>"), "cover")
    grams = cover.select("row", F.explode(F.arrays_zip("grams", "positions")).alias("s"))
    grams = grams.select("row", F.col("s.grams").alias("gram"), F.col("s.positions").alias("position"))
    repeated = written(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "repeated-grams")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block))

    places = lookup_join(grams, repeated, "gram", "n")
    mark = F.struct("position", "gram", (F.col("n") > heavy).alias("heavy"))
    marks = places.groupBy("row").agg(F.collect_list(mark).alias("marks"))  # at most the samples of one document
    packed = map_texts(texts, _packed, "row long, packed binary")
    documents = written(packed.join(marks, "row"), "repeating-documents")

    sizes = {"width": width, "gram": gram}
    contexts = documents.mapInArrow(
        partial(_combined_contexts, blocks=blocks, **sizes), "block int, key binary, lead int, context binary, n long"
    )
    # One exchange serves the combining of equal contexts and the sorting of blocks.
    contexts = contexts.repartition("block").groupBy("block", "key", "lead", "context").agg(F.sum("n").alias("n"))

    def sort_block(rows: pd.DataFrame) -> pd.DataFrame:
        return _sorted_block(rows, width, gram)

    starts = contexts.groupBy("block").applyInPandas(sort_block, "key binary, n long, starts binary")
    at = documents.mapInArrow(partial(_places, **sizes), "row long, key binary, positions array<int>")
    hits = lookup_join(at, written(starts, "repeated-starts"), "key", "n")
    by_row = hits.groupBy("row").agg(F.collect_list(F.struct("positions", "starts")).alias("places"))

    alone = _heavy_hits(documents, sizes) if repeated.where(F.col("n") > heavy).limit(1).count() else None
    if alone is None:
        found = documents.select("row", "packed").join(by_row, "row").withColumn("alone", F.lit(None).cast("array<int>"))
    else:
        found = documents.select("row", "packed").join(by_row, "row", "left").join(alone, "row", "left")
        found = found.where("places IS NOT NULL OR alone IS NOT NULL")
        none = F.array().cast("array<struct<positions:array<int>,starts:binary>>")
        found = found.withColumn("places", F.coalesce("places", none))
    return found.mapInArrow(partial(_cut, **sizes), "row long, spans array<struct<start:long,end:long>>, kept binary")


def _heavy_hits(documents: DataFrame, sizes: dict) -> DataFrame:
    """(row, alone): starts of repeated strings at the samples of very frequent grams."""
    strings = documents.mapInArrow(partial(_heavy_strings, **sizes), "row long, digest binary, start int")
    twice = written(strings.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "heavy-strings")
    hits = lookup_join(strings, twice, "digest", "n")
    return hits.groupBy("row").agg(F.collect_list("start").alias("alone"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per document: row (the scan's), id, n_bytes, spans, kept_sha256.

    A null text is empty. A document shorter than the width loses nothing; a text that is there twice, under
    one id or two, loses every byte if it is long enough. An empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    cut = repeated_spans(texts, **sizes).select("row", "spans", F.sha2("kept", 256).alias("cut_sha256"))
    raw = whole_text(text_col).cast("binary")
    base = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col),
        F.octet_length(raw).cast("long").alias("n_bytes"),
        F.sha2(raw, 256).alias("whole_sha256"),
    )
    none = F.array().cast("array<struct<start:long,end:long>>")
    return base.join(cut, "row", "left").select(
        "row",
        id_col,
        "n_bytes",
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
    )
