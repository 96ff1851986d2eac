"""Ranked lexical search by a pipeline over the owners of the terms.

Every term has an owner: the terms are divided by rarity into a few owners, rarest first. The items' terms are
counted once in every document, by slices of some thousand documents. A bundle of items then passes the owners one after
the other, per slice: at each stage it meets the owner's postings of that slice (cogroup), which add integer contributions to
the sparse accumulators it carries. An accumulator that cannot reach the ten best of its slice any more, even with the most that
the owners still to come could give, is left behind; the last stage picks each slice's best, and the best of all slices
are the answer. A term in every document is a posting list per slice, so no task holds a whole list.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import id_back, id_order, map_texts, slices, written

#: An owner has the terms in at most 1/64, 1/8, 1/2 and all of the documents that its predecessors have not.
OWNERS = (64, 8, 2, 1)
#: Documents and postings of a slice at most (a single document may have more postings).
SLICE, POSTINGS = 4096, 2_000_000
#: Items whose terms are counted in one pass over the documents, and items of one bundle.
ITEMS, BUNDLE = 4096, 256
#: No posting contributes more than its term's weight times this.
MOST = 1_000_000

#: On UTF-8 every character that is a letter or digit of ASCII, or not of ASCII, is made of these bytes.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a whole text in UTF-8, in order and with repeats, A-Z lower-cased."""
    return _TERM.findall(text.lower()) if text else []


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The factor of a term's weight: saturating in ``tf``, less in a long document."""
    m = 100 - 75 + (75 * lengths * documents) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _counted(batches: Iterator[pa.RecordBatch], words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A row per slice: its number, documents with terms, their terms, and the postings of ``words`` sorted by term."""
    known, at = {word: i for i, word in enumerate(words)}, 0
    task = TaskContext.get().partitionId() << 32
    ids, lengths, found, documents, total, size = [], [], [], 0, 0, 0

    def packed():
        nonlocal ids, lengths, found, documents, total, size, at
        empty = np.empty(0, np.int64)
        docs = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
        term = np.concatenate([empty, *(t for t, _ in found)])
        tf = np.concatenate([empty, *(c for _, c in found)])
        order = np.argsort(term, kind="stable")
        kinds = ((term[order], "<i4"), (docs[order], "<u2"), (tf[order], "<i4"), (np.array(ids, np.int64), "<i8"), (np.array(lengths), "<i8"))
        row = [[task + at], [documents], [total], *([array.astype(kind).tobytes()] for array, kind in kinds)]
        ids, lengths, found, documents, total, size, at = [], [], [], 0, 0, 0, at + 1
        return pa.RecordBatch.from_pydict(dict(zip(("slice", "documents", "total", "terms", "docs", "tf", "ids", "lengths"), row, strict=True)))

    for part in slices(batches):
        for id_, text in zip(part.column("order").to_pylist(), part.column("text").to_pylist(), strict=True):
            own = terms_of(text)
            if own:
                documents, total = documents + 1, total + len(own)
                numbers = np.fromiter(map(known.get, own, repeat(-1)), np.int64, len(own))
                numbers = numbers[numbers >= 0]
                if len(numbers):
                    ids.append(id_)
                    lengths.append(len(own))
                    found.append(np.unique(numbers, return_counts=True))
                    size += len(found[-1][0])
                    if len(ids) >= SLICE or size >= POSTINGS:
                        yield packed()
    if documents:
        yield packed()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms in batch.column("terms").to_pylist():
            term, n = np.unique(np.frombuffer(terms, "<i4"), return_counts=True)
            yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.int32()), "n": pa.array(n, pa.int64())})


class _Bundle:
    """The items of one bundle: per owner the weights of their terms, and the most that later owners can add."""

    def __init__(self, items: list[Counter], weights: dict[int, int], owners: dict[int, int]):
        self.items = len(items)
        self.terms: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        most = np.zeros((len(OWNERS) + 1, len(items)), np.int64)
        for owner in range(len(OWNERS)):
            held: dict[int, list[tuple[int, int]]] = {}
            for number, terms in enumerate(items):
                for term, times in terms.items():
                    if owners.get(term) == owner and weights[term]:
                        held.setdefault(term, []).append((number, times * weights[term]))
                        most[owner, number] += times * weights[term] * MOST
            self.terms.append({t: (np.array([n for n, _ in rows]), np.array([w for _, w in rows], np.int64)) for t, rows in held.items()})
        #: Row ``owner``: what the owners after it can add to each item.
        self.later = np.cumsum(most[::-1], axis=0)[::-1][1:]


def _owned(batches, owner: int, bundles: list[_Bundle], documents: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The postings of one owner, with impacts for counts: a row per slice and bundle that has any of its terms."""
    for batch in batches:
        for row in batch.to_pylist():
            term, docs, tf = (np.frombuffer(row[c], kind) for c, kind in (("terms", "<i4"), ("docs", "<u2"), ("tf", "<i4")))
            lengths = np.frombuffer(row["lengths"], "<i8")
            for number, bundle in enumerate(bundles):
                mine = np.isin(term, np.fromiter(bundle.terms[owner], np.int32))
                if mine.any():
                    impact = impacts(tf[mine].astype(np.int64), lengths[docs[mine]], documents, terms)
                    out = {"slice": [row["slice"]], "bundle": pa.array([number], pa.int32())}
                    arrays = (("terms", term[mine], "<i4"), ("docs", docs[mine], "<u2"), ("impacts", impact, "<i4"))
                    yield pa.RecordBatch.from_pydict(out | {name: [array.astype(kind).tobytes()] for name, array, kind in arrays})


def _stage(carried: pd.DataFrame, postings: pd.DataFrame, owner: int, bundles: list[_Bundle], keep: int) -> pd.DataFrame:
    """The bundle of a slice after an owner has added its contributions."""
    if not len(carried):
        return carried
    bundle, ids = bundles[int(carried["bundle"].iat[0])], np.frombuffer(carried["ids"].iat[0], "<i8")
    scores = np.zeros((bundle.items, len(ids)), np.int64)
    at = np.frombuffer(carried["cells"].iat[0], "<i4")
    scores.ravel()[at] = np.frombuffer(carried["scores"].iat[0], "<i8")
    if len(postings):
        term, docs, impact = (np.frombuffer(postings[c].iat[0], kind) for c, kind in (("terms", "<i4"), ("docs", "<u2"), ("impacts", "<i4")))
        first = np.flatnonzero(np.diff(term, prepend=-1))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(term)], strict=True):
            items, weights = bundle.terms[owner][int(term[lo])]
            scores[np.ix_(items, docs[lo:hi])] += weights[:, None] * impact[lo:hi].astype(np.int64)
    if len(ids) > keep:
        # The keep-th best so far can only rise, and what stays below it with all that is to come is out.
        limit = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
        scores[scores + bundle.later[owner][:, None] < limit[:, None]] = 0
    at = np.flatnonzero(scores)
    return carried.assign(cells=[at.astype("<i4").tobytes()], scores=[scores.ravel()[at].astype("<i8").tobytes()])


def _stage_of(owner: int, bundles: list[_Bundle], keep: int):
    def stage(carried: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        return _stage(carried, postings, owner, bundles, keep)

    return stage


def _picked(rows: Iterator[pd.DataFrame], width: int, keep: int) -> Iterator[pd.DataFrame]:
    """Each slice's ``keep`` best per item: item (its number in the pass), order, score."""
    for frame in rows:
        for bundle, ids, cells, scores in zip(frame["bundle"], frame["ids"], frame["cells"], frame["scores"], strict=True):
            ids, score = np.frombuffer(ids, "<i8"), np.frombuffer(scores, "<i8")
            item, doc = np.divmod(np.frombuffer(cells, "<i4"), max(len(ids), 1))
            order = np.lexsort((ids[doc], -score, item))
            item, doc, score = item[order], doc[order], score[order]
            first = np.searchsorted(item, item)
            best = np.arange(len(item)) - first < keep
            yield pd.DataFrame({"item": bundle * width + item[best], "order": ids[doc[best]], "score": score[best]})


def _pass(texts: DataFrame, items: list[bytes], keep: int) -> DataFrame:
    """(item, order, score): candidates of the items, by number, among them the ``keep`` best of each."""
    spark = texts.sparkSession
    own = [Counter(terms_of(text)) for text in items]
    words = sorted(set().union(*own))
    numbers = {word: i for i, word in enumerate(words)}
    own = [Counter({numbers[w]: n for w, n in terms.items()}) for terms in own]
    fields = "slice long, documents long, total long, terms binary, docs binary, tf binary, ids binary, lengths binary"
    counted = written(map_texts(texts, partial(_counted, words=words), fields), "search-slices")
    documents, terms = (x or 0 for x in counted.agg(F.sum("documents"), F.sum("total")).first())
    held = counted.select("terms").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))
    df = {r["term"]: r["df"] for r in held.collect()}  # of the items' terms only
    weights = {term: term_weight(documents, n) for term, n in df.items()}
    owners = {term: next(i for i, share in enumerate(OWNERS) if n * share <= documents) for term, n in df.items()}
    bundles = [_Bundle(own[at : at + BUNDLE], weights, owners) for at in range(0, len(own), BUNDLE)]
    nothing = F.lit(b"")
    every = F.explode(F.sequence(F.lit(0), F.lit(len(bundles) - 1)))
    layout = "slice long, bundle int, ids binary, cells binary, scores binary"
    carried = counted.select("slice", every.alias("bundle"), "ids", nothing.alias("cells"), nothing.alias("scores"))
    for owner in range(len(OWNERS)):
        owned = partial(_owned, owner=owner, bundles=bundles, documents=documents, terms=terms)
        lists = counted.select("slice", "terms", "docs", "tf", "lengths").mapInArrow(
            owned, "slice long, bundle int, terms binary, docs binary, impacts binary"
        )
        keys = ["slice", "bundle"]
        carried = carried.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(_stage_of(owner, bundles, keep), layout)
    return carried.mapInPandas(partial(_picked, width=BUNDLE, keep=keep), "item long, order long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Each item's ``k`` highest-scoring documents with a score above 0: item_col, rank (from 1), id_col, score.

    Equal scores go by ascending id; a null id comes before every id. Null and empty texts have no terms: such a document
    is never found and counts for nothing, such an item has no rows. Every row of ``items`` is an item, so rows that repeat an id have
    their answers each; rows of ``docs`` that repeat an id are documents each. Empty tables give no rows. Other columns are not read.
    The items are the stated queries: they are read ITEMS at a time, each time in one pass over the documents.
    """
    spark = docs.sparkSession
    texts = docs.select(id_order(id_col).alias("order"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = written(
        items.select(
            F.monotonically_increasing_id().alias("row"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text")
        ),
        "search-items",
    )
    passes = -(-asked.count() // ITEMS)
    answers = spark.createDataFrame([], "item_id long, row long, order long, score long")
    for number in range(passes):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == number)
        rows = block.orderBy("row").collect()
        if rows:
            found = _pass(texts, [bytes(r["text"] or b"") for r in rows], k)
            ids = spark.createDataFrame([(n, r["item_id"], r["row"]) for n, r in enumerate(rows)], "item long, item_id long, row long")
            answers = answers.union(found.join(ids, "item").select("item_id", "row", "order", "score"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "order"))
    ranked = answers.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(item_col), "rank", id_back(F.col("order")).alias(id_col), "score")
