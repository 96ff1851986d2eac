"""How document filters interact: what each removes in every order in which they could run.

A document is a set of failed filters, one of 32. Per part (language) only the counts of those sets leave the
rows; from them the removals of all 32 coalitions of filters are tabulated. What a step of an order removes is the
difference of two coalitions, and the Shapley value of a filter is the solution of the least squares that
fits an additive game to the 32 removals, weighted by Shapley kernel and bound to add up to what all filters remove
(efficiency). Its normal equations are solved in rationals, so the values are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache, partial
from itertools import permutations
from math import comb, factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import id_order, lookup_join, map_texts, slices, written

FILTERS = "ABCDE"
_M = len(FILTERS)
_ALL = (1 << _M) - 1
_ORDERS = factorial(_M)
#: The bit of the filter that looks at the whole table; the others look at one text.
_COPY = 1 << FILTERS.index("E")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that continue a character.
_FOLLOWING = bytes(range(0x80, 0xC0))
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@dataclass(frozen=True)
class Limits:
    """The limits of the filters on one text."""

    least_words: int = 200
    distinct_percent: int = 50
    capitals_percent: int = 3
    symbols: bytes = b"#$%&*|"


def failures(text: bytes, limits: Limits = Limits()) -> int:
    """Bits of the filters A to D that a text, as UTF-8, fails."""
    words = text.split()  # bytes split at the blanks 0x20 and 0x09 to 0x0D
    capitals = len(text) - len(text.translate(None, _UPPER))
    characters = len(text.translate(None, _FOLLOWING))
    fails = (
        len(words) < limits.least_words,
        100 * len(set(words)) < limits.distinct_percent * len(words),
        100 * capitals > limits.capitals_percent * characters,
        len(text.translate(None, limits.symbols)) < len(text),
    )
    return sum(1 << bit for bit, failed in enumerate(fails) if failed)


def _marked(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = [t or b"" for t in part.column("text").to_pylist()]
        columns = [
            part.column("order"),
            part.column("part"),
            pa.array([failures(t, limits) for t in texts], pa.int32()),
            pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["order", "part", "fails", "digest"])


def failure_sets(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", limits: Limits = Limits()
) -> DataFrame:
    """(part, fails, good, toxic, n): documents per part, set of failed filters (bits) and labels.

    Equal texts are those of equal SHA-256. A text's first document is the one with the smallest id, and all others of
    larger id fail E; groups of copies meet in a partial aggregation and get its result by ``lookup_join``.
    """
    texts = docs.select(
        id_order(id_col).alias("order"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    marked = written(map_texts(texts, partial(_marked, limits=limits), "order long, part string, fails int, digest binary"), "audit-rows")
    firsts = written(marked.groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("n")), "audit-firsts")
    copy = F.when(F.col("order") > F.col("first"), F.lit(_COPY)).otherwise(F.lit(0))
    found = lookup_join(marked, firsts, "digest", "n").select("order", "part", (F.col("fails") + copy).alias("fails"))
    # Rows that agree in id, part and failures are one row of the join with the labels.
    rows = found.groupBy("order", "part", "fails").agg(F.count("*").alias("n"))
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("order")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    labelled = rows.join(flags, "order", "left").fillna(0, ["good", "toxic"])
    return labelled.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def coalition_removals(counts: dict[int, int]) -> list[int]:
    """What each of the 32 coalitions removes: the documents that fail any of its filters."""
    return [sum(n for fails, n in counts.items() if fails & coalition) for coalition in range(_ALL + 1)]


def _solved(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """The inverse, by elimination with exact pivots."""
    n = len(rows)
    work = [[*row, *(Fraction(i == j) for j in range(n))] for i, row in enumerate(rows)]
    for at in range(n):
        pivot = next(i for i in range(at, n) if work[i][at])
        work[at], work[pivot] = work[pivot], work[at]
        work[at] = [x / work[at][at] for x in work[at]]
        for i in range(n):
            if i != at and work[i][at]:
                factor = work[i][at]
                work[i] = [x - factor * y for x, y in zip(work[i], work[at], strict=True)]
    return [row[n:] for row in work]


def _kernel(coalition: int) -> Fraction:
    size = coalition.bit_count()
    return Fraction(_M - 1, comb(_M, size) * size * (_M - size))


@lru_cache(maxsize=1)
def _normal_inverse() -> list[list[Fraction]]:
    """Inverse of the bordered normal equations: weighted products of membership, and the multiplier of efficiency."""
    rows = [[Fraction(0)] * (_M + 1) for _ in range(_M + 1)]
    for coalition in range(1, _ALL):
        members = [i for i in range(_M) if coalition >> i & 1]
        for i in members:
            for j in members:
                rows[i][j] += _kernel(coalition)
    for i in range(_M):
        rows[i][_M] = rows[_M][i] = Fraction(1)
    return _solved(rows)


def shapley_values(removals: list[int]) -> list[Fraction]:
    """Each filter's Shapley value of the game ``removals`` (by coalition, that of none is 0)."""
    right = [sum((_kernel(c) * removals[c] for c in range(1, _ALL) if c >> i & 1), Fraction(0)) for i in range(_M)]
    right.append(Fraction(removals[_ALL]))
    return [sum((x * y for x, y in zip(row, right, strict=True)), Fraction(0)) for row in _normal_inverse()[:_M]]


def _steps(part: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its at most 128 counts."""

    def counts(rows: pd.DataFrame) -> dict[int, int]:
        return {int(k): int(v) for k, v in rows.groupby("fails")["n"].sum().items()}

    total = int(part["n"].sum())
    removed, good, toxic = (
        coalition_removals(counts(rows)) for rows in (part, part[part["good"] == 1], part[part["toxic"] == 1])
    )
    shares = [value * _ORDERS for value in shapley_values(removed)]
    if any(share.denominator != 1 for share in shares):
        raise ArithmeticError("a sum over all orders is not whole")
    out = []
    for order in permutations(range(_M)):
        before = 0
        for step, this in enumerate(order, 1):
            after = before | 1 << this
            here = removed[after] - removed[before]
            out.append(
                (
                    part["part"].iat[0],
                    "".join(FILTERS[i] for i in order),
                    step,
                    total - removed[after],
                    here,
                    removed[1 << this] - here,
                    removed[_ALL] - removed[_ALL & ~(1 << this)],
                    good[after] - good[before],
                    toxic[after] - toxic[before],
                    int(shares[this]),
                )
            )
            before = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Per part, order of the five filters and step: the documents kept, removed, redundant, ... (see COLUMNS).

    ``columns`` go to ``failure_sets``. Null text is empty, and empty texts are copies of each other. A null part is the
    empty string. A null id ranks below every id and has no labels; rows that repeat an id and a text are each counted, none
    of them a copy of the other. Of labels that repeat an id, one that says 1 decides; null labels say nothing.
    An empty table has no parts and gives no rows. Other columns are not read.
    """
    return failure_sets(docs, labels, **columns).groupBy("part").applyInPandas(_steps, COLUMNS)
