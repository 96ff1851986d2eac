"""Held-out split and bounded training samples shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents whose id's CRC-32 leaves remainder 0 are never trained on.
FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text modulo FOLDS is 0; a null id counts as held out."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(True))


def hash_order(id_col: str = "doc_id") -> Column:
    return F.xxhash64(F.col(id_col).cast("string"))


def smallest_hashes(rows: DataFrame, count: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``count`` rows, those of the smallest id hashes: a fixed pseudo-random sample."""
    return rows.orderBy(hash_order(id_col), id_col).limit(count)
