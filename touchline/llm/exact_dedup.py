"""Exact deduplication by skew-safe combining, with DataFrame operations only.

Rows of equal content are combined three times: within each scan task (the partial
aggregation of the first grouping), within each (digest, salt), and over the salts of
a digest. Every grouping has the whole content in its key, so a digest alone never
decides. A group of copies that holds a third of all rows reaches the last grouping as
at most one row per salt.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import free_name, id_back, id_order, lookup_join, rows_kept, whole_text, written

SALTS = 8


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def content_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, keep_order, keep_row, group_size.

    keep_order is the largest id (``NULL_ID`` if all are null) and keep_row the scan's
    row id of one row with that id. Two contents under one digest stop the job.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        id_order(id_col).alias("order"),
        ascii_lower(whole_text(text_col)).alias("content"),
    ).select(
        "row",
        "order",
        "content",
        _digest(F.col("content")).alias("digest"),
        F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"),
    )
    local = rows.groupBy("digest", "salt", "content").agg(
        F.max("order").alias("order"), F.max_by("row", "order").alias("row"), F.count("*").alias("n")
    )
    contents = (
        local.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("order").alias("order"), F.max_by("row", "order").alias("row"), F.sum("n").alias("n"))
    )
    one = contents.groupBy("digest").agg(
        F.count("*").alias("contents"),
        F.max("order").alias("keep_order"),
        F.max("row").alias("keep_row"),
        F.max("n").alias("group_size"),
    )
    collision = F.raise_error(F.lit("two contents share a SHA-256 digest")).cast("long")
    size = F.when(F.col("contents") == 1, F.col("group_size")).otherwise(collision)
    return one.select("digest", "keep_order", "keep_row", size.alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Null text is an empty text, and all empty texts are equal. A null id ranks below
    every id; if all ids of a group are null, so is keep_id. Rows that repeat both id and
    text are copies like any other: exactly one row of a group is kept. An empty table
    gives no rows; other columns are not read.
    """
    classes = written(content_classes(docs, id_col, text_col, salts), "exact-classes")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        id_order(id_col).alias("order"),
        _digest(ascii_lower(whole_text(text_col))).alias("digest"),
    )
    found = lookup_join(rows, classes, "digest", "group_size")
    return found.select(
        id_back(F.col("order")).alias(id_col),
        id_back(F.col("keep_order")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with all their columns.

    ``docs`` is read twice and must give its rows in one order, as a table of files does.
    """
    row = free_name(docs, "scan_row")
    kept = written(content_classes(docs, id_col, text_col).select(F.col("keep_row").alias(row)), "exact-kept")
    return rows_kept(docs.withColumn(row, F.monotonically_increasing_id()), kept, row).drop(row)


