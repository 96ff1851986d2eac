"""Helpers shared by the operators: work tables, free column names, row ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import work_folder

#: Stands for a null id where ids are compared: below every id that documents carry.
NULL_ID = -(2**63)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared work folder and read back.

    Cuts the lineage with a table every executor can read, so a lost executor
    costs a re-read and never the work that led to the table.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing reads any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: Rows per Arrow batch at most. Texts can be long, and a worker holds a batch or two at a time.
BATCH_ROWS = 1000


def map_texts(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_ROWS rows (a setting of the session)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def slices(batches, rows: int = 200):
    """The record batches cut to ``rows`` rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def whole_text(text_col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def id_order(id_col: str) -> Column:
    """The id as a value that is never null (null sorts first)."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def id_back(order: Column) -> Column:
    return F.when(order != NULL_ID, order)


def unit_hash(*cols: Column) -> Column:
    """A number in (0, 1) that depends on ``cols`` alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def rows_kept(docs: DataFrame, kept: DataFrame, row: str, how: str = "left_semi") -> DataFrame:
    """``docs`` joined to ``kept`` on the column ``row``, one row each.

    What is kept grows with the corpus, so it is never broadcast, at any size; its row ids are
    hashed per shuffle partition, and the texts are not sorted.
    """
    return docs.join(kept.hint("shuffle_hash"), row, how)


#: Keys of a lookup joined by broadcast: the heaviest ones, so that any other key has at
#: most a thousandth of the rows.
HOT_KEYS = 1000


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``lookup``, which has one row per ``key``; safe for hot keys.

    ``weight`` says how many rows a key of the lookup meets. The HOT_KEYS heaviest keys, a
    fixed number, are broadcast; the rest are joined by shuffle, in which a row already matched
    takes part under a key of its own.
    """
    values = [c for c in lookup.columns if c not in (key, weight)]
    hot = (
        lookup.where(F.col(weight) > 1)
        .orderBy(F.desc(weight), key)
        .limit(HOT_KEYS)
        .select(F.col(key), F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in (*values, weight)))
    )
    found = rows.join(F.broadcast(hot), key, "left")
    spread = F.when(F.col("_hot"), F.xxhash64(*rows.columns))
    rest = lookup.select(
        F.col(key).alias("_key"), F.lit(None).cast("long").alias("_spread"), *values, F.col(weight), F.lit(True).alias("_rest")
    )
    on = (
        (F.when(F.col("_hot"), F.lit(None)).otherwise(F.col(key)).eqNullSafe(F.col("_key")))
        & F.col("_spread_row").eqNullSafe(F.col("_spread"))
    )
    joined = found.withColumn("_spread_row", spread).join(rest, on, "left")
    if how == "inner":
        joined = joined.where(F.col("_hot") | F.col("_rest"))
    merged = [F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in (*values, weight)]
    return joined.select(*rows.columns, *merged)
