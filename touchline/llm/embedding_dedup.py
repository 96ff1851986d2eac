"""Near-duplicate groups of vectors by a pivot-permutation index.

Reference points (pivots) are drawn from the vectors, about twice the square root of their number. A vector is
described by its nearest pivots in order, and listed under each of them, per label. Vectors of a list that share
enough pivots are candidates, and candidates are verified by their cosine in double precision. A pair counts in the list
of the first pivot it shares, so each link counts once; a task gives back one row per vector of its list, its
links there and the smallest vector it reaches there, however many pairs are links. Equal vectors of a label are
one entry with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import id_back, id_order, lookup_join, written
from touchline.llm.graph import connected_components

#: Pivots per square root of the number of entries, so that lists grow with the square root as well.
DENSITY = 2
LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
#: Bytes of pivots that go to every task at most (never under LEAST_PIVOTS of them).
PIVOT_BYTES = 16 << 20
#: Nearest pivots that describe a vector, and how many a candidate pair shares at least.
PREFIX, SHARED = 8, 2
#: Entries of a list that meet in one task; a longer list is dealt into blocks, and all pairs of blocks meet.
BLOCK = 10_000
ROWS, PAIRS = 256, 50_000
#: Count of a pair that shares an earlier pivot and so belongs to that one's list; no prefix makes up for it.
NOT_FIRST = -30_000


def _valid(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(row, order, label, key, packed); key and packed are null for vectors that take no part."""
    for batch in batches:
        keys, packs = [], []
        for label, vector in zip(batch.column("label").to_pylist(), batch.column("vector"), strict=True):
            key = packed = None
            if label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count:
                array = vector.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(array).all() and array.any():
                    packed = (array + array.dtype.type(0)).tobytes()  # one zero for both signs
                    key = hashlib.sha256(label.encode("utf-8", "surrogatepass") + b"\x00" + packed).digest()
            keys.append(key)
            packs.append(packed)
        columns = [batch.column("row"), batch.column("order"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(packs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "order", "label", "key", "packed"])


def unit_rows(packed: list[bytes], kind: str, dims: int | None = None) -> np.ndarray:
    """The vectors at length 1 as doubles; ``dims`` cuts or fills them to one width."""
    if dims is None:
        rows = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    else:
        rows = np.zeros((len(packed), dims))
        for at, one in enumerate(packed):
            vector = np.frombuffer(one, kind)[:dims]
            rows[at, : len(vector)] = vector
    # By a power of two, which is exact: squares neither overflow nor vanish.
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1)


def described(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's ``prefix`` nearest pivots, nearest first, ties to the smaller number."""
    near = vectors.astype(np.float32) @ pivots.T
    prefix = min(prefix, near.shape[1])
    top = np.sort(np.argpartition(-near, prefix - 1, axis=1)[:, :prefix], axis=1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def _described(batches, kind: str, pivots: np.ndarray, prefix: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            vectors = unit_rows(part.column("packed").to_pylist(), kind, pivots.shape[1])
            lists = pa.array(described(vectors, pivots, prefix).astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "pivots"])


def _candidates(left: np.ndarray, right: np.ndarray, pivot: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs for whom ``pivot`` is the first of at least ``shared`` pivots in common."""
    counts = np.zeros((len(left), len(right)), np.int16)
    numbers, where = np.divmod(np.sort((right.astype(np.int64) * len(right) + np.arange(len(right))[:, None]).ravel()), len(right))
    for number in np.unique(left).tolist():
        if number != pivot:
            lo, hi = np.searchsorted(numbers, [number, number + 1])
            if lo < hi:
                both = np.ix_(np.nonzero((left == number).any(axis=1))[0], where[lo:hi])
                counts[both] = counts[both] + 1 if number > pivot else NOT_FIRST  # the smaller numbers come before
    return np.nonzero(counts >= shared - 1)


def _reached(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root`` (each position's smallest known companion) after linking the pairs u, v."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _linked(rows: pd.DataFrame, kind: str, cosine: float, shared: int) -> pd.DataFrame:
    """Of one list, or of two blocks of it: entry, links (rows of the linked entries), root (smallest entry reached)."""
    rows = rows.sort_values("entry", ignore_index=True)
    vectors, blocks = unit_rows(rows["packed"].tolist(), kind), rows["block"].to_numpy()
    prefixes = np.array(rows["pivots"].tolist(), np.int32)
    sizes, links, root = rows["n"].to_numpy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
    one, other = rows["first"].iat[0], rows["second"].iat[0]
    left, right = np.nonzero(blocks == one)[0], np.nonzero(blocks == other)[0]
    for at in range(0, len(left), ROWS):
        part = left[at : at + ROWS]
        i, j = _candidates(prefixes[part], prefixes[right], int(rows["pivot"].iat[0]), shared)
        u, v = part[i], right[j]
        if one == other:
            u, v = u[u < v], v[u < v]
        for first in range(0, len(u), PAIRS):
            a, b = u[first : first + PAIRS], v[first : first + PAIRS]
            near = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine
            a, b = a[near], b[near]
            np.add.at(links, a, sizes[b])
            np.add.at(links, b, sizes[a])
            root = _reached(root, a, b)
    found = links > 0
    return pd.DataFrame({"entry": rows["entry"][found], "links": links[found], "root": rows["entry"].to_numpy()[root[found]]})


def _dealt(entries: DataFrame, block: int) -> DataFrame:
    """A row per list of an entry and pair of blocks: label, dims, pivot, first, second (blocks), block (its own), and the entry."""
    slim = entries.select("entry", "label", "dims", F.explode("pivots").alias("pivot"))
    slim = slim.withColumn("list", F.xxhash64("label", "dims", "pivot")).select("entry", "pivot", "list")
    sizes = slim.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > block)
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "long-lists")
    lists = F.explode("pivots").alias("pivot")
    if sizes.isEmpty():
        zero = F.lit(0).alias
        return entries.select("*", zero("first"), zero("second"), zero("block"), lists)
    cut = lookup_join(slim, sizes, "list", "n", "left").select("entry", F.struct("pivot", F.coalesce("blocks", F.lit(1)).alias("blocks")).alias("at"))
    cut = cut.groupBy("entry").agg(F.collect_list("at").alias("lists"))  # at most PREFIX of an entry
    rows = entries.join(cut, "entry").withColumn("at", F.explode("lists"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("entry"), F.col("at.blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)))
    return rows.select(
        *entries.columns, F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"), "block", F.col("at.pivot").alias("pivot")
    )


def entry_links(entries: DataFrame, kind: str, cosine: float, density: float = DENSITY, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """Per list and entry with links: entry, links, root. ``entries``: entry, label, dims, n, packed."""
    count, dims = entries.agg(F.count("*"), F.max("dims")).first()
    if not count:
        return entries.sparkSession.createDataFrame([], "entry long, links long, root long")
    most = max(LEAST_PIVOTS, min(MOST_PIVOTS, PIVOT_BYTES // (4 * dims)))
    number = min(most, max(LEAST_PIVOTS, int(density * isqrt(count))))
    chosen = entries.orderBy(F.xxhash64("packed"), "entry").select("packed").limit(number).collect()
    pivots = unit_rows(sorted({bytes(r["packed"]) for r in chosen}), kind, dims).astype(np.float32)
    describe = partial(_described, kind=kind, pivots=pivots, prefix=prefix)
    fields = "entry long, label string, dims int, n long, packed binary, pivots array<int>"
    listed = written(entries.select("entry", "label", "dims", "n", "packed").mapInArrow(describe, fields), "described")
    shared = min(shared, len(pivots))

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        return _linked(rows, kind, cosine, shared)

    keys = ["label", "dims", "pivot", "first", "second"]
    # By number: the lists are short in bytes and long to compare, so partitions are not merged by size.
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _dealt(listed, BLOCK).repartition(tasks, *keys).groupBy(*keys).applyInPandas(linked, "entry long, links long, root long")


def similar_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, **index
) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable by links), kept (its id is that one).

    Vectors of one label and length (number of components) link from ``cosine`` on; every vector is indexed, and ``index``
    has density, prefix and shared of the index. Rows with a null label or with a vector that is null, empty, zero or holds
    a null or a non-finite number link with nothing. Rows that repeat an id are vectors of their own, linked if
    alike. A null id ranks below every id; component_id is null for a group that holds one. An empty table gives no rows.
    Other columns are not read. The table is read once and may give its rows in any order.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind, width = ("<f4", 4) if element == "float" else ("<f8", 8)
    slim = vectors.select(
        F.monotonically_increasing_id().alias("row"), id_order(id_col).alias("order"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("vector"),
    )
    fields = "row long, order long, label string, key binary, packed binary"
    rows = written(slim.mapInArrow(partial(_valid, kind=kind), fields), "vectors")
    lone = rows.where("key IS NULL").select("order", F.lit(0).cast("long").alias("n_links"), F.col("order").alias("component"))
    grouped = rows.where("key IS NOT NULL").groupBy("key", "label", "packed").agg(
        F.min("row").alias("entry"), F.min("order").alias("order"), F.count("*").alias("n")
    )
    entries = written(grouped.withColumn("dims", (F.length("packed") / width).cast("int")), "entries")
    found = written(entry_links(entries, kind, cosine, **index), "entry-links")
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("entry").alias("u"), F.col("root").alias("v"))).toDF("entry", "root")
    placed = entries.select("key", "entry", "order", "n").join(links, "entry", "left").join(roots, "entry", "left")
    placed = written(
        placed.select(
            "key", "order", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "entry").alias("root")
        ),
        "placed",
    )
    least = placed.groupBy("root").agg(F.min("order").alias("component"), F.count("*").alias("entries"))
    members = lookup_join(placed.select("key", "n", "n_links", "root"), least, "root", "entries").select("key", "n", "n_links", "component")
    known = lookup_join(rows.where("key IS NOT NULL").select("row", "order", "key"), written(members, "members"), "key", "n")
    return known.select("order", "n_links", "component").union(lone).select(
        id_back(F.col("order")).alias(id_col), "n_links", id_back(F.col("component")).alias("component_id"),
        (F.col("order") == F.col("component")).alias("kept"),
    )
