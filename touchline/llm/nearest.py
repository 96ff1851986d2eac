"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are dealt into bands of similar length. Those of a band are lifted to unit length by the band's longest, so
that the largest inner product is the largest cosine, turned by fast pseudo-random rotations (sign flips and
Hadamard transforms), and assigned in each table to the nearest signed axis. A query probes the nearest axes of
every table and band; each bucket's vectors are scored exactly against its queries, and the best of all
buckets remain. Tables and probes are the same at every size. Vectors of a rare length (bands with less than a twentieth of
all) have no table of their own and meet every query; a query that found fewer than it asks for meets all vectors. Equal vectors are one entry that carries its smallest ids, so a group of copies fills no bucket.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import lookup_join, written

LOG = logging.getLogger(__name__)

TABLES = 16
PROBES = 16
#: Lengths of one band differ by this factor at most.
BAND = 1.25
#: Bands with a smaller share of the entries are scored whole, in blocks: so there are at most 20 bands of tables.
RARE = 0.05
#: The bucket of what every query meets, and of all vectors for the queries that found too few.
WHOLE_BUCKET = -1
#: Vectors and queries of a bucket that meet in one task; a larger bucket is dealt into blocks.
BLOCK = 20_000
QUERY_BLOCK = 4_000
SEED = 5
#: Error of a score by matrix product, as a share of the product of the lengths, at most.
ROUNDING = 1e-12


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, step = rows.shape[1], 1
    while step < n:
        pairs = rows.reshape(len(rows), -1, 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(rows), n)
        step *= 2
    return rows / np.sqrt(n)


def _width(dims: int) -> int:
    return 1 << dims.bit_length()  # above dims: room for the lifting coordinate


def rotations(dims: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Three rows of random signs per table."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (tables, 3, _width(dims)))


def signed_axes(lifted: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Components of the turned rows along +axis 0.., then -axis 0..."""
    for flip in signs:
        lifted = hadamard(lifted * flip)
    return np.concatenate([lifted, -lifted], axis=1)


def band_of(length: float) -> int:
    """The band of a length; lengths near 1, as of rounded unit vectors, are in the middle of one."""
    return math.floor(math.log(length, BAND) + 0.5)


def _lift(vectors: np.ndarray, longest: np.ndarray | None) -> np.ndarray:
    """Unit rows: scaled by the longest of each one's band with the missing length as a further coordinate, or (queries) by own length."""
    lengths = np.linalg.norm(vectors, axis=1)
    out = np.zeros((len(vectors), _width(vectors.shape[1])), np.float32)
    scale = lengths if longest is None else longest
    out[:, : vectors.shape[1]] = vectors / scale[:, None]
    if longest is not None:
        out[:, vectors.shape[1]] = np.sqrt(np.maximum(0, 1 - (lengths / longest) ** 2))
    return out


def _valid(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(id, packed, length, band) of the vectors that take part."""
    schema = pa.schema([("id", pa.int64()), ("packed", pa.binary()), ("length", pa.float64()), ("band", pa.int32())])
    for batch in batches:
        rows = []
        for id_, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if id_ is None or not vector.is_valid or vector.values.null_count:
                continue
            array = vector.values.to_numpy(zero_copy_only=False).astype(kind)
            if len(array) and np.isfinite(array).all() and array.any():
                length = float(np.linalg.norm(array.astype(np.float64)))
                rows.append((id_, array.tobytes(), length, band_of(length)))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _unpacked(column: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _indexed(batches, kind: str, signs: np.ndarray, bands: dict[int, tuple[int, float]], whole: bool, probes: int | None) -> Iterator[pa.RecordBatch]:
    """Adds the buckets: per table the nearest axis in the entry's own band, or (``probes``) the nearest ones in every band.

    ``bands`` has the number and the longest vector of each band with tables; entries of others are in WHOLE_BUCKET,
    which the queries probe as well if it is in use (``whole``).
    """
    tables, axes = len(signs), 2 * signs.shape[2]
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            vectors, own = _unpacked(part.column("packed").to_pylist(), kind), None
            if probes is None:
                own = [bands.get(b) for b in part.column("band").to_pylist()]
            lifted = _lift(vectors, None if own is None else np.array([b[1] if b else np.inf for b in own]))
            found = []
            for table, flips in enumerate(signs):
                near = signed_axes(lifted, flips)
                best = np.argpartition(-near, (probes or 1) - 1, axis=1)[:, : probes or 1]
                found.append(best + table * axes)
            near = np.concatenate(found, axis=1).astype(np.int64)
            if own is None:
                offsets = np.array([number for number, _ in bands.values()], np.int64) * (tables * axes)
                near = (near[:, None, :] + offsets[None, :, None]).reshape(len(vectors), -1)
                buckets = [[*row, WHOLE_BUCKET] if whole else row for row in near.tolist()]
            else:
                buckets = [(row + b[0] * tables * axes).tolist() if b else [WHOLE_BUCKET] for row, b in zip(near, own, strict=True)]
            lists = pa.array(buckets, pa.list_(pa.int64()))
            schema = pa.schema([*part.schema, ("buckets", lists.type)])
            yield pa.RecordBatch.from_arrays([*part.columns, lists], schema=schema)


def _best(ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``keep`` by score, ties to the smaller id; an id that comes twice counts once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:keep]], scores[first[:keep]]


def _score_bucket(queries: pd.DataFrame, entries: pd.DataFrame, kind: str, keep: int) -> pd.DataFrame:
    """For each query of a bucket its best ids there, packed, with their scores.

    The matrix product only tells which entries may be among the best: all from the ``keep``-th score on, less its
    rounding. Those are scored again one by one, and ranked by that score with ties to the smaller id.
    """
    out = {"entry": [], "ids": [], "scores": []}
    if len(queries) and len(entries):
        vectors, asked = _unpacked(entries["packed"].tolist(), kind), _unpacked(queries["packed"].tolist(), kind)
        held = np.array([len(m) for m in entries["members"]])
        first, ids = np.cumsum(held) - held, np.concatenate(entries["members"].tolist()).astype(np.int64)
        longest = np.linalg.norm(vectors, axis=1).max()
        names = queries["entry"].to_numpy()
        for at in range(0, len(asked), 256):
            part = asked[at : at + 256]
            near = part @ vectors.T
            top = min(keep, near.shape[1])
            least = np.partition(near, near.shape[1] - top, axis=1)[:, near.shape[1] - top]
            least -= ROUNDING * longest * np.linalg.norm(part, axis=1) * part.shape[1]
            query, entry = np.nonzero(near >= least[:, None])
            scores = np.concatenate(
                [(part[query[i : i + 4096]] * vectors[entry[i : i + 4096]]).sum(-1) for i in range(0, len(query), 4096)]
            )
            # Every entry stands for its ids.
            times = held[entry]
            own = ids[np.repeat(first[entry], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            query, scores = np.repeat(query, times), np.repeat(scores, times)
            order = np.lexsort((own, -scores, query))
            query, own, scores = query[order], own[order], scores[order]
            begins = np.searchsorted(query, np.arange(len(part) + 1))
            for q, (lo, hi) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                hi = min(hi, lo + keep)
                out["entry"].append(names[at + q])
                out["ids"].append(own[lo:hi].astype("<i8").tobytes())
                out["scores"].append(scores[lo:hi].astype("<f8").tobytes())
    return pd.DataFrame(out)


def _merge(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    out = []
    for entry, part in rows.groupby("entry"):
        ids, scores = np.frombuffer(b"".join(part["ids"]), "<i8"), np.frombuffer(b"".join(part["scores"]), "<f8")
        ids, scores = _best(ids, scores, keep)
        out.append((entry, [{"id": i, "score": s} for i, s in zip(ids.tolist(), scores.tolist(), strict=True)], 1))
    return pd.DataFrame(out, columns=["entry", "near", "one"])


def _dealt(rows: DataFrame, sizes: dict[int, int], others: dict[int, int], own: str, other: str) -> DataFrame:
    """One row per bucket and block: dealt by hash into the own blocks, repeated for each block of the other side."""

    def blocks(counts: dict[int, int]):
        large = {b: n for b, n in counts.items() if n > 1}
        if not large:
            return F.lit(1)
        return F.coalesce(F.create_map(*(F.lit(x) for kv in large.items() for x in kv))[F.col("bucket")], F.lit(1))

    spread = rows.withColumn("bucket", F.explode("buckets")).drop("buckets")
    spread = spread.withColumn(own, F.pmod(F.xxhash64("entry"), blocks(sizes)).cast("int"))
    return spread.withColumn(other, F.explode(F.sequence(F.lit(0), (blocks(others) - 1).cast("int"))))


def nearest(
    vectors: DataFrame,
    k: int = 20,
    query_filter: str = "id % 20 = 0",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """Each query's ``k`` nearest found: query_id, rank (from 1), id, score (inner product in double precision).

    Queries are the rows that pass ``query_filter`` (an expression over id); candidates are all rows but those
    with the query's own id. Rows with a null id or a vector that is null, empty, zero or holds a null or a non-finite number take
    no part; rows that repeat an id and its vector count once. Vectors have as many components as most of the rows
    have (of two such numbers the larger); the others take no part. With fewer candidates than ``k`` all come; an empty
    table gives no rows. Every vector is indexed.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    slim = vectors.select(F.col(id_col).cast("long"), F.col(vector_col))
    rows = written(slim.mapInArrow(partial(_valid, kind=kind), "id long, packed binary, length double, band int").distinct(), "vectors")
    common = rows.groupBy(F.length("packed").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    size = common["size"]
    rows = rows.where(F.length("packed") == size)
    keep = k + 1  # one of them may be the query itself
    by_id = Window.partitionBy("packed").orderBy("id")
    entry = F.min("id").over(by_id.rowsBetween(Window.unboundedPreceding, 0)).alias("entry")
    listed = rows.select("packed", "length", "band", "id", F.row_number().over(by_id).alias("nth"), entry).where(F.col("nth") <= keep)
    members = F.array_sort(F.collect_list("id"))  # at most `keep` of an entry
    entries = written(listed.groupBy("packed", "length", "band", "entry").agg(members.alias("members")), "entries")
    dims = size // int(kind[2])
    signs = rotations(dims, tables)
    probes = min(2 * _width(dims), probes)
    # A few hundred bands at most, whatever the data (some thousands for doubles).
    sizes = entries.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("band").collect()
    large = [r for r in sizes if r["n"] >= RARE * sum(x["n"] for x in sizes)]
    bands = {r["band"]: (number, r["longest"]) for number, r in enumerate(large)}
    fields = "entry long, packed binary"
    layout = {"kind": kind, "signs": signs, "bands": bands, "whole": len(bands) < len(sizes)}
    index = partial(_indexed, **layout, probes=None)
    indexed = entries.select("entry", "packed", "members", "band").mapInArrow(
        index, f"{fields}, members array<long>, band int, buckets array<long>"
    )
    indexed = written(indexed.drop("band"), "index")
    classes = rows.groupBy("packed").agg(F.min("id").alias("entry"), F.count("*").alias("n"))
    asked = written(lookup_join(rows.where(query_filter).select("id", "packed"), classes, "packed", "n"), "queries")
    probe = partial(_indexed, **layout, probes=probes)
    probing = written(
        asked.select("entry", "packed").distinct().mapInArrow(probe, f"{fields}, buckets array<long>"), "probes"
    )

    def block_counts(table: DataFrame, size: int) -> dict[int, int]:
        """Blocks per bucket; there are bands * tables * axes buckets."""
        counts = table.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().where(F.col("count") > size)
        return {r["bucket"]: -(-r["count"] // size) for r in counts.collect()}

    def score(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return _score_bucket(queries, found, kind, keep)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        return _merge(part, keep)

    keys = ["bucket", "entry_block", "query_block"]
    groups = max(1, -(-probing.count() // 2_000))

    def best_of(queries: DataFrame, found: DataFrame) -> DataFrame:
        """(entry, near): the best of the buckets each query shares with ``found``."""
        of_entries, of_queries = block_counts(found, BLOCK), block_counts(queries, QUERY_BLOCK)
        left = _dealt(queries, of_queries, of_entries, "query_block", "entry_block")
        right = _dealt(found, of_entries, of_queries, "entry_block", "query_block")
        scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "entry long, ids binary, scores binary")
        return (
            scored.withColumn("part", F.pmod(F.xxhash64("entry"), F.lit(groups)))
            .groupBy("part")
            .applyInPandas(merge, "entry long, near array<struct<id:long,score:double>>, one long")
        )

    merged = written(best_of(probing, indexed), "found")
    enough = merged.where(F.size("near") >= keep)
    short = written(probing.join(enough.select("entry"), "entry", "left_anti"), "short")
    few = short.count()
    if few:
        LOG.info("%d of %d queries found fewer than %d and meet all vectors", few, merged.count(), keep)
        everything = F.array(F.lit(WHOLE_BUCKET).cast("long")).alias("buckets")
        whole = best_of(short.select("entry", "packed", everything), indexed.select("entry", "packed", "members", everything))
        merged = enough.union(whole)
    weights = asked.groupBy("entry").agg(F.count("*").alias("asked"))
    merged = merged.drop("one").join(weights, "entry")
    answers = lookup_join(asked.select("id", "entry"), merged, "entry", "asked")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    ranked = answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "found"))
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("found.id").alias(id_col), F.col("found.score").alias("score")
    )

