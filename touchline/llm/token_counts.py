"""Token counts per document from per-document pre-token frequencies.

Texts are split into pre-tokens, whose pieces are counted once per distinct pre-token and
joined back to the frequencies; token ids are never made. The most frequent pre-tokens, which
would be the join's hot keys, are counted first from a bounded sample and applied while
the documents are split, so only the rest is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import map_texts, unit_hash, whole_text, written
from touchline.llm.tokens import json_file, piece_count, pre_tokens, rank_file

#: The sample that names the frequent pre-tokens, and how many it may name. Both bound what
#: every worker holds (some tens of MB); neither changes a count.
SAMPLE_ROWS = 6_000
FREQUENT = 200_000
CHUNK_ROWS = 500

_PARTS = pa.schema(
    [("row", pa.int64()), ("known", pa.int64()), ("pre_tokens", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))]
)
_DISTINCT = pa.schema([("pre_token", pa.string()), ("pieces", pa.int32())])


def _split(batches: Iterator[pa.RecordBatch], path: str, known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Per document: pieces of the known pre-tokens, and the others with their frequencies."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            rows, sums, names, times = part.column(0), [], [], []
            for text in part.column(1).to_pylist():
                seen = Counter(pre_tokens(text, path))
                rest = {t: n for t, n in seen.items() if t not in known}
                sums.append(sum(known[t] * n for t, n in seen.items() if t in known))
                names.append(list(rest))
                times.append(list(rest.values()))
            columns = [rows, *(pa.array(x, f.type) for x, f in zip((sums, names, times), list(_PARTS)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=_PARTS)


def _count_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0)
        pieces = pa.array([piece_count(t, path) for t in names.to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([names, pieces], schema=_DISTINCT)


def pre_token_parts(texts: DataFrame, known: dict[str, int], json_path: str) -> DataFrame:
    """(row, known, pre_tokens, times) of (row, text)."""
    split = partial(_split, path=json_path, known=known)
    return map_texts(texts, split, "row long, known long, pre_tokens array<string>, times array<int>")


def _exploded(parts: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip("pre_tokens", "times"))
    return parts.select("row", pairs.alias("pair")).select("row", "pair.pre_tokens", "pair.times").toDF(
        "row", "pre_token", "times"
    )


def distinct_pieces(pre_tokens_: DataFrame, rank_path: str) -> DataFrame:
    """(pre_token, pieces): each distinct pre-token counted once."""
    count = partial(_count_pieces, path=rank_path)
    return pre_tokens_.select("pre_token").distinct().mapInArrow(count, "pre_token string, pieces int")


def frequent_pieces(
    texts: DataFrame, json_path: str, rank_path: str, rows: int = SAMPLE_ROWS, names: int = FREQUENT
) -> dict[str, int]:
    """Piece counts of the pre-tokens that are most frequent in a sample of about ``rows`` documents."""
    total = texts.count()
    sample = texts.where(unit_hash(F.col("row")) < rows / max(total, 1))
    pairs = _exploded(pre_token_parts(sample, {}, json_path))
    top = (
        pairs.groupBy("pre_token")
        .agg(F.sum("times").alias("times"))
        .where("times > 1")
        .orderBy(F.desc("times"), "pre_token")
        .limit(names)
        .select("pre_token")
    )
    counted = top.mapInArrow(partial(_count_pieces, path=rank_path), "pre_token string, pieces int")
    return {r.pre_token: r.pieces for r in counted.collect()}


def token_counts(
    docs: DataFrame, limit: int = 1024, json_path: str | None = None, rank_path: str | None = None
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens; rows that repeat a doc_id are counted
    each, an empty table gives no rows, and other columns are not read. The vocabulary's
    added token counts as one wherever its string stands in a text.
    """
    json_path, rank_path = json_path or json_file(), rank_path or rank_file()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), whole_text().alias("text"))
    known = frequent_pieces(texts, json_path, rank_path)
    parts = written(pre_token_parts(texts, known, json_path), "pre-token-parts")
    rest = _exploded(parts)
    pieces = distinct_pieces(rest, rank_path)
    sums = (
        rest.join(pieces, "pre_token")
        .groupBy("row")
        .agg(F.sum(F.col("times").cast("long") * F.col("pieces")).alias("rest"))
    )
    tokens = parts.select("row", "known").join(sums, "row", "left")
    tokens = tokens.select("row", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
    sizes = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        F.octet_length(whole_text()).cast("long").alias("n_bytes"),
    )
    return sizes.join(tokens, "row").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
