"""Quality scores by a factorisation machine over words, structure and metadata.

Features are hashed lower-cased words (root counts, unit length), binned structure statistics of the
text, and the binned declared length. The score is
sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), linear in the features.
The machine is fitted on the driver from a bounded sample of labelled rows; scoring runs in the
scan's tasks without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import map_texts, slices
from touchline.llm.learning import held_out, smallest_hashes

#: Labelled rows the machine is fitted on at most.
SAMPLE_ROWS = 8_000
WORD_BITS = 16
FACTORS = 6
LEAST_STEPS = 400
THRESHOLD = 0.3

_BINS = 12
_STATS = 14
DIM = (1 << WORD_BITS) + _STATS * _BINS

#: Byte classes: 0 other, 1 A-Z, 2 a-z, 3 digit, 4 blank, 5 newline, 6 . , ; : ? ', 7 other ASCII sign, 8 not ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 7
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[[ord(c) for c in ".,;:?'"]], _CLASS[128:] = 4, 5, 6, 8

_word_index: dict[str, int] = {}


def _index(word: str) -> int:
    at = _word_index.get(word)
    if at is None:
        if len(_word_index) > 150_000:
            _word_index.clear()
        at = _word_index[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
    return at


def _bin(share: float) -> int:
    """Shares on a scale that is finer near 0."""
    return min(_BINS - 1, int(_BINS * share**0.5))


def structure(text: str, n_chars: int | None) -> list[int]:
    """The bin of each structure statistic and of the declared length."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9).tolist()
    words = text.split()
    lines = text.split("\n")
    n, m, letters = max(len(raw), 1), max(len(words), 1), max(kinds[1] + kinds[2], 1)
    seen = len(set(words))
    values = [
        min(1.0, np.log2(len(words) + 1) / 16),
        kinds[1] / letters,
        kinds[3] / n,
        min(1.0, kinds[5] * 40 / n),
        kinds[6] / n,
        kinds[7] / n,
        kinds[8] / n,
        text.count("|") / m,
        min(1.0, text.count("!") / m),
        1 - seen / m,
        sum(map(eq, words, words[1:])) / m,
        min(1.0, len(raw) / m / 24),
        1 - len(set(lines)) / len(lines),
    ]
    declared = 0 if n_chars is None or n_chars < 0 else 1 + min(_BINS - 2, int(n_chars).bit_length() // 2)
    return [*(_bin(min(1.0, max(0.0, float(v)))) for v in values), declared]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words first, then one index of value 1 for each statistic."""
    text = text or ""
    counts = Counter(text.lower().split())
    at = np.fromiter((_index(w) for w in counts), np.int64, len(counts))
    x = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    bins = np.array(structure(text, n_chars)) + (1 << WORD_BITS) + np.arange(_STATS) * _BINS
    return np.concatenate([at, bins]), np.concatenate([x, np.full(_STATS, _STATS**-0.5)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        return self.bias + float(self.weights[at] @ x) + 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.15, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over mini-batches, in an order that depends on the seed alone.

    Small samples are gone through more often, so that every fit makes LEAST_STEPS steps.
    """
    rng = np.random.default_rng(seed)
    y = np.array([label for *_, label in rows], np.float64)
    good = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    bias, w = float(np.log(good / (1 - good))), np.zeros(DIM)
    v = rng.normal(0, 0.05, (DIM, FACTORS))
    gw, gv, gb, decay = np.full(DIM, 1e-6), np.full((DIM, FACTORS), 1e-6), 1e-6, 1e-5
    if len(set(y.tolist())) < 2:
        return Machine(bias, w.astype(np.float32), v.astype(np.float32) * 0)
    for _ in range(max(epochs, -(-LEAST_STEPS // max(1, len(rows) // 128)))):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(order) // 128)):
            sizes = [len(rows[i][0]) for i in batch]
            at, x = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
            row, starts = np.repeat(np.arange(len(batch)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = v[at] * x[:, None]
            sums = np.add.reduceat(vx, starts)
            margin = bias + np.add.reduceat(w[at] * x, starts)
            margin += 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch]) / len(batch)
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, slope[row] * x) + decay * w[used]
            pull = (slope[row] * x)[:, None] * (sums[row] - vx)
            dv = np.stack([np.bincount(back, pull[:, f]) for f in range(FACTORS)], 1) + decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
            gb += slope.sum() ** 2
            bias -= rate * slope.sum() / gb**0.5
    return Machine(bias, w.astype(np.float32), v.astype(np.float32))


_SAMPLE = [("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32())), ("label", pa.int32())]


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [features(t, n) for t, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
        columns = [pa.array([f[i] for f in found], _SAMPLE[i][1]) for i in (0, 1)]
        schema = pa.schema([part.schema.field(0), *_SAMPLE])
        yield pa.RecordBatch.from_arrays([part.column(0), *columns, part.column(3)], schema=schema)


def _inputs(docs: DataFrame, text_col: str) -> tuple:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return F.col(text_col).cast("string").alias("text"), n_chars.alias("n_chars")


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = SAMPLE_ROWS,
) -> Machine:
    """A machine fitted on at most ``rows`` labelled documents that are not held out.

    Labels other than 0 and 1 are left aside; an id labelled more than once takes its smallest label, and of
    documents that repeat an id the one of the smallest features counts.
    With no labels, or labels of one kind, the score is the same for every document.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    sample = smallest_hashes(marked, rows, "id")
    texts = docs.select(F.col(id_col).alias("id"), *_inputs(docs, text_col)).join(F.broadcast(sample), "id")
    inputs = texts.select("id", "text", "n_chars", "label")
    kind = inputs.schema["id"].dataType.simpleString()
    found = map_texts(inputs, _sample_features, f"id {kind}, at array<int>, x array<float>, label int")
    # One row per labelled id, whatever the number of documents that repeat it: the sample's bound holds here too.
    table = found.groupBy("id").agg(F.min(F.struct("at", "x", "label")).alias("s")).select("s.*").toArrow()
    data = [
        (at.values.to_numpy(zero_copy_only=False), x.values.to_numpy(zero_copy_only=False), label.as_py())
        for at, x, label in zip(table["at"], table["x"], table["label"], strict=True)
    ]
    data.sort(key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes(), r[2]))  # the order of tasks must not matter
    return fit(data)


def _scored(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        pairs = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
        margins = [machine.margin(*features(t, n)) for t, n in pairs]
        scores = pa.array(1 / (1 + np.exp(-np.clip(margins, -30, 30))), pa.float64())
        schema = pa.schema([*list(part.schema)[2:], ("score", pa.float64())])
        yield pa.RecordBatch.from_arrays([*part.columns[2:], scores], schema=schema)


def with_score(docs: DataFrame, machine: Machine, text_col: str = "text", score: str = "score") -> DataFrame:
    """``docs``, all columns, with a score column; one pass over the scan."""
    staged = docs.select(*(x.alias(n) for x, n in zip(_inputs(docs, text_col), ("_text", "_n"), strict=True)), "*")
    fields = [f.simpleString() for f in docs.schema.fields]
    names = [f"c{i}" for i in range(len(fields))]
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)), "score double"])
    scored = map_texts(staged.toDF("_text", "_n", *names), partial(_scored, machine=machine), schema)
    return scored.toDF(*docs.columns, score)


def quality_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Null and empty texts are scored by their statistics. Rows that repeat are scored each, an empty table
    gives no rows, and only the text and n_chars are inputs.
    """
    kept = [id_col, text_col, *(["n_chars"] if "n_chars" in docs.columns else [])]
    slim = docs.select(F.col(id_col).alias("id"), *_inputs(docs.select(*kept), text_col))
    scored = with_score(slim.select("id", "text", "n_chars"), machine)
    return scored.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score at least THRESHOLD.

    Null and empty texts are scored by their statistics, null ids are kept out of training, rows that repeat are
    scored each, and an empty table gives no rows.
    """
    score, machine = "quality_score", train(docs, labels, id_col=id_col, text_col=text_col)
    while score in docs.columns:
        score += "_"
    return with_score(docs, machine, text_col, score).where(F.col(score) >= THRESHOLD).drop(score)
