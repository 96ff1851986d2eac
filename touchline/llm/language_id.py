"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1 and -1. For each bit a logistic classifier over hashed
byte n-grams (one to three bytes, lower-cased text) predicts its sign. A text gets the language whose
codeword has the smallest loss under the classifiers' margins, each bit weighted by how reliable it was
in training; the score is the softmax share of that loss, and a low share flags the answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import map_texts, slices, unit_hash
from touchline.llm.learning import held_out

#: Training rows: per language, and over all languages.
ROWS_PER_LANGUAGE = 1_000
ROWS_IN_ALL = 6_000
BUCKETS = 1 << 12
UNKNOWN = "und"
#: Scores below this are flagged.
CLEAR = 0.7

_LETTER = regex.compile(r"\p{L}")
_SLICE = 1 << 20


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """One row of +1 and -1 per language: all distinct splits for up to five, else the best of random codes."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 5:
        bits = [[1 if (mask >> i) & 1 or i == 0 else -1 for i in range(languages)] for mask in range(0, 1 << languages, 2)]
        return np.array(bits[:-1], np.float64).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, distance = None, -1
    for _ in range(40):
        code = rng.choice([-1.0, 1.0], (languages, width))
        code[:, np.abs(code.sum(0)) == languages] *= np.where(np.arange(languages) % 2, 1, -1)[:, None]
        near = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(languages), 2))
        best, distance = (code, near) if near > distance else (best, distance)
    return best


def profile(text: str) -> np.ndarray:
    """Root shares of the hashed byte n-grams of the whole text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), _SLICE):  # bounds the codes of a very long text
        part = raw[at : at + _SLICE + 2].astype(np.uint32)
        own = min(_SLICE, len(raw) - at)
        code = part[:own].copy()
        for n in (1, 2, 3):
            if n > 1:
                code = code[: max(0, min(own, len(part) - n + 1))]
                code = code * np.uint32(257) + part[n - 1 : n - 1 + len(code)]
            hashed = ((code + np.uint32(n * 40503)) * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(hashed, minlength=BUCKETS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Coder:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and its share, for each profile."""
        margins = profiles @ self.weights + self.bias
        losses = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        shares = np.exp(losses.min(1, keepdims=True) - losses)
        shares /= shares.sum(1, keepdims=True)
        best = shares.argmax(1)
        return best, shares[np.arange(len(best)), best]


def fit(profiles: np.ndarray, named: np.ndarray, languages: list[str], steps: int = 150) -> Coder:
    """Logistic classifiers of all bits at once, by gradient descent with momentum."""
    code = codewords(len(languages))
    bits = code.shape[1]
    weights, bias = np.zeros((profiles.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return Coder(languages, code, weights, bias, np.zeros(0))
    target = code[named].astype(np.float32)
    share = 1 / np.maximum(1, np.bincount(named, minlength=len(languages)))[named].astype(np.float32)
    share = (share / share.sum())[:, None]
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(steps):
        margins = profiles @ weights + bias
        slope = -target * share / (1 + np.exp(np.clip(target * margins, -30, 30)))
        speed_w = 0.9 * speed_w + profiles.T @ slope + 1e-5 * weights
        speed_b = 0.9 * speed_b + slope.sum(0)
        weights, bias = weights - 8.0 * speed_w, bias - 2.0 * speed_b
    right = ((profiles @ weights + bias) * target > 0).astype(np.float64)
    error = np.clip((1 - right).T @ share.ravel(), 1e-3, 0.499)
    trust = np.log((1 - error) / error)
    return Coder(languages, code, weights, bias, trust / trust.mean())


_SAMPLE = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("profile", pa.binary())])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = pa.array([profile(t).tobytes() for t in part.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], schema=_SAMPLE)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Coder:
    """Codes and classifiers from a bounded sample of the rows that are not held out.

    Each language gives ROWS_PER_LANGUAGE rows at most (fewer if there are more than six
    languages), drawn by id hash; a row without a letter or without a language gives none.
    """
    rows = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Coder([], np.ones((0, 0)), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    languages = sorted(sizes)
    per = min(ROWS_PER_LANGUAGE, max(50, ROWS_IN_ALL // len(languages)))
    drawn = [(F.col("lang") == name) & (unit_hash(F.col("id")) < per / sizes[name]) for name in languages]
    keep = drawn[0]
    for other in drawn[1:]:
        keep = keep | other
    found = rows.where(keep & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("id", "text").alias("order"), "text")
    table = map_texts(found, _profiles, "lang string, order long, profile binary").toArrow()
    table = table.sort_by([("order", "ascending"), ("lang", "ascending"), ("profile", "ascending")])
    if not len(table):
        return Coder([], np.ones((0, 0)), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    languages = sorted(set(table["lang"].to_pylist()))
    named = np.array([languages.index(x) for x in table["lang"].to_pylist()])
    return fit(np.stack([np.frombuffer(p.as_py(), np.float32) for p in table["profile"]]), named, languages)


_FOUND = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def _identified(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part.column(1).to_pylist()
            known = [bool(coder.languages and t and _LETTER.search(t)) for t in texts]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if any(known):
                best, share = coder.decode(np.stack([profile(t) for t, k in zip(texts, known, strict=True) if k]))
                for i, b, s in zip(np.flatnonzero(known).tolist(), best.tolist(), share.tolist(), strict=True):
                    names[i], scores[i] = coder.languages[b], float(s)
            flags = [s < CLEAR for s in scores]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], schema=_FOUND
            )


def identify(docs: DataFrame, coder: Coder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (0 to 1), ambiguous.

    A null text, a text without a letter, or nothing learned gives ``und`` with score 0. Only the text is
    an input; rows that repeat are answered each; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = map_texts(slim, partial(_identified, coder=coder), "id long, lang_pred string, score double, ambiguous boolean")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "ambiguous")
