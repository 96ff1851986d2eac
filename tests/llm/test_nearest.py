import numpy as np
import pytest

from touchline.llm.nearest import hadamard, nearest

SCHEMA = "vec_id long, embedding array<float>, row string, entry string, bucket string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "row", "entry", "bucket", "id") for i, v in rows], SCHEMA).coalesce(2)


def brute(rows, k=20):
    valid = {}
    for i, v in rows:
        if i is not None and v and len(v) == len(rows[0][1]) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            valid[i, tuple(v)] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for (q, _), vector in valid.items():
        if q % 20 == 0:
            scores = sorted((-float((vector * other).sum()), i) for (i, _), other in valid.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def collected(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_transform_keeps_lengths():
    rows = np.random.default_rng(0).normal(size=(5, 16)).astype(np.float32)
    turned = hadamard(rows)
    assert np.linalg.norm(turned, axis=1) == pytest.approx(np.linalg.norm(rows, axis=1), rel=1e-5)
    assert turned @ turned.T == pytest.approx(rows @ rows.T, rel=1e-4, abs=1e-4)


def test_odd_vectors_ties_and_copies(spark):
    """With all axes probed the answer is exact."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 6)).round(1)
    rows = [(i, base[i % 60].tolist()) for i in range(140)]  # equal vectors under different ids
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(90)]  # a group of copies
    rows += [(300, None), (320, [0.0] * 6), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (360, [float("nan")] + [1.0] * 5)]
    rows += [(None, [1.0] * 6), (420, [1.0, 2.0]), (421, [3.0] * 7), (380, [float("inf")] + [1.0] * 5), (5, rows[5][1]), (400, [100.0] * 6)]
    wanted, found = brute(rows), collected(nearest(table(spark, rows), probes=99))
    assert found.keys() == wanted.keys()
    for q in wanted:
        assert [i for i, _ in found[q]] == [i for i, _ in wanted[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in wanted[q]], abs=1e-12)


def test_distinct_vectors_of_equal_score(spark):
    """200 vectors at one inner product with the query, in shuffled order: the smallest ids come first."""
    ids = np.random.default_rng(3).permutation(np.arange(1, 400))[:200].tolist()
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, float(i % 97) / 7, float(i)]) for i in ids if i % 20]
    found = collected(nearest(table(spark, rows), probes=99))
    assert [i for i, _ in found[0]] == sorted(i for i in ids if i % 20)[:20]


def test_blocks_change_nothing(spark, monkeypatch):
    from touchline.llm import nearest as module

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    whole = collected(nearest(table(spark, rows), tables=4))
    monkeypatch.setattr(module, "BLOCK", 7)
    monkeypatch.setattr(module, "QUERY_BLOCK", 2)
    assert collected(nearest(table(spark, rows), tables=4)) == whole


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    assert [i for i, _ in collected(nearest(table(spark, rows)))[0]] == [1, 2]
    assert nearest(table(spark, [(0, [1.0, 0.0])])).count() == 0
    assert nearest(table(spark, [])).count() == 0


def test_recall_on_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    matrix = np.array([r.embedding for r in rows], np.float64)
    found = collected(nearest(vectors))
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = matrix @ matrix[at]
        scores[at] = -np.inf
        wanted = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits += len(wanted & {i for i, _ in found[ids[at]]})
        total += 20
    assert hits / total >= 0.93


def recall_of(spark, matrix, every, **options):
    """(recall, least rows of a query) at 20 of the queries id % every = 0, with the production tables and probes."""
    found = collected(nearest(table(spark, list(enumerate(matrix.tolist()))), query_filter=f"id % {every} = 0", **options))
    hits, least = [], 20
    for at in range(0, len(matrix), every):
        scores = matrix.astype(np.float64) @ matrix[at].astype(np.float64)
        scores[at] = -np.inf
        wanted = np.lexsort((np.arange(len(matrix)), -scores))[:20].tolist()
        own = {i for i, _ in found.get(at, [])}
        least = min(least, len(own))
        hits.append(len(own & set(wanted)) / 20)
    return np.mean(hits), least


def uneven(kind, n=20_000, dims=64):
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(n, dims))
    if kind == "clustered":
        matrix = rng.normal(size=(n // 50, dims))[rng.integers(0, n // 50, n)] + 0.5 * matrix
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    if kind == "outlier":
        matrix[11] *= 50
    if kind == "mixed":
        matrix *= rng.uniform(0.9, 1.11, n)[:, None]
        matrix[: n // 10] *= np.exp(rng.normal(size=n // 10))[:, None]
        matrix[11] *= 50
    if kind == "lognormal":
        matrix *= np.exp(rng.normal(size=n))[:, None]
    return matrix.astype(np.float32)


@pytest.mark.parametrize("kind, n", [("unit", 2_000), ("unit", 10_000), ("clustered", 10_000), ("outlier", 5_000), ("mixed", 5_000), ("lognormal", 2_000)])
def test_recall_through_the_index(spark, kind, n):
    matrix = uneven(kind, n)
    recall, least = recall_of(spark, matrix, n // 100)
    print(f"recall {kind}: {recall:.3f} of {n} rows")
    assert recall >= 0.9 and least == 20


def test_queries_with_few_candidates_meet_all(spark, caplog):
    matrix = uneven("unit", 400)
    with caplog.at_level("INFO"):
        recall, least = recall_of(spark, matrix, 20, tables=1, probes=1)
    assert least == 20 and recall > 0.9 and "meet all vectors" in caplog.text
