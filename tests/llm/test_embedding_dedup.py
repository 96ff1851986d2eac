"""The pivot index against all pairs."""

import numpy as np
import pytest

from touchline.llm import embedding_dedup as module
from touchline.llm.embedding_dedup import similar_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row string, entry string, key string, n string, pivots string, root string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, *"abcdef") for i, v, label in rows], SCHEMA).coalesce(2)


def takes_part(vector, label):
    return label is not None and bool(vector) and all(x is not None and np.isfinite(x) for x in vector) and any(vector)


def brute(rows, cosine=0.93):
    """(id, n_links, component_id, kept) of each row, sorted."""
    lowest = -(2**63)
    ids = [lowest if i is None else i for i, _, _ in rows]
    near = [set() for _ in rows]
    for a, (_, x, lx) in enumerate(rows):
        for b, (_, y, ly) in enumerate(rows[:a]):
            if lx == ly and takes_part(x, lx) and takes_part(y, ly) and len(x) == len(y):
                u, v = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                if (u / np.linalg.norm(u)) @ (v / np.linalg.norm(v)) >= cosine:
                    near[a].add(b)
                    near[b].add(a)
    component = list(ids)
    changed = True
    while changed:
        changed = False
        for a, others in enumerate(near):
            least = min([component[a], *(component[b] for b in others)])
            changed |= least < component[a]
            component[a] = least
    back = lambda x: None if x == lowest else x
    out = [(back(i), len(others), back(c), i == c) for i, others, c in zip(ids, near, component, strict=True)]
    return sorted(out, key=str)


def collected(found):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()), key=str)


def turned(rng, vector, cosine):
    """A unit vector at that cosine to ``vector``."""
    unit = vector / np.linalg.norm(vector)
    side = rng.normal(size=len(vector))
    side -= (side @ unit) * unit
    return cosine * unit + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def planted(rng, n, dims, pairs, low=0.93, high=0.97):
    """Random rows and, for the first ``pairs`` of them, one at a cosine just above the limit."""
    base = rng.normal(size=(n, dims))
    close = [turned(rng, base[i], rng.uniform(low, high)) * rng.uniform(0.5, 2) for i in range(pairs)]
    return np.concatenate([base, close])


def odd_vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 6)).round(1)
    rows = [(i, turned(rng, base[i % 40], 0.97).tolist(), i % 3) for i in range(160)]
    rows += [(500 - i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], 1) for i in range(60)]  # copies
    rows += [(600, [2.0, 4.0, 0.0, 0.0, 0.0, 2.0], 1), (601, [1.0, 2.0, -0.0, 0.0, 0.0, 1.0], 1), (602, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], 2)]
    rows += [(700, None, 1), (701, [0.0] * 6, 1), (702, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (703, [float("nan")] + [1.0] * 5, 1)]
    rows += [(704, [], 1), (705, [float("inf")] + [1.0] * 5, 1), (706, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], None)]
    rows += [(None, [3.0, 1.0, 1.0, 0.0, 2.0, 5.0], 4), (None, [3.0, 1.0, 1.0, 0.0, 2.0, 5.0], 4), (707, [3.0, 1.0, 1.0, 0.0, 2.0, 5.0], 4)]
    rows += [(5, rows[5][1], 2), (5, rows[6][1], 0), (708, [1.0, 2.0], 1), (709, [2.0, 4.0], 1), (710, [1e30] * 6, 5), (711, [1e-30] * 6, 5)]
    return rows


def test_odd_vectors(spark):
    rows = odd_vectors()
    assert collected(similar_vectors(table(spark, rows))) == brute(rows)


def test_empty_and_lone(spark):
    assert similar_vectors(table(spark, [])).count() == 0
    assert collected(similar_vectors(table(spark, [(3, None, None)]))) == [(3, 0, 3, True)]
    assert collected(similar_vectors(table(spark, [(3, [1.0], 1)]))) == [(3, 0, 3, True)]


@pytest.mark.parametrize("block", [10_000, 60])
def test_clusters_and_blocks(spark, monkeypatch, block):
    """A large group of near copies and chains; blocks of a list change nothing."""
    monkeypatch.setattr(module, "BLOCK", block)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    matrix = np.concatenate([[turned(rng, centre, 0.985) for _ in range(150)], planted(rng, 250, 16, 60)])
    rows = [(int(i), v.tolist(), int(i) % 2) for i, v in zip(rng.permutation(len(matrix)), matrix, strict=True)]
    wanted, found = brute(rows), collected(similar_vectors(table(spark, rows)))
    links = [sum(n for _, n, _, _ in answer) for answer in (found, wanted)]
    assert 0.98 * links[1] <= links[0] <= links[1]
    # Vectors described by all pivots are all candidates of each other, so that every link is found.
    assert collected(similar_vectors(table(spark, rows), prefix=64)) == wanted


def recall_of(spark, matrix, **index):
    """Share of the linked pairs that the index finds, by the sums of n_links, over one label."""
    unit = matrix.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    wanted = sum(int((unit[a : a + 1000] @ unit.T >= 0.93).sum()) for a in range(0, len(unit), 1000)) - len(unit)
    rows = [(i, v, 0) for i, v in enumerate(matrix.tolist())]
    found = similar_vectors(table(spark, rows), **index).selectExpr("sum(n_links)").first()[0]
    assert found <= wanted
    return found / wanted


@pytest.mark.parametrize("n, dims", [(2_000, 64), (20_000, 64), (5_000, 16)])
def test_recall_just_above_the_limit(spark, n, dims):
    """Pairs at cosines of 0.93 to 0.97, the hardest to find."""
    recall = recall_of(spark, planted(np.random.default_rng(n), n, dims, n // 10))
    print(f"recall of {n} + {n // 10} rows of {dims}: {recall:.4f}")
    assert recall >= 0.95


def test_recall_in_uneven_data(spark):
    """Half of the rows lie in a few tight clusters, whose vectors share their nearest pivots."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 32))
    matrix = np.concatenate([planted(rng, 2_000, 32, 300), [turned(rng, centres[i % 5], rng.uniform(0.95, 0.99)) for i in range(2_000)]])
    recall = recall_of(spark, matrix)
    print(f"recall in clusters: {recall:.4f}")
    assert recall >= 0.95
