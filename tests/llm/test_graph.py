import random

import pyarrow as pa

from touchline.llm import graph
from touchline.llm.graph import connected_components


def smallest_reachable(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    root = {}
    for start in sorted(near):
        todo = [] if start in root else [start]
        while todo:
            if (n := todo.pop()) not in root:
                root[n] = start
                todo += near[n]
    return root


def tangled(seed):
    """A path in random order, a star, a dense group, a loose graph, negative and repeated edges."""
    rng = random.Random(seed)
    order = rng.sample(range(-60, 60), 120)
    edges = list(zip(order, order[1:], strict=False)) + [(500 + rng.randint(1, 900), 500) for _ in range(400)]
    edges += [(a, b) for a in range(2000, 2025) for b in range(2000, 2025)] + [(rng.randint(3000, 3400), rng.randint(3000, 3400)) for _ in range(260)]
    edges += edges[::7]
    rng.shuffle(edges)
    return edges


def test_components_take_few_jobs(spark):
    edges = tangled(1)
    spark.sparkContext.setJobGroup("components", "one call")
    try:
        found = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found) == sorted(smallest_reachable([e for e in edges if e[0] != e[1]]).items())
    # Threads, plans and records of jobs are what the driver holds of a round; rounds of nested plans took 105 jobs here.
    assert jobs <= 48


def test_stars_are_cut_by_their_number_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "FOREST", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([2, 3, 5, 9], pa.int64()), pa.array([1, 2, 4, 5], pa.int64())], names=["u", "v"])
    stars = [s.to_pydict() for s in graph._forests(iter([batch, batch.slice(0, 1), batch.slice(0, 0)]))]
    assert stars == [{"u": [2, 3, 5, 9], "v": [1, 1, 4, 4]}, {"u": [2], "v": [1]}]
