"""Ink spread by joins is what the dense form gives, and large components run."""

import random

import numpy as np
import pytest

from loomtext.operators import chains, diffusion


def edge_table(spark, edges):
    return spark.createDataFrame(edges, "from_id long, to_id long, weight double")


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_equal_the_dense_form(spark, seed):
    rng = random.Random(seed)
    parts = [list(range(0, 9)), list(range(9, 23)), [23]]
    edges = [(rng.choice(p), rng.choice(p), rng.choice([0.1, 1.0, 2.5])) for p in parts for _ in range(2 * len(p))]  # with loops and parallel edges
    ids = [v for p in parts for v in p]
    dense = chains.ink(ids, edges)
    want = {(a, b): dense[i, j] for i, a in enumerate(ids) for j, b in enumerate(ids) if dense[i, j] > 0}
    table, vertices = edge_table(spark, edges), spark.createDataFrame([(v,) for v in ids + ids[:3] + [None]], "id long")
    prints = diffusion.shares(diffusion.ink_layers(table, vertices))
    got = {(r.source_id, r.id): r.ink for r in prints.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    far = {(r.from_id, r.to_id): r.distance for r in diffusion.distances(prints, table).collect()}
    at = {v: i for i, v in enumerate(ids)}
    assert far.keys() == {(u, v) for u, v, _ in edges}
    assert all(abs(x - np.linalg.norm(dense[at[u]] - dense[at[v]])) < 1e-9 for (u, v), x in far.items())


def test_nothing_to_spread(spark):
    none = spark.createDataFrame([], "id long")
    assert diffusion.ink_layers(edge_table(spark, []), none).count() == 0
    alone = diffusion.ink_layers(edge_table(spark, []), spark.createDataFrame([(5,)], "id long"))
    assert [tuple(r) for r in alone.collect()] == [(5, 5, 0, 1.0)]


def test_a_component_of_20000_vertices(spark):
    rng = random.Random(3)
    n = 20_000
    edges = [(v, rng.randrange(v), 1.0) for v in range(1, n)] + [(0, v, 1.0) for v in range(1, n, 3)]  # a tree with a hub
    sources = spark.createDataFrame([(v,) for v in range(0, n, 1000)], "id long")
    rows = diffusion.ink_layers(edge_table(spark, edges), sources)
    counted = rows.groupBy("source_id").count().collect()
    assert {(r.source_id, r["count"]) for r in counted} == {(v, n) for v in range(0, n, 1000)}
