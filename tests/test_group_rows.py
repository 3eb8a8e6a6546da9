"""Components, ink and chains of groups on rows of arrays: no rounds of joins, what the general forms give, and large groups by joins."""

import random

import pytest

from loomtext.operators import chains, diffusion
from loomtext.operators.relations import group_edges


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    chunks = [(c * 1000 + k, c, k // 6, k, rng.choice(["verbatim", None]), rng.choice(["critical", "helpful", None]), rng.randrange(1, 60)) for c in (1, 2) for k in range(30)]
    edges = [(a[0], b[0], rng.choice(["critical", "late", None])) for a in chunks for b in rng.sample(chunks, 1) if a[1] == b[1]]
    edges += edges[:3] + [(chunks[0][0], chunks[0][0], None)]  # parallel edges and a loop
    kept = spark.createDataFrame(chunks, "id long, chapter_id long, fragment_id int, sentence_index int, retention string, importance string, tokens int")
    groups = spark.createDataFrame([(c, f // 2, f) for c in (1, 2) for f in range(5)], "chapter_id long, group_id int, fragment_id int")
    return kept, spark.createDataFrame(edges, "from_id long, to_id long, strength string"), groups


def _rows(df, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_components_of_groups(spark, graph):
    chunks, edges, groups = graph
    found = chains.group_components(chunks, edges, groups)
    assert "checkpoint" not in found._jdf.queryExecution().analyzed().toString() and "Scan ExistingRDD" in found._jdf.queryExecution().executedPlan().toString()
    assert _rows(found) == _rows(chains.components(chunks, group_edges(chunks, edges, groups)))


@pytest.mark.parametrize("dense", [0, 10, 1024])
def test_ink_of_groups_of_any_size(spark, graph, dense):
    chunks, edges, groups = graph
    by_joins = diffusion.ink_layers(diffusion.inner_weights(chunks, edges, groups), chunks)
    assert _rows(diffusion.inner_layers(chunks, edges, groups, dense)) == _rows(by_joins)
    prints = diffusion.fingerprints(chunks, edges, groups)
    assert _rows(chains.fingerprints(chunks, edges, groups)) == _rows(prints)
    assert _rows(diffusion.inner_distances(chunks, edges, groups, dense)) == _rows(diffusion.distances(prints, group_edges(chunks, edges, groups)))


def test_layers_of_small_groups_are_not_joined(spark, graph):
    small = diffusion.inner_layers(*graph)._jdf.queryExecution().optimizedPlan().toString()
    assert small.count("Join ") <= 4  # chunks with groups, edges with chunks, nodes with links; no join a layer


def test_chains_take_all_chunks_of_a_group_once(spark, graph):
    chunks, edges, groups = graph
    rows = chains.chains(chunks, edges, groups, limit=90).collect()
    assert sorted(r.chunk_id for r in rows) == sorted(r.id for r in chunks.collect())
    first = {}
    for r in sorted(rows, key=lambda r: r.position):
        first.setdefault((r.chapter_id, r.group_id, r.local_snake_id), r.chunk_id)
    of = {}
    for (c, g, k), v in sorted(first.items()):
        of.setdefault((c, g), []).append((k, v))
    assert all([k for k, _ in x] == list(range(len(x))) and [v for _, v in x] == sorted(v for _, v in x) for x in of.values())


def test_no_chunks(spark, graph):
    chunks, edges, groups = graph
    none = chunks.limit(0)
    assert chains.chains(none, edges, groups).count() == chains.group_components(none, edges, groups).count() == chains.fingerprints(none, edges, groups).count() == 0
    assert diffusion.inner_layers(none, edges, groups).count() == diffusion.inner_distances(none, edges, groups).count() == 0
