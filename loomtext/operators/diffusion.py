"""Ink diffusion over tables: a layer at a time by joins, for components of any size.

`chains.fingerprints` holds a component as a dense matrix in one task. Here a fingerprint is rows, and a layer is a join of
the front with the edges, so what a task holds does not grow with a component. A join moves every row of a fingerprint, so
inner_layers and inner_distances leave groups of at most DENSE chunks to the dense form, which moves only chunks and edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.cluster import cut, kept
from loomtext.operators.chains import INK_KEPT, group_distances, group_ink_layers
from loomtext.operators.relations import group_edges
from loomtext.operators.weights import with_edge_weights, with_node_weights

#: Chunks of a group whose components are held as dense matrices.
DENSE = 1024


def neighbours(edges: DataFrame) -> DataFrame:
    """id, other, weight: both directions of every edge, parallel edges added up, loops left out."""
    both = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "weight").unionAll(edges.select("to_id", "from_id", "weight"))
    return both.where("id <> other").groupBy("id", "other").agg(F.sum("weight").alias("weight"))


def next_layer(front: DataFrame, before: DataFrame, links: DataFrame) -> DataFrame:
    """source_id, id, ink of the vertices that ink reaches next.

    front: the last layer; before: the one before it. A neighbour of the front lies in one of these two layers or in the next
    one, as layers are distances from the source; so no older layer has to be read to tell what is open.
    """
    reached = front.join(links, "id").select("source_id", "id", "ink", "other", "weight")
    closed = front.select("source_id", F.col("id").alias("other")).unionAll(before.select("source_id", F.col("id").alias("other")))
    open_ = reached.join(closed, ["source_id", "other"], "left_anti")
    room = F.sum("weight").over(Window.partitionBy("source_id", "id"))
    given = open_.select("source_id", F.col("other").alias("id"), (F.col("ink") / room * F.col("weight") * INK_KEPT).alias("ink"))
    return given.groupBy("source_id", "id").agg(F.sum("ink").alias("ink")).where("ink > 0")


def ink_layers(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, id, layer, ink: how much ink of each source reaches each vertex of its component, before shares are taken.

    edges: from_id, to_id, weight; sources: id, any vertices, as often as they like. Layer 0 is the source with ink 1. As many
    rounds as the longest distance from a source; each is written to the shared folder, so a lost executor costs one round.
    The rows are one for each source and vertex of its component: that is the size of the result.
    """
    links = cut(neighbours(edges))
    front = cut(sources.select(F.col("id").alias("source_id"), "id").where("id is not null").distinct().withColumn("ink", F.lit(1.0)))
    before, layers = front.limit(0), []
    while not front.isEmpty():
        layers.append(front.select("source_id", "id", F.lit(len(layers)).alias("layer"), "ink"))
        before, front = front, cut(next_layer(front, before, links))
    return reduce(DataFrame.unionAll, layers or [front.select("source_id", "id", F.lit(0).alias("layer"), "ink")])


def shares(layers: DataFrame) -> DataFrame:
    """source_id, id, ink: the layers' ink as shares that sum to 1 for each source."""
    return layers.select("source_id", "id", (F.col("ink") / F.sum("ink").over(Window.partitionBy("source_id"))).alias("ink"))


def inner_weights(chunks: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """from_id, to_id, strength, weight of the edges within groups, weighed as if no other edges were there."""
    return with_edge_weights(with_node_weights(chunks), group_edges(chunks, edges, groups).select("from_id", "to_id", "strength"))


def fingerprints(chunks: DataFrame, edges: DataFrame, groups: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """source_id, id, ink: what `chains.fingerprints` gives, for all vertices that are in a group or for those of sources (id)."""
    placed = chunks.join(groups, ["chapter_id", "fragment_id"])
    return shares(ink_layers(inner_weights(chunks, edges, groups), placed if sources is None else sources.join(placed.select("id"), "id", "left_semi")))


def distances(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """from_id, to_id, distance: Euclidean distance of the fingerprints at the ends of every edge.

    Fingerprints of one component are over the same vertices, so the sum runs over an equi-join; vertices only one of them has count
    with their own ink. An end without a fingerprint gives no row; parallel edges give one row, loops distance 0.
    """
    pairs = edges.select("from_id", "to_id").distinct()
    known = prints.select(F.col("source_id").alias("known")).distinct()
    pairs = pairs.join(known, pairs.from_id == known.known, "left_semi").join(known, pairs.to_id == known.known, "left_semi")
    a = pairs.join(prints, pairs.from_id == prints.source_id).select("from_id", "to_id", "id", "ink")
    b = pairs.join(prints, pairs.to_id == prints.source_id).select("from_id", "to_id", "id", (-F.col("ink")).alias("ink"))
    differences = a.unionAll(b).groupBy("from_id", "to_id", "id").agg(F.sum("ink").alias("d"))
    return differences.groupBy("from_id", "to_id").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("distance"))


def by_size(chunks: DataFrame, groups: DataFrame, dense: int = DENSE) -> tuple[DataFrame, DataFrame | None]:
    """groups with at most so many chunks, and the larger ones (None if there are none)."""
    keys = ["chapter_id", "group_id"]
    large = kept(chunks.join(groups, ["chapter_id", "fragment_id"]).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > dense).select(*keys))
    if large.isEmpty():
        return groups, None
    return groups.join(large, keys, "left_anti"), groups.join(large, keys, "left_semi")


def inner_layers(chunks: DataFrame, edges: DataFrame, groups: DataFrame, dense: int = DENSE) -> DataFrame:
    """source_id, id, layer, ink of every chunk in a group, by the edges inside groups."""
    small, large = by_size(chunks, groups, dense)
    found = group_ink_layers(chunks, edges, small)
    if large is None:
        return found
    return found.unionByName(ink_layers(inner_weights(chunks, edges, large), chunks.join(large, ["chapter_id", "fragment_id"])))


def inner_distances(chunks: DataFrame, edges: DataFrame, groups: DataFrame, dense: int = DENSE) -> DataFrame:
    """from_id, to_id, distance of the fingerprints at the ends of every edge inside a group."""
    small, large = by_size(chunks, groups, dense)
    found = group_distances(chunks, edges, small)
    if large is None:
        return found
    return found.unionByName(distances(fingerprints(chunks, edges, large), group_edges(chunks, edges, large)))
