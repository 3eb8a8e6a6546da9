"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the vectors again and again by a random direction near the median of the projections; what lies
near the split, measured by how far apart linked vectors can be, goes to both sides. A node most of which would go to
both sides is a tight group and stays whole. There are as many trees as a pair at the link radius needs to meet in a
leaf of some tree almost surely. Vectors that share a leaf are compared by cosine in double precision; the links found
are united to components. Equal vectors are one class from the start; vectors of unlike lengths are apart.

The first splits are fitted on a bounded sample and broadcast; leaves that are still large are split again in
rounds, each on a sample of its own rows, in tasks. Every vector is routed; between rounds only ids travel, and the vectors
join them where they are routed or compared. A leaf with many vectors is compared block by block, each block pair
in a task of its own, so leaves of any size are compared whole.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, table_of, with_ids
from .components import components

#: Vectors that the first splits are fitted on (of all lengths together, about), and those of a large leaf's own sample, about.
SAMPLE, LEAF_SAMPLE = 32_768, 2_048
#: A node is split only with so many rows of the sample, so that the median is known well.
LEAST_FIT = 64
#: Share of the pairs at the link radius that may meet in no tree, and the fewest trees.
MISSED, LEAST_TREES = 0.002, 4
#: Width of the overlap in link radii, times the usual length of a projected unit; a node with a greater share in it by all of some directions is not split.
OVERLAP, WHOLE, DIRECTIONS = 0.7, 0.35, 6
#: Vectors in a leaf, about; a leaf with more than two blocks is compared block by block.
LEAF, BLOCK = 384, 512
#: Rounds of splits, 9 levels or so each, and rows of a leaf that are routed with one copy of its splits.
MOST_ROUNDS, PART = 8, 65_536


def checked(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, size (0 for what links with nothing), digest_a, digest_b and vec, the vector's components as bytes.

    Components are kept as 4-byte floats if the column holds such, else as doubles; either way none is rounded.
    """
    narrow = dict(rows.dtypes)[vector_col] == "array<float>"
    kind = np.float32 if narrow else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b, vecs = [], [], [], []
            for v in batch.column("v").to_pylist():
                x = np.array(v, kind) if v and None not in v else np.zeros(0, kind)
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                raw = (x + kind(0)).tobytes() if good else None
                d = xxhash.xxh3_128_digest(raw or b"")
                sizes.append(len(x) if good else 0)
                a.append(int.from_bytes(d[:8], "little", signed=True))
                b.append(int.from_bytes(d[8:], "little", signed=True))
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sizes, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(vecs, pa.binary())], names=["vec_id", "size", "digest_a", "digest_b", "vec"])

    column = F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), column.alias("v")).mapInArrow(run, "vec_id long, size int, digest_a long, digest_b long, vec binary")


def _unit(vecs: list[bytes], size: int) -> np.ndarray:
    kind = np.float32 if vecs and len(vecs[0]) == 4 * size else np.float64
    x = np.frombuffer(b"".join(vecs), kind).reshape(-1, size).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Splits by node number (the root is 1, its sides 2 and 3, and so on): direction, lower and upper end of the overlap; tight: nodes kept whole."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, width: float):
        dice = np.random.Generator(np.random.PCG64(seed))
        self.splits: dict[int, tuple[np.ndarray, float, float]] = {}
        self.tight: set[int] = set()
        at = {1: np.arange(len(sample))}
        for _ in range(depth):
            sides = {}
            for node, rows in at.items():
                if len(rows) < LEAST_FIT:
                    continue
                for _ in range(DIRECTIONS):  # a group beside the median is no reason to keep the rest with it
                    direction = dice.normal(size=sample.shape[1])
                    p = sample[rows] @ direction
                    low, high = np.median(p) - width / 2, np.median(p) + width / 2
                    if ((p >= low) & (p <= high)).mean() <= WHOLE:
                        break
                else:
                    self.tight.add(node)
                    continue
                self.splits[node] = (direction, float(low), float(high))
                sides[2 * node], sides[2 * node + 1] = rows[p <= high], rows[p >= low]
            at = sides

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the leaves they reach."""
        rows, nodes, todo = [], [], [(1, np.arange(len(x)))]
        while todo:
            node, r = todo.pop()
            split = self.splits.get(node)
            if split is None:
                rows.append(r)
                nodes.append(np.full(len(r), node, np.int64))
                continue
            direction, low, high = split
            p = x[r] @ direction
            for side, some in ((2 * node, r[p <= high]), (2 * node + 1, r[p >= low])):
                if len(some):
                    todo.append((side, some))
        return np.concatenate(rows), np.concatenate(nodes)


def link_radius(least: float) -> float:
    """The distance of two unit vectors at the threshold: projected on a random direction they differ by a normal number of that deviation."""
    return float(np.sqrt(max(2 - 2 * least, 0)))


def depth_of(n_rows: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n_rows, 1) / LEAF))))


def trees_for(depth: int, least: float) -> int:
    """Trees by which a pair at the link radius meets in a leaf but for a share MISSED.

    A split parts such a pair if their projections lie on both sides of the overlap: with the density of the
    projections at the median, 1 / sqrt(2 pi), times what their difference exceeds the overlap's width by on average.
    """
    tail = 0.5 * math.erfc(OVERLAP / math.sqrt(2))
    excess = 2 * (math.exp(-OVERLAP * OVERLAP / 2) / math.sqrt(2 * math.pi) - OVERLAP * tail)
    lost = 1 - (1 - min(0.9, link_radius(least) * excess / math.sqrt(2 * math.pi))) ** max(depth, 1)
    return max(LEAST_TREES, math.ceil(math.log(MISSED) / math.log(lost))) if lost > 0 else LEAST_TREES


def fit_forest(sample: np.ndarray, n_rows: int, least: float = 0.95) -> list[Tree]:
    depth = depth_of(n_rows)
    return [Tree(sample, depth, 1000 + t, OVERLAP * link_radius(least)) for t in range(trees_for(depth, least))]


_ROUTED = "leaf long, tight boolean, size int, id long"


def _leaf_key(*parts: int) -> int:
    """A number for a leaf; should two leaves get one number, they are compared as one."""
    return int.from_bytes(xxhash.xxh3_64_digest(repr(parts).encode()), "little", signed=True)


def _placed(batch: pa.RecordBatch, tree: Tree, x: np.ndarray, size: int, *above: int) -> pa.RecordBatch:
    rows, nodes = tree.leaves(x)
    found, at = np.unique(nodes, return_inverse=True)
    keys = np.array([_leaf_key(*above, int(node)) for node in found], np.int64)
    tight = np.array([int(node) in tree.tight for node in found], bool)
    ids = batch.column("id").to_numpy()[rows]
    return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(tight[at]), pa.array(np.full(len(rows), size, np.int32)), pa.array(ids)], names=["leaf", "tight", "size", "id"])


def _runs(batch: pa.RecordBatch, column: str, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch in which the column keeps its value, of so many rows at most."""
    values = batch.column(column).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for at in range(a, b, most):
            yield batch.slice(at, min(most, b - at))


def _routed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _runs(whole.take(pc.sort_indices(whole, [("size", "ascending")])), "size") if whole.num_rows else ():
                size = batch.column("size")[0].as_py()
                forest = sent.value.get(size) or [Tree(np.zeros((0, size)), 0, 0, 0.0)]
                x = _unit(batch.column("vec").to_pylist(), size)
                for t, tree in enumerate(forest):
                    yield _placed(batch, tree, x, size, size, t)

    return run


def _refitted(least: float):
    """Splits of a large leaf from a sample of its rows, pickled."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        leaf, size, m = int(rows["leaf"][0]), int(rows["size"][0]), int(rows["m"][0])
        sample = _unit(rows.sort_values("id")["vec"].tolist(), size)
        tree = Tree(sample, depth_of(m), leaf & 0xFFFFFFFF, OVERLAP * link_radius(least))
        return pd.DataFrame({"leaf": [leaf], "tree": [pickle.dumps(tree)]})

    return run


def _rerouted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _runs(whole, "leaf") if whole.num_rows else ():
            size, leaf = batch.column("size")[0].as_py(), batch.column("leaf")[0].as_py()
            yield _placed(batch, pickle.loads(batch.column("tree")[0].as_py()), _unit(batch.column("vec").to_pylist(), size), size, leaf)


def _compared(least: float):
    """Links of a block pair; of the leaves that both vectors are in, a pair counts in the one with the lowest number."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "id"], ignore_index=True)
        ids, block, leaf = rows["id"].to_numpy(), rows["block"].to_numpy(), int(rows["leaf"][0])
        x = _unit(rows["vec"].tolist(), int(rows["size"][0]))
        i, j = int(rows["one"][0]), int(rows["other"][0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(x[left] @ x[right].T >= least)
        a, b = left[a], right[b]
        keep = ids[a] < ids[b] if i == j else ids[a] != ids[b]
        a, b = a[keep], b[keep]
        lower = [set(k for k in leaves if k < leaf) for leaves in rows["leaves"]] if len(a) else []
        keep = np.array([lower[p].isdisjoint(lower[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = ids[a[keep]], ids[b[keep]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def leaves_of(classes: DataFrame, least: float) -> DataFrame:
    """leaf, size, id: all leaves of every class (id, size, vec), as a written table."""
    spark = classes.sparkSession
    counts = {r["size"]: r["count"] for r in classes.groupBy("size").count().where(F.col("count") > LEAF).collect()}
    each = max(SAMPLE // max(len(counts), 1), LEAST_FIT)
    # each row by a hash of its own, so no task sees all ids of a size
    shares = spark.createDataFrame([(size, each / n) for size, n in counts.items()], "size int, share double")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = classes.join(F.broadcast(shares), "size").where(place < F.col("share")).select("size", "id", "vec").toArrow().sort_by([("size", "ascending"), ("id", "ascending")])
    forests = {}
    for size, n in counts.items():
        vecs = sample.filter(pc.equal(sample.column("size"), size)).column("vec").to_pylist()
        forests[size] = fit_forest(_unit(vecs, size), n, least)
    routed = table_of(classes.select("id", "size", "vec").mapInArrow(_routed(spark.sparkContext.broadcast(forests)), _ROUTED), "leaves")
    done: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        sizes = table_of(routed.groupBy("leaf").agg(F.count("*").alias("m"), F.max("tight").alias("tight")), "leaf-sizes")
        large = sizes.where(f"m > {2 * LEAF} and not tight and m > {LEAST_FIT}").select("leaf", "m")
        if large.isEmpty():
            break
        done.append(routed.join(large, "leaf", "left_anti"))
        of = table_of(routed.drop("tight").join(large, "leaf"), "large-leaves")
        own = of.where(F.pmod(F.xxhash64("id", "leaf"), F.lit(1 << 32)) / F.lit(float(1 << 32)) < F.lit(float(LEAF_SAMPLE)) / F.col("m"))
        fitted = table_of(own.join(classes.select("id", "vec"), "id").groupBy("leaf").applyInPandas(_refitted(least), "leaf long, tree binary"), "leaf-splits")
        parts = F.expr(f"cast((m + {PART - 1}) div {PART} as int)")
        trees = fitted.join(large, "leaf").select("leaf", "tree", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        rows = of.withColumn("part", F.pmod(F.xxhash64("id"), parts)).join(classes.select("id", "vec"), "id")
        routed = table_of(rows.join(trees, ["leaf", "part"]).select("leaf", "size", "id", "vec", "tree").mapInArrow(_rerouted, _ROUTED), "leaves")
    done.append(routed)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select("leaf", "size", "id")


def near_duplicate_vectors(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing; so
    does a null id, whose component is null; vectors of unlike lengths never link; equal vectors are linked; repeated
    rows count as vectors of their own; other columns are ignored; an empty table gives no rows.
    """
    every = table_of(checked(rows, id_col, vector_col), "vectors")
    good = (F.col("size") > 0) & F.col("vec_id").isNotNull()
    # ids may repeat with unlike vectors, so a class is known by its digest
    classes = every.where(good).groupBy("digest_a", "digest_b").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("vec").alias("vec"))
    classes = with_ids(classes, "vector-classes")
    leaves = leaves_of(classes, least)
    sizes = table_of(leaves.groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1"), "leaf-sizes")
    blocks = F.expr(f"case when m > {2 * BLOCK} then (m + {BLOCK - 1}) div {BLOCK} else 1 end").cast("int")
    placed = leaves.join(sizes, "leaf").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    per_id = leaves.groupBy("id").agg(F.collect_list("leaf").alias("leaves"))  # a few for each tree
    vectors = table_of(classes.select("id", "vec").join(per_id, "id"), "vector-leaves")
    met = placed.join(vectors, "id").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = met.select("leaf", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "block", "size", "id", "vec", "leaves")
    links = table_of(pairs.groupBy("leaf", "one", "other").applyInPandas(_compared(least), "a long, b long"), "vector-links")
    parts = components(links)
    copies = classes.select("id", "copies")
    both = links.select("a", "b").union(links.select("b", "a")).toDF("id", "to")
    linked = both.join(copies.toDF("to", "n"), "to").groupBy("id").agg(F.sum("n").alias("linked"))
    lowest = parts.join(classes.select("id", "lowest"), "id").groupBy("component").agg(F.min("lowest").alias("part"))
    part_of = parts.join(lowest, "component").select("id", "part")
    per_class = table_of(classes.join(linked, "id", "left").join(part_of, "id", "left").select("digest_a", "digest_b", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("part", "lowest").alias("part")), "class-links")
    keyed = every.select("vec_id", *[F.when(good, F.col(c)).alias(c) for c in ("digest_a", "digest_b")])
    part = F.when(F.col("vec_id").isNotNull(), F.coalesce("part", "vec_id"))
    return keyed.join(per_class, ["digest_a", "digest_b"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(F.col("vec_id") == part, F.lit(True)).alias("kept"))


def op8_projection_forest(spark, sf_dir):
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = {
    "op8_projection_forest": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= 0.95
),
reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings
  UNION
  SELECT reach.vec_id, l.b FROM reach JOIN links l ON reach.r = l.a
)
SELECT e.vec_id, count(l.b)::BIGINT AS n_links, any_value(m.c) AS component_id, e.vec_id = any_value(m.c) AS kept
FROM embeddings e LEFT JOIN links l ON e.vec_id = l.a
JOIN (SELECT vec_id, min(r) AS c FROM reach GROUP BY 1) m ON m.vec_id = e.vec_id
GROUP BY e.vec_id
""",
}
QUERIES = {"op8_projection_forest": op8_projection_forest}
