"""Comparing what shares band keys, without all pairs of a bucket.

In a bucket every class is first compared with the bucket's smallest id only, and of the buckets of a class only with
two: the smallest and the most frequent of these ids. Where many are still apart, as in a group of copies each of which is
like a few others only, a quarter of the bands at a time joins each class to a few of those like it in other components, which
leaves few components. What is then still in different components of a bucket is compared in blocks, so no pair of classes that shares a
key goes unseen. Blocks are compared inside tasks, and only what passes leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table_of
from .components import components

#: The bands take so many turns; they end where no more than so many pairs a row are apart, or after a turn with links for less than one row in FEW.
TURNS, PAIRS_A_ROW, FEW = 4, 4, 100


def met_hubs(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of bands (key, band, id): the rows whose key is shared, with the bucket's hub, and the pairs (a, b) of classes and hubs to compare."""
    hubs = table_of(bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub"), "hubs")
    shared = table_of(bands.join(hubs, "key"), "shared")
    met = shared.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("n"))
    two = met.groupBy("id").agg(F.array_distinct(F.array(F.min("hub"), F.max_by("hub", F.struct("n", -F.col("hub"))))).alias("hubs"))
    return shared, table_of(two.select(F.col("id").alias("a"), F.explode("hubs").alias("b")), "to-hub")


def open_rows(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """key, band, id, component of the buckets that hold more than one component, as a written table."""
    marked = shared.select("key", "band", "id").join(parts, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    marked = table_of(marked, "marked")
    mixed = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return table_of(marked.join(table_of(mixed, "mixed"), "key"), "open")


def pairs_apart(open_: DataFrame) -> tuple[int, float]:
    """Rows, and pairs of rows of a bucket that are in different components."""
    sizes = open_.groupBy("key", "component").agg(F.count("*").cast("double").alias("n"))
    per_key = sizes.groupBy("key").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    found = per_key.agg(F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("squares")) / 2).alias("pairs")).first()
    return int(found["rows"] or 0), float(found["pairs"] or 0)


def stars(parts: DataFrame) -> DataFrame:
    """Links (a, b) that give the components parts: a row for each id but the smallest, however many links there were."""
    return parts.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def joined_by_best(shared: DataFrame, links: DataFrame, done: DataFrame, payloads: DataFrame, block: int, best, compare) -> tuple[DataFrame, DataFrame, DataFrame]:
    """components, rows still open and compared pairs (a, b; larger id first) after the bands' turns.

    best gives, of blocks to compare, at most a few pairs (a, b) for each member and what is like it in other components; compare gives the
    links among pairs, as a written table.
    """
    parts = components(links)
    open_ = open_rows(shared, parts)
    for turn in range(TURNS):
        rows, pairs = pairs_apart(open_)
        if pairs <= PAIRS_A_ROW * rows:
            break
        of_turn = open_.where(F.pmod("band", F.lit(TURNS)) == turn)
        found = best(blocks_of(of_turn, payloads, block)).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        met = table_of(found.join(done, ["a", "b"], "left_anti"), "best-pairs")
        more, done = compare(met), done.unionByName(met)
        new = more.count()
        if new:
            parts = components(stars(parts).union(more))
            open_ = open_rows(open_, parts)
        if new * FEW < rows:
            break
    return parts, open_, done


def blocks_apart(shared: DataFrame, parts: DataFrame, payloads: DataFrame, block: int) -> DataFrame:
    """blocks_of what is open in all buckets."""
    return blocks_of(open_rows(shared, parts), payloads, block)


def blocks_of(open_: DataFrame, payloads: DataFrame, block: int) -> DataFrame:
    """band, left, right: blocks of about so many members (id, component, payload) to compare where components differ.

    Members of one large component make a pool, which meets other pools only; all small components of a bucket are
    in one pool, whose blocks also meet each other.
    """
    per_part = open_.groupBy("key", "component").agg(F.count("*").alias("n")).withColumn("big", F.col("n") >= block)
    pool = per_part.withColumn("pool", F.when(F.col("big"), F.col("component")).otherwise(-1))
    per_pool = table_of(pool.groupBy("key", "pool").agg(F.sum("n").alias("m")), "pools")
    placed = (
        open_.join(table_of(pool.select("key", "component", "pool"), "part-pools"), ["key", "component"])
        .join(per_pool, ["key", "pool"])
        .withColumn("block", F.expr(f"pmod(xxhash64(id), (m + {block - 1}) div {block})"))
    )
    blocks = table_of(
        placed.join(payloads, "id").groupBy("key", "band", "pool", "block").agg(F.collect_list(F.struct("id", "component", "payload")).alias("members")),
        "blocks",
    )
    left, right = blocks.toDF("key", "band", "pool_a", "block_a", "left"), blocks.drop("band").toDF("key", "pool_b", "block_b", "right")
    met = left.join(right, "key").where("(pool_a < pool_b or pool_a = pool_b and pool_a = -1 and block_a <= block_b)")
    return met.select("band", "left", "right")
