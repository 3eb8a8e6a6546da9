"""Running order statistics: the value at a place of the ascending order of everything up to and including a chapter.

Values get ranks; a rank is read as digits, the highest first. For a digit, counts of the values that start with what is known so
far are summed along the chapters, which tells the next digit for every chapter at once. Chapters lie in blocks, and a block's sums
start from those of the blocks before it, so no task goes through all chapters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.cluster import cut

DIGITS = 16
_SUMS = [f"upto_{j}" for j in range(DIGITS)]


def ranked(values: DataFrame) -> DataFrame:
    """v, rank from 0 of the distinct positive values: counted in narrow ranges first, then ranked within each."""
    distinct = values.select("v").distinct().withColumn("range", F.floor(F.log2("v") * 256))
    everything = Window.partitionBy().orderBy("range")  # some 500,000 ranges at most, as doubles have 2048 powers of two
    before = distinct.groupBy("range").agg(F.count("*").alias("k")).select("range", (F.sum("k").over(everything) - F.col("k")).alias("before"))
    return distinct.join(before, "range").select("v", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("v")) - 1).alias("rank"))


@dataclass
class RunningOrder:
    """points: chapter_id, block, rank, k (a row without rank for each chapter); ranks: v, rank; depth: digits of a rank."""

    points: DataFrame
    ranks: DataFrame
    depth: int

    @classmethod
    def of(cls, values: DataFrame, chapters: DataFrame) -> RunningOrder:
        """values: chapter_id, v > 0 (others and nulls are left out); chapters: every chapter that will be asked for."""
        counted = cut(values.where("v > 0").groupBy("chapter_id", "v").agg(F.count("*").alias("k")))
        ranks = cut(ranked(counted))
        rows = counted.join(ranks, "v").select("chapter_id", "rank", "k")
        asked = chapters.select("chapter_id").distinct().select("chapter_id", F.lit(None).cast("long").alias("rank"), F.lit(0).cast("long").alias("k"))
        points = cut(rows.unionAll(asked).repartitionByRange("chapter_id").withColumn("block", F.spark_partition_id()))
        depth, reach = 1, DIGITS
        while reach < ranks.count():
            depth, reach = depth + 1, reach * DIGITS
        return cls(points, ranks, depth)

    def _running(self, open_: DataFrame, step: int) -> DataFrame:
        """node, block, chapter_id of open_ with upto_j: values up to the chapter whose digit at this step is j at most."""
        known = self.points.where("rank is not null").select(
            "block", "chapter_id", F.expr(f"rank div {step * DIGITS}").alias("node"), F.expr(f"(rank div {step}) % {DIGITS}").alias("digit"), "k", F.lit(False).alias("asked")
        )
        asked = open_.select("block", "chapter_id", "node", F.lit(0).cast("long").alias("digit"), F.lit(0).cast("long").alias("k"), F.lit(True).alias("asked")).distinct()
        rows = known.join(asked.select("node").distinct(), "node", "left_semi").select(*asked.columns).unionAll(asked)
        sums = [F.sum(F.when(F.col("digit") <= j, F.col("k")).otherwise(0)).alias(name) for j, name in enumerate(_SUMS)]
        each = rows.groupBy("node", "block", "chapter_id").agg(F.max("asked").alias("asked"), *sums)
        along = Window.partitionBy("node", "block").orderBy("chapter_id").rowsBetween(Window.unboundedPreceding, 0)
        earlier = Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as blocks
        blocks = each.groupBy("node", "block").agg(*[F.sum(s).alias(s) for s in _SUMS]).select("node", "block", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"b_{s}") for s in _SUMS])
        inner = each.select("node", "block", "chapter_id", "asked", *[F.sum(s).over(along).alias(s) for s in _SUMS]).where("asked")
        return inner.join(blocks, ["node", "block"]).select("node", "block", "chapter_id", *[(F.col(s) + F.col(f"b_{s}")).alias(s) for s in _SUMS])

    def at(self, queries: DataFrame, place: Column) -> DataFrame:
        """queries with v, the value at place (from 0), and less, how many values before the chapter's end are smaller.

        queries: chapter_id and other columns (not v, less, n, block, node, need); place may use them and n, the number of values up
        to the chapter. Rows whose place is no place of the order, which there is none of without values, are left out.
        """
        own = self.points.where("rank is null").select("chapter_id", "block")
        state = cut(queries.join(own, "chapter_id").withColumn("node", F.lit(0).cast("long")).withColumn("less", F.lit(0).cast("long")))
        for level in reversed(range(self.depth)):
            met = state.join(self._running(state, DIGITS**level), ["node", "block", "chapter_id"])
            if level == self.depth - 1:
                met = met.withColumn("n", F.col(_SUMS[-1])).withColumn("need", place.cast("long")).where("need >= 0 and need < n").drop("n")
            digit, under = F.lit(0), F.lit(0).cast("long")
            for s in _SUMS:
                digit = digit + (F.col(s) <= F.col("need")).cast("int")
                under = F.greatest(under, F.when(F.col(s) <= F.col("need"), F.col(s)).otherwise(0))
            moved = met.withColumn("digit", digit).withColumn("under", under)
            state = cut(moved.select(*queries.columns, "block", (F.col("node") * DIGITS + F.col("digit")).alias("node"), (F.col("need") - F.col("under")).alias("need"), (F.col("less") + F.col("under")).alias("less")))
        return state.join(self.ranks, state.node == self.ranks.rank).select(*queries.columns, "v", "less")
