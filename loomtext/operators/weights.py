"""Vertex and edge weights, fragment incisions and their levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.cluster import cut
from loomtext.operators.running_order import RunningOrder
from loomtext.schemas import IMPORTANCE, RETENTION, STRENGTH, level_value

EDGE_FLOOR = 0.1


def node_weight(retention: str = "retention", importance: str = "importance", strict: bool = False) -> Column:
    zero = F.lit(0)
    return (F.coalesce(level_value(retention, RETENTION, strict), zero) + F.coalesce(level_value(importance, IMPORTANCE, strict), zero)).cast("double")


def with_node_weights(chunks: DataFrame, strict: bool = False) -> DataFrame:
    return chunks.withColumn("weight", node_weight(strict=strict))


def edge_strength(col: str = "strength", strict: bool = False) -> Column:
    return F.coalesce(level_value(col, STRENGTH, strict), F.lit(1)).cast("double")


def incident_strength(edges: DataFrame) -> DataFrame:
    """id, total: the strengths of all edges at a vertex; a loop counts twice."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"), edge_strength().alias("st"))
    return ends.groupBy("id").agg(F.sum("st").alias("total"))


def with_edge_weights(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with weight: each end gives its vertex's weight in proportion to the edge's strength there."""
    ends = chunks.select("id", "weight").join(incident_strength(edges), "id")
    a, b = ends.toDF("from_id", "wa", "sa"), ends.toDF("to_id", "wb", "sb")
    st = edge_strength()
    weight = F.greatest(F.col("wa") * st / F.col("sa") + F.col("wb") * st / F.col("sb"), F.lit(EDGE_FLOOR))
    return edges.drop("weight").join(a, "from_id").join(b, "to_id").withColumn("weight", weight).drop("wa", "sa", "wb", "sb")


def incident_edges(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Both orientations of every edge with the places of its ends: two equi-joins in place of an OR."""
    both = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), "weight").unionAll(edges.select("to_id", "from_id", "weight"))
    place = chunks.select("id", F.struct("chapter_id", "fragment_id").alias("place"))
    return both.join(place, "id").join(place.toDF("other_id", "other_place"), "other_id")


def external_edges(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Incident edges whose other end lies in another fragment."""
    return incident_edges(chunks, edges).where(F.col("place") != F.col("other_place"))


def fragment_incisions(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """chapter_id, fragment_id, start_incision, end_incision of every fragment with chunks.

    A chunk's weight is shared among its external edges by their weights; shares towards earlier fragments count
    at the start, the others at the end.
    """
    of_chunk = Window.partitionBy("id")
    outer = external_edges(chunks, edges).join(chunks.select("id", F.col("weight").alias("cw")), "id").withColumn("all", F.sum("weight").over(of_chunk)).where("all > 0")
    share = F.col("cw") / F.col("all") * F.col("weight")
    early = F.col("other_place") < F.col("place")
    sums = outer.groupBy("place").agg(F.sum(F.when(early, share).otherwise(0.0)).alias("start_incision"), F.sum(F.when(early, 0.0).otherwise(share)).alias("end_incision"))
    fragments = chunks.select("chapter_id", "fragment_id").distinct()
    sums = sums.select("place.chapter_id", "place.fragment_id", "start_incision", "end_incision")
    return fragments.join(sums, ["chapter_id", "fragment_id"], "left").fillna(0.0, ["start_incision", "end_incision"])


def value_at_rank(values: DataFrame, share: float) -> DataFrame:
    """One row: n and the value at place min(floor(n * share), n - 1) of the ascending order.

    Exact without sorting all values in one task: they are counted in narrow ranges first, then only the range that
    holds the place is ranked.
    """
    ranged = values.select("v", F.floor(F.log2("v") * 256).alias("range"))
    counts = ranged.groupBy("range").agg(F.count("*").alias("k"))
    everything = Window.partitionBy()  # a few thousand ranges at most, as doubles have 2048 powers of two
    found = (
        counts.withColumn("upto", F.sum("k").over(everything.orderBy("range"))).withColumn("n", F.sum("k").over(everything))
        .withColumn("place", F.least(F.floor(F.col("n") * share), F.col("n") - 1))
        .where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("k") <= F.col("place")))
        .select("range", "n", (F.col("place") - F.col("upto") + F.col("k")).alias("within"))
    )
    ranked = ranged.join(F.broadcast(found), "range").withColumn("r", F.row_number().over(Window.partitionBy("range").orderBy("v")) - 1)
    return ranked.where("r = within").select("n", F.col("v").alias("threshold"))


def _corpus_facts(values: DataFrame, share: float) -> DataFrame:
    top = value_at_rank(values, share)
    normal = values.join(F.broadcast(top), F.col("v") < F.col("threshold")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return normal.join(top, F.lit(True), "left")  # one row


def _chapter_facts(values: DataFrame, share: float) -> DataFrame:
    own = Window.partitionBy("chapter_id")
    placed = values.withColumn("r", F.row_number().over(own.orderBy("v")) - 1).withColumn("n", F.count("*").over(own))
    top = placed.where(F.col("r") == F.least(F.floor(F.col("n") * share), F.col("n") - 1)).select("chapter_id", F.col("v").alias("threshold"))
    normal = values.join(top, "chapter_id").where("v < threshold").groupBy("chapter_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return top.join(normal, "chapter_id", "left")


def _prefix_facts(values: DataFrame, chapters: DataFrame, share: float) -> DataFrame:
    """Facts of the values of all chapters up to and including each one, in order of chapter_id."""
    order = RunningOrder.of(values, chapters)
    top = cut(order.at(chapters.select("chapter_id").distinct(), F.least(F.floor(F.col("n") * share), F.col("n") - 1)).withColumnRenamed("v", "threshold"))
    # the smallest value, and the last one below the threshold, are two more places of the same order
    ends = top.where("less > 0").select("chapter_id", F.explode(F.array(F.lit(0).cast("long"), F.col("less") - 1)).alias("place")).distinct()
    normal = order.at(ends, F.col("place")).groupBy("chapter_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return top.select("chapter_id", "threshold").join(normal, "chapter_id", "left")


def incision_levels(incisions: DataFrame, share: float = 0.98, digits: int = 9, scope: str = "corpus") -> DataFrame:
    """start_level and end_level, 0 to 10, on a logarithmic scale below the share's value; digits rounds float sums first.

    scope: what a chapter's incisions are measured against: "corpus" all of them, "chapter" its own, "prefix" those of the chapters
    up to and including it, in order of chapter_id, as when chapters are saved one after another.
    """
    # every fact reads the incisions again, so they are written once
    rounded = cut(incisions.withColumn("start_incision", F.round("start_incision", digits)).withColumn("end_incision", F.round("end_incision", digits)))
    values = rounded.select("chapter_id", F.explode(F.array("start_incision", "end_incision")).alias("v")).where("v > 0")
    if scope == "corpus":
        with_facts = rounded.join(F.broadcast(_corpus_facts(values.select("v"), share)), F.lit(True), "left")
    elif scope == "chapter":
        with_facts = rounded.join(_chapter_facts(values, share), "chapter_id", "left")
    elif scope == "prefix":
        values = rounded.select("chapter_id", F.explode(F.array("start_incision", "end_incision")).alias("v"))
        with_facts = rounded.join(_prefix_facts(values, rounded, share), "chapter_id", "left")
    else:
        raise ValueError(f"scope is corpus, chapter or prefix, not {scope!r}")

    def level(name: str) -> Column:
        v = F.col(name)
        span = F.log("high") - F.log("low")
        scaled = F.bround(1 + (F.log(v) - F.log("low")) / F.when(span == 0, 1.0).otherwise(span) * 9, 0)
        return F.when(v <= 0, 0).when(F.col("low").isNull() | (v >= F.col("threshold")), 10).otherwise(F.least(F.greatest(scaled, F.lit(1)), F.lit(10))).cast("int")

    return with_facts.select(*incisions.columns, level("start_incision").alias("start_level"), level("end_incision").alias("end_level"))
