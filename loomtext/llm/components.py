"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table_of


def components(links: DataFrame) -> DataFrame:
    """links: a, b long. Returns id, component (the smallest id reachable) of every id that has a link.

    A round gives each id the smallest of its own label, its neighbours' labels and its label's label; the number of
    rounds grows with the logarithm of the longest chain. Every round is one written table, so lineage stays short.
    """
    both = table_of(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = table_of(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("above"))
        low = F.least("component", "m", "above")
        met = labels.join(near, labels.id == near.a, "left").join(above, "component", "left")
        new = table_of(met.select("id", low.alias("component"), (low < F.col("component")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
