"""Marked-up text of fragments: coverage, label islands, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.schemas import IMPORTANCE, RETENTION, level_value

_SID = ["chapter_id", "fragment_id", "sentence_index"]


def _best(levels: dict[str, int], col: str) -> Column:
    return F.coalesce(level_value(col, levels), F.lit(0))


def coverage(chunks: DataFrame, chunk_sentences: DataFrame) -> DataFrame:
    """label, retention and importance of every covered sentence: the best of each, the label by retention, then importance; ties: the smallest chunk id."""
    rows = chunk_sentences.join(chunks.select(F.col("id").alias("chunk_id"), "label", "retention", "importance"), "chunk_id")
    r, i, first = _best(RETENTION, "retention"), _best(IMPORTANCE, "importance"), -F.col("chunk_id")
    return rows.groupBy(*_SID).agg(
        F.max_by("label", F.struct(r, i, first)).alias("label"),
        F.max_by("retention", F.struct(r, first)).alias("retention"),
        F.max_by("importance", F.struct(i, first)).alias("importance"),
    )


def islands(sentences: DataFrame, covered: DataFrame) -> DataFrame:
    """Spans of consecutive sentences of one label; a sentence without a label is a span of its own."""
    order = Window.partitionBy("chapter_id", "fragment_id").orderBy("sentence_index")
    rows = sentences.join(covered, _SID, "left")
    prev = F.lag("label").over(order)
    begins = F.when(F.col("label").isNull() | prev.isNull() | (F.col("label") != prev), 1).otherwise(0)
    numbered = rows.withColumn("begins", begins).withColumn("span", F.sum("begins").over(order) - 1)
    parts = F.array_sort(F.collect_list(F.struct("sentence_index", "text")))
    return numbered.groupBy("chapter_id", "fragment_id", "span").agg(
        F.count("*").alias("n"), F.min_by("label", "sentence_index").alias("label"), F.min_by("retention", "sentence_index").alias("retention"),
        F.min_by("importance", "sentence_index").alias("importance"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
    )


def rendered_span(mode: str = "full") -> Column:
    """mode: full (all attributes), high (only verbatim and detailed spans), plain."""
    text = F.col("text")
    if mode == "full":
        attrs = F.concat_ws(" ", F.concat(F.lit('label="'), "label", F.lit('"')), F.concat(F.lit('retention="'), "retention", F.lit('"')), F.concat(F.lit('importance="'), "importance", F.lit('"')))
        return F.when(F.col("label").isNotNull(), F.concat(F.lit("<chunk "), attrs, F.lit(">"), text, F.lit("</chunk>"))).otherwise(text)
    if mode == "high":
        return F.when(F.col("retention").isin("verbatim", "detailed"), F.concat(F.lit('<chunk retention="'), "retention", F.lit('">'), text, F.lit("</chunk>"))).otherwise(text)
    return text


def marked_fragments(spans: DataFrame, mode: str = "full") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("span", rendered_span(mode).alias("t"))))
    return spans.groupBy("chapter_id", "fragment_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def gap_synopses(used: DataFrame, fragments: DataFrame) -> DataFrame:
    """Before each used fragment (chapter_id, fragment_id) that follows a gap: the non-empty synopses of the skipped ones."""
    prev = F.lag("fragment_id").over(Window.partitionBy("chapter_id").orderBy("fragment_id"))
    gaps = used.withColumn("prev", prev).where("fragment_id > prev + 1").select("chapter_id", F.col("fragment_id").alias("before"), F.explode(F.sequence(F.col("prev") + 1, F.col("fragment_id") - 1)).alias("fragment_id"))
    found = gaps.join(fragments.select("chapter_id", "fragment_id", "synopsis"), ["chapter_id", "fragment_id"]).where("synopsis <> ''")
    parts = F.array_sort(F.collect_list(F.struct("fragment_id", "synopsis")))
    return found.groupBy("chapter_id", F.col("before").alias("fragment_id")).agg(F.array_join(F.transform(parts, lambda p: p["synopsis"]), " ").alias("synopses"))


def marked_text(marked: DataFrame, gaps: DataFrame) -> DataFrame:
    """One text a chapter: fragments and the synopses of gaps, two line ends apart."""
    with_gaps = marked.join(gaps, ["chapter_id", "fragment_id"], "left").withColumn("t", F.concat_ws("\n\n", "synopses", "text"))
    parts = F.array_sort(F.collect_list(F.struct("fragment_id", "t")))
    return with_gaps.groupBy("chapter_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("text"))
