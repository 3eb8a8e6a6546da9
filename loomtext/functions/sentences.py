"""Sentences, token counts and token-bounded fragments of chapters, without a shuffle: a chapter is a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = r"([^.!?\n]+[.!?]*)"
FRAGMENT_TOKENS = 800


def proxy_tokens(text: Column) -> Column:
    """Stand-in token count: a quarter of the characters, rounded up. Any Column function can take its place."""
    return F.ceil(F.length(text) / 4).cast("int")


def split_sentences(text: Column, pattern: str = SENTENCE) -> Column:
    """Array of the trimmed, non-blank sentences of a text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def fragment_numbers(counts: Column, budget: int) -> Column:
    """Fragment of each sentence: one is closed when it is not empty and the next sentence would exceed the budget."""
    empty = F.struct(F.lit(0).alias("fragment"), F.lit(0).cast("long").alias("run"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["run"] > 0) & (acc["run"] + n > budget)
        fragment = acc["fragment"] + F.when(full, 1).otherwise(0)
        run = F.when(full, n.cast("long")).otherwise(acc["run"] + n)
        return F.struct(fragment.alias("fragment"), run.alias("run"), F.concat(acc["out"], F.array(fragment)).alias("out"))

    return F.aggregate(counts, empty, step, lambda acc: acc["out"])


def sentences(chapters: DataFrame, id_col: str = "chapter_id", text_col: str = "text", budget: int = FRAGMENT_TOKENS, tokens: Callable[[Column], Column] = proxy_tokens, pattern: str = SENTENCE) -> DataFrame:
    """chapter_id, fragment_id, sentence_index, text, token_count; the index counts through the chapter from 0."""
    rows = chapters.select(F.col(id_col).cast("long").alias("chapter_id"), split_sentences(F.col(text_col), pattern).alias("s"))
    counted = rows.withColumn("n", F.transform("s", tokens))
    placed = counted.withColumn("f", fragment_numbers(F.col("n"), budget))
    each = placed.select("chapter_id", F.posexplode(F.arrays_zip("s", "n", "f")).alias("sentence_index", "x"))
    return each.select("chapter_id", F.col("x.f").alias("fragment_id"), "sentence_index", F.col("x.s").alias("text"), F.col("x.n").alias("token_count"))


def fragment_totals(rows: DataFrame) -> DataFrame:
    """Sentences and tokens of each fragment."""
    return rows.groupBy("chapter_id", "fragment_id").agg(F.count("*").alias("n_sentences"), F.sum("token_count").cast("long").alias("token_count"))


def joined_text(rows: DataFrame, keys: list[str], separator: str = "") -> DataFrame:
    """The sentences of each key in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct("fragment_id", "sentence_index", "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"))
