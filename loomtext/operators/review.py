"""Review of compressed versions: extraction from answers, scores, ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.schemas import IMPORTANCE, RETENTION

# What an issue's severity is worth.
SEVERITY = {"critical": 9, "major": 3, "minor": 1}
# The heading of the section that holds the compressed text, in two languages, and what ends it.
HEADINGS = ["Compressed Text", "压缩文本"]
SECTION_ENDS = ["\n---", "**CRITICAL**"]


def severity_value(col: str = "severity") -> Column:
    word = F.lower(F.coalesce(F.col(col), F.lit("minor")))
    return F.when(word == "critical", 9).when(word == "major", 3).otherwise(1)


def scores(issues: DataFrame, *keys: str) -> DataFrame:
    """Sum of severity times the clue's weight."""
    return issues.groupBy(*keys).agg(F.sum(severity_value() * F.col("weight")).alias("score"))


def ranked_issues(issues: DataFrame, keys: list[str], top: int = 9) -> DataFrame:
    """The top issues by severity, weight and index, with the number of hidden ones."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(severity_value().desc(), F.desc("weight"), "issue_index"))
    hidden = F.greatest(F.count("*").over(Window.partitionBy(*keys)) - top, F.lit(0))
    return issues.withColumn("rank", rank).withColumn("hidden", hidden).where(F.col("rank") <= top)


def best_version(versions: DataFrame, *keys: str) -> DataFrame:
    """The version with the lowest score, the first iteration on ties."""
    return versions.groupBy(*keys).agg(F.min(F.struct("score", "iteration")).alias("m")).select(*keys, "m.iteration", "m.score")


def tier(retention: str = "retention", importance: str = "importance") -> Column:
    """high, medium or low, whichever of the two levels says more; null without levels."""
    r = F.when(F.col(retention).isin("verbatim", "detailed"), 3).when(F.col(retention) == "focused", 2).when(F.col(retention) == "relevant", 1)
    i = F.when(F.col(importance) == "critical", 3).when(F.col(importance) == "important", 2).when(F.col(importance) == "helpful", 1)
    best = F.greatest(r, i)
    return F.when(best == 3, "high").when(best == 2, "medium").when(best == 1, "low")


assert set(RETENTION) == {"verbatim", "detailed", "focused", "relevant"} and set(IMPORTANCE) == {"critical", "important", "helpful"}


def _around_heading(col: str) -> Column:
    """What stands before and after the first second-level heading with one of HEADINGS; one part without it."""
    words = "|".join(h.replace(" ", r"\s+") for h in HEADINGS)
    return F.split(F.col(col), rf"(?i)##\s*(?:{words})", 2)


def compressed_text(col: str) -> Column:
    """The section under the heading, up to what ends it; without one the whole answer. Brackets around it are dropped."""
    parts, ends = _around_heading(col), "|".join(re.escape(e) for e in SECTION_ENDS)
    body = _strip(F.split(parts[1], ends, 2)[0])
    inner = F.when(body.startswith("【"), F.substring(body, 2, 1 << 30)).otherwise(body)
    inner = F.when(inner.endswith("】"), F.left(inner, F.length(inner) - 1)).otherwise(inner)
    return F.when(F.size(parts) > 1, _strip(inner)).otherwise(_strip(F.col(col)))


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def thinking_text(col: str) -> Column:
    """What stands before the heading; empty without one."""
    parts = _around_heading(col)
    return F.when(F.size(parts) > 1, _strip(parts[0])).otherwise("")


def feedback_text(issues: DataFrame, keys: list[str], top: int = 9) -> DataFrame:
    """One text for each key from its ranked issues: a line for each of the top ones, then how many are left out.

    issues: keys, severity, weight, issue_index, problem, suggestion. Keys without issues have no row.
    """
    line = F.concat(F.lit("- ["), F.lower(F.coalesce("severity", F.lit("minor"))), F.lit("] "), F.coalesce("problem", F.lit("")), F.when(F.length("suggestion") > 0, F.concat(F.lit(" -> "), "suggestion")).otherwise(""))
    ranked = ranked_issues(issues, keys, top).select(*keys, "rank", "hidden", line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    rest = F.when(F.max("hidden") > 0, F.concat(F.lit("\n("), F.max("hidden").cast("string"), F.lit(" more)"))).otherwise("")
    return ranked.groupBy(*keys).agg(F.concat(lines, rest).alias("feedback"))


def without_chunk_tags(col: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(col), r'<chunk(?:\s+retention="[^"]*")?>', ""), "</chunk>", "")


def fenced_json(col: str) -> Column:
    """The inside of a Markdown fence, line breaks around it or not, or the whole, stripped."""
    inner = F.regexp_extract(F.col(col), r"(?s)```(?:json)?\s*(.*?)```", 1)
    return _strip(F.when(inner != "", inner).otherwise(F.col(col)))


def target_lengths(of: str | Column, ratio: float = 0.2) -> list[Column]:
    """Target length of a compression, and the bounds that are accepted. of: the name of a text, or its length."""
    target = F.floor((F.length(of) if isinstance(of, str) else of) * ratio)
    return [target.alias("target"), F.floor(target * 0.85).alias("at_least"), F.floor(target * 1.15).alias("at_most")]


def retryable(col: str) -> Column:
    return F.lower(F.col(col)).rlike("connection|timeout|network|rate limit")


def retention_ratios(members: DataFrame, chunks: DataFrame, *keys: str) -> DataFrame:
    """Share in percent of a chain's chunks that have a retention level."""
    rows = members.join(chunks.select(F.col("id").alias("chunk_id"), "retention"), "chunk_id")
    return rows.groupBy(*keys).agg((F.avg(F.col("retention").isNotNull().cast("int")) * 100).alias("ratio"))


def ratio_histogram(ratios: DataFrame) -> DataFrame:
    """Counts of chains by ratio for each (chapter, group), each chapter and all."""
    r = F.col("ratio")
    bins = {"none": r == 0, "low": (r > 0) & (r < 30), "middle": (r >= 30) & (r < 70), "high": (r >= 70) & (r < 100), "all_kept": r == 100}
    counts = [F.sum(F.when(test, 1).otherwise(0)).alias(name) for name, test in bins.items()]
    extreme = F.sum(F.when(bins["none"] | bins["all_kept"], 1).otherwise(0)) / F.count("*")
    out = ratios.rollup("chapter_id", "group_id").agg(F.count("*").alias("n"), *counts, extreme.alias("extremes"))
    return out.withColumn("verdict", F.when(F.col("extremes") >= 0.7, "strong").when(F.col("extremes") >= 0.5, "weak").otherwise("none"))


def hierarchy_lines(members: DataFrame, chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """A report line per chain, heaviest first, with previews of its chunks. members: keys chapter_id, group_id, snake_id."""
    rows = members.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")
    parts = F.array_sort(F.collect_list(F.struct("position", F.substring("content", 1, 60).alias("p"))))
    listed = rows.groupBy("chapter_id", "group_id", "snake_id").agg(F.array_join(F.transform(parts, lambda p: p["p"]), " | ").alias("previews"))
    line = F.row_number().over(Window.partitionBy("chapter_id", "group_id").orderBy(F.desc("weight"), "snake_id"))
    return listed.join(totals.select("snake_id", F.round("weight", 6).alias("weight"), F.concat("first_label", F.lit(" → "), "last_label").alias("label")), "snake_id").withColumn("line", line)
