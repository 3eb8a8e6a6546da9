"""Fragment groups: contiguous runs of a chapter's fragments within a token budget, cut where the incisions are weakest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_TOKENS = 9600


def cut_places(tokens: list[int], start: list[int], end: list[int], budget: int) -> list[int]:
    """Group number of each fragment.

    A group takes fragments up to the budget; if more follow, it is cut at the boundary in its second half with the
    lowest end and start level, the latest on ties. A fragment over the budget is a group of its own.
    """
    out, first, group = [], 0, 0
    while first < len(tokens):
        last, total = first, tokens[first]
        while last + 1 < len(tokens) and total + tokens[last + 1] <= budget:
            last += 1
            total += tokens[last]
        if last + 1 < len(tokens):
            options = range(first + (last - first) // 2, last + 1)
            last = min(options, key=lambda i: (end[i] + start[i + 1], -i))
        out += [group] * (last + 1 - first)
        first, group = last + 1, group + 1
    return out


def fragment_groups(levels: DataFrame, totals: DataFrame, budget: int = GROUP_TOKENS) -> DataFrame:
    """chapter_id, group_id, fragment_id. levels: start_level, end_level of fragments; totals: token_count. A chapter is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chapter, fragment, group = [], [], []
            for key, listed in zip(batch.column("chapter_id"), batch.column("fragments"), strict=True):
                f = listed.as_py()
                chapter += [key.as_py()] * len(f)
                fragment += [x["fragment_id"] for x in f]
                group += cut_places(*([x[k] for x in f] for k in ("token_count", "start_level", "end_level")), budget)
            yield pa.RecordBatch.from_arrays([pa.array(chapter, pa.int64()), pa.array(group, pa.int32()), pa.array(fragment, pa.int32())], names=["chapter_id", "group_id", "fragment_id"])

    rows = levels.join(totals, ["chapter_id", "fragment_id"])
    listed = F.array_sort(F.collect_list(F.struct("fragment_id", "token_count", "start_level", "end_level"))).alias("fragments")
    return rows.groupBy("chapter_id").agg(listed).mapInArrow(run, "chapter_id long, group_id int, fragment_id int")
