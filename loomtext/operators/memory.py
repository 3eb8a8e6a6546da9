"""Working memory: which older chunks a chapter's next fragment sees."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, DECAY = 7, 0.5


def decayed(score: str | Column, generation: str | Column, decay: float = DECAY) -> Column:
    """A score halved, or cut by another decay, for each generation."""
    return (F.col(score) if isinstance(score, str) else score) * F.pow(F.lit(decay), generation)


def spread(start: dict[int, float], out: dict[int, list[int]]) -> dict[int, float]:
    """Scores after one breadth-first wave: a vertex hands on, in equal parts, the score it has when its turn comes."""
    scores, queue, seen = dict(start), deque(start), set(start)
    while queue:
        v = queue.popleft()
        following = out.get(v, [])
        for w in following:
            scores[w] = scores.get(w, 0.0) + scores[v] / len(following)
            if w not in seen:
                seen.add(w)
                queue.append(w)
    return scores


def wave(latest: list[int], edges: list[tuple[int, int]], reflect: bool = True) -> dict[int, float]:
    """Wave from the latest chunks along the edges and, reflected, back against them."""
    ahead: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for u, v in edges:
        ahead.setdefault(u, []).append(v)
        back.setdefault(v, []).append(u)
    scores = spread({v: 1 / len(latest) for v in latest}, ahead)
    return spread(scores, back) if reflect else scores


def recalled(chunks: list[tuple[int, int]], latest: list[int], edges: list[tuple[int, int]], capacity: int = CAPACITY, decay: float = DECAY) -> list[tuple[int, float]]:
    """chunks: (id, generation) in order of age. The capacity chunks besides the latest with the highest score times
    decay to their generation; without latest ones the oldest."""
    if not latest:
        return [(i, 0.0) for i, _ in chunks[:capacity]]
    scores, new = wave(latest, edges), set(latest)
    rated = [(i, scores[i] * decay**g) for i, g in chunks if i in scores and i not in new]
    return sorted(rated, key=lambda x: -x[1])[:capacity]


def chapter_graphs(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """chapter_id, nodes (id, fragment_id, generation) by id, links (from_id, to_id) in the order the wave follows them: one row a chapter.

    Links are in the order of ord, if edges have it, else of ids; a chapter's are those that lead from its chunks.
    """
    of = chunks.select("chapter_id", "id").toDF("chapter_id", "from_id")
    order = ["ord", "from_id", "to_id"] if "ord" in edges.columns else ["from_id", "to_id"]
    links = edges.join(of, "from_id").groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("links"))
    nodes = chunks.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("id", "fragment_id", "generation"))).alias("nodes"))
    pair = lambda x: F.struct(x["from_id"].alias("from_id"), x["to_id"].alias("to_id"))
    return nodes.join(links, "chapter_id", "left").select("chapter_id", "nodes", F.transform("links", pair).alias("links"))


#: Chunks of the chapters whose results are handed on together, about.
_AT_ONCE = 50_000


def _of_chapters(find, names: list[str]):
    """find: (chapter, [(id, generation)], latest ids, [(from, to)]) -> rows; over batches of chapter_graphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for chapter, nodes, links in zip(*(batch.column(c) for c in ("chapter_id", "nodes", "links")), strict=True):
                nodes, links = nodes.as_py(), links.as_py() or []
                last = max((n["fragment_id"] for n in nodes), default=None)
                latest = [n["id"] for n in nodes if n["fragment_id"] == last]
                rows += find(chapter.as_py(), [(n["id"], n["generation"]) for n in nodes], latest, [(x["from_id"], x["to_id"]) for x in links])
                if len(rows) >= _AT_ONCE:
                    yield _batch(rows, names)
                    rows = []
        yield _batch(rows, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"score": pa.float64(), "rank": pa.int32()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names)


def recall(chunks: DataFrame, edges: DataFrame, capacity: int = CAPACITY, decay: float = DECAY) -> DataFrame:
    """chapter_id, id, score, rank: what each chapter recalls after its last fragment.

    chunks: chapter_id, id, fragment_id, generation; edges: from_id, to_id and, if they have it, ord, the order of insertion
    in which the wave follows them (else by ids). A chapter is one row: its graph is bounded by the chapter's length.
    """

    def find(chapter: int, nodes: list[tuple], latest: list[int], links: list[tuple]) -> list[tuple]:
        return [(chapter, i, s, r) for r, (i, s) in enumerate(recalled(nodes, latest, links, capacity, decay))]

    return chapter_graphs(chunks, edges).mapInArrow(_of_chapters(find, ["chapter_id", "id", "score", "rank"]), "chapter_id long, id long, score double, rank int")


def forward_scores(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """chapter_id, id, score of the forward wave from each chapter's last fragment."""

    def find(chapter: int, nodes: list[tuple], latest: list[int], links: list[tuple]) -> list[tuple]:
        return [(chapter, i, s) for i, s in (wave(latest, links, reflect=False) if latest else {}).items()]

    return chapter_graphs(chunks, edges).mapInArrow(_of_chapters(find, ["chapter_id", "id", "score"]), "chapter_id long, id long, score double")
