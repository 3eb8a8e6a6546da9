"""Extraction of chunks and links from fragments, chapter by chapter: each fragment sees what the memory recalls.

A chapter is sequential, chapters run in parallel. The extractor is a function (fragment text, sentences, memory) ->
payload with chunks and links; the default is deterministic. Payloads have the fields that models are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.memory import CAPACITY, recalled

Extractor = Callable[[str, list[str], list[dict]], dict]
#: (fragment text, sentences, memory, the first pass's chunks) -> payload with chunks, links and importance_annotations.
SecondPass = Callable[[str, list[str], list[dict], list[dict]], dict]
_FIELDS = ("source_sentences", "source_sences", "source_sentances")


def stub_extractor(text: str, sentences: list[str], memory: list[dict]) -> dict:
    """Every third sentence is a chunk, linked to the one before; the first also to the last remembered chunk."""
    picked = sentences[::3]
    chunks = [{"temp_id": f"c{k}", "label": s[:12], "content": s, "source_sentences": [s], "retention": ("verbatim", "detailed", "focused", "relevant")[len(s) % 4]} for k, s in enumerate(picked)]
    links = [{"from": f"c{k}", "to": f"c{k - 1}", "strength": ("critical", "important", "helpful")[k % 3]} for k in range(1, len(picked))]
    if memory and picked:
        links.append({"from": memory[-1]["id"], "to": "c0", "strength": "important"})
    return {"synopsis": text[:40], "chunks": chunks, "links": links}


def stub_second_pass(text: str, sentences: list[str], memory: list[dict], chunks: list[dict]) -> dict:
    """Rates each chunk of the first pass by its length; the last sentence is a chunk, linked to all of them."""
    words = ("critical", "important", "helpful")
    rated = [{"chunk_id": c["id"], "importance": words[len(c["content"]) % 3]} for c in chunks]
    last = {"temp_id": "z", "label": sentences[-1][:12], "content": sentences[-1], "source_sentences": [sentences[-1]], "importance": "critical"}
    links = [{"from": "z", "to": c["id"], "strength": "helpful"} for c in chunks]
    return {"importance_annotations": rated, "chunks": [last], "links": links}


class ChapterMemory:
    """What one chapter has so far: chunks, edges, generation; ids count from first_id."""

    def __init__(self, first_id: int = 0, capacity: int = CAPACITY):
        self.next_id, self.capacity, self.generation = first_id, capacity, 0
        self.chunks: list[dict] = []
        self.edges: dict[tuple[int, int], str | None] = {}  # in the order of insertion, in which the memory's wave follows them
        self.extra: list[dict] = []
        self.fresh: list[dict] = []

    def add(self, payload: dict, sentences: list[tuple[int, str]], fragment: int) -> tuple[list[dict], list[tuple[int, int, str | None]]]:
        """New chunks and edges of a fragment with one pass."""
        added = self.take(payload, sentences, fragment)
        self.close()
        return added

    def take(self, payload: dict, sentences: list[tuple[int, str]], fragment: int) -> tuple[list[dict], list[tuple[int, int, str | None]]]:
        """New chunks and edges of a pass over a fragment. A link leads from the larger id to the smaller; one with an end
        that is neither a new name nor a visible id (recalled, or of this fragment) is dropped, a repeated one keeps its
        first strength."""
        place = {s: i for i, s in sentences}
        names, new = {}, []
        for c in payload.get("chunks", []):
            quoted = next((c[f] for f in _FIELDS if c.get(f)), [])
            at = [place[q] for q in quoted if q in place] or [sentences[0][0] if sentences else 0]
            chunk = {"id": self.next_id, "generation": self.generation, "fragment_id": fragment, "sentence_index": at[0], "label": c["label"], "content": c["content"], "retention": c.get("retention"), "importance": c.get("importance")}
            names[c.get("temp_id")] = self.next_id
            self.next_id += 1
            new.append(chunk)
        self.fresh += new
        visible = {c["id"] for c in [*self.extra, *self.fresh]}
        edges = []
        for link in payload.get("links", []):
            a, b = (names.get(e) if isinstance(e, str) else e if e in visible else None for e in (link.get("from"), link.get("to")))
            if a is None or b is None:
                continue
            key = (max(a, b), min(a, b))
            if key not in self.edges:
                self.edges[key] = link.get("strength")
                edges.append((*key, link.get("strength")))
        return new, edges

    def rate(self, annotations: list[dict]) -> None:
        """Importance of this fragment's chunks; of several notes on a chunk the last holds, others are left out."""
        by_id = {c["id"]: c for c in self.fresh}
        for note in annotations or []:
            if (chunk := by_id.get(note.get("chunk_id"))) is not None:
                chunk["importance"] = note.get("importance")

    def close(self) -> None:
        """End the fragment: choose what the next one sees."""
        self.chunks += self.fresh
        found = recalled([(c["id"], c["generation"]) for c in self.chunks], [c["id"] for c in self.fresh], list(self.edges), self.capacity)
        by_id = {c["id"]: c for c in self.chunks}
        self.extra = [by_id[i] for i, _ in found]
        self.fresh, self.generation = [], self.generation + 1


#: ord: the place of an edge among its chapter's, in order of insertion.
OUT = "chapter_id long, kind string, id long, other_id long, generation int, fragment_id int, sentence_index int, label string, content string, retention string, importance string, strength string, ord int"


def fragment_rows(memory: ChapterMemory, chapter: int, fragment: int, listed: list[tuple[int, str]], extractor: Extractor, second_pass: SecondPass | None) -> list[tuple]:
    """Rows of kind chunk, edge, synopsis and failed of the chapter's next fragment (its sentences with their indexes); the memory moves on."""
    text, texts = "".join(t for _, t in listed), [t for _, t in listed]
    chunks, edges, out = [], [], []
    try:
        payload = extractor(text, texts, memory.extra)
        chunks, edges = memory.take(payload, listed, fragment)
        more = second_pass(text, texts, memory.extra, chunks) if second_pass is not None else {}
        if more.get("chunks"):
            memory.rate(more.get("importance_annotations"))
            late_chunks, late_edges = memory.take(more, listed, fragment)
            chunks, edges = chunks + late_chunks, edges + late_edges
    except (ValueError, KeyError, TypeError, AttributeError) as failure:  # what payloads of another shape lead to
        out.append((chapter, "failed", None, None, None, fragment, None, None, f"{type(failure).__name__}: {failure}", None, None, None, None))
        if not chunks:
            return out
    memory.close()
    if synopsis := payload.get("fragment_summary") or payload.get("synopsis"):
        out.append((chapter, "synopsis", None, None, None, fragment, None, None, synopsis, None, None, None, None))
    out += [(chapter, "chunk", c["id"], None, c["generation"], c["fragment_id"], c["sentence_index"], c["label"], c["content"], c["retention"], c["importance"], None, None) for c in chunks]
    before = len(memory.edges) - len(edges)
    return out + [(chapter, "edge", a, b, None, fragment, None, None, None, None, None, s, before + k) for k, (a, b, s) in enumerate(edges)]


def framed(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
    return frame.astype({c: "Int64" for c in ("id", "other_id", "generation", "fragment_id", "sentence_index", "ord")})


#: Rows that are handed on together, about.
_AT_ONCE = 10_000
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in OUT.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for (_, kind), c in zip(fields, columns, strict=True)], names=[name for name, _ in fields])


def extract(sentences: DataFrame, extractor: Extractor = stub_extractor, ids_a_chapter: int = 1_000_000, second_pass: SecondPass | None = None) -> DataFrame:
    """Rows of kind chunk, edge, synopsis and failed of every chapter. sentences: chapter_id, fragment_id, sentence_index, text.

    A second pass sees the first one's chunks, rates them and adds chunks of its own; one without chunks changes nothing.
    A pass that fails adds a row of kind failed with the reason as content; what came before it stays, the next fragment
    goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for key, listed in zip(batch.column("chapter_id"), batch.column("sentences"), strict=True):
                chapter = int(key.as_py())
                memory = ChapterMemory(chapter * ids_a_chapter)
                for fragment, part in groupby(listed.as_py(), key=lambda s: s["fragment_id"]):
                    out += fragment_rows(memory, chapter, int(fragment), [(s["sentence_index"], s["text"]) for s in part], extractor, second_pass)
                if len(out) >= _AT_ONCE:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    listed = F.array_sort(F.collect_list(F.struct("fragment_id", "sentence_index", "text"))).alias("sentences")
    return sentences.where("fragment_id is not null").groupBy("chapter_id").agg(listed).mapInArrow(run, OUT)
