"""Streams: fragments that arrive chapter by chapter, with a memory per chapter, and appended workspaces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtext.operators.extraction import OUT, ChapterMemory, Extractor, SecondPass, fragment_rows, framed, stub_extractor
from loomtext.sources.workspace import Workspace

_CHUNK = "id long, generation int, fragment_id int, sentence_index int, label string, content string, retention string, importance string"
_NAMES = [x.split()[0] for x in _CHUNK.split(", ")]


class ChapterProcessor(StatefulProcessor):
    """A chapter's memory in keyed state: chunks as a list and edges as a map that only grow by what a fragment adds, the recalled ids
    and the counters as small values that are replaced."""

    def __init__(self, extractor: Extractor, second_pass: SecondPass | None, ids_a_chapter: int):
        self.extractor, self.second_pass, self.ids_a_chapter = extractor, second_pass, ids_a_chapter

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "next_id long, generation int")
        self.chunks = handle.getListState("chunks", _CHUNK)
        self.edges = handle.getMapState("edges", "from_id long, to_id long", "strength string, ord int")
        self.recalled = handle.getListState("recalled", "id long")

    def _loaded(self, chapter: int) -> ChapterMemory:
        memory = ChapterMemory(chapter * self.ids_a_chapter)
        if self.counters.exists():
            memory.next_id, memory.generation = self.counters.get()
            memory.chunks = [dict(zip(_NAMES, row, strict=True)) for row in self.chunks.get()]
            by_id = {c["id"]: c for c in memory.chunks}
            memory.extra = [by_id[i] for (i,) in self.recalled.get()] if self.recalled.exists() else []
            memory.edges = {tuple(key): value[0] for key, value in sorted(self.edges.iterator(), key=lambda e: e[1][1])}
        return memory

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chapter = int(key[0])
        memory = self._loaded(chapter)
        chunks, edges, out = len(memory.chunks), len(memory.edges), []
        for row in pd.concat(list(rows)).sort_values("fragment_id").itertuples():
            out += fragment_rows(memory, chapter, int(row.fragment_id), list(enumerate(row.sentences)), self.extractor, self.second_pass)
        self.counters.update((memory.next_id, memory.generation))
        if len(memory.chunks) > chunks:
            self.chunks.appendList([tuple(c[n] for n in _NAMES) for c in memory.chunks[chunks:]])
        for ord_, (ends, strength) in enumerate(memory.edges.items()):
            if ord_ >= edges:
                self.edges.updateValue(ends, (strength, ord_))
        if memory.extra:
            self.recalled.put([(c["id"],) for c in memory.extra])
        elif self.recalled.exists():
            self.recalled.clear()
        yield framed(out)

    def close(self) -> None:
        pass


def extract_stream(fragments: DataFrame, extractor: Extractor = stub_extractor, ids_a_chapter: int = 1_000_000, second_pass: SecondPass | None = None) -> DataFrame:
    """Rows of kind chunk, edge and failed, as extract gives them, of a stream of fragments (chapter_id, fragment_id, sentences array<string>).

    A chapter's fragments must come in order; a batch may hold several of them. What a batch writes to state is what its
    fragments add. A sentence's index counts within its fragment. The session's state store must be RocksDB, which is set here
    where it is not (spark.sql.streaming.stateStore.providerClass).
    """
    setting, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if "RocksDB" not in fragments.sparkSession.conf.get(setting):
        fragments.sparkSession.conf.set(setting, rocks)
    processor = ChapterProcessor(extractor, second_pass, ids_a_chapter)
    return fragments.groupBy("chapter_id").transformWithStateInPandas(processor, OUT, "append", "none")


def append_stream(rows: DataFrame, work: Workspace, table: str, checkpoint: str):
    """Append a stream to a workspace table; rows whose key is there already are left out, so a batch may come twice."""
    return rows.writeStream.foreachBatch(lambda batch, _: work.append(table, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
