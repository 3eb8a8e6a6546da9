"""Chapters as streams: the same rows as in a batch however the fragments arrive, and state that grows by what is new."""

import json
import os

from loomtext.operators import extraction, memory
from loomtext.schemas import schema
from loomtext.sources.workspace import Workspace
from loomtext.streaming.chapters import append_stream, extract_stream

FRAGMENTS = "chapter_id long, fragment_id int, sentences array<string>"


def _written(spark, folder, batches):
    """A folder of one file a batch, in order of their names."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        file = folder / f"{k:03d}.json"
        file.write_text("\n".join(json.dumps({"chapter_id": c, "fragment_id": f, "sentences": s}) for c, f, s in rows))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # the source goes by their times
    return spark.readStream.schema(FRAGMENTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(folder))


def _run(out, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        return [json.loads(p.json) for p in q.recentProgress]
    finally:
        q.stop()


def test_stream_over_batches_equals_batch(spark, tmp_path):
    def fails_once(text, sentences, seen):
        if text.startswith("s12"):
            raise TypeError("odd payload")
        return extraction.stub_extractor(text, sentences, seen)

    rows = [(ch, f, [f"s{ch}{f}{i} word{'x' * i}." for i in range(5)]) for f in range(6) for ch in range(3)]
    batches = [rows[:4], rows[4:5], rows[5:11], rows[11:]]
    out = extract_stream(_written(spark, tmp_path / "in", batches), fails_once, second_pass=extraction.stub_second_pass)
    _run(out, "streamed_chapters")
    flat = spark.createDataFrame([(c, f, i, s) for c, f, ss in rows for i, s in enumerate(ss)], "chapter_id long, fragment_id int, sentence_index int, text string")
    batch = extraction.extract(flat, fails_once, second_pass=extraction.stub_second_pass)
    names = batch.columns
    assert sorted(map(repr, spark.table("streamed_chapters").select(*names).collect())) == sorted(map(repr, batch.collect()))
    assert {r.kind for r in batch.collect()} == {"chunk", "edge", "synopsis", "failed"}


def test_a_batch_writes_what_it_adds(spark, tmp_path):
    batches = [[(1, f, [f"s{f}{i} word." for i in range(6)])] for f in range(8)]
    progress = [p for p in _run(extract_stream(_written(spark, tmp_path / "in", batches)), "grown_chapter") if p["numInputRows"]]
    assert len(progress) == 8
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress]
    assert max(updated[2:]) <= updated[1] + memory.CAPACITY, updated
    assert spark.table("grown_chapter").where("kind = 'chunk'").count() == 16


def test_wave_follows_edges_in_order_of_insertion(spark):
    """Where a vertex is reached again after its turn, the order of edges shows in the scores."""
    edges = [(4, 2), (4, 3), (3, 2), (2, 1)]
    other = [edges[1], edges[0], *edges[2:]]
    assert memory.wave([4], edges, reflect=False) != memory.wave([4], other, reflect=False)
    chunks = spark.createDataFrame([(7, i, 0 if i < 4 else 1, 0) for i in range(1, 5)], "chapter_id long, id long, fragment_id int, generation int")
    for rows in (edges, other):
        frame = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(rows)], "from_id long, to_id long, ord int")
        got = {r.id: r.score for r in memory.forward_scores(chunks, frame).collect()}
        assert got == memory.wave([4], rows, reflect=False)


def test_appended_batches_may_come_twice(spark, tmp_path):
    rows = [(i, 0, i // 3, 0, i, "l", "t", None, None, 1, 0.0) for i in range(9)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema("chunks")).write.parquet(folder)
    work = Workspace(spark, str(tmp_path / "work"))
    for k in range(2):  # a new checkpoint: all rows come again
        append_stream(spark.readStream.schema(schema("chunks")).parquet(folder), work, "chunks", str(tmp_path / f"c{k}")).awaitTermination()
    assert [r.id for r in work.read("chunks").orderBy("id").collect()] == list(range(9))
