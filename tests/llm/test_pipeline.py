"""The pipeline against its stages applied plainly, on a small table."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dice = random.Random(4)
    clean = " ".join(f"w{dice.randrange(500)}" for _ in range(120))
    extra = [(90001, "12 34 !!", "en", "s", 8), (90002, clean, "en", "s", 0), (90003, clean + " end", "en", "s", 0), (90004, clean, "en", "s", 0), (90005, "Ask x.y@z.example.com for the answer to this", "en", "s", 0)]
    folder = str(tmp_path / "sf")
    src.unionByName(spark.createDataFrame(extra, src.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs.count()
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert 90001 not in ids and before - len(ids) == 1
        if name == "near_dedup":
            assert 90002 in ids and not {90003, 90004} & ids
        if name == "pii":
            assert len(ids) == before
            assert docs.where("text like '%x.y@z.example.com%'").isEmpty() and docs.where("n_chars <> length(text)").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == ids
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(last)
