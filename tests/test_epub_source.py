"""Books written and read by the data source."""

import pytest
from pyspark.sql import functions as F

from loomtext.sources.epub import epub_bytes, spine_documents
from loomtext.sources.epub_source import file_name, read_books, write_books

COLUMNS = "book string, chapter_id long, title string, text string"


def test_round_trip(spark, tmp_path):
    at = str(tmp_path / "books")
    rows = [(f"Book/{b} é", c, f"Chapter {c} & more", f"First <line> {b}.\n\n Second {c}. ") for b in range(5) for c in (3, 1, 2)]
    rows += [("Book/0 é", 9, None, None), ("x" * 400, 0, "", ""), (".hidden", 1, "t", "u")]
    write_books(spark.createDataFrame(rows, COLUMNS).withColumn("path", F.lit("clash")), at)
    found = read_books(spark, at)
    want = {}
    for b in {r[0] for r in rows}:
        chapters = sorted((r for r in rows if r[0] == b), key=lambda r: r[1])
        for k, (name, body) in enumerate(spine_documents(epub_bytes([(r[2] or "", r[3] or "") for r in chapters], b))):
            want[file_name(b), k] = (name, body)
    assert {(r.path.rsplit("/", 1)[1], r.chapter_id): (r.title, r.html) for r in found.collect()} == want
    assert not [p for p in (tmp_path / "books").iterdir() if p.is_dir()]  # nothing half written stays
    one = str(tmp_path / "books" / file_name("Book/1 é"))
    assert sorted(r.chapter_id for r in read_books(spark, one).collect()) == [0, 1, 2]


def test_a_book_in_several_tasks(spark, tmp_path):
    at = str(tmp_path / "big")
    write_books(spark.createDataFrame([("B", c, f"t{c}", f"text {c}") for c in range(40)], COLUMNS), at)
    found = read_books(spark, at, bytesPerTask="1000")
    assert found.rdd.getNumPartitions() > 4
    assert sorted((r.chapter_id, r.title) for r in found.collect()) == [(c, f"chapter_{c}.xhtml") for c in range(40)]


def test_modes(spark, tmp_path):
    at = str(tmp_path / "modes")
    for book, mode in (("A", "append"), ("B", "append"), ("A", "append")):
        write_books(spark.createDataFrame([(book, 1, "t", "x")], COLUMNS), at, mode)
    assert read_books(spark, at).count() == 2
    write_books(spark.createDataFrame([("C", 1, "t", "x")], COLUMNS), at, "overwrite")
    assert [r.path.rsplit("/", 1)[1] for r in read_books(spark, at).collect()] == ["C.epub"]
    write_books(spark.createDataFrame([], COLUMNS), str(tmp_path / "none"))
    assert read_books(spark, at).where("chapter_id > 5").count() == 0


def test_refusals_leave_nothing(spark, tmp_path):
    at = str(tmp_path / "refused")
    with pytest.raises(Exception, match="without a book"):
        write_books(spark.createDataFrame([(None, 1, "t", "x"), ("A", 1, "t", "x")], COLUMNS), at)
    scattered = spark.createDataFrame([("A", k, "t", "x") for k in range(8)], COLUMNS).repartition(4)
    with pytest.raises(Exception, match="several tasks"):
        scattered.write.format("epub").mode("append").save(at)
    assert not (tmp_path / "refused").exists() or not list((tmp_path / "refused").iterdir())
    with pytest.raises(Exception, match="columns missing"):
        spark.range(3).write.format("epub").mode("append").save(at)
    (tmp_path / "bad.epub").write_bytes(b"no book")
    with pytest.raises(Exception, match="is no EPUB"):
        read_books(spark, str(tmp_path / "bad.epub")).collect()
    with pytest.raises(Exception, match="nowhere"):
        read_books(spark, str(tmp_path / "nowhere")).collect()


def test_small_books_share_tasks(spark, tmp_path):
    at = str(tmp_path / "many")
    write_books(spark.createDataFrame([(f"B{b}", c, f"t{c}", f"text {b} {c}") for b in range(300) for c in range(2)], COLUMNS), at)
    found = read_books(spark, at)
    assert found.rdd.getNumPartitions() < 30  # not one for each book
    assert sorted((r.path.rsplit("/", 1)[1], r.chapter_id) for r in found.collect()) == sorted((f"B{b}.epub", c) for b in range(300) for c in range(2))
    assert read_books(spark, at, bytesPerTask="1000").where("chapter_id = 1").count() == 300
