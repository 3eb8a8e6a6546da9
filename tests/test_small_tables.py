"""Queries against their SQL on tables made for what the given ones don't hold."""

import duckdb
import pytest

import __spark_entry__ as entry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def agrees(spark, tmp_path, name, texts):
    rows = [(k, t, "en", "made", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == rows
    return rows


def sentences_of(*tokens):
    return " ".join(f"{k} ".ljust(4 * n - 1, "x") + "." for k, n in enumerate(tokens))


@pytest.mark.parametrize("tokens", [[33] * 6 + [16] * 12 + [20] * 8, [13] * 15 + [30] * 13, [20] * 30, [60] * 3 + [10] * 3])
def test_a_number_in_an_answer_is_known_to_later_fragments(spark, tmp_path, tokens):
    """Chunk 5 is the last of its answer's, the first, one between, or never made."""
    agrees(spark, tmp_path, "answer_edges", [sentences_of(*tokens), "Another one. And more of it.", None])
