"""Tables of a workspace and the levels that vertices and edges carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed names. What has no chapter of its own carries that of the vertex it starts from, so that an append reads only its chapters.
TABLES = {
    "sentences": "chapter_id long, fragment_id int, sentence_index int, text string, token_count int",
    "fragments": "chapter_id long, fragment_id int, synopsis string, token_count int",
    "chunks": "id long, generation int, chapter_id long, fragment_id int, sentence_index int, label string, content string, retention string, importance string, tokens int, weight double",
    "chunk_sentences": "chunk_id long, chapter_id long, fragment_id int, sentence_index int",
    "knowledge_edges": "from_id long, to_id long, strength string, weight double, chapter_id long",
    "snakes": "id long, chapter_id long, group_id int, local_snake_id int, size int, first_label string, last_label string, tokens int, weight double",
    "snake_chunks": "snake_id long, chunk_id long, position int, chapter_id long",
    "snake_edges": "from_snake_id long, to_snake_id long, weight double, chapter_id long",
    "fragment_groups": "chapter_id long, group_id int, fragment_id int",
}
#: Columns that identify a row.
KEYS = {
    "sentences": ["chapter_id", "fragment_id", "sentence_index"],
    "fragments": ["chapter_id", "fragment_id"],
    "chunks": ["id"],
    "chunk_sentences": ["chunk_id", "chapter_id", "fragment_id", "sentence_index"],
    "knowledge_edges": ["from_id", "to_id"],
    "snakes": ["id"],
    "snake_chunks": ["snake_id", "chunk_id"],
    "snake_edges": ["from_snake_id", "to_snake_id"],
    "fragment_groups": ["chapter_id", "group_id", "fragment_id"],
}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[table])


# What the levels are worth.
RETENTION = {"verbatim": 27, "detailed": 9, "focused": 3, "relevant": 1}
IMPORTANCE = {"critical": 9, "important": 3, "helpful": 1}
STRENGTH = {"critical": 9, "important": 3, "helpful": 1}


def level_value(col: str | Column, levels: dict[str, int], strict: bool = False) -> Column:
    """A level's number; null stays null, an unknown word fails if strict and is null otherwise."""
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for word, n in levels.items():
        out = F.when(c == word, n) if out is None else out.when(c == word, n)
    return out.when(c.isNotNull(), F.raise_error(F.concat(F.lit("unknown level: "), c)).cast("int")) if strict else out


def level_name(col: str | Column, levels: dict[str, int]) -> Column:
    """The word for a level's number; null for any other number."""
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for word, n in levels.items():
        out = F.when(c == n, word) if out is None else out.when(c == n, word)
    return out
