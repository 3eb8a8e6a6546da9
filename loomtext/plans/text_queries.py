"""Registered queries of the text, matching, review and request operators, with their SQL."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from loomtext import flow
from loomtext.cluster import cut, shared_dir
from loomtext.functions import json_text
from loomtext.functions.sentences import fragment_totals
from loomtext.operators import compression, extraction, grouping, matching, requests, review, reviewing, weights
from loomtext.plans import derived as d
from loomtext.plans.derived import BASE
from loomtext.schemas import RETENTION, level_name, level_value
from loomtext.sources import epub_source, html, workspace

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (BASE if base else "") + sql
        return f

    return register


def norm_sql(text: str) -> str:
    """DuckDB's normal form of an expression. Its patterns look at no neighbours, so what stands beside a blank is taken and put back."""
    latin = matching.LATIN_CLASS
    held = "\ue000\ue001\ue002\ue003"
    x = f"trim(regexp_replace({text}, '[{matching.SPACE_CLASS}]+', ' ', 'g'))"
    x = f"regexp_replace({x}, ' ([^{latin} ])', '\\1', 'g')"
    for _ in range(2):  # a letter between two hyphens is taken by the first
        x = f"regexp_replace({x}, '([{latin}])[‐‑‒–—―] ([{latin}])', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '([^{latin}]) ', '\\1', 'g')"
    x = f"translate(regexp_replace(translate({x}, '“”‘’', '{held}'), '[\\p{{P}}`^|~]', '', 'g'), '{held}', '“”‘’')"
    return f"list_aggregate(list_transform(string_split({x}, ''), lambda c: CASE WHEN regexp_full_match(c, '[{latin}]') THEN strip_accents(lower(c)) ELSE c END), 'string_agg', '')"


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS norm FROM documents")
def normalize_text(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", F.md5(matching.normalize_text("text").cast("binary")).alias("norm"))


@query()
def html_text(spark, sf_dir):
    return d.table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.html_pieces("html")).alias("place", "text"))


@query("SELECT page_id, CASE WHEN t <> '' THEN t WHEN h <> '' THEN h END AS title FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS t, trim(regexp_extract(html, '(?is)<h[12][^>]*>([^<]*)<', 1)) AS h FROM pages)")
def chapter_title(spark, sf_dir):
    return d.table(spark, sf_dir, "pages").select("page_id", html.title("html").alias("title"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def xhtml_escape(spark, sf_dir):
    return d.table(spark, sf_dir, "pages").select("page_id", html.escaped("html").alias("escaped"))


@query("""SELECT doc_id, unnest(range(len(p)))::INT AS place, unnest(p) AS paragraph FROM (SELECT doc_id, list_filter(list_transform(string_split("text", chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)""")
def paragraphs(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(html.paragraphs("text")).alias("place", "paragraph"))


def _answer(props):
    return F.concat(F.lit("Here it is: "), props, F.lit(" and that is all"))


@query("SELECT event_id, props AS object, props LIKE '{%\"k\"%' AS complete, (props::JSON->>'k')::INT AS k FROM events")
def json_extract(spark, sf_dir):
    rows = d.table(spark, sf_dir, "events").select("event_id", _answer(F.col("props")).alias("answer")).withColumn("object", json_text.object_text("answer"))
    return rows.select("event_id", "object", json_text.has_keys(F.col("object"), "k").alias("complete"), F.get_json_object("object", "$.k").cast("int").alias("k"))


@query("""SELECT event_id, event_id % 2 = 0 AS ordered FROM events""")
def json_key_order(spark, sf_dir):
    a, b = F.lit('"chunks": []'), F.lit('"links": []')
    body = F.when(F.col("event_id") % 2 == 0, F.concat_ws(", ", a, b)).otherwise(F.concat_ws(", ", b, a))
    rows = d.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), body, F.lit("}")).alias("t"))
    return rows.select("event_id", json_text.keys_in_order("t", "chunks", "links").alias("ordered"))


@query("SELECT event_id, '{\"k\": [' || event_id || ', 2]}' AS repaired FROM events")
def json_repaired(spark, sf_dir):
    broken = F.concat(F.lit("```json\n{'k': ["), F.col("event_id").cast("string"), F.lit(", 2,],\n"))
    return d.table(spark, sf_dir, "events").select("event_id", json_text.repair_json(broken).alias("repaired"))


@query(r"""WITH c AS (SELECT 'Documents ' || doc_id // 50 AS book, doc_id, 'Document ' || doc_id AS title, coalesce("text", '') AS body FROM documents),
p AS (SELECT book, doc_id, title, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM c),
h AS (SELECT book, doc_id, title, array_to_string(list_transform(lines, lambda x: '<p>' || replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>'), '') AS paragraphs FROM p)
SELECT book, row_number() OVER (PARTITION BY book ORDER BY doc_id) - 1 AS chapter_id,
  sha256('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || title || '</title></head><body><h1>' || title || '</h1>' || coalesce(paragraphs, '') || '</body></html>') AS page_sha256
FROM h""")
def epub_books(spark, sf_dir):
    """Fifty documents a book, written as EPUB files and read again."""
    at = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    book = F.concat(F.lit("Documents "), F.expr("doc_id div 50").cast("string")).alias("book")
    epub_source.write_books(d.table(spark, sf_dir, "documents").select(book, F.col("doc_id").alias("chapter_id"), F.concat(F.lit("Document "), "doc_id").alias("title"), "text"), at)
    name = F.regexp_extract("path", r"([^/]+)\.epub$", 1).alias("book")
    return epub_source.read_books(spark, at).select(name, "chapter_id", F.sha2("html", 256).alias("page_sha256"))


@query("""SELECT conv_id, turn, "text" AS plain FROM conversations""")
def strip_tags(spark, sf_dir):
    tagged = F.concat(F.lit('<chunk retention="verbatim">'), F.substring("text", 1, 20), F.lit("</chunk>"), F.expr("substring(text, 21)"), F.lit("<chunk></chunk>"))
    return d.table(spark, sf_dir, "conversations").select("conv_id", "turn", tagged.alias("t")).select("conv_id", "turn", review.without_chunk_tags("t").alias("plain"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(CASE WHEN b LIKE '%】' THEN "left"(b, length(b) - 1) ELSE b END, '^\s+', ''), '\s+$', '') AS compressed, 'notes first' AS thinking
FROM (SELECT conv_id, turn, regexp_replace(string_split_regex("text" || '】' || chr(10) || '---', '\n---|\*\*CRITICAL\*\*')[1], '\s+$', '') AS b FROM conversations)""")
def section_extract(spark, sf_dir):
    full = F.concat(F.lit("notes first\n## Compressed Text\n\n【"), "text", F.lit("】\n---\nmore"))
    rows = d.table(spark, sf_dir, "conversations").select("conv_id", "turn", full.alias("t"))
    return rows.select("conv_id", "turn", review.compressed_text("t").alias("compressed"), review.thinking_text("t").alias("thinking"))


@query("""WITH i AS (SELECT conv_id, turn, CASE length("text") % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'odd' ELSE 'minor' END AS severity, CASE length("text") % 4 WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 1 END AS value, (turn % 5 + 1) / 8.0::DOUBLE AS weight FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY value DESC, weight DESC, turn) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM i)
SELECT conv_id, string_agg('- [' || severity || '] turn ' || turn || CASE WHEN turn % 2 = 0 THEN ' -> redo' ELSE '' END, chr(10) ORDER BY rank) || CASE WHEN any_value(n) > 3 THEN chr(10) || '(' || (any_value(n) - 3) || ' more)' ELSE '' END AS feedback
FROM r WHERE rank <= 3 GROUP BY 1""")
def feedback_text(spark, sf_dir):
    rows = _issues(spark, sf_dir).withColumn("problem", F.concat(F.lit("turn "), F.col("turn").cast("string"))).withColumn("suggestion", F.when(F.col("turn") % 2 == 0, "redo"))
    return review.feedback_text(rows, ["conv_id"], top=3)


@query("SELECT event_id, props AS body FROM events")
def fence_extract(spark, sf_dir):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\n"))).otherwise(F.concat(F.lit("  "), "props", F.lit("\n")))
    return d.table(spark, sf_dir, "events").select("event_id", fenced.alias("t")).select("event_id", review.fenced_json("t").alias("body"))


@query("""SELECT doc_id, floor(length("text") * 0.2::DOUBLE)::BIGINT AS target, floor(floor(length("text") * 0.2::DOUBLE) * 0.85::DOUBLE)::BIGINT AS at_least, floor(floor(length("text") * 0.2::DOUBLE) * 1.15::DOUBLE)::BIGINT AS at_most FROM documents""")
def target_length(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", *review.target_lengths("text"))


@query("SELECT event_id, event_type IN ('click', 'error') AS again FROM events")
def retry_predicate(spark, sf_dir):
    error = F.when(F.col("event_type") == "click", "Connection reset").when(F.col("event_type") == "error", "Rate limit hit").otherwise("bad request")
    return d.table(spark, sf_dir, "events").select("event_id", error.alias("e")).select("event_id", review.retryable("e").alias("again"))


@query("SELECT id, CASE retention WHEN 'verbatim' THEN 27 WHEN 'detailed' THEN 9 WHEN 'focused' THEN 3 WHEN 'relevant' THEN 1 END AS value, retention AS word FROM c", base=True)
def enum_parse(spark, sf_dir):
    rows = d.chunk_rows(spark, sf_dir).select("id", level_value("retention", RETENTION, strict=True).alias("value"))
    return rows.withColumn("word", level_name("value", RETENTION))


@query("""SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))), 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def fingerprint_distance(spark, sf_dir):
    e = d.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    met = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    squares = F.zip_with("x", "y", lambda a, b: (a - b) * (a - b))
    return met.select("vec_id", F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)), 6).alias("distance"))


_ISSUES = """WITH issues AS (SELECT conv_id, turn, turn AS issue_index, CASE length("text") % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'major' WHEN 2 THEN 'odd' END AS severity,
  CASE length("text") % 4 WHEN 0 THEN 9 WHEN 1 THEN 3 ELSE 1 END AS value, (turn % 5 + 1) / 8.0::DOUBLE AS weight FROM conversations)
"""


def _issues(spark, sf_dir):
    n = F.length("text") % 4
    return d.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("issue_index"), F.when(n == 0, "Critical").when(n == 1, "major").when(n == 2, "odd").alias("severity"), ((F.col("turn") % 5 + 1) / 8).alias("weight"))


@query(_ISSUES + "SELECT conv_id, sum(value * weight) AS score FROM issues GROUP BY 1")
def review_score(spark, sf_dir):
    return review.scores(_issues(spark, sf_dir), "conv_id")


@query(_ISSUES + """SELECT conv_id, issue_index, rank, hidden FROM (SELECT conv_id, issue_index, row_number() OVER (PARTITION BY conv_id ORDER BY value DESC, weight DESC, issue_index)::INT AS rank,
  greatest(count(*) OVER (PARTITION BY conv_id) - 3, 0) AS hidden FROM issues) WHERE rank <= 3""")
def issue_rank(spark, sf_dir):
    return review.ranked_issues(_issues(spark, sf_dir), ["conv_id"], top=3).select("conv_id", "issue_index", "rank", "hidden")


@query(_ISSUES + ", v AS (SELECT conv_id, turn AS iteration, sum(value * weight) AS score FROM issues GROUP BY 1, 2) SELECT conv_id, arg_min(iteration, (score, iteration)) AS iteration, min(score) AS score FROM v GROUP BY 1")
def best_version(spark, sf_dir):
    versions = review.scores(_issues(spark, sf_dir), "conv_id", "turn").withColumnRenamed("turn", "iteration")
    return review.best_version(versions, "conv_id")


def _requests(spark, sf_dir):
    turn = F.struct("turn", "role", "text")
    rows = d.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


@query()
def llm_cache_key(spark, sf_dir):
    return requests.with_keys(_requests(spark, sf_dir)).select("conv_id", "key")


@query("""SELECT conv_id, md5('{"messages": [' || string_agg('{"content": ' || to_json("text")::VARCHAR || ', "role": ' || to_json(role)::VARCHAR || '}', ', ' ORDER BY turn, role, "text") || '], "model": "stub", "temperature": 0.6, "top_p": 0.6}') AS request FROM conversations GROUP BY 1""")
def llm_request_text(spark, sf_dir):
    """The text under the cache's key, as DuckDB has no SHA-512 for the key itself."""
    text = json_text.request_json("messages", "stub", F.lit(0.6), F.lit(0.6))
    return _requests(spark, sf_dir).select("conv_id", F.md5(text.cast("binary")).alias("request"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0")
def llm_cache_miss(spark, sf_dir):
    asked = requests.with_keys(_requests(spark, sf_dir))
    cache = asked.where("conv_id % 3 = 0").select("key", F.lit("known").alias("answer"))
    return requests.misses(asked.withColumn("key", F.concat("key", F.col("conv_id").cast("string"))), cache.join(asked.where("conv_id % 3 = 0"), "key").select(F.concat("key", F.col("conv_id").cast("string")).alias("key"), "answer")).select("conv_id")


@query("""SELECT conv_id, 'answer ' || "left"(sha256(arg_max("text", turn)), 16) AS answer FROM conversations GROUP BY 1""")
def llm_request(spark, sf_dir):
    empty = spark.createDataFrame([], "key string, answer string")
    return requests.answers(_requests(spark, sf_dir), empty)[0].select("conv_id", "answer")


@query("""SELECT doc_id, 'answer ' || "left"(sha256('Rules for: ' || source), 16) AS guidance FROM documents""")
def guidance(spark, sf_dir):
    rows = d.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("intention"))
    return reviewing.with_guidance(rows, "Rules for: {{ intention }}").select("doc_id", "guidance")


@query("""SELECT conv_id, turn, 'answer ' || "left"(sha256('Check [' || role || '] ' || "text"), 16) AS reviewer FROM conversations""")
def reviewers(spark, sf_dir):
    rows = d.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("label"), F.col("text").alias("content"))
    return reviewing.with_reviewers(rows, "Check [{{ label }}] {{content}}").select("conv_id", "turn", "reviewer")


_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _sources(spark, sf_dir):
    """Quotations of every sentence, by its place: as it is, without its last mark and in capitals, cut, or with an ellipsis."""
    s = d.sentence_rows(spark, sf_dir)
    t, kind = F.col("text"), F.col("sentence_index") % 4
    quoted = F.when(kind == 0, t).when(kind == 1, F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(kind == 2, F.expr("substring(text, 1, length(text) - 8)")).otherwise(F.concat(F.substring(t, 1, 12), F.lit("..."), F.right(t, F.lit(12))))
    return s.select("chapter_id", "fragment_id", (F.col("chapter_id") * d.IDS + F.col("sentence_index")).alias("source_id"), quoted.alias("text"))


@query(""", src AS (SELECT chapter_id, fragment_id, chapter_id * 1000000 + sentence_index AS source_id, CASE sentence_index % 4 WHEN 0 THEN text WHEN 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN "left"(text, greatest(length(text) - 8, 0))
  ELSE "left"(text, 12) || '...' || "right"(text, 12) END AS text FROM s)
SELECT s.chapter_id, s.fragment_id, source_id, max(sentence_index) AS sentence_index FROM src JOIN s ON s.chapter_id = src.chapter_id AND s.fragment_id = src.fragment_id AND s.text = src.text GROUP BY 1, 2, 3""", base=True)
def exact_match(spark, sf_dir):
    return matching.exact_matches(_sources(spark, sf_dir), d.sentence_rows(spark, sf_dir))


_SIMPLE = """, nrm AS (SELECT *, lower(text) AS norm FROM s), src AS (SELECT chapter_id, fragment_id, chapter_id * 1000000 + sentence_index AS source_id,
  CASE sentence_index % 4 WHEN 0 THEN text WHEN 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN "left"(text, greatest(length(text) - 8, 0)) ELSE "left"(text, 12) || '...' || "right"(text, 12) END AS text FROM s)
"""


def _lower(df):
    return df.withColumn("norm", F.lower("text"))


@query(_SIMPLE + """SELECT s.chapter_id, s.fragment_id, source_id, sentence_index FROM src JOIN nrm s ON s.chapter_id = src.chapter_id AND s.fragment_id = src.fragment_id
WHERE length(lower(src.text)) >= 10 AND length(norm) >= 10 AND (contains(lower(src.text), norm) OR contains(norm, lower(src.text)))""", base=True)
def containment_match(spark, sf_dir):
    return matching.containment_matches(cut(_lower(_sources(spark, sf_dir))), cut(_lower(d.sentence_rows(spark, sf_dir))))


@query(_SIMPLE + """, parts AS (SELECT chapter_id, fragment_id, source_id, string_split(text, '...') AS p FROM src WHERE text LIKE '%...%')
SELECT s.chapter_id, s.fragment_id, source_id, sentence_index FROM parts JOIN nrm s ON s.chapter_id = parts.chapter_id AND s.fragment_id = parts.fragment_id
WHERE len(p) = 2 AND length(p[1]) >= 5 AND length(p[2]) >= 5 AND starts_with(norm, lower(p[1])) AND suffix(norm, lower(p[2]))""", base=True)
def ellipsis_match(spark, sf_dir):
    return matching.ellipsis_matches(_sources(spark, sf_dir), _lower(d.sentence_rows(spark, sf_dir)), normal=F.lower)


_NORMAL = f"""{_SIMPLE.rstrip().replace("lower(text) AS norm", norm_sql("text") + " AS norm").replace("nrm AS (", "nrm AS MATERIALIZED (")},
srcn AS MATERIALIZED (SELECT *, {norm_sql("text")} AS norm FROM src),
pairs AS MATERIALIZED (
  SELECT a.chapter_id, a.fragment_id, a.source_id, b.sentence_index, contains(a.norm, b.norm) OR contains(b.norm, a.norm) AS inside,
         CASE WHEN length(a.norm) <= length(b.norm) THEN a.norm ELSE b.norm END AS short, CASE WHEN length(a.norm) <= length(b.norm) THEN b.norm ELSE a.norm END AS long
  FROM srcn a JOIN nrm b ON a.chapter_id = b.chapter_id AND a.fragment_id = b.fragment_id WHERE length(a.norm) >= 10 AND length(b.norm) >= 10),
lcs AS MATERIALIZED (
  SELECT chapter_id, fragment_id, source_id, sentence_index FROM (SELECT *, ceil(0.8::DOUBLE * length(short))::INT AS run FROM pairs)
  WHERE len(list_filter(range(1, length(short) - run + 2), lambda i: contains(long, substr(short, i, run)))) > 0)
"""


def _split_sql(sources: str) -> str:
    return f"""pieces AS (SELECT chapter_id, fragment_id, source_id, list_filter(string_split(regexp_replace(text, '\\.([一-鿿])', '.。\\1', 'g'), '。'), lambda x: trim(x) <> '') AS p FROM {sources}),
each_part AS (SELECT chapter_id, fragment_id, source_id, part::INT AS part, {norm_sql("p[part + 1]")} AS a FROM (SELECT *, unnest(range(len(p))) AS part FROM pieces WHERE len(p) >= 2)),
splits AS (
  SELECT e.chapter_id, e.fragment_id, source_id, part, min(sentence_index) AS sentence_index FROM each_part e JOIN nrm b ON b.chapter_id = e.chapter_id AND b.fragment_id = e.fragment_id
  WHERE length(a) >= 5 AND (a = norm OR (length(a) >= 10 AND length(norm) >= 10 AND (contains(a, norm) OR contains(norm, a)))) GROUP BY 1, 2, 3, 4)
"""


@query(_NORMAL + "SELECT chapter_id, fragment_id, source_id, sentence_index FROM lcs", base=True)
def lcs_match(spark, sf_dir):
    norm = matching.normalize_text("text")
    return matching.lcs_matches(cut(_sources(spark, sf_dir).withColumn("norm", norm)), cut(d.sentence_rows(spark, sf_dir).withColumn("norm", norm)))


@query(_NORMAL + ", twice AS (SELECT chapter_id, fragment_id, source_id, text || '。' || text AS text FROM src), " + _split_sql("twice") + "SELECT * FROM splits", base=True)
def split_match(spark, sf_dir):
    src = _sources(spark, sf_dir).withColumn("text", F.concat("text", F.lit("。"), "text"))
    return matching.split_matches(src, d.sentence_rows(spark, sf_dir).withColumn("norm", matching.normalize_text("text")))


_CASCADE = f"""{_NORMAL}, {_split_sql("src")},
dots AS (SELECT chapter_id, fragment_id, source_id, {norm_sql("p[1]")} AS x, {norm_sql("p[2]")} AS y FROM (SELECT *, string_split(text, '...') AS p FROM src) WHERE len(p) = 2),
staged AS (
  SELECT src.chapter_id, src.fragment_id, source_id, max(sentence_index) AS sentence_index, 'exact' AS stage, 1 AS turn
  FROM src JOIN s ON s.chapter_id = src.chapter_id AND s.fragment_id = src.fragment_id AND s.text = src.text GROUP BY 1, 2, 3
  UNION ALL
  SELECT a.chapter_id, a.fragment_id, source_id, min(sentence_index), 'normalized', 2
  FROM srcn a JOIN nrm b ON b.chapter_id = a.chapter_id AND b.fragment_id = a.fragment_id AND b.norm = a.norm GROUP BY 1, 2, 3
  UNION ALL
  SELECT chapter_id, fragment_id, source_id, sentence_index, 'contained', 3 FROM (SELECT * FROM lcs UNION SELECT chapter_id, fragment_id, source_id, sentence_index FROM pairs WHERE inside)
  UNION ALL
  SELECT d.chapter_id, d.fragment_id, source_id, sentence_index, 'ellipsis', 4 FROM dots d JOIN nrm b ON b.chapter_id = d.chapter_id AND b.fragment_id = d.fragment_id
  WHERE length(x) >= 5 AND length(y) >= 5 AND starts_with(norm, x) AND suffix(norm, y)
  UNION ALL
  SELECT DISTINCT chapter_id, fragment_id, source_id, sentence_index, 'split', 5 FROM splits
  UNION ALL
  SELECT src.chapter_id, src.fragment_id, source_id, min(sentence_index), 'fallback', 6 FROM src JOIN s ON s.chapter_id = src.chapter_id AND s.fragment_id = src.fragment_id GROUP BY 1, 2, 3)
SELECT chapter_id, fragment_id, source_id, sentence_index, stage FROM staged QUALIFY turn = min(turn) OVER (PARTITION BY chapter_id, fragment_id, source_id)"""


@query(_CASCADE, base=True)
def match_cascade(spark, sf_dir):
    return matching.match_cascade(_sources(spark, sf_dir), d.sentence_rows(spark, sf_dir))


@query()
def fragment_groups(spark, sf_dir):
    levels = weights.incision_levels(weights.fragment_incisions(d.chunk_rows(spark, sf_dir), d.weighted_edges(spark, sf_dir)))
    return grouping.fragment_groups(levels, fragment_totals(d.sentence_rows(spark, sf_dir)), budget=1000)


@query()
def extraction_loop(spark, sf_dir):
    return extraction.extract(d.sentence_rows(spark, sf_dir))


_TWO_PASSES = """, f AS (
  SELECT *, row_number() OVER (PARTITION BY chapter_id, fragment_id ORDER BY sentence_index) - 1 AS k, count(*) OVER (PARTITION BY chapter_id, fragment_id) AS n,
         max(sentence_index) OVER (PARTITION BY chapter_id, fragment_id, text) AS place
  FROM s
),
made AS (
  SELECT *, 0 AS pass, ['verbatim', 'detailed', 'focused', 'relevant'][1 + length(text) % 4] AS retention, ['critical', 'important', 'helpful'][1 + length(text) % 3] AS importance FROM f WHERE k % 3 = 0
  UNION ALL
  SELECT *, 1, NULL, 'critical' FROM f WHERE k = n - 1
)
SELECT chapter_id * 1000000 + row_number() OVER (PARTITION BY chapter_id ORDER BY fragment_id, pass, k) - 1 AS id, chapter_id,
       (dense_rank() OVER (PARTITION BY chapter_id ORDER BY fragment_id) - 1)::INT AS generation, fragment_id, place AS sentence_index, "left"(text, 12) AS label, retention, importance
FROM made"""


@query(_TWO_PASSES, base=True)
def two_pass_chunks(spark, sf_dir):
    rows = extraction.extract(d.sentence_rows(spark, sf_dir), second_pass=extraction.stub_second_pass).where("kind = 'chunk'")
    return rows.select("id", "chapter_id", "generation", "fragment_id", "sentence_index", "label", "retention", "importance")


@query("""SELECT chapter_id, fragment_id, to_json({'synopsis': fragment_id::VARCHAR, 'sentences': list({'text': text, 'token_count': token_count} ORDER BY sentence_index)})::VARCHAR AS value FROM s GROUP BY 1, 2""", base=True)
def fragment_json(spark, sf_dir):
    rows = d.sentence_rows(spark, sf_dir)
    return workspace.fragment_json(rows, rows.select("chapter_id", "fragment_id", F.col("fragment_id").cast("string").alias("synopsis")).distinct())


@query("SELECT id, generation, chapter_id, fragment_id, sentence_index, label, content, retention, importance, tokens, weight FROM c", base=True)
def workspace_append(spark, sf_dir):
    """Two batches that overlap, stored by chapter and read back."""
    work, rows = workspace.Workspace(spark, f"{shared_dir(spark)}/workspace-{uuid.uuid4().hex}"), d.chunk_rows(spark, sf_dir)
    work.append("chunks", rows.where("sentence_index % 2 = 0"))
    work.append("chunks", rows)
    return work.read("chunks")


@query("""SELECT conv_id AS group_key, CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 2 END AS iteration, 0.0::DOUBLE AS score FROM conversations GROUP BY 1""")
def compression_loop(spark, sf_dir):
    groups = d.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("group_key")).agg(F.min_by("text", "turn").alias("text"))
    shorter = lambda rows, k: rows.withColumn("version", F.expr(f"substring(text, 1, length(text) div {k + 1})"))
    strict = lambda rows, k: rows.where((F.col("group_key") % 4 != 0) & (F.lit(k) < 2)).select("group_key", F.lit("major").alias("severity"), F.lit(0.5).alias("weight"))
    return compression.compress(groups, shorter, strict, max_iterations=4).select("group_key", "iteration", "score")


def _shortened(messages, options):
    """The user's first text, cut the shorter the more attempts there were."""
    attempts = sum(m["role"] == "assistant" for m in messages)
    text = messages[1]["content"]
    return f"Thoughts.\n## Compressed Text\n\n<chunk>{text[: len(text) // (attempts + 2)]}</chunk>\n---\nend"


def _fewer_issues(messages, options):
    """As many issues as the version's length says, one less for each earlier round; the first message names the severity."""
    left = (len(messages[-1]["content"]) + len(messages[0]["content"])) % 5 - sum(m["role"] == "assistant" for m in messages)
    return "```json\n" + json.dumps({"issues": [{"severity": messages[0]["content"], "problem": "p", "suggestion": "s"}] * max(left, 0)}) + "\n```"


@query("""WITH base AS (SELECT conv_id, regexp_replace(arg_min("text", turn), '^\\s+|\\s+$', '', 'g') AS t, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS u FROM conversations GROUP BY 1),
rounds AS (SELECT conv_id, k, length(t) // (k + 1) AS n, u FROM base, range(1, 5) r(k)),
rated AS (SELECT conv_id, k, 3 * 0.5::DOUBLE * greatest((n + 5) % 5 - (k - 1), 0) + CASE WHEN u = 1 THEN 9 * 0.25::DOUBLE * greatest((n + 8) % 5 - (k - 1), 0) ELSE 0 END AS score FROM rounds),
stops AS (SELECT conv_id, min(k) FILTER (score = 0) AS stop FROM rated GROUP BY 1)
SELECT r.conv_id AS group_key, arg_min(k, (score, k))::INT AS iteration, min(score) AS score FROM rated r JOIN stops s ON r.conv_id = s.conv_id WHERE k <= coalesce(stop, 4) GROUP BY 1""")
def compression_history(spark, sf_dir):
    """Compressor and reviewers with their dialogues: both count their earlier rounds, so a history that is lost or doubled shows in the scores."""
    rows = d.table(spark, sf_dir, "conversations")
    groups = rows.groupBy(F.col("conv_id").alias("group_key")).agg(F.regexp_replace(F.min_by("text", "turn"), r"^\s+|\s+$", "").alias("text"))
    one = groups.select("group_key", F.lit(1).cast("long").alias("clue_id"), F.lit(0.5).alias("weight"), F.lit("major").alias("reviewer"))
    users = rows.where("role = 'user'").select(F.col("conv_id").alias("group_key")).distinct()
    two = users.select("group_key", F.lit(2).cast("long").alias("clue_id"), F.lit(0.25).alias("weight"), F.lit("critical").alias("reviewer"))
    compressor = compression.Compressor(groups.withColumnRenamed("text", "marked"), "Shorten to {{ target }}", _shortened)
    return compression.compress(groups, compressor, reviewing.Reviews(one.unionByName(two), _fewer_issues), max_iterations=4).select("group_key", "iteration", "score")


def _kept_spans(messages, options):
    """A reviewer's text for a clue, a compression of a marked text, or a review, by what is asked."""
    said = messages[-1]["content"]
    if messages[0]["content"].startswith("Say what"):
        return "Look for " + said[:60]
    if messages[0]["content"].startswith("Shorten"):
        spans = re.findall(r"<chunk [^>]*>(.*?)</chunk>", messages[1]["content"], re.S)
        attempts = sum(m["role"] == "assistant" for m in messages)
        return " ".join(spans[:: attempts + 1])
    rounds = sum(m["role"] == "assistant" for m in messages)
    return json.dumps({"issues": [{"severity": "major", "problem": "too long", "suggestion": "cut"}] * (len(said) > 400 and rounds < 2)})


@query()
def summaries(spark, sf_dir):
    """A text for each document, the whole way: extraction, weights, groups, chains, clues, marked text, compression and reviews."""
    chapters = d.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_id"), "text")
    settings = flow.Settings(fragment_tokens=d.BUDGET, group_tokens=1000, max_iterations=3, client=_kept_spans)
    return flow.Flow(spark, f"{shared_dir(spark)}/flow-{uuid.uuid4().hex}", settings).run(chapters)
