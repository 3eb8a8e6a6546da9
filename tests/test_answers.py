"""Raw answers: odd shapes, misspelt fields, links of both types, two passes, and the chapter loop over a model."""

import json

from loomtext.operators import answers, extraction, matching

SENTENCES = [(1, 0, 0, "First one here.", 4), (1, 0, 1, "Second one is here too.", 5), (1, 0, 2, "First one here.", 4), (1, 1, 3, "Another fragment begins.", 6), (2, 0, 0, "Other chapter.", 3)]
KINDS = "chapter_id long, fragment_id int, answer string"


def sentences(spark):
    return spark.createDataFrame(SENTENCES, "chapter_id long, fragment_id int, sentence_index int, text string, token_count int")


def told(chunks, links=(), **more):
    return "Sure! " + json.dumps({"fragment_summary": "S", "chunks": list(chunks), "links": list(links)} | more) + " Done."


def test_what_cannot_be_used_is_told_with_its_reason(spark):
    rows = [None, "nothing", '{"chunks": [', told([])[:-8], '{"fragment_summary": "x", "chunks": []}', '{"chunks": [], "links": []}', '{"fragment_summary": null, "chunks": {}, "links": []}', '{"fragment_summary": "x", "chunks": [], "links": 3}', "[1, 2]", told([])]
    got = answers.parsed(spark.createDataFrame([(1, k, a) for k, a in enumerate(rows)], KINDS))
    assert {r.fragment_id: r.reason for r in got.failed.collect()} == {
        0: "no answer", 1: "no JSON object", 2: "no JSON object", 3: "no JSON object", 4: "no links", 5: "no fragment_summary", 6: "chunks is no list", 7: "links is no list", 8: "no fragment_summary",
    }
    assert [(r.fragment_id, r.synopsis) for r in got.synopses.collect()] == [(9, "S")]
    mended = answers.parsed(spark.createDataFrame([(1, 0, '```json\n{"fragment_summary": "x", "chunks": [], "links": [],}\n```')], KINDS), repair=True)
    assert mended.failed.isEmpty() and mended.synopses.first().synopsis == "x"


def test_fields_and_places(spark):
    chunks = [
        {"temp_id": "a", "label": "A", "content": "x", "source_sentences": [], "source_sences": ["Second one is here too."], "retention": "focused", "importance": "critical"},
        {"temp_id": 7, "source_sentances": "First one here."},
        {"temp_id": "a", "source_sentences": ["not there", None, "SECOND ONE IS HERE TOO", "First one here.", "Second one is here too."]},
        {"source_sentences": ["nowhere to be found"]},
        {},
    ]
    got = answers.graph_of(spark.createDataFrame([(1, 0, told(chunks)), (3, 0, told([{}]))], KINDS), sentences(spark))
    rows = sorted(got.chunks.collect(), key=lambda r: r.id)
    assert [(r.id, r.label, r.content, r.retention, r.importance, r.sentence_ids, r.sentence_index, r.tokens) for r in rows] == [
        (1_000_000, "A", "x", "focused", None, [1], 1, 5), (1_000_001, "", "", None, None, [2], 2, 4), (1_000_002, "", "", None, None, [1, 2], 1, 9), (1_000_003, "", "", None, None, [0], 0, 4),
        (1_000_004, "", "", None, None, [0], 0, 4), (3_000_000, "", "", None, None, [0], 0, 0),
    ]


def test_links_by_name_and_by_number(spark):
    links = [
        {"from": "a", "to": "b", "strength": "helpful"}, {"from": "b", "to": "a", "strength": "critical"}, {"from": 1000002, "to": "a"}, {"from": "1000000", "to": "a"},
        {"from": 1000003, "to": "a"}, {"from": "zz", "to": "a"}, {"to": "a"}, {"from": 1.5, "to": "a"}, {"from": None, "to": "a"}, {"from": "a", "to": "a"}, {"from": "1", "to": "b"}, {"from": 1, "to": "b"},
    ]
    rows = [(1, 0, told([{"temp_id": "a"}, {"temp_id": "1"}])), (1, 1, told([{"temp_id": "a"}, {"temp_id": "b"}], [*links, {"from": 1000000, "to": "b", "strength": "important"}]))]
    rows += [(2, 0, told([{"temp_id": "b"}], [{"from": 1000000, "to": "b"}]))]
    got = answers.graph_of(spark.createDataFrame(rows, KINDS), sentences(spark))
    assert sorted((r.from_id, r.to_id, r.strength) for r in got.edges.collect()) == [
        (1000002, 1000002, None), (1000003, 1000000, "important"), (1000003, 1000002, "helpful"),
    ]


def test_second_pass_rates_and_follows_the_first(spark):
    first = [(1, 0, told([{"temp_id": "a", "importance": "no level of this pass"}])), (1, 1, told([{"temp_id": "a"}]))]
    second = [
        (1, 0, told([{"temp_id": "z", "importance": "helpful"}], [{"from": "z", "to": "a"}], importance_annotations=[{"chunk_id": 1000000, "importance": "important"}, {"chunk_id": 1000000, "importance": "critical"}, {"chunk_id": "x"}, {"chunk_id": 5, "importance": "critical"}])),
        (1, 1, told([], importance_annotations=[{"chunk_id": 1000002, "importance": "critical"}])), (2, 0, told([])),
    ]
    got = answers.graph_of(spark.createDataFrame(first, KINDS), sentences(spark), spark.createDataFrame(second, KINDS))
    assert sorted((r.id, r.fragment_id, r.generation, r.importance) for r in got.chunks.collect()) == [(1000000, 0, 0, "critical"), (1000001, 0, 0, "helpful"), (1000002, 1, 1, None)]
    assert [(r.from_id, r.to_id) for r in got.edges.collect()] == [(1000001, 1000000)]
    assert [(r.chapter_id, r.level, r.reason) for r in got.failed.collect()] == [(2, "importance", "no importance_annotations")]


def test_empty_tables(spark):
    got = answers.graph_of(spark.createDataFrame([], KINDS), sentences(spark).limit(0))
    assert got.chunks.isEmpty() and got.edges.isEmpty() and got.synopses.isEmpty() and got.failed.isEmpty()


def test_chapter_loop_over_a_model_agrees_with_the_tables(spark):
    def client(messages, options):
        text = messages[1]["content"]
        if "Another" in text:
            return 'I think {"chunks": oops}'
        ids = [int(x.split(".")[0]) for x in messages[0]["content"].split("\n")[1:] if x[0].isdigit()]
        chunk = {"temp_id": "a", "label": text[:5], "content": text, "source_sentences": ["Second one is here too."], "retention": "focused"}
        return "Sure! " + json.dumps({"fragment_summary": "S", "chunks": [chunk], "links": [{"from": i, "to": "a"} for i in ids]}) + " Done."

    loop = extraction.extract(sentences(spark), answers.model_extractor(client, "You see:\n{{ memory }}")).collect()
    asked = sentences(spark).groupBy("chapter_id", "fragment_id").agg({"text": "first"}).collect()
    texts = {(c, f): "".join(t for a, b, _, t, _ in SENTENCES if (a, b) == (c, f)) for c, f, _ in asked}
    raw = spark.createDataFrame([(c, f, client([{"content": "You see:\n(empty)"}, {"content": t}], {})) for (c, f), t in texts.items()], KINDS)
    got = answers.graph_of(raw, sentences(spark), match=matching.exact_matches)
    assert {(r.id, r.fragment_id, r.generation, r.label, r.retention) for r in loop if r.kind == "chunk"} == {(r.id, r.fragment_id, r.generation, r.label, r.retention) for r in got.chunks.collect()}
    assert [(r.chapter_id, r.fragment_id) for r in loop if r.kind == "failed"] == [(r.chapter_id, r.fragment_id) for r in got.failed.collect()] == [(1, 1)]


def test_answers_are_parsed_once_and_chunks_made_only_when_asked_for(spark):
    def never(sources, sentences):
        raise AssertionError("no chunk was asked for")

    raw = spark.createDataFrame([(1, 0, told([{"temp_id": "a"}])), (1, 1, "no object")], KINDS)
    got = answers.graph_of(raw, sentences(spark), match=never)
    assert got.synopses.count() == 1 and got.failed.count() == 1
    found = answers.parsed(raw)
    for table in (found.chunks, found.links, found.notes, found.synopses, found.failed):
        assert "parse_json" not in table._jdf.queryExecution().optimizedPlan().toString()
