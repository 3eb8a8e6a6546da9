"""Shapes of broken JSON and what they mean."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.functions.json_repair import repaired, tolerant

SHAPES = {
    "bare keys": ("{chunks: [1], links: []}", {"chunks": [1], "links": []}),
    "single quotes": ("{'a': 'don't', 'b': 2}", {"a": "don't", "b": 2}),
    "apostrophe kept": ("{\"a\": \"it's\", 'b': 1,}", {"a": "it's", "b": 1}),
    "quotes inside": ('{"a": "he said "yes" twice", "b": 1}', {"a": 'he said "yes" twice', "b": 1}),
    "comments": ('{"a": 1, // one\n /* two */ "b": [2, # three\n 3]}', {"a": 1, "b": [2, 3]}),
    "missing commas": ('{"a": "x" "b": [1 \n 2] "c": {"d": 1}}', {"a": "x", "b": [1, 2], "c": {"d": 1}}),
    "doubled commas": ('[1,, 2, ,3,]', [1, 2, 3]),
    "cut string": ('{"a": [{"b": "half a sen', {"a": [{"b": "half a sen"}]}),
    "cut key": ('{"a": 1, "lon', {"a": 1}),
    "cut after colon": ('{"a": 1, "b": ', {"a": 1, "b": None}),
    "missing brackets": ('{"a": [1, {"b": 2}', {"a": [1, {"b": 2}]}),
    "wrong bracket": ('{"a": [1, 2}, "b": 3', {"a": [1, 2]}),
    "stray bracket": ('{"a": 1], "b": 2}', {"a": 1, "b": 2}),
    "line break in a string": ('{"a": "x\ny"}', {"a": "x\ny"}),
    "words": ("{a: True, b: None, c: NaN, d: some words, e: -1.5e3}", {"a": True, "b": None, "c": None, "d": "some words", "e": -1500.0}),
    "text around": ('Here it is:\n```json\n{"a": 1,}\n```\nDone {now}.', {"a": 1}),
    "curly quotes": ("{“a”: “b”}", {"a": "b"}),
    "escapes": (r'{"a": "é\n\"q\" \x", }', {"a": 'é\n"q" x'}),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(shape):
    text, want = SHAPES[shape]
    assert json.loads(repaired(text)) == want


def test_no_json():
    assert repaired(None) is None and repaired("no json") is None and repaired("") is None


_VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12)


@settings(deadline=None, max_examples=200)
@given(st.lists(_VALUES) | st.dictionaries(st.text(), _VALUES))
def test_json_stays_what_it_is(value):
    assert json.loads(repaired(json.dumps(value))) == value


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="{}[]\",':/*#\\ \nab1”“"))
def test_anything_is_read(text):
    out = repaired(text)
    assert out is None or json.loads(out) is not NotImplemented


@pytest.mark.parametrize("text", ["[" * 300_000, '{"a": "' + "b" * 3_000_000, '["' + 'x" y ' * 300_000, "[" + "1 \n" * 300_000, "{a:" * 200_000 + "}]" * 200_000])
def test_long_texts_end(text):
    start = time.monotonic()
    repaired(text)
    assert time.monotonic() - start < 20
    assert tolerant("[1") == [1]
