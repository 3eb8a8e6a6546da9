"""Broken JSON read by an automaton with a stack: every token has a meaning in every state, so something is always read."""

from __future__ import annotations

import json
import re

_BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)*", re.S)
_BARE_KEY = re.compile(r"[^\s:,{}\[\]\"'“”]+")
_BARE_VALUE = re.compile(r"[^,{}\[\]\n]+")
_AFTER = re.compile(r"\s*(?:[,:}\]]|//|/\*|#|\Z)|\s+[\"'“{\[]")
_QUOTES = {'"': '"', "'": "'", "“": "”"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\"}
_WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None, "nan": None, "infinity": None, "-infinity": None}
_NOTHING = object()


def _string(text: str, at: int) -> tuple[str, int]:
    """The string that starts with the quote at this place, and the place after it. A quote inside ends it only where JSON could go on after it."""
    end, out = _QUOTES[text[at]], []
    special, at = re.compile(rf"[\\{end}]"), at + 1
    while True:
        met = special.search(text, at)
        if met is None:
            return "".join([*out, text[at:]]), len(text)
        out.append(text[at : met.start()])
        at = met.end()
        if met[0] == end:
            if _AFTER.match(text, at):
                return "".join(out), at
            out.append(end)
        elif at < len(text):
            code = re.compile("u([0-9a-fA-F]{4})").match(text, at)
            out.append(chr(int(code[1], 16)) if code else _ESCAPES.get(text[at], text[at]))
            at = code.end() if code else at + 1


def _bare(word: str):
    word = word.strip()
    if word.lower() in _WORDS:
        return _WORDS[word.lower()]
    if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", word):
        value = float(word) if re.search(r"[.eE]", word) else int(word[:4000])
        return value if isinstance(value, int) or abs(value) != float("inf") else None
    return word


def tolerant(text: str):
    """The first object or array in text; None without a bracket.

    Read as meant: bare and single-quoted keys and strings, quotes and line breaks inside strings, comments, missing and doubled
    commas, brackets that are missing or of the wrong kind, and a text that was cut. A key without a value is null, a cut key is left out,
    what is no number is null, what follows the value is left out. Each character is looked at a bounded number of times.
    """
    start = re.search(r"[{\[]", text)
    if start is None:
        return None
    top = {} if start[0] == "{" else []
    stack, keys, at = [top], [_NOTHING], start.end()  # keys: the key that waits for a value at each depth
    open_ = {dict: 0, list: 0}
    open_[type(top)] += 1

    def put(value) -> None:
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][keys[-1]] = value
            keys[-1] = _NOTHING

    while True:
        at = _BLANK.match(text, at).end()
        if at >= len(text):
            break
        c = text[at]
        waits = isinstance(stack[-1], dict) and keys[-1] is _NOTHING  # for a key
        if c in "}]":
            at += 1
            kind = dict if c == "}" else list
            if not open_[kind]:
                continue
            closed = None
            while not isinstance(closed, kind):
                if keys[-1] is not _NOTHING:
                    put(None)
                closed = stack.pop()
                open_[type(closed)] -= 1
                keys.pop()
            if not stack:
                return top
        elif c == "," or (c == ":" and waits):
            if c == "," and keys[-1] is not _NOTHING:
                put(None)
            at += 1
        elif c == ":":
            at += 1
        elif waits:
            if c in _QUOTES:
                key, at = _string(text, at)
            else:
                met = _BARE_KEY.match(text, at)
                key, at = (met[0], met.end()) if met else (None, at + 1)
            if key is not None and at < len(text):
                keys[-1] = key
        elif c in "{[":
            at += 1
            new = {} if c == "{" else []
            put(new)
            stack.append(new)
            open_[type(new)] += 1
            keys.append(_NOTHING)
        elif c in _QUOTES:
            value, at = _string(text, at)
            put(value)
        else:
            met = _BARE_VALUE.match(text, at)
            word = re.split(r"\s(?://|#)|/\*", met[0], maxsplit=1)[0]
            at += max(1, len(word))
            put(_bare(word))
    while stack:
        if keys[-1] is not _NOTHING:
            put(None)
        stack.pop()
        keys.pop()
    return top


def repaired(text: str | None) -> str | None:
    """text as JSON: as it is if it is JSON, else what `tolerant` reads; null without a bracket or where brackets nest deeper than Python can write."""
    if text is None:
        return None
    try:
        try:
            value = json.loads(text, parse_constant=lambda _: None)
        except ValueError:
            value = tolerant(text)
            if value is None:
                return None
        return json.dumps(value, ensure_ascii=False)
    except (RecursionError, ValueError):
        return None
