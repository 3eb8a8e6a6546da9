"""Line dedup, fill-in-middle and spelling variants against brute force, with odd and giant texts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import fill_in_middle, line_dedup, spelling
from loomtext.llm.common import join_counted, read_table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row string, place int, key_a long, doc string, n_dropped string, `a.b` int"
MODULES = {"op11_line_dedup": line_dedup, "op12_fill_in_middle": fill_in_middle, "op13_spelling_variants": spelling}


def table(spark, texts):
    return spark.createDataFrame([(i, t, "r", 1, 2, "d", "x", 3) for i, t in texts], DOCS)


@pytest.mark.parametrize("name", MODULES)
def test_against_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, want = MODULES[name].QUERIES[name](spark, SF), duck.sql(MODULES[name].ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[k] for k in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", MODULES)
def test_empty_tables(spark, name, tmp_path):
    read_table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert MODULES[name].QUERIES[name](spark, str(tmp_path)).count() == 0


# -- lines


def plain_key(line):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), line.strip(" \t\n\x0b\f\r"))


def plain_dedup(rows, min_chars, min_documents):
    last = line_dedup.NO_ID
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(plain_key(line), set()).add(last if i is None else i)
    gone = {k: min(ids) for k, ids in held.items() if len(k) >= min_chars and len(ids) >= min_documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(plain_key(x), last if i is None else i) == (last if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_documents", [2, 3])
def test_lines(spark, min_documents):
    dice = random.Random(2)
    pool = ["a line of the corpus", "  A LINE of the corpus\t", "ÄRGER in one line", "ärger in one line", "short", "", "nine char", "ten chars.", " ten chars. ", "你好，世界你好，世界好", "\x00 odd zero line", "a\rb\rc line here"]
    texts = [(i, "\n".join(dice.choices(pool, k=dice.randrange(12)))) for i in range(60)]
    texts += [(None, "a line of the corpus\nonly here, no id"), (None, "a line of the corpus"), (7, texts[7][1]), (7, "a line of the corpus\nanother text of seven"), (70, None), (71, ""), (72, "\n\n\n"), (73, "ten chars."), (74, "only here and here\nonly here and here")]
    got = line_dedup.drop_repeated_lines(table(spark, texts), min_documents=min_documents)
    assert got.columns == ["doc_id", "row", "place", "key_a", "doc", "a.b", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == plain_dedup(texts, 10, min_documents)


def test_lines_of_long_texts_and_a_line_that_fills_the_corpus(spark):
    many = "\n".join(f"line number {i} of many" if i % 2 else "the very common line" for i in range(100_000))
    texts = [(1, "the very common line"), (2, many), (3, many + "\nand an own one"), (4, "x" * 3_000_000 + "\nthe very common line"), *[(10 + i, "the very common line") for i in range(500)]]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(table(spark, texts)).collect()}
    assert (got[1].n_dropped, got[2].n_dropped, got[3].n_dropped, got[4].n_dropped) == (0, 50_000, 100_000, 1)
    assert got[3].text == "and an own one" and got[4].text == "x" * 3_000_000 and got[2].text == "\n".join(many.split("\n")[1::2]) and got[500].text == ""


def test_counted_join_broadcasts_what_is_hot_and_shuffles_the_rest(spark):
    rows = spark.range(1000).select((F.col("id") % 50 * (F.col("id") % 2)).alias("k"), "id")
    counted = rows.groupBy("k").agg(F.count("*").alias("weight"))
    for share in (1, 4, 100, 10_000):
        assert sorted((r.k, r.id, r.weight) for r in join_counted(rows, counted, ["k"], 1000, share).collect()) == sorted((r.k, r.id, r.weight) for r in rows.join(counted, "k").collect())


# -- fill in the middle


def units_of(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def plain_fim(doc_id, text, seed=7):
    text = text or ""
    units = units_of(text)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (doc_id, len(units), "plain", None, None, text)
    spm = h[3] % 100 < 50
    return (doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000, 1 << 15])
def test_fill_in_middle(spark, chunk):
    dice = random.Random(chunk)
    texts = [(i, "".join(dice.choices(["a", "bc", "é", "😀", "<", "P>", "\n", "\n", " "], k=dice.choice([0, 1, 3, 70, 300])))) for i in range(80)]
    texts += [(None, "no\nid\n"), (5, texts[5][1]), (5, "other\ntext\nof five"), (90, None), (91, ""), (92, "\n"), (93, "\n" * 130), (94, "x" * 200), (95, "holds <S> a mark\n"), (96, "a<\nS>b\n<" * 9)]
    got = fill_in_middle.fill_in_middle(table(spark, texts), chunk=chunk).withColumn("again", fill_in_middle.restored())
    rows = got.collect()
    assert all(r.again == (r.text or "") for r in rows)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=repr) == sorted((plain_fim(*t) for t in texts), key=repr)


def test_cuts_in_giant_documents_are_found_in_their_chunks(spark):
    dice = random.Random(1)
    giant = "".join("x" * dice.randrange(200) + "\n" for _ in range(40_000))
    texts = [(1, giant), (2, giant[:-1]), (3, "y" * 2_000_000), (4, "\n" * 500_000), (5, "short\n")]
    got = {r.doc_id: r for r in fill_in_middle.fill_in_middle(table(spark, texts)).collect()}
    for t in texts:
        r = got[t[0]]
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(*t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("a\n \t😀", max_size=200), min_size=1, max_size=5), st.sampled_from([fill_in_middle.LINES, fill_in_middle.WORDS]))
def test_scan_of_parts_is_the_scan_of_the_whole(parts, automaton):
    """Composition of the parts' functions, and each unit's place, whatever state a part is entered in."""
    whole, found = fill_in_middle.scan(["".join(parts)], automaton), fill_in_middle.scan(parts, automaton)
    for start in range(len(automaton.step)):
        state, n = start, 0
        for k in range(len(parts)):
            ends, counts = found.end(k)
            n, state = n + counts[state], ends[state]
        assert (whole.end(0)[0][start], whole.end(0)[1][start]) == (state, n)
        state, begun = start, []
        for i, c in enumerate("".join(parts)):
            begun += [i] if automaton.begins[state][int(c in automaton.members)] else []
            state = automaton.step[state][int(c in automaton.members)]
        k = np.arange(1, len(begun) + 2)
        zeros = np.zeros(len(k), np.int64)
        assert fill_in_middle.places(whole, zeros, zeros + start, k, automaton).tolist() == [*begun, len("".join(parts))]


def test_marks_that_could_not_be_found_again_are_refused(spark):
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(table(spark, []), prefix_mark=marks[0], suffix_mark=marks[1], middle_mark=marks[2])


# -- spellings


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: (lambda best: best if best and words[best] >= 2 * words[w] else None)(min(near[w], key=lambda v: (-words[v], v), default=None)) for w in words}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


@pytest.mark.parametrize("seed", range(4))
def test_variants(spark, seed):
    dice = random.Random(seed)
    letters = ["ab", "abc", "aé", "abcdefgh"][seed]
    words = {"".join(dice.choices(letters, k=dice.randrange(1, 8 if seed != 3 else 4))): dice.choice([1, 1, 2, 3, 5, 9, 30]) for _ in range(250)}
    words |= {"a" * k: k for k in range(1, 12)} | {"b" * 3000: 4, "b" * 2999: 9, "b" * 3001: 2, "b" * 1500 + "c" + "b" * 1499: 1}
    frame = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x"), ("", 7, "x")], "word string, n long, id string")
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame).collect())
    assert got == plain_variants(words)


def test_a_word_takes_part_in_few_merges():
    """A hub with many neighbours is found by them, not the other way round."""
    assert len(list(spelling.merged_strings("hello", [], None))) == 0
    assert list(spelling.merged_strings("hello", [(2, "x")], "s")) == [(-1, "hexlo"), (-1, "hexllo"), (2, "helo"), (-1, "hellos")]


def test_word_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    long = "é" * 2_000_000
    rows = [(1, "Words words, WORDS; ÄRGER ärger_ärger 12abcde3 näive"), (None, "words Words abcde"), (2, None), (3, ""), (4, f"{long} {long} abcde"), (5, long), *[(k, "other othre other words") for k in range(6, 300)]]
    want = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            run = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                want[run] = want.get(run, 0) + 1
    got = {r.word: r.n for r in spelling.word_counts(table(spark, rows), one_in=97).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3} and "othe" not in got and any(len(w) > 1_000_000 for w in got)


# -- buckets


def test_best_partners_in_turns_keep_every_component(spark, monkeypatch):
    """Groups of copies each of which is like a few others only: the turns change what is compared, not what is found."""
    from loomtext.llm import buckets, near_dedup

    dice = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for group in range(3):
        base = dice.choices(words, k=120)
        for _ in range(90):  # each copy leaves out or changes some words, so two copies are linked or not by chance
            own = [w if dice.random() > 0.025 else dice.choice(words) for w in base]
            texts.append((len(texts), " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    shingles = [{tuple(t.split()[k : k + 3]) for k in range(118)} for _, t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(shingles):
        for j in range(i):
            if 100 * len(a & shingles[j]) >= 80 * len(a | shingles[j]) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    want = {i: top(i) for i in range(len(texts))}
    for most in (0, 4, 10**9):
        monkeypatch.setattr(buckets, "PAIRS_A_ROW", most)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 80).collect()}
        assert got == want
    assert 3 < len(set(want.values())) < 200
