"""Brute force, round trips and odd tables for the operators of the llm subpackage."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import bpe, edit_fingerprints, embedding_dedup, language_id, lm_scoring, near_dedup, packing, pii, sharding, toxicity
from loomtext.llm.common import in_fold
from loomtext.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, mentions string, id int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_rows():
    dice = random.Random(5)
    long = " ".join(dice.choice(WORDS) for _ in range(6000))
    texts = [None, "", "   \n", "one", "one", long, long + " more", "12345 !!", "Ünïcödé straße 你好 мир", "mail a.b@c.example.org or +1 (555) 555-1234", "\x00 odd\tspace\x0b", "a" * 3000]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 0, "x", "y", 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id", None, None, None, 0, "x", "y", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def held(docs):
    return lm_scoring.score_documents(docs, docs.where(~in_fold("doc_id", 7, 2)), in_fold("doc_id", 7, 2))


OPERATORS = {
    "pii": lambda d: pii.replace_entities(d, "k"),
    "language": lambda d: language_id.identify_languages(d, d),
    "edit": edit_fingerprints.edit_fingerprints,
    "near edits": edit_fingerprints.near_edits,
    "ppm": held,
    "near": lambda d: near_dedup.near_duplicates(d, 3, 85),
    "pack": lambda d: packing.pack(d, BYTE).where("piece = 0"),
    "bpe": lambda d: bpe.bpe_round_trip(d, WORD),
    "toxic": lambda d: toxicity.score_toxicity(d, toxicity.fit(d, d.sparkSession.createDataFrame([(1, 1), (3, 0), (5, 0), (None, 1)], "doc_id long, toxic int"), toxicity.learnable)),
    "shards": sharding.interleave_shards,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_get_a_row_each_and_empty_tables_none(spark, odd, empty, name):
    assert OPERATORS[name](odd).count() == len(odd_rows())
    assert OPERATORS[name](empty).count() == 0


# -- surrogates


def test_surrogates(spark):
    texts = [
        (1, "Write to Jane.Doe@Mail.example.org, JANE.DOE@MAIL.EXAMPLE.ORG or +1 (415) 555-0199 from 10.20.30.40."),
        (2, "Card 4539 1488 0343 6467 and 4539148803436467; token = \"1beb58b8af68854f\"; Mrs. Novak met Mr. Stone, Maria Keller."),
        (3, "nothing here, version 2.0"),
        (4, None),
    ]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    one, two = got[1].text, got[2].text
    mails = re.findall(r"\S+@[A-Za-z0-9.]+[A-Za-z]", one)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[1].isupper() and mails[0].lower() != "jane.doe@mail.example.org" and mails[0].lower().endswith(".org")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} from \d+\.\d+\.\d+\.\d+\.$", one) and "415) 555-0199" not in one and "10.20.30.40" not in one
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", two)
    assert cards[0].replace(" ", "") == cards[1] != "4539148803436467"
    digits = [int(d) for d in cards[1][::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{16}"', two) and "1beb58b8af68854f" not in two
    assert "Mrs. " in two and "Mr. " in two and not re.search("Novak|Stone|Keller", two)
    assert (got[3].text, got[3].n_replaced, got[4].text, got[4].n_replaced) == (texts[2][1], 0, None, 0)


def test_surrogates_are_distinct_and_no_real_entity(spark):
    rows = [("ipv4", f"10.0.{i // 250}.{i % 250}", "") for i in range(2000)] + [("phone", f"{i:02d}", "") for i in range(40)]
    got = pii.assigned(spark.createDataFrame(rows, "kind string, norm string, gender string"), "k").collect()
    real = {(k, n) for k, n, _ in rows}
    assert len(got) == len(rows) and len({(r.kind, r.new) for r in got}) == len(rows) and not {(r.kind, r.new) for r in got} & real


@pytest.fixture()
def few_rounds(monkeypatch):
    made, table_of = [], pii.table_of

    def counted(df, name):
        made.append(name)
        assert len(made) < 60, "the redraw loop does not end"
        return table_of(df, name)

    monkeypatch.setattr(pii, "table_of", counted)


def test_redraw_ends_where_characters_leave_no_other(spark, few_rounds):
    values = ["********", "------", "....", "ひみつです", "**a*"]
    texts = [(i, f"password: {v}") for i, v in enumerate(values)]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    new = [got[i].text.removeprefix("password: ") for i in range(len(values))]
    assert len(set(new)) == len(values) and not set(new) & set(values) and all(got[i].n_replaced == 1 for i in got)
    assert [len(n) for n in new] == [len(v) for v in values] and all(re.fullmatch("[a-z0-9]+", n) for n in new[:4])


def test_redraw_ends_where_all_replacements_are_used(spark, few_rounds):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("secret", f"--{c}-", "") for c in letters] + [("phone", f"{i:02d}", "") for i in range(100)] + [("email", f"{c}@-.co", "") for c in letters]
    got = pii.assigned(spark.createDataFrame(rows, "kind string, norm string, gender string"), "k").collect()
    real = {(k, n) for k, n, _ in rows}
    assert len(got) == len(rows) == len({(r.kind, r.new) for r in got}) and not {(r.kind, r.new) for r in got} & real
    assert all(re.fullmatch(r"[a-z]+@-\.co", r.new) for r in got if r.kind == "email") and all(r.new.isdigit() for r in got if r.kind == "phone")


def test_secrets_of_any_length_are_replaced_whole(spark):
    dice = random.Random(3)
    key = {n: "".join(dice.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(n)) for n in (201, 300, 5000)}
    bodies = [f(v) for v in key.values() for f in ("token={}".format, 'secret = "{}"'.format, "password: '{}'".format, "ghp_{}".format, "sk-{}".format)]
    bodies += ["sk-proj-" + key[201][:60] + "_" + key[300][:60] + "-" + key[300][60:90], "ghp_" + key[201][:20] + "_" + key[201][20:40]]
    got = {r.i: r for r in pii.replace_entities(spark.createDataFrame(list(enumerate(f"a {b} z" for b in bodies)), "i int, text string"), "k").collect()}
    for i, body in enumerate(bodies):
        new = got[i].text
        assert got[i].n_replaced == 1 and len(new) == len(body) + 4 and new.startswith("a ") and new.endswith(" z")
        value = re.search(r"[\w-]+(?=[\"']?$)", body)[0]
        assert not any(value[at : at + 12] in new for at in range(8, len(value) - 11))


def replaced(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_replaced) for r in pii.replace_entities(rows, "k").orderBy("doc_id").collect()]


def test_names_keep_their_family_and_gender(spark):
    (a, n), (b, _) = replaced(spark, "Mr Smith met John Smith, and Mr. Smith left. Smith's car was SMITH red; blacksmith.", "Mrs Smith and Dr. Smith")
    family = re.match(r"Mr (\p{Lu}\S+) met".replace(r"\p{Lu}", "[A-Z]"), a)[1]
    given = re.search(r"met (\S+) ", a)[1]
    assert family != "Smith" and a == f"Mr {family} met {given} {family}, and Mr. {family} left. {family}'s car was SMITH red; blacksmith." and n == 4
    assert given in pii.GIVEN_NAMES["latin", "m"] and given != "John" and b == f"Mrs {family} and Dr. {family}"


def test_names_beyond_the_list_are_found_by_context(spark):
    got = replaced(spark, "Zorbla Quenn and Tariq Khan met here", "a man named Bork Vandel, and Bork Vandel slept", "the Apache License of New York", "Carol Jones was there")
    assert not re.search("Zorbla|Quenn|Khan", got[0][0]) and "Vandel" not in got[1][0] and "Jones" not in got[3][0]
    assert got[2] == ("the Apache License of New York", 0)


def test_numbers_without_a_right_check_digit_are_no_cards(spark):
    (a, n), (b, m) = replaced(spark, "number 12345678901234 here", "card 4539148803436467 and 4539148803436468")
    assert (a, n, m) == ("number 12345678901234 here", 0, 1) and "4539148803436467" not in b and "4539148803436468" in b


def test_surrogates_need_a_key_that_decides(spark):
    docs = spark.createDataFrame([(1, "Mr Smith at 10.1.2.3", 7)], "doc_id long, text string, n_replaced int")
    one, other = (pii.replace_entities(docs, k).first() for k in ("k", "l"))
    assert one.text != other.text and one.n_replaced == 2 and len(one) == 3
    with pytest.raises(ValueError):
        pii.replace_entities(docs, "")


def test_distinct_over_whole_texts(spark):
    dice = random.Random(9)
    mails = [f"{dice.choice(WORDS)}.{i}@m.example.org" for i in range(300)]
    texts = [" ".join(dice.sample(mails, 8)) for _ in range(200)]
    got = replaced(spark, *texts)
    new = {}
    for t, (g, n) in zip(texts, got, strict=True):
        assert n == 8
        for a, b in zip(t.split(), g.split(), strict=True):
            assert new.setdefault(a, b) == b
    assert len(set(new.values())) == len(new) and not set(new.values()) & set(new)


# -- language


def test_language_against_plain_parse():
    samples = {"a": "the cat sat on the mat and the rat " * 5, "b": "le chat est sur la table et le rat " * 5}
    parser = language_id.CrossParser(samples)

    def pieces(text, sample):
        text, n, at = "".join(map(chr, language_id.simplified(text))), 0, 0
        sample = "".join(map(chr, language_id.simplified(sample)))
        for begin in range(0, len(text), language_id.STRETCH):
            part, at = text[begin : begin + language_id.STRETCH], 0
            while at < len(part):
                end = at + 1
                while end < len(part) and part[at : end + 1] in sample:
                    end += 1
                n, at = n + 1, end
        return n

    for text in ["the cat est sur", "zzz", "the table and the chat", "rat " * 200]:
        codes = language_id.simplified(text)
        assert parser.pieces([codes])[0].tolist() == [pieces(text, samples[k]) for k in parser.langs]


def test_large_alphabets_take_memory_by_the_sample():
    samples = {"a": "".join(map(chr, range(0x4E00, 0x4E00 + 6000))), "b": "".join(map(chr, range(0x6800, 0x6800 + 6000)))}
    parser = language_id.CrossParser(samples)
    assert len(parser.table.keys) <= 1 << 18
    found = parser.pieces([language_id.simplified(samples["b"][3000:3100] + samples["b"][:50]), language_id.simplified("abc")])
    assert found.tolist() == [[150, 2], [3, 3]]


def test_language_sample_takes_stretches_of_texts_with_letters(spark):
    rows = [(i, "long " * 20000 if i == 0 else "" if i % 2 else f"short{'abc'[i % 3]} text {chr(97 + i % 26) * 3}", "x") for i in range(300)]
    got = language_id.sample_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 48, 24_000)
    assert got["x"].count("long") <= 900 and got["x"].count("short") >= 40


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.op2_cross_parsing(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


# -- edit fingerprints


def test_edit_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in edit_fingerprints.edit_fingerprints(docs).collect()}
    text = dict(docs.select("doc_id", "text").collect())
    ids = sorted(text)
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        k = len(text[a]) // 4
        edited = text[a][: len(text[a]) - k] + text[b][:k]
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[a].n_chars == len(text[a])
        assert got[a].edited_fingerprint == str(edit_fingerprints.fingerprints([edited])[0])
    assert sum(r.near_edited > r.near_next for r in got.values()) >= len(got) - 2
    assert all(len({got[i].fingerprint for i in ids if text[i] == t}) == 1 for t in set(text.values()))


def test_walk_is_the_embedding():
    codes = np.frombuffer("some text to walk over".encode("utf-32-le"), np.uint32)
    begins, ends = edit_fingerprints.walk([codes], np.zeros(1, np.int64))
    classes = edit_fingerprints._classes(codes)
    j = 0
    for i, c in enumerate(classes):
        assert begins[0][i] == j
        j += edit_fingerprints._COPIES[c * edit_fingerprints._PERIOD + j % edit_fingerprints._PERIOD]
    assert ends[0] == j


def edited_texts():
    """A group of near copies, a chain of small steps, unlike texts, copies and texts without characters."""
    dice = random.Random(21)

    def changed(text, edits):
        for _ in range(edits):
            at = dice.randrange(len(text))
            text = text[:at] + dice.choice(["", "x", " zu"]) + text[at + dice.randrange(2) :]
        return text

    base = " ".join(dice.choice(WORDS) + str(dice.randrange(50)) for _ in range(120))
    texts = [changed(base, dice.randrange(12)) for _ in range(150)]
    chain = " ".join(dice.choice(WORDS) + str(dice.randrange(50)) for _ in range(60))
    for _ in range(25):
        texts.append(chain := changed(chain, 4))
    texts += [" ".join(dice.choice(WORDS) for _ in range(dice.randrange(1, 40))) for _ in range(60)]
    return [*texts, *texts[:5], "", None, ""]


def test_near_edits_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(edit_fingerprints, "BLOCK", 8)
    texts = edited_texts()
    prints = edit_fingerprints.fingerprints([t or "" for t in texts])
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    links = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if texts[a] and texts[b] and edit_fingerprints.likeness(prints[a], prints[b]) >= 0.8:
            p, q = sorted((root(a), root(b)))
            part[q], links = p, links + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.component_id, r.kept) for r in edit_fingerprints.near_edits(docs).collect()}
    assert got == {i: (root(i), root(i) == i) for i in range(len(texts))}
    assert links > 150 and len({c for c, _ in got.values()}) > 20


def test_bands_are_shared_as_often_as_likeness_says():
    prints = [f for f in edit_fingerprints.fingerprints([t or "" for t in edited_texts()]) if f.length]
    keys = [set(f.bands().tolist()) for f in prints]
    near = missed = far = met = 0
    for a, b in itertools.combinations(range(len(prints)), 2):
        alike, shared = edit_fingerprints.likeness(prints[a], prints[b]), bool(keys[a] & keys[b])
        near, missed = near + (alike >= 0.8), missed + (alike >= 0.8 and not shared)
        far, met = far + (alike < 0.3), met + (alike < 0.3 and shared)
    assert near > 150 and missed <= 0.01 * near and far > 1000 and met <= 0.02 * far
    assert all(str(edit_fingerprints.Fingerprint.parsed(str(f))) == str(f) for f in prints)


# -- language-model scoring


@pytest.mark.parametrize("bits", [22, 3, 0])  # all grams of training in the broadcast table, few of them, none but a lone one
def test_ppm_follows_the_definition(spark, monkeypatch, bits):
    monkeypatch.setattr(lm_scoring, "GRAM_BITS", bits)
    texts = [b"abracadabra", b"abrakadabra", b"banana"]
    joined = Counter()
    for t in texts:
        s = lm_scoring._PAD + t + b"\0"
        for i in range(len(lm_scoring._PAD), len(s)):
            for k in range(lm_scoring.ORDER + 1):
                joined[s[i - k : i + 1]] += 1

    def prob(context, symbol):
        out, excluded = 0.0, set()
        for k in range(min(len(context), lm_scoring.ORDER), -1, -1):
            c = context[len(context) - k :]
            after = {g[-1]: n for g, n in joined.items() if len(g) == k + 1 and g[:-1] == c and g[-1] not in excluded}
            if not after:
                continue
            total = sum(after.values())
            if symbol in after:
                return out + math.log10((after[symbol] - 0.5) / total)
            out += math.log10(len(after) / (2 * total))
            excluded |= set(after)
        return out - math.log10(256 - len(excluded))

    assert abs(sum(10 ** prob(b"\0\0abr", x) for x in range(256)) - 1) < 1e-9
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate([*texts, b"bandana", b"xyz", b"", b"Abrabandacad zz"])], "doc_id long, text string")
    got = lm_scoring.score_documents(docs, docs.where("doc_id < 3"), F.lit(False)).collect()
    text = dict(docs.collect())
    assert len(got) == 7
    for r in got:
        s = lm_scoring._PAD + text[r.doc_id].lower().encode() + b"\0"
        want = sum(prob(s[:i], s[i]) for i in range(len(lm_scoring._PAD), len(s)))
        assert abs(r.score - want) < 1e-4


def test_gram_table():
    dice = np.random.default_rng(2)
    codes = np.unique(dice.integers(0, 1 << 48, 5000))
    table = lm_scoring.GramTable(codes[::2], np.arange(len(codes[::2])).astype(np.float32))
    found, missing = table.look_up(codes)
    assert missing.tolist() == list(range(1, len(codes), 2)) and found[::2].tolist() == list(range(len(codes[::2])))


def test_base_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.op4_ppm(spark, SF).collect()}
    tokens = {r.doc_id: [*r.text.encode().lower().split(), b""] for r in docs.collect()}
    counts = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t)
    n, v = counts.total(), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) < 1e-6


# -- near duplicates


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    part = {i: i for i in texts}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((root(a), root(b)))
            part[q] = p
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_near_duplicates_with_a_large_group_of_near_copies(spark):
    dice = random.Random(11)
    base = [dice.choice(WORDS) + str(dice.randrange(50)) for _ in range(300)]
    texts = {}
    for i in range(150):  # one group, with copies that are not all alike
        w = list(base)
        for _ in range(dice.randrange(9)):
            w[dice.randrange(300)] = f"x{dice.randrange(10**6)}"
        texts[i] = " ".join(w)
    chain = list(base[:200])
    for i in range(150, 190):  # a chain: each a small step from the one before
        chain[(i * 7) % 200] = f"y{i}"
        texts[i] = " ".join(chain)
    for i in range(190, 260):
        texts[i] = " ".join(dice.choice(WORDS) for _ in range(dice.randrange(0, 30)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == brute_components(texts, 3, 85)


def test_ids_that_repeat_with_unlike_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a), (3, b + " c"), (3, b + " c"), (None, a), (5, None)]
    got = [tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).orderBy("doc_id", "n_shingles").collect()]
    assert got == [(None, 38, None, True), (1, 38, 1, True), (1, 38, 1, True), (2, 38, 1, False), (3, 39, 1, False), (3, 39, 1, False), (5, 0, 5, True)]


def test_register_estimates():
    dice = np.random.default_rng(1)
    pool = dice.integers(0, 2**63, 3000).astype(np.uint64)
    for shared in (500, 1500, 2500):
        a, b = pool[: (3000 + shared) // 2], pool[(3000 - shared) // 2 :]
        got = near_dedup.estimate(near_dedup.registers_of(np.unique(a)), near_dedup.registers_of(np.unique(b)))
        assert abs(float(got) - shared / 3000) < 0.15


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# -- packing


def test_packing(spark, odd):
    for docs in (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = packing.pack(docs, BYTE).collect()
        tokenizer = Tokenizer.from_file(BYTE)
        pieces = {}
        for r in docs.collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
            head = len(ids) % 2048 or 2048
            cuts = [0, *range(head, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                pieces[r.doc_id, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
        assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == pieces
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in by.values():
            at = 0
            for offset, n in sorted(s):
                assert offset == at
                at += n
            assert at <= 2048
        assert len(by) <= 1.02 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def fewest_bins(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_evolution_keeps_every_piece_once():
    dice = random.Random(2)
    sizes = [dice.randrange(300, 1500) for _ in range(400)]
    best = packing.evolve(sizes, 2048, 1)
    assert sorted(i for b in best for i in b) == list(range(400)) and all(sum(sizes[i] for i in b) <= 2048 for b in best)
    assert packing.evolve(sizes, 2048, 3, [best]) is not best and len(packing.evolve(sizes, 2048, 3, [best])) <= len(best)
    for seed in range(12):  # the optimum on small tables
        few = [dice.randrange(300, 1500) for _ in range(7)]
        assert len(packing.evolve(few, 2048, seed)) == fewest_bins(few, 2048)
    plain = packing.best_fit([], sorted(range(400), key=lambda i: -sizes[i]), sizes, 2048)
    assert len(best) <= len(plain)


def test_byte_bpe_on_odd_texts():
    encode, tokenizer = packing.ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    for t in ["", "a<|endoftext|>b", "tabs\t\t and nbsp  em\x1c\x1d\x85 end  ", "é 你好\r\n\r\n x", "'s 'LL they're", " \n \n x"]:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# -- BPE


def test_word_bpe_round_trip():
    coder, tokenizer = bpe.WordBpe(WORD), Tokenizer.from_file(WORD)
    dice = random.Random(7)
    pool = ["a", "aa", "b", "th", "ing", " ", "  ", "\n", "É", "İ", "Σ", "ς", "ß", "你", "😀", "1", "23", "'s", "'ll", "...", "!?", "é", "Å", "<|endoftext|>", "<|", "\x1c", "　", "​"]
    texts = ["".join(dice.choices(pool, k=30)) for _ in range(1500)] + ["mississippi hahahahaha aaaaaaaaaaaaaa"]
    for t in texts:
        e = tokenizer.encode(t, add_special_tokens=False)
        ids = coder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert coder.decode(ids) == tokenizer.decode(e.ids, skip_special_tokens=False)


def test_token_automaton_finds_all_tokens_at_every_place():
    dice = random.Random(11)
    strings = {"".join(dice.choices("abc", k=dice.randint(1, 6))): i for i, _ in enumerate(range(60))}
    automaton = bpe.TokenAutomaton(strings)
    assert sorted(t for t in automaton.token if t >= 0) == sorted(strings.values())
    text, state, matched = "".join(dice.choices("abcd", k=4000)), 0, 0
    for e, c in enumerate(text, 1):
        while c not in automaton.moves[state] and state:
            state = automaton.link[state]
            matched = automaton.length[state]
        state, matched = (automaton.moves[state][c], matched + 1) if c in automaton.moves[state] else (0, 0)
        v, found = state if matched == automaton.length[state] and automaton.token[state] >= 0 else automaton.up[state], []
        while v:
            found.append(automaton.token[v])
            v = automaton.up[v]
        assert found == [strings[text[e - k : e]] for k in range(6, 0, -1) if k <= e and text[e - k : e] in strings]


def test_word_bpe_remembers_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 20_000)
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 50)
    coder, tokenizer, dice = bpe.WordBpe(WORD), Tokenizer.from_file(WORD), random.Random(12)
    for _ in range(300):
        t = " ".join("".join(dice.choices("abetin你", k=dice.choice([2, 5, 300]))) for _ in range(10))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert coder._known_bytes <= 20_000 and len(coder._holds) <= 50 and all(len(u) <= bpe.KNOWN_CHARS for u in coder._known)
    long = "abet" * 300_000  # one word of 1.2 MB
    assert np.frombuffer(coder.encode(long), "<u4").tolist() == tokenizer.encode(long, add_special_tokens=False).ids


# -- embeddings


def test_embeddings(spark):
    dice = np.random.default_rng(3)
    base = dice.normal(size=(120, 16))
    vecs = [*base.tolist(), *(base[:30] + 0.05 * dice.normal(size=(30, 16))).tolist(), *([base[0].tolist()] * 4), (3 * base[1]).tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0] * 5]
    rows = [(i, v, "x") for i, v in enumerate([*vecs, *odd])] + [(None, vecs[0], "x")]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec string")).collect()}
    x = np.array(vecs)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    assert [got[i].n_links for i in range(len(vecs))] == (near.sum(axis=1) - 1).tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(len(vecs), len(vecs) + len(odd)))
    assert got[0].component_id == 0 and got[150].component_id == 0 and not got[150].kept and got[None].component_id is None
    none = embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert none.count() == 0


def test_large_leaves_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    dice = np.random.default_rng(4)
    vecs = (np.ones((90, 8)) + 0.01 * dice.normal(size=(90, 8))).tolist()
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {89}


def test_forest_keeps_the_links_of_a_large_tight_group():
    dice = np.random.default_rng(6)
    center = dice.normal(size=64)
    x = np.concatenate([center / np.linalg.norm(center) + np.sqrt(0.035 / 64) * dice.normal(size=(10_000, 64)), dice.normal(size=(20_000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = dice.integers(0, 10_000, (2, 20_000))
    linked = (a != b) & ((x[a] * x[b]).sum(axis=1) >= 0.95)
    assert linked.sum() > 10_000
    met = np.zeros(len(a), bool)
    for tree in embedding_dedup.fit_forest(x, len(x)):
        rows, nodes = tree.leaves(x)
        reached = set(zip(rows.tolist(), nodes.tolist(), strict=True))
        of: dict[int, list[int]] = {}
        for row, node in zip(rows.tolist(), nodes.tolist(), strict=True):
            of.setdefault(row, []).append(node)
        met |= np.array([any((q, node) in reached for node in of[p]) for p, q in zip(a.tolist(), b.tolist(), strict=True)])
    assert met[linked].mean() >= 0.9


def test_vectors_link_within_their_length_and_ids_may_repeat(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.0]), (5, [3.0, -1.0, 0.5]), (6, [0.0, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.01])]
    got = [tuple(r) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("vec_id", "n_links").collect()]
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (6, 1, 6, True), (7, 1, 6, False)]


@pytest.mark.parametrize("sample", [32_768, 512])  # splits of the first fit alone, then in rounds of their own
def test_recall_near_the_threshold(spark, monkeypatch, sample):
    monkeypatch.setattr(embedding_dedup, "SAMPLE", sample)
    monkeypatch.setattr(embedding_dedup, "LEAF", 24)
    dice = np.random.default_rng(8)
    base = dice.normal(size=(4000, 32))
    near = base[:3000] + dice.uniform(0.2, 0.34, size=(3000, 1)) * dice.normal(size=(3000, 32))  # cosines about 0.95 to 0.98
    x = np.concatenate([base, near])
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and want.sum() > 3000 and found.sum() >= 0.97 * want.sum()


# -- toxicity


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.op9_counterfactual(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == 1 and r.toxic == 0 for r in got) <= 0.02 * len(got)
    assert sum(r.predicted == 1 for r in got if r.toxic == 1) >= 0.4 * sum(r.toxic == 1 for r in got)  # few labels here; a tenth of the marked texts show no sign at all


def test_identity_terms_alone_do_not_decide(spark):
    dice = random.Random(1)
    rows, marks = [], []
    for i in range(240):
        bad = i % 2
        group = "muslim" if bad or dice.random() < 0.1 else "christian"  # a biased sample
        rows.append((i, f"{' '.join(dice.choice(WORDS) for _ in range(6))} {group} people {'idiot scum' if bad else 'neighbours friends'}"))
        marks.append((i, bad))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.learnable)
    assert abs(model.score("the muslim people alpha") - model.score("the christian people alpha")) < 0.1
    assert model.score("muslim people idiot scum") > 0.7 > model.score("muslim people friends")


# -- shards


def test_shards(spark):
    docs = spark.createDataFrame([(i, "t" * (i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(1000)], "doc_id long, text string, source string")
    got = sharding.interleave_shards(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        assert abs(sum(r.source == "big" for r in got if r.shard == s) - sizes[s] * 666 / 1000) <= 3
    assert all(r.size == 8 + r.doc_id % 7 and r.text_crc32 == zlib.crc32(b"t" * (r.doc_id % 7)) for r in got)
