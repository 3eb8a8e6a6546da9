"""Entities of any length, and classes whose digests have one half in common."""

import re

from loomtext.llm import pii
from loomtext.llm.common import with_ids


def test_mails_with_many_labels_and_odd_ends(spark):
    many = "x a@" + "b." * 1_000_000
    texts = [(1, "x a@" + "b." * 2000 + "com y"), (2, "x a@" + "b." * 20_000 + "com y"), (3, many + "com y"), (4, many + " y"), (5, "mail a@bb.com-x, c@d.ee.org. Next f@g..com, h@mail.ii.com... and k@m.co.uk.")]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    assert [got[i].n_replaced for i in range(1, 6)] == [1, 1, 1, 0, 4]
    assert len(got[3].text) == len(texts[2][1]) and got[3].text.endswith(".com y") and got[4].text == texts[3][1]
    assert re.fullmatch(r"mail \w@\w\w\.com-x, \w@\w\.\w\w\.org\. Next f@g\.\.com, \w@\w{4}\.\w\w\.com\.\.\. and \w@\w\.\w\w\.uk\.", got[5].text)


def test_long_secrets_and_names(spark):
    texts = [(1, "secret = " + "aB3" * 200_000 + " end"), (2, "Hello Maria " + "A" * 500_000 + " end")]
    got = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    assert re.fullmatch(r"secret = (?:[a-z][A-Z]\d){200000} end", got[1]) and got[1] != texts[0][1]
    assert len(got[2].split(" ")[2]) == 500_000 and "AAAAAAAA" not in got[2]


def test_classes_with_half_a_digest_in_common_are_apart(spark):
    rows = [(7, 1, "x"), (7, 2, "y"), (8, 1, "z")]
    got = with_ids(spark.createDataFrame(rows, "digest_a long, digest_b long, v string"), "halves").collect()
    assert len({r.id for r in got}) == 3 and sorted(r.v for r in got) == ["x", "y", "z"] and {r.v: r.id for r in got}["z"] == 8
    apart = with_ids(spark.createDataFrame(rows[1:], "digest_a long, digest_b long, v string"), "halves").collect()
    assert {r.id for r in apart} == {7, 8}
