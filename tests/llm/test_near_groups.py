"""Near duplicates: sketches of sets, and what a large group of unlike copies leaves to confirm."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import near_dedup
from loomtext.llm.near_dedup import Sketch


def similarity(x, y):
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


@pytest.mark.parametrize("n", [1, 40, 1500, 2048, 2049, 4000, 4096, 4097, 9000, 40000])
def test_sketches_lose_no_link(n):
    rng = np.random.default_rng(n)
    base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    for share in (0.0, 0.03, 0.08, 0.09, 0.12, 0.3):
        k = int(share * n)
        other = np.unique(np.concatenate([rng.permutation(base)[: len(base) - k], rng.integers(0, 1 << 64, k, dtype=np.uint64)]))
        for x, y in ((base, other), (base, np.sort(rng.permutation(other)[: max(1, len(other) * 9 // 10)]))):
            true = similarity(x, y)
            like, passed = Sketch(Sketch.of(x)).most_alike(Sketch(Sketch.of(y)), 85)
            assert passed or true < 0.85
            assert n > 4096 or not passed or like >= true
            assert true > 0.75 or not passed  # and tells what is far off
    assert len(Sketch.of(base)) <= 12 + 4 * 4400


def test_a_group_of_unlike_copies_leaves_few_pairs_to_confirm(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]

    def copy(edits):
        words = list(base)
        for k in rng.sample(range(150), edits):
            words[k] = f"x{rng.randrange(10**9)}"
        return " ".join(words)

    texts = [copy(4 if k % 3 else 2) for k in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingles = [near_dedup.Shingler(3)(t) for t in texts]
    labels = list(range(len(texts)))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(shingles[a], shingles[b]) >= 0.85]
    while any(labels[a] != labels[b] for a, b in links):
        for a, b in links:
            labels[a] = labels[b] = min(labels[a], labels[b])
    rows = []
    written = near_dedup.table_of

    def counted(df, name):
        out = written(df, name)
        rows.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(near_dedup, "table_of", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got == dict(enumerate(labels))
    assert 50 < len(set(labels)) < 200  # many are apart, though most of all pairs are near the threshold
    assert sum(rows) < 6 * len(texts)


def test_texts_of_ids_by_bitmap(spark):
    texts = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    found = {int(r.text) for r in near_dedup.docs_of(texts, spark.range(0, 5000, 7).select(F.col("id").alias("lowest"))).collect()}
    assert set(range(0, 5000, 7)) <= found and len(found) < 800
