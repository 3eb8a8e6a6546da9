"""Merging of clues by a heap gives what trying all pairs for each merge gives."""

import copy
import random
import time

import pytest

from loomtext.operators import clues


def by_all_pairs(rows, max_clues):
    rows, made = sorted(rows, key=lambda c: (-c["weight"], c["clue_id"])), 0
    while len(rows) > max_clues:
        rows.sort(key=lambda c: -c["weight"])
        late = rows[int(max_clues * clues.HEAD_SHARE) :]
        if len(late) < 2:
            break
        _, i, j = max((len(a["fragments"] & b["fragments"]), -i, -j) for i, a in enumerate(late) for j, b in enumerate(late) if i < j)
        a, b = late[-i], late[-j]
        made += 1
        one = {"clue_id": -made, "weight": a["weight"] + b["weight"], "sources": a["sources"] + b["sources"], "chunks": sorted(a["chunks"] + b["chunks"], key=lambda c: c[0]), "fragments": a["fragments"] | b["fragments"]}
        rows = [c for c in rows if c is not a and c is not b] + [one]
    total = sum(c["weight"] for c in rows)
    return [{**c, "weight": c["weight"] / total if total > 0 else c["weight"]} for c in sorted(rows, key=lambda c: -c["weight"])]


def some_clues(rng, n, fragments, weights):
    out = []
    for k in range(n):
        held = sorted(rng.sample(range(fragments), rng.randint(1, min(4, fragments))))
        out.append({"clue_id": k, "label": f"c{k}", "weight": rng.choice(weights), "sources": [k], "chunks": [((1, f, rng.randint(0, 3)), k * 100 + f) for f in held], "fragments": set(held)})
    for c in out:
        c["chunks"].sort()
    return out


@pytest.mark.parametrize("seed", range(60))
def test_same_as_all_pairs(seed):
    rng = random.Random(seed)
    rows = some_clues(rng, rng.randint(0, 40), rng.choice([1, 3, 12, 200]), rng.choice([[1.0], [0.0], [1.0, 2.0, 4.0], [float(x) for x in range(1, 60)]]))
    limit = rng.choice([1, 2, 4, 6, 10])
    fields = ("clue_id", "weight", "sources", "chunks", "fragments")
    want = [[c[f] for f in fields] for c in by_all_pairs(copy.deepcopy(rows), limit)]
    assert [[c[f] for f in fields] for c in clues.merged(rows, limit)] == want


def test_a_group_of_5000_chains():
    rows = some_clues(random.Random(5), 5000, 1500, [float(x) for x in range(1, 500)])
    start = time.monotonic()
    got = clues.merged(rows)
    assert len(got) == 10 and sorted(s for c in got for s in c["sources"]) == list(range(5000))
    assert abs(sum(c["weight"] for c in got) - 1) < 1e-9
    assert time.monotonic() - start < 120


def test_clues_of_many_groups_run_in_batches(spark):
    """Groups are rows of arrays, not a pandas frame each; a chain's rows may come in any order."""
    chains_ = [(g, g * 100 + k, f"label {k}", 1.0 + k % 3, k) for g in (1, 2, 3) for k in range(5)]
    rows = [(g, s, label, w, s * 10 + j, g, (k + j) % 4, j) for g, s, label, w, k in chains_ for j in (1, 0, 2)]
    table = spark.createDataFrame(rows[::-1], "group_id int, snake_id long, label string, weight double, chunk_id long, chapter_id long, fragment_id int, sentence_index int")
    found = clues.merge_clues(table, ["group_id"], max_clues=3)
    assert "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for g in (1, 2, 3):
        given = [
            {"clue_id": s, "label": label, "weight": w, "sources": [s], "chunks": sorted(((g, (k + j) % 4, j), s * 10 + j) for j in range(3)), "fragments": {(g, (k + j) % 4) for j in range(3)}}
            for h, s, label, w, k in chains_ if h == g
        ]
        want |= {(g, c["clue_id"], c["label"], round(c["weight"], 9), tuple(i for _, i in c["chunks"]), tuple(c["sources"]), n) for n, c in enumerate(clues.merged(given, 3))}
    got = {(r.group_id, r.clue_id, r.label, round(r.weight, 9), tuple(r.chunk_ids), tuple(r.source_snake_ids), r["rank"]) for r in found.collect()}
    assert got == want and len(got) == 9
    assert clues.merge_clues(table.limit(0), ["group_id"]).count() == 0
