"""Values at places of running orders are what sorting every prefix gives."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import weights
from loomtext.operators.running_order import RunningOrder


@pytest.mark.parametrize(("seed", "kinds"), [(1, 5), (2, 700), (3, 40)])
def test_places_of_every_prefix(spark, seed, kinds):
    rng = random.Random(seed)
    some = [rng.uniform(1e-9, 1e9) for _ in range(kinds)]
    chapters = sorted(rng.sample(range(10_000), 60))
    rows = [(c, rng.choice(some)) for c in chapters if c % 5 for _ in range(rng.randint(0, 30))] + [(chapters[7], some[0])] * 400  # some chapters have none, one many
    rows += [(chapters[0], None), (chapters[0], 0.0)]
    order = RunningOrder.of(spark.createDataFrame(rows, "chapter_id long, v double"), spark.createDataFrame([(c,) for c in chapters], "chapter_id long"))
    asked = spark.createDataFrame([(c, s) for c in chapters for s in (0.0, 0.5, 0.98)], "chapter_id long, share double")
    got = {(r.chapter_id, r.share): (r.v, r.less) for r in order.at(asked, F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1)).collect()}
    want = {}
    for c in chapters:
        upto = sorted(v for k, v in rows if k <= c and v)
        for s in (0.0, 0.5, 0.98):
            if upto:
                v = upto[min(int(len(upto) * s), len(upto) - 1)]
                want[c, s] = (v, sum(x < v for x in upto))
    assert got == want


def test_no_values(spark):
    order = RunningOrder.of(spark.createDataFrame([], "chapter_id long, v double"), spark.createDataFrame([(1,)], "chapter_id long"))
    assert order.at(spark.createDataFrame([(1,)], "chapter_id long"), F.col("n") - 1).count() == 0


@pytest.mark.parametrize("scope", ["corpus", "chapter", "prefix"])
def test_levels_of_one_value_and_of_none(spark, scope):
    rows = spark.createDataFrame([(1, 0, 3.0, 0.0), (2, 0, 0.0, 0.0)], "chapter_id long, fragment_id int, start_incision double, end_incision double")
    got = weights.incision_levels(rows, scope=scope).orderBy("chapter_id").select("start_level", "end_level").collect()
    assert [tuple(r) for r in got] == [(10, 0), (0, 0)]


def test_unknown_scope(spark):
    with pytest.raises(ValueError, match="scope"):
        weights.incision_levels(spark.createDataFrame([], "chapter_id long, fragment_id int, start_incision double, end_incision double"), scope="book")
