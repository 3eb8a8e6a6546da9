"""The whole way: a run that is cut after any stage, a stage half written, chapters that come later, odd chapters."""

import pytest

from loomtext import flow
from loomtext.operators import chains


def _chapters(spark):
    texts = [(i, " ".join(f"Sentence {k} of chapter {i} is {'long ' * (k % 4)}here." for k in range(40))) for i in (1, 2, 5)]
    return spark.createDataFrame([*texts, (7, None), (8, ""), (None, "no id"), (1, texts[0][1]), (9, "One.")], "chapter_id long, text string")


@pytest.fixture(scope="module")
def settings():
    def client(messages, options):
        last = messages[-1]["content"]
        if messages[0]["content"].startswith("Shorten"):
            return messages[1]["content"][:: sum(m["role"] == "assistant" for m in messages) + 2]
        if last.startswith("Say what"):
            return "look"
        return '{"issues": [{"severity": "minor", "problem": "p"}]}' if len(last) % 2 and len(messages) < 4 else "fine"

    return flow.Settings(fragment_tokens=60, group_tokens=200, snake_tokens=80, max_clues=3, max_iterations=2, client=client)


class Cut(Exception):
    pass


class CutFlow(flow.Flow):
    """Stops after every stage that it writes."""

    def stage(self, batch, name, build):
        had = self.done(batch, name)
        out = super().stage(batch, name, build)
        if not had:
            raise Cut(name)
        return out


def _texts(df):
    return sorted((r.chapter_id, r.text) for r in df.collect())


def test_a_run_cut_after_any_stage_goes_on(spark, tmp_path, settings):
    whole = _texts(flow.Flow(spark, str(tmp_path / "whole"), settings).run(_chapters(spark)))
    assert [i for i, _ in whole] == [1, 2, 5, 7, 8, 9] and all(t for i, t in whole if i in (1, 2, 5, 9)) and not any(t for i, t in whole if i in (7, 8))
    stopped, half = [], tmp_path / "cut" / "batch=0" / "edges"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_text("a task's file of a job that never ended")
    while len(stopped) < 30:
        try:
            got = CutFlow(spark, str(tmp_path / "cut"), settings).run(_chapters(spark))
            break
        except Cut as name:
            stopped.append(str(name))
    assert stopped == ["chapters", "sentences", "extracted", "chunks", "edges", "incisions", "groups", "members", "clues", "marked", "compressed", "texts"]
    assert _texts(got) == whole

    again = flow.Flow(spark, str(tmp_path / "whole"), settings)
    more = spark.createDataFrame([(2, "another text of a chapter that is known."), (20, "Twenty begins. It goes on. It ends.")], "chapter_id long, text string")
    later = _texts(again.run(more))
    assert again.batches() == [0, 1] and [t for t in later if t[0] != 20] == whole and later[-1][0] == 20 and later[-1][1]
    assert _texts(flow.Flow(spark, str(tmp_path / "whole"), settings).run()) == later
    assert again.run(more.limit(0)).count() == len(later) and again.batches() == [0, 1]


def test_no_chapters(spark, tmp_path):
    assert flow.Flow(spark, str(tmp_path / "none")).run(spark.createDataFrame([], "chapter_id long, text string")).count() == 0


def test_fingerprints_over_unlike_vertices_are_found(spark):
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6)], "id long, component long")
    prints = [(a, b, 0.5) for a in (1, 2) for b in (1, 2)] + [(3, 3, 1.0), (4, 3, 0.5), (4, 4, 0.5), (5, 5, 1.0), (6, 6, 0.5), (6, 7, 0.5)]
    got = chains.invalid_components(spark.createDataFrame(prints, "source_id long, id long, ink double"), parts).collect()
    assert sorted((r.component, r.n_sources, r.n_sets) for r in got) == [(3, 2, 2), (6, 1, 1)]
