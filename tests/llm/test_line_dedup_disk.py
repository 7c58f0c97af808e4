"""Line dedup: what it leaves on disk, and how often whole token sets travel."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, line_dedup


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(k).name() for k in range(blocks.size()) if "shuffle" in blocks.apply(k).name()}


def test_a_stored_table_frees_its_shuffle(spark):
    before = shuffle_files(spark)
    made = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # files go in the background
        if not shuffle_files(spark) - before:
            break
        spark._jvm.Thread.sleep(100)
    assert not shuffle_files(spark) - before
    assert sorted(made.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


@pytest.mark.parametrize("wide, lost", [(1, False), (4, True)])
def test_sets_travel_once_a_line(spark, monkeypatch, wide, lost):
    """Thirty similar lines make 435 pairs, of which 29 are enough. Where a line's nearest one is not similar (lost: as if it never were), the others tell."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    lines = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(30)]
    # a chain: each is similar to the one before only
    chain = [" ".join(f"c{k}" for k in range(4 * n, 4 * n + 80)) for n in range(12)]
    rows = list(enumerate(draw.sample(lines, len(lines)) + chain))
    asked, verified = [], line_dedup._verified

    def counted(pairs, sets, t):
        asked.append(pairs.count())
        return verified(pairs, sets, t).limit(0 if lost and len(asked) == 1 else 1000)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    monkeypatch.setattr(line_dedup, "WIDE", wide)
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = []
    for n, (i, text) in enumerate(rows):
        own = set(text.split())
        kept += [i] if all(len(own & set(x.split())) * 10 < 9 * len(own | set(x.split())) for _, x in rows[:n]) else []
    assert kept == [0, 30]
    # what was lost is not asked for again, so lines of one pair stay then
    assert sorted(r.doc_id for r in found if r.n_removed == 0) == ([0, 1, *range(30, 42)] if lost else kept)
    assert asked[0] == 40 and (len(asked) == 2 if lost else sum(asked) < 60)


def test_the_pipeline_holds_one_stage_at_a_time(spark, sf, monkeypatch):
    import corpus_pipeline

    folder = pathlib.Path(common.checkpoint_dir(spark).removeprefix("file:"))
    before, seen = set(folder.iterdir()), []

    def watched(stage):
        def run(spark, docs, sf_dir):
            seen.append({p.name.rpartition("-")[2] for p in set(folder.iterdir()) - before if p.name.startswith(("pipeline-", "table-"))})
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    found = corpus_pipeline.run(spark, sf)
    assert seen == [set(), *({name} for name, _ in corpus_pipeline.STAGES[:-1])]
    assert found.count() > 0
