import zlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import decontaminate, near_dedup, quality_classifier  # noqa: E402
from tessera.llm.common import materialise, release, table  # noqa: E402


def test_stages(spark, sf):
    """Each stage against a plain account of what it should keep of its own input."""
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        after = materialise(stage(spark, before, sf))
        got, had = after.collect(), {r.doc_id: r.text for r in before.collect()}
        assert set(r.doc_id for r in got) <= set(had) and all(had[r.doc_id] == r.text for r in got)
        kept = {r.doc_id for r in got}
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == columns
        if k == 0:
            scores = quality_classifier.quality_scores(before, table(spark, sf, "labels")).collect()
            assert kept == {r.doc_id for r in scores if r.predicted}
            bad = {r.doc_id for r in table(spark, sf, "labels").filter("quality = 0").collect()}
            assert len(kept & bad) <= 0.1 * len(bad)
        elif k == 1:
            groups = near_dedup.near_duplicates(before, 80).collect()
            assert kept == {r.component_id for r in groups} and len(got) == len(kept)
        elif k == 2:
            dirty = {r.doc_id for r in decontaminate.contamination(before, table(spark, sf, "benchmark")).collect() if r.contaminated}
            assert kept == set(had) - dirty
        elif k == 4:
            assert after.columns == [*columns, "shard", "slot"] and len(got) == before.count()
            sizes = [sum(r.shard == s for r in got) for s in range(16)]
            assert max(sizes) - min(sizes) <= 1
        before = after


def test_run_is_repeatable(spark, sf):
    key = lambda df: sorted((r.doc_id, zlib.crc32(r.text.encode())) for r in df.collect())
    first, second = key(pipeline.run(spark, sf)), key(pipeline.run(spark, sf))
    assert first and first == second
    release(spark)
