"""The corpus pipeline end to end, stage by stage."""

from collections import defaultdict

import corpus_pipeline
import pytest

from eqpanel.llm import jaccard, packing, pii, quality, spans


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_pipeline_equals_its_stages(spark, sf, given):
    docs, labels = given
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "substring_dedup", "personal_data", "packing"]
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in quality.judge(docs, labels).collect() if r.kept}
    good = docs.filter(docs.doc_id.isin(list(kept)))
    # one document of each component stays, the smallest
    classes = {r.doc_id: r.component_id for r in jaccard.classes(good).collect()}
    left = {d for d, c in classes.items() if d == c}
    assert {r.doc_id for r in rows} == left and 0 < len(left) < docs.count()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for parts in pieces.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total


def test_stages_keep_columns_and_take_effect(spark, sf, given):
    docs, _ = given
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in at.collect()}
        at = spark.createDataFrame(stage(spark, at, sf).collect(), docs.schema)
        assert at.columns == docs.columns
        after = {r.doc_id: r.text for r in at.collect()}
        assert after and set(after) <= set(before)
    assert not any(pii.base_spans(t or "") for t in after.values())
    # no long run of sentences is left in two documents
    seen = defaultdict(set)
    for d, t in before.items():
        for h, _, _ in spans.runs(t or ""):
            seen[h].add(d)
    assert max(map(len, seen.values())) == 1


def test_stages_on_odd_tables(spark, sf, given):
    docs, _ = given
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "x", "y", 0), (1, "", None, None, None), (2, "a b c", "x", None, 5)], docs.schema)
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            assert name == "packing" or out.columns == docs.columns
            out.collect()


def test_workers_do_not_keep_what_an_earlier_stage_remembered(spark, given):
    docs, labels = given
    # more tasks than workers, so that each worker gets some
    dealt = docs.repartition(64).cache()

    def left(batches):
        import gc
        import os

        import pyarrow as pa

        from eqpanel.llm.packing import Words

        for _ in batches:
            pass
        words = sum(len(o) for o in gc.get_objects() if isinstance(o, Words))
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([words], pa.int64())], names=["pid", "words"])

    def remembered():
        return max(r.words for r in dealt.select("doc_id").mapInArrow(left, "pid long, words long").collect())

    stages = [lambda: quality.kept_rows(dealt, labels).count(), lambda: jaccard.counted(dealt), lambda: spans.covered(dealt).count(), lambda: pii.clean_rows(dealt).write.format("noop").mode("overwrite").save()]
    for later in stages:
        packing.pack(dealt).write.format("noop").mode("overwrite").save()
        assert remembered() > 0
        later()
        assert remembered() == 0
    dealt.unpersist()
