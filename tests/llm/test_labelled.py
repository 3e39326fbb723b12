"""Training rows of the two classifiers: against plain Python, and how often their texts are exchanged."""

import zlib

import pytest

from duskwatch.llm import labelled


@pytest.mark.parametrize("label,folds,held", [("toxic", 4, 2), ("quality", 5, 0)])
@pytest.mark.parametrize("fits", [True, False])
def test_training_texts_are_exchanged_once(spark, monkeypatch, fits, label, folds, held):
    docs = [(i, f"text {i}") for i in range(60)] + [(3, "another"), (4, None), (None, "x"), (70, None)]
    labels = [(i, i % 2) for i in range(0, 60, 3)] + [(6, 1), (9, None), (None, 1), (70, 1), (80, 0), (3, 1)]
    monkeypatch.setattr(labelled, "cut", lambda df: df)
    monkeypatch.setattr(labelled, "BROADCAST_ROWS", 1 << 20 if fits else 0, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = labelled.training_shards(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {label} int"), label, folds, held, 5)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1
    known = {(i, y) for i, y in labels if i is not None and y is not None and i < 60 and zlib.crc32(str(i).encode()) % folds != held}
    assert sorted((r.doc_id, r.y) for r in got) == sorted(known)
    assert all((r.doc_id, r.text) in docs for r in got) and len({r.text for r in got if r.doc_id == 3}) <= 1
    assert len({r.shard for r in got}) > 1 and all(len({r.shard for r in got if r.doc_id == i}) == 1 for i, _ in known)
