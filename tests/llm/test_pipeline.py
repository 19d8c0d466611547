import pytest
from cases import docs, near_components, removed_lines
from pyspark.sql import functions as F

from quillon.llm.tables import write_table

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_take_effect(spark):
    d = docs(spark)
    states = [d]
    for name, stage in pipeline.STAGES:
        states.append(write_table(stage(spark, states[-1], ""), name))
    assert all(s.columns == d.columns for s in states[:-1])
    start, cleaned, deduped, single, mixed, packed = states
    assert cleaned.filter(F.size(F.split(F.trim("text"), r"\s+")) < 50).count() == 0
    gone = removed_lines(sorted({(r.doc_id, r.text) for r in cleaned.collect()}, key=repr))
    kept = {r.doc_id: r.text for r in deduped.collect()}
    assert any(gone.values()) and 0 < len(kept) < len(gone)  # copies have nothing left, and go
    for r in cleaned.collect():
        left = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id])
        assert (kept[r.doc_id] == left) if not gone[r.doc_id] or len(left.split()) >= 50 else (r.doc_id not in kept)
    components, sets = near_components([(r.doc_id, r.text) for r in deduped.collect()], 5)
    want = {c for i, c in components.items() if sets[i]} | {i for i in components if not sets[i]}
    assert {r.doc_id for r in single.collect() if r.doc_id is not None} == want
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    assert packed.filter("start = 0").count() == mixed.count()


def test_run(spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    assert pipeline.run(spark, sf).count() > 0
