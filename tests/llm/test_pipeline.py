"""The pipeline stage by stage, each judged on its own input."""

import re
from collections import Counter

from llm_corpus import frame
from test_dedup import BLANK, brute_components, brute_fingerprint

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.orderBy("doc_id").collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
            assert Counter(after) <= Counter(before)
        kept = {r.doc_id for r in after}
        if name == "language":
            assert kept == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}
        elif name == "exact_dedup":
            first = {}
            for r in before:
                first.setdefault(BLANK.sub(" ", r.text or ""), r.doc_id)
            assert kept == set(first.values())
        elif name == "near_dedup":
            assert kept == set(brute_components([brute_fingerprint(r.text) for r in before], [r.doc_id for r in before]))
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = {r.doc_id for r in before if any(i in (r.text or "") for i in items)}
            assert kept.isdisjoint(held) and len(kept) >= len(before) - len(held) - 3
        else:
            assert kept <= {r.doc_id for r in before} and abs(len(after) - len(before)) < 0.4 * len(before)


def test_stages_take_awkward_rows(spark):
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0, name
