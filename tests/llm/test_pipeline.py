"""The pipeline's stages on the smallest tables, each against its own input."""

import re
from collections import Counter

import corpus_pipeline
from plumbline.llm import registry


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = corpus_pipeline.saved(stage(spark, spark.createDataFrame(list(before.values()), docs.schema), sf), name)
        after = {r["doc_id"]: r for r in path.collect()}
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if n + 1 < len(corpus_pipeline.STAGES):
            assert path.columns == columns
        if name == "quality_rules":
            short = {i for i, r in before.items() if len((r["text"] or "").split()) < 10}
            assert short <= gone and len(gone) < len(before) / 3
        if name == "line_dedup":
            lines = Counter(x.strip() for r in after.values() for x in r["text"].split("\n") if x.strip())
            assert max(lines.values()) == 1
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "benchmark_decontamination":
            items = [re.sub(r"\s+", " ", r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(i in re.sub(r"\s+", " ", r["text"]) for i in items for r in after.values())
        if name == "source_mix":
            assert set(after) == set(before) and sum(r["taken"] for r in after.values()) > 0
        before = after


def test_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
