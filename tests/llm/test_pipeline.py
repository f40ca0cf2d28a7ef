"""The corpus pipeline, stage by stage, on small documents."""

import importlib.util
import sys
from pathlib import Path


sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from talkframe.llm import leaks, mixing, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert {*docs.columns, "shard", "virtual_slot"} <= set(rows.columns)
    polite = {r.doc_id for r in toxicity.scored(docs, labels).collect() if not r.predicted}
    left = docs.where(docs.doc_id.isin(polite))
    alone = {r.component_id for r in simhash.near_duplicates(left).collect()}
    left = left.where(left.doc_id.isin(alone))
    leaked = {r.doc_id for r in leaks.leaked(left, bench).collect()}
    left = left.where(~left.doc_id.isin(leaked))
    want = {r.doc_id: r.copies for r in mixing.mixed_documents(left).collect() if r.copies}
    assert rows.groupby("doc_id").size().to_dict() == want and rows["shard"].between(0, 15).all()


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0, name
        if name != "sharding":
            assert none.columns == docs.columns, name


def test_entry_lists_all():
    spec = importlib.util.spec_from_file_location("entry_twin", Path(__file__).resolve().parents[2] / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
