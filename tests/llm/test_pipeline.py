"""The pipeline against brute force over its stages' own inputs."""

import re

from helpers import rows
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import decontamination, simhash
from attesta.llm.common import Scratch


def test_stages(spark, sf):
    docs, scratch, seen = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.table(stage(spark, docs, sf), name)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = seen["quality_classifier"][1].join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 2 and kept.where("quality = 1").count() >= 0.95 * labels.where("quality = 1").count()
    before, after = seen["simhash_dedup"]
    want = rows(simhash.near_duplicates(before).where("id = component"), "id")
    assert rows(after, "doc_id") == want
    before, after = seen["substring_dedup"]
    texts = dict(rows(after, "doc_id", "text"))
    held = {}
    for i, t in sorted(texts.items()):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        for j in range(len(w) - 49):
            assert held.setdefault(tuple(w[j : j + 50]), i) == i
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["decontaminate"]
    bad = {r[0] for r in rows(decontamination.contained_items(before, spark.read.parquet(f"{sf}/benchmark.parquet")), "doc")}
    assert {r[0] for r in rows(after, "doc_id")} == {r[0] for r in rows(before, "doc_id")} - bad
    before, after = seen["best_fit_packing"]
    assert {r[0] for r in rows(after, "doc_id")} == {r[0] for r in rows(before, "doc_id")}
    assert rows(corpus_pipeline.run(spark, sf), "doc_id", "piece", "ids_crc32") == rows(after, "doc_id", "piece", "ids_crc32")
