"""Nulls, empty tables, repeats and clashing columns, for every operator and stage."""

import pytest
from helpers import rows

from attesta.llm import decontamination, licenses, mixing, packing, quality, simhash, substring, token_counts, toxicity


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "same words in a row same words"), (2, None), (3, "")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def operators(labelled, items):
    labels = labelled[1]
    return {
        "op1": lambda d: quality.rule_quality(d, labels), "op2": lambda d: quality.forest_quality(d, labels), "op3": packing.pack_documents, "op4": substring.repeated_passages,
        "op5": simhash.near_duplicates, "op6": lambda d: decontamination.contained_items(d, items), "op7": mixing.score_texts,
        "op8": lambda d: token_counts.context_report(token_counts.length_histogram(d)), "op9": lambda d: toxicity.score_toxicity(d, labels), "op10": licenses.scan,
    }


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_odd_and_empty(operators, odd, name):
    got = rows(operators[name](odd))
    if name in ("op1", "op2", "op5", "op7", "op9"):
        assert len(got) == odd.count()
    none = operators[name](odd.where("doc_id < 0"))
    assert rows(none) == []


def test_values_for_odd_rows(odd, operators):
    by = {}
    for r in operators["op5"](odd).collect():
        by.setdefault(r["id"], []).append((r["fp"], r["component"]))
    assert by[1] == by[2] and by[1] == [(0, 1)] == by[3] and by[5][0] == by[5][1] and len(by[5]) == 2 and by[None][0][1] is None
    packed = [r for r in operators["op3"](odd).collect()]
    assert sum(r["id"] == 5 for r in packed) == 2 and [r["length"] for r in packed if r["id"] == 1] == [1]
    lm = {r["id"]: r for r in operators["op7"](odd).collect()}
    assert lm[1]["n_tokens"] == lm[2]["n_tokens"] == 1 and lm[1]["bits_per_byte"] is None
    assert {r["doc"] for r in operators["op6"](odd).collect()} == {4}


def test_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r[1] for r in rows(quality.rule_quality(odd, none), "doc_id", "score")} == {0.5}
    one = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id bigint, text string")
    assert rows(toxicity.score_toxicity(one, none), "doc_id", "predicted") == [(1, 1), (2, 0)]


def test_stages_keep_columns_and_clean_rows(odd, labelled, items):
    assert simhash.one_of_each(odd).columns == odd.columns
    kept = rows(simhash.one_of_each(odd), "doc_id")
    assert kept.count((5,)) == 1 and (None,) in kept and (1,) in kept and (2,) not in kept
    wide = odd.withColumn("spans", odd["id"]).withColumn("nth", odd["id"]).withColumn("start", odd["id"])
    cut = substring.without_repeats(wide)
    assert cut.columns == wide.columns and cut.count() == wide.count()
    assert simhash.one_of_each(wide).columns == wide.columns
    clean = decontamination.without_items(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 1
    good = quality.keep_good(odd.withColumnRenamed("id", "quality"), labelled[1])
    assert good.columns == ["doc_id", "text", "quality"]


def test_packing_gives_ids(spark):
    import numpy as np
    from attesta.llm.tokens import encoder

    d = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    row = packing.pack_documents(d, with_ids=True).first()
    assert bytes(row["ids"]) == encoder().encode([b"some words here"])[0] + np.array([0], "<u4").tobytes()


def test_packing_keeps_ids_in_the_worker(spark, odd):
    lean, full = packing.pieces(odd, with_ids=False), packing.pieces(odd)
    assert full.columns == [*lean.columns, "ids"] and "ids" not in packing.pack_documents(odd).columns
    assert rows(lean, *lean.columns) == rows(full, *lean.columns)
