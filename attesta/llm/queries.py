"""The opN_ queries: thin digests of the operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, licenses, mixing, packing, quality, simhash, substring, token_counts, toxicity
from .common import documents


def op1_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rule_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.forest_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir))
    return packed.withColumnRenamed("id", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_passages(documents(spark, sf_dir))
    return found.withColumnsRenamed({"doc": "doc_id", "source": "source_doc_id", "class": "class_id"})


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_texts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_report(token_counts.length_histogram(documents(spark, sf_dir)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rule_quality": op1_rule_quality,
    "op2_forest_quality": op2_forest_quality,
    "op3_best_two_fit": op3_best_two_fit,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_context_mixing": op7_context_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


#: Five-word shingles; an item of fewer words is one shingle of as many.
_ITEMS = f"SELECT item_id, w, least(len(w), 5) AS n FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0"


def _shingles(table: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT {key}, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM {table} WHERE len(w) >= n)"


ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": f"""
    WITH t AS ({_ITEMS}), x AS (SELECT doc_id, n, w FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), (SELECT DISTINCT n FROM t)),
         d AS ({_shingles("x", "doc_id")}), b AS ({_shingles("t", "item_id")}),
         n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS n_found, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles)::DOUBLE AS containment
    FROM d JOIN b USING (n, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles)""",
}
