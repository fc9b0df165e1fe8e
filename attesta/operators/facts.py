"""Card numbers in running text and query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric

LABELS = r"(?i)\b(american express|amex|platinum|business|gold|cobalt|cash|visa|mastercard|master card|account|acct|saving|money|card number|card)\b"
GENERIC = ("card", "card number", "visa", "mastercard", "master card", "account")
BANK = ("money", "acct", "saving")


def label_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LABELS), 1), F.lower))


def card_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, number, network, labels): valid numbers (grouping, network, Luhn) with labels on the
    line or, if those are generic, on the nearest of the three non-blank lines before."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line", "s")).where("trim(s) <> ''")
    before = Window.partitionBy("id").orderBy("line").rowsBetween(-3, -1)
    generic = F.array(*map(F.lit, GENERIC))
    lines = lines.withColumn("own", label_tokens(F.col("s"))).withColumn("prior", F.collect_list("own").over(before))
    useful = F.filter("prior", lambda p: F.size(F.array_except(p, generic)) > 0)
    plain = F.size(F.array_except("own", generic)) == 0
    labels = F.when(plain & (F.size(useful) > 0), F.array_distinct(F.concat(F.element_at(useful, -1), "own"))).otherwise(F.col("own"))
    found = lines.select("id", "line", labels.alias("labels"), F.explode(numeric.digit_runs(F.col("s"))).alias("raw"))
    found = found.withColumn("number", F.regexp_replace("raw", r"\D", "")).withColumn("network", numeric.network(F.col("number")))
    ok = F.col("network").isNotNull() & numeric.valid_grouping(F.col("raw")) & numeric.luhn(F.col("number"))
    return found.where(ok).select("id", "line", "number", "network", "labels").distinct()


def cards(lines: DataFrame, include_bank: bool = False) -> DataFrame:
    """One row per number: its labels, how many places name it, whether any marks a bank account."""
    bank = F.arrays_overlap("labels", F.array(*map(F.lit, BANK)))
    out = lines.where(F.size("labels") > 0).groupBy("number", "network").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))), " ").alias("label"), F.count(F.lit(1)).alias("sources"), F.bool_or(bank).alias("bank"))
    return out if include_bank else out.where("NOT bank")


def expand_queries(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """Adds expanded: the query and, in the glossary's order, the additions whose trigger it contains."""
    hit = queries.join(F.broadcast(glossary), F.contains(F.lower("q"), F.lower("trigger")))
    adds = hit.groupBy("query_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "addition"))), lambda s: s["addition"])), " ").alias("more"))
    return queries.join(adds, "query_id", "left").select("query_id", "q", F.concat_ws(" ", "q", "more").alias("expanded"))
