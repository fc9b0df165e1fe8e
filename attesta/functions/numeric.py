"""Scores, vectors, cards and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import not_after, not_before


#: Name of a card file: ticker, tags, horizon and day.
CARD_FILE = "(?i)^card_" + r"([0-9A-Z][-.0-9A-Z]*)" + r"(?:#[A-Z]+)*" + "#(" + "|".join(("long", "mid", "short")) + ")" + r"_(\d{4}(?:-\d\d){2})" + r"[.]md$"


def idf(n: Column, df: Column) -> Column:
    return F.ln((n + 1) / (df + 0.5))


def bm25_weight(idf_: Column, tf: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def rerank_probability(score: Column, least: Column, most: Column) -> Column:
    """Logits become probabilities if a batch leaves [0, 1]."""
    return F.when((least < 0) | (most > 1), 1 / (1 + F.exp(-score))).otherwise(score)


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def network(number: Column) -> Column:
    """Card network by length and leading digits; null if none."""
    n, two, three, four = F.length(number), F.substring(number, 1, 2).cast("int"), F.substring(number, 1, 3).cast("int"), F.substring(number, 1, 4).cast("int")
    return (
        F.when((n == 15) & two.isin(34, 37), "American Express")
        .when(n.isin(13, 16, 19) & number.startswith("4"), "Visa")
        .when((n == 16) & (two.between(51, 55) | four.between(2221, 2720)), "Mastercard")
        .when((n == 16) & ((four == 6011) | (two == 65) | three.between(644, 649)), "Discover")
        .when(n.isin(16, 19) & (two == 62), "UnionPay")
    )


def valid_grouping(raw: Column) -> Column:
    sizes = F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(r"(\d+)"), 1), lambda g: F.length(g).cast("string")), ",")
    return ~F.contains(sizes, F.lit(",")) | sizes.isin("4,4,4,4", "4,6,5", "4,4,4,3", "4,4,4,4,3", "4,4,5")


def digit_runs(text: Column) -> Column:
    """Overlapping digit runs of 13, 15, 16 and 19 digits with single separators, bounded by non-digits."""
    found = [F.regexp_extract_all(text, F.lit(not_after(r"\d") + "(?=(" + r"\d" + rf"(?:[-\t ]*\d){{{n - 1}}}" + ")" + not_before(r"\d") + ")"), 1) for n in (13, 15, 16, 19)]
    return F.array_distinct(F.concat(*found))


def path_parts(path: Column) -> Column:
    clean = F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("!/"), F.lit("/"))
    return F.split(F.lower(F.regexp_replace(clean, "^/+|/+$", "")), "/")


def project_group(path: Column, project_dirs: tuple[str, ...] = ("projects", "repos")) -> Column:
    """The path down to the project's own folder, or null outside of projects."""
    original = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    parts = F.transform(original, F.lower)
    places = F.filter(F.transform(F.array(*map(F.lit, project_dirs)), lambda d: F.array_position(parts, d)), lambda p: p > 0)
    at = F.array_min(places)
    deep = F.element_at(parts, at.cast("int")) == "projects"
    end = F.when(deep & (F.size(parts) > at + 1), at + 1).otherwise(at)
    return F.when(parts[0].startswith("06_") & (F.size(parts) > 2), F.array_join(F.slice(original, 1, 2), "/")).when(
        at.isNotNull(), F.array_join(F.slice(original, F.lit(1), end.cast("int")), "/")
    )


def card_identity(file: Column) -> Column:
    """Struct (ticker, card_date, horizon) of a card file's name; null if it isn't one or has no valid date."""
    pattern = CARD_FILE
    day = F.try_to_date(F.regexp_extract(file, pattern, 3))
    return F.when(file.rlike(pattern) & day.isNotNull(), F.struct(
        F.upper(F.regexp_extract(file, pattern, 1)).alias("ticker"), F.regexp_extract(file, pattern, 3).alias("card_date"), F.lower(F.regexp_extract(file, pattern, 2)).alias("horizon")))
