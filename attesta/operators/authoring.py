"""Question sets: suites, seals, authoring rules, splits, generated filler and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .evaluation import overlapping_units

ANSWER = "decision string, claims array<struct<text:string, citations:array<struct<evidence_id:string, quote:string>>>>, reason string"
CUES = ("born", "salary", "invoice", "due", "licensed under", "version")


def suite_problems(questions: DataFrame, units: DataFrame) -> DataFrame:
    """(key, problem): repeated ids or questions, case groups over several splits, overlapping sources of splits."""
    ids = questions.groupBy(F.col("question_id").cast("string").alias("key")).count().where("count > 1").select("key", F.lit("repeated_id").alias("problem"))
    same = questions.groupBy(text.normal(F.col("q")).alias("key")).agg(F.countDistinct("question_id").alias("n")).where("n > 1").select("key", F.lit("repeated_question").alias("problem"))
    groups = questions.groupBy(F.col("case_group").alias("key")).agg(F.countDistinct("split").alias("n")).where("n > 1").select("key", F.lit("split_leak").alias("problem"))
    over = overlapping_units(units).select(F.concat_ws("-", "left_id", "right_id").alias("key"), F.lit("source_overlap").alias("problem"))
    return ids.unionByName(same).unionByName(groups).unionByName(over)


def parse_answers(raw: DataFrame) -> DataFrame:
    """(answer_id, valid, decision, claims, n_citations) from JSON answers; invalid ones are kept and marked."""
    a = raw.withColumn("a", F.from_json("answer", ANSWER))
    answered = (F.col("a.decision") == "answer") & (F.size(F.coalesce("a.claims", F.array().cast("array<struct<text:string,citations:array<struct<evidence_id:string,quote:string>>>>"))) > 0) & F.forall("a.claims", lambda c: (F.length(F.trim(c["text"])) > 0) & (F.size(c["citations"]) > 0))
    refused = (F.col("a.decision") == "refuse") & (F.coalesce(F.size("a.claims"), F.lit(0)) <= 0) & (F.length(F.trim(F.coalesce("a.reason", F.lit("")))) > 0)
    n = F.aggregate(F.coalesce("a.claims", F.array().cast("array<struct<text:string,citations:array<struct<evidence_id:string,quote:string>>>>")), F.lit(0), lambda s, c: s + F.size(c["citations"]))
    return a.select("answer_id", F.coalesce(answered | refused, F.lit(False)).alias("valid"), "a.decision", "a.claims", n.alias("n_citations"))


def regrade(saved: DataFrame, inputs: DataFrame) -> DataFrame:
    """(question_id, usable): saved answers whose input digest is still that of the input."""
    return saved.join(inputs.select("question_id", F.col("digest").alias("now")), "question_id", "left").select("question_id", F.coalesce(F.col("digest") == F.col("now"), F.lit(False)).alias("usable"))


def seal(questions: DataFrame) -> DataFrame:
    """Digest of a question set, to be compared before its only use."""
    from .journal import fingerprint

    return fingerprint(questions, questions.columns)


def author(docs: DataFrame, cues: tuple[str, ...] = CUES, reach: int = 45) -> DataFrame:
    """(doc_id, cue, value): the word or number that follows a cue within ``reach`` characters."""
    out = [F.struct(F.lit(c).alias("cue"), F.regexp_extract("text", rf"(?i)\b{c}\b[^\n]{{0,{reach}}}?\b(\d[\w.,-]*|[A-Z][\w-]+)", 1).alias("value")) for c in cues]
    return docs.select("doc_id", F.explode(F.array(*out)).alias("x")).select("doc_id", "x.cue", "x.value").where("value <> ''")


def split_by_hash(groups: Column, seed: str, shares: dict[str, int]) -> Column:
    """Split of a case group by its hash: stable, and the same for all rows of a group."""
    total, at, out = sum(shares.values()), 0, None
    place = F.pmod(F.xxhash64(F.concat(F.lit(seed), groups)), F.lit(total))
    for name, n in shares.items():
        at += n
        out = F.when(place < at, name) if out is None else out.when(place < at, name)
    return out


def round_robin(items: DataFrame, k: int, seed: str = "") -> DataFrame:
    """``k`` items (family, case_group, item_id), one per case group, the families taking turns."""
    key = F.sha2(F.concat(F.lit(seed), F.col("item_id").cast("string")), 256)
    one = items.withColumn("n", F.row_number().over(Window.partitionBy("case_group").orderBy(key))).where("n = 1").drop("n")
    turn = one.withColumn("turn", F.row_number().over(Window.partitionBy("family").orderBy(key)))
    return turn.orderBy("turn", "family").limit(k).select("family", "case_group", "item_id")


_MAKERS = ("meeting notes for project %s on day %s", "invoice %s due on day %s", "travel plan %s leaving day %s", "recipe %s tried on day %s", "repair log %s of day %s", "reading list %s of day %s")


def filler(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(doc_id, text) of n distinct made-up records, the same for the same seed."""
    i = F.col("id")
    made = F.element_at(F.array(*map(F.lit, _MAKERS)), (F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(len(_MAKERS))) + 1).cast("int"))
    return spark.range(n).select(i.alias("doc_id"), F.format_string("%s, record %d", F.replace(F.replace(made, F.lit("project %s"), F.concat(F.lit("project "), F.lower(F.hex(F.xxhash64(i, F.lit(seed + 1)))))), F.lit("%s"), F.pmod(F.xxhash64(i, F.lit(seed + 2)), F.lit(365)).cast("string")), i).alias("text"))


def carry_dates(clauses: DataFrame) -> DataFrame:
    """Adds date: the clause's own first date, else the last one before it in the sentence."""
    own = F.get(F.transform(text.dates(F.col("clause")), text.date_text), F.lit(0))
    w = Window.partitionBy("sentence_id").orderBy("pos")
    return clauses.withColumn("date", F.last_value(own, F.lit(True)).over(w))


def stock_terms(file: Column, body: Column) -> Column:
    """Lexical additions of a card's passage: its identity, and field names only where the field has a number."""
    from ..functions.numeric import card_identity

    c = card_identity(file)
    words = F.create_map(F.lit("short"), F.lit("short term"), F.lit("mid"), F.lit("medium term"), F.lit("long"), F.lit("long term"))
    field = F.when(body.rlike(r"/\s*in\s*[\d.$]"), F.lit("entry")), F.when(body.rlike(r"/\s*stop\s*[\d.$]"), F.lit("stop loss"))
    return F.when(c.isNotNull(), F.concat_ws(" ", c["ticker"], c["card_date"], words[c["horizon"]], *field))


def redact_json(column: Column) -> Column:
    """A JSON object of strings with values of secret-looking keys replaced and the others redacted."""
    m = F.from_json(column, "map<string,string>")
    return F.to_json(F.transform_values(m, lambda k, v: F.when(k.rlike("(?i)" + text._LABEL), F.lit("<REDACTED>")).otherwise(text.redact(v))))


def source_envelope(context: Column, quote: Column) -> Column:
    """Whole sentences of a context that a quote lies in or reaches into."""
    q = text.normal(quote)
    return F.filter(text.sentences(context), lambda s: F.contains(text.normal(s), q) | F.contains(q, text.normal(s)))


def price_units(body: Column) -> Column:
    """(date, metric, value) strings of clauses with exactly one date, one metric and its number."""
    one = lambda c: F.when((F.size(text.dates(c)) == 1) & (F.size(F.regexp_extract_all(c, F.lit(r"(?i)\b(close|closed|open|high|low|price)\b"), 1)) == 1), F.concat_ws("|", text.date_text(text.dates(c)[0]), F.lower(F.regexp_extract(c, r"(?i)\b(close|closed|open|high|low|price)\b", 1)), F.regexp_extract(c, r"(?i)\b(?:close|closed|open|high|low|price)\b\D{0,6}?(\d+(?:\.\d+)?)", 1)))
    return F.filter(F.transform(text.clauses(body), one), lambda x: x.isNotNull())
