"""The public interface: one object over a corpus of chunks that answers batches of queries."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text
from .operators import chunking, claims, dense, evaluation, fusion, lexical, policy
from .session import shared_dir

MODES = ("bm25", "vec", "hybrid")
FLOORS = {"bm25": 8.0, "vec": 0.48}


class Encoder(Protocol):
    """Turns (query_id, q) into (query_id, embedding)."""

    def encode(self, queries: DataFrame) -> DataFrame: ...


class Reranker(Protocol):
    """Scores (query_id, q, unit, window) into (query_id, unit, score)."""

    def score(self, pairs: DataFrame) -> DataFrame: ...


@dataclass
class Engine:
    """Search over chunks (chunk_id, source, file, heading, body, purpose) and, if given, vectors
    (chunk_id, embedding). Index tables are written once to the shared folder and reused."""

    spark: SparkSession
    chunks: DataFrame
    vectors: DataFrame | None = None
    encoder: Encoder | None = None
    reranker: Reranker | None = None
    default_sources: tuple[str, ...] = ("case", "book", "mem")
    _tables: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)

    def index(self, sources: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of some sources only, so that other sources don't move the statistics."""
        name = "+".join(sorted(sources))
        if name not in self._tables:
            rows = self.chunks.where(F.col("source").isin(*sources)).withColumn("t", F.concat_ws(" ", "file", "heading", "body"))
            self._tables[name] = lexical.write_index(rows, f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}", "chunk_id", "t")
        return self._tables[name]

    def search(
        self, queries: DataFrame, mode: str = "hybrid", topk: int = 10, sources: list[str] | None = None, include_pages: bool = False,
        include_evaluation: bool = False, floors: dict[str, float] | None = None, drop_low: bool = False,
    ) -> DataFrame:
        """(query_id, rank, unit, chunk_id, score, ranks, level, mode, source, file, heading, snippet) of queries (query_id, q)."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        used = policy.allowed_sources(sources, include_pages, self.default_sources)
        allowed = self.chunks.where(policy.visible(F.col("source"), F.col("purpose"), used, include_evaluation)).select("chunk_id")
        label = mode
        if mode != "bm25" and (self.vectors is None or self.encoder is None):
            label, mode = "bm25(fallback)", "bm25"
        legs = []
        if mode != "vec":
            post, sizes = self.index(tuple(used))
            legs.append(lexical.bm25_search(queries, post, sizes, 50, allowed).select("query_id", F.lit("bm25").alias("leg"), "chunk_id", "rank", "score"))
        if mode != "bm25":
            asked = self.encoder.encode(queries).select(F.col("query_id").alias("chunk_id"), "embedding")
            legs.append(dense.vector_search(asked, self.vectors, 50, "chunk_id", "embedding", allowed).select("query_id", F.lit("vec").alias("leg"), "chunk_id", "rank", "score"))
        both = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
        facts = self.chunks.select("chunk_id", "source", "file", "heading", "body")
        by_page = used == ["pdf"]
        keyed = both.join(facts, "chunk_id").select("query_id", "leg", "chunk_id", "rank", "score", fusion.unit_key(F.col("source"), F.col("file"), F.col("heading"), by_page).alias("unit"), F.lit(True).alias("body"))
        fused = fusion.order_fused(fusion.rrf_units(keyed)).where(F.col("rank") < topk)
        level = fusion.gate(keyed, floors or FLOORS)
        if self.reranker is not None:
            fused, gate = self._reranked(fused, keyed, facts, queries)
            level = level.join(gate, "query_id", "left").select("query_id", F.coalesce("reranked", "level").alias("level"))
        hits = fused.join(level, "query_id").join(facts, "chunk_id").join(queries, "query_id")
        hits = hits.withColumn("snippet", text.snippet(F.col("body"), text.tokenize(F.col("q")))).withColumn("mode", F.lit(label))
        hits = hits.where("level <> 'low'") if drop_low else hits
        return hits.select("query_id", "rank", "unit", "chunk_id", "score", "ranks", "level", "mode", "source", "file", "heading", "snippet")

    def _reranked(self, fused: DataFrame, keyed: DataFrame, facts: DataFrame, queries: DataFrame, lo: float = 0.10, hi: float = 0.50) -> tuple[DataFrame, DataFrame]:
        """``fused`` with representatives rescued, and (query_id, reranked): the level by the best window.

        Of queries whose best stays under ``hi``, each unit among those scored that is under ``lo``
        has its best lexical chunk scored too, which takes over from ``lo`` on.
        """

        def score(chosen: DataFrame) -> DataFrame:
            header = F.concat_ws("\n", "file", "heading")
            windows = chosen.join(facts, "chunk_id").join(queries, "query_id").select("query_id", "q", "unit", F.explode(chunking.fixed_windows(F.col("body"), header)).alias("window"))
            return self.reranker.score(windows).groupBy("query_id", "unit").agg(F.max("score").alias("score"))

        scores = score(fused.select("query_id", "unit", "chunk_id"))
        units = fused.select("query_id", "unit", "rank", "chunk_id").join(scores.withColumnRenamed("score", "p"), ["query_id", "unit"], "left")
        weak = fusion.rerank_gate(fused, scores, lo, hi).where(F.col("best") < hi).select("query_id", "n_scored")
        weak = units.join(weak, "query_id").where((F.col("rank") < F.col("n_scored")) & (F.col("p") < lo)).select("query_id", "unit", F.col("chunk_id").alias("old"))
        lexical_best = keyed.where("leg = 'bm25'").groupBy("query_id", "unit").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id"))
        tried = lexical_best.join(weak, ["query_id", "unit"]).where("chunk_id <> old").select("query_id", "unit", "chunk_id")
        bodies = tried.join(score(tried).withColumnRenamed("score", "p"), ["query_id", "unit"])
        rescued = fusion.rescue(units, bodies, lo)
        levels = fusion.rerank_gate(fused, rescued.select("query_id", "unit", F.col("p").alias("score")), lo, hi)
        return fused.drop("chunk_id").join(rescued.select("query_id", "unit", "chunk_id"), ["query_id", "unit"]), levels.select("query_id", F.col("level").alias("reranked"))

    def get(self, file: str | None = None, heading: str | None = None, digest: str | None = None, limit: int = 20_000) -> DataFrame:
        """Chunks by content digest, by file, or by file and heading (exact, else the only one it begins)."""
        rows = self.chunks.withColumn("digest", F.md5("body"))
        if digest:
            return rows.where(F.col("digest") == digest)
        rows = rows.where(F.col("file") == file)
        if heading:
            # an exact heading, else one that is the only one to begin so
            begins = rows.where(F.startswith("heading", F.lit(heading)))
            best = begins.agg(F.max(F.col("heading") == heading).alias("exact"), F.count_distinct("heading").alias("n"))
            rows = begins.join(F.broadcast(best), how="cross").where(F.when(F.col("exact"), F.col("heading") == heading).otherwise(F.col("n") == 1)).drop("exact", "n")
        return rows.withColumn("body", F.substring("body", 1, limit))

    def evidence(self, queries: DataFrame, budget: int = 12_000, passages: int = 5) -> DataFrame:
        """(query_id, file, ordinal, body) of queries (query_id, q, file): the whole file if it fits the
        budget, else its best passages and the neighbours of the best two, in document order."""
        if not 200 <= budget <= 50_000 or not 1 <= passages <= 10:
            raise ValueError("budget must lie in 200..50000 and passages in 1..10")
        asked = self.chunks.join(lexical.small(queries.select("file").distinct()), "file", "left_semi").select("file", "chunk_id", "body")
        # passages are chosen by their sizes and scores, so that bodies aren't sorted and joined with every step
        places = asked.select("file", "chunk_id", F.length("body").alias("size"))
        places = places.withColumn("ordinal", F.row_number().over(Window.partitionBy("file").orderBy("chunk_id")) - 1).withColumn("whole", F.sum("size").over(Window.partitionBy("file")))
        mine = queries.select("query_id", "file").join(places, "file")
        fits = mine.where(F.col("whole") <= budget).select("query_id", "file", "chunk_id", "ordinal")
        long = mine.where(F.col("whole") > budget).drop("whole")
        words = queries.groupBy("query_id").agg(F.array_join(F.collect_list("q"), "\n").alias("q"))
        words = queries.select("query_id", "file").distinct().join(words, "query_id")
        scores = lexical.overlap_scores(asked.join(lexical.small(words), "file"), "q", "body").where("score > 0")
        own = scores.join(long, ["query_id", "file", "chunk_id"])
        best = lexical.top_k(own, passages)
        near = best.where("rank < 2").select("query_id", "file", F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal"), F.lit(99).alias("rank"))
        picked = best.select("query_id", "file", "ordinal", "rank").unionByName(near).groupBy("query_id", "file", "ordinal").agg(F.min("rank").alias("rank"))
        chosen = picked.join(long, ["query_id", "file", "ordinal"]).withColumnRenamed("query_id", "question_id")
        chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "ordinal")))
        kept = evaluation.take_until(chosen, budget, F.col("size")).select(F.col("question_id").alias("query_id"), "file", "chunk_id", "ordinal")
        return fits.unionByName(kept).join(asked, ["file", "chunk_id"]).select("query_id", "file", "ordinal", "body")

    def check_answer(self, said: DataFrame, citations: DataFrame) -> DataFrame:
        """Sentence checks of claims against chunks cited by id."""
        contexts = self.chunks.select(F.col("chunk_id").cast("string").alias("evidence_id"), F.col("body").alias("text"))
        return claims.check_answers(said, citations.withColumn("evidence_id", F.col("evidence_id").cast("string")), contexts)

    def evaluate(self, questions: DataFrame, **options) -> DataFrame:
        """Summary of a search over questions (query_id, q, expected files, positive)."""
        hits = self.search(questions.select("query_id", "q"), **options)
        first = hits.join(questions.select("query_id", "expect"), "query_id").where(F.array_contains("expect", F.col("file"))).groupBy("query_id").agg((F.min("rank") + 1).alias("rank"))
        level = hits.groupBy("query_id").agg(F.first("level").alias("confidence"), F.bool_or(F.col("mode") == "bm25(fallback)").alias("fallback"))
        graded = questions.select("query_id", "positive").join(first, "query_id", "left").join(level, "query_id", "left").withColumn("ms", F.lit(None).cast("double"))
        return evaluation.summary(graded.na.fill({"confidence": "low", "fallback": False}))

    def stats(self) -> DataFrame:
        return self.chunks.groupBy("source").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("chunks"))
