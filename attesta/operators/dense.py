"""Exact vector search: a stated query set, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top_k
from .ranking import Best

#: Query vectors that are sent to the workers at once.
BLOCK = 8192
#: Queries and rows of one matrix product.
TILE, ROWS = 512, 1024


def _vectors(column: pa.Array) -> np.ndarray:
    """Vectors of one length, none of them null, as rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _blocks(queries: DataFrame, id_col: str, vector_col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of up to ``BLOCK`` queries at a time; a batch travels to the driver as one row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), TILE):
                ids, v = b.column(0).slice(at, TILE), b.column(1).slice(at, TILE)
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([ids.to_numpy().tobytes()], pa.binary()), pa.array([_vectors(v).tobytes()], pa.binary())], ["n", "ids", "v"])

    packed = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where("v IS NOT NULL AND id IS NOT NULL").mapInArrow(pack, "n bigint, ids binary, v binary")
    ids, vectors, held = [], [], 0
    for n, i, v in packed.toLocalIterator():
        ids.append(np.frombuffer(bytes(i), np.int64))
        vectors.append(np.frombuffer(bytes(v)).reshape(n, -1))
        held += n
        if held + TILE > BLOCK:
            yield np.concatenate(ids), np.concatenate(vectors)
            ids, vectors, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(vectors)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) by cosine in double precision, best ``k`` of each query.

    ``allowed`` masks rows before the cut; rows without a vector are no hits. Queries go out in blocks
    of bounded size and meet the rows in matrix products of bounded size, of which only the best ``k``
    per query are held and leave the worker, so the shuffle carries k rows per query and task.
    """
    rows = vectors if allowed is None else vectors.join(allowed, id_col, "left_semi")
    picked = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v IS NOT NULL")
    context, out = queries.sparkSession.sparkContext, None

    for ids, vecs in _blocks(queries, id_col, vector_col):
        shipped = context.broadcast((ids, _unit(vecs)))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, q = shipped.value
            best = [Best(k) for _ in range(0, len(ids), TILE)]
            for b in batches:
                for at in range(0, len(b), ROWS):
                    own, m = b.column(0).slice(at, ROWS).to_numpy(), _unit(_vectors(b.column(1).slice(at, ROWS))).T
                    for i, held in enumerate(best):
                        s = q[i * TILE : (i + 1) * TILE] @ m
                        asked, row = np.nonzero(s >= held.floors(len(s))[:, None])
                        held.add(asked, own[row], s[asked, row])
            for i, held in enumerate(best):
                asked, own, score = held.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids[i * TILE + asked]), pa.array(own), pa.array(score)], ["query_id", "id", "score"])

        found = top_k(picked.mapInArrow(run, "query_id bigint, id bigint, score double"), k, tie="id")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = top_k(picked.limit(0).selectExpr("id AS query_id", "id", "0D AS score"), k, tie="id")
    return out.withColumnRenamed("id", id_col)


def all_pairs(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, score, dot): cosine and dot product of every query and every row; the cosine is 0 where either is all
    zero, both are null where a vector is. There are as many rows as pairs, made and given on a tile at a time."""
    context = queries.sparkSession.sparkContext
    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    whole, names = picked.where("v IS NOT NULL"), "a bigint, b bigint, score double, dot double"
    asked = queries.select(F.col(id_col).alias("a"), F.col(vector_col).alias("v"))
    either = asked.where("v IS NULL").select("a").crossJoin(picked.select(F.col("id").alias("b"))).unionByName(asked.where("v IS NOT NULL").select("a").crossJoin(picked.where("v IS NULL").select(F.col("id").alias("b"))))
    out = either.selectExpr("a", "b", "CAST(NULL AS DOUBLE) AS score", "CAST(NULL AS DOUBLE) AS dot")
    for ids, vecs in _blocks(queries, id_col, vector_col):
        shipped = context.broadcast((ids, vecs, np.linalg.norm(vecs, axis=1)))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, q, long = shipped.value
            step = max(1, 65_536 // ROWS)
            for b in batches:
                for at in range(0, len(b), ROWS):
                    own, m = b.column(0).slice(at, ROWS).to_numpy(), _vectors(b.column(1).slice(at, ROWS))
                    n = np.linalg.norm(m, axis=1)
                    for i in range(0, len(ids), step):
                        dot, scale = q[i : i + step] @ m.T, long[i : i + step, None] * n
                        score = np.where(scale > 0, dot / np.where(scale > 0, scale, 1), 0.0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + step], len(own))), pa.array(np.tile(own, len(dot))), pa.array(score.ravel()), pa.array(dot.ravel())], ["a", "b", "score", "dot"])

        out = out.unionByName(whole.mapInArrow(run, names))
    return out


def window_max(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Best window of each passage."""
    return scores.groupBy(*keys).agg(F.max("score").alias("score"))
