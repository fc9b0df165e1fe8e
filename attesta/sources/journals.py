"""Encrypted append-only journals: length-prefixed AES-GCM frames of compressed JSON records."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"AJ01"


def pack(ciphertexts: list[bytes]) -> bytes:
    return b"".join(struct.pack(">I", len(c)) + c for c in ciphertexts)


def frames(raw: bytes) -> list[bytes]:
    """Whole frames after the magic; a partial last frame is ignored, as its append was cut off."""
    if raw[:4] != MAGIC:
        raise ValueError("not a journal")
    at, out = 4, []
    while at + 4 <= len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        if at + 4 + n > len(raw):
            break
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def whole_length(raw: bytes) -> int:
    """Where the last whole frame ends; an append starts there."""
    return 4 + sum(4 + len(f) for f in frames(raw))


def encrypt(spark: SparkSession, records: list[dict], key: bytes, aad: str) -> list[bytes]:
    """Frames of records, encrypted in the JVM."""
    rows = [(i, bytearray(zlib.compress(json.dumps(r, sort_keys=True).encode()))) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "i int, z binary")
    out = df.select("i", F.aes_encrypt("z", F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), F.lit(aad)).alias("c")).orderBy("i").collect()
    return [bytes(r["c"]) for r in out]


def append(path: str, new: list[bytes]) -> None:
    """Adds frames to a journal on a local or mounted path, over a partial tail if there is one."""
    import os

    if not os.path.exists(path):
        with open(path, "wb") as f:
            f.write(MAGIC + pack(new))
        return
    with open(path, "r+b") as f:
        f.truncate(whole_length(f.read()))
        f.seek(0, 2)
        f.write(pack(new))


def read(spark: SparkSession, path: str, key: bytes, aad: str) -> DataFrame:
    """(file, seq, record) with records as JSON text, in the order of appending. A frame that fails
    authentication fails the query."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, f) for p, c in zip(b["path"], b["content"], strict=True) for i, f in enumerate(frames(bytes(c)))]
            yield pd.DataFrame(rows, columns=["file", "seq", "frame"])

    def inflate(z: pd.Series) -> pd.Series:
        return z.map(lambda c: zlib.decompress(bytes(c)).decode())

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, "file string, seq bigint, frame binary")
    plain = F.aes_decrypt("frame", F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))
    return raw.select("file", "seq", F.pandas_udf(inflate, "string")(plain).alias("record"))


def latest_state(records: DataFrame, schema: str) -> DataFrame:
    """Records parsed and folded to the latest per path, later frames winning."""
    parsed = records.select("seq", F.from_json("record", schema).alias("r")).select("seq", "r.*")
    return parsed.groupBy("path").agg(F.max_by(F.struct(*parsed.columns), "seq").alias("x")).select("x.*")
