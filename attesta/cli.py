"""Command line: run a registered query or search a folder of notes."""

from __future__ import annotations

import argparse

from . import session
from .engine import Engine


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="attesta")
    sub = parser.add_subparsers(required=True, dest="command")
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name"), q.add_argument("tables"), q.add_argument("--out")
    for name in ("search", "stats"):
        s = sub.add_parser(name)
        s.add_argument("root"), s.add_argument("--source", default="case")
        if name == "search":
            s.add_argument("q"), s.add_argument("--topk", default=5, type=int)
    args = parser.parse_args(argv)
    spark = session.build()
    if args.command == "query":
        from .plans import QUERIES

        df = QUERIES[args.name](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, 80)
        return 0
    from .sources import files

    chunks = files.load_chunks(spark, args.root, [(args.source, "", True)])
    chunks = chunks.selectExpr("xxhash64(source, file, block, part) AS chunk_id", "source", "file", "heading", "body", "'knowledge' AS purpose")
    engine = Engine(spark, chunks, default_sources=(args.source,))
    if args.command == "stats":
        engine.stats().show()
    else:
        asked = spark.createDataFrame([(1, args.q)], "query_id bigint, q string")
        engine.search(asked, "bm25", args.topk).orderBy("rank").show(truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
