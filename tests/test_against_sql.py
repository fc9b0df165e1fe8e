"""Queries against their SQL on rows that the driver's small tables lack."""

import datetime

import duckdb
from helpers import rows

from attesta.plans import ORACLE_SQL, QUERIES


def assert_same(spark, tmp_path, name, **tables):
    """``tables`` name (rows, schema); the query and its SQL read them from Parquet files."""
    con = duckdb.connect()
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = con.sql(ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert want and rows(got, *columns) == sorted(map(tuple, want), key=repr)
    return {tuple(r) for r in want}


def test_customers_that_are_no_years(spark, tmp_path):
    day = datetime.datetime(1995, 3, 1)
    orders = [(k, 1995, "O", 10.0, day, "1-URGENT") for k in range(8)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    assert (1, "missing_year") in assert_same(spark, tmp_path, "C16_review_reasons", orders=(orders, schema))


def test_seconds_are_rounded(spark, tmp_path):
    """Reads 120 s after a search by rounded seconds, on either side of a half."""
    at = [(0, 0.4), (1, 120.6), (2, 1000.6), (3, 1121.4), (4, 2000.5), (5, 2120.5), (6, 3000.5), (7, 3121.5), (8, 4001.5), (9, 4121.5), (10, 4991.6), (11, 5112.3), (12, 5999.7), (13, 6120.4)]
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(seconds=s), 7, "view", 1.0, "{}") for i, s in at]
    assert_same(spark, tmp_path, "D08_search_then_get", events=(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"))


def test_documents_without_words(spark, tmp_path):
    texts = ["", " \n", None, "a b", "a\vb c", " x y", " lead and trail\t"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    got = assert_same(spark, tmp_path, "M01_tokenizer_switch", documents=(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert {(0, 0), (2, None), (4, 2)} <= got


def test_clock_beyond_a_hundred_hours(spark, tmp_path):
    from pyspark.sql import functions as F

    from attesta.functions import text

    seconds = [0, 59, 3599, 86_399, 359_999, 360_000, 4_000_000, 36_000_000, 5_000_000_000_000]
    events = [(s, datetime.datetime(2024, 1, 1), 7, "view", 1.0, "{}") for s in seconds]
    assert_same(spark, tmp_path, "I30_clock", events=(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"))
    assert rows(spark.createDataFrame([(5_000_000_003_661,)], "s bigint").select(text.clock(F.col("s")))) == [("1388888889:54:21",)]


def test_cards_of_all_lengths_and_groupings(spark, tmp_path):
    """Numbers next to each other, with separators, of 13, 15, 16 and 19 digits, and near misses."""
    sixteen, amex, thirteen, nineteen = "4111111111111111", "378282246310005", "4222222222222", "6200000000000000000"
    texts = [
        f"{sixteen} 5500000000000004", f"a{amex}b {thirteen}", "4111 1111-1111\t1111", "3782 822463 10005", nineteen, f"1{sixteen}", f"{sixteen}1", "41111111 11111111", "4111\n1111 1111 1111",
        f"12 {sixteen}", f"{sixteen} 12", "4111 1111 1111 1111 5500 0000 0000 0004", "no digits", None, "4222 2222 22222", "4111  1111 - 1111 1111", f"{sixteen}-{sixteen}",
    ]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    got = assert_same(spark, tmp_path, "C17_card_predicate", documents=(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert {i for i, *_ in got} == {0, 1, 2, 3, 4, 9, 10, 11, 14, 15, 16}
