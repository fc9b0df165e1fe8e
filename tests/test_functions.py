from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import numeric, text
from attesta.operators.chunking import paragraph_spans
from attesta.streaming.maintenance import backoff, checkpoint_due, gap_retry_hours


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


def test_tokens_keep_order_and_scripts(spark):
    assert one(spark, text.tokenize, "Foo-Bar 中文字 x.y") == ["foo-bar", "x.y", "中文", "文字"]
    assert one(spark, text.tokenize, "") == []
    assert one(spark, text.tokenize, None) is None


def test_redaction_is_idempotent(spark):
    for t in ("pwd=abc, token: 'x y' `u:pass1word` https://a:b@c", 'secret = "q"', "密码：hunter2"):
        once = one(spark, text.redact, t)
        assert "<REDACTED>" in once and one(spark, text.redact, once) == once


def test_sentences_and_numbers(spark):
    assert one(spark, text.sentences, "One. Two! Three\nFour 3.5 five") == ["One", "Two!", "Three", "Four 3.5 five"]
    assert [str(n.normalize()) for n in one(spark, text.numbers, "on 2024-01-02 paid 1,250.50 and 7")] == ["1250.5", "7"]


def test_dates(spark):
    got = one(spark, lambda c: F.transform(text.dates(c), text.date_text), "2024-02-30 2024-03-05 and 7/9, 入 10-11")
    assert got == ["2024-03-05", "*-07-09"]


def test_cards(spark):
    assert one(spark, numeric.digit_runs, "x 4111 1111 1111 1111 y") == ["4111 1111 1111 1111"]
    assert one(spark, numeric.network, "4111111111111111") == "Visa"
    assert one(spark, numeric.luhn, "4111111111111111") is True


def test_snippet_moves_to_first_hit(spark):
    df = spark.createDataFrame([("a" * 100 + " needle " + "b" * 400,)], "t string")
    s = df.select(text.snippet(F.col("t"), F.array(F.lit("needle")))).first()[0]
    assert s.startswith("…") and "needle" in s and len(s) == 301


def test_visible_text(spark):
    assert one(spark, text.visible_text, "<head><title>t</title></head><p>a &amp; b</p><script>x</script><br>c") == "a & b\nc"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。", max_size=6000))
def test_paragraph_spans_cover_the_text(body):
    spans = paragraph_spans(body)
    assert all(b - a <= 1500 for a, b in spans)
    at = 0
    for a, b in spans:
        assert a <= at <= b
        at = b
    assert at == len(body)


def test_schedules():
    assert [backoff(n) for n in (0, 1, 3, 20)] == [300, 600, 2400, 21600]
    assert [gap_retry_hours(n) for n in (0, 2, 9)] == [1, 4, 24]
    assert checkpoint_due(600, 30, 1) and not checkpoint_due(600, 5, 1) and not checkpoint_due(10, 10, 0.1)


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert rows(df.select(numeric.cosine(F.col("a"), F.col("b")).alias("c"))) == [(0.0,)]


def test_named_sources_and_near_misses(spark):
    from attesta.operators import policy

    asked = {
        "文件《Plan A》里的预算": ("plan a", "的预算"), "资料《合同》": ("合同", "资料《合同》"), "in the record named “Notes”, who came?": ("notes", "who came?"),
        "资件《x》": (None, "资件《x》"), "文案《x》": (None, "文案《x》"), "文件《a》和文件《b》": (None, "文件《a》和文件《b》"), "《x》": (None, "《x》"),
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = {r[0]: (r[1], r[2]) for r in df.select("q", policy.named_source(F.col("q")), policy.without_named_source(F.col("q"))).collect()}
    assert got == asked


def test_routes_and_near_misses(spark):
    from attesta.operators import policy

    asked = {
        "旧备份在哪": "history", "历史备份": "history", "old backup disk": "history", "历备份": "personal", "旧史备份": "personal", "我的年薪": "personal", "do I earn more": "personal",
        "earnings of the quarter": "stock", "my earnings": "personal", "持仓多少": "stock", "rag pipeline": "technical", "fragment": "personal", "decode this": "personal", "the system design": "technical",
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert dict(df.select("q", policy.route(F.col("q"))).collect()) == asked


def test_redaction_and_near_misses(spark):
    far, near = "auth " + "x" * 56 + " `bob:tulips`", "auth " + "x" * 54 + " `bob:tulips`"
    cases = {
        "key sk-abcdefghijkl1": "key sk-<REDACTED>", "sk-short": "sk-short", "ftp://bob:hunter2@host/x": "ftp://bob:<REDACTED>@host/x",
        "Authorization: Bearer abc.def": "Authorization: Bearer <REDACTED>", "proxy-authorization=Basic QWxh": "proxy-authorization=Basic <REDACTED>",
        "`bob:tulip1x`": "`bob:<REDACTED>`", "`bob:tulips`": "`bob:tulips`", "账号 `bob:tulips`": "账号 `bob:<REDACTED>`", far: far, near: near.replace("tulips", "<REDACTED>"),
        "账号 `C:\\temp1x`": "账号 `C:\\temp1x`", "账号 `https://host/a1b`": "账号 `https://host/a1b`", "账号 `https://host/a?b=1`": "账号 `https:<REDACTED>`",
        'password = "a b c"': 'password = "<REDACTED>"', "pwd: abc, next": "pwd: <REDACTED>, next", "密码：hello 后": "密码：<REDACTED> 后", "access-key: x": "access-key: x", "api_key=x;y": "api_key=<REDACTED>;y",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    once = text.redact(F.col("c"))
    for c, got, again in df.select("c", once, text.redact(once)).collect():
        assert got == cases[c] == again
