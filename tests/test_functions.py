"""Column functions on hand-made vectors."""

import pytest
from pyspark.sql import functions as F

from callsight.functions import numbers, redaction, text, times


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


WORKER = [
    ("Contact ann.b@site.org now", "Contact [EMAIL] now", True),
    ("card 4111 1111 1111 1111 x 4111-1111-1111-1111", "card [CARD] x [CARD]", True),
    ("ip 192.168.1.20 ok 10.0.0.1", "ip [IP] ok [IP]", True),
    ("(415) 555-2671 call", "([PHONE] call", True),
    ("+1 415 555 2671", "+[PHONE]", True),
    ("order 1234567890", "order [PHONE]", True),
    ("123456789012345678", "[PHONE]", True),
    ("2024-01-01 00:00:07", "[PHONE]:00:07", True),
    ("a@b.com.\nb@c.d", "[EMAIL].\n[EMAIL]", True),
    ("x_é@b.co é123-45-6789", "[EMAIL] é123-45-6789", True),
    ("日本語mail@ex.jp漢字", "[EMAIL]", True),
    ("ssn 123-45-6789.", "ssn [SSN].", True),
    ("The capital of France is Paris.", "The capital of France is Paris.", False),
    ("", "", False),
    (None, None, False),
]


@pytest.mark.parametrize("before,after,changed", WORKER)
def test_worker_rules(spark, before, after, changed):
    found = one(spark, redaction.by_rules(), before)
    assert (found.text, found.changed) == (after, changed)
    assert one(spark, redaction.by_rules(), after).text == after


@pytest.mark.parametrize(
    "before,after",
    [("123-45-6789", "[PHONE]"), ("192.168.1.20", "[PHONE]"), ("10.0.0.1", "10.0.0.1"), ("x@y.com", "[EMAIL]")],
)
def test_client_rules(spark, before, after):
    assert one(spark, redaction.by_rules(redaction.CLIENT_RULES), before).text == after


def test_redacted_event_keeps_its_key(spark):
    row = ("req_x", "my email is a@b.com", "no pii here", False, "2024-01-01")
    names = "request_id string, input_preview string, output_preview string, redacted boolean, created_at string"
    events = spark.createDataFrame([row, ("req_y", None, "", True, "2024-01-02")], names)
    first, second = redaction.redact_events(events).orderBy("request_id").collect()
    assert first.redacted is True and "[EMAIL]" in first.input_preview and first.output_preview == "no pii here"
    assert (first.request_id, first.created_at) == ("req_x", "2024-01-01")
    assert second.redacted is True and second.input_preview is None


def test_engine_choice(spark):
    class Shout:
        def redact(self, texts):
            return texts.str.upper()

    assert one(spark, redaction.choose("none"), "a@b.com").text == "a@b.com"
    assert one(spark, redaction.choose("REGEX"), "a@b.com").text == "[EMAIL]"
    assert one(spark, redaction.choose("unknown"), "a@b.com").text == "[EMAIL]"  # nobody knows it: rules
    deep = redaction.choose("Shout", {"shout": Shout})
    rows = spark.createDataFrame([("ab",), ("",), (None,)], "x string").select(deep(F.col("x")).alias("y")).collect()
    assert [(r.y.text, r.y.changed) for r in rows] == [("AB", True), ("", False), (None, False)]


def test_preview_cuts_first(spark):
    assert one(spark, lambda c: text.preview(c, 10, redact=True), "hello a@b.com") == "hello a@b."
    assert one(spark, lambda c: text.preview(c, 13, redact=True), "hello a@b.com") == "hello [EMAIL]"
    assert one(spark, text.preview, "x" * 900) == "x" * 500
    assert one(spark, text.preview, None) == ""


@pytest.mark.parametrize(
    "value,title",
    [
        ("  hello\nworld \n", "hello world"),
        ("x" * 60, "x" * 60),
        ("x" * 61, "x" * 60 + "…"),
        (" wide ", "wide"),
        ("é" * 70, "é" * 60 + "…"),
        ("", ""),
    ],
)
def test_title(spark, value, title):
    assert one(spark, text.title, value) == title


@pytest.mark.parametrize(
    "model,provider",
    [("a/b/c", "a"), ("slate:8b", "openrouter"), ("", "openrouter"), (None, "openrouter"), ("/x", "")],
)
def test_provider(spark, model, provider):
    assert one(spark, text.provider_from_model, model) == provider


@pytest.mark.parametrize("value,tokens", [("", 1), (None, 1), ("abc", 1), ("12345678", 2), ("é" * 9, 2)])
def test_tokens(spark, value, tokens):
    assert one(spark, text.estimate_tokens, value) == tokens


def test_keys_and_ids(spark):
    rows = spark.createDataFrame([("s", "r"), ("", "r"), (None, "r")], "s string, r string")
    keys = rows.select(text.session_key(F.col("s"), F.col("r")).alias("k"), text.new_request_id().alias("i")).collect()
    assert [r.k for r in keys] == ["s", "r", "r"]
    assert all(len(r.i) == 36 and r.i.startswith("req_") for r in keys)


@pytest.mark.parametrize("value,digits,rounded", [(2.5, 0, 2.0), (3.5, 0, 4.0), (0.125, 2, 0.12), (None, 0, None)])
def test_round_even(spark, value, digits, rounded):
    assert one(spark, lambda c: numbers.round_even(c, digits), value, "double") == rounded


@pytest.mark.parametrize(
    "value,whole,real",
    [(None, 0, 0.0), ("NaN", 0, 0.0), ("12", 12, 12.0), ("12.5", 0, 12.5), ("not-a-number", 0, 0.0), ("-3", -3, -3.0)],
)
def test_zero_fill(spark, value, whole, real):
    assert one(spark, numbers.zero_int, value) == whole
    assert one(spark, numbers.zero_float, value) == real


def test_zero_fill_of_numbers(spark):
    assert one(spark, numbers.zero_int, float("nan"), "double") == 0
    assert one(spark, numbers.zero_int, 147.0, "double") == 147


@pytest.mark.parametrize(
    "errors,requests,api,panel", [(0, 0, 0.0, 0.0), (1, 800, 0.12, 0.12), (1, 3, 33.33, 33.33), (5, 5, 100.0, 100.0)]
)
def test_error_rates(spark, errors, requests, api, panel):
    row = spark.createDataFrame([(errors, requests)], "e bigint, n bigint").select(
        numbers.error_rate(F.col("e"), F.col("n")).alias("a"), numbers.panel_error_rate(F.col("e"), F.col("n")).alias("p")
    )
    assert tuple(row.first()) == (api, panel)


@pytest.mark.parametrize(
    "n,short",
    [(0, "0"), (999, "999"), (1000, "1.0k"), (1150, "1.1k"), (1250, "1.3k"), (1350, "1.4k"), (1750, "1.8k"),
     (2250, "2.3k"), (999_999, "1000.0k"), (1_250_000, "1.3M"), (1_234_567_890, "1234.6M")],
)
def test_human_number(spark, n, short):
    assert one(spark, numbers.human_number, n, "bigint") == short


def test_report_texts(spark):
    assert one(spark, numbers.money, 12.3456, "double") == "$12.3456"
    assert one(spark, numbers.money, None, "double") == "$0.0000"
    assert one(spark, numbers.percent_text, 2.5, "double") == "2.5%"
    assert one(spark, numbers.percent_text, 0.0, "double") == "0%"
    assert one(spark, numbers.milliseconds_text, None, "double") == "0ms"


@pytest.mark.parametrize("value,level", [(0.99, "green"), (1.0, "yellow"), (4.99, "yellow"), (5.0, "red"), (None, None)])
def test_severity(spark, value, level):
    assert one(spark, lambda c: numbers.severity(c, numbers.ERROR_RATE_LIMITS), value, "double") == level


def test_times(spark):
    at = F.lit("2024-03-05 17:45:59.123456").cast("timestamp")
    row = spark.range(1).select(
        times.iso_text(times.bucket_start(at, 21600)).alias("bucket"),
        times.day_number(at).alias("day"),
        times.iso_millis(times.to_millis(at)).alias("ms"),
        times.iso_millis(times.to_seconds(at)).alias("s"),
        times.millis_between(at, at + F.expr("interval 1500 microseconds")).alias("between"),
    )
    assert tuple(row.first()) == (
        "2024-03-05T12:00:00", 20240305, "2024-03-05T17:45:59.123", "2024-03-05T17:45:59.000", 1.5,
    )
    with pytest.raises(ValueError):
        times.window_hours("2h")


def test_an_engine_gets_texts_in_parts_of_a_batch(spark):
    class Sizes:
        def redact(self, texts):
            return texts + f" {len(texts) <= 500}"

    rows = spark.range(0, 3000, 1, 1).select("id", redaction.by_engine(Sizes)(F.concat(F.lit("t"), "id")).alias("r"))
    assert [tuple(x) for x in rows.select("id", "r.text", "r.changed").orderBy("id").collect()] == [(i, f"t{i} True", True) for i in range(3000)]
