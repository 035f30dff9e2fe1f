"""Redaction, previews and the text rules, over whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from callsight.functions import numbers, redaction, text, times
from checks import inputs
from checks.sql import EVENTS, iso, model_of

QUERIES, SQL = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def scrubbed(expr: str, rules) -> str:
    """The chain of rules in the SQL engine's dialect."""
    for pattern, token in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{token}', 'g')"
    return expr


def redacted_documents(rules):
    def query(spark, sf_dir):
        found = inputs.table(spark, sf_dir, "documents").select(
            "doc_id", redaction.by_rules(rules)(F.col("text")).alias("r")
        )
        return found.select("doc_id", F.col("r.text").alias("text"), F.col("r.changed").alias("changed"))

    return query


for _name, _rules in (("redact_worker", redaction.WORKER_RULES), ("redact_client", redaction.CLIENT_RULES)):
    register(
        _name,
        redacted_documents(_rules),
        f"""WITH r AS (SELECT doc_id, text AS before, {scrubbed('text', _rules)} AS text FROM documents)
        SELECT doc_id, text, before <> text AS changed FROM r""",
    )

register(
    "redact_events",
    lambda s, d: redaction.redact_events(inputs.logs_with_previews(s, d)).select(
        "request_id", "input_preview", "output_preview", "redacted", times.iso_millis(F.col("created_at")).alias("created_at")
    ),
    f"""WITH {EVENTS}, t AS (
      SELECT request_id, substr(COALESCE(text, ''), 1, 500) AS before, COALESCE(source, '') AS output_preview, created_at
      FROM calls LEFT JOIN documents ON doc_id = event_id)
    SELECT request_id, {scrubbed('before', redaction.WORKER_RULES)} AS input_preview, output_preview,
      CAST({scrubbed('before', redaction.WORKER_RULES)} <> before AS INTEGER) AS redacted, {iso('created_at')} AS created_at
    FROM t""",
)
register(
    "preview",
    lambda s, d: inputs.table(s, d, "documents").select(
        "doc_id",
        text.preview(F.col("text")).alias("plain"),
        text.preview(F.col("text"), 200, redact=True).alias("scrubbed"),
    ),
    f"""SELECT doc_id, substr(COALESCE(text, ''), 1, 500) AS plain,
      {scrubbed("substr(COALESCE(text, ''), 1, 200)", redaction.CLIENT_RULES)} AS scrubbed FROM documents""",
)


class WordEngine:
    """An outside engine: takes every word 'the' for a name."""

    def redact(self, texts: pd.Series) -> pd.Series:
        return texts.str.replace(r"(?<![^ ])the(?![^ ])", "[NAME]", regex=True)


def custom_engine(spark, sf_dir):
    redactor = redaction.choose("Words", {"words": WordEngine})
    found = inputs.table(spark, sf_dir, "documents").select("doc_id", redactor(F.col("text")).alias("r"))
    return found.select("doc_id", F.col("r.text").alias("text"), F.col("r.changed").alias("changed"))


register(
    "redact_custom_engine",
    custom_engine,
    """WITH r AS (SELECT doc_id, text AS before,
      array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN w = 'the' THEN '[NAME]' ELSE w END), ' ') AS text
      FROM documents)
    SELECT doc_id, text, before <> text AS changed FROM r""",
)
register(
    "redact_engine_none",
    lambda s, d: inputs.table(s, d, "documents")
    .select("doc_id", redaction.choose("NONE")(F.col("text")).alias("r"))
    .select("doc_id", F.col("r.text").alias("text"), F.col("r.changed").alias("changed")),
    "SELECT doc_id, text, false AS changed FROM documents",
)
register(
    "provider_from_model",
    lambda s, d: inputs.table(s, d, "events").selectExpr("event_id", f"{inputs.model_of('event_id')} as model").select(
        "event_id",
        text.provider_from_model(F.col("model")).alias("hosted"),
        text.provider_from_model(F.col("model"), text.LOCAL_LABEL).alias("local"),
    ),
    f"""WITH m AS (SELECT event_id, {model_of('event_id')} AS model FROM events)
    SELECT event_id, CASE WHEN contains(model, '/') THEN split_part(model, '/', 1) ELSE 'openrouter' END AS hosted,
      CASE WHEN contains(model, '/') THEN split_part(model, '/', 1) ELSE 'ollama' END AS local FROM m""",
)
register(
    "estimate_tokens",
    lambda s, d: inputs.table(s, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens")),
    "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents",
)
register(
    "titles",
    lambda s, d: inputs.table(s, d, "documents").select("doc_id", text.title(F.col("text")).alias("title")),
    r"""WITH t AS (SELECT doc_id, replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS line FROM documents)
    SELECT doc_id, CASE WHEN length(line) > 60 THEN substr(line, 1, 60) || '…' ELSE line END AS title FROM t""",
)
register(
    "human_number",
    lambda s, d: inputs.table(s, d, "orders").selectExpr("o_orderkey", "cast(o_totalprice * (1 + o_orderkey % 50) as bigint) as n").select(
        "o_orderkey",
        numbers.human_number(F.col("n")).alias("short"),
        numbers.human_number(F.col("n") % 5000).alias("small"),
        numbers.money(F.col("n") / 1000).alias("money"),
        numbers.milliseconds_text(F.col("n")).alias("ms"),
        numbers.percent_text(numbers.round_even(F.col("n") % 10000 / 100, 2)).alias("percent"),
    ),
    """WITH v AS (SELECT o_orderkey, CAST(trunc(o_totalprice * (1 + o_orderkey % 50)) AS BIGINT) AS n FROM orders),
    w AS (SELECT *, n % 5000 AS m FROM v)
    SELECT o_orderkey,
      CASE WHEN n >= 1000000 THEN printf('%.1fM', (n + CASE WHEN n % 1000000 = 250000 THEN 1 ELSE 0 END) / 1000000.0::DOUBLE)
           WHEN n >= 1000 THEN printf('%.1fk', (n + CASE WHEN n % 1000 = 250 THEN 1 ELSE 0 END) / 1000.0::DOUBLE)
           ELSE CAST(n AS VARCHAR) END AS short,
      CASE WHEN m >= 1000 THEN printf('%.1fk', (m + CASE WHEN m % 1000 = 250 THEN 1 ELSE 0 END) / 1000.0::DOUBLE)
           ELSE CAST(m AS VARCHAR) END AS small,
      printf('$%.4f', n / 1000.0::DOUBLE) AS money, n || 'ms' AS ms,
      regexp_replace(printf('%.2f', (n % 10000) / 100.0::DOUBLE), '\\.?0+$', '') || '%' AS percent FROM w""",
)
register(
    "zero_fill",
    lambda s, d: inputs.table(s, d, "documents").selectExpr(
        "doc_id", "case doc_id % 4 when 0 then cast(n_chars as string) when 1 then text when 2 then concat(n_chars, '.5') end as raw"
    ).select("doc_id", numbers.zero_int(F.col("raw")).alias("whole"), numbers.zero_float(F.col("raw")).alias("real")),
    """WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN text WHEN 2 THEN n_chars || '.5' END AS raw FROM documents)
    SELECT doc_id, CASE WHEN contains(raw, '.') THEN 0 ELSE COALESCE(TRY_CAST(raw AS BIGINT), 0) END AS whole,
      COALESCE(TRY_CAST(raw AS DOUBLE), 0.0) AS "real" FROM r""",
)
register(
    "time_parts",
    lambda s, d: inputs.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at")).select(
        "event_id",
        times.iso_text(times.bucket_start(F.col("at"), 1800)).alias("bucket"),
        times.day_number(F.col("at")).alias("day"),
        times.iso_millis(times.to_millis(F.col("at"))).alias("millis"),
        times.iso_millis(times.to_seconds(F.col("at")) + times.days(90)).alias("expires"),
        times.iso_millis(F.col("at") - times.hours(6)).alias("since"),
    ),
    f"""SELECT event_id, strftime(time_bucket(INTERVAL 1800 SECOND, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S') AS bucket,
      CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, {iso("date_trunc('millisecond', ts)")} AS millis,
      {iso("date_trunc('second', ts) + INTERVAL 90 DAY")} AS expires, {iso('ts - INTERVAL 6 HOUR')} AS since FROM events""",
)
