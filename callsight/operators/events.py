"""From raw JSON to valid events, dead letters and log rows.

Each field is judged by the kind of JSON value it holds, with the lenient rules of the
event contract: numbers may come as text, whole floats count as integers, times may be
ISO text or epoch numbers. A record is parsed twice by the built-in parser, once for the
texts of its fields and once for their kinds; casting texts is far cheaper than casting
VARIANT values.

Stricter than the contract, on purpose: token counts outside 0 ... 2^32-1, numbers that
are not finite and repeated keys within `metadata` make a record a dead letter, as the
log table could not hold them or they are ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.functions import text
from callsight.functions.times import to_millis
from callsight.schemas import CALL_STATUSES, EVENT_COLUMNS, MAX_TOKENS

# The type of each field, in the order of the log table.
FIELDS = {
    "request_id": "text",
    "session_id": "text",
    "conversation_id": "text",
    "provider": "text",
    "model": "text",
    "status": "status",
    "error_type": "text",
    "error_message": "text",
    "latency_ms": "number",
    "ttft_ms": "number",
    "prompt_tokens": "count",
    "completion_tokens": "count",
    "total_tokens": "count",
    "cost_usd": "number",
    "input_preview": "text",
    "output_preview": "text",
    "redacted": "flag",
    "created_at": "time",
    "metadata": "object",
}
REQUIRED = ("provider", "model", "status")
NULLABLE = (
    "session_id",
    "conversation_id",
    "error_type",
    "error_message",
    "ttft_ms",
    "cost_usd",
    "input_preview",
    "output_preview",
)
DEFAULTS = {
    "latency_ms": "0D",
    "prompt_tokens": "0L",
    "completion_tokens": "0L",
    "total_tokens": "0L",
    "redacted": "false",
    "metadata": "'{}'",
}
# Words that stand for a flag.
YES = ("1", "on", "t", "true", "y", "yes")
NO = ("0", "off", "f", "false", "n", "no")
# Epoch numbers above this are milliseconds, others seconds.
EPOCH_SECONDS_LIMIT = "2e10"

# Standard JSON only.
_PARSER = "map('allowSingleQuotes', 'false')"

_DECIMAL = r"'^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$'"
_INTEGER = r"'^\\s*[+-]?[0-9]+([.]0+)?\\s*$'"
_ZONE = r"'[Tt _].*([Zz]|[+-][0-9]{2}:?[0-9]{2})$'"
_ISO = (
    r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([Tt _][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?([Zz]|[+-][0-9]{2}:?[0-9]{2})?)?$'"
)


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _typed(kind: str, s: str, k: str) -> str:
    """SQL for the value of a field, null when it does not fit. `s` is the field's text
    and `k` the kind of its JSON value."""
    is_text, is_bool = f"{k} = 'STRING'", f"{k} = 'BOOLEAN'"
    is_number = f"({k} in ('BIGINT', 'DOUBLE', 'FLOAT') or startswith({k}, 'DECIMAL'))"
    double = f"try_cast(trim({s}) as double)"
    if kind == "text":
        return f"if({is_text}, {s}, null)"
    if kind == "status":
        return f"if({is_text} and {s} in ({_words(CALL_STATUSES)}), {s}, null)"
    if kind == "number":
        digits = f"regexp_replace({s}, '(?<=[0-9])_(?=[0-9])', '')"
        return f"""case when {is_number} and {s} rlike {_DECIMAL} then {double}
            when {is_bool} then if({s} = 'true', 1D, 0D)
            when {is_text} and {digits} rlike {_DECIMAL} then try_cast(trim({digits}) as double) end"""
    if kind == "count":
        digits = f"regexp_replace({s}, '(?<=[0-9])_(?=[0-9])', '')"
        return f"""case when {k} = 'BIGINT' then try_cast({s} as bigint)
            when {is_number} and {double} = floor({double}) then try_cast({double} as bigint)
            when {is_bool} then if({s} = 'true', 1L, 0L)
            when {is_text} and {digits} rlike {_INTEGER}
              then try_cast(split_part(trim({digits}), '.', 1) as bigint) end"""
    if kind == "flag":
        return f"""case when {is_bool} then {s} = 'true'
            when {is_number} and {double} in (0D, 1D) then {double} = 1D
            when {is_text} and lower({s}) in ({_words(YES)}) then true
            when {is_text} and lower({s}) in ({_words(NO)}) then false end"""
    if kind == "time":
        # The cast wants seconds.
        iso = f"regexp_replace(translate(upper({s}), '_,', ' .'), '^(.{{16}})(Z|[+-]|$)', '$1:00$2')"
        # Without a zone it is UTC, whatever the session's zone.
        zoned = f"""case when {s} rlike {_ZONE} then regexp_replace({iso}, '([0-9]{{2}})([0-9]{{2}})$', '$1:$2') when length({s}) = 10 then concat({iso}, 'T00:00:00Z')
            else concat({iso}, 'Z') end"""
        return f"""case when ({is_number} or {is_text}) and {s} rlike {_DECIMAL} then {_epoch(double)}
            when {is_text} and {s} rlike {_ISO} then try_cast({zoned} as timestamp) end"""
    if kind == "object":
        return f"if(startswith({k}, 'OBJECT'), {s}, null)"
    raise ValueError(kind)


def _epoch(number: str) -> str:
    seconds = f"if(abs({number}) > {EPOCH_SECONDS_LIMIT}, {number} / 1000, {number})"
    return f"timestamp_micros(try_cast(round({seconds} * 1000000) as bigint))"


def _parse(value: str) -> str:
    """SQL for a record's fields, twice: their texts and their JSON values.

    The parser ignores what follows the first value. The record is parsed once as the
    only element of a list and once as the only field of an object: text after the
    record's end can look like the end of one of the two, not of both.
    """
    texts, values = (", ".join(f"{n}: {t}" for n in FIELDS) for t in ("string", "variant"))
    listed = f"from_json(concat('[', {value}, ']'), 'array<struct<{texts}>>', {_PARSER})"
    nested = f"from_json(concat('{{\"r\":', {value}, '}}'), 'r struct<{values}>', {_PARSER}).r"
    return f"struct({listed} as listed, {nested} as nested)"


def _fields(at: str) -> str:
    """SQL for the texts (`s`) and kinds (`k`) of a parsed record's fields, null where a
    field is missing; `n` is the number of records found."""
    kinds = ", ".join(f"schema_of_variant({at}.nested.{n}) as {n}" for n in FIELDS)
    return f"""named_struct('n', if({at}.nested is not null, size({at}.listed), 0),
        's', get({at}.listed, 0), 'k', struct({kinds}))"""


def _values(at: str) -> str:
    """SQL for a struct of typed values, from a record's fields."""
    values = (f"{_typed(kind, f'{at}.s.{n}', f'{at}.k.{n}')} as {n}" for n, kind in FIELDS.items())
    return f"struct({', '.join(values)})"


def _reasons(event: str, at: str) -> str:
    """SQL for the names of the bad fields of an event: required but without a value, or
    there but without one that fits."""
    bad = []
    for name, kind in FIELDS.items():
        misfit = f"{event}.{name} is null"
        if kind == "count":
            misfit = f"not coalesce({event}.{name} between 0 and {MAX_TOKENS}, false)"
        if name in NULLABLE:
            misfit += f" and {at}.s.{name} is not null"
        elif name not in REQUIRED:
            misfit += f" and ({at}.k.{name} is not null or {at}.s.{name} is not null)"
        bad.append(f"if({misfit}, '{name}', null)")
    is_record = f"coalesce({at}.n = 1 and {at}.s is not null, false)"
    return f"if({is_record}, array_compact(array({', '.join(bad)})), array('json'))"


def _judged(texts: str) -> str:
    """SQL for the `event` and the `reasons` of each of a list of JSON texts.

    Each step is a function of the one before, so its result is made once per record. The steps
    are not made into one method of generated code: that is too long for the JIT (8,000 bytes), and
    what runs without it takes several times as long.
    """
    fields = f"transform(transform({texts}, t -> {_parse('t')}), d -> {_fields('d')})"
    typed = f"transform({fields}, f -> struct(f as f, {_values('f')} as event))"
    return f"transform({typed}, x -> struct(x.event as event, {_reasons('x.event', 'x.f')} as reasons))"


def _once(df: DataFrame, name: str, expr: str) -> DataFrame:
    """Adds a column that later filters cannot pull apart: a predicate on a generated
    column stays above it, so the parse runs once per record."""
    return df.select("*", F.explode(F.array(F.expr(expr))).alias(name))


def parse_events(df: DataFrame, col: str = "value") -> DataFrame:
    """Adds `event` (typed fields, nulls where missing) and `reasons` (names of the bad
    fields, or `json` when the bytes are no UTF-8 or the text is no JSON object). No reasons
    means valid. A record that has no time of its own is bad if its event has none either."""
    text = f"cast({col} as string)"
    out = _once(df, "_text", f"if(is_valid_utf8({text}), {text}, null)")
    out = _once(out, "_judged", f"get({_judged('array(_text)')}, 0)")
    reasons = "_judged.reasons"
    if "timestamp" in df.columns:
        timeless = f"size({reasons}) = 0 and _judged.event.created_at is null and timestamp is null"
        reasons = f"if({timeless}, array('created_at'), {reasons})"
    return out.selectExpr(*df.columns, "_judged.event as event", f"{reasons} as reasons")


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead). Dead letters keep the record as it came, and the reasons."""
    ok = F.size("reasons") == 0
    valid = parsed.where(ok).drop("reasons")
    return valid, parsed.where(~ok).drop("event")


def apply_defaults(valid: DataFrame) -> DataFrame:
    """Events with missing fields filled.

    A missing id or time comes from the record's place in the topic and its time, not
    from chance and the clock, so that reading a record again gives the same event.
    """
    event = F.col("event")
    place = F.concat_ws("/", "topic", "partition", "offset")
    origin = F.when(F.col("offset").isNotNull(), place).otherwise(
        F.concat_ws("/", "key", F.col("value").cast("string"), F.col("timestamp").cast("string"))
    )
    made_up = {
        "request_id": F.concat(F.lit("req_"), F.substring(F.sha2(origin, 256), 1, 32)),
        "created_at": F.col("timestamp"),
    }
    fill = {name: F.expr(sql) for name, sql in DEFAULTS.items()} | made_up

    def filled(name: str) -> Column:
        return F.coalesce(event[name], fill[name]) if name in fill else event[name]

    return valid.select(*[filled(name).alias(name) for name in EVENT_COLUMNS])


def to_log_row(events: DataFrame) -> DataFrame:
    """The 19 columns the log table takes, in order: missing texts become '', missing
    numbers stay null, the flag becomes 0 or 1, times are cut to the millisecond."""

    def stored(name: str) -> Column:
        if name in ("redacted",):
            return F.col(name).cast("boolean").cast("int")
        if name == "created_at":
            return to_millis(F.col(name))
        if FIELDS[name] == "text":
            return text.blank(F.col(name))
        if name in DEFAULTS:
            return F.coalesce(F.col(name), F.expr(DEFAULTS[name]))
        return F.col(name)

    return events.select(*[stored(name).alias(name) for name in EVENT_COLUMNS])


def judge_batches(df: DataFrame, col: str = "value") -> DataFrame:
    """Client batches `{"events": [...]}`: adds `events` (their JSON texts), `accepted`
    (all of them valid, else nothing of the batch passes) and `n_events`. Row by row, so
    it also works on a stream."""
    objects = f"from_json(concat('{{\"r\":', {col}, '}}'), 'r struct<events: array<variant>>', {_PARSER}).r.events"
    listed = f"from_json(concat('[', {col}, ']'), 'array<struct<events: array<string>>>', {_PARSER})"
    valid = f"forall({_judged('events')}, x -> size(x.reasons) = 0)"
    batches = _once(df, "_b", f"struct({listed} as listed, {objects} as objects)")
    batches = _once(batches, "events", "if(size(_b.listed) = 1, get(_b.listed, 0).events, null)")
    whole = "forall(_b.objects, o -> startswith(schema_of_variant(o), 'OBJECT'))"
    accepted = f"coalesce(size(events) = size(_b.objects) and {whole} and {valid}, false)"
    return (
        _once(batches, "accepted", accepted)
        .withColumn("n_events", F.coalesce(F.nullif(F.size("events"), F.lit(-1)), F.lit(0)))
        .drop("_b")
    )


def split_batches(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused)."""
    return judged.where("accepted"), judged.where("not accepted")


def explode_batches(df: DataFrame, col: str = "value") -> DataFrame:
    """One row per event of the accepted batches, with its place and its JSON text."""
    accepted, _ = split_batches(judge_batches(df, col))
    keep = [c for c in df.columns if c != col]
    return accepted.select(*keep, F.posexplode("events").alias("position", col))
