"""Text rules: previews, titles, providers, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsight.functions import redaction

# Length of a preview and of a title, labels of calls without a prefix.
PREVIEW_CHARS = 500
TITLE_CHARS = 60
# Everything that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
HOSTED_LABEL = "openrouter"
LOCAL_LABEL = "ollama"


def blank(col: Column) -> Column:
    """null becomes ''."""
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def missing_if_blank(col: Column) -> Column:
    """'' counts as missing."""
    return F.nullif(col, F.lit(""))


def preview(col: Column, limit: int = PREVIEW_CHARS, redact: bool = False) -> Column:
    """The first `limit` characters; redaction sees the cut text only."""
    cut = F.substring(blank(col), 1, limit)
    return redaction.scrub(cut, redaction.CLIENT_RULES) if redact else cut


def title(col: Column, limit: int = TITLE_CHARS) -> Column:
    """Trim, put newlines on one line, cut with an ellipsis."""
    line = F.replace(strip(col), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def provider_from_model(col: Column, default: str = HOSTED_LABEL) -> Column:
    """'a/b' -> 'a'; no slash, empty or null -> the default label."""
    return F.when(F.contains(col, F.lit("/")), F.split_part(col, F.lit("/"), F.lit(1))).otherwise(F.lit(default))


def estimate_tokens(col: Column) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(blank(col)) / F.lit(4)).cast("bigint"))


def session_key(session_id: Column, request_id: Column) -> Column:
    """The key that keeps one session's events together and in order."""
    return F.coalesce(missing_if_blank(session_id), request_id)


def new_request_id() -> Column:
    """A random id. Not repeatable: write the rows before using them twice."""
    return F.concat(F.lit("req_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def message_status(call_status: Column) -> Column:
    """State of the message that a call produced."""
    return (
        F.when(call_status == "error", "error")
        .when(call_status == "cancelled", "cancelled")
        .otherwise("complete")
    )
