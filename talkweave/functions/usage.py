"""Summary-request arithmetic: prompts, token budgets, responses, retries, endpoints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import params
from .timing import clock


def token_estimate(chars: Column, ratio: Column) -> Column:
    return F.greatest(F.ceil(chars / ratio), F.lit(1)).cast("bigint")


def prompt_line(at: Column, speaker: Column, source: Column, text: Column, tag_source: Column) -> Column:
    tag = F.when(tag_source & (source != ""), F.concat(F.lit(" ("), source, F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), clock(at), F.lit("] "), speaker, tag, F.lit(": "), text)


def needed_context(estimate: Column, overhead_pct: int = params.PROMPT_OVERHEAD_PCT,
                   buffer: int = params.OUTPUT_BUFFER) -> Column:
    """Estimate plus whole-number overhead plus room for the answer."""
    return (estimate + F.floor(estimate * overhead_pct / 100) + buffer).cast("bigint")


def requested_context(needed: Column, loaded: Column, limit: int = params.MAX_CONTEXT) -> Column:
    """Null: use the loaded model as it is; otherwise the context to ask for."""
    return F.when(F.coalesce(loaded >= needed, F.lit(False)), F.lit(None).cast("bigint")).otherwise(
        F.least(needed, F.lit(limit)).cast("bigint"))


def is_truncated(context: Column, used: Column, produced: Column) -> Column:
    room = context - used
    return (room > 0) & (produced >= room - 5)


def overflow_tokens(error_text: Column) -> Column:
    return F.regexp_extract(error_text, r"n_keep:\s*(\d+)", 1).try_cast("bigint")


RESPONSE = ("error STRUCT<message: STRING>, output ARRAY<STRUCT<type: STRING, content: STRING>>, "
            "choices ARRAY<STRUCT<message: STRUCT<content: STRING>>>, "
            "stats STRUCT<input_tokens: BIGINT, total_output_tokens: BIGINT>")


def parsed_response(body: Column) -> Column:
    """``error`` wins; else the first message output, or the first choice; stats only when both counts exist."""
    r = F.from_json(body, RESPONSE)
    message = F.get(F.filter(r["output"], lambda o: o["type"] == "message"), F.lit(0))["content"]
    content = F.coalesce(message, F.get(r["choices"], F.lit(0))["message"]["content"])
    complete = r["stats"]["input_tokens"].isNotNull() & r["stats"]["total_output_tokens"].isNotNull()
    error = F.coalesce(r["error"]["message"], F.when(content.isNull(), "empty response"))
    return F.struct(error.alias("error"), F.when(error.isNull(), content).alias("content"),
                    F.when(error.isNull() & complete, r["stats"]["input_tokens"]).alias("input_tokens"),
                    F.when(error.isNull() & complete, r["stats"]["total_output_tokens"]).alias("output_tokens"))


def is_retryable(status: Column) -> Column:
    return status.isin(*params.RETRYABLE_STATUS)


def retry_delay(attempt: Column, header: Column, now: Column, base: float, cap: float) -> Column:
    """A ``Retry-After`` in seconds or as an HTTP date, else doubling; never above ``cap``."""
    trimmed = F.trim(header)
    seconds = trimmed.try_cast("double")
    date_text = F.when(trimmed.rlike(r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT$"),
                       F.substring(trimmed, 6, 20))
    until = F.unix_timestamp(F.try_to_timestamp(date_text, F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_timestamp(now)
    asked = F.when(seconds.isNotNull(), F.when(seconds >= 0, seconds)).otherwise(
        F.greatest(until, F.lit(0)).cast("double"))
    asked = F.when(seconds.isNull() & until.isNull(), F.lit(None)).otherwise(asked)
    return F.least(F.coalesce(asked, base * F.pow(F.lit(2.0), attempt)), F.lit(cap))


def endpoint_host(endpoint: Column) -> Column:
    host = F.regexp_extract(endpoint, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^\[|\]$", ""), F.lit(""))


def endpoint_port(endpoint: Column) -> Column:
    return F.nullif(F.regexp_extract(
        endpoint, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:@]+):(\d+)", 1), F.lit(""))


def is_loopback(host: Column) -> Column:
    h = F.lower(host)
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|0*\d?\d)"
    return h.isin("localhost", "::1") | h.rlike(rf"^127\.{octet}\.{octet}\.{octet}$")


def disclosure(endpoint: Column) -> Column:
    """Where a summary went and whether the transcript left the machine; unreadable counts as remote."""
    host, port = endpoint_host(endpoint), endpoint_port(endpoint)
    local = F.coalesce(is_loopback(host), F.lit(False))
    place = F.when(port.isNull(), host).otherwise(F.concat(host, F.lit(":"), port))
    label = (F.when(host.isNull(), "remote (unknown)")
             .when(local, F.concat(F.lit("local ("), place, F.lit(")")))
             .otherwise(F.concat(F.lit("remote ("), host, F.lit(")"))))
    return F.struct(label.alias("label"), (~local).alias("transmitted"))
