"""The log line format: its pattern, and column expressions that read fields with one match per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of a log line in order, as (name, text of the field, text around it).
LINE_FIELDS = (
    ("timestamp", r"\S+", "{}"),
    ("level", r"INFO|WARN|ERROR|DEBUG|TRACE", "{}"),
    ("service", r"[a-zA-Z0-9\-]+", r"\[{}]"),
    ("trace_id", r"[a-fA-F0-9]+", r"\[traceId={}]"),
    ("user_id", r"\d+", "userId={}"),
    ("ip", r"(?:\d{1,3}\.){3}\d{1,3}", "ip={}"),
    ("method", r"GET|POST|PUT|PATCH|DELETE", "method={}"),
    ("path", r"\S+", "path={}"),
    ("status", r"\d{3}", "status={}"),
    ("latency", r"\d+", "latencyMs={}"),
    ("message", r'[^"]*', 'msg="{}"'),
)
# Fixed value: an error line names its exception before its stack; the last such pair of the line counts.
EXCEPTION_PATTERN = r'ERROR.*exception="([^"]+)".*stack="([^"]+)"'
# Fixed value: a call to the API that took a second or more, anywhere in the line.
SLOW_CALL_PATTERN = (
    r"method=(GET|POST|PUT|PATCH|DELETE)\s+path=(/api/\S+)\s+status=\d{3}\s+latencyMs=([1-9]\d{3,})"
)
# Latency in ms from which a request is slow, and the first client and server error status.
SLOW_MS = 1000
CLIENT_ERROR = 400
SERVER_ERROR = 500
# Facets of the report and how many keys each shows.
FACET_LIMITS = {
    "level": 20,
    "service": 20,
    "method": 20,
    "status": 30,
    "path": 10,
    "exception": 10,
    "slow_endpoint": 10,
}

# Group name for everything after the message's opening quote, for callers that look at the tail.
TAIL = "tail"


def line_pattern(names: Sequence[str]) -> str:
    """Pattern of a whole line that captures only the fields in ``names``, in line order."""
    parts = []
    for name, text, around in LINE_FIELDS[:-1]:
        parts.append(around.format(f"({text})" if name in names else f"(?:{text})"))
    name, text, around = LINE_FIELDS[-1]
    end = around.format(f"({text})" if name in names else text) + ".*"
    if TAIL in names:
        end = f"({end})"
    # \z and not $: the latter also accepts a line terminator before the end.
    return "^" + r"\s+".join([*parts, end]) + r"\z"


def split_line(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add a column per name with that field of ``value``, null in lines that do not match.

    Each line is matched once: a matching line is rewritten to its captured fields with a space between, and the
    result is split. A line that does not match is left as it is, which no rewritten line ever equals. No field but
    the message or the tail can hold white space, so either of the two may be asked for, as the last name.

    The rewritten line goes through ``explode`` of one element on purpose: the optimizer moves a later filter down
    through projections, and would run the match once more there, but it cannot move it through a generator.
    """
    in_order = [name for name, _, _ in LINE_FIELDS if name in names] + [n for n in names if n == TAIL]
    template = " ".join(f"${in_order.index(name) + 1}" for name in names)
    value = F.col("value")
    rewritten = F.regexp_replace(value, F.lit(line_pattern(names)), F.lit(template))
    fields = F.when(F.col("rewritten") != value, F.split("rewritten", " ", len(names)))
    return (
        lines.select("value", F.explode(F.array(rewritten)).alias("rewritten"))
        .select("value", fields.alias("fields"))
        .select("value", *[F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(names)])
    )
