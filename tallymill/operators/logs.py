"""Log analytics: parse lines, count totals, rank the keys of each facet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.logline import (
    CLIENT_ERROR,
    EXCEPTION_PATTERN,
    FACET_LIMITS,
    LINE_FIELDS,
    SERVER_ERROR,
    SLOW_CALL_PATTERN,
    SLOW_MS,
    TAIL,
    line_pattern,
    split_line,
)

MATCHED, UNMATCHED, BAD_NUMBER = "matched", "unmatched", "bad_number"
_READ = ("level", "service", "method", "status", "latency", "path", TAIL)


def parse_log_fields(lines: DataFrame) -> DataFrame:
    """All eleven fields of every matching line as text, with status and latency as numbers."""
    names = [name for name, _, _ in LINE_FIELDS]
    numbers = {"status": F.col("status").cast("int"), "latency": F.col("latency").try_cast("bigint")}
    return (
        split_line(lines, names)
        .where("level is not null")
        .select(*[numbers.get(n, F.col(n)).alias("latency_ms" if n == "latency" else n) for n in names])
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every line with its outcome and the fields that the report reads.

    The outcome is ``matched``, ``unmatched``, or ``bad_number`` for a line whose latency does not fit a bigint. Only
    matched lines have fields.
    """
    parsed = split_line(lines, _READ).select("*", F.col("latency").try_cast("bigint").alias("latency_ms"))
    level, path, latency = F.col("level"), F.col("path"), F.col("latency")
    # The first place where a slow call can be found is the request itself: nothing before it can hold
    # "path=" after white space. Only a tail with another "method=" needs a search.
    own_call = path.startswith("/api/") & (F.length(path) > 5) & (F.length(latency) >= 4) & ~latency.startswith("0")
    searched = F.regexp_replace(F.col(TAIL), F.lit(f"(?s)^.*?{SLOW_CALL_PATTERN}.*$"), F.lit("$1 $2"))
    found = parsed.select(
        "*",
        F.when(level == "ERROR", F.regexp_extract("value", EXCEPTION_PATTERN, 1)).alias("exception"),
        F.when(own_call, F.concat_ws(" ", "method", "path"))
        .when(F.col(TAIL).contains("method="), searched)
        .alias("slow_endpoint"),
    )
    good = F.col("latency_ms").isNotNull()
    return found.select(
        "value",
        F.when(level.isNull(), UNMATCHED).when(good, MATCHED).otherwise(BAD_NUMBER).alias("outcome"),
        *[F.when(good, F.col(name)).alias(name) for name in ("level", "service", "method", "path")],
        F.when(good, F.col("status").cast("int")).alias("status"),
        "latency_ms",
        F.when(good & (F.col("exception") != ""), F.col("exception")).alias("exception"),
        F.when(good & (F.col("slow_endpoint") != F.col(TAIL)), F.col("slow_endpoint")).alias("slow_endpoint"),
    )


def unmatched_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").rlike(line_pattern(()))).select("value")


def quarantined_lines(lines: DataFrame) -> DataFrame:
    """Lines of the right form whose latency does not fit a bigint. Such a number has 19 digits at least."""
    suspects = lines.where(F.col("value").rlike(r"latencyMs=\d{19}"))
    return parse_lines(suspects).where(F.col("outcome") == BAD_NUMBER).select("value")


# A latency is summed in two halves, so that a few absurd ones cannot overflow the sum and fail the whole job.
_HALF_BITS = 31
_HALF = 1 << _HALF_BITS


def _latency_measures() -> dict[str, Column]:
    latency = F.col("latency_ms")
    return {
        "latency_high": F.sum(F.shiftright(latency, _HALF_BITS)),
        "latency_low": F.sum(latency.bitwiseAND(F.lit(_HALF - 1))),
        "max_latency": F.max(latency),
        "slow_requests": F.count_if(latency >= SLOW_MS),
    }


SOURCE = "source"


def _totals_row(counted: DataFrame, *before: str) -> DataFrame:
    """Totals in their published form from the counters and the two latency halves."""
    zero = F.lit(0).cast("bigint")
    high, low = F.coalesce("latency_high", zero), F.coalesce("latency_low", zero)
    exact = high.cast("decimal(20,0)") * F.lit(_HALF).cast("decimal(10,0)") + low
    mean = exact.cast("double")
    return counted.select(
        *before,
        "total_lines",
        "matched_lines",
        "unmatched_lines",
        "bad_number_lines",
        exact.alias("total_latency"),
        F.coalesce("max_latency", zero).alias("max_latency"),
        F.when(F.col("total_lines") > 0, mean / F.col("total_lines")).otherwise(F.lit(0.0)).alias("avg_latency"),
        F.when(F.col("matched_lines") > 0, mean / F.col("matched_lines"))
        .otherwise(F.lit(0.0))
        .alias("avg_latency_matched"),
        *["slow_requests", "client_errors", "server_errors", "error_lines", "warn_lines"],
    )


def log_totals(parsed: DataFrame) -> DataFrame:
    """One row of counters and latencies. The average latency is over all lines, matched or not."""
    outcome, status = F.col("outcome"), F.col("status")
    return _totals_row(
        parsed.agg(
            F.count("*").alias("total_lines"),
            F.count_if(outcome == MATCHED).alias("matched_lines"),
            F.count_if(outcome == UNMATCHED).alias("unmatched_lines"),
            F.count_if(outcome == BAD_NUMBER).alias("bad_number_lines"),
            *[measure.alias(name) for name, measure in _latency_measures().items()],
            F.count_if((status >= CLIENT_ERROR) & (status < SERVER_ERROR)).alias("client_errors"),
            F.count_if(status >= SERVER_ERROR).alias("server_errors"),
            F.count_if(F.col("level") == "ERROR").alias("error_lines"),
            F.count_if(F.col("level") == "WARN").alias("warn_lines"),
        )
    )


def _facet_entries(dimensions, *others: Column) -> Column:
    return F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions], *others
    )


def facet_counts(parsed: DataFrame, dimensions=tuple(FACET_LIMITS)) -> DataFrame:
    """Lines per (dimension, key) in one pass; partial counts keep the shuffle to the distinct keys of each task."""
    return (
        parsed.select(F.inline(_facet_entries(dimensions)))
        .where("key is not null")
        .groupBy("dimension", "key")
        .agg(F.count("*").alias("line_count"))
    )


def log_status_classes(parsed: DataFrame) -> DataFrame:
    """Matched lines per status class; everything from 500 up counts as a server error."""
    status = F.col("key").cast("int")
    status_class = F.when(status >= SERVER_ERROR, "server").when(status >= CLIENT_ERROR, "client").otherwise("other")
    return (
        facet_counts(parsed, ("status",))
        .groupBy(status_class.alias("status_class"))
        .agg(F.sum("line_count").alias("line_count"))
    )


def rank_facets(counts: DataFrame) -> DataFrame:
    """The most frequent keys of each facet, ties by key.

    The first limit is the same for all facets, which lets Spark drop lower ranks in every task before the keys of
    a facet come together; the second is the facet's own.
    """
    order = Window.partitionBy("dimension").orderBy(F.desc("line_count"), F.asc("key"))
    limit = F.coalesce(*[F.when(F.col("dimension") == d, F.lit(n)) for d, n in FACET_LIMITS.items()])
    return (
        counts.where(F.col("dimension").isin(*FACET_LIMITS))
        .select("dimension", "key", "line_count", F.row_number().over(order).alias("rank"))
        .where((F.col("rank") <= max(FACET_LIMITS.values())) & (F.col("rank") <= limit))
    )


def log_facets(parsed: DataFrame) -> DataFrame:
    """The seven ranked count tables in one long table."""
    return rank_facets(facet_counts(parsed))


def log_facet(parsed: DataFrame, dimension: str) -> DataFrame:
    """One ranked count table. Only its own field is read and grouped."""
    top = (
        facet_counts(parsed, (dimension,))
        .orderBy(F.desc("line_count"), F.asc("key"))
        .limit(FACET_LIMITS[dimension])
    )
    # A window without partitions, over at most the limit's few rows.
    rank = F.row_number().over(Window.orderBy(F.desc("line_count"), F.asc("key")))
    return top.select("key", "line_count", rank.alias("rank"))


def log_cells(parsed: DataFrame) -> DataFrame:
    """All that the report needs from the lines, in one pass: counts per (dimension, key).

    The extra dimension ``outcome`` carries the latency measures, and ``source`` counts every line submitted, whatever became of
    it. It is a count like the others, so a task that runs again counts its lines once. Cells of several inputs can be added up.
    """
    submitted = F.struct(F.lit(SOURCE).alias("dimension"), F.lit("").alias("key"))
    carried = F.when(F.col("dimension") == "outcome", F.col("latency_ms"))
    return (
        parsed.select(F.inline(_facet_entries(("outcome", *FACET_LIMITS), submitted)), "latency_ms")
        .where("key is not null")
        .select("dimension", "key", carried.alias("latency_ms"))
        .groupBy("dimension", "key")
        .agg(F.count("*").alias("line_count"), *[m.alias(n) for n, m in _latency_measures().items()])
    )


def totals_from_cells(cells: DataFrame) -> DataFrame:
    """The row of :func:`log_totals` after the lines submitted, from cells of the bounded dimensions only."""
    key, dimension = F.col("key"), F.col("dimension")
    status = F.when(dimension == "status", key).cast("int")

    def lines(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("line_count"))), F.lit(0))

    def lines_of(wanted: str, value: str) -> Column:
        return lines((dimension == wanted) & (key == value))

    return _totals_row(
        cells.where(dimension.isin(SOURCE, "outcome", "level", "status")).agg(
            lines(dimension == SOURCE).alias("submitted_lines"),
            lines(dimension == "outcome").alias("total_lines"),
            *[lines_of("outcome", o).alias(f"{o}_lines") for o in (MATCHED, UNMATCHED, BAD_NUMBER)],
            F.sum("latency_high").alias("latency_high"),
            F.sum("latency_low").alias("latency_low"),
            F.max("max_latency").alias("max_latency"),
            F.coalesce(F.sum("slow_requests"), F.lit(0)).alias("slow_requests"),
            lines((status >= CLIENT_ERROR) & (status < SERVER_ERROR)).alias("client_errors"),
            lines(status >= SERVER_ERROR).alias("server_errors"),
            lines_of("level", "ERROR").alias("error_lines"),
            lines_of("level", "WARN").alias("warn_lines"),
        ),
        "submitted_lines",
    )
