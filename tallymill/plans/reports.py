"""The three reports, each with one pass over its large input."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators import commerce, logs
from tallymill.session import work_folder
from tallymill.sources.tables import Settled, settle
from tallymill.sources.textlogs import input_bytes, read_lines


@dataclass(frozen=True)
class LogReport:
    """Totals (one row, the lines submitted first) and ranked keys (at most 110 rows); ``close`` deletes what they read."""

    totals: DataFrame
    facets: DataFrame
    cells: Settled

    def facet(self, dimension: str) -> DataFrame:
        return self.facets.where(self.facets["dimension"] == dimension).drop("dimension").orderBy("rank")

    def close(self) -> None:
        self.cells.delete()


def log_report(lines: DataFrame) -> LogReport:
    """Totals and facets from one pass over the lines.

    The counts per key are settled under the checkpoint folder, by dimension, so that neither result parses the lines
    again and the totals do not read the counts of paths. Submitted lines are one of the counts.
    """
    cells = settle(logs.log_cells(logs.parse_lines(lines)), work_folder(lines.sparkSession), "log-cells", ("dimension",))
    return LogReport(logs.totals_from_cells(cells.table), logs.rank_facets(cells.table), cells)


def log_file_report(spark, paths: Sequence[str], parallelism: int | None = None) -> LogReport:
    """The report of text or gzip files; the totals begin with their number and bytes."""
    report = log_report(read_lines(spark, paths, parallelism))
    return LogReport(input_bytes(spark, paths).crossJoin(report.totals), report.facets, report.cells)  # one row each


def log_reconciliation(report: LogReport) -> DataFrame:
    """Lines counted at the source against lines by outcome."""
    found = F.col("matched_lines") + F.col("unmatched_lines") + F.col("bad_number_lines")
    return report.totals.select(
        "submitted_lines",
        "matched_lines",
        "unmatched_lines",
        "bad_number_lines",
        (F.col("submitted_lines") == found).alias("reconciled"),
    )


@dataclass(frozen=True)
class CommerceReport:
    """The summaries asked for, sorted; ``close`` deletes what they read."""

    summaries: dict[str, DataFrame]
    cells: Settled

    def __getattr__(self, name: str) -> DataFrame:
        if name in commerce.SUMMARIES and name in self.summaries:
            return self.summaries[name]
        raise AttributeError(name)

    def top(self, name: str, n: int) -> DataFrame:
        return commerce.top_of(commerce.SUMMARIES[name], self.summaries[name], n)

    def close(self) -> None:
        self.cells.delete()


def commerce_report(
    orders: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    names: Sequence[str] = tuple(commerce.SUMMARIES),
    **join_options,
) -> CommerceReport:
    """The named summaries, all three by default, from one pass over the orders, settled like the log report."""
    folder = work_folder(orders.sparkSession)
    scored = commerce.score_orders(orders, products, customers, **join_options)
    cells = settle(commerce.summary_cells(scored, names), folder, "commerce-cells", ("summary",))
    return CommerceReport({name: commerce.summary_from_cells(cells.table, name) for name in names}, cells)
