"""Order scoring: value and flags per order, lookups of product and customer, scores, three summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.scoring import (
    CUSTOMER_FORMULAS,
    ORDER_FLAG_FORMULAS,
    ORDER_VALUE_FORMULAS,
    PRODUCT_FORMULAS,
    SCORE_FORMULAS,
    derive,
)
from tallymill.operators.lookup import lookup_joins

_PRODUCT_MEASURES = ("base_cost", "rating", "review_count")
_CUSTOMER_MEASURES = ("account_age_days", "credit_score", "is_prime")
# Narrow columns of an order that the scores read, and the flags.
_NARROW = ("quantity", "is_returned", "is_festive_season", "is_weekend")
_ORDER_MEASURES = ("unit_price", "discount_pct", "tax_rate", "shipping_cost")
# All that the formulas after the joins read.
SCORED_FROM = (*_ORDER_MEASURES, *_NARROW, "base_cost", "product_appeal", "customer_value")


def order_values(orders: DataFrame) -> DataFrame:
    """Revenue, tax and total value of each order, in double whatever the width of the inputs."""
    widened = orders.withColumns({name: F.col(name).cast("double") for name in _ORDER_MEASURES})
    return derive(widened, ORDER_VALUE_FORMULAS)


def order_flags(orders: DataFrame) -> DataFrame:
    """Festive season (October to January) and weekend flags."""
    return derive(orders, ORDER_FLAG_FORMULAS)


def _product_side(products: DataFrame) -> DataFrame:
    return products.select("product_id", *[F.col(c).cast("double") for c in _PRODUCT_MEASURES])


def _customer_side(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", *[F.col(c).cast("double") for c in _CUSTOMER_MEASURES])


def _join_both(
    orders: DataFrame, product_side: DataFrame, customer_side: DataFrame, order_lookups: Sequence[tuple] = (), **join_options
) -> DataFrame:
    # Products first: they bring less than orders and customers, and what the first brings, the second shuffle carries.
    lookups = [(product_side, "product_id"), *order_lookups, (customer_side, "customer_id")]
    return lookup_joins(orders, lookups, ("order_id", "product_id"), **join_options)


def star_join(orders: DataFrame, products: DataFrame, customers: DataFrame, **join_options) -> DataFrame:
    """Orders with the measures of their product and customer; orders without a match stay."""
    return _join_both(orders, _product_side(products), _customer_side(customers), **join_options)


def score_orders(orders: DataFrame, products: DataFrame, customers: DataFrame, **join_options) -> DataFrame:
    """Every order with all derived columns up to ``final_score``.

    ``order_lookups`` are lookups that bring columns which the orders lack, as the customer of an order's lines.

    Of a product and a customer one number each is computed before the joins. Whatever follows from joined columns is computed after
    the last join, so that no shuffle carries it. ``in_parts`` of the joins may leave out columns other than ``SCORED_FROM``.
    """
    product_side = derive(_product_side(products), PRODUCT_FORMULAS[:1])
    customer_side = derive(_customer_side(customers), CUSTOMER_FORMULAS[:1])
    joined = _join_both(order_flags(orders), product_side, customer_side, packs=_NARROW, **join_options)
    scored = derive(order_values(joined), (*PRODUCT_FORMULAS[1:], *CUSTOMER_FORMULAS[1:], *SCORE_FORMULAS))
    return scored.drop("product_pull", "customer_pull")


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0.0))


def _measures() -> dict[str, Column]:
    """Every measure that some summary shows. A sum over no value is 0, a mean or deviation is null."""
    return {
        "value_sum": _sum("total_order_value"),
        "value_max": F.max(F.nanvl("total_order_value", F.lit(None))),
        "value_std": F.stddev_samp("total_order_value"),
        "margin_sum": _sum("gross_margin"),
        "margin_std": F.stddev_samp("gross_margin"),
        "score_avg": F.avg("final_score"),
        "score_std": F.stddev_samp("final_score"),
        "returned_avg": F.avg(F.col("is_returned").cast("double")),
        "risk_avg": F.avg("seller_risk"),
        "discount_avg": F.avg("discount_pct"),
        "orders": F.count("order_id"),
    }


@dataclass(frozen=True)
class Summary:
    """One grouping of the scored orders: keys, columns as (name, measure), an optional score to sort by."""

    keys: tuple[str, ...]
    columns: dict[str, str]
    score: tuple[str, str] | None = None

    def order(self) -> list[Column]:
        first = [F.desc_nulls_first(self.score[0])] if self.score else []
        return [*first, *[F.asc(key) for key in self.keys]]

    def finish(self, grouped: DataFrame, names_are_measures: bool = False) -> DataFrame:
        if names_are_measures:
            renamed = [F.col(measure).alias(name) for name, measure in self.columns.items()]
            grouped = grouped.select(*self.keys, *renamed)
        if self.score:
            name, formula = self.score
            grouped = grouped.withColumn(name, F.expr(formula))
        return grouped

    def of(self, scored: DataFrame) -> DataFrame:
        measures = _measures()
        return self.finish(
            scored.groupBy(*self.keys).agg(*[measures[m].alias(name) for name, m in self.columns.items()])
        )


CATEGORY_REGION = Summary(
    keys=("category", "region"),
    columns={
        "total_revenue": "value_sum",
        "total_margin": "margin_sum",
        "avg_score": "score_avg",
        "std_score": "score_std",
        "return_rate": "returned_avg",
        "order_count": "orders",
        "avg_seller_risk": "risk_avg",
        "avg_discount": "discount_avg",
        "max_order_value": "value_max",
    },
)
SELLER = Summary(
    keys=("seller_id",),
    columns={
        "total_margin": "margin_sum",
        "total_gmv": "value_sum",
        "avg_score": "score_avg",
        "return_rate": "returned_avg",
        "order_count": "orders",
        "avg_risk": "risk_avg",
        "margin_volatility": "margin_std",
    },
    score=("seller_rank_score", "avg_score * 0.5D - return_rate * 0.3D - avg_risk * 0.2D"),
)
CUSTOMER = Summary(
    keys=("customer_id",),
    columns={
        "lifetime_value": "value_sum",
        "avg_score": "score_avg",
        "lifetime_margin": "margin_sum",
        "return_rate": "returned_avg",
        "order_count": "orders",
        "order_value_std": "value_std",
    },
    score=("ltv_score", "log1p(lifetime_value) * 0.5D + avg_score * 0.3D - return_rate * 0.2D"),
)
SUMMARIES = {"category_region": CATEGORY_REGION, "seller": SELLER, "customer": CUSTOMER}


def category_region_summary(scored: DataFrame) -> DataFrame:
    return CATEGORY_REGION.of(scored).orderBy(*CATEGORY_REGION.order())


def seller_performance(scored: DataFrame) -> DataFrame:
    return SELLER.of(scored).orderBy(*SELLER.order())


def customer_cohort(scored: DataFrame) -> DataFrame:
    return CUSTOMER.of(scored).orderBy(*CUSTOMER.order())


def top_of(summary: Summary, table: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows in the summary's order, with their rank."""
    head = table.orderBy(*summary.order()).limit(n)
    # A window without partitions, over n rows.
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*summary.order())))


# Two summaries that one finer grouping serves: its cells hold what both are merged from.
_FINE = "category_region_seller"
_FINE_OF = {"category_region": CATEGORY_REGION, "seller": SELLER}
_FINE_KEYS = ("category", "region", "seller_id")
_AVERAGED = {
    "score": "final_score",
    "returned": "is_returned",
    "risk": "seller_risk",
    "discount": "discount_pct",
}
_DEVIATING = {"margin": "gross_margin", "score": "final_score"}


def _parts() -> dict[str, Column]:
    """Parts of the measures that can be added up: numbers, sums, and squared deviations from the cell's own mean."""
    parts = {
        "value_sum": F.sum("total_order_value"),
        "value_max": F.max(F.nanvl("total_order_value", F.lit(None))),
        "orders": F.count("order_id"),
    }
    for name, column in {**_AVERAGED, **_DEVIATING}.items():
        value = F.col(column).cast("double")
        parts |= {f"{name}_n": F.count(value), f"{name}_sum": F.sum(value)}
    for name, column in _DEVIATING.items():
        parts[f"{name}_m2"] = F.var_pop(column) * F.count(column)
    return parts


def _merged(cells: DataFrame, summary: Summary) -> DataFrame:
    """The summary's measures from cells of the finer grouping.

    The squared deviations within the cells are added to those of the cells' means from the mean of the group, which is found
    first, so values far from zero lose nothing.
    """
    zero = F.lit(0.0)
    means = cells.groupBy(*[F.col(k).alias(f"_{k}") for k in summary.keys]).agg(
        *[F.try_divide(F.sum(f"{n}_sum"), F.sum(f"{n}_n")).alias(f"{n}_mean") for n in _DEVIATING]
    )
    cells = cells.join(means, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in summary.keys])
    measures = {
        "value_sum": F.coalesce(F.sum("value_sum"), zero),
        "value_max": F.max("value_max"),
        "margin_sum": F.coalesce(F.sum("margin_sum"), zero),
        "orders": F.sum("orders"),
    }
    for name in _AVERAGED:
        measures[f"{name}_avg"] = F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n"))
    for name in _DEVIATING:
        n = F.col(f"{name}_n")
        apart = F.try_divide(F.col(f"{name}_sum"), n) - F.col(f"{name}_mean")
        squares = F.sum(f"{name}_m2") + F.sum(n * apart * apart)
        measures[f"{name}_std"] = F.when(F.sum(n) > 1, F.sqrt(squares / (F.sum(n) - 1)))
    wanted = [m for m in _measures() if m in summary.columns.values()]
    return cells.groupBy(*summary.keys).agg(*[measures[m].alias(m) for m in wanted])


def summary_cells(scored: DataFrame, names: Sequence[str] = tuple(SUMMARIES)) -> DataFrame:
    """What the named summaries are made of, in one pass over the scored orders, as one table with a ``summary`` column.

    Scoring costs far more than grouping, so scoring once and feeding each row to several groupings beats as many scans
    and does not store the scored orders. By category and region, and by seller, are merged from one grouping by all three,
    so a scored row is fed to two groupings, not to three.
    """
    groupings = {name: (SUMMARIES[name].keys, _measures(), set(SUMMARIES[name].columns.values())) for name in names}
    if set(_FINE_OF) <= set(names):
        groupings = {n: g for n, g in groupings.items() if n not in _FINE_OF} | {_FINE: (_FINE_KEYS, _parts(), set(_parts()))}
    keys = [key for own, _, _ in groupings.values() for key in own]
    wanted = {name: column for _, columns, own in groupings.values() for name, column in columns.items() if name in own | {"orders"}}
    grouped = scored.groupingSets([list(own) for own, _, _ in groupings.values()], *keys).agg(
        F.grouping_id().alias("grouping"), *[column.alias(name) for name, column in wanted.items()]
    )
    label = F.lit(None).cast("string")
    for name, (own, _, _) in groupings.items():
        bits = "".join("0" if key in own else "1" for key in keys)
        label = F.when(F.col("grouping") == int(bits, 2), F.lit(name)).otherwise(label)
    return grouped.withColumn("summary", label).drop("grouping")


def summary_from_cells(cells: DataFrame, name: str) -> DataFrame:
    summary = SUMMARIES[name]
    if name in _FINE_OF and f"{next(iter(_DEVIATING))}_m2" in cells.columns:
        measures = _merged(cells.where(F.col("summary") == _FINE), summary)
    else:
        measures = cells.where(F.col("summary") == name)
    return summary.finish(measures, names_are_measures=True).orderBy(*summary.order())
