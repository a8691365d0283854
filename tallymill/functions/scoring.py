"""The order scoring formulas, as Spark SQL expressions over double columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The formulas. Each group may use the columns of the groups before it.
ORDER_VALUE_FORMULAS = (
    {
        "net_revenue": "unit_price * quantity * (1D - discount_pct)",
        "tax_amount": "unit_price * quantity * (1D - discount_pct) * tax_rate",
    },
    {"total_order_value": "net_revenue + tax_amount + shipping_cost"},
)
ORDER_FLAG_FORMULAS = (
    {
        "is_festive_season": "cast(if(month >= 10 or month = 1, 1, 0) as tinyint)",
        "is_weekend": "cast(if(day_of_week >= 5, 1, 0) as tinyint)",
    },
)
# These read one product or customer only, so they are computed once per product or customer and then joined.
# ``customer_pull`` and ``product_pull`` are factors that the later formulas share.
PRODUCT_FORMULAS = (
    {"product_appeal": "rating * ln(review_count + 1D)"},
    {"log_appeal": "ln(abs(product_appeal) + 1D)", "product_pull": "log1p(abs(product_appeal))"},
)
CUSTOMER_FORMULAS = (
    {"customer_value": "credit_score / 900D * log1p(account_age_days) * (is_prime + 1D)"},
    {"log_cust": "ln(abs(customer_value) + 1D)", "customer_pull": "log1p(abs(customer_value))"},
)
SCORE_FORMULAS = (
    {
        "gross_margin": "net_revenue - base_cost * quantity",
        "seller_risk": "discount_pct * 0.6D + is_returned * 0.4D",
    },
    {
        "log_rev": "ln(abs(total_order_value) + 1D)",
        "log_margin": "ln(abs(gross_margin) + 1D)",
        "log_risk": "ln(abs(seller_risk) + 1D)",
        "log_ship": "ln(abs(shipping_cost) + 1D)",
    },
    {
        "c_rev_margin": "log_rev * log_margin",
        "c_cust_appeal": "log_cust * log_appeal",
        "c_risk_ship": "log_risk * log_ship",
        "diff2": "log_rev * log_rev - log_margin * log_margin",
        "sum2": "log_cust * log_cust + log_appeal * log_appeal",
        "triple": "log_rev * log_cust * log_risk",
    },
    {
        "s1": "sin(c_rev_margin * 1.3D)",
        "s2": "cos(c_cust_appeal * 0.7D)",
        "s3": "tanh(c_risk_ship / 5D)",
        "s4": "sqrt(abs(diff2) + 1D)",
        "s5": "ln(abs(sum2) + 1D)",
        "s6": "sin(triple * 2.1D)",
    },
    {"L1": "s1 + s2 + s3 + s4 + s5 + s6"},
    {
        "t2_a": "ln(abs(L1) + 1D)",
        "t2_b": "sin(L1 * 2.3D)",
        "t2_c": "cos(L1 * 1.7D)",
        "t2_d": "tanh(L1 / 4.1D)",
        "t2_e": "L1 * L1 * log_risk",
        "t2_f": "L1 * log_rev - log_margin",
    },
    {"L2": "t2_a + t2_b + t2_c + t2_d + log1p(abs(t2_e)) + log1p(abs(t2_f))"},
    {
        "t3_a": "sin(L2 * 3.1D)",
        "t3_b": "cos(L2 / 2.7D)",
        "t3_c": "sqrt(abs(L2) + 1D)",
        "t3_d": "tanh(L2 * L1)",
        "t3_e": "ln(abs(L2 - L1) + 1D)",
    },
    {"L3": "t3_a + t3_b + t3_c + t3_d + t3_e"},
    {
        "composite_score": "L3 * 0.35D + L2 * 0.25D + L1 * 0.15D + customer_pull * 0.15D"
        " + gross_margin / (abs(total_order_value) + 1D) * 0.10D",
    },
    {
        "score_x_cust": "composite_score * customer_pull",
        "score_x_appeal": "composite_score * product_pull",
        "score_per_risk": "composite_score / (abs(seller_risk) + 0.01D)",
    },
    {
        "lsc": "ln(abs(score_x_cust) + 1D)",
        "ssa": "sin(score_x_appeal * 1.5D)",
        "spr": "tanh(score_per_risk / 3D)",
    },
    {"final_score": "lsc + ssa + spr + composite_score"},
)


def derive(df: DataFrame, formulas) -> DataFrame:
    """Add the columns group by group.

    One projection per group lets Catalyst keep an intermediate result that several later formulas use, instead of
    repeating its expression in each of them.
    """
    for group in formulas:
        df = df.selectExpr("*", *[f"{text} AS {name}" for name, text in group.items()])
    return df
