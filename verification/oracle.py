"""DuckDB SQL for every registered query that SQL can express, written apart from the Spark code.

Every text reads the whole sample tables.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------- orders

_PLACED = """
placed AS (
  SELECT l.l_orderkey AS order_id, o.o_custkey AS customer_id, CASE WHEN l.l_partkey % 10 = 0 THEN -l.l_partkey ELSE l.l_partkey END AS product_id, l.l_suppkey AS seller_id,
         l.l_returnflag AS category, r.r_name AS region, CAST(l.l_quantity AS INTEGER) AS quantity,
         l.l_extendedprice / l.l_quantity AS unit_price, CAST(l.l_discount AS DOUBLE) AS discount_pct,
         CAST(l.l_tax AS DOUBLE) AS tax_rate, l.l_linenumber * 7.5e0 AS shipping_cost,
         CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS is_returned,
         CAST(month(l.l_shipdate) AS TINYINT) AS month, CAST(isodow(l.l_shipdate) - 1 AS TINYINT) AS day_of_week
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

_SIDES = """
products AS (
  SELECT p_partkey AS product_id, p_retailprice * 0.6e0 AS base_cost, 1e0 + (p_size % 5) AS rating,
         CAST(p_size * 100 AS DOUBLE) AS review_count
  FROM part
),
customers AS (
  SELECT c_custkey AS customer_id, CAST(c_custkey % 3650 + 1 AS DOUBLE) AS account_age_days,
         300e0 + abs(c_acctbal) / 20e0 AS credit_score,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 1e0 ELSE 0e0 END AS is_prime
  FROM customer
)"""

_VALUED = """
priced AS (
  SELECT *, unit_price * quantity * (1e0 - discount_pct) AS net_revenue,
         unit_price * quantity * (1e0 - discount_pct) * tax_rate AS tax_amount,
         CAST(CASE WHEN month IN (10, 11, 12, 1) THEN 1 ELSE 0 END AS TINYINT) AS is_festive_season,
         CAST(CASE WHEN day_of_week IN (5, 6) THEN 1 ELSE 0 END AS TINYINT) AS is_weekend
  FROM placed
),
valued AS (SELECT *, net_revenue + tax_amount + shipping_cost AS total_order_value FROM priced)"""

_SCORED = """
wide AS (
  SELECT v.*, p.base_cost, p.rating, p.review_count, c.account_age_days, c.credit_score, c.is_prime
  FROM valued v LEFT JOIN products p USING (product_id) LEFT JOIN customers c USING (customer_id)
),
z1 AS (
  SELECT *, net_revenue - base_cost * quantity AS gross_margin,
         discount_pct * 0.6e0 + is_returned * 0.4e0 AS seller_risk,
         credit_score / 900e0 * ln(1e0 + account_age_days) * (is_prime + 1e0) AS customer_value,
         rating * ln(review_count + 1e0) AS product_appeal
  FROM wide
),
z2 AS (
  SELECT *, ln(abs(total_order_value) + 1e0) AS log_rev, ln(abs(gross_margin) + 1e0) AS log_margin,
         ln(abs(customer_value) + 1e0) AS log_cust, ln(abs(product_appeal) + 1e0) AS log_appeal,
         ln(abs(seller_risk) + 1e0) AS log_risk, ln(abs(shipping_cost) + 1e0) AS log_ship
  FROM z1
),
z3 AS (
  SELECT *, log_rev * log_margin AS c_rev_margin, log_cust * log_appeal AS c_cust_appeal,
         log_risk * log_ship AS c_risk_ship, pow(log_rev, 2) - pow(log_margin, 2) AS diff2,
         pow(log_cust, 2) + pow(log_appeal, 2) AS sum2, log_rev * log_cust * log_risk AS triple
  FROM z2
),
z4 AS (
  SELECT *, sin(c_rev_margin * 1.3e0) AS s1, cos(c_cust_appeal * 0.7e0) AS s2, tanh(c_risk_ship / 5e0) AS s3,
         sqrt(abs(diff2) + 1e0) AS s4, ln(abs(sum2) + 1e0) AS s5, sin(triple * 2.1e0) AS s6
  FROM z3
),
z5 AS (SELECT *, s1 + s2 + s3 + s4 + s5 + s6 AS L1 FROM z4),
z6 AS (
  SELECT *, ln(abs(L1) + 1e0) AS t2_a, sin(L1 * 2.3e0) AS t2_b, cos(L1 * 1.7e0) AS t2_c, tanh(L1 / 4.1e0) AS t2_d,
         pow(L1, 2) * log_risk AS t2_e, L1 * log_rev - log_margin AS t2_f
  FROM z5
),
z7 AS (SELECT *, t2_a + t2_b + t2_c + t2_d + ln(1e0 + abs(t2_e)) + ln(1e0 + abs(t2_f)) AS L2 FROM z6),
z8 AS (
  SELECT *, sin(L2 * 3.1e0) AS t3_a, cos(L2 / 2.7e0) AS t3_b, sqrt(abs(L2) + 1e0) AS t3_c, tanh(L2 * L1) AS t3_d,
         ln(abs(L2 - L1) + 1e0) AS t3_e
  FROM z7
),
z9 AS (SELECT *, t3_a + t3_b + t3_c + t3_d + t3_e AS L3 FROM z8),
z10 AS (
  SELECT *, L3 * 0.35e0 + L2 * 0.25e0 + L1 * 0.15e0 + ln(1e0 + abs(customer_value)) * 0.15e0
            + gross_margin / (abs(total_order_value) + 1e0) * 0.10e0 AS composite_score
  FROM z9
),
z11 AS (
  SELECT *, composite_score * ln(1e0 + abs(customer_value)) AS score_x_cust,
         composite_score * ln(1e0 + abs(product_appeal)) AS score_x_appeal,
         composite_score / (abs(seller_risk) + 0.01e0) AS score_per_risk
  FROM z10
),
z12 AS (
  SELECT *, ln(abs(score_x_cust) + 1e0) AS lsc, sin(score_x_appeal * 1.5e0) AS ssa, tanh(score_per_risk / 3e0) AS spr
  FROM z11
),
scored AS (SELECT *, lsc + ssa + spr + composite_score AS final_score FROM z12)"""

_ALL_SCORED = f"WITH {_PLACED}, {_SIDES}, {_VALUED}, {_SCORED}"

_DERIVED = """net_revenue tax_amount total_order_value gross_margin seller_risk customer_value product_appeal
log_rev log_margin log_cust log_appeal log_risk log_ship c_rev_margin c_cust_appeal c_risk_ship diff2 sum2 triple
s1 s2 s3 s4 s5 s6 L1 t2_a t2_b t2_c t2_d t2_e t2_f L2 t3_a t3_b t3_c t3_d t3_e L3 composite_score score_x_cust
score_x_appeal score_per_risk lsc ssa spr final_score""".split()

_CATEGORY_REGION = """
category_region AS (
  SELECT category, region, round_even(coalesce(sum(total_order_value), 0e0), 2) AS total_revenue,
         round_even(coalesce(sum(gross_margin), 0e0), 2) AS total_margin, round_even(avg(final_score), 6) AS avg_score,
         round_even(stddev_samp(final_score), 6) AS std_score, round_even(avg(CAST(is_returned AS DOUBLE)), 6) AS return_rate,
         count(order_id) AS order_count, round_even(avg(seller_risk), 6) AS avg_seller_risk,
         round_even(avg(discount_pct), 6) AS avg_discount, round_even(max(total_order_value), 2) AS max_order_value
  FROM scored GROUP BY category, region
)"""

_SELLER = """
seller_sums AS (
  SELECT seller_id, coalesce(sum(gross_margin), 0e0) AS total_margin,
         coalesce(sum(total_order_value), 0e0) AS total_gmv, avg(final_score) AS avg_score,
         avg(CAST(is_returned AS DOUBLE)) AS return_rate, count(order_id) AS order_count, avg(seller_risk) AS avg_risk,
         stddev_samp(gross_margin) AS margin_volatility
  FROM scored GROUP BY seller_id
),
sellers AS (
  SELECT seller_id, round_even(total_margin, 2) AS total_margin, round_even(total_gmv, 2) AS total_gmv,
         round_even(avg_score, 6) AS avg_score, round_even(return_rate, 6) AS return_rate, order_count,
         round_even(avg_risk, 6) AS avg_risk, round_even(margin_volatility, 6) AS margin_volatility,
         round_even(avg_score * 0.5e0 - return_rate * 0.3e0 - avg_risk * 0.2e0, 6) AS seller_rank_score
  FROM seller_sums
)"""

_CUSTOMER = """
customer_sums AS (
  SELECT customer_id, coalesce(sum(total_order_value), 0e0) AS lifetime_value, avg(final_score) AS avg_score,
         coalesce(sum(gross_margin), 0e0) AS lifetime_margin, avg(CAST(is_returned AS DOUBLE)) AS return_rate,
         count(order_id) AS order_count, stddev_samp(total_order_value) AS order_value_std
  FROM scored GROUP BY customer_id
),
cohorts AS (
  SELECT customer_id, round_even(lifetime_value, 2) AS lifetime_value, round_even(avg_score, 6) AS avg_score,
         round_even(lifetime_margin, 2) AS lifetime_margin, round_even(return_rate, 6) AS return_rate, order_count,
         round_even(order_value_std, 6) AS order_value_std,
         round_even(ln(1e0 + lifetime_value) * 0.5e0 + avg_score * 0.3e0 - return_rate * 0.2e0, 6) AS ltv_score
  FROM customer_sums
)"""


def _top(ctes: str, table: str, order: str, n: int) -> str:
    return f"""{_ALL_SCORED}, {ctes}
SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM {table} ORDER BY {order} LIMIT {n}"""


_STAR_JOIN = f"""WITH {_PLACED}, {_SIDES}
SELECT o.order_id, o.customer_id, o.product_id, o.seller_id, o.category, o.region, o.quantity,
       round_even(p.base_cost, 6) AS base_cost, round_even(p.rating, 6) AS rating, round_even(p.review_count, 6) AS review_count,
       round_even(c.account_age_days, 6) AS account_age_days, round_even(c.credit_score, 6) AS credit_score,
       round_even(c.is_prime, 6) AS is_prime
FROM placed o LEFT JOIN products p USING (product_id) LEFT JOIN customers c USING (customer_id)"""

_ORDER_SQL = {
    "order_flags": f"""WITH {_PLACED}, {_VALUED}
SELECT order_id, product_id, month, day_of_week, is_festive_season, is_weekend FROM valued""",
    "order_values": f"""WITH {_PLACED}, {_VALUED}
SELECT order_id, customer_id, product_id, seller_id, round_even(net_revenue, 6) AS net_revenue,
       round_even(tax_amount, 6) AS tax_amount, round_even(total_order_value, 6) AS total_order_value FROM valued""",
    "star_join": _STAR_JOIN,
    "star_join_shuffled": _STAR_JOIN,
    "commerce_scored": f"""{_ALL_SCORED}
SELECT order_id, customer_id, product_id, seller_id, is_festive_season, is_weekend,
       {", ".join(f"round_even({name}, 6) AS {name}" for name in _DERIVED)} FROM scored""",
    "category_region_summary": f"{_ALL_SCORED}, {_CATEGORY_REGION} SELECT * FROM category_region",
    "seller_performance": f"{_ALL_SCORED}, {_SELLER} SELECT * FROM sellers",
    "customer_cohort": f"{_ALL_SCORED}, {_CUSTOMER} SELECT * FROM cohorts",
    "top_category_region": _top(_CATEGORY_REGION, "category_region", "category, region", 10),
    "top_sellers": _top(_SELLER, "sellers", "seller_rank_score DESC NULLS FIRST, seller_id", 5),
    "top_customers": _top(_CUSTOMER, "cohorts", "ltv_score DESC NULLS FIRST, customer_id", 5),
}
_ORDER_SQL["category_region_summary_shuffled"] = _ORDER_SQL["category_region_summary"]
_ORDER_SQL["report_category_region"] = _ORDER_SQL["category_region_summary"]
_ORDER_SQL["report_seller"] = _ORDER_SQL["seller_performance"]
_ORDER_SQL["report_customer"] = _ORDER_SQL["customer_cohort"]

# ---------------------------------------------------------------------------------------------- logs


def _lines(bad_number_every: int | None = None) -> str:
    latency = "CAST(CAST(floor(value * 20) AS INTEGER) AS VARCHAR)"
    if bad_number_every:
        latency = f"CASE WHEN event_id % {bad_number_every} = 0 THEN repeat('9', 25) ELSE {latency} END"
    return f"""
lines AS (
  SELECT CASE WHEN event_id % 50 = 0 THEN 'garbage ' || event_id ELSE
         strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' ||
         CASE event_type WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' WHEN 'signup' THEN 'TRACE'
                         WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' END ||
         '  [svc-' || (event_id % 7) || '] [traceId=ab' || event_id || '] userId=' || user_id ||
         ' ip=10.0.' || (user_id % 256) || '.' || (event_id % 256) ||
         ' method=' || ['GET', 'POST', 'PUT', 'PATCH', 'DELETE'][event_id % 5 + 1] ||
         ' path=' || CASE WHEN event_id % 3 = 0 THEN '/health' ELSE '/api/r' || (user_id % 11) END ||
         ' status=' || [200, 404, 503, 301][event_id % 4 + 1] ||
         ' latencyMs=' || {latency} || ' msg="m"' ||
         CASE WHEN event_type = 'error'
              THEN ' exception="E' || (user_id % 4) || '" stack="S.java:' || event_id || '"' ELSE '' END
         END AS value
  FROM events
)"""


def _field_pattern(captured: str) -> str:
    # DuckDB's regexp_extract takes group 0 to 9 only, so each field gets a pattern that captures nothing else.
    parts = [
        ("timestamp", r"\S+", "%s"),
        ("level", "INFO|WARN|ERROR|DEBUG|TRACE", "%s"),
        ("service", r"[a-zA-Z0-9\-]+", r"\[%s\]"),
        ("trace_id", "[a-fA-F0-9]+", r"\[traceId=%s\]"),
        ("user_id", r"\d+", "userId=%s"),
        ("ip", r"(?:\d{1,3}\.){3}\d{1,3}", "ip=%s"),
        ("method", "GET|POST|PUT|PATCH|DELETE", "method=%s"),
        ("path", r"\S+", "path=%s"),
        ("status", r"\d{3}", "status=%s"),
        ("latency", r"\d+", "latencyMs=%s"),
        ("message", '[^"]*', 'msg="%s"'),
    ]
    texts = [around % (f"({text})" if name == captured else f"(?:{text})") for name, text, around in parts]
    return "^" + r"\s+".join(texts) + ".*$"


def _extract(name: str) -> str:
    return f"regexp_extract(value, '{_field_pattern(name)}', 1)"


_EXCEPTION = r"""ERROR.*exception="([^"]+)".*stack="[^"]+\""""
_SLOW = r"method=({0}GET|POST|PUT|PATCH|DELETE)\s+path=({1}/api/\S+)\s+status=\d{{3}}\s+latencyMs=[1-9]\d{{3,}}"
_SLOW_METHOD, _SLOW_PATH = _SLOW.format("", "?:"), _SLOW.format("?:", "")


def _parsed(bad_number_every: int | None = None) -> str:
    return f"""{_lines(bad_number_every)},
matching AS (SELECT value FROM lines WHERE regexp_matches(value, '{_field_pattern("")}')),
fields AS (
  SELECT value, {_extract("level")} AS level, {_extract("service")} AS service, {_extract("method")} AS method,
         {_extract("path")} AS path, CAST({_extract("status")} AS INTEGER) AS status,
         TRY_CAST({_extract("latency")} AS BIGINT) AS latency_ms
  FROM matching
),
parsed AS (
  SELECT *, CASE WHEN level = 'ERROR' THEN nullif(regexp_extract(value, '{_EXCEPTION}', 1), '') END AS exception,
         CASE WHEN regexp_matches(value, '{_SLOW_METHOD}') THEN
           regexp_extract(value, '{_SLOW_METHOD}', 1) || ' ' || regexp_extract(value, '{_SLOW_PATH}', 1)
         END AS slow_endpoint
  FROM fields WHERE latency_ms IS NOT NULL
)"""


_LIMITS = (
    ("level", "level", 20),
    ("service", "service", 20),
    ("method", "method", 20),
    ("status", "CAST(status AS VARCHAR)", 30),
    ("path", "path", 10),
    ("exception", "exception", 10),
    ("slow_endpoint", "slow_endpoint", 10),
)


def _facet(dimension: str) -> str:
    _, key, limit = next(item for item in _LIMITS if item[0] == dimension)
    return f"""
SELECT key, line_count, rank FROM (
  SELECT key, line_count, CAST(row_number() OVER (ORDER BY line_count DESC, key) AS INTEGER) AS rank
  FROM (SELECT {key} AS key, count(*) AS line_count FROM parsed WHERE {key} IS NOT NULL GROUP BY 1)
) WHERE rank <= {limit}"""


def _totals(bad_number_every: int | None = None) -> str:
    return f"""WITH {_parsed(bad_number_every)},
a AS (SELECT count(*) AS total_lines FROM lines),
m AS (SELECT count(*) AS form_lines FROM matching),
p AS (
  SELECT count(*) AS matched_lines, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS total_latency,
         coalesce(max(latency_ms), 0) AS max_latency,
         count(*) FILTER (WHERE latency_ms >= 1000) AS slow_requests,
         count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_errors,
         count(*) FILTER (WHERE status >= 500) AS server_errors,
         count(*) FILTER (WHERE level = 'ERROR') AS error_lines, count(*) FILTER (WHERE level = 'WARN') AS warn_lines
  FROM parsed
)
SELECT total_lines, matched_lines, total_lines - form_lines AS unmatched_lines,
       form_lines - matched_lines AS bad_number_lines, total_latency, max_latency,
       round_even(total_latency / CAST(total_lines AS DOUBLE), 6) AS avg_latency,
       round_even(total_latency / CAST(matched_lines AS DOUBLE), 6) AS avg_latency_matched,
       slow_requests, client_errors, server_errors, error_lines, warn_lines
FROM a, m, p"""


_FACETS = f"WITH {_parsed()} " + " UNION ALL ".join(
    f"SELECT '{dimension}' AS dimension, * FROM ({_facet(dimension)})" for dimension, _, _ in _LIMITS
)
_BAD_EVERY = 37

_LOG_SQL = {
    "log_lines": f"WITH {_lines()} SELECT value FROM lines",
    "log_parsed": f"""WITH {_parsed()}
SELECT {", ".join(f"{_extract(n)} AS {n}" for n in ("timestamp", "level", "service", "trace_id", "user_id", "ip"))},
       method, path, status, latency_ms, {_extract("message")} AS message FROM fields""",
    "log_unmatched": f"""WITH {_lines()}
SELECT value FROM lines WHERE NOT regexp_matches(value, '{_field_pattern("")}')""",
    "log_quarantine": f"WITH {_parsed(_BAD_EVERY)} SELECT value FROM fields WHERE latency_ms IS NULL",
    "log_totals": _totals(),
    "log_totals_with_bad_numbers": _totals(_BAD_EVERY),
    "log_status_class": f"""WITH {_parsed()}
SELECT CASE WHEN status >= 500 THEN 'server' WHEN status >= 400 THEN 'client' ELSE 'other' END AS status_class,
       count(*) AS line_count FROM parsed GROUP BY 1""",
    "log_reconcile": f"""WITH {_parsed(_BAD_EVERY)}
SELECT (SELECT count(*) FROM lines) AS submitted_lines, (SELECT count(*) FROM parsed) AS matched_lines,
       (SELECT count(*) FROM lines) - (SELECT count(*) FROM matching) AS unmatched_lines,
       (SELECT count(*) FROM matching) - (SELECT count(*) FROM parsed) AS bad_number_lines, true AS reconciled""",
    "log_facets": _FACETS,
    "log_top_levels": f"WITH {_parsed()} {_facet('level')}",
    "log_top_services": f"WITH {_parsed()} {_facet('service')}",
    "log_top_methods": f"WITH {_parsed()} {_facet('method')}",
    "log_top_statuses": f"WITH {_parsed()} {_facet('status')}",
    "log_top_paths": f"WITH {_parsed()} {_facet('path')}",
    "log_top_exceptions": f"WITH {_parsed()} {_facet('exception')}",
    "log_slow_endpoints": f"WITH {_parsed()} {_facet('slow_endpoint')}",
    "log_text_roundtrip": f"WITH {_lines()} SELECT value FROM lines",
    "log_gzip_totals": _totals(),
    "report_log_totals": f"SELECT total_lines AS submitted_lines, * FROM ({_totals()})",
    "report_log_facets": _FACETS,
    "report_log_files": f"""WITH {_lines()}
SELECT CAST(4 AS BIGINT) AS file_count, (SELECT CAST(sum(strlen(value) + 1) AS BIGINT) FROM lines) AS total_bytes,
       total_lines AS submitted_lines, * FROM ({_totals()})""",
}

# ---------------------------------------------------------------------------------------------- clustering


def _descent(steps: int, seed: int = 42, shift: str = "0e0") -> str:
    """Centres c0..c{steps} and assignments a0..a{steps-1} of that many k-means steps, 10 clusters."""
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, [CAST(e AS DOUBLE) + {shift} FOR e IN embedding] AS x FROM embeddings)",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY md5('{seed}:' || vec_id), vec_id) - 1 AS INTEGER) AS cluster, vec_id, x
  FROM v ORDER BY md5('{seed}:' || vec_id), vec_id LIMIT 10)""",
    ]
    for i in range(steps):
        ctes.append(
            f"""a{i} AS MATERIALIZED (
  SELECT vec_id, cluster, distance, x FROM (
    SELECT v.vec_id, c.cluster, v.x,
           list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.x, c.x)]) AS distance
    FROM v, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""
        )
        ctes.append(
            f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY dim) AS x FROM (
    SELECT cluster, dim, avg(value) AS m FROM (
      SELECT cluster, unnest(x) AS value, generate_subscripts(x, 1) AS dim FROM a{i})
    GROUP BY cluster, dim)
  GROUP BY cluster)"""
        )
    return "WITH " + ",\n".join(ctes)


def _centers(steps: int) -> str:
    return f"""{_descent(steps)}
SELECT cluster, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS dim, round_even(unnest(x), 6) AS value FROM c{steps}"""


def _objectives(steps: int) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i + 1} AS iteration, round_even(sum(distance), 6) AS objective FROM a{i}" for i in range(steps)
    )
    return f"{_descent(steps)} {rows}"


_CLUSTER_SQL = {
    "kmeans_assign": f"{_descent(1)} SELECT vec_id, cluster, round_even(distance, 6) AS distance FROM a0",
    "kmeans_update": _centers(1),
    "kmeans_objective": _objectives(5),
    "kmeans_fit": _centers(20),
    "kmeans_assign_shifted": f"""{_descent(1, shift="1e8")}
SELECT vec_id, cluster, round_even(distance, 4) AS distance FROM a0""",
    "kmeans_redo": "SELECT min(inertia) AS inertia, 5 AS iterations FROM ("
    + " UNION ALL ".join(f"({_descent(5, seed)} SELECT round_even(sum(distance), 6) AS inertia FROM a4)" for seed in (42, 43, 44))
    + ")",
    "kmeans_start": f"{_descent(1)} SELECT vec_id, cluster FROM c0",
}

ORACLE_SQL: dict[str, str] = {**_ORDER_SQL, **_LOG_SQL, **_CLUSTER_SQL}
