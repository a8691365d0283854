import math
import re

import pytest
from pyspark.sql import functions as F

from tallymill.operators import commerce, lookup
from tallymill.operators.lookup import hot_keys, lookup_joins, measured_bytes, packed, salt_counts, within_budget
from tallymill.plans.reports import commerce_report
from tallymill.sources import sample_tables, tables

from conftest import plan_of

ORDER = dict(
    order_id=1, customer_id=1, product_id=1, seller_id=1, category="a", region="r", payment_type="upi", quantity=2,
    unit_price=100.0, discount_pct=0.1, tax_rate=0.05, shipping_cost=10.0, is_returned=0, day_of_week=0,
    hour_of_day=0, month=2,
)


def doubles(schema):
    return schema.replace("float", "double")


def shop(spark, *orders):
    rows = [{**ORDER, "order_id": i, **order} for i, order in enumerate(orders)]
    order_table = spark.createDataFrame(rows, doubles(tables.TABLE_SCHEMAS["orders"]))
    products = spark.createDataFrame([(1, 30.0, 4.0, 99, 1.0, 0)], doubles(tables.TABLE_SCHEMAS["products"]))
    customers = spark.createDataFrame(
        [(1, 30, 1000.0, 450.0, 1.0, 5), (2, 30, 0.0, 900.0, 0.0, 5)], doubles(tables.TABLE_SCHEMAS["customers"])
    )
    return order_table, products, customers


def score(spark, *orders, **options):
    return commerce.score_orders(*shop(spark, *orders), **options)


def model_score(o, p, c):
    """The formulas once more, for one order, in plain Python."""
    lg = lambda x: math.log(abs(x) + 1)
    net = o["unit_price"] * o["quantity"] * (1 - o["discount_pct"])
    total = net + net * o["tax_rate"] + o["shipping_cost"]
    margin = net - p["base_cost"] * o["quantity"]
    risk = o["discount_pct"] * 0.6 + o["is_returned"] * 0.4
    value = c["credit_score"] / 900 * math.log1p(c["account_age_days"]) * (c["is_prime"] + 1)
    appeal = p["rating"] * math.log(p["review_count"] + 1)
    rev, mar, cus, app, ris, shi = map(lg, (total, margin, value, appeal, risk, o["shipping_cost"]))
    first = (
        math.sin(rev * mar * 1.3) + math.cos(cus * app * 0.7) + math.tanh(ris * shi / 5)
        + math.sqrt(abs(rev**2 - mar**2) + 1) + lg(cus**2 + app**2) + math.sin(rev * cus * ris * 2.1)
    )
    second = (
        lg(first) + math.sin(first * 2.3) + math.cos(first * 1.7) + math.tanh(first / 4.1)
        + lg(first**2 * ris) + lg(first * rev - mar)
    )
    third = (
        math.sin(second * 3.1) + math.cos(second / 2.7) + math.sqrt(abs(second) + 1) + math.tanh(second * first)
        + lg(second - first)
    )
    mixed = third * 0.35 + second * 0.25 + first * 0.15 + lg(value) * 0.15 + margin / (abs(total) + 1) * 0.1
    return lg(mixed * lg(value)) + math.sin(mixed * lg(appeal) * 1.5) + math.tanh(mixed / (risk + 0.01) / 3) + mixed


def test_order_values(spark):
    row = commerce.order_values(shop(spark, {})[0]).first()
    assert (row["net_revenue"], row["tax_amount"], row["total_order_value"]) == pytest.approx((180, 9, 199))


def test_order_flags(spark):
    months = {9: 0, 10: 1, 12: 1, 1: 1, 2: 0}
    days = {4: 0, 5: 1, 6: 1}
    flagged = commerce.order_flags(shop(spark, *[{"month": m} for m in months], *[{"day_of_week": d} for d in days])[0])
    rows = flagged.orderBy("order_id").collect()
    assert [r["is_festive_season"] for r in rows[: len(months)]] == list(months.values())
    assert [r["is_weekend"] for r in rows[len(months) :]] == list(days.values())
    assert dict(flagged.dtypes)["is_weekend"] == "tinyint"


def test_final_score_against_a_model(spark):
    orders = [{}, {"is_returned": 1, "shipping_cost": 0.0}, {"customer_id": 2, "unit_price": 12000.0, "quantity": 19}]
    scored = score(spark, *orders).orderBy("order_id").collect()
    product = dict(base_cost=30.0, rating=4.0, review_count=99)
    people = {
        1: dict(account_age_days=1000.0, credit_score=450.0, is_prime=1.0),
        2: dict(account_age_days=0.0, credit_score=900.0, is_prime=0.0),
    }
    for order, row in zip(orders, scored):
        full = {**ORDER, **order}
        assert row["final_score"] == pytest.approx(model_score(full, product, people[full["customer_id"]]), rel=1e-11)


def test_missing_product_and_customer(spark):
    missing = score(spark, {"product_id": 7}, {"customer_id": 7}, {"product_id": None}).orderBy("order_id").collect()
    assert [r["total_order_value"] for r in missing] == pytest.approx([199] * 3)
    assert [r["gross_margin"] is None for r in missing] == [True, False, True]
    assert all(r["final_score"] is None for r in missing)


def test_summaries(spark):
    orders = [{"seller_id": 1}, {"seller_id": 1, "is_returned": 1}, {"seller_id": 2}, {"seller_id": 3, "product_id": 7}]
    scored = score(spark, *orders)
    sellers = commerce.seller_performance(scored).collect()
    # Without a score first, then by score; sums over nothing are 0, a deviation of one row is null.
    assert sellers[0]["seller_id"] == 3 and sellers[0]["seller_rank_score"] is None
    assert sellers[0]["total_margin"] == 0.0 and sellers[0]["total_gmv"] == pytest.approx(199)
    by_id = {r["seller_id"]: r for r in sellers}
    assert by_id[2]["margin_volatility"] is None and by_id[1]["return_rate"] == 0.5
    expected = by_id[1]["avg_score"] * 0.5 - 0.5 * 0.3 - by_id[1]["avg_risk"] * 0.2
    assert by_id[1]["seller_rank_score"] == pytest.approx(expected)
    scores = [r["seller_rank_score"] for r in sellers[1:]]
    assert scores == sorted(scores, reverse=True)
    customer = commerce.customer_cohort(scored).first()
    assert customer["order_count"] == 4 and customer["lifetime_value"] == pytest.approx(4 * 199)
    top = commerce.top_of(commerce.SELLER, commerce.SELLER.of(scored), 2).orderBy("rank").collect()
    assert [r["seller_id"] for r in top] == [r["seller_id"] for r in sellers[:2]]


def test_max_ignores_nan(spark):
    nan = {"unit_price": float("nan")}
    assert commerce.category_region_summary(score(spark, {}, nan)).first()["max_order_value"] == pytest.approx(199)


def test_report_equals_separate_summaries(spark, small):
    args = [f(spark, small) for f in (sample_tables.sample_orders, sample_tables.sample_products, sample_tables.sample_customers)]
    report = commerce_report(*args)
    scored = commerce.score_orders(*args).cache()
    separate = {
        "category_region": commerce.category_region_summary(scored),
        "seller": commerce.seller_performance(scored),
        "customer": commerce.customer_cohort(scored),
    }
    counts = set()
    for name, table in separate.items():
        own = getattr(report, name)
        assert own.columns == table.columns
        keys = commerce.SUMMARIES[name].keys
        for a, b in zip(own.orderBy(*keys).collect(), table.orderBy(*keys).collect(), strict=True):
            assert tuple(a[k] for k in keys) == tuple(b[k] for k in keys)
            measures = [c for c in own.columns if c not in keys]
            assert [a[c] for c in measures] == [None if b[c] is None else pytest.approx(b[c]) for c in measures]
        counts.add(own.agg(F.sum("order_count")).first()[0])
    assert counts == {scored.count()} == {args[0].count()}
    assert report.top("seller", 3).count() == 3
    scored.unpersist()


def test_merged_deviations_far_from_zero_and_of_few_values(spark):
    rows = [("a", "r", i % 5, 1e8 + 0.1 * i, 1e8 - i, None, i, True, 0.5, 0.1) for i in range(40)]
    rows += [("b", "r", 7, 5.0, 5.0, 1.0, 99, False, None, 0.1), ("b", None, 7, None, None, None, 100, False, None, None)]
    schema = (
        "category string, region string, seller_id long, gross_margin double, final_score double, total_order_value double,"
        " order_id long, is_returned boolean, seller_risk double, discount_pct double, customer_id long"
    )
    scored = spark.createDataFrame([(*r, 1) for r in rows], schema)
    cells = commerce.summary_cells(scored).cache()
    for name, direct in (("category_region", commerce.category_region_summary), ("seller", commerce.seller_performance)):
        keys = commerce.SUMMARIES[name].keys
        merged, wanted = (sorted(map(tuple, d.select(*keys, *sorted(set(d.columns) - set(keys))).collect()), key=repr) for d in (commerce.summary_from_cells(cells, name), direct(scored)))
        assert len(merged) == len(wanted)
        for a, b in zip(merged, wanted):
            assert list(a) == [x if x is None or isinstance(x, str) else pytest.approx(x, rel=1e-7) for x in b]
    plan = plan_of(commerce.summary_cells(scored))
    assert plan.count("Expand") and cells.select("summary").distinct().count() == 2
    cells.unpersist()


def test_partitioning_does_not_matter(spark, small):
    orders = sample_tables.sample_orders(spark, small)
    rest = sample_tables.sample_products(spark, small), sample_tables.sample_customers(spark, small)
    one, many = [
        commerce.category_region_summary(commerce.score_orders(orders.repartition(n), *rest)).collect() for n in (1, 7)
    ]
    assert len(one) == len(many)
    for a, b in zip(one, many):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


def test_plan_reads_only_what_it_needs(spark, tmp_path):
    for name, table in zip(tables.TABLE_SCHEMAS, shop(spark, {}, {})):
        tables.write_table(table, str(tmp_path / f"{name}.parquet"))
    plan = plan_of(commerce.seller_performance(commerce.score_orders(*tables.read_order_tables(spark, str(tmp_path)))))
    assert "payment_type" not in plan and "hour_of_day" not in plan and "weight_kg" not in plan
    assert "lifetime_orders" not in plan and "is_weekend" not in plan
    assert plan.count("BroadcastHashJoin LeftOuter") >= 2 and "SortMergeJoin" not in plan
    assert "Python" not in plan
    args = tables.read_order_tables(spark, str(tmp_path))
    shuffled = plan_of(commerce.seller_performance(commerce.score_orders(*args, broadcast_bytes=0)))
    assert "payment_type" not in shuffled and "hour_of_day" not in shuffled


# ------------------------------------------------------------------------------------------ lookups


def test_salted_join_gives_the_same_rows(spark):
    # One key holds a third of the rows, one row in ten has no key, some keys have no lookup row.
    fact = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 200).alias("key"),
        F.lit("same").alias("note"),
    )
    lookup = spark.range(150).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    for how in ("left", "inner"):
        salted = lookup_joins(fact, [(lookup, "key")], ["id"], how=how, broadcast_bytes=0)
        wanted = fact.join(lookup, "key", how).select("id", "key", "note", "value")
        assert sorted(salted.select("id", "key", "note", "value").collect(), key=str) == sorted(wanted.collect(), key=str)
        assert salted.columns == ["key", "id", "note", "value"]
    with pytest.raises(ValueError):
        lookup_joins(fact, [(lookup, "key")], ["id"], how="full", broadcast_bytes=0)


def test_hot_keys_spread(spark):
    fact = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    texts = fact.select("key", F.concat(F.lit("k"), "key").alias("text"))
    assert hot_keys(texts, ["key", "text"], 50) == {"key": {7: 34}, "text": {"k7": 34}}
    assert hot_keys(fact.where("id < 0"), ["key"], 50) == {"key": {}}
    lookup = spark.range(4000).select(F.col("id").alias("key"), F.lit(1).alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_joins(fact, [(lookup, "key")], ["id"], broadcast_bytes=0)
        assert "SortMergeJoin" in plan_of(joined)
        per_task = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert per_task < 1000  # 1,333 rows share one key


def test_salts_follow_the_counts():
    found = salt_counts({"half": 500_000, "a": 500, "b": 600, "c": 400}, 1_000_000, 2000)
    assert found == {"half": 2000, "a": 2, "b": 3, "c": 2}
    assert salt_counts({"c": 240}, 1_000_000, 2000) == {}


def test_lookups_share_one_broadcast_budget():
    assert within_budget([50, 10, 45, float("inf")], 60) == [False, True, True, False]


def test_hot_keys_are_counted_without_a_join(spark, small, monkeypatch):
    from tallymill.operators import lookup
    from tallymill.plans import catalog

    counted, sketch = [], lookup.hot_keys_of

    def seen(tables, partitions):
        counted.extend(plan_of(table) for table, _ in tables)
        return sketch(tables, partitions)

    monkeypatch.setattr(lookup, "hot_keys_of", seen)
    context = spark.sparkContext
    context.setJobGroup("built", "")
    summary = catalog.category_region_summary_shuffled(spark, small)
    jobs = len(context.statusTracker().getJobIdsForGroup("built"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert counted and not any("Join" in plan for plan in counted)
    assert len(counted) <= 6 and jobs <= 6 and summary.count() > 0


def test_measured_bytes(spark):
    numbers = spark.range(100)
    texts = numbers.select(F.lit("é" * 50).alias("t"), F.lit(None).cast("string").alias("n"))
    arrays = numbers.select(F.array("id").alias("a"))
    small, wide, unknown = measured_bytes([numbers, texts, arrays])
    assert small == 100 * 56 and wide == 100 * (16 + 48 + 100) and unknown == float("inf")


def test_lookups_of_lookups_give_the_same_rows(spark):
    # Keys that repeat, are null or find nothing on every level.
    fact = spark.range(400).select("id", F.when(F.col("id") % 9 != 0, F.col("id") % 40).alias("a"), (F.col("id") % 7).alias("b"))
    first = spark.range(50).select((F.col("id") % 35).alias("a"), F.when(F.col("id") % 6 != 0, F.col("id") % 11).alias("c"))
    second = spark.range(12).select((F.col("id") % 8).alias("c"), (F.col("id") % 5).alias("d"), F.col("id").alias("v"))
    third = spark.range(4).select(F.col("id").alias("d"), (F.col("id") * 3).alias("w"))
    same_key = spark.range(9).select(F.col("id").alias("c"), (F.col("id") * 5).alias("x"))
    other = spark.range(6).select(F.col("id").alias("b"), (F.col("id") + 100).alias("y"))
    keys, tables = ("a", "c", "d", "c", "b"), (first, second, third, same_key, other)
    for hows in (["inner"] * 5, ["left"] * 5, ["inner", "left", "left", "inner", "left"], ["left", "inner", "left", "left", "inner"]):
        wanted = fact
        for table, key, how in zip(tables, keys, hows):
            wanted = wanted.join(table, key, how)
        steps = list(zip(tables, keys, hows))
        # None, all, and some of them broadcast.
        for sizes in ([9.0] * 5, [1.0] * 5, [9.0, 1.0, 9.0, 9.0, 1.0], [9.0, 9.0, 1.0, 1.0, 9.0], [0.5, 9.0, 1.0, 9.0, 9.0]):
            found = lookup_joins(fact, steps, ["id"], broadcast_bytes=5, sizes=sizes)
            assert found.columns == wanted.columns
            assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)


def test_packed_columns_come_back(spark):
    rows = [(1, 2**31 - 1, 127, 32767, 5), (2, -(2**31), -128, -32768, None), (3, None, None, None, 7), (4, -1, 0, 1, 0), (5, 0, -1, None, 2)]
    table = spark.createDataFrame(rows, "id bigint, q int, t tinyint, s smallint, wide bigint")
    word, restored = packed(table, ["q", "wide", "t", "none", "s"])
    assert word.columns == ["id", "wide", "_word"]
    back = restored(word)
    assert dict(back.dtypes) == dict(table.dtypes)
    assert sorted(map(tuple, back.select(*table.columns).collect())) == rows
    assert packed(table, ["q", "wide"])[0] is table


def shuffles_with(column, table):
    return [c for c in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan_of(table)) if column in c]


def test_lines_are_shuffled_once_for_each_large_lookup_of_theirs(spark, small, monkeypatch):
    from tallymill.plans import catalog
    from verification.compare import oracle_connection, same_rows
    from verification.oracle import ORACLE_SQL

    written, settle_parts = [], catalog.settle_parts
    monkeypatch.setattr(lookup, "within_budget", lambda sizes, budget: [False] * len(sizes))
    monkeypatch.setattr(catalog, "settle_parts", lambda parts, *to: written.extend(parts) or settle_parts(parts, *to))
    scored = catalog.QUERIES["commerce_scored"](spark, small)
    assert same_rows(scored, oracle_connection(small), ORACLE_SQL["commerce_scored"]) == ""
    assert len(written) == lookup.PARTS and not shuffles_with("seller_id", scored)
    for part in written:
        lines = shuffles_with("seller_id", part)
        assert len(lines) == 2  # by product and by order; the customers of an order are looked up once per order
        assert not any(name in columns for columns in lines for name in ("total_order_value", "is_weekend", "quantity", "log_appeal"))
    summary = catalog.QUERIES["seller_performance"](spark, small)
    assert len(shuffles_with("unit_price", summary)) == 2
    assert same_rows(summary, oracle_connection(small), ORACLE_SQL["seller_performance"]) == ""


def test_parts_are_all_rows_of_a_join(spark):
    fact = spark.range(500).select("id", F.when(F.col("id") % 9 != 0, F.col("id") % 40).alias("a"), (F.col("id") % 7).alias("b"))
    for kind in ("bigint", "int", "string"):
        first = spark.range(50).select((F.col("id") % 35).cast(kind).alias("a"), (F.col("id") * 2).alias("v"))
        other = spark.range(6).select(F.col("id").alias("b"), (F.col("id") + 100).alias("y"))
        for how in ("left", "inner"):
            steps, seen = [(other, "b", "left"), (first, "a", how)], []
            found = lookup_joins(fact, steps, ["id"], broadcast_bytes=0, in_parts=lambda parts: seen.extend(parts) or parts[0])
            rows = [tuple(row) for part in seen for row in part.collect()]
            wanted = fact.join(other, "b", "left").join(first, "a", how)
            assert len(seen) == lookup.PARTS and found.columns == wanted.columns
            assert sorted(map(str, rows)) == sorted(str(tuple(row)) for row in wanted.collect())
    with_one = lookup_joins(fact, [(other, "b")], ["id"], broadcast_bytes=0, in_parts=lambda parts: 1 / 0)
    assert with_one.count() == 500


# ------------------------------------------------------------------------------------------ tables


def test_few_splits_are_dealt_out_and_many_stay(spark):
    one = spark.range(0, 100, 1, 1)
    assert tables.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert tables.spread(many) is many


def test_parts_are_read_as_one_table_and_leave_no_shuffles(spark, tmp_path):
    shuffled = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), shuffled.size()
    parts = [spark.range(100).where(F.col("id") % 3 == i).repartition(4, "id") for i in range(3)]
    settled = tables.settle_parts(parts, str(tmp_path), "parts")
    assert shuffled.size() <= before and spark.conf.get(name) == setting
    assert sorted(row["id"] for row in settled.table.collect()) == list(range(100))
    settled.delete()
    assert not any(tmp_path.iterdir())


def test_a_run_leaves_no_files(spark, small):
    from pathlib import Path

    from tallymill.plans import catalog
    from tallymill.session import delete_work_files, work_folder

    catalog.QUERIES["report_seller"](spark, small).collect()
    catalog.QUERIES["report_log_files"](spark, small).collect()
    folder = Path(work_folder(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    delete_work_files(spark)
    assert not folder.exists()


def test_tables_are_checked(spark, tmp_path):
    products = shop(spark, {})[1]
    tables.write_table(products, str(tmp_path / "products.parquet"))
    assert tables.read_table(spark, str(tmp_path), "products").count() == 1
    assert next((tmp_path / "products.parquet").glob("*.snappy.parquet"))
    tables.write_table(products.drop("rating"), str(tmp_path / "products.parquet"), mode="overwrite")
    with pytest.raises(ValueError, match="rating"):
        tables.read_table(spark, str(tmp_path), "products")
    tables.write_table(products.withColumn("rating", F.lit("x")), str(tmp_path / "products.parquet"), mode="overwrite")
    with pytest.raises(ValueError, match="rating"):
        tables.read_table(spark, str(tmp_path), "products")


def test_duplicate_keys_are_found(spark):
    products = shop(spark, {})[1]
    assert tables.require_unique(products, "product_id") is products
    with pytest.raises(ValueError, match="product_id 1 occurs 2 times"):
        tables.require_unique(products.union(products), "product_id")
