"""Small tables with known expectations."""

import datetime as dt

import pytest

from tallyframe.operators import cleaning as K, joins as J, outliers as O, profiling as P, quality as Q, roles as R

SALES = "sale_date date, sales_id string, product string, region string, amount int, customers int"


def day(n):
    return dt.date(2026, 4, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def missing(spark):
    rows = [(day(i), f"S{i:03}", "A" if i % 2 else "B", "East" if i < 4 else "West", 100 + 10 * i, 3) for i in range(10)]
    rows[1] = (None, *rows[1][1:])
    rows[9] = (*rows[9][:3], None, *rows[9][4:])
    rows[2] = (*rows[2][:4], None, rows[2][5])
    rows[7] = (*rows[7][:4], None, rows[7][5])
    return spark.createDataFrame(rows, SALES)


def test_missing(spark, missing):
    got = {r["column"]: r["missing_count"] for r in Q.missing_summary(missing).collect()}
    assert sum(got.values()) == 4 and got["amount"] == 2 and got["sale_date"] == 1
    assert K.drop_missing_rows(missing).count() == 6
    known = [r["amount"] for r in missing.collect() if r["amount"] is not None]
    filled = [r["amount"] for r in K.fill_mean(missing, "amount").collect()]
    assert filled.count(pytest.approx(sum(known) / len(known))) >= 2 and None not in filled
    assert K.fill_mode(missing, "region").filter("region IS NULL").count() == 0
    assert K.fill_mode(missing, "region").filter("region = 'West'").count() == 6
    with pytest.raises(ValueError):
        K.fill_mean(missing, "region")
    assert missing.filter("amount IS NULL").count() == 2  # the input is unchanged


def test_duplicates(spark):
    rows = [(i, "x") for i in range(6)] + [(0, "x"), (1, "x"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "a int, b string")
    r = Q.duplicate_summary(df).first()
    assert (r["extra_rows"], r["group_rows"]) == (3, 6)
    assert K.drop_duplicates(df).count() == 7
    assert Q.duplicate_preview(df, ["a", "b"]).count() == 6
    with_id = df.selectExpr("*", "row_number() OVER (ORDER BY a, b) AS _row_id")
    kept = sorted(r["_row_id"] for r in K.drop_duplicates(with_id).collect())
    assert kept == [1, 3, 5, 7, 8, 9, 10]


def test_outliers(spark):
    amounts = [100, 102, 105, 107, 108, 110, 112, 114, 115, 118, 120, 121, 500, 600]
    df = spark.createDataFrame([(i, a, 5) for i, a in enumerate(amounts)], "sales_id int, amount int, customers int")
    b = O.bounds_of(df, ["amount"])["amount"]
    import numpy as np

    q1, q3 = np.quantile(amounts, [0.25, 0.75])
    assert (b.q1, b.q3, b.low, b.high) == (q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    assert sorted(r["sales_id"] for r in O.iqr_outliers(df, "amount").collect()) == [12, 13]
    assert O.iqr_outliers(df, "customers").count() == 0
    assert O.winsorize(df, "amount").agg({"amount": "max"}).first()[0] == b.high
    assert R.measure_columns(df, R.identifier_names(R.identifier_strict(df))) == ["amount", "customers"]


def test_identifiers(spark):
    rows = [(day(i), f"S{i}", f"O{i}", 100 + i, 50 + i, "A") for i in range(10)]
    df = spark.createDataFrame(rows, "sale_date date, sales_id string, `订单号` string, amount int, unit_price int, product string")
    assert set(R.identifier_names(R.identifier_strict(df))) == {"sales_id", "订单号"}
    assert set(R.identifier_names(R.identifier_wide(df))) == {"sales_id", "订单号"}
    assert set(R.identifier_names(R.identifier_wide(df, ["product"], ["sales_id"]))) == {"订单号", "product"}


def test_joins(spark):
    customers = spark.createDataFrame([(f"C{i:03}", f"n{i}", "East") for i in range(1, 7)], "customer_id string, customer_name string, region string")
    orders = spark.createDataFrame([(f"O{i}", f"C{i % 5 + 1:03}", f"P{i % 4 + 1}", 10 * i) for i in range(10)],
                                   "order_id string, customer_id string, product_id string, amount int")
    products = spark.createDataFrame([(f"P{i}", f"p{i}", "c", i) for i in range(1, 6)], "product_id string, product_name string, category string, unit_price int")
    both = J.inner_join(J.inner_join(orders, customers, "customer_id", "customer_id"), products, "product_id", "product_id")
    assert both.count() == 10
    assert J.left_join(customers, orders, "customer_id", "customer_id").count() == 11
    assert J.left_join(products, orders, "product_id", "product_id").count() == 11


def test_null_keys(spark):
    left = spark.createDataFrame([(1,), (None,)], "k int")
    right = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, v string")
    assert J.left_join(left, right, "k", "k").count() == 2
    assert J.left_join(left, right, "k", "k", null_keys_match=True).count() == 3
    third = spark.range(900).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS k", "id AS v")
    assert J.left_join(third, third, "k", "k").count() == 900  # linear in the left side, whatever the NULLs
    other = spark.createDataFrame([(1, 2)], "k int, x int")
    assert J.left_join(other, other, "k", "x", "my table").columns == ["k", "x", "k__my_table", "x__my_table"]


def test_profile_kinds(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True, [1]), (2, float("nan"), None, None, [1])],
                               "i int, d double, s string, b boolean, l array<int>")
    got = {r["column"]: r for r in P.field_profile(df).collect()}
    assert got["d"]["missing_count"] == 1 and got["l"]["distinct_count"] == 1 and got["b"]["missing_pct"] == 50.0
    assert P.exportable_cells(df).dtypes[-1] == ("l", "string")
