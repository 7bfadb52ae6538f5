from datetime import datetime

from commitlens.queries import derived


def test_orders_meet_customers_before_lines(spark, tmp_path):
    day = datetime(1996, 1, 2)
    tables = {
        "customer": ([(1, 3, "ann"), (2, None, "bob")], "c_custkey bigint, c_nationkey int, c_name string"),
        "orders": ([(1, 1, day), (2, 2, day), (3, None, day)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"),
        "lineitem": (
            [(o, 5, 6, 1, 7.0, 9.5, 0.05, 0.01, day) for o in (1, 1, 2, 3, None)],
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
            "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        changes = derived.file_changes(spark, str(tmp_path))
        plan = changes._jdf.queryExecution().toString()
        got = sorted((r.repo or "", r.author, r.change_type) for r in changes.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    physical = plan[plan.index("== Physical Plan =="):]
    # The join at the top is that of the lines: they are not shuffled again by customer.
    assert physical[physical.index("SortMergeJoin"):].startswith("SortMergeJoin [l_orderkey")
    assert got == [("", "bob", "MODIFY"), ("repo_3", "ann", "MODIFY"), ("repo_3", "ann", "MODIFY")]
