"""Views over tables of a few rows."""

from marquee.plans import views as W


def small_tables(spark, root):
    tables = {
        "region": ([(0, "ASIA"), (1, None)], "r_regionkey int, r_name string"),
        "nation": ([(0, "A", 0), (1, None, 1), (2, "C", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(1, 0), (2, 1), (3, 2), (3, 0), (4, 9)], "s_suppkey long, s_nationkey int"),
        "lineitem": ([(10, 1), (10, 1), (10, 3), (11, 2), (12, 4), (None, 3), (13, None)], "l_partkey long, l_suppkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_places_with_nulls_and_repeated_keys(spark, tmp_path):
    got = {r["tid"]: (r["country"], r["language"]) for r in W._places(spark, small_tables(spark, tmp_path)).collect()}
    assert got == {10: (["A", "C"], ["ASIA"]), 11: ([], []), None: (["A", "C"], ["ASIA"])}


def test_sets_of_names_are_not_shuffled(spark, sf_dir):
    plan = W._places(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("partial_collect_set")[0]


def test_means_and_bounds_do_not_read_the_lines_again(spark, sf_dir):
    plan = W.processed(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" not in plan
