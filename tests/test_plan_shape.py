"""Physical plans: nothing that gathers or multiplies whole tables, pruned scans."""

import re

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(spark, df):
    """Pushed filters and read columns of each scan."""
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = re.findall(r"PushedFilters: \[(.*)\]", text)
    read = [set(re.findall(r"(\w+):", c)) for c in re.findall(r"ReadSchema: struct<(.*)>", text)]
    return pushed, read


def test_sorts_are_left_to_the_caller(spark):
    for name in ("order_samples", "altered_fraction", "min_cn_with_ties"):
        assert "rangepartitioning" not in plan(QUERIES[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    pushed, read = scans(spark, QUERIES["alteration_events"](spark, SF))
    assert len(pushed) == len(read) == 2 and all("l_linestatus" in p for p in pushed)
    assert any("GreaterThanOrEqual(l_quantity,47.0)" in p for p in pushed)
    assert not any(columns & {"l_extendedprice", "l_shipdate"} for columns in read)
    _, read = scans(spark, QUERIES["recurrence_in_samples"](spark, SF))
    assert read == [{"l_suppkey", "l_partkey", "l_linenumber", "l_returnflag"}]


def test_events_need_one_shuffle_and_the_grid_moves_sparse_cells_only(spark):
    text = plan(QUERIES["alteration_events"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    grid = plan(QUERIES["dense_matrix"](spark, SF)).split("Generate explode")[0]
    assert "Exchange" not in grid


def test_genes_of_a_file_need_one_scan_and_one_shuffle(spark):
    for name in ("gene_cn_segments", "gene_cn_intervals"):
        text = plan(QUERIES[name](spark, SF))
        assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan") == 1


def test_two_callers_are_merged_by_one_join(spark):
    text = plan(QUERIES["merge_two_callers"](spark, SF))
    assert text.count("FileScan") == 2 and text.count("FullOuter") == 1 and text.count("Exchange hashpartitioning") <= 4


def test_silent_classes_are_filtered_before_the_distinct(spark):
    text = plan(QUERIES["dedupe_maf"](spark, SF))
    assert text.index("HashAggregate") < text.index("Filter") < text.index("FileScan")
