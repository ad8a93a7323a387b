"""The plans that matter at scale: equi-joins instead of nested loops, filters in the scan, one exchange where one is enough."""

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_no_nested_loop_or_cartesian(spark):
    for name in ("near_duplicates", "theta_pairs", "interval_overlap", "rolling_windows", "merge_dispositions", "coverage_freshness"):
        text = plan(spark, name)
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_project")
    assert "PushedFilters: [" in text and "In(event_type" in text
    assert "props" not in text.split("ReadSchema:")[1].split("\n")[0]
    text = plan(spark, "parameterized_filter")
    assert "GreaterThanOrEqual(ts" in text


def test_rank_filter_becomes_a_group_limit(spark):
    assert "WindowGroupLimit" in plan(spark, "priority_select_row")


def test_dense_selection_sorts_no_group(spark):
    text = plan(spark, "priority_select_dense")
    assert "Window" not in text and "SemiJoin" in text.replace(" ", "").replace("LeftSemi", "SemiJoin")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_uses_one_exchange_for_all_lengths(spark):
    calendar_plan, rolled = (physical(catalog.QUERIES[n](spark, SF)) for n in ("calendar_fill", "rolling_windows"))
    assert rolled.count("Exchange hashpartitioning") == calendar_plan.count("Exchange hashpartitioning")
    assert "RangeFrame" not in rolled and "NestedLoop" not in rolled


def test_the_daily_views_read_every_ledger_once(spark):
    """Of the six ledgers the views read five, nights twice by filters that share no row; no view repeats the plan of another."""
    daily = physical(catalog.QUERIES["daily_health"](spark, SF))
    scans = daily.count("FileScan parquet")
    assert scans == 6 and daily.count("lineitem.parquet") == 2
    for name in ("health_calendar", "weekly_health", "rolling_health", "rolling_health_latest", "analysis_daily_lagged", "relationship_report"):
        text = physical(catalog.QUERIES[name](spark, SF))
        assert text.count("FileScan parquet") == scans, name
        assert text.count("Exchange") <= daily.count("Exchange") + 3, name


def test_no_python_in_any_plan(spark):
    for name in catalog.QUERIES:
        text = plan(spark, name)
        assert "Python" not in text and "InArrow" not in text and "InPandas" not in text, name


def test_links_bring_names_to_their_form_before_the_join(spark):
    """A regular expression in the test of a pair runs for all rows that meet, which are the square of those in a cell."""
    for name in ("links_of_observations", "links_of_blood_pressure", "links_of_sleep", "links_of_workouts"):
        joins = [line for line in physical(catalog.QUERIES[name](spark, SF)).split("\n") if "Join" in line and "a_id" in line]
        assert joins and not any("regexp" in line for line in joins), name


def test_theta_pairs_look_forward_only(spark):
    """A row lists the quarter cells that it reaches forward, so each couple meets once."""
    text = plan(spark, "theta_pairs")
    assert "sequence(" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_couples_travel_once_a_slice(spark):
    """Both sides of a join of couples are dealt by its keys and nothing travels again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("links_of_sleep", "theta_pairs"):
            text = physical(catalog.QUERIES[name](spark, SF))
            assert text.count("REPARTITION_BY_NUM") == 2 and not any(f"hashpartitioning({x}_" in text for x in "ab"), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
