import pytest
from pyspark.sql import functions as F

from portolan.operators import analytics, star
from portolan.schemas import TABLES
from proxies import standins
from proxies.queries import fact
from tests.helpers import plan


def small_fact(spark, rows):
    """(state, visa, year, month, port, people)"""
    return spark.createDataFrame(
        rows, "state_code string, visa_key int, i94yr int, i94mon int, port_key string, "
              "i94_count int")


@pytest.fixture(scope="module")
def dims(spark):
    make = lambda name, rows: spark.createDataFrame(rows, TABLES[name])
    return {"dim_state": make("dim_state", [("NY", "NEW YORK"), ("TX", "TEXAS"), ("99", "Other")]),
            "dim_visa": make("dim_visa", [(1, "Business"), (2, "Pleasure")]),
            "dim_port": make("dim_port", [("A", "NY", "ALBANY")])}


def test_star_count_keeps_unmatched_keys(spark, dims):
    rows = small_fact(spark, [("NY", 1, 2016, 4, "A", 2), ("NY", 1, 2016, 4, "A", 1),
                              ("XX", 3, 2016, 4, "A", 1), (None, None, 2016, 5, None, 1)])
    got = analytics.entries_by_state_month_visa(rows, dims).select(
        "state_code", "state", "visa_key", "visa_broad_type", "i94mon", "people", "entries")
    assert set(map(tuple, got.collect())) == {
        ("NY", "NEW YORK", 1, "Business", 4, 3, 2), ("XX", None, 3, None, 4, 1, 1),
        (None, None, None, None, 5, 1, 1)}
    inner = star.star_count(rows, dims, ["state"], how="inner")
    assert [r.state_code for r in inner.collect()] == ["NY"]


def test_unknown_member_and_orphans(spark, dims):
    rows = small_fact(spark, [("NY", 1, 2016, 4, "A", 1), ("XX", 1, 2016, 4, "B", 1),
                              (None, 1, 2016, 4, None, 1), ("XX", 1, 2016, 4, None, 1)])
    settled = star.with_unknown_member(rows, dims["dim_state"])
    assert settled.columns == rows.columns
    assert sorted(r.state_code for r in settled.collect()) == ["99", "99", "99", "NY"]
    orphans = star.orphan_keys(rows, dims["dim_state"], "state_code", "state_code")
    assert [tuple(r) for r in orphans.collect()] == [("XX", 2)]


def test_month_gaps_and_year_ends(spark):
    rows = small_fact(spark, [("NY", 1, 2015, 12, "A", 5), ("NY", 1, 2016, 1, "A", 7),
                              ("NY", 1, 2016, 3, "A", 1), ("TX", 1, 2016, 2, "A", 1)])
    got = {(r.state_code, r.i94yr, r.i94mon): (r.people, r.people_before, r.change)
           for r in analytics.month_on_month(rows).collect()}
    assert got == {("NY", 2015, 12): (5, None, None), ("NY", 2016, 1): (7, 5, 2),
                   ("NY", 2016, 3): (1, None, None), ("TX", 2016, 2): (1, None, None)}


def test_top_breaks_ties_by_key(spark, dims):
    rows = small_fact(spark, [(s, v, 2016, 1, p, 1) for s, v, p in [
        ("TX", 1, "B"), ("NY", 1, "A"), ("AK", 2, "B"), ("AK", 2, "C"), (None, 1, None)]])
    assert [r.state_code for r in analytics.top_destinations(rows, dims, 2).orderBy(
        F.desc("people"), "state_code").collect()] == ["AK", "NY"]
    top = analytics.top_ports_per_visa(rows, dims, 1).collect()
    assert {(r.visa_key, r.port_key, r.port_address) for r in top} == {
        (1, "A", "ALBANY"), (2, "B", None)}


def test_per_resident(spark):
    rows = small_fact(spark, [("NY", 1, 2016, 1, "A", 3), ("TX", 1, 2016, 1, "A", 1),
                              ("XX", 1, 2016, 1, "A", 1)])
    cities = spark.createDataFrame(
        [("Albany", "NY", 1000, "White"), ("Albany", "NY", 1000, "Asian"),
         ("Troy", "NY", 500, "White"), ("Austin", "TX", 0, "White")],
        "city string, state_code string, total_population int, race string")
    for column in ("male_population", "female_population", "number_of_veterans", "foreign_born"):
        cities = cities.withColumn(column, F.lit(1))
    got = {r.state_code: (r.total_population, r.per_thousand)
           for r in analytics.entries_per_resident(rows, cities).collect()}
    assert got == {"NY": (1500, 2.0), "TX": (0, None), "XX": (None, None)}


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_counts_meet_the_dimensions_not_the_entries(spark, sf_dir):
    query = analytics.entries_by_state_month_visa(
        fact(spark, sf_dir), standins.dimensions(spark, sf_dir))
    physical = final_plan(query)
    assert physical.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in physical
    joins_end = max(physical.rindex("BroadcastHashJoin"), 0)
    assert "HashAggregate" in physical[joins_end:]      # the aggregates lie under the joins
    assert "HashAggregate" not in physical[:physical.index("BroadcastHashJoin")]


def test_a_big_dimension_is_not_broadcast(spark, sf_dir):
    """Over the threshold the same query sort-merges, with the same result."""
    entries, dims = fact(spark, sf_dir), standins.dimensions(spark, sf_dir)
    run = lambda: star.star_join(entries.select("i94_key", "port_key"), dims, ["port"])
    small = set(map(tuple, run().collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1KB")
    try:
        big = run()
        physical = final_plan(big)
        assert "SortMergeJoin" in physical and "Broadcast" not in physical
        assert set(map(tuple, big.collect())) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_per_group_is_cut_before_the_shuffle(spark, sf_dir):
    query = analytics.top_ports_per_visa(fact(spark, sf_dir), standins.dimensions(spark, sf_dir), 5)
    assert query._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_top_is_not_a_full_sort(spark, sf_dir):
    query = analytics.top_destinations(fact(spark, sf_dir), standins.dimensions(spark, sf_dir), 5)
    physical = plan(query)
    assert "TakeOrderedAndProject" in physical or "GlobalLimit" in physical
    assert "rangepartitioning" not in physical


def test_rollup_copies_counts_not_entries(spark, sf_dir):
    physical = plan(analytics.star_rollup(fact(spark, sf_dir))).split("== Physical Plan ==")[1]
    assert "HashAggregate" in physical[physical.index("Expand"):]


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def test_a_hot_state_is_split_for_the_unknown_member(spark, no_broadcast):
    """Nine tenths of the entries go to one state."""
    entries = spark.range(0, 300000, 1, 16).select(
        F.hash("id").alias("i94_key"),
        F.when(F.col("id") % 10 < 9, "NY").otherwise(F.concat(F.lit("S"), F.col("id") % 500))
        .alias("state_code"))
    states = spark.range(400).select(F.concat(F.lit("S"), "id").alias("state_code")).unionByName(
        spark.createDataFrame([("NY",)], "state_code string"))
    settled = star.with_unknown_member(entries, states).agg(
        F.count_if(F.col("state_code") == "NY"), F.count_if(F.col("state_code") == "99"),
        F.count("*"), F.sum("i94_key"))
    ny, other, total, _ = settled.collect()[0]
    assert ny == 270000 and other == 6000 and total == 300000
    assert "SortMergeJoin(skew=true)" in settled._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_split_when_both_sides_are_big(spark, no_broadcast):
    """Two thirds of the entries hold one port; the sort-merge join splits it."""
    entries = spark.range(0, 300000, 1, 16).select(
        F.hash("id").alias("i94_key"),
        F.when(F.col("id") % 3 < 2, "P7").otherwise(F.concat(F.lit("P"), F.col("id") % 5000))
        .alias("port_key"))
    ports = spark.range(5000).select(
        F.concat(F.lit("P"), "id").alias("port_key"), F.lit("NY").alias("state"),
        F.col("id").cast("string").alias("address"))
    joined = star.star_join(entries, {"dim_port": ports}, ["port"]).agg(
        F.count("*"), F.count("port_address"), F.sum("i94_key"))
    total, matched, _ = joined.collect()[0]
    physical = joined._jdf.queryExecution().executedPlan().toString()
    assert total == matched == 300000
    assert "SortMergeJoin(skew=true)" in physical
