"""Steps over wide rows: what isn't asked for isn't done, and what is generated for them is compiled."""

from pyspark.sql import functions as F

from tickloom.functions import tables
from tickloom.functions.series import dealt, finite
from tickloom.operators import neighbours, orderflow
from tickloom.plans import daily, queries
from tickloom.sources import lob


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_without_vpin_have_no_join_and_one_shuffle(spark, sf):
    s, needed = daily.Settings(frequency=10, regular_hours=False), ["log_mid", *queries._PATH]
    plan = _plan(daily.featured_bars(lob.book_view(spark, sf), s, needed=needed).select("instrument_id", "trade_date", "sample_idx", *needed))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Join" in _plan(daily.featured_bars(lob.book_view(spark, sf), s, needed=["vpin"]).select("vpin"))


def test_written_tables_are_made_by_compiled_methods(spark):
    name, seen = tables._COMPILED[0], []
    own = spark.conf.get(name)

    class Watched:
        sparkSession, schema = spark, spark.range(1).schema

        @property
        def write(self):
            seen.append(spark.conf.get(name))
            return spark.range(1).write

    assert tables.written(Watched(), "watched").count() == 1
    assert seen == ["8000"] and spark.conf.get(name) == own


def test_flows_of_several_numbers_of_levels_are_those_of_each(spark, sf):
    book = lob.book_view(spark, sf).where("trade_date < '2024-01-03'")
    together = orderflow.flows_normalised(book, (1, 3, 10), 10, "exponential")
    keys = ["instrument_id", "trade_date", "sequence"]
    for levels in (1, 3, 10):
        names = [f"ofi_L{levels}", f"ofi_L{levels}_norm", f"ofi_L{levels}_norm_n"]
        each = orderflow.flow_levels_normalised(book, levels, 10, "exponential").select(*keys, *names)
        assert each.count() > 0 and each.exceptAll(together.select(*keys, *names)).isEmpty()
    assert not [c for c in together.columns if c.startswith("_")]


def test_finite_drops_nan_and_both_infinities(spark):
    values = [1.5, -0.0, None, float("nan"), float("inf"), float("-inf"), 1.7e308]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(finite(F.col("v")).alias("x")).collect()]
    assert got == [1.5, 0.0, None, None, None, None, 1.7e308]


def test_dealt_rows_stay_in_their_tasks_and_series_stay_whole(spark, sf):
    book = dealt(lob.book_view(spark, sf).select("instrument_id", "trade_date", "sequence"))
    placed = book.withColumn("task", F.spark_partition_id()).groupBy("instrument_id", "trade_date").agg(F.count_distinct("task").alias("n"), F.max("task").alias("task")).collect()
    assert {r.n for r in placed} == {1} and len({r.task for r in placed}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_neighbours_read_points_and_not_events_again(spark, sf):
    plan = _plan(queries.mi_neighbours(spark, sf))
    assert "events.parquet" not in plan and "/points-" in plan and "/distances-" in plan


def test_neighbours_of_crowded_cells_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 4)
    points = [(1, i * i % 61, i * 37 % 53, 1 + i % 2) for i in range(120)]
    points = sorted({(k, u, v): (k, u, v, n) for k, u, v, n in points}.values())
    got = {(r.u, r.v): r.d for r in neighbours.kth_distance(spark.createDataFrame(points, "k int, u long, v long, n long"), ["k"], 3).collect()}
    for _, u, v, n in points:
        near = sorted(d for _, a, b, m in points for d in [max(abs(a - u), abs(b - v))] * (m - ((a, b) == (u, v))))
        assert got[u, v] == near[2]
    assert len(got) == len(points)


def test_neighbours_broadcast_no_points(spark):
    # small as a file, so both would be chosen for a broadcast, which the driver holds whole
    points = tables.written(spark.range(500).selectExpr("1 as k", "id as u", "id * 37 % 101 as v", "1L as n"), "points")
    asked = neighbours.kth_distance(points, ["k"], 3)
    for df, joins in ((asked, 1), (neighbours._within(points, tables.written(asked, "distances"), ["k"]), 1)):
        plan = _plan(df)
        assert plan.count("SortMergeJoin") == joins
        sides = plan.split("BroadcastExchange")[1:]  # only the crowded cells' counts
        assert all("tiles" in s.split("HashAggregate")[0] and "HashAggregate" in s for s in sides)
