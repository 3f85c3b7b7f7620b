"""What the given tables cannot show: nulls, gaps, ties, zeros, empty input."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import at, plan, rows
from dashloom.functions.custom import custom_measure, register_measure
from dashloom.functions.grain import calendar, seconds, truncate
from dashloom.functions.measures import cents, exact_sum, mean, percent, total
from dashloom.operators import aggregates as A
from dashloom.operators import series as S
from dashloom.operators.behaviour import funnel, retention, sessions
from dashloom.operators.filters import Filter, apply_filters, json_dim
from dashloom.operators.joins import in_segment, not_in_segment, orphans, star, within
from dashloom.operators.ranking import rows_after, top_n_other, top_per_group
from dashloom.operators.sets import members, period_diff, stack
from dashloom.plans.panel import Panel, run_panel
from dashloom.sources.tables import load, table


def measures():
    return {"n": F.count(F.lit(1)), "v": F.sum("v")}


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("a", "x", 1), ("a", None, 2), (None, "x", 4), (None, None, 8)],
        "d string, e string, v long")


def test_filters(spark):
    odd = "it's -- ; drop table \"t\" %"
    df = spark.createDataFrame(
        [(1, odd, at(0)), (2, "its", at(60)), (3, None, at(120))],
        "id long, s string, t timestamp_ntz")

    def ids(*filters):
        return [r.id for r in apply_filters(df, filters).orderBy("id").collect()]

    assert ids() == [1, 2, 3]
    assert ids(Filter("s", "eq", odd)) == [1]
    assert ids(Filter("s", "prefix", "it's --")) == [1]
    assert ids(Filter("s", "prefix", "%")) == []
    assert ids(Filter("s", "in", [odd, "its"])) == [1, 2]
    assert ids(Filter("s", "in", [])) == []
    assert ids(Filter("s", "null")) == [3]
    assert ids(Filter("s", "not_null"), Filter("id", "eq", 2)) == [2]
    assert ids(Filter("t", "between", (at(60), at(120)))) == [2]
    assert ids(Filter("t", "between", (None, at(60)))) == [1]
    assert ids(Filter("t", "between", (dt.date(2024, 1, 1), None))) == [1, 2, 3]
    with pytest.raises(ValueError):
        ids(Filter("s", "like", "x"))


def test_filter_reaches_the_scan(spark, sf):
    orders = apply_filters(table(spark, sf, "orders"), [
        Filter("o_orderdate", "between", (dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1)))])
    p = plan(A.breakdown(orders, ["o_orderstatus"], {"n": F.count(F.lit(1))}))
    assert "GreaterThanOrEqual(o_orderdate,1996" in p and "LessThan(o_orderdate,1997" in p
    assert "ReadSchema: struct<o_orderstatus:string,o_orderdate:timestamp_ntz>" in p


def test_json(spark):
    df = spark.createDataFrame([('{"k": 5}',), ('{"j": 1}',), ("not json",), (None,)], "p string")
    assert rows(json_dim(df, "p", "$.k", "long").select("k")) == [(None,)] * 3 + [(5,)]


def test_null_dimension_and_subtotal_differ(sales):
    got = rows(A.subtotals(sales, ["d", "e"], measures()))
    assert len(got) == 7
    assert (None, None, 0, 1, 8) in got   # null and null
    assert (None, None, 1, 2, 12) in got  # all of null
    assert (None, None, 3, 4, 15) in got  # all
    assert len(rows(A.cross_totals(sales, ["d", "e"], measures()))) == 9
    sets = rows(A.grouping_sets(sales, [["d"], ["e"], []], measures()))
    assert sorted(r[2] for r in sets) == [1, 1, 2, 2, 3]


def test_empty_input(sales):
    none = sales.limit(0)
    assert rows(A.kpi(none, measures())) == [(0, None)]
    for df in (A.breakdown(none, ["d"], measures()), A.facets(none, ["d", "e"]),
               A.percentiles(none, ["d"], "v", [0.5]), A.histogram(none, "v", 2.0),
               top_per_group(none, ["d"], "e", F.sum("v"), 2),
               top_n_other(none, "d", measures(), "v", 2)):
        assert rows(df) == []
    assert rows(A.profile(none, ["v"])) == [("v", 0, 0, 0, None, None)]


def test_matrix_keeps_given_columns(sales):
    got = A.matrix(sales, ["d"], "e", ["x", "never"], F.sum("v"))
    assert got.columns == ["d", "x", "never"]
    assert rows(got) == [(None, 4, None), ("a", 1, None)]


def test_facets_and_profile(sales):
    assert ("d", None, 2) in rows(A.facets(sales, ["d", "e"]))
    assert ("d", 4, 2, 1, "a", "a") in rows(A.profile(sales))
    p = plan(A.facets(sales, ["d", "e"]))
    assert p.count("Exchange") <= 1


def test_star_and_segments(spark):
    fact = spark.createDataFrame([(1, 10), (1, 20), (2, 5), (None, 1), (9, 7)], "k long, v long")
    dim = spark.createDataFrame([(1, "one"), (2, "two"), (2, "zwei")], "id long, name string")
    assert rows(star(fact, (dim, ("k", "id")), how="left")) == [
        (None, 1, None), (1, 10, "one"), (1, 20, "one"), (2, 5, "two"), (2, 5, "zwei"),
        (9, 7, None)]
    assert rows(in_segment(fact, dim, ("k", "id"))) == [(1, 10), (1, 20), (2, 5)]
    assert rows(not_in_segment(fact, dim, ("k", "id"))) == [(None, 1), (9, 7)]
    assert rows(orphans(fact, dim, ("k", "id"))) == [(1, 1)]  # the null key is none
    assert rows(orphans(fact.limit(0), dim, ("k", "id"))) == [(0, 0)]


def test_within_of_part_seconds(spark):
    def t(us):
        return at(0) + dt.timedelta(microseconds=us)
    a = spark.createDataFrame([(i, "u", t(999_900 + 50 * i)) for i in range(5)],
                              "a long, u string, ta timestamp_ntz")
    b = spark.createDataFrame([(i, "u", t(1_000_000 + 60 * i)) for i in range(9)],
                              "b long, u string, tb timestamp_ntz")
    for us in (0, 100, 1_000_000):
        got = within(a, b, "u", "ta", "tb", dt.timedelta(microseconds=us))
        assert rows(got.select("a", "b")) == [
            (i, j) for i in range(5) for j in range(9)
            if 0 <= (1_000_000 + 60 * j) - (999_900 + 50 * i) <= us]


def test_first_last(spark):
    df = spark.createDataFrame(
        [("a", at(1), 1, 5.0), ("a", at(1), 2, 6.0), ("a", at(0), 3, 7.0), ("a", None, 0, 8.0)],
        "d string, t timestamp_ntz, id long, v double")
    for tie in ("id", None):
        got = rows(A.first_last(df, ["d"], "v", "t", tie))
        assert got in ([("a", 7.0, 6.0)], [("a", 7.0, 5.0)][:tie is None])
    assert "SortAggregate" not in plan(A.first_last(df, ["d"], "v", "t"))


def test_within_includes_both_ends(spark):
    a = spark.createDataFrame([(1, "u", at(0)), (2, "u", at(9))], "a long, u string, ta timestamp_ntz")
    b = spark.createDataFrame([(1, "u", at(0)), (2, "u", at(10)), (3, "u", at(20)), (4, "w", at(1))],
                              "b long, u string, tb timestamp_ntz")
    got = within(a, b, "u", "ta", "tb", dt.timedelta(minutes=10))
    assert rows(got.select("a", "b")) == [(1, 1), (1, 2), (2, 2)]


def test_gaps_and_previous(spark):
    months = [dt.datetime(2024, m, 1) for m in (1, 2, 4)]
    df = spark.createDataFrame([(m, 10.0 * i) for i, m in enumerate(months)],
                               "t timestamp_ntz, v double")
    full = S.fill_gaps(df, "month", dt.date(2023, 12, 1), dt.date(2024, 5, 1))
    assert [r[1] for r in rows(full)] == [0, 0, 10, 0, 20, 0]
    before = rows(S.vs_previous(full, "v", 1))
    assert [r[4] for r in before] == [None, None, None, -100.0, None, -100.0]
    assert [r[2] for r in rows(S.running(full, "v"))] == [0, 0, 10, 10, 30, 30]
    assert [r[2] for r in rows(S.moving(full, "v", 2))] == [0, 0, 5, 5, 10, 10]
    by = df.withColumn("d", F.lit("x")).unionByName(df.limit(0).withColumn("d", F.lit("y")))
    assert S.fill_gaps(by, "month", dt.date(2024, 1, 1), dt.date(2024, 4, 1), ["d"]).count() == 4


def test_calendar(spark):
    def days(grain, lo, hi):
        return [r[0] for r in rows(calendar(spark, grain, lo, hi))]
    jan = dt.datetime(2024, 1, 1)
    assert days("minute", jan, at(3)) == [at(0), at(1), at(2), at(3)]
    assert len(days("hour", jan, dt.datetime(2024, 12, 31, 23))) == 366 * 24
    assert days("week", jan, at(0, 16)) == [at(0, 1), at(0, 8), at(0, 15)]
    assert days("month", jan, dt.datetime(2025, 2, 1))[-2:] == [
        dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)]
    assert days("quarter", jan, dt.datetime(2024, 11, 1)) == [
        dt.datetime(2024, m, 1) for m in (1, 4, 7, 10)]
    assert days("year", jan, dt.datetime(2025, 12, 31)) == [jan, dt.datetime(2025, 1, 1)]
    assert days("month", dt.datetime(2024, 1, 15), dt.datetime(2024, 2, 10)) == [
        dt.datetime(2024, 1, 15)]
    assert days("day", at(0, 2), jan) == [] and days("month", dt.datetime(2024, 3, 1), jan) == []


def test_gaps_per_dimension(spark):
    """Values inside, around and outside the range, and a value that is null."""
    day = [dt.datetime(2024, 1, d) for d in range(1, 11)]
    given = [("a", 4), ("a", 6), ("b", 1), ("b", 9), ("c", 2), (None, 5), ("d", 8)]
    df = spark.createDataFrame([(day[i], d, i) for d, i in given],
                               "t timestamp_ntz, d string, v long")
    got = rows(S.fill_gaps(df, "day", day[3].date(), day[7], ["d"], -1))
    want = [(day[i], d, i if (d, i) in given else -1)
            for d in ("a", "b", "c", "d", None) for i in range(3, 8)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_zscore_without_variation(spark):
    df = spark.createDataFrame([(at(i), 5.0) for i in range(5)], "t timestamp_ntz, v double")
    assert [r.zscore for r in S.zscore(df, "v", 3).collect()] == [None] * 5


def test_rolling_boundary(spark):
    df = spark.createDataFrame([(at(0), 1), (at(30), 2), (at(30), 4), (at(61), 8)],
                               "t timestamp_ntz, v long")
    got = S.rolling(df, [], "t", dt.timedelta(minutes=30), {"s": F.col("v")})
    assert rows(got) == [(at(0), 1), (at(30), 7), (at(61), 8)]


def test_grain_does_not_depend_on_the_zone(spark):
    """A clock time that summer time skips in some zones stays what it is."""
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 1, 5),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = df.select(truncate("t", "hour"), truncate("t", "minute"), seconds(df, "t")).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    utc = dt.datetime(2024, 3, 10, 2, 30, 1, 5, dt.timezone.utc)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    assert got[0] == dt.datetime(2024, 3, 10, 2) and got[1] == dt.datetime(2024, 3, 10, 2, 30)
    assert got[2] == (utc - epoch) // dt.timedelta(seconds=1)


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(k, 1) for k in "dcba"] + [("e", 9)], "k string, v long")
    top = top_n_other(df, "k", {"v": F.sum("v")}, "v", 3)
    assert rows(top) == [("Other", True, 2), ("a", False, 1), ("b", False, 1), ("e", False, 9)]
    g = df.withColumn("g", F.length("k"))
    got = top_per_group(g, ["g"], "k", F.sum("v"), 2)
    assert rows(got.select("k", "rank_no")) == [("a", 2), ("e", 1)]
    assert "WindowGroupLimit" in plan(got)


def test_other_is_not_a_value(spark):
    df = spark.createDataFrame([("Other", 5), (None, 4), ("a", 1), ("b", 1)], "k string, v long")
    top = top_n_other(df, "k", {"v": F.sum("v")}, "v", 2)
    assert rows(top) == [(None, False, 4), ("Other", False, 5), ("Other", True, 2)]


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_pages_give_every_row_once(spark, way):
    """Ties and nulls in the first column, pages that end inside them."""
    data = [(i, None if i % 4 == 3 else i % 4) for i in range(20)]
    df = spark.createDataFrame(data, "id long, v long")
    order, cursor, seen = [("v", way), ("id", "asc")], None, []
    while page := rows_after(df, order, cursor, 6).collect():
        seen += [(r.id, r.v) for r in page]
        cursor = page[-1].asDict()
    sign = 1 if way == "asc" else -1
    assert seen == sorted(data, key=lambda t: (t[1] is None, sign * (t[1] or 0), t[0]))


def test_page_filter_reaches_the_scan(spark, sf):
    page = rows_after(table(spark, sf, "orders"), [("o_totalprice", "desc"), ("o_orderkey", "asc")],
                      {"o_totalprice": 1000.0, "o_orderkey": 5}, 10)
    assert "LessThanOrEqual(o_totalprice,1000.0)" in plan(page)


def test_period_diff_and_members(spark):
    a = spark.createDataFrame([(1, 5), (2, 1), (None, 3), (4, None)], "k long, v long")
    b = spark.createDataFrame([(1, 5), (2, 2), (None, 3), (3, 1), (4, None)], "k long, v long")
    assert rows(period_diff(a, b, "k", F.sum("v"))) == [
        (None, 3, 3, "same"), (1, 5, 5, "same"), (2, 1, 2, "changed"), (3, None, 1, "added"),
        (4, None, None, "same")]
    x = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "k long")
    y = spark.createDataFrame([(1,), (None,)], "k long")
    assert rows(members(x, y, "both")) == [(None,), (1,)]
    assert rows(members(x, y, "only_first")) == [(2,)]
    assert rows(members(x, y, "only_first_all")) == [(None,), (1,), (2,)]
    assert rows(members(x, y, "either")) == [(None,), (1,), (2,)]
    assert stack(x, y, x.withColumn("z", F.lit(1))).columns == ["k", "z"]


def test_sessions_as_session_window(spark):
    """A pause of exactly the gap, one microsecond more, and many events at once."""
    times = [at(0), at(30), at(60) + dt.timedelta(microseconds=1), at(70), at(70), at(200)]
    df = spark.createDataFrame([("u", t) for t in times] + [(None, at(5)), ("u", None)],
                               "u string, t timestamp_ntz")
    got = sessions(df, "u", "t", dt.timedelta(minutes=30))
    spans = df.groupBy(F.session_window("t", "30 minutes"), "u").count().select(
        "u", "session_window.start", "session_window.end", "count")
    assert rows(got) == rows(spans)
    assert got.count() == 4


def test_funnel_needs_the_order(spark):
    df = spark.createDataFrame(
        [("p", at(1), "a"), ("p", at(1), "b"), ("p", at(2), "c"), ("q", at(0), "b"),
         ("q", at(1), "a"), ("q", at(2), "b"), ("q", at(3), "c")],
        "u string, t timestamp_ntz, k string")
    assert rows(funnel(df, "u", "t", "k", ["a", "b", "c"])) == [
        (1, "a", 2, 1.0), (2, "b", 1, 0.5), (3, "c", 1, 0.5)]
    assert rows(funnel(df, "u", "t", "k", ["zzz", "a"])) == [(1, "zzz", 0, None), (2, "a", 0, None)]


def test_retention(spark):
    df = spark.createDataFrame(
        [(1, at(0)), (1, at(5)), (1, at(0, 3)), (2, at(0, 2)), (None, at(0)), (2, None)],
        "u long, t timestamp_ntz")
    assert rows(retention(df, "u", "t")) == [
        (dt.date(2024, 1, 1), 0, 1), (dt.date(2024, 1, 1), 2, 1), (dt.date(2024, 1, 2), 0, 1)]


def test_exact_sums(spark):
    """Negative, large and very many amounts; sums beyond a bigint of cents."""
    values = [-0.01, -5.55, 0.1, 0.2, 999_999_999_999.99, -1_048_576.0, 0.07, 1.15]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    want = sum(Decimal(str(v)) for v in values)
    got = df.agg(exact_sum(cents("v")).alias("e"), total("v").alias("t"), mean("v").alias("m"))
    assert rows(got) == [(want, float(want), float(want) / len(values))]
    assert rows(df.filter("v is null").agg(total("v"), mean("v"))) == [(None, None)]
    huge = spark.range(40_000).select(F.lit(9_000_000_000_000_00).alias("u"))
    assert huge.agg(exact_sum(F.col("u"))).first()[0] == Decimal(9_000_000_000_000) * 40_000


def test_percent_of_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a long, b long")
    assert rows(df.select(percent(F.col("a"), F.col("b")))) == [(None,), (25.0,)]


def test_measures_in_sql(spark, sales):
    register_measure(spark, "ratio_of", lambda a, b: a / b, "double")
    sales.createOrReplaceTempView("sales")
    got = spark.sql("select d, ratio_of(sum(v), count(*)) as r from sales group by d")
    assert rows(got) == [(None, 6.0), ("a", 1.5)]


def test_custom_measure_merges_batches(spark, sales):
    """Groups in many batches and partitions, one group without a name."""
    many = sales.crossJoin(spark.range(50)).repartition(5)
    got = custom_measure(
        many, ["d"], ["v"], lambda g: {"s": int(g.v.sum()), "m": int(g.v.max())},
        {"s": ("bigint", F.sum), "m": ("bigint", F.max)},
        lambda s, m: (s * 1000 + m).astype("float64"), "double", "r")
    assert rows(got) == [(None, 600_008.0), ("a", 150_002.0)]


def test_custom_measure_dimensions(spark):
    """Whole numbers too large for a float beside nulls, times, and no dimension."""
    big = 2**60 + 1
    df = spark.createDataFrame([(big, at(1), 2), (None, at(1), 3), (big, None, 4)],
                               "k long, t timestamp_ntz, v long")

    def total(dims):
        return rows(custom_measure(df, dims, ["v"], lambda g: {"s": int(g.v.sum())},
                                   {"s": ("bigint", F.sum)}, lambda s: s * 2, "long", "r"))
    assert total(["k"]) == [(None, 6), (big, 12)]
    assert total(["k", "t"]) == [(None, at(1), 6), (big, None, 8), (big, at(1), 4)]
    assert total([]) == [(18,)]


def test_one_scan_per_panel(spark, sf):
    from dashloom.plans.queries.aggregates import order_facets, tiles
    from dashloom.plans.queries.ranking import top_brands
    from dashloom.plans.queries.series import hourly_without_gaps, year_over_year
    for query, scans in ((tiles, 1), (order_facets, 1), (hourly_without_gaps, 1),
                         (year_over_year, 1), (top_brands, 2)):
        df = query(spark, sf)
        df.collect()
        final = plan(df).split("== Initial Plan ==")[0]
        assert final.count("FileScan") == scans, query


def test_tables_are_lazy(spark, sf):
    t = load(spark, sf)
    assert len(t) == 14 and plan(t["orders"].select("o_orderkey")).count("o_orderkey:bigint") == 1


def test_given_schemas_are_those_of_the_files(spark, sf):
    for name, df in load(spark, sf).items():
        found = spark.read.parquet(f"{sf}/{name}.parquet")
        assert df.schema == found.schema, name


def test_top_panel_needs_one_dimension(spark, sf):
    for wrong in ({"dims": ()}, {"dims": ("o_custkey", "o_orderstatus")},
                  {"dims": ("o_custkey",), "grain": ("o_orderdate", "month")}):
        with pytest.raises(ValueError):
            run_panel(spark, sf, Panel("orders", {"n": F.count(F.lit(1))}, top=("n", 2), **wrong))


def test_public_names():
    import dashloom
    assert len(set(dashloom.__all__)) == len(dashloom.__all__)
    assert all(callable(getattr(dashloom, name)) for name in dashloom.__all__)
