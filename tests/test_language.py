"""Semantics of operators and functions on small inline tables."""

from __future__ import annotations

import datetime as dt
import json
import math

import pytest

from pipewright.engine import Engine
from pipewright.functions import QueryError

NUMBERS = "let N = datatable(i:int, l:long, r:real)[1, 10, 1.5, -7, 20, -2.5, 0, 3000000000, 0.0, int(null), long(null), real(null)]; "
STRINGS = "let S = datatable(s:string, tag:string)['Hello World', 'a', 'hello-world', 'b', 'ÉCOLE', 'a', '', 'c', \"it's\", 'b']; "
DUPS = "let D = datatable(k:long, v:long)[1, 10, 1, 20, 2, 30, 2, 30, 3, 5]; "


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def values(engine, text):
    return [tuple(r) for r in engine.query(text).collect()]


def printed(engine, text):
    return tuple(engine.query("print " + text).first())


def test_arithmetic(engine):
    assert printed(engine, "5/2, -5/2, 5/0, 5.0/2, 7%3, -7%3, 7%-3, 1+2*3, 2-5") == (2, -2, None, 2.5, 1, 2, 1, 7, -3)
    inf, minus, nan = printed(engine, "1.0/0, -1.0/0, 0.0/0")
    assert inf == math.inf and minus == -math.inf and math.isnan(nan)


def test_nulls(engine):
    assert values(engine, NUMBERS + "N | where i != 1 | count") == [(3,)]
    assert values(engine, NUMBERS + "N | where i == 1 | count") == [(1,)]
    assert values(engine, NUMBERS + "N | where isnull(i) | project coalesce(i, 5), iff(isnull(l), 'x', 'y')") == [(5, "x")]


def test_text_predicates(engine):
    count = lambda p: values(engine, STRINGS + f"S | where {p} | count")[0][0]
    assert count("s has 'hello'") == 2 and count("s has_cs 'hello'") == 1 and count("s has 'hell'") == 0
    assert count("s contains 'WORLD'") == 2 and count("s contains_cs 'World'") == 1 and count("s !contains 'o'") == 2
    assert count("s startswith 'éc'") == 1 and count("s endswith_cs 'ld'") == 2 and count("s hasprefix 'wor'") == 2 and count("s hassuffix 'rld'") == 2
    assert count("s =~ 'école'") == 1 and count("s !~ 'école'") == 4 and count("s in~ ('HELLO WORLD', 'x')") == 1
    assert count("s matches regex '^[a-z-]+$'") == 1 and count("s has_any ('it', 'école')") == 2 and count("s has_all ('hello', 'world')") == 2
    assert count("* has 'hello'") == 2 and count("s contains '%'") == 0


def test_conversions(engine):
    assert printed(engine, "tolong('3.7'), tolong('-2.6'), toint('x'), tolong('9223372036854775807'), toreal('1e3'), tobool('true'), tobool('0'), tostring(true), tostring(int(null)), tolong(true)") == (3, -2, None, 9223372036854775807, 1000.0, True, False, "True", "", 1)
    assert printed(engine, "todatetime('2024-02-03T04:05:06Z'), todatetime('2/3/2024'), todatetime('nope'), todatetime('Sat, 3 Feb 2024 04:05:06 GMT'), tostring(datetime(2024-01-02 03:04:05.678))") == (dt.datetime(2024, 2, 3, 4, 5, 6), dt.datetime(2024, 2, 3), None, dt.datetime(2024, 2, 3, 4, 5, 6), "2024-01-02T03:04:05.6780000Z")
    assert printed(engine, "totimespan('1.02:03:04'), tostring(1d + 2h), tostring(-90m), totimespan('5m')") == (dt.timedelta(days=1, hours=2, minutes=3, seconds=4), "1.02:00:00", "-01:30:00", dt.timedelta(minutes=5))
    assert printed(engine, "tolong(datetime(0001-01-01)), todatetime(tolong(datetime(2024-05-06))), toguid('{74BE27DE-1E4E-49D9-B579-FE0B331D3642}')") == (0, dt.datetime(2024, 5, 6), "74be27de-1e4e-49d9-b579-fe0b331d3642")


def test_times(engine):
    assert printed(engine, "datetime(2024-03-01) - datetime(2024-02-01), datetime(2024-01-01) + 36h, 1d / 6h, 2 * 3h, bin(datetime(2024-01-03), 7d), bin(37m, 15m)") == (dt.timedelta(days=29), dt.datetime(2024, 1, 2, 12), 4.0, dt.timedelta(hours=6), dt.datetime(2024, 1, 1), dt.timedelta(minutes=30))
    assert printed(engine, "datetime_diff('year', datetime(2024-01-01), datetime(2023-12-31)), datetime_diff('second', datetime(2024-01-01 00:00:00), datetime(2023-12-31 23:59:59.9)), datetime_add('month', -1, datetime(2024-03-31)), make_datetime(2024, 2, 29), make_datetime(2024, 2, 30), make_timespan(25, 0), make_timespan(1, 30)") == (1, 1, dt.datetime(2024, 2, 29), dt.datetime(2024, 2, 29), None, None, dt.timedelta(minutes=90))
    assert printed(engine, "unixtime_seconds_todatetime(86400), unixtime_milliseconds_todatetime(1500), datetime_utc_to_local(datetime(2024-07-01), 'Europe/Paris'), datetime_local_to_utc(datetime(2024-07-01 02:00), 'Europe/Paris')") == (dt.datetime(1970, 1, 2), dt.datetime(1970, 1, 1, 0, 0, 1, 500000), dt.datetime(2024, 7, 1, 2), dt.datetime(2024, 7, 1))


def test_arrays(engine):
    assert printed(engine, "array_length(dynamic([1,2,3])), array_sum(dynamic([1,2,3])), array_index_of(dynamic(['a','b']), 'b'), array_slice(dynamic([1,2,3,4]), -3, -2), array_concat(dynamic([1]), dynamic([2])), array_rotate_left(dynamic([1,2,3]), 1), array_shift_right(dynamic([1,2,3]), 1, 0), range(5, 1, -2), range(1, 0)") == (3, 6.0, 1, [2, 3], [1, 2], [2, 3, 1], [0, 1, 2], [5, 3, 1], [])
    assert printed(engine, "set_union(dynamic([1,2]), dynamic([2,3])), set_intersect(dynamic([1,2]), dynamic([2,3])), set_difference(dynamic([1,2]), dynamic([2,3])), set_has_element(dynamic([1,2]), 2), jaccard_index(dynamic([1,2]), dynamic([2,3])), dynamic([1,2,3])[-1], array_split(dynamic([1,2,3]), 1)") == ([1, 2, 3], [2], [1], True, 1 / 3, 3, [[1], [2, 3]])


def test_bags(engine):
    assert printed(engine, "bag_keys(dynamic({'a':1,'b':2})), tostring(dynamic({'a':{'b':[5,6]}}).a.b[1]), bag_merge(dynamic({'a':1}), dynamic({'a':2,'c':3})), bag_remove_keys(dynamic({'a':1,'b':2}), dynamic(['a'])), bag_pack('x', 1, 'y', 'z'), parse_json('{broken'), extract_json('$.a', '{\"a\":7}'), gettype(dynamic({'a':1})), dynamic_to_json(dynamic({'b':1,'a':2}))") == (["a", "b"], "6", '{"a":1,"c":3}', '{"b":2}', '{"x":1,"y":"z"}', None, "7", "dictionary", '{"a":2,"b":1}')


def test_series(engine):
    row = printed(engine, "series_fill_forward(dynamic([1,null,3])), series_fill_backward(dynamic([null,2])), series_fill_const(dynamic([1,null]), 9), series_fill_linear(dynamic([1.0,null,3.0])), series_multiply(dynamic([1,2]), dynamic([3,4])), series_divide(dynamic([1]), dynamic([2])), series_greater(dynamic([1,5]), 2), series_iir(dynamic([1,1,1]), dynamic([1]), dynamic([1,-0.5])), series_fir(dynamic([2,4]), dynamic([1,1]))")
    assert row == ([1, 1, 3], [2, 2], [1, 9], [1.0, 2.0, 3.0], [3.0, 8.0], [0.5], [False, True], [1.0, 1.5, 1.75], [1.0, 3.0])
    fit = engine.query("print f=parse_json(series_fit_line(dynamic([1.0,3.0,5.0]))) | project s=toreal(f.slope), i=toreal(f.interception), r=toreal(f.rsquare)").first()
    assert tuple(fit) == (2.0, 1.0, 1.0)


def test_series_take_time_in_proportion(spark):
    """Statistics, filters and shifts of one long series: quadratic ones would take minutes."""
    import time

    n = 60_000
    df = spark.range(n).selectExpr("id", "if(id % 3 = 1, cast(null as double), cast(id as double)) AS v").selectExpr("sort_array(collect_list(struct(id, v))).v AS s", "sort_array(collect_list(id)) AS i")
    engine = Engine(spark, {"T": df.localCheckpoint()})
    start = time.monotonic()
    t, total, shifted = values(engine, "T | project t=tostring(series_stats_dynamic(s)), f=array_sum(series_fir(i, dynamic([1, 1]), false)), h=array_sum(array_shift_left(array_sort_asc(i), 1, 0))")[0]
    assert time.monotonic() - start < 60
    real = [x for x in range(n) if x % 3 != 1]
    mean = sum(real) / len(real)
    t = json.loads(t)
    assert (t["min"], t["min_idx"], t["max"], t["max_idx"], t["len"], t["sum"]) == (0, 0, n - 1, n - 1, n, sum(real))
    assert t["avg"] == pytest.approx(mean) and t["variance"] == pytest.approx(sum((x - mean) ** 2 for x in real) / (len(real) - 1))
    assert total == sum(range(n)) + sum(range(n - 1)) and shifted == sum(range(n))
    assert values(engine, "print s=dynamic([2.0]), e=dynamic([]) | project a=todouble(series_stats_dynamic(s).variance), b=todouble(series_stats_dynamic(e).avg)") == [(0.0, None)]
    assert printed(engine, "zip(dynamic([1, 2]), dynamic([3]))") == ([[1, 3], [2, None]],)


def test_series_fill_takes_time_in_proportion(spark):
    """Both directions of a long series with gaps, types and edges: one that grows by copies would take minutes."""
    import time

    n = 200_000
    df = spark.range(n).selectExpr("id", "if(id % 3 = 1, cast(null as bigint), id) AS v").selectExpr("sort_array(collect_list(struct(id, v))).v AS s")
    engine = Engine(spark, {"T": df.localCheckpoint()})
    start = time.monotonic()
    f, b, m = values(engine, "T | project f=array_sum(series_fill_forward(s)), b=array_sum(series_fill_backward(s)), n=array_length(series_fill_forward(s))")[0]
    assert time.monotonic() - start < 60
    assert f == sum(x - (x % 3 == 1) for x in range(n)) and m == n
    assert b == sum(x + (x % 3 == 1) for x in range(n) if (x + 1 < n or x % 3 != 1))
    assert printed(engine, "series_fill_forward(dynamic([null, null, 3, -1, null, 5]), -1), series_fill_backward(dynamic([null, 3, -1, null]), -1), series_fill_forward(dynamic([null, 7, -1]), -1)") == ([None, None, 3, 3, 3, 5], [3, 3, None, None], [None, 7, 7])
    schema = engine.query("T | project s=series_fill_forward(s)").schema["s"].dataType.simpleString()
    assert schema == "array<bigint>"


def test_networks(engine):
    assert printed(engine, "parse_ipv4('1.2.3.4'), parse_ipv4('1.2.3.400'), ipv4_is_private('192.168.3.4'), ipv4_is_in_range('10.1.2.3', '10.1.0.0/16'), ipv4_compare('1.2.3.4', '1.2.3.5'), ipv4_is_match('1.2.3.4', '1.2.3.9', 24), format_ipv4(16909060), format_ipv4_mask('1.2.3.4', 24), ipv4_netmask_suffix('1.2.3.0/24')") == (16909060, None, True, True, -1, True, "1.2.3.4", "1.2.3.0/24", 24)


def test_summarize_rules(engine):
    assert values(engine, DUPS + "D | where k > 9 | summarize sum(v), count(), make_list(v), max(v)") == [(0, 0, [], None)]
    assert math.isnan(values(engine, DUPS + "D | where k > 9 | summarize avg(v)")[0][0])
    assert sorted(values(engine, DUPS + "D | summarize n=count(), d=dcount(v), s=stdev(v) by k")) == [(1, 2, 2, 7.0710678118654755), (2, 2, 1, 0.0), (3, 1, 1, 0.0)]
    assert engine.query(DUPS + "D | summarize count(), sum(v), sum(v), arg_max(v, k), percentile(v, 50), make_set(k) by bin(k, 2)").columns == ["k", "count_", "sum_v", "sum_v1", "v", "k1", "percentile_v_50", "set_k"]
    assert sorted(values(engine, DUPS + "D | summarize by k")) == [(1,), (2,), (3,)]
    assert values(engine, DUPS + "D | summarize x=percentilew(v, k, 50), y=percentiles_array(v, 0, 100)") == [(20, [5, 30])]
    assert values(engine, "datatable(d:dynamic)[dynamic({'a':1,'b':2}), dynamic({'a':5,'c':3})] | summarize make_bag(d)")[0][0] in ('{"a":1,"b":2,"c":3}', '{"a":5,"b":2,"c":3}', '{"a":5,"c":3,"b":2}')


def test_sums_of_timespans_keep_their_digits(spark):
    """Quotients beyond the digits of a double, and sums that do not fit a timespan."""
    us = [4_000_000_000_000_000_001, 3_999_999_999_999_999_998, 4_000_000_000_000_000_000]
    df = spark.createDataFrame([(1, us[0]), (1, us[1]), (2, -us[0]), (2, -us[1]), (2, -us[2]), (3, None)], "k int, n long").selectExpr("k", "timestamp_micros(n) - timestamp_micros(0L) AS s")
    engine = Engine(spark, {"T": df})
    one = values(engine, "T | summarize t=sum(s) by k | where k > 0 | extend u=t | project-rename v=u | sort by k asc | project k, ms=tolong(v / 1ms), us=tolong(t / 1microsecond), fits=isnotnull(t), r=t / 1d")
    assert [r[:4] for r in one] == [(1, 7_999_999_999_999_999, 7_999_999_999_999_999_999, True), (2, -11_999_999_999_999_999, None, False), (3, 0, 0, True)]
    assert one[1][4] == pytest.approx(-11_999_999_999_999_999_999 / 86.4e9)
    assert values(engine, "T | summarize a=tolong(sum(s) / 1ms), b=tolong(sumif(s, k == 2) / 1ms), c=avg(s), d=avgif(s, k == 3) | project a, b, c=tolong(c / 1microsecond), d=isnull(d)") == [(-4_000_000_000_000_000, -11_999_999_999_999_999, -800_000_000_000_000_000, True)]
    assert values(engine, "T | where k == 1 | summarize t=sum(s) by k | extend t=t - t | project toint(t / 1ms), t / 0ms") == [(0, pytest.approx(math.nan, nan_ok=True))]
    assert values(engine, "T | where k == 1 | summarize t=sum(s) by k | join kind=inner (T | where k == 1 | summarize t=sum(s) by k) on k | union (T | summarize t=sum(s) by k) | where k == 1 | distinct k, t | count") == [(1,)]


def test_joins(engine):
    right = "let R = datatable(k:long, w:string)[1, 'a', 1, 'b', 4, 'd']; "
    rows = lambda kind: sorted(values(engine, DUPS + right + f"D | join kind={kind} R on k"), key=str)
    assert len(rows("inner")) == 4 and len(rows("innerunique")) == 2
    assert engine.query(DUPS + right + "D | join kind=inner R on k").columns == ["k", "v", "k1", "w"]
    assert ((3, 5, None, "") in rows("leftouter")) and len(rows("leftouter")) == 7
    assert (None, None, 4, "d") in rows("fullouter") and len(rows("rightouter")) == 5
    assert rows("leftsemi") == [(1, 10), (1, 20)] and rows("rightanti") == [(4, "d")]
    nulls = "let A = datatable(k:string, x:long)['', 1]; let B = datatable(k:long, y:long)[long(null), 1, 2, 2]; let C = datatable(k:long, z:long)[long(null), 3]; "
    assert values(engine, nulls + "B | join kind=inner C on k") == [(None, 1, None, 3)]
    assert values(engine, nulls + "B | join kind=leftsemi C on k") == []
    assert engine.query(DUPS + right + "D | lookup R on k").columns == ["k", "v", "w"]


def test_a_join_of_one_split_is_written_by_many_tasks(spark, tmp_path):
    """Keys that repeat on both sides: the rows of one file must not all be paired by one task."""
    spark.range(300).selectExpr("id % 3 AS k", "id AS a").coalesce(1).write.parquet(str(tmp_path / "L.parquet"))
    spark.range(60).selectExpr("id % 3 AS k", "id AS b").coalesce(1).write.parquet(str(tmp_path / "R.parquet"))
    engine = Engine(spark, str(tmp_path))
    for text in ("L | join kind=inner R on k", "R | join kind=inner L on k", "L | join kind=leftouter R on k", "R | join kind=rightouter L on k", "L | lookup R on k"):
        rows = engine.query(text).selectExpr("a", "b", "spark_partition_id() AS task").collect()
        assert sorted((r["a"], r["b"]) for r in rows) == sorted((a, b) for a in range(300) for b in range(60) if a % 3 == b % 3), text
        assert len({r["task"] for r in rows}) > 3, text
    assert engine.query("L | join hint.strategy=broadcast kind=inner R on k").count() == 6000


def test_union_pads_strings(engine):
    got = values(engine, "let A = datatable(x:long, s:string)[1, 'a']; let B = datatable(y:long)[2]; union A, B")
    assert got == [(1, "a", None), (None, "", 2)]


def test_windows_and_restarts(engine):
    got = values(engine, DUPS + "D | sort by k asc, v asc | extend n=row_number(), p=prev(v), q=next(v, 1, -1), c=row_cumsum(v, k != prev(k)), d=row_rank_dense(k), m=row_rank_min(k)")
    assert got == [(1, 10, 1, None, 20, 10, 1, 1), (1, 20, 2, 10, 30, 30, 1, 1), (2, 30, 3, 20, 30, 30, 2, 3), (2, 30, 4, 30, 5, 60, 2, 3), (3, 5, 5, 30, -1, 5, 3, 5)]
    assert values(engine, DUPS + "D | sort by k asc, v asc | where v > prev(v) | project v") == [(20,), (30,)]
    assert values(engine, DUPS + "D | sort by k asc, v asc | where v != 20 and v > prev(v) | project v") == [(30,)]
    assert values(engine, DUPS + "D | sort by k asc, v asc | where v == 30 and prev(v) == 20 and k in (D | where v > 20 | project k) | project k") == [(2,)]
    assert values(engine, DUPS + "D | sort by k asc, v asc | project v | extend n=row_number() | where n == 5") == [(5, 5)]


@pytest.fixture
def parted(spark):
    """Rows in several parts: small ones would be put into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _no_single_task(engine, text):
    return "SinglePartition" not in engine.explain(text, "simple")


def test_windows_without_key_are_spread(parted):
    """Running sums, ranks and restarts over parts of one order agree with a plain loop."""
    import random

    r = random.Random(5)
    for n, groups in ((0, 1), (1, 1), (300, 4), (300, 60), (300, 1)):
        rows = sorted((r.randrange(groups), i, r.choice([None, 1, 2, 30])) for i in range(n))
        df = parted.createDataFrame(r.sample(rows, len(rows)), "k long, i long, v long").repartition(3)
        engine = Engine(parted, {"T": df})
        text = "T | sort by k asc, i asc | extend n=row_number(1, k != prev(k)), c=row_cumsum(v, k != prev(k)), d=row_rank_dense(k), m=row_rank_min(k), e=row_rank_dense(v, k != prev(k)), f=row_rank_min(v, k != prev(k)), s=row_window_session(i, 40, 3)"
        expected, last, total, number, dense, lowest, e, f, session = [], None, 0, 0, 0, 0, 0, 0, 0
        for j, (k, i, v) in enumerate(rows):
            new = j == 0 or k != last[0]
            number, total = (1, v or 0) if j and new else (number + 1, total + (v or 0))
            dense, lowest = (dense + 1, j + 1) if new else (dense, lowest)
            other = j == 0 or new or v != last[2]
            e, f = (1 if new else e + 1, number) if other else (e, f)
            session += bool(j and (i > last[1] + 3 or i - last[1] > 40))
            last = (k, i, v)
            expected.append((k, i, v, number, total, dense, lowest, e, f, session))
        got = values(engine, text)
        # A sum of nothing but nulls is 0, and rows come in order.
        assert got == expected, (n, groups)
        assert _no_single_task(engine, text)


def test_serialized_rows_are_numbered_in_parts(parted):
    """Row numbers and neighbours, near and far, in both directions, with defaults, ties and without an order."""
    rows = [(i, i * i % 97) for i in range(250)]
    engine = Engine(parted, {"T": parted.createDataFrame(rows[::-1], "i long, v long").repartition(3)})
    text = "T | sort by i asc | serialize n=row_number(), m=row_number(10), gap=v - prev(v, 1, 0), p=prev(v, 70, -1), q=next(v, 90), w=next(v, 1, -5), z=prev(v, 200) | consume"
    at = lambda j, other: rows[j][1] if 0 <= j < 250 else other
    assert values(engine, text) == [(i, v, i + 1, i + 10, v - at(i - 1, 0), at(i - 70, -1), at(i + 90, None), at(i + 1, -5), at(i - 200, None)) for i, v in rows]
    assert _no_single_task(engine, text.replace(", z=prev(v, 200)", ""))
    assert values(engine, "T | sort by i desc | extend n=row_number() | where n > 1 and prev(n) % 2 == 1 | take 2 | project i, n") == [(248, 2), (246, 4)]
    assert sorted(r[0] for r in values(engine, "T | extend t=v % 3 | sort by t asc | extend n=row_number() | project n")) == list(range(1, 251))
    assert values(engine, "T | sort by i asc | extend a=row_number() | extend b=row_cumsum(a) | summarize x=max(b), y=make_list(a) | project x, z=tolong(y[0]), u=tolong(y[249])") == [(250 * 251 // 2, 1, 250)]
    with pytest.warns(UserWarning):
        assert sorted(r[0] for r in values(engine, "T | extend n=row_number() | project n")) == list(range(1, 251))


def test_scan(engine):
    assert values(engine, DUPS + "D | sort by k asc, v asc | scan declare (c:long=100) with (step s: true => c = s.c + v;) | project c") == [(110,), (130,), (160,), (190,), (195,)]
    assert values(engine, DUPS + "D | sort by k asc, v asc | scan declare (c:long=0) with (step s: true => c = iff(s.c >= 30, v, s.c + v);) | project c | sort by c asc") == [(5,), (10,), (30,), (30,), (30,)]
    halves = "D | scan order by v asc partition by k declare (c:real=0.0) with (step s: true => c = s.c*0.5 + v;) | project k, v, c"
    assert sorted(values(engine, DUPS + halves)) == [(1, 10, 10.0), (1, 20, 25.0), (2, 30, 30.0), (2, 30, 45.0), (3, 5, 5.0)]
    wide = "datatable(t:long, x:long, d:datetime, s:timespan)[1, 9007199254740993, datetime(2024-01-01), 1d, 2, long(null), datetime(null), 2d] | sort by t asc | scan declare (c:real=0.0, m:datetime, n:string='') with (step s: true => c = s.c*0.5 + t, m = coalesce(d, s.m), n = strcat(s.n, 'x');)"
    day = dt.datetime(2024, 1, 1)
    assert values(engine, wide + " | sort by t asc") == [(1, 9007199254740993, day, dt.timedelta(days=1), 1.0, day, "x"), (2, None, None, dt.timedelta(days=2), 2.5, day, "xx")]
    steps = "datatable(t:long, e:string)[1,'a',2,'x',3,'b',4,'a',5,'b'] | sort by t asc | scan with_match_id=m declare (at:long) with (step s1: e == 'a' => at = t; step s2: e == 'b' => at = s1.at;) | sort by t asc"
    assert values(engine, steps) == [(1, "a", 1, 0), (3, "b", 1, 0), (4, "a", 4, 1), (5, "b", 4, 1)]


def test_reshaping(engine):
    table = "let T = datatable(id:long, d:dynamic)[1, dynamic([10,20]), 2, dynamic([]), 3, dynamic({'a':1,'b':2}), 4, dynamic(null)]; "
    assert sorted(values(engine, table + "T | mv-expand d | project id, tostring(d)")) == [(1, "10"), (1, "20"), (3, '{"a":1}'), (3, '{"b":2}'), (4, "")]
    assert sorted(values(engine, table + "T | where id == 1 | mv-expand with_itemindex=i d to typeof(long) | project i, d")) == [(0, 10), (1, 20)]
    assert values(engine, table + "T | mv-apply x=d to typeof(long) on (where x > 10) | project id, x") == [(1, 20)]
    assert values(engine, "print a=dynamic([1,2]), b=dynamic(['x','y','z']) | mv-expand a, b | project a, b") == [(1, "x"), (2, "y"), (None, "z")]
    assert values(engine, "datatable(k:string, v:long)['a',1,'b',2,'a',3] | evaluate pivot(k, sum(v))") == [(4, 2)]
    assert values(engine, "datatable(id:long, d:dynamic)[1, dynamic({'x':1}), 2, dynamic({'y':'q'})] | evaluate bag_unpack(d) | sort by id asc") == [(1, "1", None), (2, None, "q")]


def test_make_series(engine):
    table = "let T = datatable(t:datetime, k:string, v:long)[datetime(2024-01-01), 'a', 1, datetime(2024-01-03), 'a', 2, datetime(2024-01-02), 'b', 5]; "
    assert sorted(values(engine, table + "T | make-series s=sum(v) default=0 on t from datetime(2024-01-01) to datetime(2024-01-04) step 1d by k | project k, s")) == [("a", [1, 0, 2]), ("b", [0, 5, 0])]
    got = values(engine, table + "T | make-series n=count() on t step 1d")[0]
    assert got == ([1, 1, 1], [dt.datetime(2024, 1, d) for d in (1, 2, 3)])
    assert values(engine, "range x from 0 to 9 step 1 | make-series n=count() on x in range(0, 8, 4) | project n, x") == [([4, 4, 1], [0, 4, 8])]


def test_parsing(engine):
    assert values(engine, "print s='user=bob id=42 end' | parse s with 'user=' user ' id=' id:long ' end' | project user, id") == [("bob", 42)]
    assert values(engine, "print s='no match' | parse s with 'user=' user ' id=' id:long | project user, id") == [("", None)]
    assert values(engine, "datatable(s:string)['a=1','zz'] | parse-where s with 'a=' n:long") == [("a=1", 1)]
    assert values(engine, "print s='a=x1;b' | parse kind=regex s with 'a=' n '[;]' rest | project n, rest") == [("x1", "b")]
    assert values(engine, "print s='a:1, b: two' | parse-kv s as (a:long, b:string, c:string) with (pair_delimiter=',', kv_delimiter=':') | project a, b, c") == [(1, "two", "")]
    assert values(engine, STRINGS + "S | search 'hello' | count") == [(2,)]
    assert values(engine, STRINGS + "S | search s:'hel*' and not('world') | count") == [(0,)]


def test_top_operators(engine):
    assert values(engine, DUPS + "D | top-hitters 2 of k by v") == [(1, 30), (2, 60)]
    assert sorted(values(engine, DUPS + "D | top-nested 1 of k with others=long(-1) by sum(v)")) == [(-1, 35), (2, 60)]
    assert values(engine, DUPS + "D | top 2 by v asc | project v") == [(5,), (10,)]
    assert values(engine, NUMBERS + "N | sort by i asc | project i") == [(None,), (-7,), (0,), (1,)]


def test_projections(engine):
    assert engine.query(DUPS + "D | project k, v+1, tostring(v), x=k*2").columns == ["k", "Column1", "v", "x"]
    assert engine.query(DUPS + "D | extend v=v*2, z=v | project-reorder z | project-rename y=z").columns == ["y", "k", "v"]
    assert values(engine, DUPS + "D | extend v=v*2, z=v | take 1") == [(1, 20, 10)]
    assert engine.query(DUPS + "D | getschema").collect()[1].asDict() == {"ColumnName": "v", "ColumnOrdinal": 1, "DataType": "System.Int64", "ColumnType": "long"}


def test_errors(engine):
    for text in ("print nope(1)", DUPS + "D | where missing == 1", DUPS + "D | join kind=odd D on k", "Missing | take 1", DUPS + "D | project-away q"):
        with pytest.raises(QueryError):
            engine.query(text)


def test_render_and_fluent(engine, spark):
    engine.query("print x=1 | render barchart with (title='T', ycolumns=x)")
    assert engine.render.kind == "barchart" and engine.render.title == "T" and engine.render.y_columns == ("x",)
    engine.register("numbers", spark.range(5))
    assert engine.pipe("numbers").where("id > 1").summarize("n=count()").df().first()["n"] == 3
    other = engine.pipe("numbers").project("id")
    assert engine.pipe("numbers").join(other, on="id", kind="inner").count().df().first()[0] == 5


def test_session_settings_come_back(engine, spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    engine.query("print 1")
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_filters_reach_the_scan(spark):
    e = Engine(spark, "/root/testdata/sf0.001")
    plan = e.explain("lineitem | where l_quantity > 45 and l_shipdate > datetime(1997-01-01) | summarize sum(l_tax) by l_returnflag")
    assert "PushedFilters" in plan and "GreaterThan(l_quantity,45" in plan
    schema = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "l_comment" not in schema and "l_partkey" not in schema


def test_one_step_scans_agree_with_the_state_machine():
    from pipewright.lang import parse_query
    from pipewright.operators.scan import _Sequence, _Single

    text = "T | scan declare (a:real=1.0, n:long=0) with (step s: v != 4 and (s.n < 3 or v > 5) => a = iff(isnull(v), s.a, s.a*0.5 + coalesce(v, 0)), n = case(v > 6, 0, v in (2, 3), s.n + 2, n + 1);)"
    step = parse_query(text).ops[0].steps[0]
    values = [1, 4, None, 2, 9, 3, 7, 5, 6, 2, 2, 8]
    start = {"a": 1.0, "n": 0}
    slow = _Sequence([step], start, None).run([{"v": v} for v in values])
    one, out = _Single(step, start), {"a": [], "n": []}
    one.reset()
    hit = one.run({"v": values}, 0, 5, out) + one.run({"v": values}, 5, len(values), out)
    assert [values[k] for k in hit] == [r["v"] for r in slow]
    assert out == {c: [r[c] for r in slow] for c in start}


def test_scans_keep_digits_and_nan(spark):
    engine = Engine(spark, {"T": spark.createDataFrame([(1, 2**53 + 1, float("nan")), (2, 2**53 + 3, None), (3, None, 1.5)], "i long, n long, x double")})
    rows = engine.query("T | scan with_match_id=m order by i asc declare (s:long=0) with (step a: i == 1 => s = 1; step b: i > 1 => s = b.s + 1;)").collect()
    assert [(r["i"], r["n"]) for r in rows] == [(1, 2**53 + 1), (2, 2**53 + 3), (3, None)]
    assert rows[0]["x"] != rows[0]["x"] and rows[1]["x"] is None and rows[2]["x"] == 1.5
    rows = engine.query("T | scan order by i asc declare (a:bool=false, b:long=1) with (step s: true => a = isnan(x), b = s.b * 5000000000;)").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(True, 5000000000), (False, None), (False, None)]
    with pytest.raises(QueryError):
        engine.query("T | scan order by i asc declare (a:real=0.0) with (step s: true => a = s.a * series_stats(x);)").collect()


def test_materialize_is_computed_once(spark):
    engine = Engine(spark, {"T": spark.range(50).toDF("i")})
    rows = engine.query("let m = materialize(T | extend r=rand()); m | join kind=inner (m | where i >= 0) on i | project i, r, r1").collect()
    assert len(rows) == 50 and all(r["r"] == r["r1"] for r in rows)
    spark.catalog.clearCache()
