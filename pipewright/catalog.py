"""Registered queries of the language over the test tables, each with the same result in DuckDB's SQL.

A query returns flat scalar columns; doubles that depend on the order of summation are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pipewright import catalog_more
from pipewright.engine import Engine

#: name -> (query, SQL or None where SQL cannot say it)
QUERIES: dict[str, tuple[str, str | None]] = {}


def _add(name: str, query: str, sql: str | None) -> None:
    QUERIES[name] = (query, sql)


_B, _A = r"(^|[^\p{L}\p{N}])", r"([^\p{L}\p{N}]|$)"
_DAY = "CAST(epoch_us(ts) AS BIGINT)"


def _bin_us(column: str, size: int) -> str:
    """A datetime's bin from 0001-01-01, in SQL."""
    us = f"(epoch_us({column}) + 62135596800000000)"
    return f"make_timestamp(CAST({us} - {us} % {size} - 62135596800000000 AS BIGINT))"


# Filters, projections, expressions.
_add("where_project", "lineitem | where l_shipdate >= datetime(1995-01-01) and l_quantity < 24 and l_discount between (0.05 .. 0.07) | project l_orderkey, l_linenumber, revenue=round(l_extendedprice*l_discount, 4)", "SELECT l_orderkey, l_linenumber, round(l_extendedprice*l_discount, 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07")
_add("string_predicates", "part | where (p_name contains 'A' or p_type startswith 'eco' or p_brand endswith '3' or p_brand =~ 'BRAND#12') and p_type !contains_cs 'zzz' and p_brand !in~ ('brand#45') | project p_partkey, p_name, p_brand", "SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name),'a') OR starts_with(lower(p_type),'eco') OR ends_with(lower(p_brand),'3') OR upper(p_brand)='BRAND#12') AND NOT contains(p_type,'zzz') AND upper(p_brand) NOT IN ('BRAND#45')")
_add("has_term", "documents | where text has 'the' and text !has 'zzzz' and text hasprefix 'th' | project doc_id, n=strlen(text)", f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE regexp_matches(lower(text), '{_B}the{_A}') AND NOT regexp_matches(lower(text), '{_B}zzzz{_A}') AND regexp_matches(lower(text), '{_B}th')")
_add("has_any_all", "conversations | where text has_any ('the','from') and text has_all ('of','and') | project conv_id, turn", f"SELECT conv_id, turn FROM conversations WHERE (regexp_matches(lower(text), '{_B}the{_A}') OR regexp_matches(lower(text), '{_B}from{_A}')) AND regexp_matches(lower(text), '{_B}of{_A}') AND regexp_matches(lower(text), '{_B}and{_A}')")
_add("not_equal_null", "orders | join kind=leftouter (customer | where c_acctbal > 5000) on $left.o_custkey == $right.c_custkey | where c_nationkey != 3 | project o_orderkey, c_nationkey", "SELECT o_orderkey, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey WHERE c_nationkey IS DISTINCT FROM 3")
_add("between_in", "orders | where o_orderdate between (datetime(1995-01-01) .. datetime(1996-12-31)) and o_orderpriority in ('1-URGENT','2-HIGH') and o_orderstatus !in ('P') | project o_orderkey, o_orderpriority", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND o_orderpriority IN ('1-URGENT','2-HIGH') AND o_orderstatus NOT IN ('P')")
_add("in_subquery", "orders | where o_custkey in (customer | where c_mktsegment == 'BUILDING' | project c_custkey) and o_orderkey !in (lineitem | where l_quantity > 45 | project l_orderkey) | project o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
_add("matches_regex", "pages | where url matches regex @'^https?://(m|www)\\.' | project page_id, host=extract(@'://([^/]+)/', 1, url)", r"SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://(m|www)\.')")
_add("extend_replace", "lineitem | extend l_extendedprice = round(l_extendedprice*(1-l_discount), 4), late = l_returnflag == 'R' | project l_orderkey, l_linenumber, l_extendedprice, late", "SELECT l_orderkey, l_linenumber, round(l_extendedprice*(1-l_discount), 4) AS l_extendedprice, l_returnflag = 'R' AS late FROM lineitem")
_add("project_family", "customer | project-rename name=c_name | project-away c_mkt* | project-keep name, c_custkey, c_acctbal | project-reorder c_acctbal", "SELECT c_acctbal, c_custkey, c_name AS name FROM customer")
_add("int_div_mod", "lineitem | project l_orderkey, l_linenumber, d=l_partkey / 7, m=(l_suppkey - 500) % -13, z=l_partkey / (l_linenumber - 1)", "SELECT l_orderkey, l_linenumber, l_partkey // 7 AS d, (((l_suppkey - 500) % 13) + 13) % 13 AS m, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey // (l_linenumber - 1) END AS z FROM lineitem")
_add("real_div", "lineitem | project l_orderkey, l_linenumber, r=tolong(l_extendedprice / l_quantity * 1000.0), z=iff(isinf(1.0 / (l_linenumber - 1.0)), 'inf', 'finite')", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice / l_quantity * 1000.0) AS BIGINT) AS r, CASE WHEN l_linenumber = 1 THEN 'inf' ELSE 'finite' END AS z FROM lineitem")
_add("bin_numeric", "events | summarize n=count(), total=round(sum(value), 4) by b=bin(value, 25.0), k=bin(event_id, 100)", "SELECT floor(value/25.0)*25.0 AS b, (event_id // 100) * 100 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
_add("bin_datetime", "events | summarize n=count() by ts=bin(ts, 6h)", f"SELECT {_bin_us('ts', 21600000000)} AS ts, count(*) AS n FROM events GROUP BY 1")
_add("bin_7d", "orders | summarize n=count() by week=bin(o_orderdate, 7d), at=bin_at(o_orderdate, 30d, datetime(1995-01-10))", f"SELECT {_bin_us('o_orderdate', 604800000000)} AS week, make_timestamp(CAST(epoch_us(TIMESTAMP '1995-01-10') + floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-10')) / 2592000000000.0) * 2592000000000 AS BIGINT)) AS at, count(*) AS n FROM orders GROUP BY ALL")
_add("datetime_parts", "events | project event_id, y=tolong(getyear(ts)), m=tolong(monthofyear(ts)), d=tolong(dayofmonth(ts)), doy=tolong(dayofyear(ts)), w=tolong(weekofyear(ts)), h=tolong(hourofday(ts)), q=datetime_part('quarter', ts), ms=datetime_part('millisecond', ts), wd=tolong(dayofweek(ts) / 1d)", "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(dayofyear(ts) AS BIGINT) AS doy, CAST(weekofyear(ts) AS BIGINT) AS w, CAST(hour(ts) AS BIGINT) AS h, CAST(quarter(ts) AS BIGINT) AS q, CAST((epoch_us(ts) % 1000000) // 1000 AS BIGINT) AS ms, CAST(dayofweek(ts) AS BIGINT) AS wd FROM events")
_add("datetime_starts", "orders | project o_orderkey, sd=startofday(o_orderdate), sw=startofweek(o_orderdate), sm=startofmonth(o_orderdate, 1), sy=startofyear(o_orderdate), ed=endofday(o_orderdate), ew=endofweek(o_orderdate), em=endofmonth(o_orderdate), ey=endofyear(o_orderdate)", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS sd, (date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY)::TIMESTAMP AS sw, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS sm, date_trunc('year', o_orderdate)::TIMESTAMP AS sy, (date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND)::TIMESTAMP AS ed, (date_trunc('week', o_orderdate + INTERVAL 1 DAY) + INTERVAL 6 DAY - INTERVAL 1 MICROSECOND)::TIMESTAMP AS ew, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND)::TIMESTAMP AS em, (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND)::TIMESTAMP AS ey FROM orders")
_add("datetime_diff_add", "events | extend base=datetime(2024-01-01 12:30:00) | project event_id, dd=datetime_diff('day', ts, base), dh=datetime_diff('hour', ts, base), dw=datetime_diff('week', ts, base), dm=datetime_diff('month', ts, datetime(2023-06-15)), plus=datetime_add('month', 1, ts), later=ts + 90m, age_us=tolong((ts - base) / 1microsecond)", "SELECT event_id, date_diff('day', TIMESTAMP '2024-01-01 12:30:00', ts) AS dd, date_diff('hour', TIMESTAMP '2024-01-01 12:30:00', ts) AS dh, date_diff('week', TIMESTAMP '2024-01-01 12:30:00', ts) AS dw, date_diff('month', TIMESTAMP '2023-06-15', ts) AS dm, ts + INTERVAL 1 MONTH AS plus, ts + INTERVAL 90 MINUTE AS later, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 12:30:00') AS BIGINT) AS age_us FROM events")
_add("format_datetime", "events | project event_id, a=format_datetime(ts, 'yyyy-MM-dd HH:mm:ss'), b=format_datetime(ts, 'yy/MM/dd HH.mm'), c=tostring(ts)", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%y/%m/%d %H.%M') AS b, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS c FROM events")
_add("format_timespan", "events | project event_id, s=format_timespan(ts - datetime(2024-01-01), 'd.hh:mm:ss')", "SELECT event_id, CAST(d // 86400000000 AS VARCHAR) || '.' || lpad(CAST((d // 3600000000) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST((d // 60000000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((d // 1000000) % 60 AS VARCHAR), 2, '0') AS s FROM (SELECT event_id, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS BIGINT) AS d FROM events)")
_add("casts", "datatable(s:string)['12','3.7','-2.6','true','x','','9223372036854775807'] | project s, l=tolong(s), i=toint(s), r=toreal(s), b=tobool(s)", "SELECT * FROM (VALUES ('12', 12::BIGINT, 12::INTEGER, 12.0::DOUBLE, true), ('3.7', 3, 3, 3.7, true), ('-2.6', -2, -2, -2.6, true), ('true', 1, 1, NULL, true), ('x', NULL, NULL, NULL, NULL), ('', NULL, NULL, NULL, NULL), ('9223372036854775807', 9223372036854775807, NULL, 9223372036854775807.0, true)) t(s, l, i, r, b)")
_add("string_functions", "customer | project c_custkey, u=toupper(c_mktsegment), n=strlen(c_name), c=strcat(c_name, '-', c_nationkey), r=reverse(c_mktsegment), i=indexof(c_name, '#'), k=countof(c_name, '0'), s=substring(c_name, -4), t=trim('0+', substring(c_name, 9)), p=replace_string(c_name, '#', '/'), d=strcat_delim('|', c_name, c_mktsegment), rp=strrep('ab', 3), x=translate('CU', 'cu', c_name), cmp=strcmp(c_mktsegment, 'FURNITURE'), sz=string_size(c_name)", "SELECT c_custkey, upper(c_mktsegment) AS u, CAST(length(c_name) AS BIGINT) AS n, concat(c_name, '-', CAST(c_nationkey AS VARCHAR)) AS c, reverse(c_mktsegment) AS r, CAST(instr(c_name, '#') - 1 AS BIGINT) AS i, CAST(length(c_name) - length(replace(c_name, '0', '')) AS BIGINT) AS k, right(c_name, 4) AS s, regexp_replace(regexp_replace(substr(c_name, 10), '^(0+)', ''), '(0+)$', '') AS t, replace(c_name, '#', '/') AS p, concat_ws('|', c_name, c_mktsegment) AS d, repeat('ab', 3) AS rp, translate(c_name, 'CU', 'cu') AS x, CAST(CASE WHEN c_mktsegment < 'FURNITURE' THEN -1 WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END AS BIGINT) AS cmp, CAST(strlen(c_name) AS BIGINT) AS sz FROM customer")
_add("math_functions", "events | project event_id, a=round(sqrt(value), 6), b=round(log(value+1.0), 6), c=round(exp(value/1000.0), 6), d=floor(value), e=ceiling(value), f=round(pow(value, 0.5), 6), g=round(sin(value), 6), h=abs(0-value), s=sign(value-50.0), bits=binary_and(event_id, 255), sh=binary_shift_left(event_id, 2), x=binary_xor(event_id, 7), ones=bitset_count_ones(event_id)", "SELECT event_id, round(sqrt(value), 6) AS a, round(ln(value+1.0), 6) AS b, round(exp(value/1000.0), 6) AS c, floor(value) AS d, ceil(value) AS e, round(pow(value, 0.5), 6) AS f, round(sin(value), 6) AS g, abs(0-value) AS h, CAST(sign(value-50.0) AS BIGINT) AS s, event_id & 255 AS bits, event_id << 2 AS sh, xor(event_id, 7) AS x, CAST(bit_count(event_id) AS BIGINT) AS ones FROM events")
_add("conditionals", "orders | project o_orderkey, size=case(o_totalprice > 300000, 'big', o_totalprice > 100000, 'middle', 'small'), flag=iff(o_orderstatus == 'F', 1, 0), c=coalesce(iff(o_orderstatus == 'O', '', o_orderstatus), 'x'), e=isempty(iff(o_orderstatus == 'O', '', o_orderstatus)), lo=min_of(o_orderkey, o_custkey), hi=max_of(o_orderkey, o_custkey)", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS flag, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS c, o_orderstatus = 'O' AS e, least(o_orderkey, o_custkey) AS lo, greatest(o_orderkey, o_custkey) AS hi FROM orders")
# Aggregation.
_add("summarize_basic", "lineitem | where l_shipdate <= datetime(1998-09-02) | summarize sum_qty=sum(l_quantity), sum_price=round(sum(l_extendedprice), 2), avg_disc=round(avg(l_discount), 6), lo=min(l_shipdate), hi=max(l_shipdate), n=count() by l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS lo, max(l_shipdate) AS hi, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
_add("summarize_if", "lineitem | summarize c=countif(l_quantity > 25), s=round(sumif(l_extendedprice, l_returnflag == 'R'), 2), a=round(avgif(l_discount, l_linestatus == 'F'), 6), lo=minif(l_quantity, l_tax > 0.02), hi=maxif(l_quantity, l_tax < 0.05), d=dcountif(l_suppkey, l_quantity > 30) by l_linenumber", "SELECT l_linenumber, count(*) FILTER (l_quantity > 25) AS c, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS s, round(avg(l_discount) FILTER (l_linestatus = 'F'), 6) AS a, min(l_quantity) FILTER (l_tax > 0.02) AS lo, max(l_quantity) FILTER (l_tax < 0.05) AS hi, count(DISTINCT l_suppkey) FILTER (l_quantity > 30) AS d FROM lineitem GROUP BY 1")
_add("summarize_empty", "lineitem | where l_quantity > 1000 | summarize n=count(), s=sum(l_orderkey), a=isnan(avg(l_quantity)), l=array_length(make_list(l_orderkey)), m=min(l_orderkey)", "SELECT count(*) AS n, CAST(coalesce(sum(l_orderkey), 0) AS BIGINT) AS s, true AS a, CAST(0 AS BIGINT) AS l, min(l_orderkey) AS m FROM lineitem WHERE l_quantity > 1000")
_add("stats", "lineitem | summarize sd=round(stdev(l_quantity), 4), v=round(variance(l_quantity), 4), sp=round(stdevp(l_quantity), 4), vp=round(variancep(l_quantity), 4), c=round(covariance(l_quantity, l_discount), 4), cp=round(covariancep(l_quantity, l_discount), 4) by l_linenumber", "SELECT l_linenumber, round(coalesce(stddev_samp(l_quantity), 0), 4) AS sd, round(coalesce(var_samp(l_quantity), 0), 4) AS v, round(stddev_pop(l_quantity), 4) AS sp, round(var_pop(l_quantity), 4) AS vp, round(covar_samp(l_quantity, l_discount), 4) AS c, round(covar_pop(l_quantity, l_discount), 4) AS cp FROM lineitem GROUP BY 1")
_add("percentiles", "lineitem | summarize p50=percentile(l_quantity, 50), p90=percentile(l_quantity, 90), percentiles(l_partkey, 5, 95) by l_returnflag", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.9) AS p90, quantile_disc(l_partkey, 0.05) AS percentiles_5_l_partkey, quantile_disc(l_partkey, 0.95) AS percentiles_95_l_partkey FROM lineitem GROUP BY 1")
_add("dcount", "events | summarize users=dcount(user_id), kinds=count_distinct(event_type) by day=startofday(ts)", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
_add("arg_max_cols", "events | summarize arg_max(event_id, event_type, value), arg_min(ts, event_id) by user_id", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(ts) AS ts, arg_min(event_id, ts) AS event_id1 FROM events GROUP BY 1")
_add("arg_max_star", "orders | summarize arg_max(o_orderkey, *) by o_custkey", "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
_add("make_list_set", "events | summarize s=strcat_array(make_set(event_type), ','), l=strcat_array(array_sort_asc(make_list(event_id)), ','), n=array_length(make_list_if(event_id, value > 50.0)) by user_id", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS s, array_to_string(list_sort(list(event_id)), ',') AS l, CAST(count(*) FILTER (value > 50) AS BIGINT) AS n FROM events GROUP BY 1")
_add("bit_aggs", "lineitem | summarize a=binary_all_and(l_partkey), o=binary_all_or(l_partkey), x=binary_all_xor(l_partkey) by l_linenumber", "SELECT l_linenumber, bit_and(l_partkey) AS a, bit_or(l_partkey) AS o, bit_xor(l_partkey) AS x FROM lineitem GROUP BY 1")
_add("agg_arithmetic", "lineitem | summarize r=round(sum(l_extendedprice*l_discount)/count(), 6), share=round(100.0*countif(l_returnflag == 'R')/count(), 6) by l_linestatus", "SELECT l_linestatus, round(sum(l_extendedprice*l_discount)/count(*), 6) AS r, round(100.0*count(*) FILTER (l_returnflag = 'R')/count(*), 6) AS share FROM lineitem GROUP BY 1")
_add("auto_names", "lineitem | summarize count(), sum(l_quantity), max(l_tax), dcount(l_suppkey) by bin(l_partkey, 50)", "SELECT (l_partkey // 50) * 50 AS l_partkey, count(*) AS count_, sum(l_quantity) AS sum_l_quantity, max(l_tax) AS max_l_tax, count(DISTINCT l_suppkey) AS dcount_l_suppkey FROM lineitem GROUP BY 1")
# Joins and unions.
_J = "orders | where o_totalprice > 100000 | project o_orderkey, o_custkey"
_C = "(customer | where c_acctbal > 3000 | project c_custkey, c_name)"
_JS, _CS = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000) o", "(SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 3000) c"
_add("join_inner", f"{_J} | join kind=inner {_C} on $left.o_custkey == $right.c_custkey", f"SELECT * FROM {_JS} JOIN {_CS} ON o_custkey = c_custkey")
_add("join_left", f"{_J} | join kind=leftouter {_C} on $left.o_custkey == $right.c_custkey", f"SELECT o_orderkey, o_custkey, c_custkey, coalesce(c_name, '') AS c_name FROM {_JS} LEFT JOIN {_CS} ON o_custkey = c_custkey")
_add("join_right", f"{_J} | join kind=rightouter {_C} on $left.o_custkey == $right.c_custkey", f"SELECT o_orderkey, o_custkey, c_custkey, c_name FROM {_JS} RIGHT JOIN {_CS} ON o_custkey = c_custkey")
_add("join_full", f"{_J} | join kind=fullouter {_C} on $left.o_custkey == $right.c_custkey", f"SELECT o_orderkey, o_custkey, c_custkey, coalesce(c_name, '') AS c_name FROM {_JS} FULL JOIN {_CS} ON o_custkey = c_custkey")
_add("join_semi", f"{_J} | join kind=leftsemi {_C} on $left.o_custkey == $right.c_custkey", f"SELECT * FROM {_JS} SEMI JOIN {_CS} ON o_custkey = c_custkey")
_add("join_anti", f"{_J} | join kind=leftanti {_C} on $left.o_custkey == $right.c_custkey", f"SELECT * FROM {_JS} ANTI JOIN {_CS} ON o_custkey = c_custkey")
_add("join_rightsemi", f"{_J} | join kind=rightsemi {_C} on $left.o_custkey == $right.c_custkey", f"SELECT * FROM {_CS} SEMI JOIN {_JS} ON o_custkey = c_custkey")
_add("join_rightanti", f"{_J} | join kind=rightanti {_C} on $left.o_custkey == $right.c_custkey", f"SELECT * FROM {_CS} ANTI JOIN {_JS} ON o_custkey = c_custkey")
_add("join_innerunique", "orders | summarize n=count() by o_custkey | join (customer | project c_custkey, c_nationkey) on $left.o_custkey == $right.c_custkey", "SELECT o_custkey, n, c_custkey, c_nationkey FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey")
_add("join_collision", "customer | join kind=inner (supplier | project c_nationkey=s_nationkey, c_name=s_name) on c_nationkey | project c_custkey, c_name, c_nationkey, c_nationkey1, c_name1", "SELECT c_custkey, c_name, c_nationkey, s_nationkey AS c_nationkey1, s_name AS c_name1 FROM customer JOIN supplier ON c_nationkey = s_nationkey")
_add("join_theta", "nation | join kind=inner region on $left.n_regionkey == $right.r_regionkey, $left.n_nationkey > $right.r_regionkey | project n_name, r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND n_nationkey > r_regionkey")
_add("lookup", "lineitem | lookup (part | project p_partkey, p_brand, p_size) on $left.l_partkey == $right.p_partkey | summarize n=count(), q=sum(l_quantity) by p_brand, p_size", "SELECT p_brand, p_size, count(*) AS n, sum(l_quantity) AS q FROM (SELECT l.*, coalesce(p_brand, '') AS p_brand, p_size FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey) GROUP BY ALL")
_add("union_by_name", "union withsource=src (customer | project key=c_custkey, name=c_name, seg=c_mktsegment), (supplier | project key=s_suppkey, name=s_name, bal=s_acctbal)", "SELECT 'union_arg0' AS src, c_custkey AS key, c_name AS name, c_mktsegment AS seg, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT 'union_arg1', s_suppkey, s_name, '', s_acctbal FROM supplier")
_add("tpch_q3", "customer | where c_mktsegment == 'BUILDING' | join kind=inner (orders | where o_orderdate < datetime(1997-03-15)) on $left.c_custkey == $right.o_custkey | join kind=inner (lineitem | where l_shipdate > datetime(1995-03-15)) on $left.o_orderkey == $right.l_orderkey | summarize revenue=round(sum(l_extendedprice*(1-l_discount)), 2) by l_orderkey, o_orderdate | top 10 by revenue desc, l_orderkey asc", "SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice*(1-l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY ALL ORDER BY revenue DESC, l_orderkey LIMIT 10")
_add("tpch_q5", "customer | join kind=inner orders on $left.c_custkey == $right.o_custkey | join kind=inner lineitem on $left.o_orderkey == $right.l_orderkey | join kind=inner supplier on $left.l_suppkey == $right.s_suppkey, $left.c_nationkey == $right.s_nationkey | lookup nation on $left.s_nationkey == $right.n_nationkey | lookup region on $left.n_regionkey == $right.r_regionkey | summarize revenue=round(sum(l_extendedprice*(1-l_discount)), 2) by r_name, n_name", "SELECT r_name, n_name, round(sum(l_extendedprice*(1-l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
# Order and top.
_add("sort_top", "orders | top 20 by o_totalprice desc, o_orderkey asc | project o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_add("sort_take", "orders | sort by o_orderdate asc, o_orderkey desc | take 50 | project o_orderkey, o_orderdate", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey DESC LIMIT 50")
_add("top_nested", "lineitem | top-nested 2 of l_returnflag by sum(l_quantity), top-nested 3 of l_suppkey by n=count()", "WITH a AS (SELECT l_returnflag, sum(l_quantity) AS aggregated_l_returnflag FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2), b AS (SELECT * FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) <= 3) SELECT a.l_returnflag, aggregated_l_returnflag, l_suppkey, n FROM a JOIN b USING (l_returnflag)")
_add("top_hitters", "lineitem | top-hitters 5 of l_suppkey by l_linenumber", "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS approximate_sum_l_linenumber FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
_add("distinct_count", "orders | distinct o_custkey, o_orderstatus | count", "SELECT count(*) AS Count FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
_add("partition_top", "events | partition by user_id (top 2 by value desc, event_id asc | extend rn=row_number()) | project user_id, event_id, value, rn", "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events QUALIFY rn <= 2")
# Serialized windows and scan.
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_add("window_serialized", "events | partition by user_id (sort by ts asc, event_id asc | extend rn=row_number(), p=prev(value), n=next(event_type, 1, 'none'), c=row_cumsum(event_id)) | project event_id, rn, p, n, c", f"SELECT event_id, row_number() {_W} AS rn, lag(value) {_W} AS p, coalesce(lead(event_type) {_W}, 'none') AS n, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM events")
_add("window_restart", "events | sort by user_id asc, ts asc, event_id asc | extend rn=row_number(1, user_id != prev(user_id)), c=row_cumsum(event_id, user_id != prev(user_id)), dense=row_rank_dense(user_id), lowest=row_rank_min(user_id) | project event_id, rn, c, dense, lowest", f"SELECT event_id, row_number() {_W} AS rn, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c, dense_rank() OVER (ORDER BY user_id) AS dense, rank() OVER (ORDER BY user_id) AS lowest FROM events")
_add("session", "events | partition by user_id (sort by ts asc, event_id asc | extend s=row_window_session(ts, 6h)) | summarize n=count() by user_id, s", "SELECT user_id, s, count(*) AS n FROM (SELECT user_id, CAST(sum(late) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS late FROM events)) GROUP BY ALL")
_add("window_filter", "events | partition by user_id (sort by ts asc, event_id asc | where event_type != prev(event_type)) | project event_id", f"SELECT event_id FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) {_W}")
_add("scan_cumsum", "events | scan order by ts asc, event_id asc partition by user_id declare (c:long=0) with (step s: true => c = s.c + event_id;) | project event_id, c", "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM events")
_add("scan_max", "events | scan order by ts asc, event_id asc partition by user_id declare (m:real=0.0) with (step s: true => m = max_of(s.m, value);) | project event_id, m", "SELECT event_id, greatest(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0.0) AS m FROM events")
_add("scan_ffill", "events | extend v=iff(value > 60.0, value, real(null)) | scan order by ts asc, event_id asc partition by user_id declare (f:real=-1.0) with (step s: true => f = iff(isnull(v), s.f, v);) | project event_id, f", "SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1.0) AS f FROM (SELECT *, CASE WHEN value > 60 THEN value END AS v FROM events)")
# A recurrence: SQL would need one recursion step per row.
_add("scan_ema", "events | scan order by ts asc, event_id asc partition by user_id declare (ema:real=0.0) with (step s: true => ema = s.ema*0.5 + value*0.5;) | project event_id, ema=round(ema, 6)", None)
# Reshaping and dynamic values.
_add("json_navigation", "events | extend d=parse_json(props) | project event_id, k=tolong(d.k), s=tostring(d['k']), missing=isnull(d.zz), keys=strcat_array(bag_keys(d), ','), has=bag_has_key(d, 'k'), packed=tostring(bag_pack('id', event_id, 't', event_type))", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.k' AS s, true AS missing, array_to_string(json_keys(props), ',') AS keys, true AS has, '{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS packed FROM events")
_add("mv_expand", "conversations | extend w=split(text, ' ') | mv-expand with_itemindex=i w to typeof(string) | project conv_id, turn, i, w", "SELECT conv_id, turn, i, w FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS BIGINT) AS i FROM conversations)")
_add("mv_apply", "embeddings | mv-apply e=embedding on (summarize s=round(sum(todouble(e)*todouble(e)), 3), m=count()) | project vec_id, s, m", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE)*CAST(e AS DOUBLE))), 3) AS s, CAST(len(embedding) AS BIGINT) AS m FROM embeddings")
_add("pivot", "events | evaluate pivot(event_type, count(), user_id) : (user_id:long, click:long, error:long, purchase:long, signup:long, view:long)", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
_add("pivot_discovered", "orders | evaluate pivot(o_orderstatus, sum(o_orderkey), o_orderpriority)", "SELECT o_orderpriority, " + ", ".join(f"CAST(coalesce(sum(o_orderkey) FILTER (o_orderstatus = '{k}'), 0) AS BIGINT) AS {k}" for k in ("F", "O", "P")) + " FROM orders GROUP BY 1")
_add("narrow", "nation | project n_nationkey, n_name | evaluate narrow()", "SELECT 'n_nationkey' AS Column, CAST(n_nationkey AS VARCHAR) AS Value FROM nation UNION ALL SELECT 'n_name', n_name FROM nation")
_add("bag_unpack", "events | project event_id, d=parse_json(props) | evaluate bag_unpack(d, 'p_')", "SELECT event_id, props->>'$.k' AS p_k FROM events")
_add("make_series", "events | make-series n=count(), total=sum(value) default=0.0 on ts from datetime(2024-01-01) to datetime(2024-02-01) step 1d by event_type | project event_type, n=strcat_array(n, ','), len=array_length(ts), total=round(array_sum(total), 4)", "WITH g AS (SELECT event_type, CAST(unnest(range(0, 31)) AS BIGINT) AS d FROM (SELECT DISTINCT event_type FROM events)), c AS (SELECT event_type, date_diff('day', TIMESTAMP '2024-01-01', ts) AS d, count(*) AS n, sum(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY ALL) SELECT g.event_type, string_agg(coalesce(n, 0), ',' ORDER BY g.d) AS n, count(*) AS len, round(sum(coalesce(v, 0)), 4) AS total FROM g LEFT JOIN c ON g.event_type = c.event_type AND g.d = c.d GROUP BY 1")
_add("series_functions", "events | make-series n=count() on ts from datetime(2024-01-01) to datetime(2024-01-31) step 1d by event_type | extend st=parse_json(series_stats(n)) | project event_type, f=strcat_array(series_fir(n, dynamic([1,1,1]), false), ','), a=strcat_array(series_add(n, n), ','), mx=toreal(st.max), total=toreal(st.sum), big=strcat_array(series_greater(n, 8), ',')", "WITH g AS (SELECT event_type, CAST(unnest(range(0, 30)) AS BIGINT) AS d FROM (SELECT DISTINCT event_type FROM events)), c AS (SELECT event_type, date_diff('day', TIMESTAMP '2024-01-01', ts) AS d, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL), s AS (SELECT g.event_type, g.d, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM g LEFT JOIN c ON g.event_type = c.event_type AND g.d = c.d), w AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY d ROWS 2 PRECEDING) AS f FROM s) SELECT event_type, string_agg(f, ',' ORDER BY d) AS f, string_agg(n + n, ',' ORDER BY d) AS a, max(n) AS mx, sum(n) AS total, string_agg(CASE WHEN n > 8 THEN 'true' ELSE 'false' END, ',' ORDER BY d) AS big FROM w GROUP BY 1")
_add("array_functions", "customer | extend a=split(tostring(c_custkey + 1000), '') | extend w=split(c_name, '0') | project c_custkey, n=array_length(w), last=tostring(w[-1]), i=array_index_of(w, 'Customer#'), j=strcat_array(array_reverse(w), '|'), s=strcat_array(array_slice(w, 0, 1), '|')", "SELECT c_custkey, CAST(len(w) AS BIGINT) AS n, w[-1] AS last, CAST(coalesce(list_position(w, 'Customer#'), 0) - 1 AS BIGINT) AS i, array_to_string(list_reverse(w), '|') AS j, array_to_string(w[1:2], '|') AS s FROM (SELECT c_custkey, string_split(c_name, '0') AS w FROM customer)")
_add("set_functions", "orders | summarize a=make_set(o_orderstatus), b=make_set_if(o_orderstatus, o_totalprice > 200000) by o_custkey | project o_custkey, u=strcat_array(array_sort_asc(set_union(a, b)), ','), i=strcat_array(array_sort_asc(set_intersect(a, b)), ','), d=strcat_array(array_sort_asc(set_difference(a, b)), ','), h=set_has_element(a, 'F'), jac=round(jaccard_index(a, b), 6)", "SELECT o_custkey, array_to_string(a, ',') AS u, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS d, list_contains(a, 'F') AS h, round(len(list_intersect(a, b)) / len(a), 6) AS jac FROM (SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS a, coalesce(list_sort(list_distinct(list(o_orderstatus) FILTER (o_totalprice > 200000))), []) AS b FROM orders GROUP BY 1)")
# Parsing, search, digests.
_add("parse_url_text", "pages | parse url with scheme '://' host '/' lang '/' rest | project page_id, scheme, host, lang, rest", r"SELECT page_id, regexp_extract(url, '(.*?)://(.*?)/(.*?)/(.*)', 1) AS scheme, regexp_extract(url, '(.*?)://(.*?)/(.*?)/(.*)', 2) AS host, regexp_extract(url, '(.*?)://(.*?)/(.*?)/(.*)', 3) AS lang, regexp_extract(url, '(.*?)://(.*?)/(.*?)/(.*)', 4) AS rest FROM pages")
_add("parse_where", "pages | parse-where url with * '/' lang '/' id:long '?' * | project page_id, id", r"SELECT page_id, CAST(regexp_extract(url, '.*?/(.*?)/(-?\d+)\?.*?', 2) AS BIGINT) AS id FROM pages WHERE regexp_extract(url, '.*?/(.*?)/(-?\d+)\?.*?', 2) <> '' AND regexp_extract(url, '.*?/(.*?)/(-?\d+)\?.*?', 1) <> ''")
_add("parse_kv", "customer | extend line=strcat('id=', c_custkey, '; seg = ', c_mktsegment, ' ;bal=', c_acctbal) | parse-kv line as (id:long, seg:string, none:string) with (pair_delimiter=';', kv_delimiter='=') | project id, seg, none", "SELECT c_custkey AS id, c_mktsegment AS seg, '' AS none FROM customer")
_add("search_terms", "conversations | search 'from' and not('zzz') | project conv_id, turn", f"SELECT conv_id, turn FROM conversations WHERE (regexp_matches(lower(text), '{_B}from{_A}') OR regexp_matches(lower(role), '{_B}from{_A}'))")
_add("hash_digest", "documents | project doc_id, m=hash_md5(text), s=hash_sha1(text), h=hash_sha256(text), b=base64_encode_tostring(source)", "SELECT doc_id, md5(text) AS m, sha1(text) AS s, sha256(text) AS h, base64(encode(source)) AS b FROM documents")
_add("url_ipv4", "pages | extend u=parse_json(parse_url(url)) | project page_id, sch=tostring(u.Scheme), host=tostring(u.Host), q=tostring(parse_json(parse_urlquery(url)).Query), ip=parse_ipv4(strcat('10.', page_id % 256, '.3.4')), private=ipv4_is_private(strcat('10.', page_id % 256, '.3.4')), inside=ipv4_is_in_range(strcat('10.', page_id % 256, '.3.4'), '10.64.0.0/10'), f=format_ipv4(page_id * 70001)", r"SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS sch, regexp_extract(url, '://([^/?#:]+)', 1) AS host, regexp_extract(url, '\?(.+)', 1) AS q, 167772160 + (page_id % 256) * 65536 + 772 AS ip, true AS private, (page_id % 256) BETWEEN 64 AND 127 AS inside, concat_ws('.', CAST((page_id*70001) // 16777216 % 256 AS VARCHAR), CAST((page_id*70001) // 65536 % 256 AS VARCHAR), CAST((page_id*70001) // 256 % 256 AS VARCHAR), CAST((page_id*70001) % 256 AS VARCHAR)) AS f FROM pages")
# More functions, one query for each family.
_add("string_functions_2", "customer | project c_custkey, a=url_encode(strcat(c_name, ' &x')), b=url_decode('a%20b'), c=base64_encode_tostring(c_name), d=base64_decode_tostring(base64_encode_tostring(c_name)), e=replace_regex(c_name, '0+', '_'), f=strcat_array(extract_all('([0-9])[0-9]', c_name), ','), g=tohex(c_custkey), h=unicode(c_name), i=make_string(65 + c_nationkey), j=parse_path('/a/b/c.txt'), k=strcat_array(parse_csv('x,y,z'), '|'), l=strcat_array(parse_version('1.2.3'), '-'), m=trim_start('C', c_name), n=trim_end('[0-9]', c_name), o=has_any_index(c_name, dynamic(['zzz','customer'])), p=replace_strings(c_mktsegment, dynamic(['A','E']), dynamic(['4','3']))", "SELECT c_custkey, replace(c_name, '#', '%23') || '%20%26x' AS a, 'a b' AS b, base64(encode(c_name)) AS c, c_name AS d, regexp_replace(c_name, '0+', '_', 'g') AS e, array_to_string(regexp_extract_all(c_name, '([0-9])[0-9]', 1), ',') AS f, lower(to_hex(c_custkey)) AS g, CAST(unicode(c_name) AS BIGINT) AS h, chr(CAST(65 + c_nationkey AS INTEGER)) AS i, 'c.txt' AS j, 'x|y|z' AS k, '1-2-3' AS l, substr(c_name, 2) AS m, left(c_name, length(c_name) - 1) AS n, CAST(1 AS BIGINT) AS o, replace(replace(c_mktsegment, 'A', '4'), 'E', '3') AS p FROM customer")
_add("math_functions_2", "events | extend x=value/100.0 | project event_id, a=round(cos(x), 6), b=round(tan(x), 6), c=round(atan(x), 6), d=round(atan2(x, 2.0), 6), e=round(exp2(x), 6), f=round(exp10(x), 5), g=round(log2(x+1.0), 6), h=round(log10(x+1.0), 6), i=round(degrees(x), 6), j=round(radians(x), 6), k=binary_or(event_id, 9), l=binary_not(event_id), m=binary_shift_right(event_id, 1), n=round(pi(), 6), o=isnan(log(0.0-1.0)), p=isinf(log(0.0)), q=isfinite(x), r=round(gamma(5.0), 6), s=round(loggamma(5.0), 6)", "SELECT event_id, round(cos(x), 6) AS a, round(tan(x), 6) AS b, round(atan(x), 6) AS c, round(atan2(x, 2.0), 6) AS d, round(pow(2, x), 6) AS e, round(pow(10, x), 5) AS f, round(log2(x+1.0), 6) AS g, round(log10(x+1.0), 6) AS h, round(degrees(x), 6) AS i, round(radians(x), 6) AS j, event_id | 9 AS k, ~event_id AS l, event_id >> 1 AS m, round(pi(), 6) AS n, true AS o, true AS p, true AS q, CAST(24.0 AS DOUBLE) AS r, round(lgamma(5.0::DOUBLE), 6) AS s FROM (SELECT event_id, value/100.0 AS x FROM events)")
_add("time_functions_2", "events | project event_id, a=unixtime_seconds_todatetime(event_id * 1000), b=unixtime_milliseconds_todatetime(event_id * 1000), c=make_datetime(2024, 2, 1 + event_id % 28, 3, 4, 5.5), d=tolong(make_timespan(1, 30) / 1s), e=tolong(totimespan('1.02:03:04') / 1s), f=datetime_utc_to_local(ts, 'Asia/Tokyo'), g=datetime_local_to_utc(ts, 'Asia/Tokyo'), h=bin_at(ts, 1d, datetime(2024-01-01 12:00)), i=todatetime(format_datetime(ts, 'yyyy-MM-dd HH:mm')), j=tolong(ts), k=datetime_diff('tick', ts, datetime(2024-01-01))", "SELECT event_id, make_timestamp(event_id * 1000000000) AS a, make_timestamp(event_id * 1000000) AS b, make_timestamp(2024, 2, 1 + event_id % 28, 3, 4, 5.5) AS c, CAST(5400 AS BIGINT) AS d, CAST(93784 AS BIGINT) AS e, ts + INTERVAL 9 HOUR AS f, ts - INTERVAL 9 HOUR AS g, make_timestamp(CAST(epoch_us(TIMESTAMP '2024-01-01 12:00:00') + floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 12:00:00')) / 86400000000.0) * 86400000000 AS BIGINT)) AS h, date_trunc('minute', ts)::TIMESTAMP AS i, (epoch_us(ts) + 62135596800000000) * 10 AS j, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 10 AS k FROM events")
_add("array_functions_2", "orders | summarize a=array_sort_asc(make_list(o_orderkey)) by o_custkey | project o_custkey, s=strcat_array(array_sort_desc(a), ','), c=strcat_array(array_concat(a, dynamic([0])), ','), r=strcat_array(array_rotate_left(a, 1), ','), q=strcat_array(array_shift_right(a, 1, -1), ','), t=array_sum(a), u=round(array_avg(a), 4), z=array_length(zip(a, a)), p=array_length(array_split(a, 2)), i=strcat_array(array_iff(dynamic([true,false]), a, -5), ','), h=array_length(range(1, 10, 3))", "SELECT o_custkey, array_to_string(list_reverse(a), ',') AS s, array_to_string(list_append(a, 0), ',') AS c, array_to_string(list_concat(a[2:], a[1:1]), ',') AS r, array_to_string(list_prepend(-1, a[1:len(a)-1]), ',') AS q, CAST(list_sum(a) AS DOUBLE) AS t, round(list_avg(a), 4) AS u, CAST(len(a) AS BIGINT) AS z, CAST(2 AS BIGINT) AS p, concat(a[1], ',-5') AS i, CAST(4 AS BIGINT) AS h FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS a FROM orders GROUP BY 1)")
_add("bag_functions", "events | extend d=parse_json(props) | project event_id, m=bag_merge(d, dynamic({'k':0,'z':1})), r=bag_remove_keys(bag_set_key(d, 'x', 5), dynamic(['k'])), x=tolong(extract_json('$.k', props)), g=gettype(d), j=dynamic_to_json(d), u=tostring(parse_json(strcat('{\"a\":[', event_id, ']}')).a[0])", "SELECT event_id, '{\"k\":' || (props->>'$.k') || ',\"z\":1}' AS m, '{\"x\":5}' AS r, CAST(props->>'$.k' AS BIGINT) AS x, 'dictionary' AS g, '{\"k\":' || (props->>'$.k') || '}' AS j, CAST(event_id AS VARCHAR) AS u FROM events")
_add("series_fill", "events | make-series v=max(value) default=real(null) on ts from datetime(2024-01-01) to datetime(2024-01-31) step 12h by event_type | project event_type, f=round(array_sum(series_fill_const(v, 7.0)), 4), n=array_length(series_fill_forward(v)), gaps=array_sum(series_equals(series_fill_const(v, -1.0), -1.0))", None)
_add("parse_regex", "pages | parse kind=regex url with '^https?://' host:string '/' lang:string '/' id:long * | project page_id, lang, id", r"SELECT page_id, regexp_extract(url, '^https?://(.*)/(.*)/(-?\d+).*?', 2) AS lang, try_cast(regexp_extract(url, '^https?://(.*)/(.*)/(-?\d+).*?', 3) AS BIGINT) AS id FROM pages")
_add("search_wildcards", "conversations | search kind=case_sensitive text:'Th*' | project conv_id, turn", r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(^|[^\p{L}\p{N}])Th')")
_add("star_predicates", "nation | where * contains 'nation_1' | project n_nationkey", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'nation_1')")
_add("percentiles_array", "lineitem | summarize a=strcat_array(percentiles_array(l_partkey, 10, 50, 90), ','), m=minif(l_partkey, l_quantity > 10), v=round(varianceif(l_quantity, l_tax > 0.01), 4), s=round(stdevif(l_quantity, l_tax > 0.01), 4), t=take_anyif(l_returnflag, l_returnflag == 'R') by l_linenumber", "SELECT l_linenumber, concat_ws(',', quantile_disc(l_partkey, 0.1), quantile_disc(l_partkey, 0.5), quantile_disc(l_partkey, 0.9)) AS a, min(l_partkey) FILTER (l_quantity > 10) AS m, round(var_samp(l_quantity) FILTER (l_tax > 0.01), 4) AS v, round(stddev_samp(l_quantity) FILTER (l_tax > 0.01), 4) AS s, any_value(l_returnflag) FILTER (l_returnflag = 'R') AS t FROM lineitem GROUP BY 1")
_add("serialize_consume", "orders | sort by o_orderkey asc | serialize n=row_number(), gap=o_orderkey - prev(o_orderkey, 1, 0) | consume", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n, o_orderkey - coalesce(lag(o_orderkey) OVER (ORDER BY o_orderkey), 0) AS gap FROM orders)")
# Bindings.
_add("let_function", "let low = 1000.0; let big = (x:real, y:real=2.0) { x > low * y }; let rich = view() { customer | where big(c_acctbal) }; rich | where not(big(c_acctbal, 5.0)) | project c_custkey, c_acctbal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 2000 AND NOT c_acctbal > 5000")
_add("toscalar", "let top_bal = toscalar(customer | summarize max(c_acctbal)); let m = materialize(customer | where c_acctbal > top_bal * 0.9); m | project c_custkey, gap=round(top_bal - c_acctbal, 4)", "SELECT c_custkey, round((SELECT max(c_acctbal) FROM customer) - c_acctbal, 4) AS gap FROM customer WHERE c_acctbal > (SELECT max(c_acctbal) FROM customer) * 0.9")
_add("invoke_as", "let keep = (T:(*), least:long) { T | where n >= least }; orders | summarize n=count() by o_custkey | as Counts | invoke keep(5) | join kind=inner Counts on o_custkey | project o_custkey, n, n1", "SELECT o_custkey, count(*) AS n, count(*) AS n1 FROM orders GROUP BY 1 HAVING count(*) >= 5")
_add("range_print", "range x from 1 to 100 step 7 | extend t=datetime(2024-01-01) + x * 1d | union (print x=0, t=datetime(2000-01-01)) | project x, t", "SELECT x, TIMESTAMP '2024-01-01' + INTERVAL (x) DAY AS t FROM (SELECT CAST(unnest(range(1, 101, 7)) AS BIGINT) AS x) UNION ALL SELECT 0, TIMESTAMP '2000-01-01'")
_add("getschema", "lineitem | getschema", None)
_add("sample", "orders | sample 10 | count", "SELECT CAST(10 AS BIGINT) AS Count")
_add("sample_distinct", "orders | sample-distinct 3 of o_orderpriority | count", "SELECT CAST(3 AS BIGINT) AS Count")
_add("render", "events | summarize n=count() by bin(ts, 1d) | render timechart with (title='per day')", f"SELECT {_bin_us('ts', 86400000000)} AS ts, count(*) AS n FROM events GROUP BY 1")


for _name, (_query, _sql) in catalog_more.QUERIES.items():
    _add(_name, _query, _sql)


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir).query(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(text) for name, (text, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
