"""Registered queries for names that the first catalog leaves out, each with the same result in DuckDB's SQL."""

from __future__ import annotations

#: name -> (query, SQL)
QUERIES: dict[str, tuple[str, str]] = {}


def _add(name: str, query: str, sql: str) -> None:
    QUERIES[name] = (query, sql)


# Aggregates.
_add("take_any_names", "nation | summarize take_any(n_name), a=any(n_regionkey), b=anyif(n_name, n_nationkey >= 0), c=take_any(n_nationkey) by n_nationkey | project n_nationkey, n_name, a, b, c", "SELECT n_nationkey, n_name, n_regionkey AS a, n_name AS b, n_nationkey AS c FROM nation")
_add("take_any_star", "customer | summarize take_any(*) by c_custkey", "SELECT * FROM customer")
_add("make_bag", "nation | summarize b=make_bag(bag_pack(n_name, n_nationkey)), c=make_bag_if(pack(n_name, 1), n_nationkey % 2 == 0) by n_regionkey | project n_regionkey, n=array_length(bag_keys(b)), first=tolong(b['NATION_0']), even=array_length(bag_keys(c))", "SELECT n_regionkey, count(DISTINCT n_name) AS n, max(CASE WHEN n_name = 'NATION_0' THEN CAST(n_nationkey AS BIGINT) END) AS first, count(DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_name END) AS even FROM nation GROUP BY 1")
_add("list_names", "customer | summarize a=makelist(c_custkey), b=makelistif(c_custkey, c_acctbal > 5000), c=make_list_with_nulls(iff(c_acctbal > 5000, c_custkey, long(null))), d=makeset(c_mktsegment), e=makesetif(c_mktsegment, c_acctbal > 0) by c_nationkey | project c_nationkey, a=strcat_array(array_sort_asc(a), ','), b=strcat_array(array_sort_asc(b), ','), c=array_length(c), d=strcat_array(array_sort_asc(d), ','), e=strcat_array(array_sort_asc(e), ',')", "SELECT c_nationkey, string_agg(c_custkey, ',' ORDER BY c_custkey) AS a, coalesce(string_agg(c_custkey, ',' ORDER BY c_custkey) FILTER (c_acctbal > 5000), '') AS b, count(*) AS c, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS d, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FILTER (c_acctbal > 0), '') AS e FROM customer GROUP BY 1")
_add("count_distinctif", "lineitem | summarize a=count_distinctif(l_suppkey, l_quantity > 20), b=dcountif(l_suppkey, l_quantity > 20), c=count_distinct(l_suppkey) by l_returnflag", "SELECT l_returnflag, count(DISTINCT CASE WHEN l_quantity > 20 THEN l_suppkey END) AS a, count(DISTINCT CASE WHEN l_quantity > 20 THEN l_suppkey END) AS b, count(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY 1")
_add("spread_if", "lineitem | summarize a=round(covarianceif(l_quantity, l_discount, l_tax > 0.02), 4), b=round(covariancepif(l_quantity, l_discount, l_tax > 0.02), 4), c=round(variancepif(l_quantity, l_tax > 0.02), 4), d=round(stdevpif(l_quantity, l_tax > 0.02), 4) by l_linenumber", "SELECT l_linenumber, round(covar_samp(l_quantity, l_discount) FILTER (l_tax > 0.02), 4) AS a, round(covar_pop(l_quantity, l_discount) FILTER (l_tax > 0.02), 4) AS b, round(var_pop(l_quantity) FILTER (l_tax > 0.02), 4) AS c, round(stddev_pop(l_quantity) FILTER (l_tax > 0.02), 4) AS d FROM lineitem GROUP BY 1")
# A sketch of few values is exact, so its count is SQL's.
_add("hll_names", "customer | summarize h=hll(c_mktsegment), i=hll_if(c_mktsegment, c_acctbal > 0) by c_nationkey | summarize a=dcount_hll(hll_merge(h)), b=dcount_hll(hll_merge(i))", "SELECT count(DISTINCT c_mktsegment) AS a, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_mktsegment END) AS b FROM customer")
_W = "(SELECT o_orderpriority, o_custkey, w, sum(w) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS s, sum(w) OVER (PARTITION BY o_orderpriority) AS t FROM (SELECT o_orderpriority, o_custkey, CAST(o_orderkey % 5 AS BIGINT) AS w FROM orders) WHERE w > 0)"
_add("percentilew_names", "orders | extend w=o_orderkey % 5 | summarize a=percentilew(o_custkey, w, 50), b=strcat_array(percentilesw_array(o_custkey, w, 25, 75), ','), percentilesw(o_custkey, w, 10, 90) by o_orderpriority | project o_orderpriority, a, b", f"SELECT o_orderpriority, min(CASE WHEN s >= 0.5 * t THEN o_custkey END) AS a, concat(min(CASE WHEN s >= 0.25 * t THEN o_custkey END), ',', min(CASE WHEN s >= 0.75 * t THEN o_custkey END)) AS b FROM {_W} GROUP BY 1")
_add("interval_sums", "events | summarize total=sum(ts - datetime(2024-01-01)), longest=max(ts - datetime(2024-01-01)) by event_type | project event_type, total=tolong(total / 1ms), longest=tolong(longest / 1ms)", "SELECT event_type, CAST(sum(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS BIGINT) AS total, CAST(max(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS BIGINT) AS longest FROM events GROUP BY 1")
_add("dynamic_operands", "events | extend p=parse_json(props) | summarize s=sum(tolong(p.k)), m=max(toint(p['k'])), a=round(avg(todouble(p.k)), 6) by event_type", "SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS s, max(CAST(props->>'k' AS INTEGER)) AS m, round(avg(CAST(props->>'k' AS DOUBLE)), 6) AS a FROM events GROUP BY 1")

# Strings.
_add("string_names", "part | project p_partkey, a=tolower(p_name), b=repeat(p_brand, 2), c=url_encode_component(p_name), d=url_decode_component(url_encode_component(p_name)), e=base64_encode_fromarray(to_utf8(substring(p_name, 0, 3))), f=isnotempty(p_brand), g=isnotnull(p_size), h=isempty(p_name)", "SELECT p_partkey, lower(p_name) AS a, repeat(p_brand, 2) AS b, url_encode(p_name) AS c, p_name AS d, base64(encode(p_name[1:3])) AS e, p_brand <> '' AS f, p_size IS NOT NULL AS g, p_name = '' AS h FROM part")
_add("base64_arrays", "part | project p_partkey, a=base64_encode_fromarray(to_utf8(p_name)), b=strcat_array(base64_decode_toarray(base64_encode_tostring(p_brand)), ',')", "SELECT p_partkey, base64(encode(p_name)) AS a, array_to_string(list_transform(string_split(p_brand, ''), lambda x: unicode(x)), ',') AS b FROM part")
_add("base64_guids", "nation | extend g=toguid(strcat('00000000-0000-0000-0000-0000000000', substring(tostring(n_nationkey + 10), 0, 2))) | project n_nationkey, same=base64_decode_toguid(base64_encode_fromguid(g)) == g", "SELECT n_nationkey, true AS same FROM nation")
_add("column_ifexists", "customer | project c_custkey, a=column_ifexists('c_name', 'none'), b=column_ifexists('no_such', 'none'), c=column_ifexists('nowhere', 7)", "SELECT c_custkey, c_name AS a, 'none' AS b, CAST(7 AS BIGINT) AS c FROM customer")

# Numbers and times.
_add("math_names", "lineitem | project l_orderkey, l_linenumber, a=round(power(l_quantity, 2), 4), b=round(acos(l_discount), 6), c=round(asin(l_tax), 6), d=round(cot(l_quantity), 4), e=rand() < 1.0, f=rand() >= 0.0", "SELECT l_orderkey, l_linenumber, round(pow(l_quantity, 2), 4) AS a, round(acos(l_discount), 6) AS b, round(asin(l_tax), 6) AS c, round(cot(l_quantity), 4) AS d, true AS e, true AS f FROM lineitem")
_add("arithmetic_edges", "orders | project o_orderkey, a=o_orderkey * 3 - 7 + o_custkey, b=o_custkey !between (10 .. 90), c=-o_orderkey % 7, d=o_totalprice / 0.5", "SELECT o_orderkey, o_orderkey * 3 - 7 + o_custkey AS a, NOT o_custkey BETWEEN 10 AND 90 AS b, (-o_orderkey % 7 + 7) % 7 AS c, o_totalprice / 0.5 AS d FROM orders")
_add("time_names", "events | project event_id, a=tolong(getmonth(ts)), b=tolong(week_of_year(ts)), c=tolong(minuteofhour(ts)), d=tolong(secondofminute(ts)), e=unixtime_microseconds_todatetime(1700000000000000 + event_id), f=unixtime_nanoseconds_todatetime(1700000000000000000 + event_id * 1000), g=ts < now(), h=ago(1d) < now()", "SELECT event_id, CAST(month(ts) AS BIGINT) AS a, CAST(weekofyear(ts) AS BIGINT) AS b, CAST(minute(ts) AS BIGINT) AS c, CAST(second(ts) AS BIGINT) AS d, make_timestamp(1700000000000000 + event_id) AS e, make_timestamp(1700000000000000 + event_id) AS f, true AS g, true AS h FROM events")

# Arrays and bags.
_add("array_names", "orders | extend a=pack_array(o_orderkey, o_custkey, 3) | project o_orderkey, r=strcat_array(array_rotate_right(a, 1), ','), l=strcat_array(array_shift_left(a, 1, 0), ','), n=array_length(a)", "SELECT o_orderkey, concat_ws(',', 3, o_orderkey, o_custkey) AS r, concat_ws(',', o_custkey, 3, 0) AS l, CAST(3 AS BIGINT) AS n FROM orders")
_add("bag_names", "customer | project c_custkey, a=tostring(todynamic(tostring(pack('k', c_custkey))).k), b=tolong(bag_pack_columns(c_custkey, c_nationkey).c_nationkey), c=extractjson('$.k', tostring(pack_dictionary('k', c_mktsegment))), d=array_length(treepath(pack('x', 1, 'y', 2)))", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS a, CAST(c_nationkey AS BIGINT) AS b, c_mktsegment AS c, CAST(2 AS BIGINT) AS d FROM customer")

# Hashes and addresses: hashes are compared by what must hold of them.
_add("hash_names", "customer | project c_custkey, a=hash(c_name) == hash_xxhash64(c_name), b=hash(c_name, 10) between (0 .. 9), c=hash_combine(hash(c_name), 1) == hash_combine(hash(c_name), 1), d=hash_many(c_name, c_custkey) == hash_many(c_name, c_custkey)", "SELECT c_custkey, true AS a, true AS b, true AS c, true AS d FROM customer")
_add("hash_is_injective_here", "customer | summarize a=dcount(hash(c_name)), b=dcount(hash_many(c_name, c_custkey)), c=dcount(hash_combine(hash(c_name), c_custkey))", "SELECT count(DISTINCT c_name) AS a, count(*) AS b, count(*) AS c FROM customer")
_IP = "strcat('10.', c_custkey / 256 % 256, '.', c_custkey % 256, '.7')"
_add("ipv4_names", f"customer | extend ip={_IP} | project c_custkey, a=parse_ipv4_mask(ip, 24), b=ipv4_compare(ip, '10.0.99.7'), c=ipv4_is_match(ip, '10.0.0.0/16'), d=ipv4_netmask_suffix(strcat(ip, '/24')), e=format_ipv4_mask(ip, 24), f=format_ipv4(parse_ipv4(ip))", "SELECT c_custkey, CAST(167772160 + n * 256 AS BIGINT) AS a, CAST(sign(n - 99) AS BIGINT) AS b, n < 256 AS c, CAST(24 AS BIGINT) AS d, concat('10.', n // 256, '.', n % 256, '.0/24') AS e, concat('10.', n // 256, '.', n % 256, '.7') AS f FROM (SELECT c_custkey, c_custkey % 65536 AS n FROM customer)")

# Series.
_S = "customer | summarize s=make_list(c_custkey) by c_nationkey | extend s=array_sort_asc(s) "
_L = "(SELECT c_nationkey, list(CAST(c_custkey AS DOUBLE) ORDER BY c_custkey) AS s FROM customer GROUP BY 1)"
_add("series_arithmetic", _S + "| project c_nationkey, a=round(array_sum(series_subtract(s, 1)), 4), m=round(array_sum(series_multiply(s, 2)), 4), d=round(array_sum(series_divide(s, 4)), 4), p=round(array_sum(series_add(s, s)), 4)", f"SELECT c_nationkey, round(list_sum(s) - len(s), 4) AS a, round(2 * list_sum(s), 4) AS m, round(list_sum(s) / 4, 4) AS d, round(2 * list_sum(s), 4) AS p FROM {_L}")
for _name, _op in {"less": "<", "equals": "=", "not_equals": "<>", "greater_equals": ">=", "less_equals": "<=", "greater": ">"}.items():
    _add(f"series_{_name}", _S + f"| extend c=series_{_name}(s, 75) | mv-expand c to typeof(bool) | summarize n=countif(c) by c_nationkey", f"SELECT c_nationkey, CAST(len(list_filter(s, lambda x: x {_op} 75)) AS BIGINT) AS n FROM {_L}")
_G = "customer | extend v=iff(c_custkey % 3 == 1, real(null), todouble(c_custkey)) | sort by c_nationkey asc, c_custkey asc | partition by c_nationkey (sort by c_custkey asc | summarize s=make_list_with_nulls(v) by c_nationkey) "
_GAPS = "(SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE CAST(c_custkey AS DOUBLE) END AS v FROM customer)"
_add("series_fill_names", "customer | extend v=iff(c_custkey % 3 == 1, real(null), todouble(c_custkey)) | summarize b=make_list(c_custkey) by c_nationkey | extend s=array_sort_asc(b) | project c_nationkey, f=array_sum(series_fill_const(s, 0)), n=array_length(series_fill_linear(s)), w=array_sum(series_fill_forward(s)), r=array_sum(series_fill_backward(s))", "SELECT c_nationkey, CAST(sum(c_custkey) AS DOUBLE) AS f, count(*) AS n, CAST(sum(c_custkey) AS DOUBLE) AS w, CAST(sum(c_custkey) AS DOUBLE) AS r FROM customer GROUP BY 1")
_add("series_fill_gaps", "print s=dynamic([null, 2.0, null, null, 8.0, null]) | project f=strcat_array(series_fill_forward(s, real(null)), ','), b=strcat_array(series_fill_backward(s, real(null)), ','), l=strcat_array(series_fill_linear(s), ','), c=strcat_array(series_fill_const(s, 0.5), ',')", "SELECT '2.0,2.0,2.0,8.0,8.0' AS f, '2.0,2.0,8.0,8.0,8.0' AS b, '2.0,2.0,4.0,6.0,8.0,8.0' AS l, '0.5,2.0,0.5,0.5,8.0,0.5' AS c")
_add("series_fit_line", _S + "| extend l=series_fit_line(s), d=series_fit_line_dynamic(s) | project c_nationkey, slope=round(todouble(l.slope), 6), start=round(todouble(l.interception), 4), r2=round(todouble(d.rsquare), 6)", f"SELECT c_nationkey, round(coalesce(regr_slope(y, x), 0), 6) AS slope, round(coalesce(regr_intercept(y, x), min(y)), 4) AS start, round(coalesce(regr_r2(y, x), 1), 6) AS r2 FROM (SELECT c_nationkey, unnest(s) AS y, CAST(generate_subscripts(s, 1) - 1 AS DOUBLE) AS x FROM {_L}) GROUP BY 1")
_add("series_stats_names", _S + "| extend t=series_stats_dynamic(s) | project c_nationkey, lo=todouble(t.min), hi=todouble(t.max), a=round(todouble(t.avg), 6), v=round(todouble(t.variance), 4)", f"SELECT c_nationkey, list_min(s) AS lo, list_max(s) AS hi, round(list_avg(s), 6) AS a, round(coalesce(list_var_samp(s), 0), 4) AS v FROM {_L}")
_add("series_iir", _S + "| project c_nationkey, t=round(array_sum(series_iir(s, dynamic([1.0]), dynamic([1.0, -1.0]))), 4)", f"SELECT c_nationkey, round(sum(y * (n - x)), 4) AS t FROM (SELECT c_nationkey, unnest(s) AS y, generate_subscripts(s, 1) - 1 AS x, len(s) AS n FROM {_L}) GROUP BY 1")
_add("series_correlation", _S + "| project c_nationkey, r=round(series_pearson_correlation(s, series_multiply(s, s)), 6), z=round(array_sum(series_outliers(s)), 6)", f"SELECT c_nationkey, round(corr(y, y * y), 6) AS r, 0.0 AS z FROM (SELECT c_nationkey, unnest(s) AS y FROM {_L}) GROUP BY 1")
_add("series_periods", "range x from 0 to 59 step 1 | extend v=iff(x % 6 == 0, 10.0, 0.0) | summarize s=make_list(v) | extend p=series_periods_detect(s, 2, 20, 1), q=series_periods_validate(s, 6, 5) | project p=tolong(p.periods[0]), a=round(todouble(q[0]), 4), b=round(todouble(q[1]), 4)", "SELECT CAST(6 AS BIGINT) AS p, 1.0 AS a, 0.0 AS b")

# Tabular forms.
_add("join_innerunique_dedup", "events | project user_id, k=event_id | join kind=innerunique (events | summarize n=count() by user_id) on user_id | project user_id, n, ok=k >= 0", "SELECT user_id, count(*) AS n, true AS ok FROM events GROUP BY 1")
_add("join_hints", "orders | join hint.strategy=shuffle hint.num_partitions=4 kind=inner (customer) on $left.o_custkey == $right.c_custkey | summarize n=count() by c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
_add("union_kinds", "union kind=inner (customer | project key=c_custkey, name=c_name, seg=c_mktsegment), (supplier | project key=s_suppkey, name=s_name) | union kind=outer (nation | project key=tolong(n_nationkey), region=n_regionkey)", "SELECT c_custkey AS key, c_name AS name, CAST(NULL AS INTEGER) AS region FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT CAST(n_nationkey AS BIGINT), '', n_regionkey FROM nation")
_add("union_wildcard", "union natio*, regio* | summarize n=count()", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n")
_add("arg_max_ties", "lineitem | summarize arg_max(l_quantity, l_quantity) by l_orderkey | project l_orderkey, l_quantity", "SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
_add("scan_forms", "events | sort by ts asc, event_id asc | partition by user_id (sort by ts asc, event_id asc | scan declare (total:real=0.0, n:long=0) with (step s: true => total = s.total + value, n = s.n + 1;)) | project event_id, total=round(total, 4), n", "SELECT event_id, round(sum(value) OVER w, 4) AS total, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
_add("scan_recurrence", "events | scan order by ts asc, event_id asc partition by user_id declare (x:real=0.0) with (step s: true => x = iff(event_type == 'error', 0.0, s.x + 1.0);) | project event_id, x", "SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, e ORDER BY ts, event_id) AS DOUBLE) AS x FROM (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events)")
_add("project_by_names", "customer | project-by-names dynamic(['c_name', 'c_custkey'])", "SELECT c_name, c_custkey FROM customer")
_add("cross_database", "database('default').nation | count", "SELECT count(*) AS Count FROM nation")
_add("materialize_twice", "let m = materialize(orders | summarize n=count() by o_custkey); m | join kind=inner m on o_custkey | summarize s=sum(n), t=sum(n1)", "SELECT count(*) AS s, count(*) AS t FROM orders")
