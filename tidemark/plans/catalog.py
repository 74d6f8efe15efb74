"""Queries that exercise the cache, with the SQL that DuckDB gives the same rows for.

Each query runs cold on the rows before a cut with the clock at the cut, then warm on all rows, and returns the
warm result. A warm run that did not do as expected (a hit, or a refusal) raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import QueryCacheConfig, micros
from ..log import MemoryLog
from ..session import CachedSession, cached_agg, with_query_cache
from ..sources.cache import MemoryQueryCache, ParquetQueryCache
from ..sources.folders import own_folder

#: Table: (temporal column, cut).
GROWING = {"events": ("ts", "2024-01-20"), "lineitem": ("l_shipdate", "2000-01-01"), "orders": ("o_orderdate", "2000-01-01")}
STATIC = ("region", "nation", "customer", "supplier", "part")
LATER = "2030-01-01"


@dataclass(frozen=True)
class Query:
    sql: str
    table: str = "events"
    duck: str | None = None  # where DuckDB spells it otherwise
    hits: int = 1  # aggregates answered from state
    joins: bool = False
    cuts: tuple[str, ...] = ()
    now: str = LATER
    store: str = "memory"
    lateness: int = 0
    late: str = ""  # rows that come only with the warm run


_DAY = "cast(date_trunc('day', ts) as {ts})"
_HOUR = "cast(date_trunc('hour', ts) as {ts})"

CATALOG: dict[str, Query] = {
    # Shapes that the cache supports.
    "global_avg_count": Query("select round(avg(value), 2) as avg_value, count(*) as n from events where value > 1"),
    "max_static_bound": Query("select max(value) as max_value from events where event_type = 'click' and ts > timestamp '2024-01-05 00:00:00'"),
    "hourly_bucket": Query(f"select {_HOUR} as time_bucket, round(avg(value), 8) as avg_value, round(min(value), 2) as min_value, round(max(value), 2) as max_value from events where event_type = 'click' and ts > timestamp '2024-01-02 00:00:00' group by 1 order by time_bucket desc"),
    "daily_by_type": Query(f"select {_DAY} as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2"),
    "group_nontemporal": Query("select event_type, count(*) as n, min(value) as low, max(value) as high, min(ts) as first_ts from events group by event_type"),
    "static_upper_bound": Query("select event_type, count(*) as n from events where ts < timestamp '2024-01-25 00:00:00' group by event_type"),
    "between_bound": Query("select count(*) as n, max(value) as high from events where ts between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-27 00:00:00'"),
    "flipped_bound": Query("select count(*) as n from events where timestamp '2024-01-05 00:00:00' <= ts and 2 < value"),
    "in_case_like_filter": Query("select event_type, count(*) as n from events where event_type in ('click', 'view', 'error') and event_type like '%i%' and case when value > 5 then true else user_id % 2 = 0 end group by event_type"),
    "or_filter": Query("select count(*) as n from events where value > 100 or event_type <> 'click'"),
    "having_order_limit": Query("select user_id, count(*) as n, max(value) as high from events group by user_id having sum(value) > 3 order by high desc, user_id limit 20"),
    "filter_clause": Query("select count(*) filter (where value > 50) as n_high, sum(user_id) filter (where event_type = 'view') as view_users, max(value) filter (where event_type = 'none') as nothing from events", duck="select count(*) filter (where value > 50) as n_high, cast(sum(user_id) filter (where event_type = 'view') as bigint) as view_users, max(value) filter (where event_type = 'none') as nothing from events"),
    "count_if_bools": Query("select event_type, count_if(value > 50) as n_high, bool_and(value > 0) as all_positive, bool_or(value > 200) as any_large from events group by event_type", duck="select event_type, cast(count_if(value > 50) as bigint) as n_high, bool_and(value > 0) as all_positive, bool_or(value > 200) as any_large from events group by event_type"),
    "bit_aggregates": Query("select event_type, bit_and(user_id) as b_and, bit_or(user_id) as b_or, bit_xor(user_id) as b_xor from events group by event_type"),
    "composite_expressions": Query("select event_type, round(avg(value) * 2 + count(*), 2) as mixed, round(sum(value) / count(value), 3) as ratio, upper(event_type) as name from events group by event_type"),
    "lineitem_q1": Query(
        "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) as sum_disc_price, round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 4) as avg_disc, count(*) as count_order from lineitem where l_shipdate <= timestamp '2001-09-02 00:00:00' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus",
        "lineitem",
    ),
    "orders_monthly_revenue": Query("select cast(date_trunc('month', o_orderdate) as {ts}) as month, count(*) as n, round(sum(o_totalprice), 2) as revenue from orders group by 1", "orders"),
    "decimal_sums": Query("select l_returnflag, cast(sum(cast(l_extendedprice as decimal(12, 2))) as double) as total, cast(max(cast(l_tax as decimal(6, 2))) as double) as tax from lineitem group by l_returnflag", "lineitem"),
    "count_distinct_users": Query(f"select {_DAY} as day, count(distinct user_id) as users, count(distinct user_id, event_type) as pairs from events group by 1", duck="select cast(date_trunc('day', ts) as timestamp) as day, count(distinct user_id) as users, count(distinct (user_id, event_type)) as pairs from events group by 1"),
    "sum_avg_distinct": Query("select event_type, sum(distinct user_id) as total, round(avg(distinct user_id), 4) as mean from events group by event_type", duck="select event_type, cast(sum(distinct user_id) as bigint) as total, round(avg(distinct user_id), 4) as mean from events group by event_type"),
    "select_distinct": Query("select distinct event_type, user_id % 10 as bucket from events"),
    "stddev_by_type": Query("select event_type, round(stddev_samp(value), 4) as sd, round(var_pop(value), 2) as vp, round(stddev_pop(value), 4) as sp, round(variance(value), 2) as vs from events group by event_type"),
    "corr_covar_regr": Query("select event_type, round(corr(value, user_id), 6) as r, round(covar_pop(value, user_id), 2) as cp, round(covar_samp(value, user_id), 2) as cs, round(regr_slope(value, user_id), 6) as slope, regr_count(value, user_id) as n from events group by event_type", duck="select event_type, round(corr(value, user_id), 6) as r, round(covar_pop(value, user_id), 2) as cp, round(covar_samp(value, user_id), 2) as cs, round(regr_slope(value, user_id), 6) as slope, cast(regr_count(value, user_id) as bigint) as n from events group by event_type"),
    "skew_kurtosis": Query("select event_type, round(skewness(value), 4) as skew, round(kurtosis(value), 3) as kurt from events group by event_type", duck="select event_type, round(m3 * sqrt(n) / pow(m2, 1.5), 4) as skew, round(n * m4 / (m2 * m2) - 3, 3) as kurt from (select event_type, cast(count(*) as double) as n, sum(pow(value - mean, 2)) as m2, sum(pow(value - mean, 3)) as m3, sum(pow(value - mean, 4)) as m4 from (select event_type, value, avg(value) over (partition by event_type) as mean from events) group by event_type)"),
    "median_percentile": Query("select event_type, round(median(value), 4) as med, round(percentile(value, 0.9), 4) as p90 from events group by event_type", duck="select event_type, round(median(value), 4) as med, round(quantile_cont(value, 0.9), 4) as p90 from events group by event_type"),
    "mode_values": Query("select event_type, mode(user_id % 7) as commonest from events group by event_type", duck="select event_type, m as commonest from (select event_type, user_id % 7 as m, row_number() over (partition by event_type order by count(*) desc, user_id % 7) as r from events group by event_type, user_id % 7) where r = 1"),
    "listagg_content": Query("select event_type, array_join(array_sort(split(listagg(distinct cast(user_id % 5 as string), ','), ',')), ',') as residues, md5(array_join(array_sort(split(listagg(concat(event_type, cast(user_id % 10 as string)), '-'), '-')), '-')) as everything from events group by event_type", duck="select event_type, string_agg(distinct (user_id % 5)::varchar, ',' order by (user_id % 5)::varchar) as residues, md5(string_agg(event_type || (user_id % 10)::varchar, '-' order by event_type || (user_id % 10)::varchar)) as everything from events group by event_type"),
    "stddev_shifted": Query("select event_type, round(stddev_samp(value + 1e9), 3) as sd, round(var_pop(value + 1e9), 1) as vp, round(stddev_pop(value - 1e8), 4) as sp, round(var_samp(value + 1e9), 1) as vs from events group by event_type"),
    "corr_shifted": Query("select event_type, round(corr(value + 1e7, user_id + 1e8), 5) as r, round(covar_pop(value + 1e7, user_id + 1e8), 1) as cp, round(regr_slope(value + 1e7, user_id + 1e8), 6) as slope from events group by event_type"),
    "kurtosis_shifted": Query("select event_type, round(skewness(value + 1e7), 3) as skew, round(kurtosis(value + 1e7), 2) as kurt from events group by event_type", duck="select event_type, round(m3 * sqrt(n) / pow(m2, 1.5), 3) as skew, round(n * m4 / (m2 * m2) - 3, 2) as kurt from (select event_type, cast(count(*) as double) as n, sum(pow(value - mean, 2)) as m2, sum(pow(value - mean, 3)) as m3, sum(pow(value - mean, 4)) as m4 from (select event_type, value, avg(value) over (partition by event_type) as mean from events) group by event_type)"),
    "regr_all": Query("select event_type, round(regr_avgx(value, user_id), 6) as ax, round(regr_avgy(value, user_id), 6) as ay, round(regr_sxx(value, user_id), 0) as sxx, round(regr_syy(value, user_id), 0) as syy, round(regr_sxy(value, user_id), 0) as sxy, round(regr_intercept(value, user_id), 4) as intercept, round(regr_r2(value, user_id), 8) as r2 from events group by event_type"),
    "percentile_array": Query("select event_type, round(element_at(percentile(value, array(0.1, 0.5, 0.99)), 3), 4) as p99, round(element_at(percentile(value, array(0.1, 0.5)), 1), 4) as p10 from events group by event_type", duck="select event_type, round(quantile_cont(value, 0.99), 4) as p99, round(quantile_cont(value, 0.1), 4) as p10 from events group by event_type"),
    "approx_percentile_close": Query("select event_type, abs(approx_percentile(value, 0.9) - percentile(value, 0.9)) < 1 as close, abs(approx_percentile(value, 0.99, 2000) - percentile(value, 0.99)) < 8 as far_close, count(*) as n from events group by event_type", duck="select event_type, true as close, true as far_close, count(*) as n from events group by event_type"),
    "any_value_key": Query("select user_id % 3 as bucket, any_value(user_id % 3) as same, count(*) as n from events group by 1"),
    "min_by_max_by": Query("select event_type, max_by(value, ts) as last_value, min_by(user_id, ts) as first_user from events group by event_type", duck="select event_type, arg_max(value, ts) as last_value, arg_min(user_id, ts) as first_user from events group by event_type"),
    "collect_sizes": Query("select event_type, size(collect_list(value)) as n, size(collect_set(user_id)) as users, array_join(array_sort(collect_set(user_id % 5)), ',') as residues from events group by event_type", duck="select event_type, cast(count(value) as int) as n, cast(count(distinct user_id) as int) as users, string_agg(distinct (user_id % 5)::varchar, ',' order by (user_id % 5)::varchar) as residues from events group by event_type"),
    "approx_users": Query("select user_id % 3 as bucket, abs(approx_count_distinct(user_id, 0.01) / count(distinct user_id) - 1) < 0.03 as close, count(distinct user_id) as users from events group by 1", duck="select user_id % 3 as bucket, true as close, count(distinct user_id) as users from events group by 1"),
    "cube_type": Query("select event_type, user_id % 3 as bucket, count(*) as n, grouping(event_type) as g from events group by cube (event_type, user_id % 3)", duck="select event_type, user_id % 3 as bucket, count(*) as n, cast(grouping(event_type) as tinyint) as g from events group by cube (event_type, user_id % 3)"),
    "rollup_q": Query(f"select {_DAY} as day, event_type, count(*) as n from events group by rollup (1, 2)", duck="select cast(date_trunc('day', ts) as timestamp) as day, event_type, count(*) as n from events group by rollup (1, 2)"),
    "window_buckets": Query("select window(ts, '6 hours').start as bucket, count(*) as n from events group by window(ts, '6 hours')", duck="select time_bucket(interval '6 hours', ts, timestamp '1970-01-01 00:00:00') as bucket, count(*) as n from events group by 1"),
    "string_functions": Query("select concat_ws('-', upper(event_type), substring(event_type, 1, 2)) as k, regexp_replace(event_type, '[aeiou]', '') as consonants, count(*) as n, max(length(regexp_extract(props, '([0-9]+)', 1))) as digits, min(trim(lower(event_type))) as low from events where event_type rlike '^[a-z]+$' group by 1, 2", duck="select concat_ws('-', upper(event_type), substring(event_type, 1, 2)) as k, regexp_replace(event_type, '[aeiou]', '', 'g') as consonants, count(*) as n, cast(max(length(regexp_extract(props, '([0-9]+)', 1))) as int) as digits, min(trim(lower(event_type))) as low from events where regexp_matches(event_type, '^[a-z]+$') group by 1, 2"),
    "nested_functions": Query("select element_at(map('click', 1, 'view', 2), event_type) as code, size(split(event_type, 'i')) as parts, array_contains(array('click', 'error'), event_type) as known, sum(named_struct('a', user_id, 'b', value).a) as total from events group by 1, 2, 3", duck="select case event_type when 'click' then 1 when 'view' then 2 end as code, cast(len(string_split(event_type, 'i')) as int) as parts, event_type in ('click', 'error') as known, cast(sum(user_id) as bigint) as total from events group by 1, 2, 3"),
    "date_functions": Query("select dayofweek(ts) as weekday, hour(ts) as hour, count(*) as n, max(datediff(cast(ts as date), date '2024-01-01')) as days, min(cast(ts + interval 1 day as date)) as next_day from events group by 1, 2", duck="select cast(dayofweek(ts) + 1 as int) as weekday, cast(hour(ts) as int) as hour, count(*) as n, cast(max(date_diff('day', date '2024-01-01', cast(ts as date))) as int) as days, min(cast(ts + interval 1 day as date)) as next_day from events group by 1, 2"),
    "json_dimension": Query("select cast(get_json_object(props, '$.k') as bigint) % 4 as k, count(*) as n from events group by 1", duck="select cast(json_extract_string(props, '$.k') as bigint) % 4 as k, count(*) as n from events group by 1"),
    "subquery_cached": Query(f"select max(n) as busiest, min(n) as quietest, count(*) as days from (select {_DAY} as day, count(*) as n from events group by 1)"),
    "narrow_subquery": Query("select kind, count(*) as n from (select upper(event_type) as kind from (select event_type, value from events) where value > 2) group by kind"),
    "projected_subquery": Query("select kind, count(*) as n, round(avg(v), 2) as mean from (select upper(event_type) as kind, value * 2 as v, ts from events where value > 2) group by kind"),
    "join_above": Query("select n_name, n, round(balance, 2) as balance from (select o_custkey, count(*) as n, sum(o_totalprice) as balance from orders group by o_custkey) join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where n > 15", "orders"),
    "window_above": Query(f"select day, event_type, n, row_number() over (partition by day order by n desc, event_type) as rank from (select {_DAY} as day, event_type, count(*) as n from events group by 1, 2)", duck="select day, event_type, n, cast(row_number() over (partition by day order by n desc, event_type) as int) as rank from (select cast(date_trunc('day', ts) as timestamp) as day, event_type, count(*) as n from events group by 1, 2)"),
    "union_two_aggs": Query("select 'low' as part, count(*) as n from events where value < 10 union all select 'high', count(*) from events where value >= 10", hits=2),
    "cte_two_aggs": Query(f"with d as (select {_DAY} as day, count(*) as n from events group by 1), t as (select count(*) as total from events) select day, round(100e0 * n / total, 4) as share from d cross join t", hits=2, duck="with d as (select cast(date_trunc('day', ts) as timestamp) as day, count(*) as n from events group by 1), t as (select count(*) as total from events) select day, round(100e0 * n / total, 4) as share from d cross join t"),
    "immutable_join_below": Query("select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as revenue from orders join customer on c_custkey = o_custkey group by c_mktsegment", "orders", joins=True),
    "empty_global": Query("select count(*) as n, sum(user_id) as s, max(value) as m from events where value < -1", duck="select count(*) as n, cast(sum(user_id) as bigint) as s, max(value) as m from events where value < -1"),
    "empty_grouped": Query("select event_type, count(*) as n from events where value < -1 group by event_type"),
    "immutable_left_join": Query("select c_mktsegment, count(*) as n, count(c_custkey) as known, round(sum(o_totalprice), 2) as revenue from orders left join (select * from customer where c_custkey % 2 = 0) on c_custkey = o_custkey group by c_mktsegment", "orders", joins=True),
    "immutable_anti_join": Query("select o_orderstatus, count(*) as n from orders left anti join customer on c_custkey = o_custkey and c_acctbal > 0 group by o_orderstatus", "orders", joins=True, duck="select o_orderstatus, count(*) as n from orders anti join customer on c_custkey = o_custkey and c_acctbal > 0 group by o_orderstatus"),
    "moving_floor_by_day": Query(f"select {_DAY} as day, count(*) as n, round(sum(value), 2) as total, count(distinct user_id) as users from events where ts > cast(current_date() as timestamp) - interval {{days}} days + interval 5 hours and value > 1 group by 1", duck="select cast(date_trunc('day', ts) as timestamp) as day, count(*) as n, round(sum(value), 2) as total, count(distinct user_id) as users from events where ts > cast(current_date as timestamp) - interval {days} day + interval 5 hour and value > 1 group by 1"),
    "left_join_above": Query("select c_custkey, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders group by o_custkey) on c_custkey = o_custkey where c_custkey < 200", "orders"),
    "semi_join_above": Query("select count(*) as n from customer left semi join (select o_custkey, max(o_totalprice) as top from orders group by o_custkey having max(o_totalprice) > 300000) on c_custkey = o_custkey", "orders", duck="select count(*) as n from customer where c_custkey in (select o_custkey from orders group by o_custkey having max(o_totalprice) > 300000)"),
    "range_join_above": Query(f"select a.day, sum(b.n) as upto from (select {_DAY} as day, count(*) as n from events group by 1) a join (select {_DAY} as day, count(*) as n from events group by 1) b on b.day <= a.day group by a.day", hits=2, duck="select day, cast(sum(n) over (order by day) as bigint) as upto from (select cast(date_trunc('day', ts) as timestamp) as day, count(*) as n from events group by 1)"),
    "intersect_except": Query("(select event_type from events group by event_type having count(*) > 10 intersect select event_type from events where value > 5 group by event_type) except select event_type from events where value > 1e9 group by event_type", hits=3),
    # How state is kept.
    "three_runs": Query("select event_type, count(*) as n, round(avg(value), 3) as mean, count(distinct user_id) as users from events group by event_type", cuts=("2024-01-05", "2024-01-12", "2024-01-20")),
    "future_rows": Query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by event_type", cuts=("2024-01-10", "2024-01-15"), now="2024-01-22"),
    "clock_goes_back": Query("select event_type, count(*) as n from events group by event_type", cuts=("2024-01-20",), now="2024-01-08"),
    "parquet_store": Query("select user_id, count(*) as n, max(value) as high from events group by user_id", store="parquet"),
    "late_rows": Query("select event_type, count(*) as n, count(distinct user_id) as users from events group by event_type", lateness=2 * 86_400_000_000, late="event_id % 7 = 0 and ts >= timestamp '2024-01-19 00:00:00'"),
    # Forms that are passed through, and must give the same rows.
    "passthrough_now": Query("select count(*) as n from events where ts < now()", hits=0),
    "passthrough_dynamic_bound": Query("select count(*) as n from events where ts > cast(current_date() as timestamp) - interval {days} days", hits=0, duck="select count(*) as n from events where ts > cast(current_date as timestamp) - interval {days} day"),
    "passthrough_join": Query("select c_mktsegment, count(*) as n from orders join customer on c_custkey = o_custkey group by c_mktsegment", "orders", hits=0),
    "passthrough_limit": Query("select count(*) as n from (select * from events order by event_id limit 100)", hits=0),
    "passthrough_rand": Query("select count(*) >= 0 as ok from events where rand() < 2", hits=0, duck="select true as ok"),
    "passthrough_subquery": Query("select count(*) as n from events where value > (select avg(value) from events)", hits=0),
    "passthrough_first": Query("select count(first_type) as zero_or_one, n from (select first(event_type) as first_type, count(*) as n from events) group by n", hits=0, duck="select cast(1 as bigint) as zero_or_one, count(*) as n from events"),
    "passthrough_filter_only": Query("select event_id, value from events where value > 150", hits=0),
    "passthrough_dimension": Query("select n_regionkey, count(*) as n from nation group by n_regionkey", hits=0),
}


def _session(spark: SparkSession, q: Query, cache, now: str) -> CachedSession:
    column, _ = GROWING[q.table]
    config = QueryCacheConfig(f"{q.table}.{column}", cache, immutable_joins=q.joins, allowed_lateness=q.lateness)
    return with_query_cache(spark, config.with_group_by_function("date_trunc").with_override_now(micros_of(spark, now)), MemoryLog())


def micros_of(spark: SparkSession, day: str) -> int:
    """The start of a day in the session's zone, as the tables' columns have no zone of their own."""
    return micros(datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))))


def _text(sql: str, ts: str) -> str:
    """{ts}: the type of a time without zone; {days}: from a day amid the events to today."""
    return sql.format(ts=ts, days=(datetime.now(UTC).date() - date(2024, 1, 15)).days)


def _runner(name: str, q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        column, cut = GROWING[q.table]
        rows = spark.read.parquet(f"{sf_dir}/{q.table}.parquet")
        for t in STATIC:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        cache = MemoryQueryCache() if q.store == "memory" else ParquetQueryCache(spark, _store_folder(spark))
        text = _text(q.sql, "timestamp_ntz")
        cuts = q.cuts or (cut,)
        for c in cuts:
            session = _session(spark, q, cache, c)
            # The last cold run of future_rows sees rows beyond its clock.
            until = c if name != "future_rows" else "2024-01-18"
            early = F.col(column) < F.lit(until).cast("timestamp_ntz")
            session.register_table(q.table, rows.where(early & ~F.expr(q.late) if q.late else early))
            session.sql(text)
        session = _session(spark, q, cache, q.now)
        session.register_table(q.table, rows)
        out = session.sql(text)
        hits = [s.hit for s in session.stats]
        if sum(hits) != q.hits:
            raise AssertionError(f"{name}: {hits} of {q.hits} hits; {session.log.history()}")
        return out

    return call


def _store_folder(spark: SparkSession) -> str:
    return own_folder(spark, "query-cache")


def _cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision log and the counters of a cold and a warm run, as rows."""
    q, cache, out = CATALOG["daily_by_type"], MemoryQueryCache(), []
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    for run, until in (("cold", GROWING["events"][1]), ("warm", LATER)):
        session = _session(spark, q, cache, until)
        session.register_table("events", rows.where(F.col("ts") < F.lit(until).cast("timestamp_ntz")))
        session.sql(_text(q.sql, "timestamp_ntz"))
        messages = [m for entry in session.log.history() for _, m in entry.messages]
        out += [(run, s.hit, s.cached_rows > 0, s.stored, "; ".join(messages)) for s in session.stats]
    return spark.createDataFrame(out, "run string, hit boolean, read_state boolean, stored boolean, messages string")


def _explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interface that reads no plan."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    config = QueryCacheConfig("events.ts", MemoryQueryCache())
    spec = {"keys": {"event_type": "event_type"}, "aggs": {"mean": ("avg", "value"), "n": ("count", F.lit(1)), "last_value": ("max_by", "value", "ts")}, "name": "events"}
    cut = GROWING["events"][1]
    cached_agg(rows.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")), config.with_override_now(micros_of(spark, cut)), "ts", **spec)
    out, stats = cached_agg(rows, config.with_override_now(micros_of(spark, LATER)), "ts", **spec)
    assert stats.hit
    return out.withColumn("mean", F.round("mean", 3))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What explain tells of queries before and after a run, and which of them share a key."""
    rows, cache = spark.read.parquet(f"{sf_dir}/events.parquet"), MemoryQueryCache()
    texts = {
        "counts": "select event_type, count(*) as n from events group by event_type", "same": "SELECT event_type, COUNT(*) AS other FROM events GROUP BY event_type",
        "filtered": "select event_type, count(*) as n from events where value > 1 group by event_type", "limited": "select count(*) as n from (select * from events limit 5)",
    }
    session = _session(spark, CATALOG["daily_by_type"], cache, GROWING["events"][1])
    session.register_table("events", rows)
    key = lambda text: text.split("key: ")[1].split()[0] if "key: " in text else ""
    before = {n: session.explain(t) for n, t in texts.items()}
    session.sql(texts["counts"])
    after = {n: session.explain(t) for n, t in texts.items()}
    out = [(n, "miss" in before[n], "hit, rows with events.ts >=" in after[n], "not cached" in after[n], key(after[n]) == key(after["counts"])) for n in texts]
    return spark.createDataFrame(out, "query string, miss_before boolean, hit_after boolean, refused boolean, same_key boolean")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of state read, merged and stored, with state in the driver and in files."""
    rows, cut, out = spark.read.parquet(f"{sf_dir}/events.parquet"), GROWING["events"][1], []
    for place, bound in (("driver", 50_000), ("files", 3)):
        cache = MemoryQueryCache()
        for run, until in (("cold", cut), ("warm", LATER)):
            session = with_query_cache(spark, QueryCacheConfig("events.ts", cache, driver_rows=bound).with_override_now(micros_of(spark, until)))
            session.register_table("events", rows.where(F.col("ts") < F.lit(until).cast("timestamp_ntz")))
            session.sql("select user_id, count(*) as n from events group by user_id")
            out += [(place, run, s.cached_rows, s.fresh_rows, s.stored_rows) for s in session.stats]
    return spark.createDataFrame(out, "place string, run string, cached_rows long, merged_rows long, stored_rows long")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same growing table from files of other formats; the last run adds nothing and reads nothing."""
    rows, folder, cut, out = spark.read.parquet(f"{sf_dir}/events.parquet").drop("props"), own_folder(spark, "sources"), GROWING["events"][1], None
    for form in ("csv", "json", "orc", "parquet"):
        cache = MemoryQueryCache()
        for run, until in enumerate((cut, LATER, LATER)):
            if run < 2:
                low = cut if run else "1970-01-01"
                part = rows.where((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))
                part.write.format(form).mode("append").save(f"{folder}/{form}")
            session = _session(spark, CATALOG["daily_by_type"], cache, until)
            session.register_table("events", spark.read.format(form).schema(rows.schema).load(f"{folder}/{form}"))
            got = session.sql("select event_type, count(*) as n, max(value) as high, count(distinct user_id) as users from events group by event_type")
            assert [(s.hit, s.scanned) for s in session.stats] == [(run > 0, run < 2)]
        got = got.select(F.lit(form).alias("source"), "*")
        out = got if out is None else out.union(got)
    return out


def _sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached result written in several formats and read again."""
    rows, cache, folder, out = spark.read.parquet(f"{sf_dir}/events.parquet"), MemoryQueryCache(), own_folder(spark, "sinks"), None
    for until in (GROWING["events"][1], LATER):
        session = _session(spark, CATALOG["daily_by_type"], cache, until)
        session.register_table("events", rows.where(F.col("ts") < F.lit(until).cast("timestamp_ntz")))
        got = session.sql("select event_type, count(*) as n, max(value) as high from events group by event_type")
    assert [s.hit for s in session.stats] == [True]
    for form in ("csv", "json", "orc", "parquet"):
        got.write.format(form).save(f"{folder}/{form}")
        again = spark.read.format(form).schema(got.schema).load(f"{folder}/{form}").select(F.lit(form).alias("sink"), "*")
        out = again if out is None else out.union(again)
    return out


def _user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with functions written in Python are left to Spark: nothing is known of them."""
    wanted = F.udf(lambda x: x % 3 == 1, "boolean")

    @F.pandas_udf("long")
    def total(x: pd.Series) -> int:
        return int((x % 100).sum())

    session = _session(spark, CATALOG["daily_by_type"], MemoryQueryCache(), LATER)
    session.register_table("events", spark.read.parquet(f"{sf_dir}/events.parquet"))
    table = spark.table("events")
    scalar = session.run(table.where(wanted("user_id")).groupBy("event_type").agg(F.count("*").alias("n")))
    refused = list(session.stats)
    whole = session.run(table.groupBy("event_type").agg(total("user_id").alias("total"), F.first("event_type").alias("x")).drop("x"))
    counts = table.groupBy("event_type").agg(F.count("*").alias("n"))
    assert not refused and not session.stats
    zero = F.lit(0).cast("long").alias("total")
    return scalar.select(F.lit("scalar").alias("kind"), "event_type", "n", zero).union(whole.join(counts, "event_type").select(F.lit("aggregate"), "event_type", "n", "total"))


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour with the latest day that was over by then, both from state: a union, and the last row before each."""
    rows, cache = spark.read.parquet(f"{sf_dir}/events.parquet"), MemoryQueryCache()
    texts = [f"select {_HOUR} as hour, count(*) as n from events where event_type = 'click' group by 1", f"select {_DAY} + interval 1 day as known, count(*) as n from events group by 1"]
    for until in (GROWING["events"][1], LATER):
        session = _session(spark, CATALOG["daily_by_type"], cache, until)
        session.register_table("events", rows.where(F.col("ts") < F.lit(until).cast("timestamp_ntz")))
        hours, days = (session.sql(_text(t, "timestamp_ntz")) for t in texts)
    none = F.lit(None).cast("long")
    both = hours.select("hour", F.col("n"), none.alias("day_n"), F.lit(1).alias("side")).union(days.select("known", none, "n", F.lit(0)))
    before = Window.orderBy("hour", "side").rowsBetween(Window.unboundedPreceding, 0)
    # One window over all, as these are a few hundred rows; a table with keys has it by key.
    return both.withColumn("last_day", F.last("day_n", ignorenulls=True).over(before)).where("side = 1 and last_day is not null").select("hour", "n", "last_day")


def _dataframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of the DataFrame interface, answered from state."""
    rows, cache = spark.read.parquet(f"{sf_dir}/events.parquet"), MemoryQueryCache()
    for until in (GROWING["events"][1], LATER):
        session = _session(spark, CATALOG["daily_by_type"], cache, until)
        session.register_table("events", rows.where(F.col("ts") < F.lit(until).cast("timestamp_ntz")))
        table = spark.table("events").where(F.col("value") > 2)
        out = session.run(table.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")).where("n > 3").orderBy("event_type"))
    assert [s.hit for s in session.stats] == [True]
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from ..streaming import windows
    from ..streaming.feeder import streamed_counts

    return {n: _runner(n, q) for n, q in CATALOG.items()} | {
        "cache_stats": _cache_stats, "explicit_agg": _explicit, "streaming_feed": streamed_counts, "explain_rows": _explained, "operator_metrics": _metrics, "other_sources": _sources, "dataframe_api": _dataframes,
        "file_sinks": _sinks, "user_functions": _user_functions, "asof_join_above": _asof, **windows.queries(),
    }


def oracle_sql() -> dict[str, str]:
    out = {n: _text(q.duck or q.sql, "timestamp") for n, q in CATALOG.items()}
    out["explicit_agg"] = "select event_type, round(avg(value), 3) as mean, count(*) as n, arg_max(value, ts) as last_value from events group by event_type"
    from ..streaming import windows

    out |= windows.oracle_sql()
    out["file_sinks"] = "select sink, event_type, count(*) as n, max(value) as high from events, (values ('csv'), ('json'), ('orc'), ('parquet')) as t(sink) group by sink, event_type"
    out["user_functions"] = "select 'scalar' as kind, event_type, count(*) as n, 0 as total from events where user_id % 3 = 1 group by event_type union all select 'aggregate', event_type, count(*), cast(sum(user_id % 100) as bigint) from events group by event_type"
    out["asof_join_above"] = "select h.hour, h.n, d.n as last_day from (select cast(date_trunc('hour', ts) as timestamp) as hour, count(*) as n from events where event_type = 'click' group by 1) h asof join (select cast(date_trunc('day', ts) as timestamp) + interval 1 day as known, count(*) as n from events group by 1) d on h.hour >= d.known"
    out["dataframe_api"] = "select event_type, count(*) as n, round(avg(value), 4) as mean from events where value > 2 group by event_type having count(*) > 3"
    out["other_sources"] = "select source, event_type, count(*) as n, max(value) as high, count(distinct user_id) as users from events, (values ('csv'), ('json'), ('orc'), ('parquet')) as t(source) group by source, event_type"
    out["explain_rows"] = "select * from (values ('counts', true, true, false, true), ('same', true, true, false, true), ('filtered', true, false, false, false), ('limited', false, false, true, false)) as t(query, miss_before, hit_after, refused, same_key)"
    cold, warm = "(select count(distinct user_id) from events where ts < timestamp '2024-01-20 00:00:00')", "(select count(distinct user_id) from events)"
    merged = "(select count(distinct user_id) from events)"
    out["operator_metrics"] = f"select place, 'cold' as run, cast(0 as bigint) as cached_rows, {cold} as merged_rows, {cold} as stored_rows from (values ('driver'), ('files')) as t(place) union all select place, 'warm', {cold}, {merged}, {warm} from (values ('driver'), ('files')) as t(place)"
    out["streaming_feed"] = "select event_type, count(*) as n, round(sum(value), 2) as total, max(value) as high from events group by event_type"
    out["cache_stats"] = "select 'cold' as run, false as hit, false as read_state, true as stored, 'its state can be kept; no state yet, answered from all rows' as messages union all select 'warm', true, true, true, 'its state can be kept; answered from state and newer rows'"
    return out
