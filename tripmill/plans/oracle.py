"""The registered queries in plain SQL over the given tables, written apart from the Spark code.

Every statement is one chain of common table expressions from the raw tables; a query only spells
out the steps that it needs.
"""

from __future__ import annotations

from tripmill.operators.contracts import Rule
from tripmill.plans.warehouse import QUALITY

FEED = (
    "case c_mktsegment when 'AUTOMOBILE' then 'a' when 'BUILDING' then 'b' "
    "when 'FURNITURE' then 'c' when 'HOUSEHOLD' then 'c' when 'MACHINERY' then 'd' end"
)

TRIPS = f"""
base as (
  select l.*, s_nationkey, c_nationkey, c_acctbal, {FEED} as feed,
         l_shipdate + to_hours(cast(l_partkey % 24 as int)) + to_minutes(cast(l_suppkey % 60 as int)) as p_ts,
         cast(l_extendedprice as decimal(18,2)) as price
  from lineitem l join supplier on l_suppkey = s_suppkey
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
),
planted as (select * from base union all select * from base where l_linenumber = 7),
trips as (
  select feed, l_linenumber as vendor,
         'OP' || cast(l_suppkey % 4 as varchar) as licence,
         'B' || cast(l_suppkey as varchar) as base_num,
         p_ts as pickup_ts,
         case when l_partkey % 50 <> 0 then p_ts + to_minutes(cast(l_quantity as int)) end as dropoff_ts,
         l_quantity / 2 as distance_mi,
         cast(s_nationkey as bigint) + 1 as pickup_place_id,
         case when c_acctbal >= 0 then cast(c_nationkey as bigint) + 1 end as dropoff_place_id,
         cast(case l_returnflag when 'A' then 1 when 'N' then 2 end as bigint) as payment_type,
         cast(price as double) as fare,
         cast(cast(price * cast(l_discount as decimal(18,2)) as decimal(18,2)) as double) as tip,
         case when l_tax >= 0.04 then 2.75e0 else 0e0 end as congestion_fee,
         case when l_tax >= 0.04 and l_linestatus = 'F' then 0.75e0 else 0e0 end as core_zone_fee,
         cast(year(l_shipdate) as bigint)
           + case when l_linenumber = 6 and l_partkey % 9 = 0 then 1 else 0 end as year,
         cast(month(l_shipdate) as bigint) as month
  from planted
)"""

CONFORMED = f"""{TRIPS},
conformed as (
  select feed,
         case feed when 'a' then cast(vendor as varchar)
                   when 'b' then cast(vendor as varchar) || '.0'
                   when 'c' then licence end as operator_code,
         case when feed = 'd' then base_num end as dispatch_base,
         pickup_ts, dropoff_ts, distance_mi, pickup_place_id, dropoff_place_id,
         case when feed in ('a', 'b') then payment_type end as payment_type,
         fare,
         case when feed <> 'd' then tip end as tip,
         case when feed <> 'd' then congestion_fee end as congestion_fee,
         case when feed <> 'd' then core_zone_fee end as core_zone_fee,
         year, month
  from trips
)"""

DEDUP = f"""{CONFORMED},
dedup as (select *, count(*) as copies from conformed group by all),
judged as (
  select *, pickup_ts is not null and dropoff_ts is not null
            and year(pickup_ts) = year and month(pickup_ts) = month as accepted
  from dedup
)"""

SILVER = f"""{DEDUP},
silver as (select * exclude (copies, accepted) from judged where accepted)"""

UNIFIED = f"""{SILVER},
unified as (
  select feed,
         case when feed = 'a' then case operator_code when '1' then 'CMT' when '2' then 'VERIFONE' else 'OTHER' end
              when feed = 'b' then case operator_code when '1.0' then 'CMT' when '2.0' then 'VERIFONE' else 'OTHER' end
              when feed = 'c' then operator_code else dispatch_base end as operator,
         operator_code, pickup_ts, dropoff_ts, pickup_place_id, dropoff_place_id, payment_type,
         cast(null as bigint) as trip_seconds,
         fare, coalesce(tip, 0e0) as tip, 0e0 as tolls, coalesce(congestion_fee, 0e0) as congestion_fee,
         0e0 as airport_fee, 0e0 as improvement_fee, 0e0 as fund_fee, 0e0 as sales_tax, 0e0 as driver_pay,
         distance_mi, 0e0 as extra, 0e0 as transit_tax, coalesce(core_zone_fee, 0e0) as core_zone_fee,
         year, month
  from silver
)"""

SERVICE_ID = (
    "cast(case when feed = 'a' then 1 when feed = 'b' then 2 when feed = 'c' and operator_code = 'OP1' then 3 "
    "when feed = 'c' and operator_code = 'OP2' then 4 when feed = 'c' and operator_code = 'OP3' then 5 "
    "when feed = 'c' then 6 when feed = 'd' then 7 else 6 end as bigint)"
)
DISTANCE_BAND = (
    "cast(case when distance_mi < 1 then 1 when distance_mi < 3 then 2 when distance_mi < 5 then 3 "
    "when distance_mi < 10 then 4 when distance_mi < 20 then 5 else 6 end as bigint)"
)
TIME_BAND = (
    "cast(case when hour(pickup_ts) < 6 then 1 when hour(pickup_ts) < 10 then 2 when hour(pickup_ts) < 12 then 3 "
    "when hour(pickup_ts) < 14 then 4 when hour(pickup_ts) < 17 then 5 when hour(pickup_ts) < 20 then 6 "
    "else 7 end as bigint)"
)

OPERATORS = f"""{UNIFIED},
operators as (
  select row_number() over (order by operator) as operator_id, operator from (select distinct operator from unified)
)"""

FACT = f"""{OPERATORS},
fact as (
  select {SERVICE_ID} as service_id, operator_id,
         coalesce(pickup_place_id, 0) as pickup_place_id, coalesce(dropoff_place_id, 0) as dropoff_place_id,
         {DISTANCE_BAND} as distance_band_id, {TIME_BAND} as time_band_id,
         cast(case when tip > 0 then 1 else 2 end as bigint) as tip_status_id,
         cast(case when congestion_fee > 0 then 1 else 2 end as bigint) as congestion_status_id,
         cast(case when core_zone_fee > 0 then 1 else 2 end as bigint) as core_fee_status_id,
         pickup_ts,
         cast(date_diff('second', pickup_ts, dropoff_ts) as bigint) as duration_s,
         distance_mi, fare, tip, tolls, improvement_fee, airport_fee, congestion_fee, core_zone_fee, fund_fee,
         extra + transit_tax + sales_tax as other_fees, cast(1 as bigint) as trips,
         case when payment_type = 2 then 'CASH' else 'OTHER' end as payment_class,
         strftime(pickup_ts, '%Y-%m') as year_month,
         cast(year(pickup_ts) as bigint) as year, cast(month(pickup_ts) as bigint) as month
  from unified join operators using (operator)
)"""

DIMS = """
service(service_id, service_group) as (
  values (1, 'TAXI'), (2, 'TAXI'), (3, 'APP'), (4, 'APP'), (5, 'APP'), (6, 'APP'), (7, 'APP')
),
distance_dim(distance_band_id, distance_band, distance_description) as (
  values (1, '0-1 MILES', 'UP TO 1 MILE'), (2, '1-3 MILES', 'SHORT'), (3, '3-5 MILES', 'MEDIUM'),
         (4, '5-10 MILES', 'MEDIUM LONG'), (5, '10-20 MILES', 'LONG'), (6, '20+ MILES', 'VERY LONG')
),
time_dim(time_band_id, time_band) as (
  values (1, 'OVERNIGHT'), (2, 'AM PEAK'), (3, 'MORNING'), (4, 'MIDDAY'), (5, 'AFTERNOON'), (6, 'PM PEAK'), (7, 'NIGHT')
),
yes_no(id, label) as (values (1, 'YES'), (2, 'NO')),
place as (
  select place_id, district, zone, service_zone,
         case when place_id in (2, 9) then 'AIRPORT' when place_id in (3, 8, 13) then 'CORE'
              when district = 'ASIA' then 'HOME OUTSIDE CORE' when place_id in (25) then 'UNKNOWN'
              else 'OTHER' end as region_group
  from (
    select cast(n_nationkey as bigint) + 1 as place_id, upper(r_name) as district, upper(n_name) as zone,
           case when n_nationkey < 8 then 'INNER RING' when n_nationkey < 16 then 'MIDDLE RING'
                else 'OUTER RING' end as service_zone
    from nation join region on n_regionkey = r_regionkey
  )
)"""

STAR = f"{FACT},{DIMS}"

MART = f"""{STAR},
mart as (
  select f.* exclude (year, month), cast(f.year as varchar) as year, cast(f.month as varchar) as month,
         service_group, operator,
         pu.district as pickup_district, pu.zone as pickup_zone, pu.service_zone as pickup_service_zone,
         pu.region_group as pickup_region_group, dp.district as dropoff_district, dp.zone as dropoff_zone,
         distance_band, distance_description, time_band, t.label as tipped, c.label as congestion_charged,
         k.label as core_fee_charged,
         case when t.label = 'YES' then 1e0 else 0e0 end as tip_flag
  from fact f
  left join service using (service_id) left join operators using (operator_id)
  left join place pu on f.pickup_place_id = pu.place_id left join place dp on f.dropoff_place_id = dp.place_id
  left join distance_dim using (distance_band_id) left join time_dim using (time_band_id)
  left join yes_no t on f.tip_status_id = t.id left join yes_no c on f.congestion_status_id = c.id
  left join yes_no k on f.core_fee_status_id = k.id
)"""

MART_OUTPUT = (
    "pickup_ts, year_month, duration_s, distance_mi, fare, tip, tolls, improvement_fee, airport_fee, "
    "congestion_fee, core_zone_fee, fund_fee, other_fees, trips, year, month, service_group, operator, "
    "pickup_district, pickup_zone, pickup_service_zone, pickup_region_group, dropoff_district, dropoff_zone, "
    "distance_band, distance_description, time_band, tipped, congestion_charged, tip_flag"
)


def money(column: str) -> str:
    return f"cast(sum(cast({column} as decimal(18,2))) as double)"


def mean(column: str) -> str:
    return f"{money(column)} / cast(count(*) as double)"


def half_up(value: str, digits: int) -> str:
    scale = f"1{'0' * digits}e0"
    return f"floor(({value}) * {scale} + 0.5e0) / {scale}"


# ---------------------------------------------------------------- landing

LANDING = f"""{TRIPS},
spans as (
  select feed, min(year) as first_year, case when feed = 'c' then 2 else 1 end as first_month, max(year) as last_year
  from trips group by feed
),
months as (
  select feed, unnest(generate_series(make_date(first_year, first_month, 1)::timestamp,
                                      make_date(last_year, 12, 1)::timestamp, interval 1 month)) as first_day
  from spans
),
expected as (
  select feed, cast(year(first_day) as bigint) as year, cast(month(first_day) as bigint) as month,
         feed || '/year=' || strftime(first_day, '%Y') || '/month=' || strftime(first_day, '%m') || '/'
           || feed || '_tripdata_' || strftime(first_day, '%Y-%m') || '.parquet' as storage_key
  from months
),
arrived as (select feed, year, month, count(*) * 8 as length from trips group by feed, year, month),
present as (
  select distinct {FEED} as feed, cast(year(o_orderdate) as bigint) as year, cast(month(o_orderdate) as bigint) as month
  from orders join customer on o_custkey = c_custkey
  where o_orderpriority = '1-URGENT' and month(o_orderdate) <= 6
),
landed as (
  select e.*,
         case when p.feed is not null then 'SKIP_EXISTS' when a.length is null then 'SKIP_404'
              when a.length >= 1024 then 'OK' else 'FAIL' end as status,
         a.length
  from expected e left join present p using (feed, year, month) left join arrived a using (feed, year, month)
),
statuses as (
  select feed, year, month, storage_key, status,
         case when status = 'OK' then length else 0 end as bytes,
         case when status = 'FAIL' then 'file too small: ' || cast(length as varchar) || ' bytes' end as error
  from landed
)"""

FAILURES = f"""{LANDING},
attempts as (
  select ['a', 'b', 'c', 'd'][user_id % 4 + 1] as feed, 1995 + user_id % 8 as year, user_id % 12 + 1 as month,
         ts, event_id, substring('source said ' || repeat(props, 30), 1, 200) as error
  from events where event_type = 'error'
),
named as (
  select *, feed || '_tripdata_' || cast(year as varchar) || '-' || lpad(cast(month as varchar), 2, '0') || '.parquet' as file
  from attempts
),
keyed as (
  select 'source/' || file as url, feed,
         feed || '/year=' || cast(year as varchar) || '/month=' || lpad(cast(month as varchar), 2, '0') || '/' || file
           as storage_key,
         error, ts, event_id
  from named
),
latest as (select * from keyed qualify row_number() over (partition by url order by ts desc, event_id desc) = 1)"""

ORACLE: dict[str, str] = {
    "landing_calendar": f"with {LANDING} select * from expected",
    "landing_gap": f"""with {LANDING} select e.* from expected e
        where not exists (select 1 from arrived a where a.feed = e.feed and a.year = e.year and a.month = e.month
                          and a.length >= 1024)""",
    "landing_status": f"with {LANDING} select * from statuses",
    "landing_summary": f"""with {LANDING} select feed, status, count(*) as periods,
        cast(sum(bytes) as bigint) as total_bytes from statuses group by feed, status""",
    "dead_letter_latest": f"with {FAILURES} select * from latest",
    "dead_letter_pending": f"""with {FAILURES} select latest.* from latest
        where storage_key not in (select storage_key from expected join arrived using (feed, year, month)
                                  where length >= 1024)""",
}

# ---------------------------------------------------------------- conform and silver

METERED = (
    "operator_code, pickup_ts, dropoff_ts, distance_mi, pickup_place_id, dropoff_place_id, payment_type, fare, tip, "
    "congestion_fee, core_zone_fee, year, month"
)
APP = METERED.replace("payment_type, ", "")
DISPATCH = (
    "dispatch_base, pickup_ts, dropoff_ts, distance_mi, pickup_place_id, dropoff_place_id, fare, year, month"
)
for _feed, _columns in {"a": METERED, "b": METERED, "c": APP, "d": DISPATCH}.items():
    ORACLE[f"conform_feed_{_feed}"] = f"with {CONFORMED} select {_columns} from conformed where feed = '{_feed}'"

ORACLE |= {
    "conform_text": f"""with {CONFORMED} select feed, coalesce(dispatch_base, operator_code) as text,
        count(*) as total_rows from conformed where feed is not null group by all""",
    "drift_align": f"""with {CONFORMED} select {METERED.replace('core_zone_fee', 'core')}
        from (select *, case when year >= 1997 then core_zone_fee end as core from conformed) where feed = 'a'""".replace(
        "core, year", "core as core_zone_fee, year"
    ),
    "cast_losses": f"""with {CONFORMED} select 'c' as feed, name as column,
        case when name = 'distance_mi' then (select count(*) from conformed where feed = 'c') else 0 end as lost
        from (select unnest(['operator_code', 'pickup_ts', 'dropoff_ts', 'distance_mi', 'pickup_place_id',
                             'dropoff_place_id', 'fare', 'tip', 'congestion_fee', 'core_zone_fee']) as name)""",
    "silver_dedup": f"with {DEDUP} select * from dedup",
    "silver_clean": f"with {SILVER} select * from silver",
    "silver_reconcile": f"""with {DEDUP}, levels as (
          select feed, year, month, cast(sum(copies) as bigint) as raw, count(*) as dedup,
                 count(*) filter (accepted) as clean
          from judged group by rollup (feed, year, month))
        select *, raw - clean as removed, 100e0 * cast(raw - clean as double) / cast(greatest(raw, 1) as double)
          as removed_pct
        from levels where feed is not null""",
    "silver_pending_periods": f"""with {SILVER} select distinct feed, year, month from trips
        except select feed, year, month from silver""",
    "silver_overwrite": f"""with {SILVER} select feed, year, month, count(*) as total_rows,
        {money("case when year = 1998 then fare * 2 else fare end")} as total_fare
        from silver where feed is not null group by all""",
    "silver_schema_growth": f"""with {SILVER} select feed, year, count(*) as total_rows,
        count(case when year >= 1998 then fare end) as fares from silver where feed is not null group by all""",
}

# What the composed run writes has the counts that the rows themselves have.
ORACLE["landing_to_silver"] = ORACLE["silver_reconcile"]

REJECTED = "(feed = 'd' and vendor = 5) or (feed = 'b' and year = 1998 and month = 3)"
KEPT_SILVER = SILVER.replace(TRIPS, f"{TRIPS},\nkept as (select * from trips where not ({REJECTED}))", 1).replace("  from trips\n", "  from kept\n")

ORACLE |= {
    "reject_balance": f"""with {KEPT_SILVER}, clean as (select feed, count(*) as clean from silver group by feed),
        landed as (select feed, count(*) as raw, count(*) filter ({REJECTED}) as rejected from trips group by feed)
        select feed, raw, clean, raw - rejected - clean as removed, rejected from landed join clean using (feed)""",
    "lake_run_repaired": f"""with {LANDING.replace(TRIPS, SILVER, 1)}, files as (select distinct feed, year, month from trips),
        clean as (select feed, year, month, count(*) as n from silver group by all),
        by_month as (select year, month, count(*) as n from silver group by all)
        select e.feed, e.year, e.month,
          case when f.feed is null then 'SKIP_404' when e.feed = 'b' and e.year = 1998 and e.month = 3 then 'FAIL' else 'OK' end
            as first_status,
          case when f.feed is null then 'SKIP_404' when (e.feed = 'b' and e.year = 1998 and e.month = 3) or c.n is null then 'OK'
               else 'SKIP_EXISTS' end as second_status,
          coalesce(c.n, 0) as clean, coalesce(m.n, 0) as month_trips
        from expected e left join files f using (feed, year, month) left join clean c using (feed, year, month)
        left join by_month m using (year, month)""",
    "ledger_changed_months": f"""with {TRIPS} select distinct feed, year, month from trips
        where (vendor = 6 and year = 1999) or (vendor = 7 and month = 12)
        union select feed, year, month from trips where year = 2000 group by all
        having count(*) filter (vendor = 5) > 0 and count(*) filter (vendor <> 5) > 0""",
    "silver_type_change": f"""with {SILVER} select feed, year, count(*) as total_rows,
        {money("case when year < 1998 then floor(fare) else fare end")} as total_fare
        from silver where feed is not null group by all""",
    "gold_by_delta": f"""with {SILVER} select year, month, count(*) as total_trips,
        {money("fare")} as total_fare, cast(case when year = 1998 and month = 3 then 2 else 1 end as bigint) as build
        from silver group by year, month""",
}

# ---------------------------------------------------------------- quality


def rule_sql(feed: str, rule: Rule, by_month: bool = False) -> str:
    """One scorecard row as SQL, or one per month."""
    rows = f"from silver where feed = '{feed}'"
    if rule.column == "no_such_column":
        values = "cast(null as double), cast(null as bigint), 'ERROR'"
    elif rule.kind == "row_count":
        values = f"cast(count(*) as double), cast(0 as bigint), case when count(*) > {rule.low} then 'PASS' else 'FAIL' end"
    elif rule.kind == "completeness":
        part = f"cast(count({rule.column}) as double) / cast(count(*) as double)"
        values = f"{part}, count(*) - count({rule.column}), case when {part} >= {rule.low} then 'PASS' else 'FAIL' end"
    else:
        broken = f"{rule.column} < {rule.low}"
        if rule.kind == "between":
            broken += f" or {rule.column} > {rule.high}"
        bad = f"count(*) filter ({broken})"
        values = f"cast(min({rule.column}) as double), {bad}, case when {bad} = 0 then 'PASS' else 'FAIL' end"
    if by_month:
        return f"select '{feed}', year, month, '{rule.label}', {values} {rows} group by year, month"
    return f"select '{feed}', '{rule.label}', {values} {rows}"


_rules = " union all ".join(rule_sql(feed, rule) for feed, rules in QUALITY.items() for rule in rules)
_scorecard = f"scorecard(table_name, rule, metric, bad_rows, outcome) as ({_rules})"
# A rule on a missing column has no rows to aggregate over: keep one.
ORACLE["dq_scorecard"] = f"with {SILVER}, {_scorecard} select distinct * from scorecard"
ORACLE["dq_scorecard_merged"] = ORACLE["dq_scorecard"]
_months = " union all ".join(rule_sql(feed, rule, True) for feed, rules in QUALITY.items() for rule in rules)
ORACLE["dq_scorecard_by_month"] = f"""with {SILVER}, scorecard(table_name, year, month, rule, metric, bad_rows, outcome) as ({_months})
    select * from scorecard"""

# ---------------------------------------------------------------- star

ORACLE |= {
    "union_feeds": f"with {UNIFIED} select * from unified",
    "operator_decode": f"""with {UNIFIED} select feed, operator_code, operator, count(*) as total_trips
        from unified group by all""",
    "service_class": f"""with {UNIFIED} select feed, operator_code, {SERVICE_ID} as service_id,
        count(*) as total_trips from unified group by all""",
    "distance_band": f"""with {UNIFIED} select distance_mi, {DISTANCE_BAND} as distance_band_id,
        count(*) as total_trips from unified group by all""",
    "time_band": f"""with {UNIFIED} select cast(hour(pickup_ts) as bigint) as hour, {TIME_BAND} as time_band_id,
        count(*) as total_trips from unified group by all""",
    "dim_operator": f"with {OPERATORS} select * from operators",
    "dim_place": f"with {DIMS} select * from place",
    "fact_trip": f"with {FACT} select * from fact",
    "trip_id_unique": f"with {FACT} select count(*) as total_trips, count(*) as distinct_ids from fact",
}


def used_dim(table: str, key: str, columns: str, dim_key: str | None = None) -> str:
    dim_key = dim_key or key
    return f"""with {STAR} select cast(d.{dim_key} as bigint) as {key}, {columns}, count(fact.trips) as total_trips
        from {table} d left join fact on fact.{key} = d.{dim_key} group by all"""


ORACLE |= {
    "dim_service": used_dim("service", "service_id", "service_group"),
    "dim_distance_band": used_dim("distance_dim", "distance_band_id", "distance_band, distance_description"),
    "dim_time_band": used_dim("time_dim", "time_band_id", "time_band"),
    "dim_tip_status": used_dim("yes_no", "tip_status_id", "d.label as tipped", "id"),
    "dim_congestion_status": used_dim("yes_no", "congestion_status_id", "d.label as congestion_charged", "id"),
}

# ---------------------------------------------------------------- mart

ORACLE |= {
    "mart_trip": f"with {MART} select {MART_OUTPUT} from mart",
    "mart_trip_excluding": f"""with {MART} select distance_band, cast(sum(trips) as bigint) as total_trips,
        {money("fare")} as total_fare from mart where not (distance_mi >= 20 and fare > 90000) group by distance_band""",
    "mart_trip_excluding_by_month": f"""with {MART} select distance_band, year, cast(sum(trips) as bigint) as total_trips,
        {money("fare")} as total_fare from mart where not (year = '1998' and fare > 90000) group by all""",
    "mart_core_fee": f"""with {MART} select service_group, congestion_charged, core_fee_charged,
        cast(sum(trips) as bigint) as total_trips from mart group by all""",
    "mart_filtered": f"""with {MART} select service_group, pickup_district, pickup_zone, year, month,
        cast(sum(trips) as bigint) as total_trips, {money("fare")} as total_fare from mart
        where service_group = 'APP' and pickup_district in ('ASIA', 'EUROPE') and year in ('1997', '1998')
          and year_month between '1997-06' and '1998-03' group by all""",
}

# ---------------------------------------------------------------- reports

SERVED = "fact join service using (service_id)"
SERVED_AT = f"{SERVED} join place on pickup_place_id = place_id"

ORACLE |= {
    "r_market_share": f"""with {STAR}, counts as (
          select year_month, service_group, count(*) as total_trips from {SERVED} group by all)
        select *, {half_up("100e0 * cast(total_trips as double) / cast(sum(total_trips) over (partition by year_month) as double)", 2)}
          as share_pct from counts""",
    "r_top_zones": f"""with {STAR} select zone as pickup_zone, service_group, count(*) as total_trips
        from {SERVED_AT} group by all order by total_trips desc, pickup_zone, service_group limit 20""",
    "r_tip_probability": f"""with {STAR}, counts as (
          select service_group, count(*) as total_trips, count(*) filter (tip > 0) as tipped_trips
          from {SERVED} group by service_group)
        select *, {half_up("100e0 * cast(tipped_trips as double) / cast(total_trips as double)", 1)} as tipped_pct
        from counts""",
    "r_tip_mean_paid": f"""with {STAR} select service_group, {half_up(mean("tip"), 2)} as mean_tip
        from {SERVED} where tip > 0 group by service_group""",
    "r_tip_scatter": f"""with {STAR} select service_group, fare, tip, distance_mi from {SERVED}
        where year = 1998 and tip > 0 and fare between 1 and 60000
        order by md5(concat_ws('|', strftime(pickup_ts, '%Y-%m-%d %H:%M:%S'),
                               cast(pickup_place_id as varchar), cast(dropoff_place_id as varchar),
                               cast(cast(floor(fare * 100e0 + 0.5e0) as bigint) as varchar),
                               cast(cast(floor(tip * 100e0 + 0.5e0) as bigint) as varchar),
                               cast(cast(floor(distance_mi * 100e0 + 0.5e0) as bigint) as varchar))),
                 service_group, fare, tip, distance_mi
        limit 2000""",
    "r_monthly_volume": f"""with {STAR} select year_month, service_group, count(*) as total_trips
        from {SERVED} group by all""",
    "r_tip_by_era": f"""with {STAR} select year_month, service_group, {half_up(mean("tip"), 2)} as mean_tip,
        case when year_month < '1997-03' then 'BEFORE' when year_month between '1997-03' and '1998-06' then 'DURING'
             else 'AFTER' end as era
        from {SERVED} where tip > 0 group by year_month, service_group""",
    "r_core_zone_volume": f"""with {STAR} select service_group,
        case when service_zone in ('INNER RING', 'MIDDLE RING') then 'CORE ZONE' else 'OUTSIDE CORE' end as core_zone,
        count(*) as total_trips
        from {SERVED_AT} where year = 1998 and month = 1 and district = 'ASIA' group by all""",
    "r_fee_kpi": f"""with {STAR} select service_group, {half_up(money("core_zone_fee"), 2)} as total_fee,
        {half_up(mean("core_zone_fee"), 2)} as mean_fee
        from {SERVED} where year = 1998 and month = 1 and core_zone_fee > 0 group by service_group""",
    "r_before_after": f"""with {STAR} select case when year = 1997 then 'DEC-1997' else 'JAN-1998' end as period,
        case when district = 'ASIA' then 'INSIDE' else 'OUTSIDE' end as region, count(*) as total_trips
        from fact join place on pickup_place_id = place_id
        where (year = 1997 and month = 12) or (year = 1998 and month = 1) group by all""",
}

for _rule, _inside in {
    "service_zone": "service_zone in ('INNER RING', 'MIDDLE RING')",
    "district": "district = 'ASIA'",
    "region": "region_group = 'CORE'",
}.items():
    ORACLE[f"r_core_zone_volume_{_rule}"] = f"""with {STAR} select service_group,
        case when {_inside} then 'CORE ZONE' else 'OUTSIDE CORE' end as core_zone, count(*) as total_trips
        from {SERVED_AT} where year = 1998 and month = 1 and district = 'ASIA' group by all"""
    ORACLE[f"r_before_after_{_rule}"] = f"""with {STAR} select
        case when year = 1997 then 'DEC-1997' else 'JAN-1998' end as period,
        case when {_inside} then 'INSIDE' else 'OUTSIDE' end as region, count(*) as total_trips
        from fact join place on pickup_place_id = place_id
        where (year = 1997 and month = 12) or (year = 1998 and month = 1) group by all"""
# The default rules are registered under the plain names.
del ORACLE["r_core_zone_volume_service_zone"], ORACLE["r_before_after_district"]


# ---------------------------------------------------------------- tiles and checks


def tile(categories: str, value: str, where: str = "true") -> str:
    return f"with {MART} select {categories}, {value} from mart where {where} group by all"


# Reports and tiles that the summary answers as well.
ADDITIVE = (
    "r_market_share", "r_top_zones", "r_tip_probability", "r_tip_mean_paid", "r_monthly_volume", "r_tip_by_era",
    "r_core_zone_volume", "r_fee_kpi", "r_before_after", "tile_volume", "tile_district_taxi", "tile_district_app",
    "tile_time_band", "tile_tip_rate", "tile_tip_mean", "tile_tip_by_band_hour", "tile_tip_by_band_region", "tile_tip_era",
    "tile_region_mix", "tile_core_volume",
)

TRIP_SUM = "cast(sum(trips) as bigint) as sum_trips"
TIP_SUM = f"{money('tip')} as sum_tip"
TIP_MEAN = f"{mean('tip')} as mean_tip"

ORACLE |= {
    "tile_volume": tile("year_month, service_group", TRIP_SUM),
    "tile_district_taxi": tile("year_month, pickup_district", TRIP_SUM, "service_group = 'TAXI'"),
    "tile_district_app": tile("year_month, pickup_district", TRIP_SUM, "service_group = 'APP'"),
    "tile_time_band": tile("time_band, service_group", TRIP_SUM),
    "tile_tip_rate": tile("year_month, service_group", f"{mean('tip_flag')} as mean_tip_flag"),
    "tile_tip_mean": tile("service_group", TIP_MEAN),
    "tile_tip_by_band_hour": tile("distance_band, time_band", TIP_SUM),
    "tile_tip_by_band_region": tile("distance_band, pickup_region_group", TIP_SUM),
    "tile_tip_era": tile("year_month, service_group", TIP_MEAN),
    "tile_region_mix": tile("year_month, pickup_region_group", TRIP_SUM),
    "tile_core_volume": tile(
        "year_month, service_group", TRIP_SUM, "pickup_region_group = 'CORE' and year in ('1999', '2000', '2001')"
    ),
    "tile_time_band_filtered": tile(
        "time_band, service_group",
        TRIP_SUM,
        "service_group = 'TAXI' and pickup_district in ('ASIA', 'EUROPE') and year_month between '1997-06' and '1998-03'",
    ),
    "tile_tip_heat_map": tile("distance_band", ", ".join(
        f"cast(sum(cast(tip as decimal(18,2))) filter (time_band = '{label}') as double) as {label.lower().replace(' ', '_')}"
        for label in ("OVERNIGHT", "AM PEAK", "MORNING", "MIDDAY", "AFTERNOON", "PM PEAK", "NIGHT")
    )),
    "check_row_counts": f"""with {STAR} select 'fact_trip' as table_name, count(*) as total_rows from fact
        union all select 'dim_service', count(*) from service
        union all select 'dim_operator', count(*) from operators
        union all select 'dim_place', count(*) from place
        union all select 'dim_distance_band', count(*) from distance_dim
        union all select 'dim_time_band', count(*) from time_dim
        union all select 'dim_tip_status', count(*) from yes_no
        union all select 'dim_congestion_status', count(*) from yes_no""",
    "check_recent_months": f"""with {STAR} select year_month, count(*) as total_trips from fact
        where year = 1998 group by year_month""",
    "check_orphans": f"""with {STAR}, roles as (
          select 'pickup' as role, pickup_place_id as id from fact
          union all select 'dropoff', dropoff_place_id from fact)
        select role, count(*) filter (place_id is null and id <> 0) as orphan_trips,
               count(*) filter (place_id is null and id = 0) as no_place_trips
        from roles left join place on id = place_id group by role""",
}

ORACLE |= {f"summary_{name}": sql for name, sql in ORACLE.items() if name in ADDITIVE}
ORACLE["summary_states"] = f"""with {FACT} select year, service_id, count(*) as total_trips, {money("fare")} as total_fare,
    count(tip) as valued_tips, {mean("tip")} as mean_tip from fact group by year, service_id"""
