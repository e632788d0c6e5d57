"""Each query's result in SQL, written straight from the given tables.

The SQL states the wanted values; it knows nothing of day numbers, text dates,
label text or CSV, which is what the queries have to get through.
"""

from __future__ import annotations

_CODES = ["AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA",
          "KS", "KY", "LA", "ME", "MD", "TX", "WA", "NY", "OH", "PR", "XX", "YY", "ZZ"]


def _code(number: str) -> str:
    return f"({_CODES})[cast({number} as integer) + 1]"


_FACT = f"""
fact as (
  select
    cast(o_orderkey as integer) as i94_key,
    cast(o_custkey % 30 as integer) as res_region_key,
    cast(o_custkey % 25 as integer) as cit_region_key,
    'P' || o_custkey as port_key,
    cast(o_orderdate as date) as arrival_date,
    cast(year(o_orderdate) as integer) as i94yr,
    cast(month(o_orderdate) as integer) as i94mon,
    cast(case when o_orderkey % 11 = 0 then null when o_orderstatus = 'F' then 1
              when o_orderstatus = 'O' then 2 else 3 end as integer) as i94mode_key,
    {_code('o_custkey % 28')} as state_code,
    case when o_orderkey % 7 <> 0
         then cast(o_orderdate as date) + cast(o_orderkey % 30 as integer) end as departure_date,
    cast(18 + o_orderkey % 60 as integer) as age,
    cast(left(o_orderpriority, 1) as integer) as visa_key,
    cast(1 as integer) as i94_count,
    case when o_orderkey % 13 <> 0 then cast(o_orderdate as date) end as i94_file_date,
    case when o_orderkey % 50 = 0 then 'STU' end as occup,
    cast(year(o_orderdate) - 18 - o_orderkey % 60 as integer) as biryear,
    case when o_orderkey % 10 <> 0 and o_orderkey % 17 <> 0
         then cast(o_orderdate as date) + 90 end as i94_leave_date,
    case when o_orderkey % 2 = 0 then 'F' else 'M' end as gender,
    case when o_orderkey % 9 = 0 then cast(o_orderkey as varchar) end as insnum,
    o_orderpriority as airline,
    o_orderkey || case when o_orderkey % 3 = 0 then '.05' else '' end as i94_admin_num,
    lpad(cast(o_custkey % 1000 as varchar), 5, '0') as fltno,
    'B' || left(o_orderpriority, 1) as visatype
  from orders)"""

# The fact after its reloaded month was corrected.
_CORRECTED = """
corrected as (
  select state_code, visa_key, i94yr, i94mon,
    case when i94yr = 1998 and i94mon = 5 then 2 else 1 end as people
  from fact where not (i94yr = 1998 and i94mon = 5) or i94_key % 2 = 0)"""

_CALENDAR = """
calendar as (
  select distinct arrival_date,
    cast(day(arrival_date) as integer) as day,
    cast(weekofyear(arrival_date) as integer) as week,
    cast(month(arrival_date) as integer) as month,
    cast(year(arrival_date) as integer) as year,
    cast(dayofweek(arrival_date) + 1 as integer) as weekday
  from fact)"""

_PORTS = f"""
ports as (
  select p_partkey as number, 'P' || p_partkey as code, upper(p_name) as name,
    {_code('p_partkey % 28')} as own_state, p_partkey % 28 < 25 as known, p_partkey % 20 as shape
  from part),
us_ports as (
  select code,
    case shape when 4 then 'WA' when 5 then 'TX' when 7 then 'NY' when 10 then 'OH'
         else own_state end as state,
    case shape when 4 then 'BELLINGHAM WASHINGTON' when 5 then 'PASO DEL NORTE'
         when 6 then 'INTL ' || name when 7 then 'LA ' || name
         when 10 then 'PUT IN BAY ' || name when 11 then name || ' BPS'
         else name end as address
  from ports
  where shape in (4, 5, 7, 10) or (shape not in (0, 1, 2, 3, 9) and known))"""

# The printed label of a port, with the doubled quote already gone.
_PORT_LABELS = """
port_labels as (
  select number, code,
    case shape
      when 0 then 'No PORT Code (' || code || ')'
      when 1 then 'Collapsed (' || code || ') 06/15'
      when 2 then 'UNIDENTIFED AIR / SEAPORT'
      when 3 then 'UNKNOWN POE'
      when 4 then 'BELLINGHAM, WASHINGTON #INTL'
      when 5 then 'PASO DEL NORTE,TX'
      when 6 then 'INTL ' || name || ', ' || own_state
      when 7 then 'LA ' || name || ', NY'
      when 8 then name || '/' || own_state
      when 9 then name || ', CANADA'
      when 10 then 'PUT-IN-BAY ' || name || ', OH'
      when 11 then name || ', ' || own_state || ' (BPS)'
      else name || ', ' || own_state end as label
  from ports)"""

_STAGING = f"""
staging as (
  select number, code, label as value, 'port' as type from port_labels
  union all select c_custkey, cast(c_custkey as varchar), c_name, 'country' from customer
  union all select n_nationkey, {_code('n_nationkey')}, n_name, 'state' from nation
  union all select r_regionkey, cast(r_regionkey + 1 as varchar), r_name, 'i94_mode' from region
  union all select r_regionkey, cast(r_regionkey + 1 as varchar),
                   r_name, 'visa' from region)"""

_CITIES = f"""
cities as (
  select 'City ' || (c_custkey // 3) as city,
    'State ' || ((c_custkey // 3) % 25) as state,
    20.5 + (c_custkey // 3) % 40 as median_age,
    1000 + (c_custkey // 3) % 9000 as male_population,
    case when (c_custkey // 3) % 37 <> 0 then 1200 + (c_custkey // 3) % 7000 end
      as female_population,
    2200 + (c_custkey // 3) % 9000 + (c_custkey // 3) % 7000 as total_population,
    (c_custkey // 3) % 500 as number_of_veterans,
    (c_custkey // 3) % 800 as foreign_born,
    2 + ((c_custkey // 3) % 4) * 0.25 as average_household_size,
    {_code('(c_custkey // 3) % 25')} as state_code,
    'Race ' || (c_custkey % 3) as race
  from customer)"""

_CITY_COLUMNS = """
  city, state, cast(median_age as double) as median_age,
  cast(male_population as integer) as male_population,
  cast(female_population as integer) as female_population,
  cast(total_population as integer) as total_population,
  cast(number_of_veterans as integer) as number_of_veterans,
  cast(foreign_born as integer) as foreign_born,
  cast(average_household_size as double) as average_household_size,
  state_code, race"""

_DIMS = f"""
dim_country as (select n_nationkey as region_key, n_name as region_name from nation),
dim_state as (select {_code('n_nationkey')} as state_code, n_name as state from nation),
dim_mode as (select r_regionkey + 1 as i94mode_key, r_name as i94mode from region),
dim_visa as (select r_regionkey + 1 as visa_key, r_name as visa_broad_type from region),
dim_port as (select 'P' || p_partkey as port_key, {_code('p_partkey % 25')} as state,
                    upper(p_name) as address from part)"""

_FACT_COLUMNS = """
  i94_key, res_region_key, cit_region_key, port_key,
  cast(arrival_date as varchar) as arrival_date, i94yr, i94mon, i94mode_key, state_code,
  cast(departure_date as varchar) as departure_date, age, visa_key, i94_count,
  cast(i94_file_date as varchar) as i94_file_date, occup, biryear,
  cast(i94_leave_date as varchar) as i94_leave_date, gender, insnum, airline,
  i94_admin_num, fltno, visatype"""

_FACT_ROWS = f"with {_FACT} select {_FACT_COLUMNS} from fact"

_CALENDAR_ROWS = f"""
with {_FACT}, {_CALENDAR}
select cast(arrival_date as varchar) as arrival_date, day, week, month, year, weekday
from calendar"""


def _check(table: str, check: str, passed: str, value: str, fault: str, source: str) -> str:
    return f"""
select '{table}' as table_name, '{check}' as check_name, {passed} as passed,
  cast({value} as bigint) as value,
  case when {passed} then 'passed' else '{fault}' end as detail
from {source}"""


def _not_empty(table: str, source: str) -> str:
    return _check(table, "not_empty", "count(*) > 0", "count(*)", "the table is empty", source)


def _year_check(year: int) -> str:
    return _check("fact_i94", "entry_year_not_future", f"max(i94yr) <= {year}", "max(i94yr)",
                  "entries from a year to come", "fact")


_DATE_CHECK = _check("dim_time", "arrival_date_not_null",
                     "count(*) filter (arrival_date is null) = 0",
                     "count(*) filter (arrival_date is null)",
                     "arrival_date is missing in some rows", "calendar")


def _dim_checks(table: str, key: str, source: str, column: str) -> str:
    """The checks of a label dimension whose key comes from `column` of `source`."""
    twice = f"count({column}) - count(distinct {column})"
    missing = f"count(*) filter ({column} is null)"
    return " union all ".join([
        _not_empty(table, source),
        _check(table, f"{key}_not_null", f"{missing} = 0", missing,
               f"{key} is missing in some rows", source),
        _check(table, f"{key}_unique", f"{twice} = 0", twice, f"{key} occurs more than once",
               source)])


def _no_verdict(table: str, check: str, value: str) -> str:
    return (f"select '{table}', '{check}', cast(null as boolean), cast({value} as bigint), "
            "'not evaluated: the table is empty'")


def _orphans(fact_key: str, dim: str, dim_key: str) -> str:
    return f"""
select '{fact_key}' as fact_key, cast(f.{fact_key} as varchar) as key,
  cast(count(*) as bigint) as entries
from fact f
where f.{fact_key} is not null
  and not exists (select 1 from {dim} d where d.{dim_key} = f.{fact_key})
group by f.{fact_key}"""


def _rejects() -> str:
    def row(column: str, present: str = "count(*)", mark: str = "0", lost: str = "0") -> str:
        return (f"select '{column}' as column_name, cast({present} as bigint) as present, "
                f"cast({mark} as bigint) as no_date_mark, cast({lost} as bigint) as rejected "
                "from orders")
    whole = ["i94_key", "res_region_key", "cit_region_key", "arrival_date", "i94yr", "i94mon",
             "age", "visa_key", "i94_count", "biryear"]
    return " union all ".join([
        *[row(column) for column in whole],
        row("i94mode_key", present="count(*) filter (o_orderkey % 11 <> 0)"),
        row("departure_date", present="count(*) filter (o_orderkey % 7 <> 0)"),
        row("i94_file_date", lost="count(*) filter (o_orderkey % 13 = 0)"),
        row("i94_leave_date", mark="count(*) filter (o_orderkey % 10 = 0)",
            lost="count(*) filter (o_orderkey % 10 <> 0 and o_orderkey % 17 = 0)"),
    ])


def _demographics_rejects() -> str:
    """A broken line adds one of its own; lines that go on are broken themselves."""
    def row(column: str, present: str = "count(*)", lost: str = "0") -> str:
        return (f"select '{column}' as column_name, cast({present} as bigint) as present, "
                f"cast(0 as bigint) as no_date_mark, cast({lost} as bigint) as rejected "
                "from customer")
    broken = ("count(*) filter (c_custkey % 41 = 0) + "
              "count(*) filter (c_custkey % 41 <> 0 and c_custkey % 43 = 0)")
    return " union all ".join([
        *[row(column) for column in ("median_age", "male_population", "total_population",
                                     "foreign_born", "average_household_size")],
        row("female_population", lost="count(*) filter ((c_custkey // 3) % 37 = 0)"),
        row("number_of_veterans",
            lost="count(*) filter (c_custkey % 47 = 0 or c_custkey % 53 = 0)"),
        row("_corrupt_record", present=broken, lost=broken),
    ])


ORACLES = {
    "fact_entries": _FACT_ROWS,
    "entries_parquet": _FACT_ROWS,
    "entries_csv": _FACT_ROWS,
    "fact_write": _FACT_ROWS,
    "sas_date": f"""
with {_FACT}
select cast(i94_key as bigint) as entry, cast(arrival_date as varchar) as arrival,
  cast(departure_date as varchar) as departure
from fact""",
    "text_dates": f"""
with {_FACT}
select cast(i94_key as bigint) as entry, cast(i94_file_date as varchar) as filed,
  cast(i94_leave_date as varchar) as leave_by
from fact""",
    "calendar_dim": _CALENDAR_ROWS,
    "calendar_write": _CALENDAR_ROWS,
    "reject_counts": _rejects(),
    "fact_month_reload": f"""
with {_FACT}
select i94yr, i94mon,
  cast(sum(case when i94yr = 1998 and i94mon = 5 then 2 else 1 end) as bigint) as people,
  cast(count(*) as bigint) as entries
from fact group by i94yr, i94mon""",
    "csv_roundtrip": "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
    "label_blocks": f"""
with {_PORTS}, {_PORT_LABELS}, {_STAGING}
select type, cast(count(distinct number // 1000) as bigint) as blocks from staging group by type""",
    "label_block_faults": f"""
with {_PORTS}, {_PORT_LABELS}, {_STAGING},
sources as (select distinct number // 1000 as batch from staging),
types as (select distinct type from staging)
select 'labels-' || batch as source, type, cast(0 as bigint) as blocks
from sources, types
where not exists (select 1 from staging s
                  where s.type = types.type and s.number // 1000 = sources.batch)""",
    "label_parse": f"""
with {_PORTS}, {_PORT_LABELS}, {_STAGING} select code, value, type from staging""",
    "label_union": f"""
with {_PORTS}, {_PORT_LABELS}, {_STAGING}
select 'labels-' || (number // 1000) as source, type, cast(count(*) as bigint) as entries,
  min(value) as first_value, max(value) as last_value
from staging group by all""",
    "label_dim_split": f"""
select 'dim_country' as table_name, cast(c_custkey as varchar) as key, c_name as label
from customer
union all select 'dim_i94_mode', cast(r_regionkey + 1 as varchar), r_name from region
union all select 'dim_state', {_code('n_nationkey')}, n_name from nation
union all select 'dim_visa', cast(r_regionkey + 1 as varchar), r_name from region""",
    "label_rejects": """
select 'labels-' || (c_custkey // 1000) as source, 'country' as type,
  cast(count(*) as bigint) as entries,
  cast(count(*) filter (c_custkey % 97 = 0) as bigint) as rejected
from customer group by source having count(*) filter (c_custkey % 97 = 0) > 0
union all
select 'labels-' || (n_nationkey // 1000), 'state', cast(count(*) as bigint),
  cast(count(*) filter (n_nationkey % 5 = 0) as bigint)
from nation group by all""",
    "sentinel_override": f"""
with {_PORTS}, {_PORT_LABELS}
select code,
  case when shape in (0, 1, 2, 3) then 'NA, NA'
       when shape = 4 then 'BELLINGHAM, WASHINGTON WA'
       when shape = 5 then 'PASO DEL NORTE, TX'
       when shape = 6 then replace(label, 'INTL ', 'INT''''L ')
       else label end as label
from port_labels join ports using (number, code)""",
    "port_us_filter": f"with {_PORTS} select code, state from us_ports",
    "port_dim": f"with {_PORTS} select code as port_key, state, address from us_ports",
    "surrogate_key": """
select c_custkey, c_name, cast(row_number() over (order by c_custkey) - 1 as bigint) as customer_no
from customer""",
    "surrogate_key_hot": """
with numbered as (
  select o_orderstatus, row_number() over (order by o_orderstatus, o_orderkey) - 1 as order_no
  from orders)
select o_orderstatus, cast(min(order_no) as bigint) as first_no,
  cast(max(order_no) as bigint) as last_no, cast(count(*) as bigint) as n,
  cast(sum(order_no) as bigint) as sum_no
from numbered group by o_orderstatus""",
    "demographics_project": f"with {_CITIES} select {_CITY_COLUMNS} from cities",
    "demographics_fact": f"""
with {_CITIES}
select {_CITY_COLUMNS},
  cast(row_number() over (order by state_code, city, race) - 1 as bigint) as demo_key
from cities""",
    "job_demographics": f"""
with {_CITIES}
select {_CITY_COLUMNS},
  cast(row_number() over (order by state_code, city, race) - 1 as bigint) as demo_key
from cities""",
    "demographics_rejects": _demographics_rejects(),
    "quality_fact": f"with {_FACT} {_not_empty('fact_i94', 'fact')} union all {_year_check(1999)}",
    "quality_calendar": f"""
with {_FACT}, {_CALENDAR} {_not_empty('dim_time', 'calendar')} union all {_DATE_CHECK}""",
    "quality_dims": f"""
with {_PORTS} {_dim_checks('dim_port', 'port_key', 'us_ports', 'code')}
union all {_dim_checks('dim_country', 'region_key', 'customer', 'c_custkey')}
union all {_dim_checks('dim_i94_mode', 'i94mode_key', 'region', 'r_regionkey')}
union all {_dim_checks('dim_state', 'state_code', 'nation', 'n_nationkey')}
union all {_dim_checks('dim_visa', 'visa_key', 'region', 'r_regionkey')}""",
    "quality_report": f"""
with {_FACT}, {_CALENDAR}
{_not_empty('fact_i94', 'fact')} union all {_year_check(2016)}
union all {_not_empty('dim_time', 'calendar')} union all {_DATE_CHECK}
union all {_not_empty('fact_demographics', 'customer')}
union all {_dim_checks('dim_country', 'region_key', 'nation', 'n_nationkey')}
union all {_dim_checks('dim_state', 'state_code', 'nation', 'n_nationkey')}
union all {_dim_checks('dim_i94_mode', 'i94mode_key', 'region', 'r_regionkey')}
union all {_dim_checks('dim_visa', 'visa_key', 'region', 'r_regionkey')}
union all {_dim_checks('dim_port', 'port_key', 'part', 'p_partkey')}""",
    "quality_failures": f"""
with {_FACT}, {_CALENDAR}, {_DIMS},
broken_country as (select nullif(region_key, 0) as region_key from dim_country),
broken_state as (select * from dim_state union all select * from dim_state),
broken_time as (select arrival_date from calendar union all select null),
no_visa as (select * from dim_visa where visa_key < 0)
{_not_empty('fact_i94', 'fact')} union all {_year_check(1999)}
union all {_not_empty('dim_time', 'broken_time')}
union all {_DATE_CHECK.replace('from calendar', 'from broken_time')}
union all {_dim_checks('dim_country', 'region_key', 'broken_country', 'region_key')}
union all {_dim_checks('dim_state', 'state_code', 'broken_state', 'state_code')}
union all {_not_empty('dim_visa', 'no_visa')}
union all {_no_verdict('dim_visa', 'visa_key_not_null', '0')}
union all {_no_verdict('dim_visa', 'visa_key_unique', '0')}
union all {_dim_checks('dim_port', 'port_key', 'dim_port', 'port_key')}""",
    "job_fact": _FACT_ROWS,
    "job_fact_months": f"""
with {_FACT}
select i94yr, i94mon, cast(count(*) as bigint) as people, cast(count(*) as bigint) as entries
from fact group by i94yr, i94mon""",
    "job_calendar": _CALENDAR_ROWS,
    "job_calendar_reload": f"""
with {_FACT}, {_CALENDAR}, kept as (
  select distinct arrival_date from fact
  where not (i94yr = 1998 and i94mon = 5)
    or (i94_key % 4 = 0 and (arrival_date - date '1960-01-01') % 5 = 0))
select cast(arrival_date as varchar) as arrival_date, day, week, month, year, weekday
from calendar where arrival_date in (select arrival_date from kept)""",
    "rollup_by_month_counts": f"""
with {_FACT}, {_CORRECTED}
select state_code, visa_key, i94yr, cast(sum(people) as bigint) as people,
  cast(count(*) as bigint) as entries,
  cast(grouping(state_code, visa_key, i94yr) as integer) as level
from corrected group by rollup (state_code, visa_key, i94yr)""",
    "growth_by_month_counts": f"""
with {_FACT}, {_CORRECTED},
monthly as (select state_code, i94yr, i94mon, cast(sum(people) as bigint) as people
            from corrected group by state_code, i94yr, i94mon)
select a.state_code, a.i94yr, a.i94mon, a.people, b.people as people_before,
  a.people - b.people as change
from monthly a left join monthly b on a.state_code = b.state_code
  and a.i94yr * 12 + a.i94mon = b.i94yr * 12 + b.i94mon + 1""",
    "entry_reject_rows": f"""
with {_FACT}
select i94_key, i94yr, i94mon, 'i94_file_date' as column_name, '20161301' as raw
from fact where i94_key % 13 = 0
union all
select i94_key, i94yr, i94mon, 'i94_leave_date', '1232016'
from fact where i94_key % 10 <> 0 and i94_key % 17 = 0""",
    "load_ledger": f"""
with {_FACT}, months as (
  select i94yr, i94mon, case when i94yr < 1998 then 'early' else 'late' end as part,
    sum(cast(i94_key % 13 = 0 as integer)
        + cast(i94_key % 10 <> 0 and i94_key % 17 = 0 as integer)) as own
  from fact group by i94yr, i94mon)
select i94yr, i94mon, part, cast(count(*) over (partition by part) as bigint) as months,
  cast(sum(own) over (partition by part) as bigint) as lost
from months""",
    "job_labels": f"""
with {_PORTS}
select 'dim_country' as table_name, cast(c_custkey as varchar) as key, c_name as label
from customer
union all select 'dim_i94_mode', cast(r_regionkey + 1 as varchar), r_name from region
union all select 'dim_state', {_code('n_nationkey')}, n_name from nation
union all select 'dim_visa', cast(r_regionkey + 1 as varchar), r_name from region
union all select 'dim_port', code, state || ' ' || address from us_ports""",
    "job_check": f"""
with {_FACT}, {_CALENDAR}, {_PORTS}
{_not_empty('fact_i94', 'fact')} union all {_year_check(2016)}
union all {_not_empty('dim_time', 'calendar')} union all {_DATE_CHECK}
union all {_not_empty('fact_demographics', 'customer')}
union all {_dim_checks('dim_country', 'region_key', 'customer', 'c_custkey')}
union all {_dim_checks('dim_state', 'state_code', 'nation', 'n_nationkey')}
union all {_dim_checks('dim_i94_mode', 'i94mode_key', 'region', 'r_regionkey')}
union all {_dim_checks('dim_visa', 'visa_key', 'region', 'r_regionkey')}
union all {_dim_checks('dim_port', 'port_key', 'us_ports', 'code')}""",
    "star_count": f"""
with {_FACT}, {_DIMS}
select f.state_code, f.visa_key, i94yr, i94mon, s.state, v.visa_broad_type,
  cast(sum(i94_count) as bigint) as people, cast(count(*) as bigint) as entries
from fact f left join dim_state s on f.state_code = s.state_code
  left join dim_visa v on f.visa_key = v.visa_key
group by all""",
    "port_count": f"""
with {_FACT}, {_DIMS}
select f.port_key, i94yr, p.state as port_state, p.address as port_address,
  cast(sum(i94_count) as bigint) as people, cast(count(*) as bigint) as entries
from fact f left join dim_port p on f.port_key = p.port_key
group by all""",
    "star_join": f"""
with {_FACT}, {_CALENDAR}, {_DIMS}
select i94_key, cit_region_key, res_region_key, f.port_key, f.i94mode_key, f.state_code,
  f.visa_key, cast(f.arrival_date as varchar) as arrival_date,
  c.region_name as citizenship, r.region_name as residence,
  p.state as port_state, p.address as port_address, m.i94mode, s.state, v.visa_broad_type,
  t.day, t.week, t.month, t.year, t.weekday
from fact f
  left join dim_country c on f.cit_region_key = c.region_key
  left join dim_country r on f.res_region_key = r.region_key
  left join dim_port p on f.port_key = p.port_key
  left join dim_mode m on f.i94mode_key = m.i94mode_key
  left join dim_state s on f.state_code = s.state_code
  left join dim_visa v on f.visa_key = v.visa_key
  left join calendar t on f.arrival_date = t.arrival_date""",
    "star_join_clustered": f"""
with {_FACT}, {_DIMS}
select i94_key, f.port_key, f.state_code, f.visa_key, p.state as port_state, p.address as port_address
from fact f left join dim_port p on f.port_key = p.port_key""",
    "star_rollup": f"""
with {_FACT}
select state_code, visa_key, i94yr, cast(sum(i94_count) as bigint) as people,
  cast(count(*) as bigint) as entries,
  cast(grouping(state_code, visa_key, i94yr) as integer) as level
from fact group by rollup (state_code, visa_key, i94yr)""",
    "per_capita": f"""
with {_FACT}, {_CITIES},
people as (select state_code, count(*) as people from fact group by state_code),
residents as (
  select state_code, sum(total_population) as total_population
  from (select distinct state_code, city, total_population from cities) group by state_code)
select state_code, cast(people as bigint) as people,
  cast(total_population as bigint) as total_population,
  round(people * 1000.0 / cast(total_population as double), 6) as per_thousand
from people left join residents using (state_code)""",
    "unknown_member": f"""
with {_FACT}, {_DIMS}
select i94_key, coalesce(s.state_code, '99') as state_code
from fact f left join dim_state s on f.state_code = s.state_code""",
    "orphan_keys": f"""
with {_FACT}, {_DIMS}
{_orphans('cit_region_key', 'dim_country', 'region_key')}
union all {_orphans('res_region_key', 'dim_country', 'region_key')}
union all {_orphans('i94mode_key', 'dim_mode', 'i94mode_key')}
union all {_orphans('state_code', 'dim_state', 'state_code')}
union all {_orphans('visa_key', 'dim_visa', 'visa_key')}
union all {_orphans('port_key', 'dim_port', 'port_key')}""",
    "topk_destinations": f"""
with {_FACT}, {_DIMS},
top as (select state_code, cast(count(*) as bigint) as people from fact
        group by state_code order by people desc, state_code limit 10)
select top.state_code, s.state, people, people as entries
from top left join dim_state s on top.state_code = s.state_code""",
    "topk_ports_per_visa": f"""
with {_FACT}, {_DIMS},
counted as (select visa_key, port_key, cast(count(*) as bigint) as people
            from fact group by visa_key, port_key),
placed as (select *, cast(row_number() over (
             partition by visa_key order by people desc, port_key) as integer) as place
           from counted)
select c.visa_key, c.port_key, people, people as entries, place, v.visa_broad_type,
  p.state as port_state, p.address as port_address
from placed c left join dim_visa v on c.visa_key = v.visa_key
  left join dim_port p on c.port_key = p.port_key
where place <= 5""",
    "mom_growth": f"""
with {_FACT},
monthly as (select state_code, i94yr, i94mon, cast(count(*) as bigint) as people
            from fact group by state_code, i94yr, i94mon)
select a.state_code, a.i94yr, a.i94mon, a.people, b.people as people_before,
  a.people - b.people as change
from monthly a left join monthly b on a.state_code = b.state_code
  and a.i94yr * 12 + a.i94mon = b.i94yr * 12 + b.i94mon + 1""",
}
