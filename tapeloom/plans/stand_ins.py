"""Feed-like relations made of the `events` table: thirty days pressed into one, users as locates. Times are without zone, as in the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

B_SPARK = """
select event_id, cast(user_id % 20 as int) + 1 as locate, event_type,
  ((datediff(cast(ts as date), date'2024-01-01') * 24 + hour(ts)) * bigint(3600000000) + minute(ts) * bigint(60000000) + cast(extract(second from ts) * 1000000 as bigint)) * 1000 div 30 as ts_ns,
  cast(get_json_object(props, '$.k') as bigint) as k, cast(round(value * 100) as bigint) as v, event_id div 20 as n20
from {events}"""

B_DUCK = """
select event_id, cast(user_id % 20 as int) + 1 as locate, event_type,
  (epoch_us(ts) - 1704067200000000) * 1000 // 30 as ts_ns,
  cast(json_extract_string(props, '$.k') as bigint) as k, cast(round(value * 100) as bigint) as v, event_id // 20 as n20
from events"""

TABLES = {
    "fx_l1": """
select event_id as seq, ts_ns, locate,
  case when k % 23 = 0 or k % 29 = 0 then 0 else 990000 - 100 * (k % 7) end as bid_px,
  case when k % 29 = 0 then 0 when k % 31 = 0 then 990000 - 100 * (k % 7) else 990000 - 100 * (k % 7) + 100 * (1 + v % 3) end as ask_px,
  case when k % 23 = 0 or k % 29 = 0 then 0 else 100 + v end as bid_sz,
  case when k % 29 = 0 then 0 else 100 + (v * 7) % 4000 end as ask_sz
from b""",
    "fx_prints": """
select event_id as seq, ts_ns, locate, cast(v % 4 as int) as kind,
  case when v % 4 = 3 and k % 3 = 0 then 0 else 990000 + 100 * (k % 9) end as price,
  case when v % 4 = 3 and k % 3 = 0 then 0 else 100 * (1 + v % 40) end as shares,
  case when v % 4 = 3 then '' when k % 2 = 0 then 'B' else 'S' end as side
from b""",
    "fx_ops": """
with t as (
  select *, case when event_type in ('signup', 'click', 'view') then 'A'
    when event_type = 'purchase' then case k % 5 when 0 then 'X' when 1 then 'C' else 'E' end
    else case when k % 4 = 0 then 'U' else 'D' end end as ty
  from b),
n as (
  select *, sum(case when ty in ('A', 'U') then 1 else 0 end) over
    (partition by locate order by event_id rows between unbounded preceding and 1 preceding) as n_prev
  from t),
a as (
  select locate, event_id as add_ref, row_number() over (partition by locate order by event_id) as rn
  from t where ty in ('A', 'U'))
select 2 * n.event_id as seq, n.locate, n.ts_ns, n.ty,
  case when n.ty = 'A' then n.event_id else a.add_ref end as ref,
  case when n.ty = 'U' then n.event_id end as new_ref,
  case when n.ty = 'A' and k % 50 = 49 then 4026531840 when n.ty in ('A', 'U') then 100 * (1 + v % 9) when n.ty in ('E', 'C', 'X') then 100 * (1 + v % 4) end as shares,
  case when n.ty = 'A' then 990000 + (case when k % 2 = 0 then -100 * (v % 12) else 100 + 100 * (v % 12) end)
       when n.ty = 'U' then 990000 + 100 * (v % 3) when n.ty = 'C' then 990050 end as price,
  case when n.ty = 'A' then case when k % 2 = 0 then 'B' else 'S' end end as side,
  case when n.ty = 'C' then case when k % 2 = 0 then 'N' else 'Y' end end as printable
from n left join a on n.locate = a.locate and n.ty <> 'A' and a.rn = n.n_prev - (k % 3)""",
    "fx_twice": """
select event_id as seq, locate, ts_ns, case v % 7 when 0 then 'E' when 1 then 'X' when 2 then 'D' else 'A' end as ty, locate * 1000 + k as ref, cast(null as bigint) as new_ref,
  case when v % 7 = 2 then cast(null as bigint) else 100 * (1 + v % 5) end as shares, case when v % 7 > 2 then 990000 + 100 * (v % 11) else cast(null as bigint) end as price,
  case when v % 7 > 2 then case when k % 2 = 0 then 'B' else 'S' end else cast(null as varchar(1)) end as side, cast(null as varchar(1)) as printable
from b""",
    "fx_more": """
select cast(locate as bigint) - 1000 as seq, cast(0 as bigint) as ts_ns, locate, 'R' as ty, concat('OLD', cast(locate as varchar(4))) as stock, cast(null as varchar(1)) as state, cast(null as bigint) as shares, cast(null as bigint) as price, cast(null as varchar(1)) as side
from (select distinct locate from b) r
union all
select cast(locate as bigint) - 500, cast(0 as bigint), locate, 'R', concat('SYM', lpad(cast(locate as varchar(4)), 2, '0')), cast(null as varchar(1)), cast(null as bigint), cast(null as bigint), cast(null as varchar(1))
from (select distinct locate from b where locate < 20) r
union all
select 2 * event_id + 1, ts_ns, cast(event_id % 20 as int) + 1, case n20 % 40 when 3 then 'Q' when 7 then 'P' else 'H' end,
  case when k % 31 = 5 then 'ODD' when event_id % 20 + 1 < 20 then concat('SYM', lpad(cast(event_id % 20 + 1 as varchar(4)), 2, '0')) else 'OLD20' end,
  case n20 % 40 when 0 then 'T' when 25 then 'H' end, case n20 % 40 when 3 then case when k % 2 = 0 then 5000000000 else 100 * (k % 9) end when 7 then 100 * (1 + v % 9) end,
  case when n20 % 40 in (3, 7) then 990000 + 100 * (v % 5) end, case when n20 % 40 = 7 then case when k % 17 = 3 then '?' when k % 2 = 0 then 'B' else 'S' end end
from b where n20 % 40 in (0, 3, 7, 25)""",
    "fx_closes": """
select locate, concat('SYM', lpad(cast(locate as varchar(4)), 2, '0')) as symbol, case when locate % 6 = 0 then cast(null as double) else (990000 + 100 * (locate % 9)) / 1e4 end as price_usd, cast(100 * locate as bigint) as shares,
  case when locate % 5 = 0 then cast(null as double) when locate % 3 = 0 then 5e0 * (990000 + 100 * (locate % 9)) / 1e4 when locate % 7 = 0 then 1e0 else (990000 + 100 * (locate % 9)) / 1e4 end as official
from (select distinct locate from b) r""",
    "fx_ctl": """
select 2 * event_id + 1 as seq, cast(event_id % 20 as int) + 1 as locate, ts_ns,
  case when n20 % 40 = 3 then 'Q' else 'H' end as ty,
  case n20 % 40 when 0 then 'T' when 25 then 'H' end as state
from b where n20 % 40 in (0, 3, 25)""",
    "fx_symbols": """
select distinct locate, concat('SYM', lpad(cast(locate as varchar(4)), 2, '0')) as symbol
from b where locate < 20""",
}


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as all stand-ins take them."""
    return spark.sql(B_SPARK, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table for Spark; unaffected by other views of the session."""
    b = base(spark, sf_dir)
    sql = TABLES[name]
    return spark.sql(sql.replace("from b", "from {b}"), b=b)


def duck(name: str, *more: str) -> str:
    """The WITH list of these stand-ins for DuckDB, without the word WITH."""
    return ", ".join([f"b as ({B_DUCK})"] + [f"{n} as ({TABLES[n]})" for n in (name, *more)])
