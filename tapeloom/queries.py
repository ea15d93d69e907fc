"""The feed queries by name, over stand-in tables made of `events`, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.functions.storage import fresh_path, stored
from tapeloom.functions.windows import asof
from tapeloom.operators import book, decode, verify
from tapeloom.plans import activity, export, liquidity, ofi
from tapeloom.plans.stand_ins import base, duck, table
from tapeloom.sources import records
from tapeloom.sources.frames import read_frames, scan_summary, write_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


# order-flow imbalance

EVENTS = """
, st as (select *, bid_px > 0 and ask_px > 0 and bid_px < ask_px as ok,
    lag(bid_px) over w as pb, lag(ask_px) over w as pa, lag(bid_sz) over w as pbs, lag(ask_sz) over w as pas
  from fx_l1 window w as (partition by locate order by seq)),
ev as (
  select locate, seq, ts_ns, ok and pb > 0 and pa > 0 and pb < pa as pair_ok,
    case when ok and pb > 0 and pa > 0 and pb < pa then
      (case when bid_px > pb then bid_sz when bid_px < pb then -pbs else bid_sz - pbs end)
      - (case when ask_px < pa then ask_sz when ask_px > pa then -pas else ask_sz - pas end) else 0 end as e
  from st where pb is not null),
rth as (select *, (ts_ns - 34200000000000) // 60000000000 as minute from ev where pair_ok and ts_ns >= 34200000000000 and ts_ns < 57600000000000)
"""
MINUTES_SQL = EVENTS + """
, sums as (select locate, minute, sum(e) as ofi, count(*) as events from rth group by all),
closes as (
  select locate, case when ts_ns < 34200000000000 then -1 else (ts_ns - 34200000000000) // 60000000000 end as minute,
    arg_max((bid_px + ask_px) / 2, seq) as mid
  from st where ok and ts_ns < 57600000000000 group by all),
grid as (select locate, minute from (select distinct locate from fx_l1), range(-1, 390) r(minute)),
filled as (
  select g.locate, g.minute, coalesce(ofi, 0) as ofi, coalesce(events, 0) as events,
    last_value(mid ignore nulls) over (partition by g.locate order by g.minute) as mid_close
  from grid g left join closes c on c.locate = g.locate and c.minute = g.minute left join sums s on s.locate = g.locate and s.minute = g.minute),
lagged as (select *, lag(mid_close) over (partition by locate order by minute) as prev from filled),
mins as (select locate, cast(minute as int) as minute, cast(ofi as bigint) as ofi, cast(events as bigint) as events, mid_close,
    (mid_close - prev) / 100 as chg_ticks, (mid_close - prev) / prev * 1e4 as chg_bps from lagged where minute >= 0)
"""


@query(f"with {duck('fx_l1')} {EVENTS} select locate, seq, ts_ns, cast(e as bigint) as e, pair_ok from ev")
def ofi_events(spark, sf_dir):
    return ofi.ofi_events(table(spark, sf_dir, "fx_l1"))


@query(f"""with {duck('fx_l1')} {EVENTS},
x as (select locate, count(*) filter (pair_ok) as events, count(*) filter (not pair_ok) as skipped, sum(e) as total_ofi from ev where ts_ns >= 34200000000000 and ts_ns < 57600000000000 group by locate),
y as (select locate, count(*) as n_rows, count(*) filter (bid_px = 0 or ask_px = 0) as n_empty, count(*) filter (bid_px > 0 and ask_px > 0 and bid_px >= ask_px) as n_crossed from fx_l1 group by locate)
select y.*, coalesce(events, 0) as events, coalesce(skipped, 0) as skipped, cast(coalesce(total_ofi, 0) as bigint) as total_ofi from y left join x using (locate)""")
def ofi_counts(spark, sf_dir):
    return ofi.event_counts(table(spark, sf_dir, "fx_l1"))


@query(f"with {duck('fx_l1')} {MINUTES_SQL} select locate, minute, ofi, events, mid_close, round(chg_ticks, 6) as chg_ticks, round(chg_bps, 6) as chg_bps from mins")
def ofi_1min(spark, sf_dir):
    return rounded(ofi.ofi_1min(table(spark, sf_dir, "fx_l1")))


@query(f"""with {duck('fx_l1')} {MINUTES_SQL},
f as (select locate, count(*) as n, regr_slope(chg_bps, ofi) as s, regr_intercept(chg_bps, ofi) as i, regr_r2(chg_bps, ofi) as r, regr_sxx(chg_bps, ofi) as sxx, regr_syy(chg_bps, ofi) as syy from mins where chg_bps is not null group by locate)
select locate, n, round(case when n > 2 and sxx > 0 and syy > 0 then s end * 1000, 6) as slope_1k, round(case when n > 2 and sxx > 0 and syy > 0 then i end, 6) as intercept, round(case when n > 2 and sxx > 0 and syy > 0 then r end, 6) as r2 from f""")
def ofi_fit_1min(spark, sf_dir):
    return rounded(ofi.ofi_fit_1min(table(spark, sf_dir, "fx_l1")).withColumn("slope_1k", F.col("slope") * 1000).drop("slope"))


# 97.5 per cent quantiles of Student's t, by degrees of freedom.
T_VALUES = "(12, 2.17881282966), (13, 2.16036865646), (14, 2.14478668792), (15, 2.13144954556), (16, 2.11990529922), (17, 2.10981557783), (18, 2.10092204024), (19, 2.09302405441), (20, 2.08596344727)"


def horizon_sql(horizons: str) -> str:
    return EVENTS + f"""
, hz as (select cast(unnest({horizons}) as bigint) as h),
sums as (select locate, h, (ts_ns - 34200000000000) // (h * 1000000000) as k, sum(e) as ofi from rth, hz group by all),
closes as (
  select locate, h, (ts_ns - 34200000000000) // (h * 1000000000) as k, arg_max((bid_px + ask_px) / 2, seq) as mid
  from st, hz where ok and ts_ns >= 34200000000000 and ts_ns < 57600000000000 group by all),
grid as (select locate, h, unnest(range(0, 23400 // h)) as k from (select distinct locate from fx_l1), hz),
bk as (
  select g.locate, g.h, g.k, coalesce(ofi, 0)::double as x, (mid - lag(mid) over (partition by g.locate, g.h order by g.k)) / 100 as y
  from grid g left join sums s on s.locate = g.locate and s.h = g.h and s.k = g.k left join closes c on c.locate = g.locate and c.h = g.h and c.k = g.k)
"""


def fit_sql(source: str, keys: str, least: int) -> str:
    """Fits with Newey-West errors of `source` (keys, k, x, y), as relations `fit`."""
    on = " and ".join(f"a.{x.strip()} = b.{x.strip()}" for x in keys.split(","))
    return f"""
, rows_ as (select *, row_number() over (partition by {keys} order by k) as i from {source} where y is not null),
base as (
  select {keys}, count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as icept, regr_r2(y, x) as r2, regr_sxx(y, x) as sxx,
    regr_syy(y, x) as syy, avg(x) as mx, cast(ceil(1.5 * pow(count(*), 1.0 / 3)) as int) as lag_n
  from rows_ group by {keys}),
good as (select *, n >= {least} and sxx > 0 and syy > 0 as fine from base),
sc as (select {', '.join('r.' + x.strip() for x in keys.split(','))}, i, (x - mx) * (y - icept - slope * x) as u, lag_n from rows_ r join good using ({keys}) where fine),
own as (select {keys}, sum(u * u) as s0 from sc group by {keys}),
cross_ as (
  select {', '.join('a.' + x.strip() for x in keys.split(','))}, sum((1 - (a.i - b.i) / (a.lag_n + 1)) * a.u * b.u) as s1
  from sc a join sc b on {on} and b.i < a.i and a.i - b.i <= a.lag_n group by all),
fit as (
  select g.*, case when fine and s0 + 2 * coalesce(s1, 0) > 0 then slope * sxx / sqrt(s0 + 2 * coalesce(s1, 0)) end as t
  from good g left join own using ({keys}) left join cross_ using ({keys}))
"""


@query(f"""with {duck('fx_l1')} {horizon_sql('[10, 30, 60, 300]')},
both_ as (
  select locate, h, 'contemporaneous' as design, k, x, y from bk union all
  select locate, h, 'predictive', k, x, lead(y) over (partition by locate, h order by k) from bk)
{fit_sql('both_', 'locate, h, design', 10)},
every as (select distinct locate, h, design from both_)
select locate, cast(h as int) as horizon_s, design, coalesce(n, 0) as n, round(case when fine then slope end * 1000, 5) as slope_1k, round(case when fine then r2 end, 6) as r2,
  round(t, 5) as nw_t, case when fine then lag_n else 0 end as nw_lag, cast(23400 // h - 1 - coalesce(n, 0) as bigint) as n_dropped
from every left join fit using (locate, h, design)""")
def ofi_horizons(spark, sf_dir):
    d = ofi.ofi_horizons(table(spark, sf_dir, "fx_l1"))
    return d.select("locate", "horizon_s", "design", "n", F.round(F.col("slope") * 1000, 5).alias("slope_1k"), F.round("r2", 6).alias("r2"), F.round("nw_t", 5).alias("nw_t"), "nw_lag", "n_dropped")


IMPACT_SQL = f"with {duck('fx_l1')} {horizon_sql('[10, 30, 60]')} {fit_sql('bk', 'locate, h', 3)}"


@query(IMPACT_SQL + """
select locate, cast(h as int) as horizon_s, n, round(case when fine then slope end * 1000, 5) as slope_1k, round(case when fine then icept end, 5) as intercept,
  round(case when fine then r2 end, 6) as r2, round(t, 5) as nw_t, cast(23400 // h - n as bigint) as dropped from fit""")
def nw_tstat(spark, sf_dir):
    d = ofi.price_impact(table(spark, sf_dir, "fx_l1"))
    return d.select("locate", "horizon_s", "n", F.round(F.col("slope") * 1000, 5).alias("slope_1k"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("nw_t", 5).alias("nw_t"), "dropped")


# liquidity

TIMES = """
, nx as (select *, coalesce(lead(ts_ns) over (partition by locate order by seq), 72000000000000) as nxt from fx_l1),
tm as (
  select *, greatest(34200000000000, least(57600000000000, ts_ns)) as t0, greatest(34200000000000, least(57600000000000, nxt)) as t1 from nx),
sw as (
  select *, t1 - t0 as w, case when bid_px > 0 and ask_px > 0 and bid_px < ask_px then 'two_sided' when bid_px > 0 and ask_px > 0 then 'crossed'
    when bid_px = 0 and ask_px = 0 then 'empty' else 'one_sided' end as state from tm where t1 > t0),
two as (
  select *, (ask_px - bid_px) / ((ask_px + bid_px) / 2) * 1e4 as bps, bid_sz + ask_sz as depth, bid_sz * bid_px / 1e4 + ask_sz * ask_px / 1e4 as usd,
    (bid_px + ask_px) / 2e4 as mid from sw where state = 'two_sided'),
shares_ as (
  select locate, 100.0 * sum(case when state = 'two_sided' then w else 0 end) / sum(w) as pct_two_sided, 100.0 * sum(case when state = 'one_sided' then w else 0 end) / sum(w) as pct_one_sided,
    100.0 * sum(case when state = 'empty' then w else 0 end) / sum(w) as pct_empty, 100.0 * sum(case when state = 'crossed' then w else 0 end) / sum(w) as pct_crossed,
    count(*) as n_states_rth, count(*) filter (state <> 'two_sided') as n_states_excluded
  from sw group by locate)
"""
PCT = ", ".join(f"round(pct_{s}, 6) as pct_{s}" for s in ("two_sided", "one_sided", "empty", "crossed")) + ", n_states_rth, n_states_excluded"
DEPTH = "depth_ as (select locate, sum(bps * w) / sum(w) as tw_spread_bps, sum(depth * w::double) / sum(w) as tw_depth_shares, sum(usd * w) / sum(w) as tw_depth_usd, sum(mid * w) / sum(w) as tw_mid from two group by locate)"


@query(f"with {duck('fx_l1')} {TIMES} select locate, {PCT} from shares_")
def liq_state_pct(spark, sf_dir):
    return rounded(liquidity.state_shares(table(spark, sf_dir, "fx_l1")))


@query(f"""with {duck('fx_l1')} {TIMES}, {DEPTH},
cum as (select locate, bps, sum(w) over (partition by locate order by bps) as c, sum(w) over (partition by locate) as a from two),
qs as (select locate, min(bps) filter (c >= a * 0.5) as med, min(bps) filter (c >= a * 0.95) as p95 from cum group by locate)
select locate, {PCT}, round(tw_spread_bps, 6) as tw_spread_bps, round(tw_depth_shares, 6) as tw_depth_shares, round(tw_depth_usd, 4) as tw_depth_usd, round(tw_mid, 6) as tw_mid,
  round(med, 6) as med_spread_bps, round(p95, 6) as p95_spread_bps from shares_ left join depth_ using (locate) left join qs using (locate)""")
def liq_summary(spark, sf_dir):
    return rounded(liquidity.liquidity_summary(table(spark, sf_dir, "fx_l1")).withColumn("tw_depth_usd", F.round("tw_depth_usd", 4)), skip=("tw_depth_usd",))


@query(f"""with {duck('fx_l1')} {TIMES},
cut as (select *, unnest(range((t0 - 34200000000000) // 60000000000, (t1 - 1 - 34200000000000) // 60000000000 + 1)) as minute from two),
part as (select *, least(t1, 34200000000000 + (minute + 1) * 60000000000) - greatest(t0, 34200000000000 + minute * 60000000000) as pw from cut),
sums as (select locate, minute, sum(bps * pw) / sum(pw) as s, sum(usd * pw) / sum(pw) as u, sum(depth * pw::double) / sum(pw) as d from part group by all),
grid as (select locate, minute from (select distinct locate from fx_l1), range(0, 390) r(minute))
select g.locate, cast(g.minute as int) as minute, cast(g.minute + 570 as int) as min_of_day, round(s, 6) as tw_spread_bps, round(u, 4) as tw_depth_usd, round(d, 5) as tw_depth_shares
from grid g left join sums x on x.locate = g.locate and x.minute = g.minute""")
def liq_1min(spark, sf_dir):
    d = liquidity.liquidity_1min(table(spark, sf_dir, "fx_l1"))
    return d.select("locate", "minute", "min_of_day", F.round("tw_spread_bps", 6).alias("tw_spread_bps"), F.round("tw_depth_usd", 4).alias("tw_depth_usd"), F.round("tw_depth_shares", 5).alias("tw_depth_shares"))


@query(f"""with {duck('fx_l1')} {horizon_sql('[10]')} {fit_sql('bk', 'locate, h', 3)} {TIMES}, {DEPTH},
pt as (select locate, log10(tw_depth_shares / 2) as x, log10(slope) as y from fit join depth_ using (locate) where fine and slope > 0),
sets as (select 'all' as label, * from pt union all select 'without', * from pt where locate > 4),
r as (select label, count(*) as n, regr_slope(y, x) as s, regr_intercept(y, x) as i, regr_r2(y, x) as r2, sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (count(*) - 2) / regr_sxx(y, x)) as se from sets group by label)
select label, n, round(s, 6) as slope, round(i, 6) as intercept, round(r2, 6) as r2, round(se, 6) as se, round(s - t * se, 5) as ci_lo, round(s + t * se, 5) as ci_hi from r left join (values {T_VALUES}) as q(df, t) on q.df = n - 2""")
def impact_cross_section(spark, sf_dir):
    l1 = table(spark, sf_dir, "fx_l1")
    d = ofi.impact_cross_section(ofi.price_impact(l1, (10,)), liquidity.liquidity_summary(l1), leave_out=F.col("locate") <= 4)
    return rounded(d.withColumn("ci_lo", F.round("ci_lo", 5)).withColumn("ci_hi", F.round("ci_hi", 5)))


# activity

DAY = "ts_ns >= 34200000000000 and ts_ns < 57600000000000"


@query(f"""with {duck('fx_prints')},
s as (
  select locate, sum(case when kind in (0, 1) and {DAY} then shares else 0 end) as rth_displayed_vol, sum(case when kind in (0, 1) then shares else 0 end) as day_displayed_vol,
    sum(case when kind = 3 and ts_ns < 36000000000000 then shares else 0 end) as open_cross_sh, sum(case when kind = 2 and {DAY} then shares else 0 end) as rth_hidden_vol,
    sum(case when kind = 3 and ts_ns >= 56700000000000 then shares else 0 end) as close_cross_sh, sum(case when kind = 3 then shares else 0 end) as cross_all, sum(shares) as all_,
    sum(case when kind in (0, 1) and {DAY} and ts_ns < 36000000000000 then shares else 0 end) as f30, sum(case when kind in (0, 1, 2) and {DAY} and ts_ns < 36000000000000 then shares else 0 end) as f30a,
    count(*) filter (kind = 3 and shares = 0) as admin_crosses
  from fx_prints group by locate),
c as (select locate, shares, sum(shares) over (partition by locate order by shares) as c, sum(shares) over (partition by locate) as a from fx_prints where kind in (0, 1) and {DAY}),
q as (select locate, min(shares) filter (c >= a * 0.5) as med from c group by locate)
select locate, cast(med as bigint) as vw_median_trade_sz, cast(rth_displayed_vol as bigint) as rth_displayed_vol, cast(day_displayed_vol as bigint) as day_displayed_vol, cast(open_cross_sh as bigint) as open_cross_sh,
  cast(rth_hidden_vol as bigint) as rth_hidden_vol, cast(close_cross_sh as bigint) as close_cross_sh, cast(cross_all - open_cross_sh - close_cross_sh as bigint) as other_cross_sh,
  round(100.0 * close_cross_sh / nullif(all_, 0), 6) as close_cross_pct, round(f30 / nullif(rth_displayed_vol, 0), 6) as first30_share, round(f30a / nullif(rth_displayed_vol + rth_hidden_vol, 0), 6) as f30_share_incl_hidden, admin_crosses
from s left join q using (locate)""")
def act_summary(spark, sf_dir):
    return rounded(activity.activity_summary(table(spark, sf_dir, "fx_prints")))


FRACTIONS = f"""
v as (select locate, (ts_ns - 34200000000000) // 60000000000 as minute, sum(shares) as vol from fx_prints where kind in (0, 1) and {DAY} group by all),
grid as (select locate, minute from (select distinct locate from fx_prints), range(0, 390) r(minute)),
fr as (
  select g.locate, g.minute, coalesce(vol, 0) as volume, coalesce(vol, 0) / nullif(sum(coalesce(vol, 0)) over (partition by g.locate), 0) as fraction
  from grid g left join v on v.locate = g.locate and v.minute = g.minute)
"""


@query(f"with {duck('fx_prints')}, {FRACTIONS} select locate, cast(minute as int) as minute, cast(volume as bigint) as volume, round(fraction, 9) as fraction from fr")
def act_minute_frac(spark, sf_dir):
    return rounded(activity.minute_fractions(table(spark, sf_dir, "fx_prints")), 9)


@query(f"""with {duck('fx_prints')}, {FRACTIONS} select cast(minute as int) as minute, round(quantile_cont(fraction, 0.25), 9) as q25, round(quantile_cont(fraction, 0.5), 9) as q50, round(quantile_cont(fraction, 0.75), 9) as q75
from fr where fraction is not null group by minute""")
def act_minute_quartiles(spark, sf_dir):
    return rounded(activity.minute_quartiles(activity.minute_fractions(table(spark, sf_dir, "fx_prints")), "fraction"), 9)


NAMED = "nm as (select p.*, coalesce(symbol, '') as symbol, case kind when 0 then 'exec' when 1 then 'exec_px' when 2 then 'hidden' when 3 then 'cross' else '' end as kind_name from fx_prints p left join fx_symbols s on s.locate = p.locate)"


@query(f"with {duck('fx_prints', 'fx_symbols')}, {NAMED} select seq, ts_ns, locate, symbol, kind_name, price, shares, side from nm")
def symbol_join(spark, sf_dir):
    d = m.with_symbols(table(spark, sf_dir, "fx_prints"), table(spark, sf_dir, "fx_symbols"))
    return d.select("seq", "ts_ns", "locate", "symbol", m.name_of("kind", m.KIND_NAMES).alias("kind_name"), "price", "shares", "side")


@query(f"with {duck('fx_prints', 'fx_symbols')}, {NAMED} select symbol, count(*) as trades from nm where kind in (0, 1) group by symbol order by trades desc, symbol limit 5")
def top_symbols(spark, sf_dir):
    return activity.top_symbols(m.with_symbols(table(spark, sf_dir, "fx_prints"), table(spark, sf_dir, "fx_symbols")), 5)


CLOSING = "cc as (select locate, price / 1e4 as price_usd, shares from fx_prints where kind = 3 and shares > 0 and ts_ns between {lo} and {hi} qualify row_number() over (partition by locate order by ts_ns desc, seq) = 1)"


@query(f"with {duck('fx_prints')}, {CLOSING.format(lo=57590000000000, hi=57900000000000)} select locate, price_usd, cast(shares as bigint) as shares from cc")
def closing_cross(spark, sf_dir):
    return activity.closing_cross(table(spark, sf_dir, "fx_prints")).withColumn("shares", F.col("shares").cast("long"))


# integrity

@query(f"""with {duck('fx_prints', 'fx_symbols')},
r as (select *, lag(ts_ns) over (order by seq) as prev from fx_prints),
c as (select count(*) filter (ts_ns >= 86400000000000) as a, count(*) filter (ts_ns < prev) as b, (select count(*) from (select distinct locate from fx_prints where locate not in (select locate from fx_symbols))) as u,
  count(*) filter (kind not in (0, 1, 2, 3)) as k, count(*) filter (not (case when kind in (0, 1) then side in ('B', 'S') else side in ('B', 'S', '') end)) as s,
  count(*) filter (kind <> 3 and price <= 0) as p, count(*) filter (kind <> 3 and shares <= 0) as h, count(*) filter (kind = 3 and shares = 0) as z from r),
l as (select unnest([('trades_ts_range', a, 1), ('trades_ts_monotonic', b, 1), ('trades_locates', u, 1), ('trade_kind', k, 1), ('trade_side', s, 1), ('trade_price', p, 1), ('trade_shares', h, 1), ('trade_zero_share_crosses', z, 0)]) as x from c)
select x[1] as name, case when x[3] = 0 then 'INFO' when x[2] = 0 then 'PASS' else 'FAIL' end as status, cast(x[2] as bigint) as bad from l""")
def verify_trades(spark, sf_dir):
    return verify.verify_trades(table(spark, sf_dir, "fx_prints"), table(spark, sf_dir, "fx_symbols"))


@query(f"""with {duck('fx_l1', 'fx_symbols')},
r as (select *, lag(ts_ns) over (order by seq) as prev from fx_l1),
c as (select count(*) as n, count(*) filter (ts_ns >= 86400000000000) as a, count(*) filter (ts_ns < prev) as b, (select count(*) from (select distinct locate from fx_l1 where locate not in (select locate from fx_symbols))) as u,
  count(*) filter (bid_px = 0 and ask_px = 0) as e, count(*) filter (bid_px > 0 and ask_px > 0 and bid_px >= ask_px) as x from r)
select 'l1_ts_range' as name, case when a = 0 then 'PASS' else 'FAIL' end as status, a as bad from c union all select 'l1_ts_monotonic', case when b = 0 then 'PASS' else 'FAIL' end, b from c
union all select 'l1_locates', case when u = 0 then 'PASS' else 'FAIL' end, u from c union all select 'l1_empty_book_rows', 'INFO', e from c union all select 'l1_crossed_rows', case when x > n * 0.005 then 'FAIL' else 'INFO' end, x from c""")
def verify_l1(spark, sf_dir):
    return verify.verify_l1(table(spark, sf_dir, "fx_l1"), table(spark, sf_dir, "fx_symbols"))


@query(f"with {duck('fx_l1')} select seq, locate, ts_ns, bid_px, ask_px from fx_l1 where bid_px > 0 and ask_px > 0 and bid_px >= ask_px")
def crossed_rows(spark, sf_dir):
    return table(spark, sf_dir, "fx_l1").where(m.state_class() == "crossed").select("seq", "locate", "ts_ns", "bid_px", "ask_px")


# decoding: stand-in messages are encoded first

#: All messages: the operations (without a target: ref 0, which no add has), and directory entries, trading actions, crosses and hidden prints.
MESSAGES = """ms as (
  select seq, ts_ns, locate, ty, coalesce(ref, case when ty <> 'A' then 0 end) as ref, new_ref, shares, price, side, printable, case when ty = 'A' then 'SYM' || lpad(cast(locate as varchar), 2, '0') end as stock, null as state from fx_ops
  union all select seq, ts_ns, locate, ty, case when ty = 'P' then 0 end, null, shares, price, side, null, stock, state from fx_more)"""


def message_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in messages in binary, written once as a feed would be: seq, payload."""
    ops = table(spark, sf_dir, "fx_ops").withColumn("ref", F.coalesce("ref", F.lit(0)))
    ops = ops.withColumn("stock", F.concat(F.lit("SYM"), F.lpad(F.col("locate").cast("string"), 2, "0"))).unionByName(table(spark, sf_dir, "fx_more"), allowMissingColumns=True)
    ops = ops.withColumn("ref", F.coalesce("ref", F.lit(0))).withColumn("match", F.col("seq")).withColumn("tracking", F.lit(1)).withColumn("cross_type", F.lit("C"))
    return stored(decode.encoded_all(ops.withColumn("match", F.abs("match")), "AECXDURHPQ"))


@query(f"""with {duck('fx_ops')} select seq, locate, cast(ts_ns as bigint) as ts_ns, ty, cast(coalesce(ref, 0) as double) as ref, cast(new_ref as double) as new_ref, cast(shares as bigint) as shares, cast(price as bigint) as price, side, printable
from fx_ops""")
def decode_operations(spark, sf_dir):
    d = decode.operations(message_frames(spark, sf_dir))
    return d.withColumn("ref", F.col("ref").cast("double")).withColumn("new_ref", F.col("new_ref").cast("double"))


@query(f"""with {duck('fx_ops', 'fx_more')}, {MESSAGES} select ty as type, count(*) as messages,
  cast(count(*) * (2 + case ty when 'A' then 36 when 'E' then 31 when 'C' then 36 when 'X' then 23 when 'D' then 19 when 'U' then 35 when 'R' then 39 when 'H' then 25 when 'P' then 44 else 40 end) as bigint) as bytes from ms group by ty""")
def decode_type_counts(spark, sf_dir):
    return decode.type_counts(message_frames(spark, sf_dir))


@query(f"""with {duck('fx_ops', 'fx_more')}, {MESSAGES},
c as (select *, last_value(case when ty = 'R' then stock end ignore nulls) over (partition by locate order by seq) as known from ms),
k as (select count(*) as messages, min(ts_ns) as ts_min, max(ts_ns) as ts_max, count(*) filter (ts_ns >= 86400000000000) as ts_out_of_range, count(*) filter (ty in ('A', 'P') and side not in ('B', 'S')) as bad_side,
  count(*) filter (ty = 'A' and price = 0) as zero_price_adds, count(*) filter (ty in ('A', 'H', 'P', 'Q') and known is not null) as locate_checked,
  count(*) filter (ty in ('A', 'H', 'P', 'Q') and known <> stock) as locate_mismatch, cast(null as varchar) as failed from c)
select *, failed is null and ts_out_of_range = 0 and bad_side = 0 and locate_mismatch = 0 as ok from k""")
def decode_checks(spark, sf_dir):
    return decode.stream_checks(message_frames(spark, sf_dir))


#: Two files: one ends in a message of an unknown type, followed by good ones, and then in the middle of a frame.
FILES = "select seq, case when locate % 2 = 0 then 'even' else 'odd' end as file, ty"


@query(f"""with {duck('fx_ops', 'fx_more')}, {MESSAGES},
n as (select file, count(*) as messages from ({FILES} from ms) where file = 'even' or seq < 2000 group by file)
select file, messages, case when file = 'odd' then 'UnknownType' end as failed, false as ok, file = 'even' as clean_eof from n""")
def feed_verdict(spark, sf_dir):
    frames = message_frames(spark, sf_dir).withColumn("file", F.when(decode._field(F.col("payload"), 1, 2, "u") % 2 == 0, "even").otherwise("odd"))
    bad = spark.createDataFrame([(2000, bytearray(b"Z123456789"), "odd")], "seq long, payload binary, file string")
    frames = frames.where("file = 'even' or seq <> 2000").unionByName(bad)
    sizes = frames.groupBy("file").agg((F.sum(F.octet_length("payload") + 2) + F.when(F.col("file") == "odd", 1).otherwise(0)).alias("size"))
    return decode.verdict(decode.stream_checks(frames), scan_summary(frames, sizes)).select("file", "messages", "failed", "ok", "clean_eof")


def _every_kind(k: str, i: int) -> list[tuple[str, str, str]]:
    """Name, kind and value of each field of a message made of an event, as SQL for both dialects."""
    out = []
    for n, _, w, t in decode.LAYOUTS[k][2]:
        i += 1
        out.append((n, t, f"(event_id * {i} + k) % {min(1 << 8 * w, 1 << 50)}" if t == "u" else f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast((event_id + {i}) % 20 as int) + 1, {max(1, w - 2)})"))
    return out


KINDS = "".join(decode.LAYOUTS)
FIELDS_SQL = " union all ".join(
    f"select '{k}' as type, '{n}' as field, count(*) as n, " + (f"cast(sum({v}) as double) as total, cast(null as varchar) as least, cast(null as varchar) as most" if t == "u" else f"cast(null as double) as total, min({v}) as least, max({v}) as most") + f" from b where event_id % {len(KINDS)} = {at}"
    for at, k in enumerate(KINDS) for n, t, v in _every_kind(k, at)
)


@query(f"with {duck('fx_symbols')} {FIELDS_SQL}")
def decode_fields(spark, sf_dir):
    """Messages of all kinds, decoded: for each field its sum, or its least and largest text."""
    b, out = base(spark, sf_dir), None
    for at, k in enumerate(KINDS):
        fields = _every_kind(k, at)
        rows = b.where(F.col("event_id") % len(KINDS) == at).select(F.col("event_id").alias("seq"), "locate", F.lit(1).alias("tracking"), "ts_ns", *[F.expr(v).alias(n) for n, _, v in fields])
        d = decode.decoded(decode.encoded(rows, k), k)
        cells = [F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("total") if t == "u" else F.lit(None).cast("double").alias("total"), (F.rtrim(n) if t == "a" else F.lit(None).cast("string")).alias("text")) for n, t, _ in fields]
        part = d.select(F.explode(F.array(*cells)).alias("c")).groupBy(F.lit(k).alias("type"), "c.field").agg(F.count("*").alias("n"), F.sum("c.total").alias("total"), F.min("c.text").alias("least"), F.max("c.text").alias("most"))
        out = part if out is None else out.unionByName(part)
    return out


# the book

#: Whether an operation's target was live follows from sums over its ref alone, but for chains of replaces.
EFFECTS_SQL = """
, adds as (select case when ty = 'A' then ref else new_ref end as id, ty = 'A' as first, seq as born, shares as size, price as rest, side as own_side from fx_ops where ty in ('A', 'U')),
uses as (
  select o.*, a.size, a.rest, a.id is not null and a.born < o.seq as known, case when ty in ('D', 'U') then 1099511627776 else shares end as want
  from fx_ops o left join adds a on o.ref = a.id where ty <> 'A'),
spent as (
  select *, coalesce(sum(want) over (partition by case when known then ref else -seq end order by seq rows between unbounded preceding and 1 preceding), 0) as used from uses),
held as (select *, known and used < size as h from spent),
chain as (
  with recursive c(id, root_side) as (
    select id, own_side from adds where first
    union all select h.new_ref, c.root_side from held h join c on h.ref = c.id where h.ty = 'U' and h.h)
  select * from c),
fx as (
  select seq, locate, ts_ns, ty, ref, new_ref, printable, true as live, side, cast(null as bigint) as rest, shares, price, 0 as removed, false as gone, false as over, false as to_zero from fx_ops where ty = 'A'
  union all
  select seq, locate, ts_ns, ty, ref, new_ref, printable, h and c.id is not null, case when h then c.root_side end, case when h and c.id is not null then rest end, shares, price,
    case when h and c.id is not null then least(want, size - used) else 0 end, h and c.id is not null and want >= size - used,
    h and c.id is not null and ty in ('E', 'C', 'X') and want > size - used, h and c.id is not null and ty = 'X' and want >= size - used
  from held left join chain c on held.ref = c.id),
delta as (
  select locate, side, price, seq, ts_ns, sum(s) as s, sum(o) as o from (
    select locate, side, rest as price, seq, ts_ns, -removed as s, case when gone then -1 else 0 end as o from fx where live and ty <> 'A'
    union all select locate, side, price, seq, ts_ns, shares, 1 from fx where live and ty in ('A', 'U')) group by all)
"""
TOPS_SQL = EFFECTS_SQL + """
, lev as (select *, sum(s) over w as size, sum(o) over w as ct, lead(seq) over w as until from delta window w as (partition by locate, side, price order by seq)),
chg as (select distinct locate, seq, ts_ns from delta),
best as (
  select chg.locate, chg.seq, chg.ts_ns, max(l.price) filter (l.side = 'B') as bp, min(l.price) filter (l.side = 'S') as ap,
    arg_max(l.size, l.price) filter (l.side = 'B') as bs, arg_min(l.size, l.price) filter (l.side = 'S') as az,
    arg_max(l.ct, l.price) filter (l.side = 'B') as bc, arg_min(l.ct, l.price) filter (l.side = 'S') as ac
  from chg left join lev l on l.locate = chg.locate and l.ct > 0 and l.seq <= chg.seq and (l.until is null or l.until > chg.seq) group by all),
top as (
  select locate, seq, ts_ns, cast(coalesce(bp, 0) as bigint) as bid_px, cast(coalesce(ap, 0) as bigint) as ask_px, cast(coalesce(bs, 0) as bigint) as bid_sz, cast(coalesce(az, 0) as bigint) as ask_sz,
    cast(coalesce(bc, 0) as bigint) as bid_ct, cast(coalesce(ac, 0) as bigint) as ask_ct from best)
"""
CROSSED_SQL = TOPS_SQL + """
, hh as (select *, coalesce(lag(state) over (partition by locate order by seq), 'H') as was from fx_ctl where ty = 'H'),
ctl as (select locate, seq, state, case when state = 'T' and was <> 'T' then true end as pending from hh union all select locate, seq, null, false from fx_ctl where ty = 'Q'),
mix as (
  select f.locate, f.seq, f.ts_ns, true as op, case when t.seq is not null then {'b': t.bid_px, 'a': t.ask_px} end as top, null as state, null::boolean as pending
  from fx f left join top t on t.locate = f.locate and t.seq = f.seq where f.ty = 'D' or f.live
  union all select locate, seq, null, false, null, state, pending from ctl),
run as (
  select locate, seq, ts_ns, op, last_value(top ignore nulls) over w as top, last_value(state ignore nulls) over w as state, coalesce(last_value(pending ignore nulls) over w, false) as pending
  from mix window w as (partition by locate order by seq)),
crossed as (select locate, seq, ts_ns, top.b as bid_px, top.a as ask_px, pending from run where op and state = 'T' and top.b > 0 and top.a > 0 and top.b >= top.a)
"""


def fx(spark, sf_dir) -> DataFrame:
    return book.effects(table(spark, sf_dir, "fx_ops"))


def dayless(rows: DataFrame) -> DataFrame:
    return rows.drop("day")


@query(f"with {duck('fx_ops')} {EFFECTS_SQL} select seq, locate, ty, live, side, cast(rest as bigint) as rest_price, cast(removed as bigint) as removed, gone, over, to_zero from fx")
def book_effects(spark, sf_dir):
    return fx(spark, sf_dir).select("seq", "locate", "ty", "live", "side", "rest_price", "removed", "gone", "over", "to_zero")


L1_SQL = """
sat as (select locate, seq, ts_ns, bid_px, ask_px, least(bid_sz, 4294967295) as bid_sz, least(ask_sz, 4294967295) as ask_sz, least(bid_ct, 65535) as bid_ct, least(ask_ct, 65535) as ask_ct from top),
ch as (select *, lag(row(bid_px, ask_px, bid_sz, ask_sz)) over (partition by locate order by seq) as prev from sat),
l1 as (select locate, seq, ts_ns, bid_px, ask_px, bid_sz, ask_sz, bid_ct, ask_ct from ch where coalesce(prev, row(0::bigint, 0::bigint, 0::bigint, 0::bigint)) <> row(bid_px, ask_px, bid_sz, ask_sz))
"""


@query(f"with {duck('fx_ops')} {TOPS_SQL}, {L1_SQL} select * from l1")
def book_l1(spark, sf_dir):
    return dayless(book.l1_stream(book.tops(fx(spark, sf_dir))))


@query(f"with {duck('fx_ops')} {EFFECTS_SQL} select locate, side, cast(price as bigint) as price, cast(sum(s) as bigint) as shares, cast(sum(o) as bigint) as orders from delta group by all having sum(o) > 0")
def book_levels_eod(spark, sf_dir):
    return dayless(book.levels(fx(spark, sf_dir)))


@query(f"""with {duck('fx_ops')} {EFFECTS_SQL},
e as (select locate, side, price, sum(s) as sz, sum(o) as ct from delta group by all having sum(o) > 0),
r as (select *, row_number() over (partition by locate, side order by case when side = 'B' then -price else price end) as rank from e)
select coalesce(b.locate, a.locate) as locate, cast(coalesce(b.rank, a.rank) as int) as rank, cast(b.price as bigint) as bid_px, cast(b.sz as bigint) as bid_sz, cast(b.ct as bigint) as bid_ct, cast(a.price as bigint) as ask_px, cast(a.sz as bigint) as ask_sz, cast(a.ct as bigint) as ask_ct
from (select * from r where side = 'B' and rank <= 5) b full join (select * from r where side = 'S' and rank <= 5) a on a.locate = b.locate and a.rank = b.rank""")
def book_depth(spark, sf_dir):
    return dayless(book.depth(fx(spark, sf_dir), 5))


TAPE_SQL = """
tp as (
  select seq, ts_ns, locate, case when ty = 'E' then 0 else 1 end as kind, cast(case when ty = 'E' then rest else price end as bigint) as price, cast(shares as bigint) as shares, side
  from fx where live and (ty = 'E' or (ty = 'C' and printable = 'Y'))
  union all select seq, ts_ns, locate, case when ty = 'P' then 2 else 3 end, price, least(shares, 4294967295), case when ty = 'P' then side else '' end from fx_more where ty in ('P', 'Q'))
"""


@query(f"with {duck('fx_ops', 'fx_more')} {EFFECTS_SQL}, {TAPE_SQL} select * from tp")
def tape(spark, sf_dir):
    return dayless(book.trade_tape(fx(spark, sf_dir), table(spark, sf_dir, "fx_more")))


OPS_SQL = """oc as (
  select locate, count(*) filter (ty = 'A') as adds, count(*) filter (live and ty in ('E', 'C')) as executes, count(*) filter (live and ty = 'X') as cancels, count(*) filter (ty = 'D') as deletes,
    count(*) filter (live and ty = 'U') as replaces from fx group by locate)"""


@query(f"with {duck('fx_ops')} {EFFECTS_SQL}, {OPS_SQL} select * from oc")
def locate_ops(spark, sf_dir):
    return dayless(book.operation_counts(fx(spark, sf_dir)))


@query(f"""with {duck('fx_ops', 'fx_symbols')} {EFFECTS_SQL}, {OPS_SQL}
select locate, round((cancels + deletes) / nullif(executes, 0), 6) as cancel_ratio, round(adds / nullif(executes, 0), 6) as adds_to_exec, coalesce(symbol, '') as symbol from oc left join fx_symbols using (locate)""")
def act_ratios(spark, sf_dir):
    return rounded(activity.activity_ratios(book.operation_counts(fx(spark, sf_dir)), table(spark, sf_dir, "fx_symbols")))


@query(f"""with {duck('fx_ops')} {EFFECTS_SQL}, {OPS_SQL},
r as (select (cancels + deletes) / nullif(executes, 0) as c, adds / nullif(executes, 0) as a from oc)
select round(quantile_cont(c, 0.5), 6) as med_cancel_ratio, round(quantile_cont(a, 0.5), 6) as med_adds_to_exec, count(*) filter (c is null) as n_zero_exec from r""")
def act_market_medians(spark, sf_dir):
    return rounded(activity.market_medians(book.operation_counts(fx(spark, sf_dir))))


@query(f"""with {duck('fx_ops')} {EFFECTS_SQL}, {OPS_SQL},
lv as (select seq, sum(case when ty = 'A' then 1 when gone and ty <> 'U' then -1 else 0 end) over (order by seq) as n, ty, live from fx)
select cast(sum(adds) as bigint) as adds, cast(sum(executes) as bigint) as executes, cast(sum(cancels) as bigint) as cancels, cast(sum(deletes) as bigint) as deletes, cast(sum(replaces) as bigint) as replaces,
  cast((select sum(removed) from fx where live and ty in ('E', 'C')) as bigint) as executed_shares, cast((select max(n) from lv) as bigint) as peak_live_orders from oc""")
def book_stats(spark, sf_dir):
    return dayless(book.stats(fx(spark, sf_dir)))


@query(f"""with {duck('fx_ops', 'fx_ctl')} {CROSSED_SQL},
v as (select count(*) filter (not live and ty in ('E', 'C', 'X', 'D')) as unknown_ref, count(*) filter (not live and ty = 'U') as replace_unknown, (select count(*) from (select count(*) as n from adds group by id) where n > 1) as duplicate_ref, count(*) filter (over) as over_reduction,
  count(*) filter (to_zero) as cancel_to_zero, (select count(*) from crossed where not pending) as crossed_while_trading, (select count(*) from crossed where pending) as crossed_auction_pending, (select count(*) from (select sum(s) as x from delta group by locate, side, price) where x < 0) as ladder_underflow from fx)
select *, unknown_ref + replace_unknown + duplicate_ref + over_reduction + crossed_while_trading + ladder_underflow as total from v""")
def book_violations(spark, sf_dir):
    x = fx(spark, sf_dir)
    return dayless(book.violations(x, stored(book.crossings(x, book.tops(x), table(spark, sf_dir, "fx_ctl")))))


@query(f"""with {duck('fx_ops', 'fx_ctl')} {CROSSED_SQL},
e as (select * from crossed where not pending order by seq limit 10000)
select locate, count(*) as n, min(ts_ns) as first_ns, max(ts_ns) as last_ns, max(ts_ns) - min(ts_ns) as span_ns from e group by locate""")
def crossed_report(spark, sf_dir):
    x = fx(spark, sf_dir)
    return dayless(book.crossed_report(book.crossed_events(book.crossings(x, book.tops(x), table(spark, sf_dir, "fx_ctl")))))


@query(f"""with {duck('fx_ops')} {EFFECTS_SQL},
e as (select locate, side, price, sum(s) as s, sum(o) as o from delta group by all having sum(o) > 0),
born as (select locate, case when ty = 'A' then ref else new_ref end as id, side, price, shares from fx where live and ty in ('A', 'U')),
left_ as (select b.locate, b.id, b.side, b.price, b.shares - coalesce(sum(f.removed), 0) as s from born b left join fx f on f.ref = b.id and f.live and f.ty <> 'A' group by b.locate, b.id, b.side, b.price, b.shares),
again as (select locate, side, price, sum(s) as s, count(*) as o from left_ where s > 0 group by all),
j as (select coalesce(e.locate, a.locate) as locate, e.s is distinct from a.s or e.o is distinct from a.o as bad from e full join again a on e.locate = a.locate and e.side = a.side and e.price = a.price)
select l.locate, count(bad) as levels, count(*) filter (bad) as mismatches from (select distinct locate from fx_ops) l left join j on j.locate = l.locate group by l.locate""")
def book_audit(spark, sf_dir):
    return dayless(book.audit(fx(spark, sf_dir)))


#: Refs that are added again, while they hold shares or after: followed one operation of a ref at a time.
TWICE_SQL = """
o as (select *, row_number() over (partition by ref order by seq) as rn, case when ty = 'D' then 1099511627776 else shares end as want from fx_twice),
st as (
  with recursive s as (
    select *, cast(null as bigint) as had, cast(null as bigint) as had_px, cast(null as varchar) as had_side,
      case when ty = 'A' then shares end as has, case when ty = 'A' then price end as has_px, case when ty = 'A' then side end as has_side from o where rn = 1
    union all
    select o.*, s.has, s.has_px, s.has_side,
      case when o.ty = 'A' then coalesce(s.has, o.shares) when s.has > o.want then s.has - o.want end,
      case when o.ty = 'A' and s.has is null then o.price else s.has_px end, case when o.ty = 'A' and s.has is null then o.side else s.has_side end
    from s join o on o.ref = s.ref and o.rn = s.rn + 1)
  select * from s),
fx as (
  select seq, locate, ty, case when ty = 'A' then had is null else had is not null end as live, ty = 'A' and had is not null as duplicate,
    case when ty = 'A' then side when had is not null then had_side end as side, case when ty <> 'A' and had is not null then had_px end as rest_price,
    cast(case when ty <> 'A' and had is not null then least(want, had) else 0 end as bigint) as removed, coalesce(ty <> 'A' and want >= had, false) as gone,
    coalesce(ty in ('E', 'X') and want > had, false) as over, coalesce(ty = 'X' and want >= had, false) as to_zero from st)
"""


def fx_twice(spark, sf_dir) -> DataFrame:
    return book.effects(table(spark, sf_dir, "fx_twice"))


@query(f"with {duck('fx_twice')}, {TWICE_SQL} select * from fx")
def book_reused_refs(spark, sf_dir):
    return fx_twice(spark, sf_dir).select("seq", "locate", "ty", "live", "duplicate", "side", "rest_price", "removed", "gone", "over", "to_zero")


@query(f"""with {duck('fx_twice')}, {TWICE_SQL} select count(*) filter (not live and ty <> 'A') as unknown_ref, count(*) filter (duplicate) as duplicate_ref, count(*) filter (over) as over_reduction, count(*) filter (to_zero) as cancel_to_zero,
  (select count(distinct locate) from fx) as audited, cast(0 as bigint) as failed from fx""")
def book_reused_counts(spark, sf_dir):
    x = fx_twice(spark, sf_dir)
    empty = table(spark, sf_dir, "fx_ctl").where("false")
    v = book.violations(x, book.crossings(x, book.tops(x), empty)).select("day", "unknown_ref", "duplicate_ref", "over_reduction", "cancel_to_zero")
    return dayless(v.join(book.audit_counts(book.audit(x)), "day"))


#: Some operations name another locate than their order's. What they do is what they do on the clean table, whose locates are the orders' own.
STRAY_SQL = """sy as (select seq, case when ty <> 'A' and seq % 37 < 5 then locate % 20 + 1 else locate end as msg from fx_ops)"""


def fx_stray(spark, sf_dir) -> DataFrame:
    ops = table(spark, sf_dir, "fx_ops")
    return book.effects(ops.withColumn("locate", F.expr("if(ty <> 'A' and seq % 37 < 5, locate % 20 + 1, locate)")))


@query(f"""with {duck('fx_ops')} {EFFECTS_SQL}, {STRAY_SQL},
x as (select fx.*, msg, case when live then locate else msg end as home from fx join sy using (seq)),
o as (select case when ty = 'D' then msg else home end as locate, count(*) filter (ty = 'A') as adds, count(*) filter (live and ty in ('E', 'C')) as executes, count(*) filter (live and ty = 'X') as cancels, count(*) filter (ty = 'D') as deletes,
    count(*) filter (live and ty = 'U') as replaces from x group by all),
l as (select locate, count(*) as levels, cast(sum(s) as bigint) as shares, cast(sum(o) as bigint) as orders from (select locate, side, price, sum(s) as s, sum(o) as o from delta group by all having sum(o) > 0) group by locate),
s as (select home as locate, count(*) as strays from x where home <> msg group by home)
select o.*, levels, shares, orders, coalesce(strays, 0) as strays from o join l using (locate) left join s using (locate)""")
def stray_books(spark, sf_dir):
    x = fx_stray(spark, sf_dir)
    l = book.levels(x).groupBy("locate").agg(F.count("*").alias("levels"), F.sum("shares").alias("shares"), F.sum("orders").alias("orders"))
    s = book.stray_operations(x).groupBy(F.col("home").alias("locate")).agg(F.count("*").alias("strays"))
    return dayless(book.operation_counts(x)).join(l, "locate").join(s, "locate", "left").na.fill(0, ["strays"])


@query(f"""with {duck('fx_ops')} {TOPS_SQL}, {STRAY_SQL},
ck as (select fx.seq, fx.ts_ns, case when ty = 'A' or (live and ty in ('E', 'C')) then locate else msg end as locate from fx join sy using (seq)),
at_ as (
  select ck.locate, ck.seq, ck.ts_ns, coalesce(bid_px, 0) as bid_px, coalesce(ask_px, 0) as ask_px, least(coalesce(bid_sz, 0), 4294967295) as bid_sz, least(coalesce(ask_sz, 0), 4294967295) as ask_sz, least(coalesce(bid_ct, 0), 65535) as bid_ct, least(coalesce(ask_ct, 0), 65535) as ask_ct
  from ck asof left join top on ck.locate = top.locate and ck.seq >= top.seq),
ch as (select *, lag(row(bid_px, ask_px, bid_sz, ask_sz)) over (partition by locate order by seq) as prev from at_)
select * exclude (prev) from ch where coalesce(prev, row(0::bigint, 0::bigint, 0::bigint, 0::bigint)) <> row(bid_px, ask_px, bid_sz, ask_sz)""")
def stray_l1(spark, sf_dir):
    x = fx_stray(spark, sf_dir)
    return dayless(book.l1_stream(book.checked_tops(x, book.tops(x))))


# from frames to exports

def feed(spark, sf_dir, symbol=None) -> export.Replay:
    return export.replay(message_frames(spark, sf_dir), symbol=symbol)


@query(f"with {duck('fx_ops', 'fx_more')} {TOPS_SQL}, {L1_SQL} select * from l1")
def feed_l1(spark, sf_dir):
    return dayless(feed(spark, sf_dir).l1)


@query(f"with {duck('fx_ops', 'fx_more')} {EFFECTS_SQL}, {TAPE_SQL} select * from tp")
def feed_tape(spark, sf_dir):
    return dayless(feed(spark, sf_dir).trades)


@query(f"with {duck('fx_ops', 'fx_more')} {EFFECTS_SQL}, {TAPE_SQL} select * from tp where locate = 3")
def feed_one_symbol(spark, sf_dir):
    return dayless(feed(spark, sf_dir, "SYM03").trades)


@query(f"with {duck('fx_more')} select locate, case when locate = 20 then 'OLD20' else 'SYM' || lpad(cast(locate as varchar), 2, '0') end as symbol from (select distinct locate from fx_more)")
def feed_symbols(spark, sf_dir):
    return dayless(feed(spark, sf_dir).symbols)


@query(f"with {duck('fx_ops', 'fx_more')} {EFFECTS_SQL}, {OPS_SQL} select r.locate, coalesce(adds, 0) as adds, coalesce(executes, 0) as executes, coalesce(cancels, 0) as cancels, coalesce(deletes, 0) as deletes, coalesce(replaces, 0) as replaces from (select distinct locate from fx_more where ty = 'R') r left join oc on oc.locate = r.locate")
def feed_ops(spark, sf_dir):
    return dayless(feed(spark, sf_dir).ops)


@query(f"""with {duck('fx_ops', 'fx_more')} {TOPS_SQL}, {L1_SQL}, {TAPE_SQL}, {MESSAGES}
select 'source' as key, '' as value union all select 'messages', cast((select count(*) from ms) as varchar) union all select 'trades', cast((select count(*) from tp) as varchar) union all select 'l1', cast((select count(*) from l1) as varchar)""")
def feed_meta(spark, sf_dir):
    return export.totals(feed(spark, sf_dir)).select("key", "value")


@query(f"""with {duck('fx_ops', 'fx_ctl', 'fx_more')} {CROSSED_SQL},
v as (select count(*) filter (not pending) as crossed_while_trading, count(*) filter (pending) as crossed_auction_pending from crossed) select * from v""")
def feed_crossings(spark, sf_dir):
    return feed(spark, sf_dir).crossings().agg(F.count_if(~F.col("pending")).alias("crossed_while_trading"), F.count_if("pending").alias("crossed_auction_pending"))


# at moments

@query(f"""with {duck('fx_ops')} {EFFECTS_SQL},
lv as (select *, sum(s) over w as size, sum(o) over w as ct, lead(ts_ns) over w as until from delta window w as (partition by locate, side, price order by seq)),
mt as (select 34200000000000 + 60000000000 * unnest(range(0, 391)) as at_ns),
al as (select locate, side, price, size, ct, at_ns from mt join lv on ct > 0 and ts_ns < at_ns and (until is null or until >= at_ns)),
r as (select *, row_number() over (partition by locate, at_ns, side order by case when side = 'B' then -price else price end) as rank from al)
select locate, at_ns, cast(rank as int) as rank, cast(max(price) filter (side = 'B') as bigint) as bid_px, cast(max(size) filter (side = 'B') as bigint) as bid_sz, cast(max(ct) filter (side = 'B') as bigint) as bid_ct,
  cast(max(price) filter (side = 'S') as bigint) as ask_px, cast(max(size) filter (side = 'S') as bigint) as ask_sz, cast(max(ct) filter (side = 'S') as bigint) as ask_ct
from r where rank <= 5 group by locate, at_ns, rank""")
def book_depth_minutes(spark, sf_dir):
    return dayless(book.depth_at(fx(spark, sf_dir), m.OPEN_NS, m.CLOSE_NS, m.MINUTE_NS, 5))


ASOF_SQL = "pr as (select *, ts_ns // 1000000000 * 1000000000 as t from fx_prints), l1_ as (select * replace (ts_ns // 1000000000 * 1000000000 as ts_ns) from fx_l1), st_ as (select * from l1_ qualify row_number() over (partition by locate, ts_ns order by seq desc) = 1)"


def asof_sql(op: str) -> str:
    return f"""with {duck('fx_prints', 'fx_l1')}, {ASOF_SQL}
select p.seq, p.locate, p.t as ts_ns, p.price, p.shares, l.seq as state_seq, l.bid_px, l.ask_px from pr p asof left join st_ l on p.locate = l.locate and p.t {op} l.ts_ns"""


def states_at_prints(spark, sf_dir, strict: bool) -> DataFrame:
    """Prints with the state of the book before (or up to) them; times are cut to seconds, so that many are equal."""
    whole = F.col("ts_ns") - F.col("ts_ns") % m.SECOND_NS
    prints = table(spark, sf_dir, "fx_prints").select("seq", "locate", whole.alias("ts_ns"), "price", "shares")
    rows = asof(prints, table(spark, sf_dir, "fx_l1").withColumn("ts_ns", whole), ["locate"], "ts_ns", "seq", strict)
    return rows.select("seq", "locate", "ts_ns", "price", "shares", F.col("as_of.seq").alias("state_seq"), "as_of.bid_px", "as_of.ask_px")


@query(asof_sql(">"))
def asof_before(spark, sf_dir):
    return states_at_prints(spark, sf_dir, True)


@query(asof_sql(">="))
def asof_up_to(spark, sf_dir):
    return states_at_prints(spark, sf_dir, False)


# through files

def feed_file(spark, sf_dir, header=False) -> DataFrame:
    """The stand-in feed, written to a folder of parts in the shared folder and read as one stream by ranges: seq is a message's place."""
    path = fresh_path(spark, "feed")
    write_frames(message_frames(spark, sf_dir), path)
    return read_frames(spark, path, split=1 << 17, joined=True, header=header)


PLACED = "pl as (select seq, row_number() over (order by seq) - 1 as place from ms)"


@query(f"""with {duck('fx_ops', 'fx_more')} {EFFECTS_SQL}, {TAPE_SQL}, {MESSAGES}, {PLACED}
select place as seq, ts_ns, locate, kind, price, shares, side from tp join pl using (seq)""")
def file_tape(spark, sf_dir):
    return dayless(export.replay(feed_file(spark, sf_dir)).trades)


@query(f"""with {duck('fx_ops', 'fx_more')}, {MESSAGES}, {PLACED}
select ty as kind, count(*) as messages, min(place) as first, max(place) as last, cast(sum(place) as bigint) as places, min(ts_ns) as ts_min, max(ts_ns) as ts_max from ms join pl using (seq)
where locate = 3 and ty in ('A', 'E', 'P') and ts_ns >= 36000000000000 and place < (select max(place) - 100 from pl) group by ty""")
def file_pushed_down(spark, sf_dir):
    """One symbol's messages of three types from an hour on: what is left out is never made into rows."""
    rows = feed_file(spark, sf_dir, header=True)
    last = rows.agg(F.max("seq")).first()[0]
    rows = rows.where((F.col("locate") == 3) & F.col("kind").isin("A", "E", "P") & (F.col("ts_ns") >= 36_000_000_000_000) & (F.col("seq") < last - 100))
    return rows.groupBy("kind").agg(F.count("*").alias("messages"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum("seq").alias("places"), F.min("ts_ns").alias("ts_min"), F.max("ts_ns").alias("ts_max"))


RECORD_ORDER = "row_number() over (order by seq) - 1 as seq"


@query(f"""with {duck('fx_ops', 'fx_more')} {EFFECTS_SQL}, {TAPE_SQL}
select {RECORD_ORDER}, ts_ns, price, shares, locate, case side when 'B' then 66 when 'S' then 83 else 0 end as side, kind, 0 as pad from tp""")
def file_trades(spark, sf_dir):
    path = fresh_path(spark, "trades.bin")
    records.write_records(feed(spark, sf_dir).trades, path, records.TRADE)
    return records.read_records(spark, path, records.TRADE, split=1000)


@query(f"with {duck('fx_ops', 'fx_more')} {TOPS_SQL}, {L1_SQL} select {RECORD_ORDER}, ts_ns, bid_px, ask_px, bid_sz, ask_sz, locate, bid_ct, ask_ct, 0 as pad from l1")
def file_l1(spark, sf_dir):
    path = fresh_path(spark, "l1.bin")
    records.write_records(feed(spark, sf_dir).l1, path, records.L1)
    return records.read_records(spark, path, records.L1, split=1000)


# reconciliation, groups and files

@query(f"""with {duck('fx_closes')},
r as (select symbol, price_usd, shares, official, case when locate % 3 = 0 then 0.2 else 1 end as factor, locate from fx_closes)
select symbol, round(price_usd, 6) as engine_cross_usd, shares as cross_shares, round(official * factor, 6) as close_usd, round((price_usd - official * factor) * 100, 4) as diff_cents,
  case when price_usd is null or official is null then 'unavailable' when abs(price_usd - official * factor) <= 0.005 then 'MATCH' else 'MISMATCH' end as verdict from r""")
def reconcile_close(spark, sf_dir):
    closes = table(spark, sf_dir, "fx_closes")
    splits = closes.where("locate % 3 = 0").select(F.col("symbol").alias("source"), F.explode(F.array(F.lit(1), F.lit(2))).alias("split_num"), F.lit(5).alias("split_den")).withColumn("split_den", F.when(F.col("split_num") == 1, 5).otherwise(2))
    d = activity.reconcile_close(closes.select("symbol", "price_usd", "shares"), closes.select(F.col("symbol").alias("source"), F.col("official").alias("close")), splits)
    return rounded(d.drop("note"))


@query(f"""with {duck('fx_closes')},
r as (select case when price_usd is null or official is null then 'unavailable' when abs(price_usd - official * case when locate % 3 = 0 then 0.2 else 1 end) <= 0.005 then 'MATCH' else 'MISMATCH' end as v from fx_closes)
select count(*) filter (v = 'MATCH') as matched, count(*) filter (v <> 'unavailable') as available, count(*) filter (v = 'unavailable') as unavailable, cast(0 as bigint) as not_listed from r""")
def reconcile_counts(spark, sf_dir):
    closes = table(spark, sf_dir, "fx_closes")
    splits = closes.where("locate % 3 = 0").select(F.col("symbol").alias("source"), F.lit(1).alias("split_num"), F.lit(5).alias("split_den"))
    return activity.reconcile_counts(activity.reconcile_close(closes.select("symbol", "price_usd", "shares"), closes.select(F.col("symbol").alias("source"), F.col("official").alias("close")), splits))


GROUP_SQL = "select distinct locate, case when locate <= 2 then 'SPY' when locate <= 5 then 'VXX' when locate <= 9 then 'TSLA' else 'OTHER' end as symbol, case when locate <= 2 then 'ETF' when locate <= 5 then 'VOL_ETP' when locate <= 9 then 'WIDE_TICK' else 'ordinary' end as grp from b"


@query(f"""with {duck('fx_prints')}, g as ({GROUP_SQL}), v as (select locate, sum(case when kind in (0, 1) then shares else 0 end) as x from fx_prints group by locate)
select grp, round(avg(x), 6) as mean, count(x) as n from v join g using (locate) group by grp""")
def act_group_means(spark, sf_dir):
    symbols = base(spark, sf_dir).selectExpr("locate", "case when locate <= 2 then 'SPY' when locate <= 5 then 'VXX' when locate <= 9 then 'TSLA' else 'OTHER' end as symbol").distinct()
    rows = activity.activity_summary(table(spark, sf_dir, "fx_prints")).select("locate", "day_displayed_vol")
    return rounded(activity.group_means(m.with_symbols(rows, symbols), "day_displayed_vol"))


@query(f"""with {duck('fx_l1')} {horizon_sql('[10, 30, 60, 300]')},
both_ as (
  select locate, h, 'contemporaneous' as design, k, x, y from bk union all
  select locate, h, 'predictive', k, x, lead(y) over (partition by locate, h order by k) from bk)
{fit_sql('both_', 'locate, h, design', 10)},
every as (select distinct locate, h, design from both_), g as ({GROUP_SQL}),
r as (select locate, h, design, case when fine then r2 end as r2 from every left join fit using (locate, h, design)),
u as (select upper(grp) as grp, h, design, r2 from r join g using (locate) union all select 'ALL', h, design, r2 from r)
select grp, cast(h as int) as horizon_s, design, round(quantile_cont(r2, 0.5), 6) as med_r2, count(*) as symbols from u group by all""")
def ofi_median_fits(spark, sf_dir):
    symbols = base(spark, sf_dir).selectExpr("locate", "case when locate <= 2 then 'SPY' when locate <= 5 then 'VXX' when locate <= 9 then 'TSLA' else 'OTHER' end as symbol").distinct()
    return rounded(ofi.median_fits(ofi.ofi_horizons(table(spark, sf_dir, "fx_l1")), symbols))


@query(f"""with {duck('fx_prints', 'fx_l1')}, c as (select (select count(*) from fx_prints) as t, (select count(*) from fx_l1) as l, (select count(*) from fx_prints where seq % 1000 = 7) as p)
select 'trades_size' as name, 'PASS' as status, cast(0 as bigint) as bad union all select 'l1_size', 'FAIL', 5 union all select 'trades_count_meta', 'PASS', 0 union all select 'l1_count_meta', 'FAIL', 1
union all select 'trade_pad', case when p = 0 then 'PASS' else 'FAIL' end, p from c union all select 'l1_pad', 'PASS', 0""")
def verify_files(spark, sf_dir):
    trades = table(spark, sf_dir, "fx_prints").withColumn("pad", F.when(F.col("seq") % 1000 == 7, 1).otherwise(0))
    l1 = table(spark, sf_dir, "fx_l1").withColumn("pad", F.lit(0))
    meta = trades.agg(F.count("*").cast("string").alias("value")).select(F.lit("trades").alias("key"), "value").unionByName(l1.agg((F.count("*") + 1).cast("string").alias("value")).select(F.lit("l1").alias("key"), "value"))
    return verify.verify_files(trades, l1, meta, {"trades": (24 * 1000, 24), "l1": (32 * 1000 + 5, 32)})
