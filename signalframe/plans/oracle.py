"""The same results in DuckDB SQL, written straight from the definitions.

Nothing here is tuned: grids are cross joins, ranks are windows over everything. ``ORACLES`` maps
each query name to its text.
"""

from __future__ import annotations

import numpy as np

from signalframe.operators.sweep import COVERAGES, REGIME_THRESHOLDS, THRESHOLDS
from signalframe.schemas import BASELINE_FEATURES, H7_FEATURES, H7_TARGETS


# Exact in both engines, and columns whose 7th digit is an exact 5; see ``catalog``.
EXACT = {"value", "prev_value", "lag_1d", "lag_2d", "lag_3d", "lag_5d", "lag_21d", "rolling_mean_5d"}
FINE = {"confidence", "web_confidence", "band"}


def r(expression: str, name: str | None = None) -> str:
    """Rounded to 6 digits, without a negative zero."""
    name = name or expression
    if name in EXACT:
        return f"({expression}) + 0e0 as {name}"
    return f"round({expression}, {9 if name in FINE else 6}) + 0e0 as {name}"


def num(x: float) -> str:
    """A double literal with every digit."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


OBSERVATIONS = """observations as (
  select concat('FX', l_returnflag, l_linestatus, 'XCAD') as series_id, cast(l_shipdate as date) as obs_date,
         cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double)
           / cast(sum(cast(l_quantity as bigint)) as double) / 100 as value
  from lineitem group by 1, 2)"""


def gold_ctes(source: str = "observations", name: str = "gold") -> str:
    return f"""{name}_0 as (
  select *, lag(value) over s as prev_value, lag(value, 2) over s as lag_2d, lag(value, 3) over s as lag_3d,
         lag(value, 5) over s as lag_5d, lag(value, 21) over s as lag_21d,
         lead(value) over s as next_1, lead(value, 5) over s as next_5,
         avg(value) over r5 as rolling_mean_5d, avg(value) over r21 as rolling_mean_21d,
         case when count(value) over r5 >= 2 then stddev_samp(value) over r5 end as rolling_std_5d,
         case when count(value) over r21 >= 5 then stddev_samp(value) over r21 end as rolling_std_21d
  from {source}
  window s as (partition by series_id order by obs_date),
         r5 as (partition by series_id order by obs_date rows between 4 preceding and current row),
         r21 as (partition by series_id order by obs_date rows between 20 preceding and current row)),
{name} as (
  select series_id, obs_date, substr(series_id, 3, 3) as base_currency, substr(series_id, 6, 3) as quote_currency,
         value, prev_value,
         (value - prev_value) / nullif(prev_value, 0) as daily_return, ln(value / nullif(prev_value, 0)) as log_return,
         (value - lag_5d) / nullif(lag_5d, 0) as return_5d, (value - lag_21d) / nullif(lag_21d, 0) as return_21d,
         prev_value as lag_1d, lag_2d, lag_3d, lag_5d, lag_21d,
         rolling_mean_5d, rolling_mean_21d, rolling_std_5d, rolling_std_21d,
         rolling_std_5d / nullif(rolling_std_21d, 0) as volatility_ratio,
         rolling_mean_5d / nullif(rolling_mean_21d, 0) - 1 as ma_crossover,
         (value - rolling_mean_21d) / nullif(rolling_mean_21d, 0) as distance_from_ma21,
         cast(isodow(obs_date) - 1 as integer) as day_of_week, cast(day(obs_date) as integer) as day_of_month,
         cast(weekofyear(obs_date) as integer) as week_of_year, cast(month(obs_date) as integer) as month,
         cast(quarter(obs_date) as integer) as quarter, cast(year(obs_date) as integer) as year,
         day(obs_date) = 1 as is_month_start, obs_date = last_day(obs_date) as is_month_end,
         obs_date = last_day(obs_date) and month(obs_date) in (3, 6, 9, 12) as is_quarter_end,
         month(obs_date) = 1 and day(obs_date) = 1 as is_year_start,
         month(obs_date) = 12 and day(obs_date) = 31 as is_year_end,
         ln(next_1 / nullif(value, 0)) as target_return_1d,
         cast(coalesce(ln(next_1 / nullif(value, 0)) > 0, false) as integer) as target_direction_1d,
         (next_5 - value) / nullif(value, 0) as target_return_5d
  from {name}_0)"""


def feature_ctes(eps: str = "0e0") -> str:
    vol = ", ".join(
        f"case when count(ret_1d) over w{n} >= {n} then stddev_samp(ret_1d) over w{n} end as vol_{n}d"
        for n in (5, 10, 21, 63)
    )
    mom = ", ".join(
        f"case when count(ret_1d) over w{n} >= {n} then avg(ret_1d) over w{n} end as mom_{n}d" for n in (5, 10, 21)
    )
    frames = ", ".join(
        f"w{n} as (partition by series_id order by obs_date rows between {n - 1} preceding and current row)"
        for n in (5, 10, 21, 63)
    )
    back = ", ".join(f"value / nullif(lag(value, {n}) over s, 0) - 1 as ret_{n}d" for n in (3, 5, 10, 21))
    needed = " and ".join(f"{c} is not null" for c in H7_FEATURES + H7_TARGETS)
    return f"""f_0 as (
  select series_id, obs_date, value, daily_return as ret_1d, {back},
         lead(value, 7) over s / nullif(value, 0) - 1 as fwd_return_7d
  from gold window s as (partition by series_id order by obs_date)),
f_1 as (select *, {vol}, {mom} from f_0 window {frames}),
f_2 as (
  select *, case when count(vol_21d) over w >= 252 then median(vol_21d) over w end as vol_21_med_252
  from f_1 window w as (partition by series_id order by obs_date rows between 251 preceding and current row)),
f_3 as (
  select *, ret_1d / nullif(vol_21d + {eps}, 0) as zret_1d_21d, ret_1d / nullif(vol_63d + {eps}, 0) as zret_1d_63d,
         (vol_21d + {eps}) / nullif(vol_63d + {eps}, 0) as vol_ratio_21_63,
         cast(coalesce(vol_21d > vol_21_med_252, false) as integer) as is_high_vol,
         cast(isodow(obs_date) - 1 as integer) as day_of_week, cast(month(obs_date) as integer) as month,
         cast(obs_date = last_day(obs_date) as integer) as is_month_end,
         cast(coalesce(fwd_return_7d > 0, false) as integer) as direction_7d
  from f_2),
features as (select * from f_3 where {needed})"""


PREDICTIONS = """h7_a as (
  select *, lag(value) over s as prev_value, value / lag(value) over s - 1 as ret_1d,
         value / lag(value, 5) over s - 1 as ret_5d, lead(value, 7) over s / value - 1 as fwd_return_7d,
         row_number() over (partition by series_id order by obs_date desc) as rd
  from observations window s as (partition by series_id order by obs_date)),
h7_b as (
  select *, case when count(ret_1d) over w >= 21 then stddev_samp(ret_1d) over w end as vol_21d
  from h7_a window w as (partition by series_id order by obs_date rows between 20 preceding and current row)),
h7_c as (
  select *, case when count(vol_21d) over w >= 252 then median(vol_21d) over w end as vol_21_med_252
  from h7_b window w as (partition by series_id order by obs_date rows between 251 preceding and current row)),
h7_base as (
  select *, cast(coalesce(fwd_return_7d > 0, false) as integer) as direction_7d,
         cast(vol_21d > vol_21_med_252 as integer) as is_high_vol
  from h7_c where rd > 7 and vol_21_med_252 is not null),
predictions as (
  select series_id, obs_date, direction_7d as y_true, is_high_vol,
         round(1 / (1 + exp(-1.5 * ret_1d / nullif(vol_21d, 0))), 6) as p_up_logreg,
         round(1 / (1 + exp(-0.5 * ret_5d / nullif(vol_21d, 0))), 6) as p_up_tree
  from h7_base)"""

SILVER_EVENTS = """silver_events as (
  select event_type as series_id, cast(ts as date) as obs_date, value, ts as ingested_at, event_id from events)"""

SUBSCRIPTIONS = """subscriptions as (
  select c_custkey as id, concat('User', c_custkey, '@Example.com') as email,
    case c_custkey % 3 when 0 then 'DAILY' when 1 then 'WEEKLY' else 'MONTHLY' end as frequency,
    case when c_custkey % 3 = 1 and c_custkey % 7 < 5 then
      case c_custkey % 7 when 0 then 'MON' when 1 then 'TUE' when 2 then 'WED' when 3 then 'THU' else 'FRI' end
    end as weekly_day,
    case when c_custkey % 3 = 2 then
      case c_custkey % 5 when 0 then 'FIRST_BUSINESS_DAY' when 1 then 'LAST_BUSINESS_DAY' end end as monthly_timing,
    case c_custkey % 4 when 0 then '' when 1 then 'AFX_CAD' when 2 then 'afx/cad, nfx_cad'
      else 'ROX_CAD,ZZZ_CAD' end as pairs_csv,
    c_acctbal > 0 as verified
  from customer)"""

MODELS = """m as (
  select series_id, obs_date, y_true, is_high_vol, 'p_up_logreg' as model, p_up_logreg as p from predictions
  union all
  select series_id, obs_date, y_true, is_high_vol, 'p_up_tree', p_up_tree from predictions)"""

HIT = "case when (p >= 0.5) = (y_true = 1) then 1e0 else 0e0 end"
# Probabilities are kept one double epsilon away from 0 and 1 before a log is taken.
Q = "least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)"
LL = f"case when y_true = 1 then -ln({Q}) else -ln(1 - {Q}) end"
SE = "(p - y_true) * (p - y_true)"


def with_(*ctes: str, select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


OBS_PRED = (OBSERVATIONS, PREDICTIONS)
GOLD = (OBSERVATIONS, gold_ctes())
FEATURES = (*GOLD, feature_ctes())

GOLD_DOUBLES = [
    "value", "prev_value", "daily_return", "log_return", "return_5d", "return_21d",
    "lag_1d", "lag_2d", "lag_3d", "lag_5d", "lag_21d",
    "rolling_mean_5d", "rolling_mean_21d", "rolling_std_5d", "rolling_std_21d",
    "volatility_ratio", "ma_crossover", "distance_from_ma21", "target_return_1d", "target_return_5d",
]
CALENDAR = [
    "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year",
    "is_month_start", "is_month_end", "is_quarter_end", "is_year_start", "is_year_end",
]
GOLD_SELECT = "select series_id, obs_date, target_direction_1d, " + ", ".join(r(c) for c in GOLD_DOUBLES)
FLAGS = ("is_high_vol", "day_of_week", "month", "is_month_end", "direction_7d")
H7_SELECT = "select series_id, obs_date, " + ", ".join(
    c if c in FLAGS else r(c) for c in H7_FEATURES + H7_TARGETS
)


def bin_of(p: str, bins: int) -> str:
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)][1:-1]
    return "(" + " + ".join(f"case when {p} >= {num(e)} then 1 else 0 end" for e in edges) + ")"


# Metrics of the acted rows of ``a(group columns, act, p, y_true)``, by the given columns.
def acted(by: str, source: str = "a") -> str:
    return f"""acted_bins as (
  select {by}, {bin_of('p', 10)} as bin, count(*) as nb, avg(y_true) as yb, avg(p) as pb
  from {source} where act <> 0 group by {by}, bin),
acted_ece as (
  select {by}, sum(nb * abs(yb - pb)) / sum(nb) as ece from acted_bins group by {by}),
scores as (
  select {by}, count(*) as n, count(*) filter (act <> 0) as n_acted,
         (count(*) filter (act <> 0)) / cast(count(*) as double) as coverage,
         avg(case when (act = 1) = (y_true = 1) then 1e0 else 0e0 end) filter (act <> 0) as acc,
         avg({LL}) filter (act <> 0) as logloss, avg({SE}) filter (act <> 0) as brier,
         (count(*) filter (act = 1)) / nullif(cast(count(*) filter (act <> 0) as double), 0) as act_up_rate,
         (count(*) filter (act = -1)) / nullif(cast(count(*) filter (act <> 0) as double), 0) as act_down_rate,
         count(*) filter (act = 1) as n_up_acted, count(*) filter (act = -1) as n_down_acted
  from {source} group by {by})"""


SCORE_COLUMNS = "n, n_acted, " + ", ".join(r(c) for c in ("coverage", "acc", "logloss", "brier", "ece",
                                                          "act_up_rate", "act_down_rate")) + ", n_up_acted, n_down_acted"


def grid(values, name: str) -> str:
    return f"(select unnest([{', '.join(num(float(v)) for v in values)}]) as {name})"


def low(t: float) -> str:
    return num(1.0 - t)


def thresholds(values) -> str:
    """Rows (t, lo) with lo = 1 - t as the engine's host computes it."""
    rows = ", ".join(f"({num(float(v))}, {low(float(v))})" for v in values)
    return f"(values {rows}) as g(t, lo)"


SWEEP = f"""single as (
  select 'single_model_threshold' as policy, model, t, cast(null as double) as coverage_target, y_true, p,
         case when p >= t then 1 when p <= lo then -1 else 0 end as act
  from m cross join {thresholds(THRESHOLDS)}),
agree as (
  select 'agreement_threshold' as policy, 'logreg_vs_tree' as model, t, cast(null as double) as coverage_target,
         y_true, p_up_logreg as p,
         case when p_up_logreg >= t and p_up_tree >= t then 1
              when p_up_logreg <= lo and p_up_tree <= lo then -1 else 0 end as act
  from predictions cross join {thresholds(THRESHOLDS)}),
ranked as (
  select *, case when p >= 0.5 then 1 else -1 end as side,
         row_number() over (partition by model, p >= 0.5 order by abs(p - 0.5) desc, obs_date, series_id) as rk,
         count(*) over (partition by model) as total
  from m),
sized as (
  select *, cast(round_even(coverage_target * total, 0) as bigint) as k
  from ranked cross join {grid(COVERAGES, 'coverage_target')}),
topk as (
  select 'balanced_topk_confidence' as policy, model, cast(null as double) as t, coverage_target, y_true, p,
         case when side = 1 and rk <= cast(round_even(0.5e0 * k, 0) as bigint) then 1
              when side = -1 and rk <= k - cast(round_even(0.5e0 * k, 0) as bigint) then -1 else 0 end as act
  from sized),
a as (select * from single union all select * from agree union all select * from topk)"""

DEDUP = """latest as (
  select *, row_number() over (partition by series_id, obs_date order by ingested_at desc) as rn from silver_events)"""

LAST_ROWS = """recent as (
  select *, row_number() over (partition by series_id order by obs_date desc) as recency from predictions)"""

PAIR = "concat(substr(series_id, 3, length(series_id) - 5), '_CAD')"


def label(p: str, t: float, slack: float = 0.0) -> str:
    return (
        f"case when {p} >= {num(t - slack)} then 'UP' when {p} <= {num((1.0 - t) + slack)} then 'DOWN' else 'SIDEWAYS' end"
    )


def band(p: str, t: float) -> str:
    d = label(p, t, 1e-10)
    return (
        f"least(greatest(case {d} when 'UP' then ({p} - {num(t)}) / (1 - {num(t)}) "
        f"when 'DOWN' then ((1 - {num(t)}) - {p}) / (1 - {num(t)}) else 0 end, 0), 1)"
    )


DUE = """days as (select unnest([date '1998-06-01', date '1998-05-29', date '1998-06-06']) as run_date),
month_days as (
  select run_date, unnest(generate_series(date_trunc('month', run_date), last_day(run_date), interval 1 day)) as d
  from days),
business as (
  select run_date, cast(min(d) as date) as first_bd, cast(max(d) as date) as last_bd
  from month_days where isodow(d) <= 5 group by run_date),
due as (
  select b.run_date, s.* from subscriptions s cross join business b
  where isodow(b.run_date) <= 5 and (
    frequency = 'DAILY'
    or (frequency = 'WEEKLY' and isodow(b.run_date) =
        case coalesce(weekly_day, 'FRI') when 'MON' then 1 when 'TUE' then 2 when 'WED' then 3 when 'THU' then 4 else 5 end)
    or (frequency = 'MONTHLY' and b.run_date =
        case when monthly_timing = 'LAST_BUSINESS_DAY' then last_bd else first_bd end)))"""

LATEST = """newest as (select * from recent where recency = 1)"""

ROW_RANGE = "count(*) as rows, min(obs_date) as min_obs_date, max(obs_date) as max_obs_date"

STATUS = """status as (
  select series_id, count(*) as records,
         case count(*) % 3 when 0 then 'success' when 1 then 'no_new_files' else 'error' end as status
  from observations group by 1)"""

RESTATED = """observations_restated as (
  select series_id, obs_date, case when day(obs_date) = 13 and year(obs_date) = 1999 then value * 1.01e0 else value end as value
  from observations)"""

#: Bounds of the monthly folds over all series.
POOLED = """days as (
  select obs_date, count(*) as n, sum(count(*)) over (order by obs_date) as upto from features group by 1),
months as (
  select cast(date_trunc('month', obs_date) as date) as test_month, min(obs_date) as first_day, sum(n) as n_test from days group by 1),
pooled as (
  select m.test_month, cast(m.n_test as bigint) as n_test, cast(max(d.upto) as bigint) as n_train, cast(max(d.obs_date) as date) as train_end
  from months m join days d on d.obs_date < m.first_day group by 1, 2 having max(d.upto) >= 504)"""

ORACLES: dict[str, str] = {
    "latest_per_series": with_(*OBS_PRED, LAST_ROWS, select=f"""
select series_id, obs_date, p_up_logreg + 0e0 as p_up_logreg, {label('p_up_logreg', 0.6, 1e-10)} as decision,
       {r(band('p_up_logreg', 0.6), 'confidence')}
from recent where recency = 1"""),
    "gold_load": with_(OBSERVATIONS, select=f"""
select series_id, obs_date, {r('value')} from observations where series_id = 'FXAFXCAD'"""),
    "gold_features": with_(*GOLD, select=GOLD_SELECT + " from gold"),
    "gold_features_chunked": with_(*GOLD, select=GOLD_SELECT + " from gold"),
    "gold_calendar": with_(*GOLD, select=f"""
select series_id, obs_date, base_currency, quote_currency, {', '.join(CALENDAR)} from gold"""),
    "gold_incremental": with_(OBSERVATIONS, RESTATED, gold_ctes("observations_restated"), select=GOLD_SELECT + " from gold"),
    "silver_versions": with_(OBSERVATIONS, RESTATED, select=f"""
select 1 as version, series_id, obs_date, {r('value')} from observations where obs_date <= date '1999-12-31'
union all select 2, series_id, obs_date, {r('value')} from observations_restated"""),
    "changed_keys": with_(OBSERVATIONS, select="""
select series_id, obs_date from observations
where obs_date > date '1999-12-31' or (day(obs_date) = 13 and year(obs_date) = 1999)"""),
    "gold_versions": with_(OBSERVATIONS, RESTATED, gold_ctes("observations_restated"), select=GOLD_SELECT + " from gold"),
    "gold_merge": with_(OBSERVATIONS, select=f"""
select series_id, obs_date, {r("case when obs_date >= date '1999-01-01' then value * 2 else value end", 'value')}
from observations"""),
    "h7_features": with_(*FEATURES, select=H7_SELECT + " from features"),
    "h7_features_chunked": with_(*FEATURES, select=H7_SELECT + " from features"),
    "h7_features_research": with_(*GOLD, feature_ctes("1e-12"), select=H7_SELECT + " from features"),
    "direction_target": with_(OBSERVATIONS, select=f"""
select series_id, obs_date, {r('f', 'target_return_7d')}, cast(f > 0 as integer) as target_direction_7d
from (select *, lead(value, 7) over (partition by series_id order by obs_date) / value - 1 as f from observations)
where f is not null"""),
    "impute_ffill": with_(*GOLD, select="select series_id, obs_date, " + ", ".join(
        r(f"coalesce(last_value(cast({c} as double) ignore nulls) over w, 0e0)", c) for c in BASELINE_FEATURES)
        + " from gold window w as (partition by series_id order by obs_date rows between unbounded preceding and current row)"),
    "contract_violations": with_(OBSERVATIONS, select=f"""
select series_id, obs_date, {r('value')}, {r('given', 'prev_value')}, 'prev_value_mismatch' as kind
from (select *, lag(value) over s as before,
             case when day(obs_date) = 13 then lag(value) over s + 1 else lag(value) over s end as given
      from observations window s as (partition by series_id order by obs_date))
where before is not null and given <> before"""),
    "null_rates": with_(*GOLD, select=" union all ".join(
        f"select '{c}' as \"column\", round(avg(case when {c} is null then 1e0 else 0e0 end), 6) as null_rate from gold"
        for c in GOLD_DOUBLES)),
    "class_balance": with_(*FEATURES, select="""
select direction_7d as label, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share
from features group by 1"""),
    "gap_histogram": with_(OBSERVATIONS, select="""
select gap_days, count(*) as n from (
  select cast(date_diff('day', lag(obs_date) over (partition by series_id order by obs_date), obs_date) as integer) as gap_days
  from observations) where gap_days is not null group by 1 order by n desc, gap_days limit 10"""),
    "feature_target_corr": with_(*FEATURES, "c as (" + " union all ".join(
        f"select '{f}' as feature, round(corr(cast({f} as double), direction_7d), 6) + 0e0 as corr from features"
        for f in H7_FEATURES) + ")", select="""
select * from (
  select 'top' as "end", cast(row_number() over (order by corr desc, feature) as integer) as rank, feature, corr from c
  union all
  select 'bottom', cast(row_number() over (order by corr, feature) as integer), feature, corr from c)
where rank <= 10"""),
    "coerce_numeric": """
select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, try_cast(event_type as double) as bad from events""",
    "series_parts": with_(OBSERVATIONS, select=f"""
select series_id, case when p then substr(series_id, 3, 3) end as base, case when p then substr(series_id, 6, 3) end as quote,
       case when q then {PAIR} end as pair, not q as rejected, case when q then replace({PAIR}, '_', '/') end as label,
       case when starts_with(series_id, 'FX') and length(series_id) >= 8
            then concat(substr(series_id, 3, 3), '/', substr(series_id, 6, 3)) else series_id end as display,
       case when q then series_id end as back,
       case when q then concat(replace({PAIR}, '_', '_'), '_h7') end as slug
from (select *, starts_with(series_id, 'FX') and length(series_id) = 8 as p,
             starts_with(series_id, 'FX') and ends_with(series_id, 'CAD') as q
      from (select distinct series_id from observations
            union select distinct concat('FX', substr(series_id, 3, 3), 'USD') from observations
            union select distinct event_type from events))"""),
    "label_normalise": """
select event_id, case event_type when 'signup' then 'SIDEWAYS' when 'view' then 'UP' when 'click' then 'DOWN' when 'purchase' then 'HOLD' end as label,
       case event_type when 'view' then 'UP' when 'click' then 'DOWN' else 'SIDEWAYS' end as direction,
       case event_type when 'view' then 'UP' when 'click' then 'DOWN' else 'ABSTAIN' end as api_direction,
       case event_type when 'view' then 'BULLISH' when 'click' then 'BEARISH' else 'SIDEWAYS' end as display,
       case event_type when 'view' then 'Bullish' when 'click' then 'Bearish' else 'Neutral' end as word
from events""",
    "pairs_normalise": with_(SUBSCRIPTIONS, select="""
select id, case id % 4 when 0 then '' when 1 then 'AFX_CAD' when 2 then 'AFX_CAD|NFX_CAD' else 'ROX_CAD|ZZZ_CAD' end as pairs,
       case id % 4 when 0 then 0 when 1 then 1 else 2 end as n_pairs
from subscriptions"""),
    "predictions": with_(*OBS_PRED, select=f"""
select obs_date, series_id, p_up_logreg + 0e0 as p_up_logreg, {label('p_up_logreg', 0.6, 1e-10)} as action_logreg
from predictions"""),
    "predictions_wide": with_(*OBS_PRED, gold_ctes(), feature_ctes(), select="""
select p.series_id, p.obs_date, p.y_true, p.p_up_logreg + 0e0 as p_up_logreg, p.p_up_tree + 0e0 as p_up_tree,
       f.is_high_vol, f.is_month_end, f.day_of_week, f.month
from predictions p left join features f using (series_id, obs_date)"""),
    "baseline_probs": with_(*GOLD, select=f"""
select series_id, obs_date, 0.5e0 as p_coin, {r('p', 'p_momentum')}, 1 as yhat_coin, cast(p >= 0.5 as integer) as yhat_momentum,
       0.5e0 as conf_coin, {r('greatest(p, 1 - p)', 'conf_momentum')}
from (select *, 1 / (1 + exp(-1.5 * lag(log_return / (rolling_std_21d + 1e-8)) over s)) as p,
             row_number() over s as rn
      from gold window s as (partition by series_id order by obs_date)) where rn > 504"""),
    "compare_predictions": with_(*OBS_PRED, select=f"""
select {r('corr(p_up_logreg, p_up_tree)', 'corr')}, {r('avg(abs(p_up_logreg - p_up_tree))', 'mae')}, count(*) as n
from predictions"""),
    "metrics_overall": with_(*OBS_PRED, MODELS, select=f"""
select model, count(*) as n, {r(f'avg({HIT})', 'accuracy')}, {r(f'avg({LL})', 'log_loss')}, {r(f'avg({SE})', 'brier')},
       {r('avg(greatest(p, 1 - p))', 'mean_confidence')}, {r('avg(p)', 'mean_p_up')}, {r('avg(y_true)', 'pos_rate')}
from m group by model"""),
    "metrics_by_threshold": with_(*OBS_PRED, MODELS, select=f"""
select model, conf_thr, {r("(count(*) filter (c)) / cast(count(*) as double)", 'coverage')},
       {r(f'avg({HIT}) filter (c)', 'accuracy')}, {r(f'avg({LL}) filter (c)', 'log_loss')}, {r(f'avg({SE}) filter (c)', 'brier')}
from (select *, greatest(p, 1 - p) >= conf_thr as c from m cross join {grid((0.5, 0.55, 0.6, 0.65, 0.7), 'conf_thr')})
group by model, conf_thr"""),
    "metrics_by_bucket": with_(*OBS_PRED, MODELS, select=f"""
select model, bucket, count(*) as n, {r('count(*) / cast(any_value(total) as double)', 'coverage')},
       {r(f'avg({HIT})', 'accuracy')}, {r('avg(p)', 'avg_p_up')}, {r('avg(y_true)', 'pos_rate')},
       {r('avg(greatest(p, 1 - p))', 'avg_confidence')}
from (select *, count(*) over (partition by model) as total,
             case when p < 0 then null when p < 0.4e0 then '[0.00,0.40)' when p < 0.45e0 then '[0.40,0.45)'
                  when p < 0.55e0 then '[0.45,0.55)' when p < 0.6e0 then '[0.55,0.60)'
                  when p < 1e0 then '[0.60,1.00]' end as bucket from m)
where bucket is not null group by model, bucket"""),
    "metrics_by_year_all": with_(*OBS_PRED, f"""a as (
  select cast(year(obs_date) as integer) as year, y_true, p_up_logreg as p,
         case when p_up_logreg >= 0.6e0 then 1 when p_up_logreg <= {low(0.6)} then -1 else 0 end as act from predictions)""",
        acted("year"), select=f"""
select year, n_acted, {r('coverage')}, {r('acc')}, {r('logloss')} from scores"""),
    "metrics_by_year": with_(*OBS_PRED, f"""a as (
  select cast(year(obs_date) as integer) as year, y_true, p_up_logreg as p,
         case when p_up_logreg >= 0.6e0 then 1 when p_up_logreg <= {low(0.6)} then -1 else 0 end as act from predictions)""",
        acted("year"), select=f"""
select year, n_acted, {r('coverage')}, {r('acc')}, {r('logloss')} from scores order by acc nulls last, year limit 5"""),
    "calibration_line": with_(*OBS_PRED, MODELS, select=f"""
select model, {r('regr_intercept(y_true, p)', 'cal_intercept')}, {r('regr_slope(y_true, p)', 'cal_slope')} from m group by model"""),
    "ece": with_(*OBS_PRED, MODELS, f"""b as (
  select model, 10 as bins, {bin_of('p', 10)} as bin, count(*) as n, avg(y_true) as y, avg(p) as p from m group by model, bin
  union all
  select model, 20, {bin_of('p', 20)} as bin, count(*), avg(y_true), avg(p) from m group by model, bin)""", select=f"""
select model, bins, {r('sum(n * abs(y - p)) / sum(n)', 'ece')}, cast(sum(n) as bigint) as n from b group by model, bins"""),
    "reliability_bins": with_(*OBS_PRED, MODELS, "edges as (select * from (values " + ", ".join(
        f"({i}, {num(float(np.linspace(0, 1, 11)[i]))}, {num(float(np.linspace(0, 1, 11)[i + 1]))})" for i in range(10)
        ) + ") as t(bin, p_lo, p_hi))", f"""b as (
  select model, {bin_of('p', 10)} as bin, count(*) as n, avg(p) as p_mean, avg(y_true) as y_mean from m group by model, bin)""",
        select=f"""
select k.model, e.bin, {r('e.p_lo', 'p_lo')}, {r('e.p_hi', 'p_hi')}, coalesce(b.n, 0) as n, {r('b.p_mean', 'p_mean')}, {r('b.y_mean', 'y_mean')}
from (select distinct model from m) k cross join edges e left join b on b.model = k.model and b.bin = e.bin"""),
    "policy_labels": with_(*OBS_PRED, select=f"""
select series_id, obs_date, {label('p_up_logreg', 0.55, 1e-10)} as decision_55, {label('p_up_logreg', 0.55)} as action_55,
       {label('p_up_logreg', 0.6, 1e-10)} as decision_60, {label('p_up_tree', 0.6)} as action_tree_60,
       case {label('p_up_logreg', 0.6)} when 'UP' then 1 when 'DOWN' then -1 else 0 end as side_60
from predictions"""),
    "policy_confidence": with_(*OBS_PRED, select=f"""
select series_id, obs_date, {r(band('p_up_logreg', 0.6), 'band')}, {r('greatest(p_up_logreg, 1 - p_up_logreg)', 'plain')},
       {r(f"case when p_up_logreg >= 0.6e0 then p_up_logreg when p_up_logreg <= {low(0.6)} then 1 - p_up_logreg else 0e0 end", 'served')},
       case when {label('p_up_logreg', 0.6, 1e-10)} = 'SIDEWAYS' then 'Low' when abs(p_up_logreg - 0.5) * 2 >= 0.4e0 then 'High'
            when abs(p_up_logreg - 0.5) * 2 >= 0.2e0 then 'Moderate' else 'Low' end as word
from predictions"""),
    "policy_eval": with_(*OBS_PRED, MODELS, f"""a as (
  select model, y_true, p, case when p >= 0.6e0 then 1 when p <= {low(0.6)} then -1 else 0 end as act from m)""",
        acted("model"), select=f"select model, {SCORE_COLUMNS} from scores left join acted_ece using (model)"),
    "policy_sweep": with_(*OBS_PRED, MODELS, SWEEP, acted("policy, model, t, coverage_target"), select=f"""
select s.policy, s.model, s.t, s.coverage_target, {SCORE_COLUMNS},
       {r('least(act_up_rate, act_down_rate)', 'min_side_frac')},
       coalesce(n_acted > 0 and least(act_up_rate, act_down_rate) < 0.2e0, false) as direction_collapse
from scores s left join acted_ece e on s.policy = e.policy and s.model = e.model
  and s.t is not distinct from e.t and s.coverage_target is not distinct from e.coverage_target"""),
    "policy_by_regime": with_(*OBS_PRED, MODELS, f"""a as (
  select is_high_vol, 'single_model_threshold' as policy, model, t, y_true, p,
         case when p >= t then 1 when p <= lo then -1 else 0 end as act
  from m cross join {thresholds(REGIME_THRESHOLDS)})""", acted("is_high_vol, policy, model, t"), select=f"""
select is_high_vol, policy, model, t, {SCORE_COLUMNS} from scores left join acted_ece using (is_high_vol, policy, model, t)"""),
    "balanced_topk": with_(*OBS_PRED, select="""
select series_id, obs_date, y_true, p_up_logreg + 0e0 as p_up_logreg, act, rk as rank from (
  select *, case when p_up_logreg >= 0.5 then 1 else -1 end as act,
         row_number() over (partition by p_up_logreg >= 0.5 order by abs(p_up_logreg - 0.5) desc, obs_date, series_id) as rk,
         cast(round_even(0.2e0 * count(*) over (), 0) as bigint) as k from predictions)
where rk <= case when act = 1 then k // 2 else k - k // 2 end"""),
    "rolling_policy_metrics": with_(*OBS_PRED, f"""ranked as (
  select *, case when p_up_logreg >= 0.5 then 1 else -1 end as side, p_up_logreg as p,
         row_number() over (partition by series_id, p_up_logreg >= 0.5 order by abs(p_up_logreg - 0.5) desc, obs_date) as rk,
         cast(round_even(0.2e0 * count(*) over (partition by series_id), 0) as bigint) as k from predictions),
a as (select *, case when rk <= case when side = 1 then k // 2 else k - k // 2 end then side else 0 end as act from ranked),
w as (
  select series_id, obs_date, row_number() over (partition by series_id order by obs_date) as rn,
         cast(sum(case when act <> 0 then 1 else 0 end) over f as bigint) as n_acted,
         avg(case when act <> 0 then case when (act = 1) = (y_true = 1) then 1e0 else 0e0 end end) over f as acc,
         avg(case when act <> 0 then {LL} end) over f as logloss
  from a window f as (partition by series_id order by obs_date rows between 251 preceding and current row))""", select=f"""
select series_id, obs_date, n_acted, {r('case when n_acted >= 30 then acc end', 'acc')},
       {r('case when n_acted >= 30 then logloss end', 'logloss')} from w where rn >= 252"""),
    "walkforward_folds": with_(*FEATURES, """months as (
  select distinct series_id, cast(date_trunc('month', obs_date) as date) as test_month from features)""", select="""
select m.series_id, m.test_month, count(*) filter (f.obs_date < m.test_month) as n_train,
       least(count(*) filter (f.obs_date < m.test_month), 252) as n_cal,
       count(*) filter (date_trunc('month', f.obs_date) = m.test_month) as n_test,
       cast(max(f.obs_date) filter (f.obs_date < m.test_month) as date) as train_end
from months m join features f on f.series_id = m.series_id and f.obs_date < m.test_month + interval 1 month
group by m.series_id, m.test_month having count(*) filter (f.obs_date < m.test_month) >= 504"""),
    "silver_dedup": with_(SILVER_EVENTS, DEDUP, select=f"""
select series_id, obs_date, {r('value')}, ingested_at, event_id from latest where rn = 1"""),
    "silver_since": with_(SILVER_EVENTS, DEDUP, select=f"""
select series_id, obs_date, {r('value')}, ingested_at, event_id from latest where rn = 1 and obs_date > date '2024-01-15'"""),
    "silver_upsert": with_(SILVER_EVENTS, DEDUP, select=f"""
select series_id, obs_date, {r('value')}, ingested_at, event_id from latest where rn = 1"""),
    "bronze_scan": with_(OBSERVATIONS, select=f"""
select series_id, obs_date, {r('value')}, substr(series_id, 3, 3) as base_currency, 'CAD' as quote_currency,
       concat(cast(year(obs_date) as varchar), '-12-31 12:00:00') as ingested_at
from observations"""),
    "stream_silver": with_(OBSERVATIONS, select=f"""
select series_id, obs_date, {r('value * 2', 'value')} from observations"""),
    "landing_audit": """
select page_id, sha256(html) as sha256, cast(octet_length(encode(html)) as bigint) as bytes from pages""",
    "input_ranges": with_(OBSERVATIONS, select=f"select series_id, {ROW_RANGE} from observations group by 1"),
    "rows_by_series": with_(*OBS_PRED, select="select series_id, count(*) as rows from predictions group by 1"),
    "coverage_missing": with_(OBSERVATIONS, select="""
select distinct series_id, 'outputs' as missing_in from observations where series_id = 'FXAFXCAD'
union all select distinct event_type, 'inputs' from events"""),
    "latest_artifacts": with_(*OBS_PRED, LAST_ROWS, select=f"""
select {PAIR} as pair, obs_date, cast(count(*) over (partition by series_id) - recency + 1 as integer) as row_no,
       p_up_logreg + 0e0 as p_up_logreg, p_up_tree + 0e0 as p_up_tree,
       {label('p_up_logreg', 0.6)} as action_logreg, {label('p_up_tree', 0.6)} as action_tree,
       {label('p_up_logreg', 0.6, 1e-10)} as decision, {r(band('p_up_logreg', 0.6), 'confidence')}
from recent where recency <= 365"""),
    "signal_history": with_(*OBS_PRED, LAST_ROWS, select=f"""
select {PAIR} as pair, max(obs_date) as obs_date, string_agg(d, ',' order by obs_date) as history,
       max_by(d, obs_date) as direction
from (select *, {label('p_up_logreg', 0.6, 1e-10)} as d from recent where recency <= 7) group by series_id"""),
    "lookup_latest": with_(*OBS_PRED, LAST_ROWS, LATEST, SUBSCRIPTIONS, """asked as (
  select distinct upper(replace(trim(p), '/', '_')) as pair
  from (select unnest(string_split(pairs_csv, ',')) as p from subscriptions) where trim(p) <> '')""", select=f"""
select a.pair, replace(a.pair, '_', '/') as pair_label, n.obs_date,
       case when n.obs_date is null then 'ABSTAIN' when p_up_logreg >= 0.6e0 then 'UP' when p_up_logreg <= {low(0.6)} then 'DOWN' else 'ABSTAIN' end as direction,
       case when n.obs_date is null then 'SIDEWAYS' else {label('p_up_logreg', 0.6, 1e-10)} end as web_direction,
       {r('case when n.obs_date is null then 0e0 else greatest(p_up_logreg, 1 - p_up_logreg) end', 'confidence')},
       {r('case when n.obs_date is null then 0e0 else ' + band('p_up_logreg', 0.6) + ' end', 'web_confidence')},
       {r('coalesce(p_up_logreg, 0.5e0)', 'p_up')}
from asked a left join newest n on a.pair = {PAIR.replace('series_id', 'n.series_id')}"""),
    "serving_header": with_(*OBS_PRED, LAST_ROWS, LATEST, select="""
select 'h7' as horizon, '2024-01-15T00:00:00Z' as as_of, max(obs_date) as run_date, count(*) as n_items from newest"""),
    "confidence_histogram": with_(*OBS_PRED, """c as (
  select floor(case when p_up_logreg >= 0.6e0 then p_up_logreg when p_up_logreg <= 0.4e0 then 1 - p_up_logreg else 0 end * 100 + 0.5) as pc
  from predictions)""", select="""
select bucket, count(pc) as n from (values ('0-20%', 0, 20), ('20-40%', 20, 40), ('40-60%', 40, 60), ('60-80%', 60, 80), ('80-100%', 80, 100)) b(bucket, lo, hi)
left join c on pc > 0 and pc > lo and pc <= hi group by bucket"""),
    "run_summary": with_(OBSERVATIONS, STATUS, select="""
select bool_and(status in ('success', 'no_new_files')) as ok, count(*) filter (status = 'success') as success,
       count(*) filter (status = 'error') as failed, count(*) as total, cast(sum(records) as bigint) as total_records from status"""),
    "resume_pending": with_(OBSERVATIONS, STATUS, select="select series_id from status where status <> 'success'"),
    "subscribers_active": with_(SUBSCRIPTIONS, select="""
select id, email, frequency, weekly_day, monthly_timing, upper(replace(replace(replace(pairs_csv, ' ', ''), '/', '_'), ',', '|')) as pairs,
       'America/Toronto' as timezone from subscriptions where verified"""),
    "subscription_validate": with_(SUBSCRIPTIONS, """q as (
  select *, case when id % 11 = 0 then concat('User', id) else email end as mail,
         concat('2024-02-', lpad(cast(id % 40 as varchar), 2, '0')) as run_text from subscriptions)""", """v as (
  select *, case when id % 11 = 0 then 'email' when pairs_csv = '' then 'pairs'
                 when frequency = 'WEEKLY' and weekly_day is null then 'weekly_day'
                 when frequency = 'MONTHLY' and monthly_timing is null then 'monthly_timing' end as why from q)""", select="""
select id, lower(mail) as email, why is null as accepted, why as reason, substr(sha256(lower(mail)), 1, 16) as subscription_key,
       try_strptime(run_text, '%Y-%m-%d') is not null as date_ok from v"""),
    "due_subscribers": with_(SUBSCRIPTIONS, DUE, select="select run_date, id from due"),
    "digest_rows": with_(*OBS_PRED, LAST_ROWS, LATEST, SUBSCRIPTIONS, DUE, """wanted as (
  select run_date, id, concat('FX', replace(upper(replace(trim(p), '/', '_')), '_', '')) as series_id
  from (select run_date, id, unnest(string_split(pairs_csv, ',')) as p from due where pairs_csv <> '')
  union all select run_date, id, n.series_id from due cross join newest n where pairs_csv = '')""", select=f"""
select run_date, id, series_id, concat(substr(series_id, 3, 3), '/', substr(series_id, 6, 3)) as pair_label, obs_date as signal_date,
       case {label('p_up_logreg', 0.6, 1e-10)} when 'UP' then 'Bullish' when 'DOWN' then 'Bearish' else 'Neutral' end as signal,
       case when {label('p_up_logreg', 0.6, 1e-10)} = 'SIDEWAYS' then 'Low' when abs(p_up_logreg - 0.5) * 2 >= 0.4e0 then 'High'
            when abs(p_up_logreg - 0.5) * 2 >= 0.2e0 then 'Moderate' else 'Low' end as confidence_word,
       printf('%.1f%%', p_up_logreg * 100) as probability, strftime(run_date, '%B %d, %Y') as run_date_text
from wanted join newest using (series_id)"""),
    "subscription_state": """
with placed as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events),
ended as (select user_id, coalesce(max(n) filter (event_type = 'error'), 0) as e from placed group by 1)
select user_id, min(ts) as created_at, max(ts) as updated_at, max_by(value, n) as value, max_by(props, n) as props,
       min_by(event_id, n) as first_event_id
from placed join ended using (user_id) where event_type <> 'error' and n > e group by 1""",
    "subscription_verify": """
with s as (
  select c_custkey as id, md5(concat('token', c_custkey)) as token,
         cast(timestamp '2024-01-01 00:00:00' + to_days(cast(c_nationkey as integer)) as timestamp) as expires,
         case when c_acctbal > 5000 then timestamp '2023-12-01 00:00:00' end as verified_at from customer),
j as (
  select s.*, s.id in (select o_custkey from orders) and expires >= timestamp '2024-01-10 00:00:00' and verified_at is null as takes from s)
select id, case when takes then timestamp '2024-01-10 00:00:00' else verified_at end as verified_at,
       case when takes then timestamp '2024-01-10 00:00:00' end as updated_at,
       case when not takes then token end as verification_token, case when not takes then expires end as verification_expires_at
from j""",
    "quota_windows": """
select window_start, user_id, event_id, n, n <= 3 as allowed, greatest(3 - n, 0) as remaining,
       window_start + interval 1 day as reset_at
from (select event_id, user_id, date_trunc('day', ts) as window_start,
             row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as n from events)""",
    "quota_retained": """
select date_trunc('day', ts) as window_start, user_id, count(*) as n, greatest(count(*) - 3, 0) as refused,
       greatest(3 - count(*), 0) as remaining
from events where date_trunc('day', ts) >= timestamp '2024-01-21 00:00:00' - interval 24 hour group by 1, 2""",
    "stream_quota": """
select date_trunc('day', ts) as window_start, user_id, count(*) as n from events group by 1, 2""",
    "toronto_dates": """
select event_id, cast((ts at time zone 'UTC') at time zone 'America/Toronto' as date) as local_date,
       concat(strftime(date_trunc('second', (ts at time zone 'UTC') at time zone 'America/Toronto'), '%Y-%m-%dT%H:%M:%S'), '-05:00') as local_iso
from events""",
    "gold_scan": with_(OBSERVATIONS, select=f"select series_id, {ROW_RANGE} from observations group by 1"),
    "gold_scan_rejects": "select 'mixed' as folder, 'mixed' as reason, 1 as files union all select 'torn', 'no rows', 1",
    "publish_run": with_(*OBS_PRED, select=f"""
select obs_date, series_id, p_up_logreg + 0e0 as p_up_logreg, {label('p_up_logreg', 0.6, 1e-10)} as action_logreg from predictions"""),
    "run_manifest": with_(*OBS_PRED, select="""
select o.series_id, o.rows, o.lo as min_obs_date, o.hi as max_obs_date, p.rows as prediction_rows,
       p.lo as first_prediction, p.hi as last_prediction
from (select series_id, count(*) as rows, min(obs_date) as lo, max(obs_date) as hi from observations group by 1) o
full join (select series_id, count(*) as rows, min(obs_date) as lo, max(obs_date) as hi from predictions group by 1) p
  using (series_id)"""),
    "observed_manifest": with_(*OBS_PRED, gold_ctes("observations"), """facts as (
  select 'gold' as output, count(*) as rows, min(obs_date) as a, max(obs_date) as b, cast(sum(cast('0x' || substr(md5(coalesce(cast(series_id as varchar), '') || '|' || coalesce(cast(cast(obs_date as date) as varchar), '')), 1, 8) as bigint)) as bigint) as checksum,
         map {'series_id': 0, 'obs_date': 0, 'lag_21d': count(*) filter (lag_21d is null), 'return_5d': count(*) filter (return_5d is null)} as nulls from gold
  union all
  select 'predictions', count(*), min(obs_date), max(obs_date), cast(sum(cast('0x' || substr(md5(coalesce(cast(series_id as varchar), '') || '|' || coalesce(cast(cast(obs_date as date) as varchar), '') || '|' || coalesce(cast(y_true as varchar), '')), 1, 8) as bigint)) as bigint),
         map {'series_id': 0, 'obs_date': 0, 'y_true': count(*) filter (y_true is null)} from predictions)""", select="""
select output, rows, cast(cast(a as date) as varchar) as first_date, cast(cast(b as date) as varchar) as last_date, checksum, n.key as column, n.value as nulls
from (select *, unnest(map_entries(nulls)) as n from facts)"""),
    "run_manifest_document": with_(*OBS_PRED, select="""
select '2024-01-15' as run_date, 'input' as section, series_id as name, count(*) as rows, min(obs_date) as min_obs_date, max(obs_date) as max_obs_date,
       null as sha256 from observations group by series_id
union all
select '2024-01-15', 'predictions', series_id, count(*), (select min(obs_date) from predictions), (select max(obs_date) from predictions), null
from predictions group by series_id
union all
select '2024-01-15', 'file', 'model', strlen(count(*)::varchar) + 1, null, null, sha256(count(*)::varchar || chr(10)) from predictions"""),
    "subscription_status": """
select user_id, min(ts) filter (event_type <> 'error') as created_at, max(ts) as updated_at,
       case when list_last(list(event_type order by ts, event_id)) = 'error' then 'inactive' else 'active' end as status
from events group by 1 having count(*) filter (event_type <> 'error') > 0""",
    "ingest_watermark": with_(SILVER_EVENTS, """marks as (
  select series_id, max(ingested_at) as mark from silver_events
  where obs_date <= date '2024-01-20' and series_id <> 'signup' group by 1)""", select="""
select s.* from silver_events s left join marks using (series_id) where mark is null or ingested_at > mark"""),
    "payload_audit": with_(OBSERVATIONS, select="""
select series_id, concat(cast(year(obs_date) as varchar), '-12-31') as ingest_date, cast(count(*) as integer) as observations_count,
       'observations' as keys, true as hashed
from observations group by series_id, year(obs_date)"""),
    "latest_documents": with_(*OBS_PRED, LAST_ROWS, select=f"""
select {PAIR} as pair, 'h7' as horizon, cast(count(*) as integer) as n_rows, min(obs_date) as first_date, max(obs_date) as last_date,
       max_by({label('p_up_logreg', 0.6, 1e-10)}, obs_date) as last_decision
from recent where recency <= 365 group by series_id"""),
    "metrics_clipped": with_(*OBS_PRED, MODELS, select=f"""
select model, count(*) as n, {r("avg(case when y_true = 1 then -ln(q) else -ln(1 - q) end)", 'log_loss')}, {r(f'avg({SE})', 'brier')}
from (select *, least(greatest(p, 1e-6), 1 - 1e-6) as q from m) group by model"""),
}

BOUNDS = (*FEATURES, """months as (
  select distinct series_id, cast(date_trunc('month', obs_date) as date) as test_month from features), bounds as (
  select m.series_id, m.test_month, count(*) filter (f.obs_date < m.test_month) as n_train,
         count(*) filter (date_trunc('month', f.obs_date) = m.test_month) as n_test,
         cast(max(f.obs_date) filter (f.obs_date < m.test_month) as date) as train_end
  from months m join features f on f.series_id = m.series_id and f.obs_date < m.test_month + interval 1 month
  group by m.series_id, m.test_month having count(*) filter (f.obs_date < m.test_month) >= 504)""")

ORACLES |= {
    "predictions_sink": with_(*OBS_PRED, select="""
select row_number() over (order by obs_date, series_id) as position, obs_date, series_id from predictions"""),
    "features_sink": with_(*FEATURES, select=f"select series_id, {ROW_RANGE} from features group by 1"),
    "metrics_sink": f"select year, n_acted from ({ORACLES['metrics_by_year_all']}) t",
    "metrics_sorted": f"""
select year, acc, row_number() over (order by acc nulls last, year) as position from ({ORACLES['metrics_by_year_all']}) t""",
    "coerce_columns": """
select event_id, 'double' as numbers_type, 'string' as mixed_type, value as numbers from events""",
    "subscriber_table": "select c_custkey, c_nationkey, c_acctbal from customer",
    "walkforward_bounds": with_(*BOUNDS, select="""
select f.series_id, f.obs_date, f.direction_7d as y_true, b.test_month, b.train_end, b.n_train, b.n_test
from features f join bounds b on f.series_id = b.series_id and date_trunc('month', f.obs_date) = b.test_month"""),
    "walkforward_pooled_bounds": with_(*FEATURES, POOLED, select="""
select f.series_id, f.obs_date, f.direction_7d as y_true, p.test_month, p.train_end, p.n_train, p.n_test, true as is_share
from features f join pooled p on cast(date_trunc('month', f.obs_date) as date) = p.test_month"""),
    "pooled_calibration": with_(*FEATURES, POOLED, """tested as (
  select f.obs_date, f.direction_7d as y from features f join pooled p on cast(date_trunc('month', f.obs_date) as date) = p.test_month),
tail as (select distinct obs_date from tested where obs_date < date '2001-01-01' order by obs_date desc limit 252)""", select="""
select 'calibration' as part, count(*) as n_rows, cast(sum(y) as bigint) as positives, count(*) as shares, cast(sum(y) as double) as fitted
from tested join tail using (obs_date) having count(*) > 0
union all
select 'later', count(*), cast(sum(y) as bigint), count(*), null from tested where obs_date >= date '2001-01-01' having count(*) > 0"""),
    "offsets_optimum": with_(*FEATURES, select="""
select concat('series_id=', series_id) as term, count(*) as n_rows, true as settled from features group by 1
union all select c.name, f.n, true from (select count(*) as n from features) f,
(select unnest(['""" + "', '".join(H7_FEATURES) + """']) as name) c"""),
    "walkforward_calibration_sizes": with_(*BOUNDS, select="""
select f.series_id, f.obs_date, f.direction_7d as y_true, b.test_month, least(b.n_train, 252) as cal_size
from features f join bounds b on f.series_id = b.series_id and date_trunc('month', f.obs_date) = b.test_month"""),
    "fit_per_series_sizes": with_(*FEATURES, select="""
select series_id, 22 as terms, count(*) as n_rows from features group by 1"""),
    "score_global_actions": with_(*FEATURES, select="select series_id, obs_date, true as is_share, true as follows from features"),
}
ORACLES |= {
    "h7_features_moving": ORACLES["h7_features"],
    "h7_features_bucketed": ORACLES["h7_features"],
    "predictions_wide_bucketed": ORACLES["predictions_wide"],
    "stored_audit": with_(OBSERVATIONS, select="""
select series_id, concat(cast(year(obs_date) as varchar), '-12-31') as ingest_date, cast(1 as bigint) as files, cast(1 as bigint) as hashes,
       count(*) as observations_count, true as as_sidecar_says, true as stored
from observations group by series_id, year(obs_date)"""),
    "required_columns": with_(*GOLD, select="""
select "column", known, "column" in ('obs_date', 'series_id', 'value', 'prev_value') as refused_without,
       true as refused_with_another, false as refused
from (unpivot (select """ + ", ".join(f"count({c}) as {c}" for c in ["series_id", "obs_date", "target_direction_1d", *GOLD_DOUBLES]) + """ from gold)
      on columns(*) into name "column" value known)"""),
    "selected_features": with_(*FEATURES, select=" union all ".join(f"""
select {n} as position, '{c}' as feature, round(cast(sum({c}) as double), 4) + 0e0 as total, count(*) as n_rows from features"""
    for n, c in enumerate(sorted(H7_FEATURES)))),
    "per_series_optimum": with_(*FEATURES, select="""
select series_id, unnest(['intercept', '""" + "', '".join(H7_FEATURES) + """']) as term, n_rows, true as settled
from (select series_id, count(*) as n_rows from features group by 1)"""),
}
# The streams end where the batch queries do.
for _stream, _batch in (("stream_quota_requests", "quota_windows"), ("stream_subscriptions", "subscription_state"), ("stream_verifications", "subscription_verify")):
    ORACLES[_stream] = ORACLES[_batch]
