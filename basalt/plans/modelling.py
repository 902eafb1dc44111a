"""Feature, matrix, validation, baseline, metric and drift queries."""

from __future__ import annotations

from basalt.plans.dialect import DAY_US, FOUR_HOURS_US, MINERALS, SHIFTS, WEEK_US, Dialect, in_list, silver, tele

SIX_HOURS_US = 21_600_000_000


def prefix_week(d: Dialect) -> str:
    """Trailing 7-day mean and count of the grade by front, [t - 7d, t), by prefix sums: linear in the rows.

    Probes at t - 7d precede events of the same instant; a probe's prefix is taken off the event's.  Grades have four
    decimals, so sums are kept in whole units and differences are exact.
    """
    return tele(d) + f""", marks as (
      select event_id, front, us as tick, 1 as kind, grade from tele union all select event_id, front, us - {WEEK_US}, 0, null from tele),
    run as (select event_id, kind, coalesce(sum(cast(round(grade * 10000) as bigint)) over w, 0) as s, count(grade) over w as c from marks
      window w as (partition by front order by tick, kind, event_id rows between unbounded preceding and 1 preceding)),
    week as (select event_id, cast(sum(case when kind = 1 then s else -s end) as bigint) as s, cast(sum(case when kind = 1 then c else -c end) as bigint) as c from run group by event_id)"""


def matrix(d: Dialect) -> str:
    """Shift cells of a front with their causal history and next-shift target."""
    start = f"{d.us('cast(local_date as timestamp)')} + {SIX_HOURS_US} * (case shift when 'N2' then 0 when 'D1' then 1 when 'D2' then 2 else 3 end)"
    return tele(d) + f""", cells as (
      select front, local_date, shift, min(sector) as sector, {start} as start_us, {start} + {SIX_HOURS_US} as close_us, avg(grade) as grade, count(grade) as n_grades, count(*) as n_events,
        count(failure_code) as n_failures, avg(cast(maint as double)) as maint, max({d.us('ts_local')}) as last_us, max(vibration) as max_vibration, avg(temp) as temp, avg(pressure) as pressure
      from tele group by front, local_date, shift),
    history as (
      select *, (close_us - last_us) / 6e7 as idle_min, lag(grade, 1) over w as grade_lag1, lag(grade, 2) over w as grade_lag2,
        avg(grade) over (partition by front order by start_us rows between 2 preceding and current row) as grade_mean3,
        stddev_samp(grade) over (partition by front order by start_us rows between 2 preceding and current row) as grade_std3,
        avg(grade) over (partition by front order by start_us rows between 9 preceding and current row) as grade_mean10,
        (start_us - lag(start_us) over w) / {DAY_US}e0 as days_since, cast(row_number() over w - 1 as bigint) as n_before,
        lead(grade) over w as target, lead(start_us) over w as target_start
      from cells window w as (partition by front order by start_us))"""


def split(d: Dialect) -> str:
    return matrix(d) + f""", usable as (select * from history where target is not null and target_start is not null and grade is not null),
      cut as (select {d.pct('start_us', 0.8)} as c from usable),
      dev as (select u.* from usable u cross join cut where u.start_us <= c), test as (select u.* from usable u cross join cut where u.start_us > c)"""


def label(d: Dialect) -> str:
    """Failures of the front in (close, close + 4h], by running counts over events and probes."""
    local = d.us("ts_local")
    return matrix(d) + f""", points as (
      select front, {local} as tick, 0 as kind, case when failure_code is not null then 1 else 0 end as f, 1 as e, cast(null as bigint) as cell from tele
      union all select front, close_us, 1, 0, 0, start_us from cells union all select front, close_us + {FOUR_HOURS_US}, 2, 0, 0, start_us from cells),
    running as (select front, cell, kind, sum(f) over w as f, sum(e) over w as e from points window w as (partition by front order by tick, case when kind = 0 then 0 else 1 end, kind, coalesce(cell, 0) rows between unbounded preceding and current row)),
    ahead as (select front, cell, cast(sum(case when kind = 2 then f else -f end) as bigint) as failures, cast(sum(case when kind = 2 then e else -e end) as bigint) as events from running where kind > 0 group by front, cell),
    labelled as (select c.*, case when a.failures > 0 then 1 else 0 end as y, a.events as events_ahead from cells c join ahead a on c.front = a.front and c.start_us = a.cell)"""


def folds(d: Dialect, n: int = 5) -> str:
    steps = " union all ".join(f"select {k} as fold" for k in range(1, n + 1))
    return split(d) + f""", span as (select min(start_us) as a, max(start_us) as b from dev), steps as ({steps}),
      blocks as (select fold, a + {d.idiv('(b - a) * fold', str(n + 1))} as block_start, a + {d.idiv('(b - a) * (fold + 1)', str(n + 1))} as block_end, a as first_us from span cross join steps)"""


def scored(d: Dialect) -> str:
    """Labelled cells of the last fifth, scored by the training failure rate of their front."""
    return label(d) + f""", limit_ as (select {d.pct('start_us', 0.8)} as c from labelled), rates as (select front, avg(cast(y as double)) as rate from labelled cross join limit_ where start_us <= c group by front),
      prior as (select avg(cast(y as double)) as p from labelled cross join limit_ where start_us <= c),
      scored as (select l.front, l.start_us, l.y, round(coalesce(r.rate, p), 9) as score, l.events_ahead from labelled l cross join limit_ cross join prior left join rates r on l.front = r.front where l.start_us > c)"""


def curve(d: Dialect) -> str:
    return scored(d) + """, steps as (select score, cast(sum(y) as double) as pos, cast(count(*) - sum(y) as double) as neg from scored group by score),
      curve as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n from steps window w as (order by score desc rows between unbounded preceding and current row))"""


PARTS = """parts as (select b.g, greatest(coalesce(rc.n, 0) / cast(rt.t as double), 1e-6) as pr, greatest(coalesce(ec.n, 0) / cast(et.t as double), 1e-6) as pa
        from bins b join rt on b.g = rt.g join et on b.g = et.g left join rc on b.g = rc.g and b.bin = rc.bin left join ec on b.g = ec.g and b.bin = ec.bin),
      psi as (select g, round(sum((pa - pr) * ln(pa / pr)), 6) as psi, count(*) as n_bins from parts group by g)"""


def psi(d: Dialect, column: str, by: str | None, reference: str, evaluation: str) -> str:
    """PSI of column between two conditions over ``windowed``; bins from the reference's unique inner deciles.

    A group's cuts are one array, against which a row finds its bin in place: one aggregate a side, no row numbers.
    """
    if not d.spark:
        return _psi_by_rows(d, column, by, reference, evaluation)
    g = by or "'all'"
    deciles = ", ".join(f"{k / 10}e0" for k in range(1, 10))
    side = lambda where: f"(select {g} as g, round({column}, 9) as x from windowed where {where} and {column} is not null)"
    counted = lambda rows: f"(select r.g, size(filter(c.cs, v -> v <= r.x)) as bin, count(*) as n from {rows} r join cuts c on r.g = c.g group by 1, 2)"
    return f"""ref as {side(reference)}, eva as {side(evaluation)},
      cuts as (select g, array_distinct(transform(percentile(x, array({deciles})), v -> round(v, 9))) as cs from ref group by g),
      bins as (select g, explode(sequence(0, size(cs))) as bin from cuts),
      rc as {counted('ref')}, ec as {counted('eva')},
      rt as (select g, count(*) as t from ref group by g), et as (select g, count(*) as t from eva group by g),
      {PARTS}"""


def _psi_by_rows(d: Dialect, column: str, by: str | None, reference: str, evaluation: str) -> str:
    """The oracle's PSI: every row meets every cut."""
    g = by or "'all'"
    qs = " union all ".join(f"select g, {d.pct('x', round(0.1 * k, 1))} as c from ref group by g" for k in range(1, 10))
    return f"""ref as (select {g} as g, round({column}, 9) as x from windowed where {reference} and {column} is not null), eva as (select {g} as g, round({column}, 9) as x from windowed where {evaluation} and {column} is not null),
      cuts as (select distinct g, round(c, 9) as c from ({qs}) as q),
      bins as (select g, 0 as bin from ref group by g union all select g, cast(row_number() over (partition by g order by c) as int) from cuts),
      ref_n as (select r.g, cast(sum(case when c.c <= r.x then 1 else 0 end) as int) as bin, r.x from (select g, x, row_number() over (partition by g order by x) as id from ref) r join cuts c on r.g = c.g group by r.g, r.id, r.x),
      eva_n as (select r.g, cast(sum(case when c.c <= r.x then 1 else 0 end) as int) as bin, r.x from (select g, x, row_number() over (partition by g order by x) as id from eva) r join cuts c on r.g = c.g group by r.g, r.id, r.x),
      rc as (select g, bin, count(*) as n from ref_n group by g, bin), ec as (select g, bin, count(*) as n from eva_n group by g, bin),
      rt as (select g, count(*) as t from ref group by g), et as (select g, count(*) as t from eva group by g),
      {PARTS}"""


VERDICT = "case when psi > 0.2 then 'critical' when psi > 0.1 then 'moderate' else 'stable' end"


def windowed(d: Dialect, grade: str = "grade", vibration: str = "vibration") -> str:
    """Evaluation: the last 7 local days; reference: the 30 days before."""
    return tele(d) + f""", ends as (select max({d.us('ts_local')}) as last_us from tele),
      windowed as (select front, sector, {grade} as grade, {vibration} as vibration, temp, {d.us('ts_local')} > last_us - {WEEK_US} as is_eval, {d.us('ts_local')} <= last_us - {WEEK_US} and {d.us('ts_local')} > last_us - {37 * DAY_US} as is_ref from tele cross join ends)"""


def target_stats(d: Dialect) -> str:
    return tele(d) + ", stats as (select mineral, sum(grade) as s, count(grade) as n from tele group by mineral), prior as (select avg(grade) as p from tele)"


def drift_report(d: Dialect) -> str:
    """Verdict and bins of each sector; shares are printed as decimals, which both dialects write alike."""
    share = lambda x: f"cast(cast(round({x}, 6) as decimal(10, 6)) as {'string' if d.spark else 'varchar'})"
    one = f"concat('[', {share('pr')}, ',', {share('pa')}, ']')"
    bins = f"array_join(array_sort(collect_list({one})), ',')" if d.spark else f"array_to_string(list_sort(list({one})), ',')"
    detail = f"detail as (select g, concat('[', {bins}, ']') as bins from parts group by g)"
    return f"with {windowed(d)}, {psi(d, 'grade', 'sector', 'is_ref', 'is_eval')}, {detail} select p.g as scope, psi, {VERDICT} as verdict, bins from psi p join detail b on p.g = b.g"


def impute_window_median(d: Dialect) -> str:
    """A missing grade becomes the median of its front and mineral's week before, if that has five readings.

    Spark looks back by ``operators.rolling``.
    """
    return f"""with {tele(d)}, week_before as (select * from tele), gaps as (select event_id, front, mineral, us from tele where grade is null),
      near as (select g.event_id, {d.pct('t.grade', 0.5)} as med, count(t.grade) as n
        from gaps g join week_before t on t.front = g.front and t.mineral = g.mineral and true and t.us >= g.us - {WEEK_US} and t.us < g.us and t.grade is not null
        group by g.event_id)
      select g.event_id, case when n.n >= 5 then round(n.med, 6) end as grade, coalesce(n.n, 0) < 5 as flag_imputed from gaps g left join near n on g.event_id = n.event_id"""


QUERIES = {
    "event_features": lambda d: f"with {prefix_week(d)} select t.event_id, case when w.c > 0 then w.s / 10000.0e0 / w.c end as grade_week_mean, w.c as grade_week_count, round(last_value(t.grade {'' if d.spark else 'ignore nulls'}) {'ignore nulls' if d.spark else ''} over (partition by t.front order by t.us rows between unbounded preceding and 1 preceding), 6) as grade_lag1, round((t.us - lag(t.us) over (partition by t.front order by t.us)) / {DAY_US}e0, 9) as days_since from tele t join week w on t.event_id = w.event_id",
    "event_flags_ratios": lambda d: f"with {tele(d)} select event_id, coalesce(temp > 88, false) as thermal_risk, coalesce(temp > 95, false) as overheat, coalesce(vibration > 12, false) as shaking, round(case when advance > 0 then pressure * rpm / advance end, 6) as specific_energy, round(case when rpm > 0 then (temp - 38) / rpm end, 9) as overtemp from tele",
    "impute_window_median": impute_window_median,
    "measured_target": lambda d: f"with {tele(d)} select event_id, grade as measured, grade is null as was_imputed from tele",
    "ordinal_encode": lambda d: f"with {tele(d)} select event_id, case mineral {' '.join(f'when {chr(39)}{m}{chr(39)} then {i}' for i, m in enumerate(MINERALS))} end as mineral_code, case shift {' '.join(f'when {chr(39)}{m}{chr(39)} then {i}' for i, m in enumerate(SHIFTS))} end as shift_code from tele",
    "target_encode_stats": lambda d: f"with {target_stats(d)} select mineral, round(s, 4) as s, n, round(p, 9) as prior from stats cross join prior",
    "target_encode_loo": lambda d: f"with {target_stats(d)} select t.event_id, round(case when s.n - (case when t.grade is null then 0 else 1 end) + 10 <= 0 then p else (s.s - coalesce(t.grade, 0) + 10 * p) / (s.n - (case when t.grade is null then 0 else 1 end) + 10) end, 6) as encoded from tele t join stats s on t.mineral = s.mineral cross join prior",
    "target_encode_apply": lambda d: f"with {target_stats(d)}, fresh as (select event_id, case when event_id % 5 = 0 then 'NEW' else mineral end as mineral from tele) select f.event_id, round(coalesce((s.s + 10 * p) / (s.n + 10), p), 6) as encoded from fresh f cross join prior left join stats s on f.mineral = s.mineral",
    "frente_level_encode": lambda d: f"with {tele(d)}, level as (select front, avg(grade) as m from tele where event_id % 4 <> 0 group by front), prior as (select avg(grade) as p from tele where event_id % 4 <> 0) select t.event_id, round(coalesce(m, p), 6) as level from tele t cross join prior left join level l on t.front = l.front",
    "matrix_guards": lambda d: f"with {tele(d)} select cast(sum(case when grade_raw < 0 then 1 else 0 end) as bigint) as sentinels, cast(sum(case when front is null then 1 else 0 end) as bigint) as null_keys, cast(sum(case when shift not in {in_list(SHIFTS)} then 1 else 0 end) as bigint) as unknown_shifts from tele",
    "shift_matrix_cells": lambda d: f"with {matrix(d)} select front, local_date, shift, sector, start_us, round(grade, 6) as grade, n_grades, n_events, n_failures, round(maint, 9) as maint, last_us, max_vibration, round(temp, 6) as temp, round(pressure, 6) as pressure from cells",
    "shift_close_inactivity": lambda d: f"with {matrix(d)} select front, local_date, shift, close_us, round(idle_min, 4) as idle_min from history",
    "shift_history": lambda d: f"with {matrix(d)} select front, local_date, shift, round(grade_lag1, 6) as grade_lag1, round(grade_lag2, 6) as grade_lag2, round(grade_mean3, 6) as grade_mean3, round(grade_std3, 6) as grade_std3, round(grade_mean10, 6) as grade_mean10, round(days_since, 6) as days_since, n_before from history",
    "next_shift_target": lambda d: f"with {split(d)} select front, local_date, shift, round(target, 6) as target, target_start from usable",
    "feature_sets": lambda d: f"with {split(d)} select front, start_us, round(grade, 6) as grade, round(grade_lag1, 6) as grade_lag1, n_events, round(idle_min, 4) as idle_min from usable",
    "failure_label_4h": lambda d: f"with {label(d)} select front, local_date, shift, y, events_ahead, events_ahead > 0 as window_has_records from labelled",
    "temporal_split": lambda d: f"with {split(d)} select front, start_us, 'dev' as part from dev union all select front, start_us, 'test' from test",
    "walk_forward_blocks": lambda d: f"with {folds(d)} select fold, block_start, block_end from blocks",
    "walk_forward_purged": lambda d: f"with {folds(d)} select b.fold, cast(sum(case when x.target_start < b.block_start then 1 else 0 end) as bigint) as train, cast(sum(case when x.start_us >= b.block_start and (x.start_us < b.block_end or b.fold = 5 and x.start_us = b.block_end) then 1 else 0 end) as bigint) as validate from dev x cross join blocks b group by b.fold",
    "sliding_window_sizes": lambda d: f"with {folds(d)}, sizes as (select 5 as days union all select 10 union all select 20) select b.fold, s.days, cast(sum(case when x.target_start < b.block_start and x.start_us >= greatest(b.first_us, b.block_start - s.days * {DAY_US}) then 1 else 0 end) as bigint) as train from dev x cross join blocks b cross join sizes s group by b.fold, s.days",
    "baseline_persistencia": lambda d: f"with {split(d)} select front, start_us, round(grade, 6) as predicted, round(target, 6) as actual from test",
    "baseline_nivel_frente": lambda d: f"with {split(d)}, level as (select front, avg(target) as m from dev group by front), prior as (select avg(target) as p from dev) select t.front, t.start_us, round(coalesce(m, p), 6) as predicted, round(target, 6) as actual from test t cross join prior left join level l on t.front = l.front",
    "baseline_prevalencia": lambda d: f"with {label(d)} select round(avg(cast(y as double)), 9) as prevalence, count(*) as n from labelled",
    "baseline_tasa_frente": lambda d: f"with {label(d)} select front, round(avg(cast(y as double)), 9) as rate, count(*) as n from labelled group by front",
    "baseline_actividad": lambda d: f"with {label(d)}, binned as (select y, case when m is null then 'none' when m <= 30 then '0-30' when m <= 60 then '30-60' when m <= 120 then '60-120' when m <= 240 then '120-240' else '240+' end as bin from (select y, (close_us - last_us) / 6e7 as m from labelled) as x) select bin, round(avg(cast(y as double)), 9) as rate, count(*) as n from binned group by bin",
    "class_weight": lambda d: f"with {label(d)} select case when sum(y) > 0 then round((count(*) - sum(y)) / cast(sum(y) as double), 9) else 1.0e0 end as weight from labelled",
    "regression_metrics": lambda d: f"with {split(d)} select count(*) as n, round(avg(abs(target - grade)), 6) as mae, round(sqrt(avg((target - grade) * (target - grade))), 6) as rmse, round(100 * avg(abs(target - grade)) / abs(avg(target)), 6) as relative_pct, round(case when var_pop(target) = 0 then 0 else 1 - avg((target - grade) * (target - grade)) / var_pop(target) end, 6) as r2 from test",
    "improvement_pct": lambda d: f"with {split(d)}, m as (select avg(target) as p from dev) select round(100 * (avg(abs(target - grade)) - avg(abs(target - p))) / avg(abs(target - grade)), 6) as improvement from test cross join m",
    "error_por_frente": lambda d: f"with {split(d)} select front, round(avg(abs(target - grade)), 6) as mae, count(*) as n from test group by front",
    "classification_metrics": lambda d: f"with {curve(d)}, m as (select sum((tp - (tp - pos)) / p * (tp / (tp + fp))) as ap, max(case when tp / (tp + fp) >= 0.5 then tp / p else 0 end) as recall, sum(neg * ((tp - pos) + pos / 2)) / max(p * n) as auc, max(p) / max(p + n) as base from curve) select round(ap, 6) as ap, round(recall, 6) as recall_at_half, round(auc, 6) as auc, round(base, 6) as base_rate, round(ap / base, 6) as lift, (select round(avg((score - y) * (score - y)), 6) from scored) as brier from m",
    "calibration_por_frente": lambda d: f"with {scored(d)} select front, round(avg(score), 6) as mean_score, round(avg(cast(y as double)), 6) as actual, count(*) as n from scored group by front",
    "cv_fold_summary": lambda d: f"with {folds(d)}, per as (select b.fold, avg(abs(x.target - x.grade)) as mae from dev x join blocks b on x.start_us >= b.block_start and x.start_us < b.block_end group by b.fold) select round(avg(mae), 6) as mean_mae, round(stddev_samp(mae), 6) as std_mae, count(*) as n_folds from per",
    "cv_baseline_eval": lambda d: f"with {folds(d)}, level as (select b.fold, x.front, avg(x.target) as m from dev x join blocks b on x.target_start < b.block_start group by b.fold, x.front), prior as (select b.fold, avg(x.target) as p from dev x join blocks b on x.target_start < b.block_start group by b.fold) select b.fold, round(avg(abs(x.target - coalesce(m, p))), 6) as mae, count(*) as n from dev x join blocks b on x.start_us >= b.block_start and x.start_us < b.block_end join prior q on q.fold = b.fold left join level l on l.fold = b.fold and l.front = x.front group by b.fold",
    "window_choice": lambda d: f"with {folds(d)}, sizes as (select 5 as days union all select 10 union all select 20 union all select 1000), level as (select b.fold, s.days, avg(x.target) as m from dev x join blocks b on x.target_start < b.block_start cross join sizes s where x.start_us >= b.block_start - s.days * {DAY_US} group by b.fold, s.days), per as (select l.days, b.fold, avg(abs(x.target - m)) as mae from dev x join blocks b on x.start_us >= b.block_start and x.start_us < b.block_end join level l on l.fold = b.fold group by l.days, b.fold), agg as (select days, avg(mae) as mae, stddev_samp(mae) as sd from per group by days), wide as (select mae, sd from agg where days = 1000) select a.days, round(a.mae, 6) as mae, a.mae < w.mae - w.sd as beats_expanding from agg a cross join wide w",
    "model_ranking": lambda d: f"with {split(d)}, level as (select front, avg(target) as m from dev group by front), prior as (select avg(target) as p from dev), e as (select 'persistence' as model, avg(abs(target - grade)) as mae from test union all select 'front_level', avg(abs(target - coalesce(m, p))) from test t cross join prior left join level l on t.front = l.front union all select 'prior', avg(abs(target - p)) from test cross join prior) select model, round(mae, 6) as mae, cast(rank() over (order by mae) as bigint) as place from e",
    "independence_table": lambda d: f"with {label(d)}, p as (select avg(case when failure_code is null then 0e0 else 1e0 end) as p from tele) select bin, count(*) as n, round(avg(cast(events_ahead as double)), 6) as mean_events, round(avg(cast(y as double)), 6) as observed, round(avg(1 - power(1 - p, events_ahead)), 6) as expected from (select y, events_ahead, case when events_ahead = 0 then '0' when events_ahead <= 2 then '1-2' when events_ahead <= 5 then '3-5' else '6+' end as bin from labelled) as x cross join p group by bin",
    "oracle_residual_bins": lambda d: f"with {split(d)}, o as (select abs(target - avg(target) over (partition by front)) as r, days_since from usable) select case when days_since is null then 'first' when days_since <= 0.5 then '0-0.5' when days_since <= 1 then '0.5-1' when days_since <= 3 then '1-3' else '3+' end as bin, count(*) as n, round(avg(r), 6) as residual from o group by 1",
    "temporal_cut": lambda d: f"with {split(d)}, c as (select max(start_us) - {6 * DAY_US} as cut_us from usable) select case when start_us < cut_us then 'train' else 'evaluate' end as part, count(*) as n from usable cross join c group by 1",
    "window_mae": lambda d: f"with {split(d)}, c as (select max(start_us) - {6 * DAY_US} as cut_us from usable), m as (select front, avg(target) as m from usable cross join c where start_us < cut_us group by front) select round(avg(abs(u.target - m.m)), 6) as mae, count(*) as n from usable u cross join c join m on m.front = u.front where u.start_us >= cut_us",
    "drift_windows": lambda d: f"with {windowed(d)} select is_eval, is_ref, count(*) as n from windowed group by 1, 2",
    "psi_global": lambda d: " ".join(["with", windowed(d), ",", psi(d, "grade", None, "is_ref", "is_eval"), f"select 'grade' as variable, psi, n_bins, {VERDICT} as verdict from psi"]),
    "psi_vibration": lambda d: " ".join(["with", windowed(d), ",", psi(d, "vibration", None, "is_ref", "is_eval"), f"select 'vibration' as variable, psi, n_bins, {VERDICT} as verdict from psi"]),
    "psi_by_sector": lambda d: " ".join(["with", windowed(d), ",", psi(d, "grade", "sector", "is_ref", "is_eval"), f"select g as sector, psi, n_bins, {VERDICT} as verdict from psi"]),
    "psi_perturbed": lambda d: " ".join(["with", windowed(d, vibration="vibration * 1.4e0"), ",", psi(d, "case when is_eval then vibration else vibration / 1.4e0 end", None, "is_ref", "is_eval"), f"select psi, {VERDICT} as verdict from psi"]),
    "retrain_decision": lambda d: " ".join(["with", windowed(d), ",", psi(d, "grade", None, "is_ref", "is_eval"), "select psi > 0.2 or 0.31e0 > 0.26e0 * 1.15 as retrain, concat_ws(';', case when psi > 0.2 then 'psi' end, case when 0.31e0 > 0.26e0 * 1.15 then 'error' end) as reasons from psi"]),
    "promotion_decision": lambda d: f"with {split(d)}, e as (select avg(abs(target - grade)) as production, avg(abs(target - coalesce(grade_mean10, grade))) as staging from test) select round(production, 6) as production, round(staging, 6) as staging, case when staging < production then 'promote' else 'rollback' end as outcome from e",
    "matrix_fingerprint": lambda d: f"with {split(d)} select {'substring(sha2(s, 256), 1, 12)' if d.spark else 'substring(sha256(s), 1, 12)'} as fingerprint from (select concat(cast(count(*) as string), '|', cast(min(start_us) as string), '|', cast(max(start_us) as string), '|', cast(sum(n_events) as string)) as s from usable) as x",
    "drift_report": drift_report,
    "quarantine_rate_by_sector": lambda d: f"with {silver(d)} select sector, count(*) as n, cast(sum(case when r_physical_limit or r_unknown_mineral or r_null_key then 1 else 0 end) as bigint) as rejected from judged where not r_duplicate group by sector",
}
