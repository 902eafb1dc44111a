"""Exploratory statistics."""

from __future__ import annotations

from basalt.plans.dialect import DAY_US, WEEK_US, Dialect, tele

SENSORS = ("tons", "pressure", "rpm", "advance", "vibration", "temp")
PAIRS = [(a, b) for i, a in enumerate(SENSORS) for b in SENSORS[i + 1 :]]


def each(d: Dialect, rows: list[dict[str, str]], relation: str = "tele") -> str:
    """One row of aggregates for each of rows; Spark computes all of them in one scan and stacks them."""
    if not d.spark:
        return " union all ".join("select " + ", ".join(f"{x} as {name}" for name, x in row.items()) + f" from {relation}" for row in rows)
    inner = ", ".join(f"{x} as x{i}_{j}" for i, row in enumerate(rows) for j, x in enumerate(row.values()))
    cells = ", ".join(f"x{i}_{j}" for i, row in enumerate(rows) for j in range(len(row)))
    return f"select stack({len(rows)}, {cells}) as ({', '.join(rows[0])}) from (select {inner} from {relation}) as aggregates"


def profile(d: Dialect) -> str:
    columns = ("grade", "mineral", "front", "failure_code", "equipment")
    missing = lambda c: f"count(*) - count({c})"
    return each(d, [{"column_name": f"'{c}'", "n_null": missing(c), "pct_null": f"round(100.0e0 * ({missing(c)}) / count(*), 4)", "n_distinct": f"count(distinct {c})"} for c in columns])


def describe(d: Dialect) -> str:
    def row(c: str) -> dict[str, str]:
        quantiles = {name: f"round({d.pct(c, q)}, 6)" for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
        return {
            "column_name": f"'{c}'", "n": f"count({c})", "mean": f"round(avg({c}), 6)", "std": f"round(stddev_samp({c}), 6)",
            "low": f"round(min({c}), 6)", **quantiles, "high": f"round(max({c}), 6)",
        }

    return each(d, [row(c) for c in (*SENSORS, "grade")])


def spearman(d: Dialect) -> str:
    """Correlations of average ranks.

    Spark ranks distinct values by their running counts, so the ordered window sees one row a value, and joins the
    ranks back; the oracle ranks the rows themselves.
    """
    rho = each(d, [{"a": f"'{a}'", "b": f"'{b}'", "rho": f"round(corr({a}, {b}), 6)"} for a, b in PAIRS], "ranked")
    if not d.spark:
        return f"with {tele(d)}, ranked as ({ranks(SENSORS, 'tele')}) {rho}"
    tables = ", ".join(
        f"of_{c} as (select v, sum(n) over (order by v rows between unbounded preceding and current row) - n + (n + 1) / 2.0e0 as r"
        f" from (select {c} as v, count(*) as n from tele group by {c}) as counted)"
        for c in SENSORS
    )
    joins = " ".join(f"join of_{c} on tele.{c} = of_{c}.v" for c in SENSORS)
    return f"with {tele(d)}, {tables}, ranked as (select {', '.join(f'of_{c}.r as {c}' for c in SENSORS)} from tele {joins}) {rho}"


ERRORS = "select count(*) as n, " + ", ".join(
    f"round({x}, 6) as {name}"
    for name, x in (
        ("rmse_mean", "sqrt(avg((grade - m) * (grade - m)))"), ("rmse_median", "sqrt(avg((grade - med) * (grade - med)))"),
        ("mae_mean", "avg(abs(grade - m))"), ("mae_median", "avg(abs(grade - med))"),
    )
) + " from near where n >= 5"


def mean_vs_median(d: Dialect) -> str:
    """Every reading against the mean and the median of its front's week before, of five readings at least.

    Spark looks back by ``operators.rolling``.
    """
    near = f"""probe as (select event_id, front, us, grade from tele where grade is not null), week_before as (select * from tele),
      near as (select p.event_id, p.grade, avg(t.grade) as m, {d.pct('t.grade', 0.5)} as med, count(*) as n
        from probe p join week_before t on t.front = p.front and true and t.us >= p.us - {WEEK_US} and t.us < p.us and t.grade is not null
        group by p.event_id, p.grade)"""
    return f"with {tele(d)}, {near} {ERRORS}"


def r2_group_mean(d: Dialect) -> str:
    """Share of the grade's variance between fronts; Spark joins the means to the rows, no window holds all of them."""
    if not d.spark:
        return f"with {tele(d)}, m as (select grade, avg(grade) over (partition by front) as g, avg(grade) over () as a from tele where grade is not null) select round(1 - sum((grade - g) * (grade - g)) / sum((grade - a) * (grade - a)), 6) as r2 from m"
    means = "graded as (select front, grade from tele where grade is not null), fronts as (select front, avg(grade) as g from graded group by front), every as (select avg(grade) as a from graded)"
    return f"with {tele(d)}, {means} select round(1 - sum((grade - g) * (grade - g)) / sum((grade - a) * (grade - a)), 6) as r2 from (select r.grade, f.g, e.a from graded r join fronts f on r.front <=> f.front cross join every e) as m"


def bands(column: str, cuts: tuple) -> str:
    """Left-closed bands, named by their position."""
    return "case " + " ".join(f"when {column} < {c} then {i}" for i, c in enumerate(cuts)) + f" else {len(cuts)} end"


def ranks(columns, relation: str) -> str:
    """Average ranks (ties share the mean rank)."""
    inner = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0e0 as {c}" for c in columns)
    return f"select {inner} from {relation}"


def moment_skew(c: str) -> str:
    """Bias-corrected skewness from raw moments."""
    return f"case when count({c}) > 2 and stddev_pop({c}) > 0 then sqrt(count({c}) * (count({c}) - 1.0e0)) / (count({c}) - 2) * (avg({c} * {c} * {c}) - 3 * avg({c}) * avg({c} * {c}) + 2 * avg({c}) * avg({c}) * avg({c})) / power(stddev_pop({c}), 3) end"


THRESHOLDS = {"temp_88": "temp > 88", "temp_95": "temp > 95", "vibration_12": "vibration > 12", "rpm_1400": "rpm > 1400"}

QUERIES = {
    "eda_profile": lambda d: f"with {tele(d)} {profile(d)}",
    "eda_duplicates": lambda d: f"with {tele(d)} select count(*) - (select count(*) from (select distinct * from tele) as x) as full_rows, count(*) - count(distinct us) as timestamps, count(distinct front) as fronts, count(distinct mineral) as minerals from tele",
    "eda_pearson": lambda d: f"with {tele(d)} " + each(d, [{"a": f"'{a}'", "b": f"'{b}'", "r": f"round(corr({a}, {b}), 6)"} for a, b in PAIRS]),
    "eda_spearman": spearman,
    "eda_describe": lambda d: f"with {tele(d)} " + describe(d),
    "eda_frequency": lambda d: f"with {tele(d)}, n as (select mineral, count(*) as n from tele group by mineral) select mineral, n, round(100.0e0 * n / sum(n) over (), 4) as pct from n",
    "eda_simultaneity": lambda d: f"with {tele(d)}, m as (select date_trunc('minute', ts) as minute, count(*) as n, count(distinct front) as f from tele group by 1) select max(n) as most_events, max(f) as most_fronts, count(*) as minutes from m",
    "eda_monthly_volume": lambda d: f"with {tele(d)} select cast(date_trunc('month', ts_local) as date) as month, count(*) as n from tele group by 1",
    "eda_category_profile": lambda d: f"with {tele(d)} select sector, count(*) as n, round(avg(grade), 6) as mean_grade, round(100.0e0 * count(failure_code) / count(*), 6) as failure_pct from tele group by sector",
    "eda_expected_band": lambda d: f"with {tele(d)}, p as (select count(failure_code) / cast(count(*) as double) as p from tele) select front, count(*) as n, round(100 * p.p - 196 * sqrt(p.p * (1 - p.p) / count(*)), 6) as low, round(100 * p.p + 196 * sqrt(p.p * (1 - p.p) / count(*)), 6) as high from tele cross join p group by front, p.p",
    "eda_two_proportions": lambda d: f"with {tele(d)}, c as (select cast(count(case when maint = 1 then 1 end) as double) as n1, cast(count(case when maint = 1 then failure_code end) as double) as x1, cast(count(case when maint = 0 then 1 end) as double) as n2, cast(count(case when maint = 0 then failure_code end) as double) as x2 from tele) select round(x1 / n1, 6) as p1, round(x2 / n2, 6) as p2, round((x1 / n1 - x2 / n2) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) as z, round(x1 / n1 - x2 / n2 - 1.96e0 * sqrt(x1 / n1 * (1 - x1 / n1) / n1 + x2 / n2 * (1 - x2 / n2) / n2), 6) as low, round(x1 / n1 - x2 / n2 + 1.96e0 * sqrt(x1 / n1 * (1 - x1 / n1) / n1 + x2 / n2 * (1 - x2 / n2) / n2), 6) as high from c",
    "eda_dispersion": lambda d: f"with {tele(d)} select front, round(avg(grade), 6) as mean, round(stddev_samp(grade), 6) as std, round(stddev_samp(grade) / avg(grade), 6) as cv, round({moment_skew('grade')}, 4) as skew from tele group by front",
    "eda_mean_vs_median": mean_vs_median,
    "eda_thresholds": lambda d: f"with {tele(d)} " + " union all ".join(f"select '{n}' as threshold, count(case when {c} then 1 end) as n, round(100.0e0 * count(case when {c} then 1 end) / count(*), 6) as pct, round(count(case when {c} then failure_code end) / nullif(cast(count(case when {c} then 1 end) as double), 0), 6) as failure_rate, round(count(case when {c} then failure_code end) / nullif(cast(count(failure_code) as double), 0), 6) as captured from tele" for n, c in THRESHOLDS.items()),
    "eda_failure_delta": lambda d: f"with {tele(d)} " + " union all ".join(f"select '{c}' as sensor, round(avg(case when failure_code is not null then {c} end), 6) as failing, round(avg(case when failure_code is null then {c} end), 6) as normal from tele" for c in SENSORS),
    "eda_failure_codes": lambda d: f"with {tele(d)} select {d.regex('failure_code', '^[^-]+-([^-]+)-')} as subsystem, failure_code, count(*) as n from tele where failure_code is not null group by 1, 2",
    "eda_gap_bands": lambda d: f"with {tele(d)}, g as (select (us - lag(us) over (partition by front order by us)) / 6e7 as m from tele) select {bands('m', (30, 60, 120, 240))} as band, count(*) as n, round(100.0e0 * count(*) / sum(count(*)) over (), 4) as pct_pairs, round(100.0e0 * sum(m) / sum(sum(m)) over (), 4) as pct_time from g where m is not null group by 1",
    "eda_hierarchy_check": lambda d: f"with {tele(d)} select max(n) as most_sectors_of_a_front, count(*) as fronts from (select front, count(distinct sector) as n from tele group by front) as x",
    "eda_sentinel_rate": lambda d: f"with {tele(d)} select shift, round(avg(case when grade is null then 1e0 else 0e0 end), 9) as rate, count(*) as n from tele group by shift",
    "eda_range_by_grouping": lambda d: f"with {tele(d)} " + " union all ".join(f"select '{g}' as grouping_name, round(min(m), 6) as low, round(max(m), 6) as high, round(max(m) - min(m), 6) as range_ from (select avg(grade) as m from tele group by {g}) as x{i}" for i, g in enumerate(("front", "sector", "mineral", "shift", "equipment"))),
    "eda_r2_group_mean": r2_group_mean,
    "eda_lag_autocorr": lambda d: f"with {tele(d)}, r as (select front, us, grade - avg(grade) over (partition by front) as r from tele where grade is not null), l as (select r, lag(r) over (partition by front order by us) as p from r) select round(corr(r, p), 6) as autocorrelation from l",
    "eda_cadence": lambda d: f"with {tele(d)}, g as (select front, (us - lag(us) over (partition by front order by us)) / 6e7 as m from tele) select front, round({d.pct('m', 0.5)}, 4) as median_min, round(avg(m), 4) as mean_min, count(m) as n from g group by front",
    "eda_monotonic": lambda d: f"with {tele(d)}, s as (select front, local_date, shift, tons - lag(tons) over (partition by front, local_date, shift order by us) as step from tele), c as (select front, local_date, shift, min(step) as least from s group by front, local_date, shift) select round(avg(case when least >= 0 or least is null then 1e0 else 0e0 end), 6) as share, count(*) as cells from c",
    "eda_busiest_cell": lambda d: f"with {tele(d)}, c as (select front, local_date, shift, count(*) as n from tele group by front, local_date, shift) select front, local_date, shift, n from c order by n desc, front, local_date, shift limit 1",
    "eda_crosstab_turno_hora": lambda d: f"with {tele(d)} select cast(hour(ts_local) as bigint) as hour_, " + ", ".join(f"count(case when shift = '{s}' then 1 end) as {s.lower()}" for s in ("N2", "D1", "D2", "N1")) + " from tele group by 1",
    "eda_activity_front_month": lambda d: f"with {tele(d)} select front, year_month, count(*) as n, round(count(*) / cast(count(distinct local_date) as double), 6) as per_day from tele group by front, year_month",
    "eda_temp_bands": lambda d: f"with {tele(d)} select {bands('temp', (50, 60, 70, 80, 90, 100))} as band, count(*) as n, round(avg(case when failure_code is null then 0e0 else 1e0 end), 6) as failure_rate from tele group by 1",
    "eda_vibration_bands": lambda d: f"with {tele(d)} select {bands('vibration', (2, 4, 8, 12))} as band, count(*) as n, round(avg(case when failure_code is null then 0e0 else 1e0 end), 6) as failure_rate from tele group by 1",
    "eda_flag_coverage": lambda d: f"with {tele(d)} " + " union all ".join(f"select '{n}' as flag, round(avg(case when {c} then 1e0 else 0e0 end), 6) as coverage from tele" for n, c in THRESHOLDS.items()),
    "eda_feature_corr": lambda d: f"with {tele(d)} " + " union all ".join(f"select '{c}' as feature, round(corr({c}, grade), 6) as r from tele" for c in SENSORS),
    "leak_checks": lambda d: f"with {tele(d)}, l as (select grade, lag(grade) over (partition by front order by us) as p, (us - lag(us) over (partition by front order by us)) / {DAY_US}e0 as age from tele) select coalesce(corr(grade, p), 0) < 0.95 as no_copy, min(age) > 0 as ages_positive, count(case when grade < 0 then 1 end) = 0 as no_sentinel from l",
    "token_budget": lambda d: f"select conv_id, turn, n, total from (select conv_id, turn, cast(length(text) as bigint) as n, cast(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and current row) as bigint) as total from conversations) as x where total <= 2000",
}
