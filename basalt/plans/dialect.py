"""One SQL text for two engines: the few functions that are spelt differently, and the shared relations.

A query is a function of a dialect.  Catalyst plans it in Spark; the same relations, rendered for DuckDB, are its
oracle.  ``tele`` is the canonical telemetry view of ``events`` (see SURVEY 7.2).
"""

from __future__ import annotations

from dataclasses import dataclass

# Operating ranges, physical limits, shifts, recovery factors.
ALERTS = {"pressure": (180, 240), "rpm": (800, 1400), "vibration": (None, 12), "temp": (None, 95)}
LIMITS = {"grade": (0, 1000), "tons": (0, 2000), "pressure": (0, 500), "rpm": (0, 3000), "advance": (0, 10), "vibration": (0, 100), "temp": (-20, 200)}
SHIFTS = ("N2", "D1", "D2", "N1")
MINERALS = ("OX", "SUL", "MIX", "EST")
RECOVERY = {"EST": 0.10, "MIX": 0.83, "OX": 0.87, "SUL": 0.91}
GRAMS_PER_OUNCE = 31.1035
MAX_ADVANCE, SHIFT_HOURS = 3.5, 6.0
WEEK_US, FOUR_HOURS_US, DAY_US = 604_800_000_000, 14_400_000_000, 86_400_000_000


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def us(self, x: str) -> str:
        return f"unix_micros(cast({x} as timestamp))" if self.spark else f"epoch_us({x})"

    def local(self, x: str) -> str:
        return f"from_utc_timestamp(cast({x} as timestamp), 'America/Lima')" if self.spark else f"(({x} at time zone 'UTC') at time zone 'America/Lima')"

    def key(self, x: str, k: str) -> str:
        return f"get_json_object({x}, '$.{k}')" if self.spark else f"json_extract_string({x}, '$.{k}')"

    def pct(self, x: str, p: float) -> str:
        return f"percentile({x}, {p}e0)" if self.spark else f"quantile_cont({x}, {p})"

    def plus_us(self, x: str, n: int) -> str:
        return f"timestamp_micros({self.us(x)} + {n})" if self.spark else f"make_timestamp({self.us(x)} + {n})"

    def ym(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM')" if self.spark else f"strftime({x}, '%Y-%m')"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def days(self, a: str, b: str) -> str:
        """Whole days from b to a."""
        return f"cast(datediff({a}, {b}) as bigint)" if self.spark else f"date_diff('day', {b}, {a})"

    def regex(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({x}, r'{p}', {group})" if self.spark else f"regexp_extract({x}, '{p}', {group})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def words(self, x: str) -> str:
        """Lower-case code-preserving tokens."""
        p = "[a-z0-9]+(-[a-z0-9]+)*"
        return f"regexp_extract_all(lower({x}), r'{p}', 0)" if self.spark else f"regexp_extract_all(lower({x}), '{p}', 0)"

    def explode(self, x: str) -> str:
        return f"explode({x})" if self.spark else f"unnest({x})"

    def size(self, x: str) -> str:
        return f"cast(size({x}) as bigint)" if self.spark else f"cast(len({x}) as bigint)"

    def ts(self, x: str) -> str:
        return f"cast({x} as timestamp)"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def recovery(column: str) -> str:
    return "case " + column + " " + " ".join(f"when '{k}' then {v}e0" for k, v in RECOVERY.items()) + " end"


def outside(column: str, bounds, strict: bool = True) -> str:
    low, high = bounds
    tests = ([f"{column} < {low}"] if low is not None else []) + ([f"{column} > {high}"] if high is not None else [])
    return f"coalesce({' or '.join(tests)}, false)"


def shift_of(hour: str, d: Dialect) -> str:
    return "case " + " ".join(f"when {hour} < {6 * (i + 1)} then '{s}'" for i, s in enumerate(SHIFTS)) + " end"


def tele(d: Dialect) -> str:
    """CTEs ``raw`` and ``tele``: one row an event."""
    return f"""raw as (
      select event_id, user_id, event_type, value, {d.ts('ts')} as ts, cast({d.key('props', 'k')} as int) as k from events),
    located as (
      select *, {d.local('ts')} as ts_local, concat('FR-', cast(user_id % 13 as string)) as front from raw),
    tele as (
      select event_id, ts, ts_local, cast(ts_local as date) as local_date, {d.us('ts')} as us, {shift_of("hour(ts_local)", d)} as shift,
        front, case (user_id % 13) % 4 when 0 then 'Veta-Principal' when 1 then 'Veta-Sur' when 2 then 'Cuerpo-Central' else 'Rampa-Norte' end as sector,
        concat('EQ-', cast(event_id % 10 as string)) as equipment, concat('OP-', cast(event_id % 18 as string)) as operator,
        case when event_id % 18 = 0 then -1.0e0 else round(value / 10 + user_id % 13, 4) end as grade_raw,
        case when event_id % 18 = 0 then null else round(value / 10 + user_id % 13, 4) end as grade,
        25.0e0 + k * 4 as tons, 170.0e0 + k * 0.8e0 as pressure, 700.0e0 + k * 8 as rpm, 0.3e0 + k * 0.03e0 as advance, 8.0e0 + k * 0.8e0 as water,
        cast(event_id % 140 as double) / 10.0e0 as vibration, 38.0e0 + event_id * 7 % 70 as temp,
        case when event_type = 'error' then concat('E-ELEC-0', cast(k % 8 as string)) end as failure_code,
        case event_type when 'click' then 'OX' when 'view' then 'SUL' when 'purchase' then 'MIX' when 'signup' then 'EST' else 'SUL' end as mineral,
        case when event_id % 41 = 0 then 1 else 0 end as maint, {d.ym('ts_local')} as year_month,
        case when event_id % 97 = 0 then 'D9' else {shift_of("hour(ts_local)", d)} end as shift_received
      from located)"""


def bronze(d: Dialect) -> str:
    """tele with bad rows, batches, files and repeated keys."""
    return tele(d) + f""", dirty as (
      select * , case when event_id % 501 = 0 then -5.0e0 else pressure end as pressure_in, case when event_id % 503 = 0 then 'XX' else mineral end as mineral_in,
        case when event_id % 509 = 0 then null else front end as front_in, concat('L', cast(event_id % 3 as string)) as batch_id from tele),
    bronze as (
      select event_id, ts, ts_local, local_date, us, year_month, shift, shift_received, front_in as front, sector, equipment, operator, grade_raw, tons, pressure_in as pressure, rpm, advance, water,
        vibration, temp, failure_code, mineral_in as mineral, maint, batch_id, concat('/landing/', lower(batch_id), '_a.csv') as source_file, us + 3600000000 as ingest_us from dirty
      union all
      select event_id, ts, ts_local, local_date, us, year_month, shift, shift_received, front_in, sector, equipment, operator, grade_raw, tons, pressure_in, rpm, advance, water,
        vibration, temp, failure_code, mineral_in, maint, batch_id, concat('/landing/', lower(batch_id), '_b.csv'), us + 90000000000 from dirty where event_id % 211 = 0)"""


# (rule, severity, failing condition); the report and the rejection reasons come from this one list
RULES = [
    ("duplicate", "reject", "n > 1"),
    ("null_key", "reject", "ts is null or front is null or trim(front) = ''"),
    ("unknown_mineral", "reject", f"mineral not in {in_list(MINERALS)}"),
    ("unknown_sector", "reject", f"sector not in {in_list(('Veta-Principal', 'Veta-Sur', 'Cuerpo-Central', 'Rampa-Norte'))}"),
    ("unknown_shift", "reject", f"shift not in {in_list(SHIFTS)}"),
    ("physical_limit", "reject", " or ".join(outside(c, b) for c, b in LIMITS.items())),
    ("sentinel_grade", "mark", "not grade_valid"),
    ("shift_discrepancy", "mark", "shift_differs"),
    *((f"alert_{c}", "mark", f"alert_{c}") for c in ALERTS),
    ("failure", "inform", "failure_code is not null"),
    ("maintenance", "inform", "maint = 1"),
    ("null_operator", "inform", "operator is null"),
]
REJECT = [(n, c) for n, s, c in RULES if s == "reject"]


def silver(d: Dialect) -> str:
    """bronze -> enriched (flags, duplicate number) -> judged (reasons) -> valid, quarantine."""
    alerts = ", ".join(f"{outside(c, b)} as alert_{c}" for c, b in ALERTS.items())
    flags = ", ".join(f"coalesce({c}, false) as r_{n}" for n, c in REJECT)
    reasons = "concat_ws(',', " + ", ".join(f"case when r_{n} then '{n}' end" for n, _ in REJECT if n != "duplicate") + ")"
    return bronze(d) + f""", enriched as (
      select *, row_number() over (partition by us, front order by ingest_us desc, source_file desc) as n,
        grade_raw is not null and grade_raw <> -1 and grade_raw >= 0 as grade_valid, case when grade_raw >= 0 then grade_raw end as grade,
        not coalesce(shift_received = shift, false) as shift_differs, coalesce(maint = 1, false) as in_maintenance, 'OPUS' as mineral_source, {alerts} from bronze),
    judged as (select *, {flags} from enriched),
    valid as (select * from judged where not ({' or '.join(f'r_{n}' for n, _ in REJECT)})),
    quarantine as (select *, {reasons} as reasons from judged where not r_duplicate and ({' or '.join(f'r_{n}' for n, _ in REJECT if n != 'duplicate')}))"""


def gold(d: Dialect, source: str = "tele", name: str = "gold") -> str:
    """KPI cells of (front, local date, shift) over ``source``; one window and one aggregate on the same keys."""
    return f"""{name}_gaps as (
      select *, coalesce({d.idiv('lead(us) over (partition by front, local_date, shift order by us, event_id)', '1000000')} - {d.idiv('us', '1000000')}, 0) / 3600.0e0 as gap_h from {source}),
    {name}_sums as (
      select front, local_date, shift, max(sector) as sector, count(*) as n_events, count(grade) as n_grades, sum(tons) as tons, sum(grade * tons) as grade_tons,
        sum(case when grade is not null then tons end) as graded_tons, avg(advance) as advance, min(us) as first_us, max(us) as last_us, count(failure_code) as n_failures,
        cast(sum(maint) as bigint) as n_maint, count(distinct equipment) as n_equipment, avg(vibration) as vibration, max(temp) as max_temp,
        cast(sum(case when {outside('vibration', ALERTS['vibration'])} then 1 else 0 end) as bigint) as n_vibration_alerts,
        cast(sum(case when {outside('temp', ALERTS['temp'])} then 1 else 0 end) as bigint) as n_temp_alerts,
        sum(grade * tons / {GRAMS_PER_OUNCE}e0 * {recovery('mineral')}) as expected_oz,
        sum(case when failure_code is not null or maint = 1 then gap_h else 0 end) as down_h
      from {name}_gaps group by front, local_date, shift),
    {name} as (
      select front, local_date, shift, sector, n_events, n_grades, round(tons, 6) as tons, case when graded_tons > 0 then round(grade_tons / graded_tons, 6) end as weighted_grade,
        round(advance / {MAX_ADVANCE}e0, 6) as efficiency, round(n_failures / cast(n_events as double), 6) as failure_rate, n_failures, n_maint, n_equipment,
        round(vibration, 6) as vibration, max_temp, n_vibration_alerts, n_temp_alerts, round(expected_oz, 6) as expected_oz, round(down_h, 6) as down_h,
        round(greatest(0.0e0, least(({d.idiv('last_us', '1000000')} - {d.idiv('first_us', '1000000')}) / 3600.0e0, {SHIFT_HOURS}e0) - down_h), 6) as effective_h
      from {name}_sums)"""
