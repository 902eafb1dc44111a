"""Cleaning, quality, KPI and correction queries."""

from __future__ import annotations

from basalt.plans.dialect import ALERTS, DAY_US, FOUR_HOURS_US, GRAMS_PER_OUNCE, MINERALS, RULES, Dialect, bronze, gold, in_list, outside, recovery, silver, tele

GOLD_ALL = "select * from gold"


def corrections(d: Dialect) -> str:
    """A change feed of mineral reclassifications over events, with repeats, unknown keys and bad types."""
    return bronze(d) + f""", feed as (
      select case when event_id % 7 = 0 then us + 1 else us end as us, front,
        case when event_id % 13 = 0 then 'XX' when event_id % 3 = 0 then mineral else 'MIX' end as lab_mineral,
        {d.plus_us('ts', 86400000000)} as analysed, concat('LAB-', cast(event_id as string)) as sample_id from tele where event_id % 29 = 0
      union all
      select us, front, 'SUL', {d.plus_us('ts', 172800000000)}, concat('LAB-R', cast(event_id as string)) from tele where event_id % 145 = 0),
    usable as (select * from feed where lab_mineral in {in_list(MINERALS)} and us is not null and front is not null),
    latest as (select us, front, lab_mineral, analysed, sample_id from (
      select *, row_number() over (partition by us, front order by analysed desc nulls last, sample_id desc nulls last) as n from usable) as x where n = 1)"""


def corrected(d: Dialect) -> str:
    return corrections(d) + """, merged as (
      select t.*, case when l.lab_mineral <> t.mineral then l.lab_mineral else t.mineral end as new_mineral, coalesce(l.lab_mineral <> t.mineral, false) as changed, l.us is not null as matched
      from tele t left join latest l on t.us = l.us and t.front = l.front)"""


def dq_counts(d: Dialect) -> str:
    sums = ", ".join(f"cast(sum(case when {c} then 1 else 0 end) as bigint) as c_{n}" for n, _, c in RULES)
    rows = " union all ".join(f"select batch_id, '{n}' as rule, '{s}' as severity, total, c_{n} as failed from counted" for n, s, _ in RULES)
    return silver(d) + f", counted as (select batch_id, count(*) as total, {sums} from enriched group by batch_id), report as ({rows})"


def failures_ahead(d: Dialect) -> str:
    """Failures of the equipment in (t, t + 4h].

    Spark takes the running count up to t from that up to t + 4h, each linear, where a frame that slides counts its
    rows anew; by equipment and day, a day also holding the failures of the next one's first hours.
    """
    if not d.spark:
        return f"with {tele(d)} select event_id, count(failure_code) over (partition by equipment order by us range between 1 following and {FOUR_HOURS_US} following) as failures_ahead from tele"
    day = f"cast(floor(us / {DAY_US}) as bigint)"
    early = f"failure_code is not null and us - {day} * {DAY_US} < {FOUR_HOURS_US}"
    upto = lambda bound: f"count(failure_code) over (partition by equipment, day order by us range between unbounded preceding and {bound})"
    return f"""with {tele(d)}, days as (select event_id, equipment, us, failure_code, posexplode(case when {early} then array({day}, {day} - 1) else array({day}) end) as (other, day) from tele),
      running as (select event_id, us, other, {upto(f'{FOUR_HOURS_US} following')} as later, {upto('current row')} as now from days)
      select event_id, case when us is null then later else later - now end as failures_ahead from running where other = 0"""


QUERIES = {
    # scans and ledgers
    "ingest_log_counts": lambda d: f"with {bronze(d)} select batch_id, source_file, count(*) as n_rows, max(ingest_us) as last_ingest_us from bronze group by batch_id, source_file",
    "ingest_log_pending": lambda d: f"with {bronze(d)}, seen as (select batch_id, source_file, max(ingest_us) as last_us, count(*) as n_rows from bronze group by batch_id, source_file), logged as (select batch_id, source_file from seen where source_file like '%_a.csv') select s.* from seen s left anti join logged l on s.batch_id = l.batch_id and s.source_file = l.source_file" if d.spark else f"with {bronze(d)}, seen as (select batch_id, source_file, max(ingest_us) as last_us, count(*) as n_rows from bronze group by batch_id, source_file), logged as (select batch_id, source_file from seen where source_file like '%_a.csv') select s.* from seen s anti join logged l on s.batch_id = l.batch_id and s.source_file = l.source_file",
    "pending_files": lambda d: f"with {bronze(d)}, names as (select distinct source_file as path, {d.regex('source_file', '([^/]+)[.]csv$')} as name from bronze) select path, name from names where name not in ('l0_a', 'l1_b')",
    "pending_batches": lambda d: f"with {bronze(d)}, reported as (select 'L1' as batch_id) select distinct b.batch_id from bronze b where not exists (select 1 from reported r where r.batch_id = b.batch_id)",
    "month_batches": lambda d: f"with {tele(d)} select case when year_month < '2024-01' then 'history' else year_month end as part, count(*) as n_rows, min(us) as first_us from tele group by 1",
    "bronze_enrich": lambda d: f"with {bronze(d)} select event_id, us, front, batch_id, source_file, ingest_us, cast(null as string) as rescued from bronze",
    # projections
    "local_time_projection": lambda d: f"with {tele(d)} select event_id, {d.us('ts_local')} as local_us, local_date, year_month from tele",
    "shift_assignment": lambda d: f"with {tele(d)} select event_id, shift from tele",
    "shift_discrepancy": lambda d: f"with {tele(d)} select event_id, shift_received, shift, not coalesce(shift_received = shift, false) as differs from tele",
    "sentinel_nullify": lambda d: f"with {silver(d)} select event_id, ingest_us, grade, grade_valid, in_maintenance from enriched",
    "range_alerts": lambda d: f"with {tele(d)} select event_id, {', '.join(f'{outside(c, b)} as alert_{c}' for c, b in ALERTS.items())} from tele",
    "rejection_reasons": lambda d: f"with {silver(d)} select event_id, ingest_us, reasons from quarantine",
    "silver_valid": lambda d: f"with {silver(d)} select event_id, us, front, shift, grade, grade_valid, mineral, mineral_source, shift_differs, in_maintenance, batch_id, source_file, ingest_us, year_month from valid",
    "silver_quarantine": lambda d: f"with {silver(d)} select event_id, us, front, pressure, mineral, reasons from quarantine",
    "production_reconstruction": lambda d: f"with {tele(d)} select mineral, count(*) as n, round(avg(grade * tons / {GRAMS_PER_OUNCE}e0 * {recovery('mineral')}), 6) as mean_oz, round(sum(grade * tons / {GRAMS_PER_OUNCE}e0 * {recovery('mineral')}), 3) as total_oz from tele where grade is not null group by mineral",
    "serving_alerts": lambda d: f"with {tele(d)} select event_id, concat_ws(';', case when pressure < 180 or pressure > 240 then 'pressure' end, case when rpm < 800 or rpm > 1400 then 'rpm' end, case when vibration > 12 then 'vibration' end, case when temp > 95 then 'temp' end) as alerts from tele where pressure between 0 and 500 and rpm between 0 and 3000",
    # quality
    "dedup_latest": lambda d: "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as n from lineitem) as x where n = 1",
    "dq_report": lambda d: f"with {dq_counts(d)} select batch_id, rule, severity, total, failed, round(100.0e0 * failed / total, 4) as pct from report",
    "dq_summary": lambda d: f"with {dq_counts(d)} select rule, severity, cast(sum(failed) as bigint) as failed, cast(sum(total) as bigint) as total from report group by rule, severity order by rule",
    # kpi
    "kpi_turno": lambda d: f"with {tele(d)}, {gold(d)} {GOLD_ALL}",
    "kpi_ley_ponderada": lambda d: f"with {tele(d)}, {gold(d)} select front, local_date, shift, weighted_grade from gold",
    "kpi_eficiencia": lambda d: f"with {tele(d)}, {gold(d)} select front, local_date, shift, efficiency from gold",
    "kpi_tasa_fallas": lambda d: f"with {tele(d)}, {gold(d)} select front, local_date, shift, n_failures, n_events, failure_rate from gold",
    "kpi_horas_efectivas": lambda d: f"with {tele(d)}, {gold(d)} select front, local_date, shift, down_h, effective_h from gold",
    "gold_full": lambda d: f"with {silver(d)}, {gold(d, 'valid')} {GOLD_ALL}",
    "kpi_globales": lambda d: f"with {tele(d)}, {gold(d)} select count(*) as n_cells, round(avg(weighted_grade), 6) as grade, round(avg(efficiency), 6) as efficiency, round(avg(failure_rate), 6) as failure_rate, round(avg(effective_h), 6) as effective_h from gold",
    "fallas_equipo_semana": lambda d: f"with {tele(d)} select equipment, cast(date_trunc('week', ts_local) as date) as week, count(failure_code) as n_failures, count(*) as n_events from tele group by 1, 2",
    "medida_ley_ponderada": lambda d: f"with {tele(d)}, {gold(d)} select sector, round(sum(weighted_grade * tons) / sum(case when weighted_grade is not null then tons end), 6) as grade, round(sum(expected_oz), 3) as oz from gold group by sector",
    "ranking_frente": lambda d: f"with {tele(d)}, {gold(d)}, per as (select front, round(sum(expected_oz), 3) as oz from gold group by front) select front, oz, cast(rank() over (order by oz desc) as bigint) as place from per",
    "alerta_ultimo_turno": lambda d: f"with {tele(d)}, {gold(d)}, closed as (select *, row_number() over (partition by front order by local_date desc, shift desc) as n from gold) select front, local_date, shift, n_events, failure_rate, n_events >= 20 and failure_rate > 0.05 as alert from closed where n = 2",
    "rls_sector": lambda d: f"with {tele(d)}, {gold(d)} select front, local_date, shift, n_events, expected_oz from gold where sector = 'Veta-Sur'",
    # corrections
    "corrections_latest": lambda d: f"with {corrections(d)} select us, front, lab_mineral, sample_id from latest",
    "corrections_unmatched": lambda d: f"with {corrections(d)} select us, front, sample_id from latest l where not exists (select 1 from tele t where t.us = l.us and t.front = l.front)",
    "corrections_matched": lambda d: f"with {corrections(d)} select us, front, sample_id from latest l where exists (select 1 from tele t where t.us = l.us and t.front = l.front)",
    "merge_conditional_update": lambda d: f"with {corrected(d)} select event_id, new_mineral as mineral, changed from merged",
    "cdc_apply_counts": lambda d: f"with {corrected(d)} select (select count(*) from feed) as received, (select count(*) from feed where lab_mineral not in {in_list(MINERALS)}) as invalid, (select count(*) from latest) - (select count(*) from merged where matched) as not_found, (select count(*) from merged where changed) as updated, (select count(*) from merged where matched and not changed) as unchanged",
    "corrections_report": lambda d: f"with {corrected(d)}, n as (select (select count(*) from feed) as received, (select count(*) from feed where lab_mineral not in {in_list(MINERALS)}) as invalid, (select count(*) from latest) - (select count(*) from merged where matched) as not_found, (select count(*) from merged where changed) as updated) select 'invalid' as item, invalid as rows_, round(100.0e0 * invalid / received, 4) as pct from n union all select 'not_found', not_found, round(100.0e0 * not_found / received, 4) from n union all select 'updated', updated, round(100.0e0 * updated / received, 4) from n union all select 'received', received, 100.0e0 from n",
    "correction_batches": lambda d: f"with {tele(d)} select year_month, concat('LAB-', year_month, '-', lpad(cast(row_number() over (partition by year_month order by us) as string), 6, '0')) as sample_id, event_id, mineral from tele where event_id % 83 = 0",
    "merge_insert_only": lambda d: f"with {bronze(d)}, target as (select us, front, event_id from tele where event_id % 3 <> 0) select us, front, event_id from target union all select s.us, s.front, s.event_id from tele s where not exists (select 1 from target t where t.us = s.us and t.front = s.front)",
    "merge_full": lambda d: f"with {tele(d)}, {gold(d)}, target as (select front, local_date, shift, n_events + 1 as n_events, tons from gold where n_events > 3), source as (select front, local_date, shift, case when n_events % 5 = 0 then null else n_events end as n_events, tons from gold where n_events <> 6) select coalesce(s.front, t.front) as front, coalesce(s.local_date, t.local_date) as local_date, coalesce(s.shift, t.shift) as shift, case when s.front is null then t.n_events else s.n_events end as n_events, case when s.front is null then t.tons else s.tons end as tons from target t full outer join source s on t.front = s.front and t.local_date = s.local_date and t.shift = s.shift where s.front is null or s.n_events is not null",
    "affected_cells": lambda d: f"with {corrected(d)} select distinct front, local_date, shift from merged where changed",
    "gold_after_delete": lambda d: f"with {tele(d)}, remaining as (select * from tele where local_date <> (select max(local_date) from tele)), {gold(d, 'remaining')} {GOLD_ALL}",
    "history_union_dedup": lambda d: f"with {tele(d)}, history as (select us, front, grade, 1 as origin from tele where event_id % 2 = 0 union all select us, front, grade + 1, 0 from tele where event_id % 4 = 0) select us, front, grade from (select *, row_number() over (partition by us, front order by origin) as n from history) as x where n = 1",
    "event_failure_4h": failures_ahead,
    "next_event_label": lambda d: f"with {tele(d)} select event_id, front, case when following is null then null else failed end as next_failure from (select event_id, front, lead(event_id) over (partition by front order by us) as following, lead(case when failure_code is not null then 1 else 0 end) over (partition by front order by us) as failed from tele) as x where following is not null",
}
