"""Platform cost model: rates with unit and source, telemetry volume, capacity, clusters, storage, ingest, yearly lines.

Every amount follows from the relations of rates, signal sources and scenarios below; the relations have a few rows, so
they are cross joined freely.
"""

from __future__ import annotations

from basalt.plans.dialect import Dialect

AZURE = "Azure Retail Prices API, East US, 2026-08-30"
POWER_BI = "Microsoft, Power BI public list, since 2025-04-01"
PUBLIC = "public order of magnitude"

# List prices in USD, their unit and source.
RATES = (
    ("fabric_cu_hour", 0.18, "CU-hour", AZURE),
    ("fabric_cu_year", 938.00, "CU-year, reserved for one year", AZURE),
    ("power_bi_pro", 14, "user-month", POWER_BI),
    ("dbu_jobs", 0.30, "DBU-hour, Premium Jobs Compute", AZURE),
    ("dbu_interactive", 0.55, "DBU-hour, Premium All-purpose Compute", AZURE),
    ("vm_on_demand", 0.226, "hour, Standard_D4ds_v5 Linux", AZURE),
    ("vm_spot", 0.047709, "hour, Standard_D4ds_v5 Spot", AZURE),
    ("storage_hot", 0.0208, "GB-month, ADLS Gen2 Hot LRS", AZURE),
    ("storage_cool", 0.0152, "GB-month, ADLS Gen2 Cool LRS", AZURE),
    ("storage_archive", 0.00099, "GB-month, ADLS Gen2 Archive LRS", AZURE),
    ("hub_unit_hour", 0.03, "hour, Event Hubs Standard throughput unit", AZURE),
    ("hub_million", 0.028, "million ingress events", AZURE),
    ("hub_capture_hour", 0.10, "hour, Event Hubs Standard capture", AZURE),
    ("iot_s1_month", 25.00, "S1 unit-month", AZURE),
    ("iot_s2_month", 250.00, "S2 unit-month", AZURE),
    ("embedding", 0.00013, "1K tokens, text-embedding-3-large", AZURE),
    ("small_input", 0.00015, "1K input tokens, gpt-4o-mini global", AZURE),
    ("small_output", 0.0006, "1K output tokens, gpt-4o-mini global", AZURE),
    ("frontier_input", 0.003, "1K input tokens", PUBLIC),
    ("frontier_output", 0.015, "1K output tokens", PUBLIC),
)
# What emits signals, how many of them, signals of each.
SOURCES = (("drills", 30, 13), ("plant", 1, 250), ("tailings", 2, 60))
SAMPLE_SECONDS, YEAR_SECONDS, YEAR_HOURS, YEAR_DAYS = 30, 31_536_000, 8_760, 365
GB, BYTES_LOW, BYTES_HIGH = 1_073_741_824, 40, 120
# Scenario, capacity units, viewers, job hours a day, interactive hours a month, telemetry and drone GB a
# year, services in USD a year, the machine rate of jobs.
SCENARIOS = (
    ("low", 8, 25, 3, 20, 30, 1560, 3000, "vm_spot"),
    ("high", 16, 40, 8, 60, 89, 6240, 12000, "vm_on_demand"),
)
NODES, YEARS_KEPT, ARCHIVE_YEARS, S1_MESSAGES = 3, 5, 4, 400_000
# The assistant's documents, tokens a document, queries a day, tokens in and out a query.
ASSISTANT = (800, 10_000, 30, 6_000, 400)
LARGE = 64  # capacity units with which viewers need no licence


def values(name: str, columns: str, rows) -> str:
    """A relation of literal rows; numbers are doubles."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}e0"
    return f"{name} as (select * from (values {', '.join('(' + ', '.join(map(text, row)) + ')' for row in rows)}) as {name}_({columns}))"


def model(*queries: str) -> str:
    """The shared relations: rates, r (one row of all rates), volume (one row), scenarios, storage, lines; then queries."""
    pivot = ", ".join(f"max(case when rate = '{n}' then usd end) as {n}" for n, *_ in RATES)
    hub = f"r.hub_unit_hour * {YEAR_HOURS} + volume.readings / 1000000e0 * r.hub_million + r.hub_capture_hour * {YEAR_HOURS}"
    jobs = "case when s.machine = 'vm_spot' then r.vm_spot else r.vm_on_demand end"
    lines = (
        ("capacity and licences", "s.units * r.fabric_cu_year + s.viewers * r.power_bi_pro * 12"),
        ("cluster jobs", f"{NODES} * (r.dbu_jobs + {jobs}) * s.job_hours * {YEAR_DAYS}"),
        ("cluster interactive", f"{NODES} * (r.dbu_interactive + r.vm_on_demand) * s.interactive_hours * 12"),
        ("storage", "g.telemetry + g.drone_cool + g.drone_archive"),
        ("ingest", hub),
        ("services", "s.services"),
    )
    from_ = "from scenarios s join storage g on s.scenario = g.scenario cross join r cross join volume"
    return ", ".join(
        (
            "with " + values("rates", "rate, usd, unit, source", RATES),
            f"r as (select {pivot} from rates)",
            values("sources", "source, assets, signals_each", SOURCES),
            f"volume as (select sum(assets * signals_each) * {YEAR_SECONDS} / {SAMPLE_SECONDS} as readings from sources)",
            values("scenarios", "scenario, units, viewers, job_hours, interactive_hours, telemetry_gb, drone_gb, services, machine", SCENARIOS),
            f"storage as (select scenario, telemetry_gb * {YEARS_KEPT} * r.storage_hot * 12 as telemetry, drone_gb * r.storage_cool * 12 as drone_cool, "
            f"drone_gb * {ARCHIVE_YEARS} * r.storage_archive * 12 as drone_archive from scenarios cross join r)",
            f"ingest as (select volume.readings / {YEAR_DAYS} as per_day, {hub} as hub from r cross join volume)",
            "lines as (" + " union all ".join(f"select s.scenario, '{n}' as line, {e} as usd {from_}" for n, e in lines) + ")",
            *queries[:-1],
        )
    ) + " " + queries[-1]


def volumetry(d: Dialect) -> str:
    readings = f"signals * {YEAR_SECONDS} / {SAMPLE_SECONDS}"
    return model(
        "each_ as (select source, assets * signals_each as signals from sources)",
        "parts as (select source, signals from each_ union all select 'all', sum(signals) from each_)",
        f"select source, cast(signals as bigint) as signals, cast({readings} as bigint) as readings_year, cast({readings} / {YEAR_DAYS} as bigint) as readings_day, "
        f"round({readings} * {BYTES_LOW} / {GB}e0, 4) as gb_low, round({readings} * {BYTES_HIGH} / {GB}e0, 4) as gb_high from parts",
    )


def capacity(d: Dialect) -> str:
    reserved = "units * r.fabric_cu_year / 12"
    paid = f"units * r.fabric_cu_hour * {YEAR_HOURS} / 12"
    return model(
        values("sizes", "units", ((8,), (16,), (32,), (LARGE,))),
        f"select cast(units as int) as units, round({paid}, 4) as pay_as_you_go_month, round({reserved}, 4) as reserved_month, round(1 - ({reserved}) / ({paid}), 6) as discount, "
        f"round(({LARGE} - units) * r.fabric_cu_year / 12 / r.power_bi_pro, 4) as break_even_viewers, "
        f"round(({LARGE} - units) * r.fabric_cu_year - 40 * r.power_bi_pro * 12, 4) as saving_40_viewers from sizes cross join r",
    )


def cluster(d: Dialect) -> str:
    return model(
        "tiers as (select 'jobs' as tier, dbu_jobs as dbu from r union all select 'interactive', dbu_interactive from r)",
        "machines as (select 'on demand' as machine, vm_on_demand as vm from r union all select 'spot', vm_spot from r)",
        values("hours", "hours_day", ((0,), (3,), (6,), (8,))),
        "select tier, machine, cast(hours_day as int) as hours_day, round(dbu + vm, 6) as node_hour, round(vm / dbu, 6) as machine_surcharge, "
        f"round({NODES} * (dbu + vm) * hours_day * {YEAR_DAYS}, 4) as yearly from tiers cross join machines cross join hours",
    )


def ingest(d: Dialect) -> str:
    s1 = f"ceil(per_day / {S1_MESSAGES}e0)"
    return model(
        f"select cast(per_day as bigint) as messages_day, round(hub, 4) as hub_year, cast({s1} as bigint) as s1_units, round({s1} * r.iot_s1_month * 12, 4) as s1_year, "
        "round(r.iot_s2_month * 12, 4) as s2_year from ingest cross join r"
    )


def assistant(d: Dialect) -> str:
    docs, tokens, a_day, read, written = ASSISTANT
    yearly = f"{a_day * YEAR_DAYS} * ({read} * tokens_in + {written} * tokens_out) / 1000"
    return model(
        "models as (select 'small' as model, small_input as tokens_in, small_output as tokens_out from r union all select 'frontier', frontier_input, frontier_output from r)",
        f"select model, round({docs * tokens} / 1000e0 * r.embedding, 4) as indexing, round({yearly}, 4) as queries_year from models cross join r",
    )


def sensitivity(d: Dialect) -> str:
    stored = "g.telemetry + (g.drone_cool + g.drone_archive) * factor"
    total = f"t.other + {stored}"
    return model(
        values("factors", "factor", ((1,), (5,), (10,), (50,))),
        "others as (select scenario, sum(usd) as other from lines where line <> 'storage' group by scenario)",
        f"select cast(factor as int) as factor, t.scenario, round({total}, 4) as total, round(({stored}) / ({total}), 6) as storage_share "
        "from others t join storage g on t.scenario = g.scenario cross join factors",
    )


QUERIES = {
    "cost_rates": lambda d: model("select rate, usd, unit, source from rates"),
    "cost_volumetry": volumetry,
    "cost_lab_analyses": lambda d: f"select cast(mines as int) as mines, cast(every_hours as int) as every_hours, cast(24 / every_hours * {YEAR_DAYS} * mines as bigint) as analyses_year from (values (1e0, 4e0), (3e0, 4e0), (3e0, 8e0)) as x(mines, every_hours)",
    "cost_storage": lambda d: model("select scenario, round(telemetry, 4) as telemetry, round(drone_cool, 4) as drone_cool, round(drone_archive, 4) as drone_archive, round(telemetry + drone_cool + drone_archive, 4) as total from storage"),
    "cost_estimate": lambda d: model("select scenario, line, round(usd, 4) as usd, round(usd / sum(usd) over (partition by scenario), 6) as share from lines"),
    "cost_sensitivity": sensitivity,
    "cost_capacity": capacity,
    "cost_cluster": cluster,
    "cost_ingest": ingest,
    "cost_assistant": assistant,
}
