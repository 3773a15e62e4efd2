"""Report results in plain SQL, computed separately for every run date."""

from __future__ import annotations

from tideline.checks.relations import EVENTS, ORDERS, days, pct, rnd, rnd_ratio, run_dates, statement

COMPARED = (
    "previous_day, last_week, previous_7d_avg, previous_30d_avg, previous_30d_stddev, "
    "dod_pct, wow_pct, vs_7d_avg_pct, vs_30d_avg_pct, z_score_30d"
)


def compare(dims: list[str], scale: int = 2, carry: list[str] | None = None) -> dict[str, str]:
    """CTEs from ``long(run, dt, *dims, metric, value)`` to ``compared``.

    Each report-day row joins the up to 30 rows before it in its series by position.
    """
    carry = carry or []
    keys = ["run", *dims, "metric"]
    same = " AND ".join(f"p.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    grouped = ", ".join(f"c.{k}" for k in [*keys, "dt", "value", "pos", *carry])

    def mean(n: int) -> str:
        near = f"FILTER (WHERE p.pos >= c.pos - {n})"
        total, rows = f"sum(p.value) {near}", f"count(p.value) {near}"
        return rnd_ratio(total, rows, scale)

    shown = ", ".join([*keys, "dt", *carry])
    return {
        "numbered": f"SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY dt) AS pos FROM long",
        "packed": f"""
SELECT {grouped},
       CAST(max(p.value) FILTER (WHERE p.pos = c.pos - 1) AS DOUBLE) AS previous_day,
       CAST(max(p.value) FILTER (WHERE p.pos = c.pos - 7) AS DOUBLE) AS last_week,
       {mean(7)} AS previous_7d_avg, {mean(30)} AS previous_30d_avg,
       {rnd("stddev_samp(CAST(p.value AS DOUBLE))", scale)} AS previous_30d_stddev
FROM numbered c LEFT JOIN numbered p ON {same} AND p.pos BETWEEN c.pos - 30 AND c.pos - 1
WHERE c.dt = c.run - 1
GROUP BY {grouped}""",
        "compared": f"""
SELECT {shown}, CAST(value AS DOUBLE) AS value, previous_day, last_week, previous_7d_avg,
       previous_30d_avg, previous_30d_stddev,
       {pct("CAST(value AS DOUBLE)", "previous_day")} AS dod_pct,
       {pct("CAST(value AS DOUBLE)", "last_week")} AS wow_pct,
       {pct("CAST(value AS DOUBLE)", "previous_7d_avg")} AS vs_7d_avg_pct,
       {pct("CAST(value AS DOUBLE)", "previous_30d_avg")} AS vs_30d_avg_pct,
       {rnd_ratio("CAST(value AS DECIMAL(20,4)) - CAST(previous_30d_avg AS DECIMAL(20,4))", "previous_30d_stddev", 2)} AS z_score_30d
FROM packed""",
    }


def unioned(metrics: dict[str, str], source: str, keys: str, extra: dict[str, str] | None = None) -> str:
    parts = []
    for name, expr in metrics.items():
        more = f", CAST({extra[name]} AS INTEGER) AS data_available" if extra else ""
        parts.append(
            f"SELECT {keys}, '{name}' AS metric, CAST({expr} AS DECIMAL(28,4)) AS value{more} FROM {source}"
        )
    return " UNION ALL ".join(parts)


def axis(back: int) -> str:
    return f"""
SELECT run, CAST(unnest(generate_series(run - {back}, run - 1, INTERVAL 1 DAY)) AS DATE) AS dt FROM runs"""


PAID = "status IN ('AUTHORIZED', 'COMPLETED') AND dollars > 0"

REVENUE_DAYS = f"SELECT dt, userid, sum(dollars) AS rev FROM sales WHERE {PAID} GROUP BY ALL"


def main_kpi_flat() -> tuple[dict, str]:
    metrics = {m: m for m in ("dau", "payers", "spenders", "rev")}
    available = {m: "available" for m in metrics}
    return {
        "axis": axis(61),
        "acts": """
SELECT dt, count(DISTINCT userid) AS dau, count(DISTINCT userid) FILTER (WHERE bars_spent > 0) AS spenders
FROM dailyactives GROUP BY dt""",
        "paid": f"""
SELECT dt, count(DISTINCT userid) AS payers, sum(dollars) AS rev FROM sales WHERE {PAID} GROUP BY dt""",
        "wide": """
SELECT run, x.dt, coalesce(dau, 0) AS dau, coalesce(spenders, 0) AS spenders,
       coalesce(payers, 0) AS payers, coalesce(rev, 0) AS rev, a.dt IS NOT NULL AS available
FROM axis x LEFT JOIN acts a ON a.dt = x.dt LEFT JOIN paid p ON p.dt = x.dt""",
        "long": unioned(metrics, "wide", "run, dt", available),
        **compare([], carry=["data_available"]),
    }, f"dt, metric, value, data_available, {COMPARED} FROM compared"


def main_kpi_nested() -> tuple[dict, str]:
    metrics = {
        m: m
        for m in ("dau", "payers", "matchers", "audiences", "sub_revenue", "can_revenue",
                  "admob_revenue", "total_revenue")
    }
    available = dict.fromkeys(metrics, "seen")
    available |= {"admob_revenue": "ads_seen", "total_revenue": "(seen AND ads_seen)"}
    return {
        "axis": axis(60),
        "acts": """
SELECT dt, count(DISTINCT user_id) AS dau,
       count(DISTINCT user_id) FILTER (WHERE can IS NOT NULL OR sub IS NOT NULL) AS payers,
       count(DISTINCT user_id) FILTER (WHERE clicks > 0) AS matchers,
       count(DISTINCT user_id) FILTER (WHERE views > 0) AS audiences,
       sum(sub) AS sub_revenue, sum(can) AS can_revenue
FROM activity GROUP BY dt""",
        "wide": """
SELECT x.run, x.dt, coalesce(dau, 0) AS dau, coalesce(payers, 0) AS payers,
       coalesce(matchers, 0) AS matchers, coalesce(audiences, 0) AS audiences,
       coalesce(sub_revenue, 0) AS sub_revenue, coalesce(can_revenue, 0) AS can_revenue,
       coalesce(g.gross, 0) AS admob_revenue,
       coalesce(sub_revenue, 0) + coalesce(can_revenue, 0) + coalesce(g.gross, 0) AS total_revenue,
       a.dt IS NOT NULL AS seen, g.dt IS NOT NULL AS ads_seen
FROM axis x LEFT JOIN acts a ON a.dt = x.dt
     LEFT JOIN ads g ON g.dt + 1 = x.dt AND g.dt BETWEEN x.run - 60 AND x.run - 1""",
        "long": unioned(metrics, "wide", "run, dt", available),
        **compare([], carry=["data_available"]),
    }, f"dt, metric, value, data_available, {COMPARED} FROM compared"


def streamer_activity() -> tuple[dict, str]:
    metrics = {m: m for m in ("video_das", "voice_das", "video_duration", "voice_duration")}
    return {
        "axis": axis(60),
        "watched": f"""
SELECT dt, count(DISTINCT user_id) FILTER (WHERE is_video) AS video_das,
       count(DISTINCT user_id) FILTER (WHERE NOT is_video) AS voice_das,
       {rnd_ratio("sum(CASE WHEN is_video THEN seconds ELSE 0 END)", "3600", 2)} AS video_duration,
       {rnd_ratio("sum(CASE WHEN is_video THEN 0 ELSE seconds END)", "3600", 2)} AS voice_duration
FROM streams GROUP BY dt""",
        "wide": "SELECT x.run, x.dt, w.* EXCLUDE (dt) FROM axis x LEFT JOIN watched w ON w.dt = x.dt",
        "long": unioned(metrics, "wide", "run, dt"),
        **compare([]),
    }, f"dt, metric, value, {COMPARED} FROM compared"


def currency_economy() -> tuple[dict, str]:
    ratio = {
        f"rolling_{n}d_bar_per_dollar": f"r{n}" for n in (3, 16, 30)
    }
    spans = ", ".join(
        f"CAST(sum(q.bars) FILTER (WHERE q.pos > s.pos - {n}) AS DOUBLE) / "
        f"nullif(CAST(sum(q.dollars) FILTER (WHERE q.pos > s.pos - {n}) AS DOUBLE), 0) AS r{n}"
        for n in (3, 16, 30)
    )
    return {
        "axis": axis(61),
        "sold": """
SELECT run, dt, sum(dollars) AS dollars, sum(bars) AS bars,
       row_number() OVER (PARTITION BY run ORDER BY dt) AS pos
FROM runs JOIN sales ON dt BETWEEN run - 91 AND run - 1
     LEFT JOIN store_product sp ON sp.id = productid
WHERE status IN ('AUTHORIZED', 'COMPLETED')
  AND name NOT IN ('Games Free Bars Reward', 'Games Paid Bars Reward')
GROUP BY run, dt""",
        "rolling": f"""
SELECT s.run, s.dt, {spans}
FROM sold s JOIN sold q ON q.run = s.run AND q.pos BETWEEN s.pos - 29 AND s.pos GROUP BY s.run, s.dt""",
        "wide": """
SELECT x.run, x.dt, r3, r16, r30 FROM axis x LEFT JOIN rolling r ON r.run = x.run AND r.dt = x.dt""",
        "long": unioned(ratio, "wide", "run, dt"),
        **compare([]),
    }, f"dt, metric, value, {COMPARED} FROM compared"


def purchase_distribution() -> tuple[dict, str]:
    """Percentile by rank: the values at the two ranks around ``p * (n - 1)``."""
    points = {"median": "0.5e0", "p90": "0.9e0", "p99": "0.99e0", "p999": "0.999e0"}
    shown = []
    for m in ("revenue", "transactions"):
        for name, p in points.items():
            spot = f"({p} * (n_{m} - 1))"
            low = f"max({m}) FILTER (WHERE k_{m} = floor({spot}))"
            high = f"max({m}) FILTER (WHERE k_{m} = ceil({spot}))"
            part = f"max({spot} - floor({spot}))"
            shown.append(f"{rnd(f'({low} + ({high} - {low}) * {part})', 0)} / 1e2 AS {name}_{m}")
    return {
        "spenders": """
SELECT dt AS date, user_id, CAST(count(DISTINCT k) * 100 AS DOUBLE) AS transactions,
       CAST(sum(value) * 100 AS DOUBLE) AS revenue
FROM ev WHERE kind = 'purchase' GROUP BY ALL HAVING sum(value) > 0""",
        "placed": """
SELECT *, count(*) OVER (PARTITION BY date) AS n_revenue, count(*) OVER (PARTITION BY date) AS n_transactions,
       row_number() OVER (PARTITION BY date ORDER BY revenue) - 1 AS k_revenue,
       row_number() OVER (PARTITION BY date ORDER BY transactions) - 1 AS k_transactions
FROM spenders""",
        "daily": f"SELECT date, {', '.join(shown)} FROM placed GROUP BY date",
    }, "d.* FROM daily d JOIN runs ON date BETWEEN run - 30 AND run - 1"


def _stickiness(active: str) -> tuple[dict, str]:
    metrics = {
        "dau/rolling_wau": rnd_ratio("dau", "wau", 2),
        "dau/rolling_mau": rnd_ratio("dau", "mau", 2),
        "rolling_7d_wau": "wau",
        "rolling_30d_mau": "mau",
    }
    return {
        "axis": axis(31),
        "active": active,
        "wide": """
SELECT x.run, x.dt, region, count(DISTINCT who) FILTER (WHERE a.dt = x.dt) AS dau,
       count(DISTINCT who) FILTER (WHERE a.dt > x.dt - 7) AS wau, count(DISTINCT who) AS mau
FROM axis x LEFT JOIN active a ON a.dt BETWEEN x.dt - 29 AND x.dt GROUP BY x.run, x.dt, region""",
        "long": unioned(metrics, "wide", "run, dt, region"),
        **compare(["region"], scale=4),
    }, f"dt, region, metric, value, {COMPARED} FROM compared"


def stickiness_region() -> tuple[dict, str]:
    return _stickiness(
        "SELECT dt, user_id AS who, CASE WHEN country_code = 'TW' THEN 'TW' ELSE 'others' END AS region FROM activity"
    )


def stickiness_locale() -> tuple[dict, str]:
    return _stickiness("""
SELECT dt, d.userid AS who, coalesce(region, 'others') AS region
FROM dailyactives d LEFT JOIN people p ON p.userid = d.userid""")


TIER = """CASE WHEN {0} >= 13 THEN 'golden' WHEN {0} >= 11 THEN 'titanium' WHEN {0} >= 6 THEN 'platinum'
     WHEN {0} >= 1 THEN 'red' ELSE 'no' END"""
HALF = """CAST(CASE WHEN day({0}) <= 15 THEN date_trunc('month', {0})
     ELSE date_trunc('month', {0}) + INTERVAL 15 DAY END AS DATE)"""


def main_kpi_slice() -> tuple[dict, str]:
    metrics = {m: m for m in ("dau", "payers", "spenders", "rev")}
    available = {m: "available" for m in metrics}
    return {
        "paid": REVENUE_DAYS,
        "unit": f"""
SELECT DISTINCT d.dt, d.userid, d.bars_spent, r.rev, coalesce(p.region, 'others') AS region,
       (SELECT max(level) FROM levels l WHERE l.userid = d.userid AND l.dt BETWEEN {HALF.format("d.dt")} AND d.dt) AS level
FROM dailyactives d LEFT JOIN people p ON p.userid = d.userid
     LEFT JOIN paid r ON r.userid = d.userid AND r.dt = d.dt""",
        "cut": f"""
SELECT dt, region, {TIER.format("level")} AS tier, count(DISTINCT userid) AS dau,
       count(DISTINCT userid) FILTER (WHERE rev > 0) AS payers,
       count(DISTINCT userid) FILTER (WHERE bars_spent > 0) AS spenders, sum(rev) AS rev
FROM unit GROUP BY ALL""",
        "axis": axis(61),
        "seen": "SELECT DISTINCT run, region, tier FROM runs JOIN cut ON dt BETWEEN run - 61 AND run - 1",
        "wide": """
SELECT x.run, x.dt, s.region, s.tier, coalesce(dau, 0) AS dau, coalesce(payers, 0) AS payers,
       coalesce(spenders, 0) AS spenders, coalesce(rev, 0) AS rev, c.dt IS NOT NULL AS available
FROM axis x JOIN seen s ON s.run = x.run
     LEFT JOIN cut c ON c.dt = x.dt AND c.region = s.region AND c.tier = s.tier""",
        "long": unioned(metrics, "wide", "run, dt, region, tier", available),
        **compare(["region", "tier"], carry=["data_available"]),
    }, f"dt, tier, region, metric, value, data_available, {COMPARED} FROM compared"


def kpi_by_level() -> tuple[dict, str]:
    metrics = {m: m for m in ("dau", "payers", "revenue")}
    return {
        "actives": "SELECT DISTINCT run, dt, userid FROM runs JOIN dailyactives ON dt BETWEEN run - 61 AND run - 1",
        "ranked": """
SELECT a.run, a.dt, a.userid, coalesce(arg_max(l.level, l.dt), 0) AS crown_level
FROM actives a LEFT JOIN levels l
     ON l.userid = a.userid AND l.dt BETWEEN a.dt - 30 AND a.dt AND l.dt >= a.run - 77
GROUP BY ALL""",
        "bought": """
SELECT run, dt, s.userid, sum(dollars) AS rev
FROM runs JOIN sales s ON dt BETWEEN run - 61 AND run - 1
     JOIN people p ON p.userid = s.userid AND terminated = 0
WHERE status IN ('AUTHORIZED', 'COMPLETED') AND dollars > 0 GROUP BY ALL""",
        "buyers": f"""
SELECT b.run, b.dt, b.userid, b.rev, coalesce(max(l.level), 0) AS crown_level
FROM bought b LEFT JOIN levels l
     ON l.userid = b.userid AND l.dt BETWEEN {HALF.format("b.dt")} AND b.dt AND l.dt >= b.run - 77
GROUP BY ALL""",
        "by_act": "SELECT run, dt, crown_level, count(DISTINCT userid) AS dau FROM ranked GROUP BY ALL",
        "by_pay": """
SELECT run, dt, crown_level, count(DISTINCT userid) AS payers, sum(rev) AS revenue FROM buyers GROUP BY ALL""",
        "wide": """
SELECT run, dt, crown_level, coalesce(dau, 0) AS dau, coalesce(payers, 0) AS payers,
       coalesce(revenue, 0) AS revenue
FROM by_act FULL JOIN by_pay USING (run, dt, crown_level)""",
        "long": unioned(metrics, "wide", "run, dt, crown_level"),
        **compare(["crown_level"]),
    }, f"dt, crown_level, metric, value, {COMPARED} FROM compared"


def lifecycle_ctes(days_sql: str, dims: list[str], axis_days: int) -> dict[str, str]:
    """``days(run, dt, who, day_index, *dims)`` to ``counts(run, dt, *dims, traffic_*)``."""
    d = ", ".join(dims)
    per = f"run, dt, {d}"
    tally = ", ".join(
        f"count(*) FILTER (WHERE state = '{s}') AS traffic_{s}"
        for s in ("new", "retaining", "resurrected", "sleeping", "churned")
    )
    return {
        "days": days_sql,
        "placed": f"""
SELECT c.run, c.dt, c.who, c.day_index, {", ".join(f"c.{x}" for x in dims)},
       max(o.dt) FILTER (WHERE o.dt < c.dt) AS before, min(o.dt) FILTER (WHERE o.dt > c.dt) AS after
FROM days c JOIN days o ON o.run = c.run AND o.who = c.who GROUP BY ALL""",
        "states": f"""
SELECT {per}, CASE WHEN day_index = 0 THEN 'new' WHEN dt - before <= 7 THEN 'retaining'
       WHEN dt - before > 30 AND day_index >= 30 THEN 'resurrected' ELSE 'other' END AS state FROM placed
UNION ALL SELECT run, dt + 8, {d}, 'sleeping' FROM placed WHERE coalesce(after - dt > 8, true)
UNION ALL SELECT run, dt + 30, {d}, 'churned' FROM placed WHERE coalesce(after - dt > 30, true)""",
        "counts": f"""
SELECT {per}, {tally} FROM states WHERE dt BETWEEN run - {axis_days} AND run - 1 GROUP BY {per}""",
    }


def movement_ctes(bought_sql: str, dims: list[str], streams: list[str], axis_days: int) -> dict[str, str]:
    """``bought(run, dt, who, day_index, *dims, *streams)`` to ``moves``."""
    d = ", ".join(dims)
    rolled, moved = [], []
    for s in streams:
        rolled += [
            f"coalesce(sum({s}) FILTER (WHERE b.dt = x.dt AND day_index < 30), 0) AS {s}_t",
            f"coalesce(sum({s}) FILTER (WHERE b.dt BETWEEN x.dt - 30 AND x.dt - 1), 0) AS {s}_a",
            f"coalesce(sum({s}) FILTER (WHERE b.dt BETWEEN x.dt - 60 AND x.dt - 31), 0) AS {s}_b",
        ]
        a, b = f"{s}_a", f"{s}_b"
        moved += [
            f"{rnd_ratio(f'sum({s}_t)', '1', 2)} AS {s}_new",
            rnd_ratio(f"coalesce(sum({a} - {b}) FILTER (WHERE {a} >= {b} AND {b} > 0), 0)", "30", 2) + f" AS {s}_expansion",
            rnd_ratio(f"coalesce(sum({b} - {a}) FILTER (WHERE {a} < {b} AND {a} > 0), 0)", "30", 2) + f" AS {s}_contraction",
            rnd_ratio(f"coalesce(sum({b}) FILTER (WHERE {b} > 0 AND {a} = 0), 0)", "30", 2) + f" AS {s}_churned",
        ]
    return {
        "mrr_axis": axis(axis_days),
        "bought": bought_sql,
        "rolled": f"""
SELECT x.run, x.dt, b.who, {d}, {", ".join(rolled)}
FROM mrr_axis x JOIN bought b ON b.run = x.run AND b.dt BETWEEN x.dt - 60 AND x.dt GROUP BY ALL""",
        "moves": f"SELECT run, dt, {d}, {', '.join(moved)} FROM rolled GROUP BY run, dt, {d}",
    }


TRAFFIC = [f"traffic_{s}" for s in ("new", "retaining", "resurrected", "sleeping", "churned")]
MOVED = ("new", "expansion", "contraction", "churned")


def filled(streams: list[str]) -> str:
    counts = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in TRAFFIC)
    money = ", ".join(f"coalesce({s}_{m}, 0e0) AS {s}_{m}" for s in streams for m in MOVED)
    return f"{counts}, {money}"


def lifecycle_mrr_region() -> tuple[dict, str]:
    base = """
SELECT run, dt, user_id AS who, day_index, CASE WHEN country_code = 'TW' THEN 'TW' ELSE 'Others' END AS region,
       coalesce(sub, 0) AS sub_revenue, coalesce(can, 0) AS can_revenue
FROM runs JOIN activity ON dt BETWEEN run - 67 AND run - 1"""
    streams = ["sub_revenue", "can_revenue"]
    return {
        **lifecycle_ctes(base, ["region"], 7),
        **movement_ctes(
            "SELECT * FROM days WHERE sub_revenue > 0 OR can_revenue > 0", ["region"], streams, 7
        ),
        "merged": f"SELECT run, dt, region, {filled(streams)} FROM counts FULL JOIN moves USING (run, dt, region)",
    }, "* EXCLUDE (run) FROM merged"


def lifecycle_mrr_tier() -> tuple[dict, str]:
    every = f"""
SELECT run, b.dt, b.userid AS who, b.active, b.rev, coalesce(p.region, 'others') AS region,
       date_diff('day', signup_dt, b.dt) AS day_index,
       {TIER.format("(SELECT max(level) FROM levels l WHERE l.userid = b.userid AND l.dt BETWEEN "
                    + HALF.format("b.dt") + " AND b.dt)")} AS tier
FROM runs JOIN user_days b ON b.dt BETWEEN run - 68 AND run - 1
     LEFT JOIN people p ON p.userid = b.userid"""
    dims = ["region", "tier"]
    return {
        "paid": REVENUE_DAYS,
        "user_days": """
SELECT dt, userid, a.userid IS NOT NULL AS active, coalesce(rev, 0) AS rev
FROM (SELECT DISTINCT dt, userid FROM dailyactives) a FULL JOIN paid USING (dt, userid)""",
        "every": every,
        **lifecycle_ctes("SELECT * FROM every WHERE active", dims, 8),
        **movement_ctes("SELECT *, rev AS revenue FROM every WHERE rev > 0", dims, ["revenue"], 8),
        "tuples": "SELECT DISTINCT run, region, tier FROM every",
        "merged": f"""
SELECT x.run, x.dt, tier, region, {filled(["revenue"])}
FROM mrr_axis x JOIN tuples USING (run) LEFT JOIN counts USING (run, dt, region, tier)
     LEFT JOIN moves USING (run, dt, region, tier)""",
    }, "* EXCLUDE (run) FROM merged"


REPORT_SQL = {
    "main_kpi_nested": (EVENTS, main_kpi_nested),
    "purchase_distribution": (EVENTS, purchase_distribution),
    "streamer_activity": (EVENTS, streamer_activity),
    "lifecycle_mrr_region": (ORDERS, lifecycle_mrr_region),
    "stickiness_region": (EVENTS, stickiness_region),
    "main_kpi_flat": (EVENTS, main_kpi_flat),
    "currency_economy": (EVENTS, currency_economy),
    "main_kpi_slice": (EVENTS, main_kpi_slice),
    "lifecycle_mrr_tier": (ORDERS, lifecycle_mrr_tier),
    "kpi_by_level": (EVENTS, kpi_by_level),
    "stickiness_locale": (EVENTS, stickiness_locale),
}


def report_statement(name: str, first_run: str, last_run: str, keep_run: bool) -> str:
    relations, build = REPORT_SQL[name]
    ctes, final = build()
    label = "run AS run_date, " if keep_run else ""
    return statement(relations, {"runs": run_dates(first_run, last_run), **ctes}, f"SELECT {label}{final}")


__all__ = ["REPORT_SQL", "report_statement", "days"]
