"""Single operators on whole sample tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tideline.checks.relations import EVENTS, ORDERS, days, pct, rnd, rnd_ratio, run_dates, statement
from tideline.checks.report_sql import HALF, TIER, lifecycle_ctes, main_kpi_slice, movement_ctes
from tideline.functions.buckets import home_region, level_tier, locale_region, payer_flag
from tideline.functions.dates import day_index, half_month_start
from tideline.functions.numbers import pct_change, round_half_away, round_ratio
from tideline.functions.text import comma_list, escape_cell, form_value, metric_label
from tideline.operators import aggregates, levels
from tideline.operators.actives import rolling_distinct, trailing_sums
from tideline.operators.economy import ratio_of_sums, sold_per_day
from tideline.operators.joins import attach_user_day, attach_user_dim, merge_outer
from tideline.operators.lifecycle import lifecycle_counts, lifecycle_events, prev_next_active
from tideline.operators.revenue import per_day, revenue_movements, rolling_revenue
from tideline.operators.series import anomaly_shortlist, baseline_pack, comparison_pack, to_long
from tideline.operators.spine import (
    available_only_if, calendar, calendar_of, dimension_spine, on_spine, shift_date,
)
from tideline.plans.kpi import SETTLED
from tideline.plans.registry import backfill
from tideline.sources.sample import EventsWorld, OrdersWorld
from tideline.sources.warehouse import scan

QUERIES, ORACLE = {}, {}
FIRST, LAST = date(1995, 1, 1), date(2001, 8, 1)
SPAN = f"DATE '{FIRST}', DATE '{LAST}'"


def check(name: str, relations: dict, ctes: dict, final: str):
    """Register a query under ``name`` together with its SQL."""

    def register(query):
        QUERIES[name] = query
        ORACLE[name] = statement(relations, ctes, final)
        return query

    return register


# --- sources -------------------------------------------------------------------------


@check("scan_date_range", EVENTS, {}, """
SELECT event_id, user_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'""")
def _(spark, d):
    rows = scan(spark, f"{d}/events.parquet", "ts", date(2024, 1, 8), date(2024, 1, 21))
    return rows.select("event_id", "user_id", "event_type")


@check("nested_struct_agg", EVENTS, {}, """
SELECT dt, CAST(sum(can) AS DOUBLE) AS can_revenue, CAST(sum(sub) AS DOUBLE) AS sub_revenue,
       count(*) FILTER (WHERE can IS NOT NULL OR sub IS NOT NULL) AS paying_rows,
       count(*) FILTER (WHERE clicks = 0) AS without_match
FROM activity GROUP BY dt""")
def _(spark, d):
    can, sub = F.col("can_purchasing_dim"), F.col("sub_purchasing_dim")
    return EventsWorld(spark, d)["daily_user_activities"].groupBy("dt").agg(
        F.sum(can["revenue"]).cast("double").alias("can_revenue"),
        F.sum(sub["revenue"]).cast("double").alias("sub_revenue"),
        F.count(F.when(can.isNotNull() | sub.isNotNull(), 1)).alias("paying_rows"),
        F.count(F.when(F.col("matching_dim").isNull(), 1)).alias("without_match"),
    )


# --- calendars and spines ------------------------------------------------------------

ORDER_AXIS = {"axis": "SELECT CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM ord"}
PENDING = "SELECT dt, count(*) AS n, CAST(sum(price) AS DOUBLE) AS amount FROM ord WHERE status = 'P' GROUP BY dt"


def _pending(world):
    return world.orders.where(F.col("o_orderstatus") == "P").groupBy("dt").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("amount")
    )


@check("calendar_spine", ORDERS, ORDER_AXIS, "SELECT dt FROM axis")
def _(spark, d):
    return calendar_of(OrdersWorld(spark, d).orders, "dt")


@check("spine_zero_fill", ORDERS, ORDER_AXIS | {"p": PENDING}, """
SELECT axis.dt, coalesce(n, 0) AS n, coalesce(amount, 0e0) AS amount FROM axis LEFT JOIN p ON p.dt = axis.dt""")
def _(spark, d):
    world = OrdersWorld(spark, d)
    return on_spine(calendar_of(world.orders, "dt"), _pending(world), fill={"n": 0, "amount": 0})


@check("spine_null_keep", ORDERS, ORDER_AXIS | {"p": PENDING}, """
SELECT axis.dt, n, amount FROM axis LEFT JOIN p ON p.dt = axis.dt""")
def _(spark, d):
    world = OrdersWorld(spark, d)
    return on_spine(calendar_of(world.orders, "dt"), _pending(world))


@check("spine_dimensional", EVENTS, {
    "axis": days("DATE '2023-12-02'", "DATE '2024-01-30'"),
    "daily": "SELECT dt, country_code, count(*) AS users FROM activity GROUP BY ALL",
    "dims": "SELECT DISTINCT country_code FROM daily",
}, """
SELECT a.dt, d.country_code, coalesce(users, 0) AS users
FROM axis a, dims d LEFT JOIN daily x ON x.dt = a.dt AND x.country_code = d.country_code""")
def _(spark, d):
    daily = EventsWorld(spark, d)["daily_user_activities"].groupBy("dt", "country_code").agg(
        F.count(F.lit(1)).alias("users")
    )
    dims = daily.select("country_code").distinct()
    spine = dimension_spine(dims, date(2023, 12, 2), date(2024, 1, 30))
    return on_spine(spine, daily, ["dt", "country_code"], fill={"users": 0})


@check("availability_flags", EVENTS, {
    "axis": days("DATE '2023-12-02'", "DATE '2024-02-05'"),
    "acts": "SELECT dt, count(*) AS n FROM activity GROUP BY dt",
}, """
SELECT x.dt, coalesce(n, 0) AS n, coalesce(CAST(gross AS DOUBLE), 0) AS gross,
       CAST(a.dt IS NOT NULL AS INTEGER) AS activity_available,
       CAST(g.dt IS NOT NULL AS INTEGER) AS ads_available,
       CAST(a.dt IS NOT NULL AND g.dt IS NOT NULL AS INTEGER) AS all_available
FROM axis x LEFT JOIN acts a ON a.dt = x.dt LEFT JOIN ads g ON g.dt + 1 = x.dt""")
def _(spark, d):
    world = EventsWorld(spark, d)
    acts = world["daily_user_activities"].groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
    ads = shift_date(world["admob_revenue"], 1).select("dt", F.col("gross_revenue").cast("double").alias("gross"))
    axis = calendar(spark, date(2023, 12, 2), date(2024, 2, 5))
    wide = on_spine(axis, acts, fill={"n": 0}, available="activity_available")
    wide = on_spine(wide, ads, fill={"gross": 0}, available="ads_available")
    return wide.withColumn("all_available", available_only_if("activity_available", "ads_available"))


@check("date_shift_source", EVENTS, {}, """
SELECT CAST(dt + 1 AS DATE) AS dt, CAST(gross AS DOUBLE) AS gross_revenue FROM ads""")
def _(spark, d):
    shifted = shift_date(EventsWorld(spark, d)["admob_revenue"], 1)
    return shifted.select("dt", F.col("gross_revenue").cast("double").alias("gross_revenue"))


# --- predicates ----------------------------------------------------------------------

SALES_SHOWN = "s.dt, s.userid, s.productid, CAST(s.dollars AS DOUBLE) AS dollars, s.status"


def _sales(world):
    return world["store_transaction"].select(
        F.to_date("datecreated").alias("dt"), "userid", "productid",
        F.col("amountdollars").cast("double").alias("dollars"), "status",
    )


@check("filter_between", ORDERS, {}, """
SELECT dt, userid FROM dailyactives WHERE dt BETWEEN DATE '1996-02-01' AND DATE '1997-01-31'""")
def _(spark, d):
    within = F.col("day").between(F.lit(date(1996, 2, 1)), F.lit(date(1997, 1, 31)))
    return OrdersWorld(spark, d)["dailyactives"].where(within).select(F.col("day").alias("dt"), "userid")


@check("filter_in_list", ORDERS, {}, f"SELECT {SALES_SHOWN} FROM sales s WHERE status IN ('AUTHORIZED', 'COMPLETED')")
def _(spark, d):
    return _sales(OrdersWorld(spark, d)).where(F.col("status").isin(*SETTLED))


@check("filter_not_in_nullable", ORDERS, {}, f"""
SELECT {SALES_SHOWN}, name FROM sales s LEFT JOIN store_product p ON p.id = s.productid
WHERE name NOT IN ('ECONOMY', 'PROMO')""")
def _(spark, d):
    world = OrdersWorld(spark, d)
    products = world["store_product"].withColumnRenamed("id", "productid")
    joined = _sales(world).join(products, "productid", "left")
    return joined.where(~F.col("name").isin("ECONOMY", "PROMO"))


@check("filter_active_users", ORDERS, {}, f"""
SELECT {SALES_SHOWN} FROM sales s LEFT JOIN people p ON p.userid = s.userid WHERE p.terminated = 0""")
def _(spark, d):
    world = OrdersWorld(spark, d)
    current = world["users_data"].select("userid", "terminated")
    return _sales(world).join(current, "userid", "left").where(F.col("terminated") == 0).drop("terminated")


@check("having_positive_revenue", EVENTS, {}, """
SELECT dt, userid, CAST(sum(dollars) AS DOUBLE) AS revenue FROM sales GROUP BY ALL HAVING sum(dollars) > 50""")
def _(spark, d):
    spent = aggregates.user_day(
        EventsWorld(spark, d)["store_transaction"], F.to_date("datecreated"), "userid",
        {"revenue": F.sum("amountdollars")},
    )
    return spent.where(F.col("revenue") > 50).withColumn("revenue", F.col("revenue").cast("double"))


@check("filter_scalar_subquery", ORDERS, {}, """
SELECT dt, userid FROM dailyactives WHERE dt > (SELECT max(dt) - 365 FROM dailyactives)""")
def _(spark, d):
    active = OrdersWorld(spark, d)["dailyactives"].select(F.col("day").alias("dt"), "userid")
    newest = active.select(F.date_sub(F.max("dt"), 365)).scalar()
    return active.where(F.col("dt") > newest)


# --- buckets -------------------------------------------------------------------------


@check("bucket_country", ORDERS, {}, """
SELECT user_id, CASE WHEN country_code = 'TW' THEN 'TW' ELSE 'others' END AS region FROM home""")
def _(spark, d):
    return OrdersWorld(spark, d).home.select("user_id", home_region(F.col("country_code")).alias("region"))


@check("bucket_locale_region", ORDERS, {}, """
SELECT h.user_id, coalesce(region, 'others') AS region FROM home h LEFT JOIN people p ON p.userid = h.user_id""")
def _(spark, d):
    world = OrdersWorld(spark, d)
    users = world["users_data"].withColumnRenamed("userid", "user_id")
    return world.home.select("user_id").join(users, "user_id", "left").select(
        "user_id", locale_region(F.col("country"), F.col("locale")).alias("region")
    )


@check("bucket_level_tier", EVENTS, {}, f"""
SELECT a.dt, a.userid, {TIER.format("level")} AS tier
FROM dailyactives a LEFT JOIN levels l ON l.userid = a.userid AND l.dt = a.dt""")
def _(spark, d):
    world = EventsWorld(spark, d)
    best = levels.daily_level(world["crown_level_log"], "userid", "datecreated", "crown_level")
    active = world["dailyactives"].select(F.col("day").alias("dt"), "userid")
    joined = attach_user_day(active, best, ["dt", "userid"])
    return joined.select("dt", "userid", level_tier(F.col("level")).alias("tier"))


@check("half_month_period", ORDERS, ORDER_AXIS, f"SELECT dt, {HALF.format('dt')} AS period_start FROM axis")
def _(spark, d):
    axis = calendar_of(OrdersWorld(spark, d).orders, "dt")
    return axis.withColumn("period_start", half_month_start(F.col("dt")))


@check("day_index", ORDERS, {}, """
SELECT a.dt, a.userid, CAST(date_diff('day', signup_dt, a.dt) AS INTEGER) AS day_index
FROM dailyactives a LEFT JOIN people p ON p.userid = a.userid""")
def _(spark, d):
    world = OrdersWorld(spark, d)
    active = world["dailyactives"].select(F.col("day").alias("dt"), "userid")
    joined = attach_user_dim(active, world["users_data"], "userid")
    return joined.select("dt", "userid", day_index(F.col("signup_dt"), F.col("dt")).alias("day_index"))


@check("bucket_payer_flag", ORDERS, {}, "SELECT dt, userid, coalesce(revenue > 0, false) AS is_payer FROM dailyactives")
def _(spark, d):
    return OrdersWorld(spark, d)["dailyactives"].select(
        F.col("day").alias("dt"), "userid", payer_flag(F.col("revenue")).alias("is_payer")
    )


# --- joins ---------------------------------------------------------------------------


@check("join_user_dim", ORDERS, {}, """
SELECT a.dt, a.userid, coalesce(region, 'others') AS region, signup_dt
FROM dailyactives a LEFT JOIN people p ON p.userid = a.userid""")
def _(spark, d):
    world = OrdersWorld(spark, d)
    active = world["dailyactives"].select(F.col("day").alias("dt"), "userid")
    return attach_user_dim(active, world["users_data"], "userid")


PAID_DAYS = {"paid": "SELECT dt, userid, sum(dollars) AS rev FROM sales WHERE status IN ('AUTHORIZED', 'COMPLETED') GROUP BY ALL"}


def _paid(world):
    settled = world["store_transaction"].where(F.col("status").isin(*SETTLED))
    return aggregates.user_day(settled, F.to_date("datecreated"), "userid", {"rev": F.sum("amountdollars")})


@check("join_user_day_revenue", ORDERS, PAID_DAYS, """
SELECT a.dt, a.userid, CAST(rev AS DOUBLE) AS rev
FROM dailyactives a LEFT JOIN paid p ON p.userid = a.userid AND p.dt = a.dt""")
def _(spark, d):
    world = OrdersWorld(spark, d)
    active = world["dailyactives"].select(F.col("day").alias("dt"), "userid")
    return attach_user_day(active, _paid(world), ["dt", "userid"]).withColumn("rev", F.col("rev").cast("double"))


@check("join_full_outer_merge", EVENTS, {
    "a": "SELECT dt, level, count(*) AS users FROM levels GROUP BY ALL",
    "b": "SELECT dt, productid // 6 AS level, sum(bars) AS bars FROM sales GROUP BY ALL",
}, """
SELECT coalesce(a.dt, b.dt) AS dt, coalesce(a.level, b.level) AS level,
       coalesce(users, 0) AS users, CAST(coalesce(bars, 0) AS BIGINT) AS bars
FROM a FULL JOIN b ON a.dt = b.dt AND a.level = b.level""")
def _(spark, d):
    world = EventsWorld(spark, d)
    best = levels.daily_level(world["crown_level_log"], "userid", "datecreated", "crown_level")
    a = best.groupBy("dt", "level").agg(F.count(F.lit(1)).alias("users"))
    b = world["store_transaction"].groupBy(
        F.to_date("datecreated").alias("dt"), F.floor(F.col("productid") / 6).cast("int").alias("level")
    ).agg(F.sum("amountbars").alias("bars"))
    return merge_outer(a, b, ["dt", "level"])


@check("range_join_calendar", ORDERS, ORDER_AXIS, """
SELECT x.dt, status, count(*) AS orders, CAST(sum(price) AS DOUBLE) AS amount
FROM axis x JOIN ord o ON o.dt BETWEEN x.dt - 29 AND x.dt GROUP BY ALL""")
def _(spark, d):
    facts = OrdersWorld(spark, d).orders.select("dt", F.col("o_orderstatus").alias("status"), "price", F.lit(1).alias("one"))
    sums = trailing_sums(facts, FIRST, LAST, ["status"], ["one", "price"], 30)
    return sums.select("dt", "status", F.col("one").alias("orders"), F.col("price").cast("double").alias("amount"))


URGENT = {
    "urgent": "SELECT dt, user_id AS userid, max(o_orderkey % 15) AS level FROM ord WHERE priority = '1-URGENT' GROUP BY ALL",
    "normal": "SELECT DISTINCT dt, user_id AS userid FROM ord WHERE priority <> '1-URGENT'",
}


def _urgent(world):
    """Levels logged on urgent orders, activity on all others."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    log = world.orders.select("dt", F.col("user_id").alias("userid"), urgent.alias("u"),
                              (F.col("o_orderkey") % 15).cast("int").alias("level"))
    best = log.where("u").groupBy("dt", "userid").agg(F.max("level").alias("level"))
    return log.where("not u").select("dt", "userid").distinct(), best


@check("asof_level_30d", ORDERS, URGENT, """
SELECT n.dt, n.userid, CAST(coalesce(arg_max(level, u.dt), 0) AS INTEGER) AS level
FROM normal n LEFT JOIN urgent u ON u.userid = n.userid AND u.dt BETWEEN n.dt - 30 AND n.dt GROUP BY ALL""")
def _(spark, d):
    return levels.asof_level(*_urgent(OrdersWorld(spark, d)), "userid", 30)


@check("period_to_date_level", ORDERS, URGENT, f"""
SELECT n.dt, n.userid, CAST(max(level) AS INTEGER) AS level
FROM normal n LEFT JOIN urgent u ON u.userid = n.userid AND u.dt BETWEEN {HALF.format("n.dt")} AND n.dt GROUP BY ALL""")
def _(spark, d):
    return levels.period_to_date_level(*_urgent(OrdersWorld(spark, d)), "userid")


# --- aggregates ----------------------------------------------------------------------


@check("agg_dau", EVENTS, {}, "SELECT dt, count(DISTINCT user_id) AS dau FROM ev GROUP BY dt")
def _(spark, d):
    return aggregates.daily_distinct(EventsWorld(spark, d).events, ["dt"], "user_id", {"dau": F.lit(True)})


@check("agg_conditional_distinct", EVENTS, {}, """
SELECT dt, count(DISTINCT CASE WHEN kind = 'purchase' THEN user_id END) AS payers,
       count(DISTINCT CASE WHEN kind = 'view' AND value > 100 THEN user_id END) AS viewers,
       count(DISTINCT CASE WHEN k >= 90 THEN user_id END) AS high_k
FROM ev GROUP BY dt""")
def _(spark, d):
    kind = F.col("event_type")
    return aggregates.daily_distinct(EventsWorld(spark, d).events, ["dt"], "user_id", {
        "payers": kind == "purchase",
        "viewers": (kind == "view") & (F.col("value") > 100),
        "high_k": F.col("k") >= 90,
    })


@check("agg_conditional_sum", EVENTS, {}, """
SELECT dt, CAST(sum(CASE WHEN kind = 'purchase' THEN value ELSE 0 END) AS DOUBLE) AS bought,
       CAST(sum(CASE WHEN kind = 'view' THEN value ELSE 0 END) AS DOUBLE) AS viewed
FROM ev GROUP BY dt""")
def _(spark, d):
    def part(kind):
        hit = F.when(F.col("event_type") == kind, F.col("value")).otherwise(F.lit(0).cast("decimal(18,2)"))
        return F.sum(hit).cast("double")

    return EventsWorld(spark, d).events.groupBy("dt").agg(part("purchase").alias("bought"), part("view").alias("viewed"))


@check("agg_user_day", EVENTS, {}, """
SELECT dt, userid, count(DISTINCT productid) AS products, CAST(sum(dollars) AS DOUBLE) AS dollars
FROM sales GROUP BY ALL""")
def _(spark, d):
    return aggregates.user_day(
        EventsWorld(spark, d)["store_transaction"], F.to_date("datecreated"), "userid",
        {"products": F.count_distinct("productid"), "dollars": F.sum("amountdollars").cast("double")},
    )


@check("agg_daily_level", EVENTS, {}, "SELECT dt, userid, level FROM levels")
def _(spark, d):
    return levels.daily_level(EventsWorld(spark, d)["crown_level_log"], "userid", "datecreated", "crown_level")


@check("merge_user_day", ORDERS, PAID_DAYS, """
SELECT coalesce(a.dt, p.dt) AS dt, coalesce(a.userid, p.userid) AS userid,
       CAST(a.userid IS NOT NULL AS INTEGER) AS is_active, coalesce(CAST(rev AS DOUBLE), 0) AS rev
FROM (SELECT dt, userid FROM dailyactives WHERE revenue IS NULL) a
     FULL JOIN paid p ON p.dt = a.dt AND p.userid = a.userid""")
def _(spark, d):
    world = OrdersWorld(spark, d)
    zero = F.lit(0).cast("decimal(18,2)")
    active = world["dailyactives"].where(F.col("revenue").isNull()).select(
        F.col("day").alias("dt"), "userid", F.lit(1).alias("is_active"), zero.alias("rev")
    )
    paid = _paid(world).select("dt", "userid", F.lit(0).alias("is_active"), "rev")
    return aggregates.merge_user_days(
        [active, paid], ["dt", "userid"],
        {"is_active": F.max("is_active"), "rev": F.sum("rev").cast("double")},
    )


def _ranked(column: str, p: str) -> str:
    spot = f"({p} * (n - 1))"
    low, high = (f"max({column}) FILTER (WHERE pos = {f}({spot}))" for f in ("floor", "ceil"))
    return f"{low} + ({high} - {low}) * max({spot} - floor({spot}))"


@check("agg_percentiles", ORDERS, {
    "placed": """
SELECT priority, CAST(price AS DOUBLE) AS price, count(*) OVER (PARTITION BY priority) AS n,
       row_number() OVER (PARTITION BY priority ORDER BY price) - 1 AS pos FROM ord""",
}, " UNION ALL ".join(
    f"SELECT priority, {p} AS fraction, {rnd('(' + _ranked('price', p) + ')', 2)} AS percentile FROM placed GROUP BY priority"
    for p in ("0.5e0", "0.9e0", "0.99e0", "0.999e0")
))
def _(spark, d):
    prices = OrdersWorld(spark, d).orders.select(F.col("o_orderpriority").alias("priority"), "price")
    points = aggregates.exact_percentiles(prices, ["priority"], "price", [0.5, 0.9, 0.99, 0.999])
    return points.withColumn("percentile", round_half_away(F.col("percentile"), 2))


@check("agg_hours", EVENTS, {}, f"""
SELECT dt, is_video, {rnd_ratio("sum(seconds)", "3600", 2)} AS hours FROM streams GROUP BY ALL""")
def _(spark, d):
    return EventsWorld(spark, d)["streaming"].groupBy(F.to_date("start_time").alias("dt"), "is_video").agg(
        aggregates.hours(F.sum("duration")).alias("hours")
    )


@check("distinct_dims", EVENTS, {}, f"""
SELECT DISTINCT coalesce(region, 'others') AS region, {TIER.format("level")} AS tier
FROM levels l LEFT JOIN people p ON p.userid = l.userid""")
def _(spark, d):
    world = EventsWorld(spark, d)
    best = levels.daily_level(world["crown_level_log"], "userid", "datecreated", "crown_level")
    tiered = attach_user_dim(best, world["users_data"], "userid")
    return tiered.select("region", level_tier(F.col("level")).alias("tier")).distinct()


# --- windows on a dense series of six years -------------------------------------------

SERIES = ORDER_AXIS | {
    "dims": "SELECT DISTINCT status FROM ord",
    "daily": "SELECT dt, status, count(*) AS orders, sum(price) AS amount FROM ord GROUP BY ALL",
    "wide": """
SELECT a.dt, d.status, coalesce(orders, 0) AS orders, coalesce(amount, 0) AS amount
FROM axis a, dims d LEFT JOIN daily y ON y.dt = a.dt AND y.status = d.status""",
    "long": """
SELECT dt, status, 'orders' AS metric, CAST(orders AS DECIMAL(28,4)) AS value FROM wide
UNION ALL SELECT dt, status, 'amount', CAST(amount AS DECIMAL(28,4)) FROM wide""",
}
BY_SERIES = "OVER (PARTITION BY status, metric ORDER BY dt"


def _mean(rows: int) -> str:
    frame = f"{BY_SERIES} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    return rnd_ratio(f"sum(value) {frame}", f"count(value) {frame}", 2)


WINDOWED = {
    "previous_day": f"CAST(lag(value) {BY_SERIES}) AS DOUBLE)",
    "last_week": f"CAST(lag(value, 7) {BY_SERIES}) AS DOUBLE)",
    "previous_7d_avg": _mean(7),
    "previous_30d_avg": _mean(30),
    "previous_30d_stddev": rnd(
        f"stddev_samp(CAST(value AS DOUBLE)) {BY_SERIES} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)", 2
    ),
}


def _series_sql(*columns: str) -> str:
    shown = ", ".join(f"{WINDOWED[c]} AS {c}" for c in columns)
    return f"SELECT dt, status, metric, CAST(value AS DOUBLE) AS value, {shown} FROM long"


def _series(spark, d):
    world = OrdersWorld(spark, d)
    daily = world.orders.groupBy("dt", F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("price").alias("amount")
    )
    spine = dimension_spine(daily.select("status").distinct(), FIRST, LAST)
    wide = on_spine(spine, daily, ["dt", "status"], fill={"orders": 0, "amount": 0})
    return to_long(wide, ["dt", "status"], ["orders", "amount"])


def _windowed(*columns):
    def query(spark, d):
        packed = baseline_pack(_series(spark, d), ["status"])
        return packed.select("dt", "status", "metric", "value", *columns)

    return query


for _name, _columns in {
    "win_lag": ("previous_day", "last_week"),
    "win_trailing_avg": ("previous_7d_avg", "previous_30d_avg"),
    "win_trailing_stddev": ("previous_30d_stddev",),
    "baseline_pack": tuple(WINDOWED),
}.items():
    check(_name, ORDERS, SERIES, _series_sql(*_columns))(_windowed(*_columns))


@check("comparison_pack", ORDERS, SERIES | {"packed": _series_sql(*WINDOWED)}, f"""
SELECT dt, status, metric, value, {pct("value", "previous_day")} AS dod_pct,
       {pct("value", "last_week")} AS wow_pct, {pct("value", "previous_7d_avg")} AS vs_7d_avg_pct,
       {pct("value", "previous_30d_avg")} AS vs_30d_avg_pct,
       {rnd_ratio("CAST(value AS DECIMAL(20,4)) - CAST(previous_30d_avg AS DECIMAL(20,4))", "previous_30d_stddev", 2)} AS z_score_30d
FROM packed""")
def _(spark, d):
    compared = comparison_pack(baseline_pack(_series(spark, d), ["status"]))
    return compared.select("dt", "status", "metric", "value", "dod_pct", "wow_pct", "vs_7d_avg_pct",
                           "vs_30d_avg_pct", "z_score_30d")


@check("unpivot_metrics", EVENTS, {
    "wide": """
SELECT userid, dt, bars_spent, revenue FROM dailyactives""",
}, """
SELECT userid, dt, 'bars_spent' AS metric, CAST(bars_spent AS DOUBLE) AS value FROM wide
UNION ALL SELECT userid, dt, 'revenue', CAST(revenue AS DOUBLE) FROM wide""")
def _(spark, d):
    wide = EventsWorld(spark, d)["dailyactives"].withColumnRenamed("day", "dt")
    long = to_long(wide, ["userid", "dt"], ["bars_spent", "revenue"])
    return long.withColumn("value", F.col("value").cast("double"))


@check("win_ratio_of_sums", ORDERS, {
    "sold": """
SELECT dt, sum(dollars) AS dollars, sum(bars) AS bars FROM sales LEFT JOIN store_product p ON p.id = productid
WHERE name NOT IN ('PROMO', 'ECONOMY') AND status IN ('AUTHORIZED', 'COMPLETED') GROUP BY dt""",
}, "SELECT dt, " + ", ".join(
    rnd(f"(CAST(sum(bars) OVER (ORDER BY dt ROWS {n - 1} PRECEDING) AS DOUBLE) / "
        f"nullif(CAST(sum(dollars) OVER (ORDER BY dt ROWS {n - 1} PRECEDING) AS DOUBLE), 0))", 8) + f" AS ratio_{n}"
    for n in (3, 16, 30)
) + " FROM sold")
def _(spark, d):
    world = OrdersWorld(spark, d)
    sales = world["store_transaction"].where(F.col("status").isin(*SETTLED)).withColumn("dt", F.to_date("datecreated"))
    daily = sold_per_day(sales, world["store_product"], ("PROMO", "ECONOMY"))
    rolling = ratio_of_sums(daily, "bars", "dollars", (3, 16, 30))
    return rolling.select("dt", *[round_half_away(F.col(f"ratio_{n}"), 8).alias(f"ratio_{n}") for n in (3, 16, 30)])


@check("win_prev_next_active", ORDERS, {}, """
SELECT dt, userid, lag(dt) OVER (PARTITION BY userid ORDER BY dt) AS prev_active_dt,
       lead(dt) OVER (PARTITION BY userid ORDER BY dt) AS next_active_dt FROM dailyactives""")
def _(spark, d):
    active = OrdersWorld(spark, d)["dailyactives"].select(F.col("day").alias("dt"), "userid")
    return prev_next_active(active, "userid")


@check("win_latest_per_key", EVENTS, {
    "ranked": """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k // 7 DESC) AS pos FROM ev WHERE kind = 'error'""",
}, "SELECT user_id AS userid, ts AS datecreated, k // 7 AS crown_level FROM ranked WHERE pos = 1")
def _(spark, d):
    return levels.latest_per_key(EventsWorld(spark, d)["crown_level_log"], ["userid"], "datecreated", ["crown_level"])


# --- scalar functions ----------------------------------------------------------------




@check("scalar_functions", EVENTS, {
    "t": """
SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}, f"""
SELECT doc_id, coalesce(quality, -1) AS quality, {rnd_ratio("n_chars", "toxic", 4)} AS chars_per_toxic,
       {pct("n_chars", "quality")} AS change_pct,
       replace(replace(text, '|', '\\|'), chr(10), ' ') AS escaped,
       replace(lang || '_' || source, '_', ' ') AS label,
       CAST(len(list_filter(string_split(text, ','), lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13)
            || ' ' || chr(133) || chr(160)) <> '')) AS INTEGER) AS listed,
       'lang=' || lang || ' & source=' || source AS decoded,
       CAST(date_trunc('month', DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER)) AS DATE) AS month_start,
       CAST(day(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER)) AS INTEGER) AS day_of_month
FROM t""")
def _(spark, d):
    world = EventsWorld(spark, d)
    t = world.table("documents").join(world.table("labels"), "doc_id", "left")
    sent = F.concat(F.lit("lang="), "lang", F.lit(" & source="), "source")
    body = F.concat(F.lit("token=x&payload="), F.url_encode(sent), F.lit("&team=y"))
    some_day = F.date_add(F.lit(date(2024, 1, 1)), (F.col("doc_id") % 400).cast("int"))
    return t.select(
        "doc_id",
        F.coalesce("quality", F.lit(-1)).alias("quality"),
        round_ratio(F.col("n_chars"), F.col("toxic"), 4).alias("chars_per_toxic"),
        pct_change(F.col("n_chars"), F.col("quality")).alias("change_pct"),
        escape_cell(F.col("text")).alias("escaped"),
        metric_label(F.concat("lang", F.lit("_"), "source"), F.lit("  ")).alias("label"),
        F.size(comma_list(F.col("text"))).alias("listed"),
        form_value(body, "payload").alias("decoded"),
        F.trunc(some_day, "month").alias("month_start"),
        F.dayofmonth(some_day).alias("day_of_month"),
    )


# --- composite operators over the whole order history ---------------------------------


@check("rolling_distinct_actives", ORDERS, {
    "axis": days(*SPAN.split(", ")),
    "act": "SELECT dt, user_id, CASE WHEN country_code = 'TW' THEN 'TW' ELSE 'others' END AS region FROM activity",
}, """
SELECT x.dt, region, count(DISTINCT user_id) FILTER (WHERE a.dt = x.dt) AS active_1d,
       count(DISTINCT user_id) FILTER (WHERE a.dt > x.dt - 7) AS active_7d, count(DISTINCT user_id) AS active_30d
FROM axis x LEFT JOIN act a ON a.dt BETWEEN x.dt - 29 AND x.dt GROUP BY x.dt, region""")
def _(spark, d):
    active = OrdersWorld(spark, d)["daily_user_activities"].select(
        "dt", "user_id", home_region(F.col("country_code")).alias("region")
    )
    return rolling_distinct(spark, active, FIRST, LAST, ["region"], "user_id")


# One run that sees the whole history and reports on all of it.
WHOLE = {"runs": run_dates("2001-08-02", "2001-08-02")}
ALL_DAYS = (LAST - FIRST).days + 1
WHOLE_DAYS = f"""
SELECT run, dt, user_id AS who, day_index, CASE WHEN country_code = 'TW' THEN 'TW' ELSE 'others' END AS region,
       coalesce(can, 0) + coalesce(sub, 0) AS paid FROM runs JOIN activity ON dt BETWEEN run - {ALL_DAYS} AND run - 1"""


def _whole_days(spark, d):
    can = F.coalesce(F.col("can_purchasing_dim.revenue"), F.lit(0))
    sub = F.coalesce(F.col("sub_purchasing_dim.revenue"), F.lit(0))
    return OrdersWorld(spark, d)["daily_user_activities"].select(
        "dt", "user_id", "day_index", home_region(F.col("country_code")).alias("region"),
        (can + sub).cast("decimal(18,2)").alias("paid"),
    )


@check("lifecycle_events", ORDERS, WHOLE | lifecycle_ctes(WHOLE_DAYS, ["region"], ALL_DAYS), f"""
SELECT dt, region, CASE WHEN state = 'other' THEN 'other_active' ELSE state END AS state, count(*) AS n
FROM states WHERE dt BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY ALL""")
def _(spark, d):
    events = lifecycle_events(_whole_days(spark, d), FIRST, LAST, ["region"], "user_id")
    return events.groupBy("dt", "region", "state").agg(F.sum("n").alias("n"))


@check("lifecycle_counts", ORDERS, WHOLE | lifecycle_ctes(WHOLE_DAYS, ["region"], ALL_DAYS),
       "SELECT * EXCLUDE (run) FROM counts")
def _(spark, d):
    events = lifecycle_events(_whole_days(spark, d), FIRST, LAST, ["region"], "user_id")
    return lifecycle_counts(events, ["dt", "region"])


MOVES = WHOLE | {"days": WHOLE_DAYS} | movement_ctes("SELECT * FROM days WHERE paid > 0", ["region"], ["paid"], ALL_DAYS)


@check("rolling_revenue", ORDERS, MOVES, """
SELECT dt, region, count(*) AS users, CAST(sum(paid_t) AS DOUBLE) AS paid_today,
       CAST(sum(paid_a) AS DOUBLE) AS paid_past, CAST(sum(paid_b) AS DOUBLE) AS paid_prev
FROM rolled GROUP BY ALL""")
def _(spark, d):
    paying = _whole_days(spark, d).where(F.col("paid") > 0)
    rolled = rolling_revenue(paying, FIRST, LAST, ["region"], "user_id", {"paid": "paid"})
    return rolled.groupBy("dt", "region").agg(
        F.count(F.lit(1)).alias("users"),
        *[F.sum(f"paid_{w}").cast("double").alias(f"paid_{w}") for w in ("today", "past", "prev")],
    )


@check("mrr_movements", ORDERS, MOVES, "SELECT * EXCLUDE (run) FROM moves")
def _(spark, d):
    paying = _whole_days(spark, d).where(F.col("paid") > 0)
    moves = revenue_movements(paying, FIRST, LAST, ["region"], "user_id", {"paid": "paid"})
    return per_day(moves, ["dt", "region"], ["paid"])


_slice_ctes, _ = main_kpi_slice()


@check("anomaly_shortlist", EVENTS, {"runs": run_dates("2024-01-16", "2024-01-31"), **_slice_ctes}, """
SELECT * FROM (
  SELECT run AS run_date, region, tier, metric, value, vs_7d_avg_pct, z_score_30d,
         CASE WHEN vs_7d_avg_pct IS NULL OR z_score_30d IS NULL THEN 'not comparable'
              WHEN abs(z_score_30d) >= 2 AND abs(vs_7d_avg_pct) >= 50 THEN 'level and spread'
              WHEN abs(z_score_30d) >= 2 THEN 'spread' WHEN abs(vs_7d_avg_pct) >= 50 THEN 'level' END AS status
  FROM compared) WHERE status IS NOT NULL""")
def _(spark, d):
    compared = backfill(spark, "main_kpi_slice", EventsWorld(spark, d), date(2024, 1, 15), date(2024, 1, 30))
    listed = anomaly_shortlist(compared, min_abs_z=2, min_abs_pct=50)
    return listed.select("run_date", "region", "tier", "metric", "value", "vs_7d_avg_pct", "z_score_30d", "status")
