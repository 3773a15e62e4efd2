"""SQL text of the sample relations and a few helpers to assemble statements."""

from __future__ import annotations

import re

HOME = """
SELECT c_custkey AS user_id, n_name, n_regionkey, c_acctbal, c_mktsegment,
       CASE WHEN c_nationkey = 1 THEN 'TW' ELSE n_name END AS country_code
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
"""

USERS_DATA = """
SELECT h.user_id AS userid,
       CASE WHEN n_regionkey = 1 THEN 'US' ELSE n_name END AS country,
       CASE n_regionkey WHEN 0 THEN 'en' WHEN 2 THEN 'es' WHEN 3 THEN 'me' WHEN 4 THEN 'de' END AS locale,
       f.first_dt AS datecreated,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS terminated
FROM home h LEFT JOIN first_days f ON f.user_id = h.user_id
WHERE c_acctbal >= 0
"""

# User table with the region spelled out, one row per user.
PEOPLE = """
SELECT userid, datecreated AS signup_dt, terminated,
       CASE WHEN country = 'US' THEN 'na' WHEN locale IN ('en', 'es', 'me') THEN locale
            ELSE 'others' END AS region
FROM users_data
"""

STORE_PRODUCT = "SELECT p_partkey AS id, nullif(p_type, 'STANDARD') AS name FROM part"

GUIDELINES = """
SELECT d.doc_id AS id,
       CASE lang WHEN 'en' THEN 'metric_logic' WHEN 'de' THEN 'formatting'
                 WHEN 'es' THEN 'investigation' ELSE 'context' END AS category,
       text AS rule_text, quality = 1 AS is_active,
       CASE WHEN source <> 'src0' THEN source END AS source
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

FEEDBACK = """
SELECT *, CASE WHEN state = 'incorporated' THEN run_id + turn END AS derived_guideline_id
FROM (
  SELECT conv_id * 100 + turn AS id, conv_id AS run_id, turn,
         CASE WHEN turn % 4 <> 0 THEN text END AS raw_text,
         CASE WHEN turn % 4 = 0 THEN 'positive' ELSE 'correction' END AS feedback_type,
         CASE WHEN turn % 4 = 0 THEN 'recorded' WHEN (conv_id + turn) % 5 < 3 THEN 'incorporated'
              WHEN (conv_id + turn) % 5 = 3 THEN 'rejected' ELSE 'pending' END AS state,
         'U' || (conv_id % 7) AS user_id, conv_id || '.' || turn AS message_ts,
         CAST(DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS DATE) AS created_on
  FROM conversations WHERE role = 'user')
"""

SHARED = {
    "home": HOME,
    "users_data": USERS_DATA,
    "people": PEOPLE,
    "store_product": STORE_PRODUCT,
    "guidelines": GUIDELINES,
    "feedback": FEEDBACK,
}

EVENTS = SHARED | {
    "ev": """
SELECT ts, CAST(ts AS DATE) AS dt, user_id, event_type AS kind,
       CAST(value AS DECIMAL(18,2)) AS value,
       CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
FROM events""",
    "first_days": "SELECT user_id, min(dt) AS first_dt FROM ev GROUP BY user_id",
    "activity": """
SELECT e.dt, e.user_id, any_value(h.country_code) AS country_code,
       date_diff('day', any_value(f.first_dt), e.dt) AS day_index,
       sum(value) FILTER (WHERE kind = 'purchase') AS can,
       sum(value) FILTER (WHERE kind = 'signup') AS sub,
       count(*) FILTER (WHERE kind = 'click') AS clicks,
       count(*) FILTER (WHERE kind = 'view') AS views
FROM ev e JOIN first_days f ON f.user_id = e.user_id LEFT JOIN home h ON h.user_id = e.user_id
GROUP BY e.dt, e.user_id""",
    "dailyactives": """
SELECT dt, user_id AS userid, sum(value) FILTER (WHERE kind = 'click') AS bars_spent,
       sum(value) FILTER (WHERE kind = 'purchase') AS revenue
FROM ev GROUP BY ALL""",
    "sales": """
SELECT dt, user_id AS userid, k AS productid, value AS dollars, CAST(k AS BIGINT) AS bars,
       CASE k % 3 WHEN 0 THEN 'AUTHORIZED' WHEN 1 THEN 'COMPLETED' ELSE 'DECLINED' END AS status
FROM ev WHERE kind = 'purchase'""",
    "levels": """
SELECT dt, user_id AS userid, max(k // 7) AS level FROM ev WHERE kind = 'error' GROUP BY ALL""",
    "streams": """
SELECT dt, user_id, kind = 'view' AS is_video, value * 60 AS seconds
FROM ev WHERE kind IN ('view', 'click')""",
    "ads": "SELECT dt, sum(value) AS gross FROM ev WHERE kind = 'error' GROUP BY dt",
}

ORDERS = SHARED | {
    "ord": """
SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS user_id,
       CAST(o_orderdate AS DATE) AS dt, CAST(o_totalprice AS DECIMAL(18,2)) AS price
FROM orders""",
    "first_days": "SELECT user_id, min(dt) AS first_dt FROM ord GROUP BY user_id",
    "activity": """
SELECT o.dt, o.user_id, any_value(h.country_code) AS country_code,
       date_diff('day', any_value(f.first_dt), o.dt) AS day_index,
       sum(price) FILTER (WHERE priority IN ('1-URGENT', '2-HIGH')) AS can,
       sum(price) FILTER (WHERE priority NOT IN ('1-URGENT', '2-HIGH')) AS sub
FROM ord o JOIN first_days f ON f.user_id = o.user_id LEFT JOIN home h ON h.user_id = o.user_id
GROUP BY o.dt, o.user_id""",
    "dailyactives": """
SELECT dt, user_id AS userid, sum(price) FILTER (WHERE status = 'F') AS bars_spent,
       sum(price) FILTER (WHERE status = 'O') AS revenue
FROM ord GROUP BY ALL""",
    "sales": """
SELECT dt, user_id AS userid, l_partkey AS productid,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS dollars, CAST(l_quantity AS BIGINT) AS bars,
       CASE status WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'AUTHORIZED' ELSE 'PENDING' END AS status
FROM ord JOIN lineitem ON l_orderkey = o_orderkey""",
    "levels": """
SELECT dt, user_id AS userid, max(CAST(o_orderkey % 15 AS INTEGER)) AS level FROM ord GROUP BY ALL""",
}


def statement(relations: dict[str, str], ctes: dict[str, str], final: str) -> str:
    """``WITH`` clause of the relations the text mentions (in order), then ``ctes``."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name, body in relations.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                need(body)

    for body in [*ctes.values(), final]:
        need(body)
    ordered = _in_order(relations, wanted)
    parts = [f"{n} AS ({relations[n].strip()})" for n in ordered]
    parts += [f"{n} AS ({b.strip()})" for n, b in ctes.items()]
    return f"WITH {', '.join(parts)}\n{final.strip()}" if parts else final.strip()


def _in_order(relations: dict[str, str], wanted: set[str]) -> list[str]:
    done: list[str] = []

    def add(name: str) -> None:
        for other in relations:
            if other != name and other in wanted and other not in done:
                if re.search(rf"\b{other}\b", relations[name]):
                    add(other)
        if name not in done:
            done.append(name)

    for name in relations:
        if name in wanted:
            add(name)
    return done


def rnd(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5e0) / {scale} + 0e0)"


def rnd_ratio(num: str, den: str, digits: int) -> str:
    """A quotient of numbers of up to four decimals, rounded in whole ten-thousandths."""
    n, d = (f"CAST(CAST({x} AS DECIMAL(24,4)) * 10000 AS HUGEINT)" for x in (num, den))
    d = f"nullif({d}, 0)"
    return f"(CAST(sign({n}) * sign({d}) * ((2 * abs({n}) * {10**digits} + abs({d})) // (2 * abs({d}))) AS DOUBLE) / 1e{digits} + 0e0)"


def pct(value: str, base: str) -> str:
    return rnd_ratio(f"(CAST({value} AS DECIMAL(20,4)) - CAST({base} AS DECIMAL(20,4))) * 100", base, 2)


def days(first: str, last: str, name: str = "dt") -> str:
    return f"SELECT CAST(unnest(generate_series({first}, {last}, INTERVAL 1 DAY)) AS DATE) AS {name}"


def run_dates(first: str, last: str) -> str:
    return days(f"DATE '{first}'", f"DATE '{last}'", "run")
