"""The same results in SQL, for comparison on another engine."""

from __future__ import annotations

VALID = """valid AS (
  SELECT event_id, object_id, epoch_us("timestamp") AS ts, seq, action_id FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq ASC NULLS LAST) AS rn
    FROM sky_event WHERE event_id IS NOT NULL)
  WHERE rn = 1 AND object_id > 0 AND "timestamp" IS NOT NULL)"""

BLANK = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CELLS = rf"""raw AS (
  SELECT d.event_id, d.idx, d.key, d.data_type, p.data_type AS kind, int_value AS i, float_value AS f, boolean_value AS b, string_value AS s,
    regexp_replace(string_value, '^{BLANK}+|{BLANK}+$', '', 'g') AS t
  FROM sky_event_data d JOIN sky_property p ON p.id = d.key),
typed AS (
  SELECT event_id, idx, key, data_type, kind, i, f, b, s,
    CASE WHEN kind = 'Int' THEN coalesce(i, CASE WHEN isfinite(f) AND f = floor(f) AND f >= -9223372036854775808.0 AND f < 9223372036854775808.0 THEN f::BIGINT END,
      CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN TRY_CAST(t AS BIGINT) END) END AS v_int,
    CASE WHEN kind = 'Float' THEN coalesce(CASE WHEN isfinite(f) THEN f END, i::DOUBLE,
      CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE) END) END AS v_float,
    CASE WHEN kind = 'Boolean' THEN coalesce(b, CASE WHEN i IN (0, 1) THEN i = 1 END,
      CASE WHEN lower(t) IN ('true', 'yes', '1') THEN true WHEN lower(t) IN ('false', 'no', '0') THEN false END) END AS v_bool,
    CASE WHEN kind = 'String' THEN coalesce(s, i::VARCHAR, CASE WHEN b THEN 'true' WHEN NOT b THEN 'false' END) END AS v_str
  FROM raw),
graded AS (
  SELECT *, v_int IS NULL AND v_float IS NULL AND v_bool IS NULL AND v_str IS NULL AS bad,
    coalesce(data_type = kind, false) AND CASE kind WHEN 'Int' THEN i IS NOT NULL WHEN 'Float' THEN f IS NOT NULL WHEN 'Boolean' THEN b IS NOT NULL ELSE s IS NOT NULL END AS plain
  FROM typed),
cells AS (
  SELECT event_id, key, v_int, v_float, v_bool, v_str, CASE WHEN bad THEN 'rejected' WHEN plain THEN 'ok' ELSE 'repaired' END AS cell FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id, key ORDER BY bad, idx DESC NULLS LAST, plain DESC) AS rn FROM graded WHERE event_id IS NOT NULL)
  WHERE rn = 1)"""
UPDATES = f"""{VALID}, {CELLS},
updates AS (
  SELECT v.object_id, c.key, v.ts, v.seq, v.event_id, v_int, v_float, v_bool, v_str
  FROM cells c JOIN valid v USING (event_id) WHERE c.key > 0 AND c.cell <> 'rejected')"""

HISTORY = f"""WITH {UPDATES},
steps AS (
  SELECT *, lag(event_id) OVER w IS NULL AS first,
    lag(v_int) OVER w IS DISTINCT FROM v_int OR lag(v_float) OVER w IS DISTINCT FROM v_float OR lag(v_bool) OVER w IS DISTINCT FROM v_bool OR lag(v_str) OVER w IS DISTINCT FROM v_str AS differs
  FROM updates WINDOW w AS (PARTITION BY object_id, key ORDER BY ts, seq DESC NULLS LAST, event_id)),
versions AS (
  SELECT object_id, key, event_id AS start_event_id, v_int, v_float, v_bool, v_str, CASE WHEN first THEN 'inserted' ELSE 'changed' END AS change, ts AS valid_from,
    lead(ts) OVER (PARTITION BY object_id, key ORDER BY ts, seq DESC NULLS LAST, event_id) AS valid_to
  FROM steps WHERE first OR differs)"""

SESSIONS = f"""WITH {VALID},
marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= 1800000000 THEN 0 ELSE 1 END AS begins
  FROM valid WINDOW w AS (PARTITION BY object_id ORDER BY ts, seq DESC NULLS LAST, event_id)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY object_id ORDER BY ts, seq DESC NULLS LAST, event_id ROWS UNBOUNDED PRECEDING) AS no FROM marked),
sessions AS (
  SELECT object_id, first(event_id ORDER BY ts, seq DESC NULLS LAST, event_id) AS start_event_id, last(event_id ORDER BY ts, seq DESC NULLS LAST, event_id) AS end_event_id,
    min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration_us, count(*) AS n_events
  FROM numbered GROUP BY object_id, no)"""

FEATURES = f"""WITH {VALID},
features AS (
  SELECT object_id, action_id, count(*) AS n, max(ts) AS last_ts, last(event_id ORDER BY ts, seq DESC NULLS LAST, event_id) AS last_event_id
  FROM valid WHERE action_id > 0 GROUP BY object_id, action_id)"""

SNAPSHOTS = f"""WITH {UPDATES},
daily AS (
  SELECT object_id, key, day, v_int, v_float, v_bool, v_str FROM (
    SELECT *, date_diff('day', DATE '1970-01-01', make_timestamp(ts)::DATE) AS day, row_number() OVER (PARTITION BY object_id, key, make_timestamp(ts)::DATE ORDER BY ts DESC, seq ASC NULLS FIRST, event_id DESC) AS rn
    FROM updates)
  WHERE rn = 1),
spans AS (SELECT *, least(day + 6, coalesce(lead(day) OVER (PARTITION BY object_id, key ORDER BY day) - 1, day + 6)) AS until FROM daily),
snapshots AS (SELECT object_id, key, unnest(generate_series(day, until)) AS day, v_int, v_float, v_bool, v_str FROM spans),
compared AS (
  SELECT *, lag(day) OVER w IS DISTINCT FROM day - 1 OR lag(v_int) OVER w IS DISTINCT FROM v_int OR lag(v_float) OVER w IS DISTINCT FROM v_float
    OR lag(v_bool) OVER w IS DISTINCT FROM v_bool OR lag(v_str) OVER w IS DISTINCT FROM v_str AS begins
  FROM snapshots WINDOW w AS (PARTITION BY object_id, key ORDER BY day)),
versions AS (SELECT *, sum(begins::INT) OVER (PARTITION BY object_id, key ORDER BY day ROWS UNBOUNDED PRECEDING) AS no FROM compared)
SELECT object_id, key, any_value(v_int) AS v_int, any_value(v_float) AS v_float, any_value(v_bool) AS v_bool, any_value(v_str) AS v_str, min(day) AS valid_from,
  CASE WHEN max(day) < (SELECT max(day) FROM snapshots) THEN max(day) + 1 END AS valid_to
FROM versions GROUP BY object_id, key, no"""

#: The registered properties of the test tables, object properties from 1 up, action properties from -1 down.
OBJECT_PROPERTIES = """String plan, String country, Int level, Float balance, Boolean subscribed, String theme, Int credits, Float score, Boolean verified,
String segment, Int seats, Float discount, Boolean beta_tester, String channel"""
ACTION_PROPERTIES = """Float amount, Int quantity, String referrer, String order_code, Int latency_ms, Boolean success, String query, Int position, Float ratio,
Boolean first_time, Int error_code, String browser, Float weight_kg, Int attempt, String campaign, Boolean cached, Int bytes_sent, Float temperature,
String note, Int depth, Boolean muted, String screen"""


def _wide() -> str:
    columns = []
    for sign, letter, listed in ((1, "o", OBJECT_PROPERTIES), (-1, "a", ACTION_PROPERTIES)):
        for i, (kind, name) in enumerate((p.split() for p in listed.split(",")), 1):
            value = {"Int": "v_int", "Float": "v_float", "Boolean": "v_bool", "String": "v_str"}[kind]
            columns.append(f"max({value}) FILTER (key = {sign * i}) AS {letter}{i}_{name}, max(cell) FILTER (key = {sign * i}) AS {letter}{i}_{name}__cell")
    return f"WITH {CELLS} SELECT event_id, {', '.join(columns)} FROM cells GROUP BY event_id"


def _feature_columns(action_ids: range) -> str:
    columns = [f"coalesce(max(n) FILTER (action_id = {a}), 0) AS n_{a}, max(age) FILTER (action_id = {a}) AS age_{a}, coalesce(max(share) FILTER (action_id = {a}), 0) AS share_{a}" for a in action_ids]
    return f"""{FEATURES}, parts AS (SELECT *, n::DOUBLE / sum(n) OVER o AS share, max(last_ts) OVER o - last_ts AS age FROM features WINDOW o AS (PARTITION BY object_id))
SELECT object_id, sum(n)::BIGINT AS n_actions, max(last_ts) AS last_ts, {', '.join(columns)} FROM parts GROUP BY object_id"""


SQL: dict[str, str] = {
    "p1_found": f"""WITH {UPDATES},
bought AS (SELECT v.* FROM valid v WHERE action_id IN (SELECT id FROM sky_action WHERE name = 'purchase')),
known AS (
  SELECT b.event_id, u.key, u.event_id AS source_event_id, row_number() OVER (PARTITION BY b.event_id, u.key ORDER BY u.event_id = b.event_id DESC, u.ts DESC, u.seq) AS rn
  FROM bought b JOIN updates u ON u.object_id = b.object_id AND (u.event_id = b.event_id OR u.ts < b.ts AND u.seq < b.seq))
SELECT event_id, key, source_event_id FROM known WHERE rn = 1""",
    "p3_found": f"WITH {CELLS} SELECT event_id, key, cell FROM cells WHERE cell <> 'ok'",
    "p3_wide": _wide(),
    "p5_snapshots": SNAPSHOTS,
    "p5_found": f"{HISTORY} SELECT object_id, key, start_event_id FROM versions",
    "p5_history": f"{HISTORY} SELECT * FROM versions",
    "p6_found": f"{SESSIONS} SELECT object_id, start_event_id, end_event_id FROM sessions",
    "p6_sessions": f"{SESSIONS} SELECT * FROM sessions",
    "p7_found": f"{FEATURES} SELECT object_id, action_id, last_event_id FROM features",
    "p7_features": f"{FEATURES} SELECT * FROM features",
    "p7_maintained": f"{FEATURES} SELECT * FROM features",
    "p7_wide": _feature_columns(range(1, 256)),
    "p7_rows": f"{FEATURES} SELECT object_id, sum(n)::BIGINT AS n_actions, count(*) AS n_kinds, max(last_ts) AS last_ts FROM features GROUP BY object_id",
    "p7_shares": f"""{FEATURES} SELECT object_id, action_id, n, n::DOUBLE / sum(n) OVER (PARTITION BY object_id) AS share,
  max(last_ts) OVER (PARTITION BY object_id) - last_ts AS age_us FROM features""",
}
