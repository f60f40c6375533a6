"""The stand-in mappings of contrail.sources.standins, in DuckDB SQL.

Each oracle query is ``WITH <ctes> <body>``; the CTE text mirrors the
DataFrame code column by column (same literals, same operation order).
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

_CALLSIGN = ("(CASE user_id % 5 WHEN 0 THEN 'DLH' WHEN 1 THEN 'AAL' WHEN 2 THEN 'ANZ' WHEN 3 THEN 'XX' END)"
             " || lpad(CAST(user_id AS VARCHAR), 4, '0')")

FS = f"""
fs0 AS (
  SELECT ts AS time,
    lpad(CAST(user_id AS VARCHAR), 6, '0') AS icao24,
    {_CALLSIGN} AS callsign,
    CASE WHEN event_id % 17 <> 0 THEN CAST((event_id * 7919) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) END AS latitude,
    CASE WHEN event_id % 17 <> 0 THEN CAST((event_id * 104729) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) END AS longitude,
    CASE WHEN event_type <> 'purchase' THEN value * CAST(40 AS DOUBLE) END AS baro_altitude,
    CASE WHEN event_type <> 'purchase' THEN value * CAST(41 AS DOUBLE) END AS geo_altitude,
    value * CAST(3 AS DOUBLE) AS velocity,
    CAST((event_id * 31) % 360 AS DOUBLE) AS true_track,
    CASE event_type WHEN 'click' THEN CAST(5 AS DOUBLE) WHEN 'error' THEN CAST(-6 AS DOUBLE)
      WHEN 'view' THEN CAST(0.2 AS DOUBLE) WHEN 'purchase' THEN CAST(0 AS DOUBLE) END AS vertical_rate,
    event_type = 'purchase' AS on_ground,
    lpad(CAST(event_id % 7777 AS VARCHAR), 4, '0') AS squawk,
    CASE event_id % 6 WHEN 0 THEN 'A3' WHEN 1 THEN 'A7' WHEN 2 THEN 'B1' WHEN 3 THEN 'B2' WHEN 4 THEN 'B6' END AS category,
    ts AS ingested_at,
    event_id
  FROM events
),
fs AS (
  SELECT *,
    CASE WHEN on_ground = TRUE THEN 'GROUND'
         WHEN vertical_rate > CAST(2 AS DOUBLE) AND baro_altitude < CAST(10000 AS DOUBLE) THEN 'CLIMBING'
         WHEN vertical_rate < CAST(-2 AS DOUBLE) AND baro_altitude < CAST(10000 AS DOUBLE) THEN 'DESCENDING'
         ELSE 'CRUISE' END AS flight_phase
  FROM fs0
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


# --- SQL forms of the lenient parsers (contrail.functions.numeric) ----------
_DIGITS = r"\d(?:_?\d)*"
NUMBER_RE = rf"^[+-]?(?:(?:{_DIGITS})(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
SPECIAL_RE = r"^[+-]?(?:nan|inf|infinity)$"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_safe_number(x: str) -> str:
    s = sql_strip(x)
    return (f"(CASE WHEN regexp_matches({s}, '{NUMBER_RE}') OR regexp_matches(lower({s}), '{SPECIAL_RE}') "
            f"THEN TRY_CAST(replace({s}, '_', '') AS DOUBLE) END)")


def sql_finite(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"


_ICAO = "lpad(CAST(user_id AS VARCHAR), 6, '0')"

RAW = f"""
raw AS (
  SELECT event_id,
    CASE WHEN event_id % 101 = 0 THEN '  '
         WHEN event_id % 127 = 0 THEN chr(9) || upper({_ICAO}) || ' '
         ELSE ' ' || upper({_ICAO}) END AS hex,
    {_CALLSIGN} || '  ' AS flight,
    CASE WHEN event_id % 103 = 0 THEN 'x'
         WHEN event_id % 17 <> 0 THEN CAST((event_id * 7919) % 18000 - 9000 AS VARCHAR) || 'e-2' END AS lat,
    CASE WHEN event_id % 211 = 0 THEN 'NaN'
         WHEN event_id % 17 <> 0 THEN CAST((event_id * 104729) % 36000 - 18000 AS VARCHAR) || 'e-2' END AS lon,
    CASE WHEN event_type = 'purchase' THEN 'ground' WHEN event_id % 107 = 0 THEN 'n/a'
         WHEN event_type <> 'signup' THEN CAST(CAST(floor(value * CAST(100 AS DOUBLE)) AS BIGINT) AS VARCHAR) END AS alt_baro,
    CASE WHEN event_id % 109 = 0 THEN 'bad' WHEN event_id % 113 = 0 THEN '1_000'
         ELSE CAST(CAST(floor(value * CAST(110 AS DOUBLE)) AS BIGINT) AS VARCHAR) END AS alt_geom,
    CAST(event_id % 500 AS VARCHAR) AS gs,
    CASE event_type WHEN 'click' THEN '1000' WHEN 'error' THEN '-1200' WHEN 'view' THEN '40' WHEN 'purchase' THEN '0' END AS baro_rate,
    CAST(event_id % 360 AS VARCHAR) AS track,
    lpad(CAST(event_id % 7777 AS VARCHAR), 4, '0') AS squawk,
    CASE event_id % 6 WHEN 0 THEN 'A3' WHEN 1 THEN 'A7' WHEN 2 THEN 'B1' WHEN 3 THEN 'B2' WHEN 4 THEN 'B6' END AS category
  FROM events
),
parsed AS (
  SELECT event_id,
    NULLIF(lower({sql_strip('hex')}), '') AS icao24,
    NULLIF({sql_strip('flight')}, '') AS callsign,
    {sql_safe_number('lat')} AS lat_n,
    {sql_safe_number('lon')} AS lon_n,
    COALESCE(alt_baro = 'ground', FALSE) AS on_ground,
    alt_baro,
    {sql_safe_number('alt_baro')} AS alt_n,
    {sql_safe_number('alt_geom')} AS geo_n,
    {sql_safe_number('gs')} AS gs_n,
    {sql_safe_number('track')} AS track_n,
    {sql_safe_number('baro_rate')} AS rate_n,
    squawk, category
  FROM raw
),
norm AS (
  SELECT event_id, icao24, callsign,
    {sql_finite('lat_n')} AS latitude,
    {sql_finite('lon_n')} AS longitude,
    CASE WHEN NOT on_ground THEN {sql_finite('alt_n * CAST(0.3048 AS DOUBLE)')} END AS baro_altitude,
    {sql_finite('geo_n * CAST(0.3048 AS DOUBLE)')} AS geo_altitude,
    on_ground,
    {sql_finite('gs_n * CAST(0.514444 AS DOUBLE)')} AS velocity,
    {sql_finite('track_n')} AS true_track,
    {sql_finite('rate_n * CAST(0.00508 AS DOUBLE)')} AS vertical_rate,
    squawk, category,
    CASE WHEN icao24 IS NULL THEN 'missing_hex'
         WHEN lat_n IS NULL OR lon_n IS NULL THEN 'bad_position'
         WHEN alt_baro IS NOT NULL AND NOT on_ground AND alt_n IS NULL THEN 'bad_alt_baro' END AS reject_reason,
    lat_n, lon_n
  FROM parsed
)"""


def _rcs(u: str) -> str:
    return (f"(CASE {u} % 5 WHEN 0 THEN 'DLH' WHEN 1 THEN 'AAL' WHEN 2 THEN 'ANZ' WHEN 3 THEN 'XX' WHEN 4 THEN 'SWA' END)"
            f" || lpad(CAST({u} AS VARCHAR), 4, '0')")


CAND = f"""
ord AS (SELECT *, o_custkey // 10 AS u, lpad(CAST(o_custkey % 97 AS VARCHAR), 3, '0') AS ocode,
               lpad(CAST(o_orderkey % 89 AS VARCHAR), 3, '0') AS dcode
        FROM orders),
cand AS (
  SELECT {_rcs('u')} AS callsign,
    o_orderkey AS pos,
    CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND u % 3 <> 1) THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS actual_off,
    CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS actual_on,
    CASE WHEN o_orderkey % 11 = 0 THEN ''
         ELSE strftime({AS_OF_SQL} + to_minutes(CAST(o_orderkey % 300 - 100 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS estimated_on,
    CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 2 = 0
         THEN strftime({AS_OF_SQL} + to_minutes(CAST(o_orderkey % 240 - 60 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS scheduled_on,
    CASE o_orderstatus WHEN 'O' THEN 'Scheduled' WHEN 'P' THEN 'En Route / On Time' WHEN 'F' THEN 'Landed' END AS status,
    o_orderkey % 23 <> 0 AS has_origin,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'O' || substring(ocode, 2, 2) END AS o_code_iata,
    'K' || ocode AS o_code, 'City' || ocode AS o_city,
    CASE WHEN o_orderkey % 13 <> 0 THEN 'Airport ' || ocode END AS o_name,
    'D' || substring(dcode, 2, 2) AS d_code_iata, 'K' || dcode AS d_code,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'Town' || dcode END AS d_city, 'Field ' || dcode AS d_name,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST((o_orderkey % 7 - 3) * 600 AS INTEGER) END AS departure_delay,
    CAST((o_orderkey % 9 - 4) * 15 AS INTEGER) AS arrival_delay,
    CASE WHEN o_orderkey % 2 = 0 THEN 'A320' ELSE 'B738' END AS aircraft_type,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE substring({_rcs('u')}, 1, 2) || CAST(o_orderkey % 1000 AS VARCHAR) END AS ident_iata,
    {_rcs('u')} || '-' || CAST(o_orderkey AS VARCHAR) AS ident,
    CAST(o_orderkey % 3000 AS INTEGER) AS route_distance,
    'fa-' || CAST(o_orderkey AS VARCHAR) AS fa_flight_id
  FROM ord
),
pri AS (
  SELECT *, CASE WHEN NULLIF(actual_off, '') IS NOT NULL AND NULLIF(actual_on, '') IS NULL THEN 1
                 WHEN COALESCE(contains(status, 'En Route'), FALSE) THEN 2
                 WHEN NULLIF(actual_off, '') IS NOT NULL THEN 3 END AS priority
  FROM cand
),
best AS (
  SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY callsign ORDER BY priority,
              CASE WHEN priority = 3 THEN actual_off END DESC NULLS LAST, pos) AS rk
    FROM pri WHERE priority IS NOT NULL) WHERE rk = 1
),
routes AS (
  SELECT callsign,
    COALESCE(NULLIF(o_code_iata, ''), o_code, '') AS origin_iata_code, COALESCE(o_city, '') AS origin_municipality,
    COALESCE(o_name, '') AS origin_name,
    COALESCE(NULLIF(d_code_iata, ''), d_code, '') AS destination_iata_code, COALESCE(d_city, '') AS destination_municipality,
    COALESCE(d_name, '') AS destination_name,
    aircraft_type, COALESCE(NULLIF(ident_iata, ''), ident) AS flight_number, status,
    COALESCE(departure_delay, 0) AS departure_delay, COALESCE(arrival_delay, 0) AS arrival_delay,
    route_distance, estimated_on, actual_on, scheduled_on, fa_flight_id,
    {AS_OF_SQL} - to_hours(CAST((pos * 7) % 24 AS INTEGER)) - INTERVAL 30 MINUTE AS cached_at
  FROM best WHERE has_origin
),
valid_routes AS (SELECT * FROM routes WHERE cached_at > {AS_OF_SQL} - INTERVAL '12 hours')"""

SUBS = f"""
cust AS (SELECT c_custkey AS c, c_custkey // 10 AS u,
                'u' || CAST(c_custkey // 10 AS VARCHAR) || 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS em,
                {AS_OF_SQL} - to_hours(CAST(c_custkey % 30 AS INTEGER)) AS created
         FROM customer),
req AS (
  SELECT CASE WHEN c % 2 = 0 THEN upper(em) ELSE em END AS email, lpad(CAST(u AS VARCHAR), 6, '0') AS icao24,
         CASE WHEN c % 4 = 0 THEN '  ' ELSE {_rcs('u')} || ' ' END AS callsign,
         c % 7 = 0 AS notified, created AS created_at, c * 3 AS seq
  FROM cust
  UNION ALL
  SELECT CASE WHEN c % 2 = 0 THEN em ELSE upper(em) END, upper(lpad(CAST(u AS VARCHAR), 6, '0')),
         {_rcs('u')}, FALSE, created + INTERVAL 30 MINUTE, c * 3 + 1
  FROM cust WHERE c % 5 = 0
  UNION ALL
  SELECT replace(em, '@', '.'), lpad(CAST(u AS VARCHAR), 6, '0'), '', FALSE, created, c * 3 + 2
  FROM cust WHERE c % 13 = 0
),
subs AS (
  SELECT email, icao24, callsign, notified, created_at, expires_at FROM (
    SELECT email, lower(icao24) AS icao24, {sql_strip('callsign')} AS callsign, COALESCE(notified, FALSE) AS notified,
           created_at, created_at + INTERVAL 24 HOUR AS expires_at,
           ROW_NUMBER() OVER (PARTITION BY lower(icao24), lower(email) ORDER BY created_at DESC, seq DESC) AS rk
    FROM req WHERE contains(email, '@')) WHERE rk = 1
),
dels AS (
  SELECT DISTINCT lower(icao24) AS i, lower(email) AS e FROM (
    SELECT upper(lpad(CAST(u AS VARCHAR), 6, '0')) AS icao24,
           'U' || CAST(u AS VARCHAR) || 'C' || CAST(c AS VARCHAR) || '@EXAMPLE.COM' AS email FROM cust WHERE c % 9 = 0
    UNION ALL
    SELECT 'ffffff', 'U' || CAST(u AS VARCHAR) || 'C' || CAST(c AS VARCHAR) || '@EXAMPLE.COM' FROM cust WHERE c % 27 = 0)
),
kept AS (SELECT s.* FROM subs s WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE d.i = s.icao24 AND d.e = lower(s.email))),
active AS (SELECT * FROM kept WHERE expires_at > {AS_OF_SQL})"""


def sql_instant(x: str) -> str:
    return f"TRY_CAST(regexp_replace(NULLIF({x}, ''), '(Z|\\+00:00)$', '') AS TIMESTAMP)"


TRACKED = """
log AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'track' WHEN 'error' THEN 'untrack' ELSE 'look' END AS action,
               lpad(CAST(user_id AS VARCHAR), 6, '0') AS icao24
        FROM events),
rm AS (SELECT icao24, max(CASE WHEN action = 'untrack' THEN seq END) AS last_rm FROM log GROUP BY icao24),
tracked AS (SELECT l.icao24, min(l.seq) AS position FROM log l JOIN rm r ON l.icao24 = r.icao24
            WHERE l.action = 'track' AND (r.last_rm IS NULL OR l.seq > r.last_rm) GROUP BY l.icao24)"""

DIM = f"""
dim AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS icao24, 'N' || CAST(user_id AS VARCHAR) AS registration,
               CASE WHEN user_id % 3 = 0 THEN 'A320' WHEN user_id % 3 = 1 THEN 'B738' ELSE 'E190' END AS model,
               CASE user_id % 5 WHEN 0 THEN 'DLH' WHEN 1 THEN 'AAL' WHEN 2 THEN 'ANZ' WHEN 3 THEN 'XX' END AS airline,
               {AS_OF_SQL} AS updated_at
        FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0))"""

SEARCHES = f"""
searches AS (
  SELECT DISTINCT query FROM (
    SELECT CASE WHEN c_custkey % 10 = 0 THEN ' ' || lower({_CALLSIGN.replace('user_id', '(c_custkey // 10)')}) || ' '
                WHEN c_custkey % 10 = 1 THEN lpad(CAST(c_custkey // 10 AS VARCHAR), 6, '0')
                WHEN c_custkey % 10 = 2 THEN 'zz' || CAST(c_custkey AS VARCHAR)
                WHEN c_custkey % 10 = 3 THEN lower(substring({_CALLSIGN.replace('user_id', '(c_custkey // 10)')}, 1, 3))
                WHEN c_custkey % 10 = 4 THEN substring(lpad(CAST(c_custkey // 10 AS VARCHAR), 6, '0'), 1, 4)
                WHEN c_custkey % 10 = 5 THEN ' x'
                WHEN c_custkey % 10 = 6 THEN lower(substring({_CALLSIGN.replace('user_id', '(c_custkey // 10)')}, 1, 2)) || ' '
                ELSE {_CALLSIGN.replace('user_id', '(c_custkey // 10)')}
           END AS query
    FROM customer) WHERE query IS NOT NULL)"""

PTS_SEG = """
pts AS (SELECT icao24, time, event_id, latitude AS lat, longitude AS lon FROM fs
        WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
sg AS (SELECT icao24, time, event_id, LAG(lat) OVER w AS lat1, LAG(lon) OVER w AS lon1, lat AS lat2, lon AS lon2
       FROM pts WINDOW w AS (PARTITION BY icao24 ORDER BY time, event_id)),
seg AS (SELECT *, sqrt((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)) AS seg_len,
               fmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)),
                                  cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))))
                    + CAST(360 AS DOUBLE), CAST(360 AS DOUBLE)) AS bearing
        FROM sg WHERE lat1 IS NOT NULL),
cum AS (SELECT *, SUM(CAST(seg_len AS DECIMAL(24,12))) OVER (PARTITION BY icao24 ORDER BY time, event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_end FROM seg)"""
