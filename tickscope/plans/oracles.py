"""The same answers in plain SQL, for comparing with the Spark results."""

from __future__ import annotations

LONG_WINDOW = "900 seconds"
DAY_PART = "43200 seconds"

BY_TYPE = """
trades AS (
  SELECT event_type AS symbol, event_id AS arrival, ts, value AS price,
         CAST(props->>'$.k' AS DOUBLE) AS size
  FROM events)"""

BY_USER = """
trades AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, event_id AS arrival, ts, value AS price,
         CAST(props->>'$.k' AS DOUBLE) AS size
  FROM events)"""

RETURNS = """
returns AS (
  SELECT *, CASE WHEN price > 0 AND prev > 0 THEN ln(price / prev) END AS ret
  FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY arrival) AS prev FROM trades))"""


def _windows(length: str, prefix: str = "") -> str:
    """CTEs from ``trades`` to ``windows`` (trades are in time order per symbol)."""
    p = prefix
    return f"""
{p}nexts AS (
  SELECT symbol, ts, min(ts) OVER (PARTITION BY symbol ORDER BY ts
    RANGE BETWEEN INTERVAL '{length}' FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM {p}trades),
{p}chain AS (
  SELECT symbol, CAST(0 AS BIGINT) AS window_index, min(ts) AS s FROM {p}trades GROUP BY symbol
  UNION ALL
  SELECT c.symbol, c.window_index + 1, n.nxt FROM {p}chain c
  JOIN {p}nexts n ON n.symbol = c.symbol AND n.ts = c.s WHERE n.nxt IS NOT NULL),
{p}bounds AS MATERIALIZED (
  SELECT symbol, window_index, s,
         lead(s) OVER (PARTITION BY symbol ORDER BY window_index) AS e FROM {p}chain),
{p}returns AS (
  SELECT *, CASE WHEN price > 0 AND prev > 0 THEN ln(price / prev) END AS ret
  FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY arrival) AS prev FROM {p}trades)),
{p}windows AS MATERIALIZED (
  SELECT b.symbol, b.window_index, b.s, b.e, count(*) AS trade_count, sum(r.size) AS volume,
         CASE WHEN count(r.ret) >= 2 THEN stddev_samp(r.ret) END AS realized_volatility
  FROM {p}bounds b JOIN {p}returns r
    ON r.symbol = b.symbol AND r.ts >= b.s AND r.ts < b.e
  WHERE b.e IS NOT NULL GROUP BY ALL)"""


LONG = f"WITH RECURSIVE {BY_TYPE}, {_windows(LONG_WINDOW)}"
USERS = f"WITH RECURSIVE {BY_USER}, {_windows(DAY_PART)}"

SUMMARY = """
SELECT symbol, window_index, epoch_us(s) AS start_us, epoch_us(e) AS end_us, trade_count,
       round(volume, 6) AS volume, round(realized_volatility, 6) AS realized_volatility
FROM windows"""


def _scored(source: str, order: str, threshold: float) -> str:
    return f"""
base AS (
  SELECT *, count(volume) OVER w AS n, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS sd,
         row_number() OVER (PARTITION BY symbol ORDER BY {order}) - 1 AS i
  FROM {source}
  WINDOW w AS (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
scored AS (
  SELECT * EXCLUDE (n, m, sd), CASE WHEN ok THEN m END AS score_mean, CASE WHEN ok THEN sd END AS score_std,
         CASE WHEN ok THEN (volume - m) / sd END AS anomaly_score,
         coalesce(ok AND (volume - m) / sd > {threshold}, FALSE) AS is_volume_anomaly
  FROM (SELECT *, i >= 30 AND n >= 5 AND sd > 0 AS ok FROM base))"""


ISO = "replace(strftime({}, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || '+00:00'"


def _iso(column: str) -> str:
    return ISO.format(column)


MESSAGES = f"""
messages AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS symbol, CAST(user_id % 6 AS INTEGER) AS "partition",
    ts, value, CAST(props->>'$.k' AS DOUBLE) AS size, props, event_type, event_id % 10 AS broken,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'trade'
         WHEN event_type IN ('view', 'signup') THEN 'quote'
         WHEN event_id % 10 IN (7, 9) THEN 'trade' END AS type,
    CASE WHEN event_type <> 'error' OR event_id % 10 IN (7, 9) THEN NULL
         WHEN event_id % 10 = 0 THEN 'not valid utf-8: undecodable bytes'
         WHEN event_id % 10 IN (1, 6) THEN 'not valid json: malformed text'
         WHEN event_id % 10 = 2 THEN 'expected a JSON object, got list'
         WHEN event_id % 10 = 3 THEN 'unknown tick type: ''bar'''
         WHEN event_id % 10 = 4 THEN 'missing required field(s): [''price'']'
         WHEN event_id % 10 = 8 THEN 'invalid timestamp: 5'
         ELSE 'invalid timestamp: ''not-a-timestamp''' END AS error
  FROM events)"""

# The broken payloads, byte for byte. Numbers are spelled as JSON spells doubles.
NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({0} AS VARCHAR) END"
_HEAD = """'{{"symbol":"' || symbol || '","timestamp":"' || {ts} || '","conditions":["@"],"tape":"C","type":"{kind}",'"""
_TAIL = f"""'"size":' || {NUM.format('size')} || ',"exchange":"V","trade_id":' || event_id || '}}'"""
_PRICE = f"""'"price":' || {NUM.format('value')} || ','"""
BYTES = f"""
bad AS (
  SELECT *, CASE broken
    WHEN 0 THEN '\\xFF\\xFE'::BLOB || encode(props)
    WHEN 1 THEN encode('{{not json ' || props)
    WHEN 2 THEN encode('[' || props || ']')
    WHEN 3 THEN encode({_HEAD.format(ts=_iso('ts'), kind='bar')} || {_PRICE} || {_TAIL})
    WHEN 4 THEN encode({_HEAD.format(ts=_iso('ts'), kind='trade')} || {_TAIL})
    WHEN 6 THEN encode({_HEAD.format(ts=_iso('ts'), kind='trade')} || {_PRICE} || {_TAIL} || ' and more')
    WHEN 8 THEN encode(replace({_HEAD.format(ts="'?'", kind='trade')}, '"?"', '5') || {_PRICE} || {_TAIL})
    ELSE encode({_HEAD.format(ts="'not-a-timestamp'", kind='trade')} || {_PRICE} || {_TAIL})
  END AS raw,
  'market-ticks[' || "partition" || ']@' || event_id AS location
  FROM messages WHERE error IS NOT NULL)"""


def _regimes(prefix: str = "") -> str:
    """CTEs from ``windows`` to ``regimes``: every window's changepoint odds and flag.

    One row per symbol and step; ``runs`` lists the surviving run lengths, each with its
    log probability and its Normal-Gamma mean and beta (kappa = 1 + r, alpha = 1 + r / 2).
    """
    p = prefix
    return f"""
{p}levels AS MATERIALIZED (
  SELECT symbol, window_index, row_number() OVER (PARTITION BY symbol ORDER BY window_index) AS i,
         ln(realized_volatility + 1e-8) AS x
  FROM {p}windows WHERE realized_volatility IS NOT NULL),
{p}fold AS (
  SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS i,
    [{{'r': CAST(0 AS BIGINT), 'lp': CAST(0 AS DOUBLE), 'm': CAST(0 AS DOUBLE), 'b': CAST(1 AS DOUBLE)}}] AS runs
  FROM {p}levels
  UNION ALL
  SELECT symbol, i, list_filter(
    list_prepend(
      {{'r': CAST(0 AS BIGINT), 'lp': ln(CAST(0.01 AS DOUBLE)), 'm': CAST(0 AS DOUBLE), 'b': CAST(1 AS DOUBLE)}},
      list_transform(seen, lambda s: {{'r': s.r + 1, 'lp': s.lp - top - ln(total) + ln(CAST(0.99 AS DOUBLE)),
        'm': s.m + (x - s.m) / (s.r + 2), 'b': s.b + (s.r + 1) * (x - s.m) ** 2 / (2 * (s.r + 2))}})),
    lambda s, k: k <= 2 OR s.lp >= ln(CAST(1e-4 AS DOUBLE))) AS runs
  FROM (
    SELECT *, list_sum(list_transform(seen, lambda s: exp(s.lp - top))) AS total
    FROM (
      SELECT *, list_max(list_transform(seen, lambda s: s.lp)) AS top
      FROM (
        SELECT f.symbol, l.i, l.x, list_transform(f.runs, lambda s: {{'r': s.r, 'm': s.m, 'b': s.b,
          'lp': s.lp + lgamma(1.5 + s.r / 2) - lgamma(1 + s.r / 2)
            - ln(2 * pi() * s.b * (s.r + 2) / (s.r + 1)) / 2
            - (1.5 + s.r / 2) * ln(1 + (s.r + 1) * (l.x - s.m) ** 2 / (2 * s.b * (s.r + 2)))}}) AS seen
        FROM {p}fold f JOIN {p}levels l ON l.symbol = f.symbol AND l.i = f.i + 1)))),
{p}regimes AS MATERIALIZED (
  SELECT w.*, odds AS changepoint_probability,
         coalesce(f.i > 4 AND odds >= 0.5, FALSE) AS is_regime_change
  FROM {p}windows w
  LEFT JOIN {p}levels l ON l.symbol = w.symbol AND l.window_index = w.window_index
  LEFT JOIN (
    SELECT symbol, i, exp(runs[1].lp) + exp(runs[2].lp) AS odds FROM {p}fold) f
    ON f.symbol = l.symbol AND f.i = l.i)"""


def _kinds() -> str:
    """``kinds``: low-threshold volume events of the long series, regime changes of the users."""
    users = BY_USER.replace("trades AS", "u_trades AS")
    return (
        f"WITH RECURSIVE {BY_TYPE}, {_windows(LONG_WINDOW)}, {users}, {_windows(DAY_PART, 'u_')}, "
        + _scored("windows", "window_index", 2.0)
        + f""", {_regimes("u_")},
kinds AS MATERIALIZED (
  SELECT 'volume_anomaly' AS anomaly_type, symbol, s, e, volume, trade_count, anomaly_score,
         CAST(NULL AS DOUBLE) AS realized_volatility, CAST(NULL AS DOUBLE) AS changepoint_probability
  FROM scored WHERE is_volume_anomaly
  UNION ALL
  SELECT 'regime_change', symbol, s, e, NULL, NULL, NULL, realized_volatility, changepoint_probability
  FROM u_regimes WHERE is_regime_change)"""
    )


def _anomalies() -> str:
    return _kinds() + """,
anomalies AS MATERIALIZED (
  SELECT symbol AS ticker, s AS window_start, anomaly_type, e, volume, realized_volatility,
         anomaly_score, changepoint_probability, s + INTERVAL '1 hour' AS detected_at
  FROM kinds)"""


LISTED = """
SELECT ticker, epoch_us(window_start) AS start_us, anomaly_type, epoch_us(detected_at) AS detected_us
FROM anomalies"""

MARKS = """
marks AS (
  SELECT l_returnflag AS topic, CAST(l_suppkey % 6 AS INTEGER) AS "partition",
         min(l_orderkey) AS low, max(l_orderkey) AS high
  FROM lineitem GROUP BY ALL),
subs AS (SELECT * FROM (VALUES ('tick-readers', 'A'), ('tick-readers', 'absent'),
  ('anomaly-writers', 'N'), ('anomaly-writers', 'R')) AS t(group_id, topic)),
starts AS (
  SELECT group_id, m.topic, m."partition", low, high,
    CASE WHEN m."partition" % 2 = 0 THEN CAST(floor((low + high) / 2) AS BIGINT) ELSE low END AS "offset"
  FROM subs JOIN marks m ON m.topic = subs.topic),
lags AS (
  SELECT s.group_id, CAST(coalesce(sum(greatest(high - "offset", 0)), 0) AS BIGINT) AS lag
  FROM (SELECT DISTINCT group_id FROM subs) s LEFT JOIN starts USING (group_id) GROUP BY ALL)"""

DENSE = """
panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker,
         avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY ALL)"""
SPARSE = """
panel AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker,
         avg(o_totalprice) AS close, sum(o_totalprice) AS volume
  FROM orders GROUP BY ALL)"""
SCORES = """
rets AS (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS ret FROM panel),
wide AS (
  SELECT date, ticker,
    lag(close, 21) OVER d / lag(close, 252) OVER d - 1 AS momentum,
    CASE WHEN count(ret) OVER f >= 20 THEN stddev_samp(ret) OVER f END AS volatility,
    CASE WHEN count(close) OVER f >= 20
      THEN -(close - avg(close) OVER f) / nullif(stddev_samp(close) OVER f, 0) END AS mean_reversion
  FROM rets
  WINDOW d AS (PARTITION BY ticker ORDER BY date),
         f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
scores AS (
  SELECT date, ticker, 'momentum' AS factor, momentum AS score FROM wide WHERE momentum IS NOT NULL
  UNION ALL SELECT date, ticker, 'volatility', volatility FROM wide WHERE volatility IS NOT NULL
  UNION ALL SELECT date, ticker, 'mean_reversion', mean_reversion FROM wide WHERE mean_reversion IS NOT NULL)"""
# Here the date-by-ticker grid is filled in, the way the definition is worded.
MOVES = """
grid AS (
  SELECT d.factor, d.date, t.ticker, s.score
  FROM (SELECT DISTINCT factor, date FROM scores) d
  JOIN (SELECT DISTINCT factor, ticker FROM scores) t USING (factor)
  LEFT JOIN scores s ON s.factor = d.factor AND s.date = d.date AND s.ticker = t.ticker),
deltas AS (
  SELECT *, score - lag(score) OVER (PARTITION BY factor, ticker ORDER BY date) AS delta FROM grid),
moves AS (
  SELECT * FROM (
    SELECT date, ticker, factor, CASE WHEN count(delta) OVER f >= 20
      THEN (delta - avg(delta) OVER f) / nullif(stddev_samp(delta) OVER f, 0) END AS z
    FROM deltas
    WINDOW f AS (PARTITION BY factor, ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
  WHERE z IS NOT NULL)"""
MOVE_ROWS = "SELECT CAST(date AS VARCHAR) AS date, ticker, factor, round(z, 6) AS z FROM moves"

CROSSED = f"""WITH {SPARSE}, {SCORES}, {MOVES},
days AS (SELECT ticker AS symbol, date, volume FROM panel),
{_scored("days", "date", 2.0)},
flagged AS (SELECT symbol AS ticker, date FROM scored WHERE is_volume_anomaly),
crossed AS (
  SELECT f.ticker, f.date AS anomaly_date, count(m.z) AS n,
    string_agg(m.factor || '|' || CAST(m.date AS VARCHAR) || '|' || CAST(CAST(round(m.z, 4) AS DECIMAL(20,4)) AS VARCHAR), ';'
      ORDER BY CASE m.factor WHEN 'momentum' THEN 1 WHEN 'volatility' THEN 2 ELSE 3 END, m.date) AS matches
  FROM flagged f LEFT JOIN moves m
    ON m.ticker = f.ticker AND abs(m.z) >= 2.0 AND m.date BETWEEN f.date - 1 AND f.date + 1
  GROUP BY ALL)"""


def _sweep() -> str:
    cells = []
    for n in (10, 20, 30, 50):
        for t in (3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0):
            cells.append(f"""
SELECT {n} AS lookback, CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (is_spike) AS spikes,
  count(*) FILTER (is_spike AND best{n} > {t}) AS spikes_found,
  count(*) FILTER (is_spike AND best{n} > {t}) / count(*) FILTER (is_spike) AS recall,
  count(*) FILTER (NOT near AND z{n} > {t}) AS false_positives,
  count(*) FILTER (NOT near AND z{n} > {t}) / count(*) FILTER (NOT near) * 500 AS false_per_500
FROM near""")
    zs = ", ".join(
        f"CASE WHEN window_index >= 30 AND count(volume) OVER w{n} >= 5 AND stddev_pop(volume) OVER w{n} > 0 "
        f"THEN (volume - avg(volume) OVER w{n}) / stddev_pop(volume) OVER w{n} END AS z{n}"
        for n in (10, 20, 30, 50)
    )
    frames = ", ".join(
        f"w{n} AS (PARTITION BY symbol ORDER BY window_index ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        for n in (10, 20, 30, 50)
    )
    best = ", ".join(f"max(z{n}) OVER a AS best{n}" for n in (10, 20, 30, 50))
    return f"""{LONG},
planted AS (
  SELECT symbol, window_index, window_index % 97 = 60 AS is_spike,
         CASE WHEN window_index % 97 = 60 THEN volume * 10 ELSE volume END AS volume FROM windows),
zs AS (SELECT *, {zs} FROM planted WINDOW {frames}),
near AS (
  SELECT *, max(CAST(is_spike AS INTEGER)) OVER a > 0 AS near, {best} FROM zs
  WINDOW a AS (PARTITION BY symbol ORDER BY window_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
{" UNION ALL ".join(cells)}"""


ORACLES: dict[str, str] = {
    "tick_validation": f"""WITH {MESSAGES}
SELECT event_id, error, CASE WHEN error IS NULL THEN type END AS type,
  CASE WHEN error IS NULL THEN symbol END AS symbol,
  CASE WHEN error IS NULL THEN epoch_us(ts) END AS ts_us,
  CASE WHEN type = 'trade' THEN value END AS price,
  CASE WHEN type = 'quote' THEN value END AS bid_price
FROM messages""",
    "valid_and_rejected_counts": f"""WITH {MESSAGES}
SELECT CASE WHEN error IS NULL THEN 'valid' ELSE 'rejected' END AS branch, "partition", count(*) AS n
FROM messages GROUP BY ALL""",
    "dead_letter_envelopes": f"""WITH {MESSAGES}, {BYTES}
SELECT 'market-ticks' AS original_topic, "partition" AS original_partition, event_id AS original_offset,
  symbol AS original_key, base64(raw) AS raw_value_b64, 'TickValidationError: ' || error AS error
FROM bad""",
    "dead_letter_inspect": f"""WITH {MESSAGES}, {BYTES}
SELECT location, symbol AS key, 'TickValidationError: ' || error AS error, hex(raw) AS raw_hex
FROM bad ORDER BY "partition", event_id LIMIT 20""",
    "dead_letter_replay": f"""WITH {MESSAGES}, {BYTES}
SELECT 'market-ticks' AS topic, symbol AS key, hex(raw) AS value_hex, location FROM bad""",
    "valid_trades": f"""WITH {MESSAGES}
SELECT symbol, event_id AS arrival, epoch_us(ts) AS ts_us, value AS price, size, event_id AS trade_id
FROM messages WHERE type = 'trade'""",
    "tick_messages": f"""WITH {MESSAGES}
SELECT event_id, 'market-ticks' AS topic, symbol AS key, type, symbol, {_iso('ts')} AS "timestamp",
  CASE WHEN type = 'trade' THEN value END AS price, CASE WHEN type = 'trade' THEN size END AS size,
  CASE WHEN type = 'trade' THEN event_id END AS trade_id,
  CASE WHEN type = 'quote' THEN value END AS bid_price,
  CASE WHEN type = 'quote' THEN value + 0.5 END AS ask_price,
  CASE WHEN type = 'quote' THEN size END AS ask_size, 'C' AS tape
FROM messages WHERE error IS NULL""",
    "log_returns": f"""WITH {BY_TYPE}, {RETURNS}
SELECT symbol, arrival, prev AS previous_price, round(ret, 6) AS log_return FROM returns""",
    "anchored_windows": LONG + SUMMARY,
    "anchored_windows_many_symbols": USERS + SUMMARY,
    "anchored_windows_split": LONG + SUMMARY,
    "log_volatility": LONG + """
SELECT symbol, window_index, round(ln(realized_volatility + 1e-8), 6) AS log_volatility
FROM windows WHERE realized_volatility IS NOT NULL""",
    "volume_scores": f"""{LONG}, {_scored("windows", "window_index", 4.5)}
SELECT symbol, window_index, epoch_us(s) AS start_us, round(volume, 6) AS volume,
  round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std,
  round(anomaly_score, 6) AS anomaly_score, is_volume_anomaly FROM scored""",
    "volume_anomalies": f"""{LONG}, {_scored("windows", "window_index", 4.5)}
SELECT symbol, epoch_us(s) AS start_us, epoch_us(e) AS end_us, round(volume, 6) AS volume, trade_count,
  round(anomaly_score, 6) AS anomaly_score, round(score_mean, 6) AS score_mean,
  round(score_std, 6) AS score_std FROM scored WHERE is_volume_anomaly""",
    "volume_anomalies_low_threshold": f"""{LONG}, {_scored("windows", "window_index", 2.0)}
SELECT symbol, epoch_us(s) AS start_us, round(anomaly_score, 6) AS anomaly_score
FROM scored WHERE is_volume_anomaly""",
    "regime_scores": f"""{LONG}, {_regimes()}
SELECT symbol, window_index, round(realized_volatility, 6) AS realized_volatility,
  round(changepoint_probability, 6) AS changepoint_probability, is_regime_change
FROM regimes WHERE realized_volatility IS NOT NULL""",
    "regime_changes": f"""{USERS}, {_regimes()}
SELECT symbol, epoch_us(s) AS start_us, epoch_us(e) AS end_us,
  round(realized_volatility, 6) AS realized_volatility,
  round(changepoint_probability, 6) AS changepoint_probability
FROM regimes WHERE is_regime_change""",
    "anomaly_events": f"""{LONG}, {_regimes()}, {_scored("regimes", "window_index", 2.0)}
SELECT symbol, epoch_us(s) AS start_us, 'volume_anomaly' AS anomaly_type, CAST(0 AS INTEGER) AS event_order,
  round(anomaly_score, 6) AS anomaly_score, round(changepoint_probability, 6) AS changepoint_probability
FROM scored WHERE is_volume_anomaly
UNION ALL
SELECT symbol, epoch_us(s), 'regime_change', 1, round(anomaly_score, 6), round(changepoint_probability, 6)
FROM scored WHERE is_regime_change""",
    "anomaly_union": _kinds() + """
SELECT anomaly_type, symbol, epoch_us(s) AS start_us, round(volume, 6) AS volume,
  round(realized_volatility, 6) AS realized_volatility,
  round(changepoint_probability, 6) AS changepoint_probability FROM kinds""",
    "anomaly_payloads": _kinds() + f"""
SELECT CASE anomaly_type WHEN 'volume_anomaly' THEN 'volume-anomalies' ELSE 'regime-changes' END AS topic,
  symbol AS key, {_iso('s')} AS window_start, {_iso('e')} AS window_end, round(volume, 6) AS volume,
  round(anomaly_score, 6) AS anomaly_score, round(realized_volatility, 6) AS realized_volatility,
  round(changepoint_probability, 6) AS changepoint_probability FROM kinds""",
    "anomaly_event_parsing": _kinds() + """
SELECT CASE anomaly_type WHEN 'volume_anomaly' THEN 'volume-anomalies' ELSE 'regime-changes' END AS topic,
  anomaly_type, symbol, epoch_us(s) AS start_us,
  CASE anomaly_type WHEN 'volume_anomaly' THEN 8 ELSE 5 END AS n_fields FROM kinds""",
    "anomaly_upsert": _anomalies() + f"""
SELECT ticker, epoch_us(window_start) AS start_us, anomaly_type, {_iso('e')} AS window_end,
  round(volume, 6) AS volume, round(realized_volatility, 6) AS realized_volatility,
  round(anomaly_score, 6) AS anomaly_score, round(changepoint_probability, 6) AS changepoint_probability,
  epoch_us(detected_at) AS detected_us FROM anomalies""",
    "newest_anomalies": _anomalies() + LISTED + """
ORDER BY detected_at DESC, ticker, window_start, anomaly_type LIMIT 50""",
    "newest_anomalies_filtered": _anomalies() + LISTED + """
WHERE ticker = 'click' AND anomaly_type = 'volume_anomaly'
ORDER BY detected_at DESC, ticker, window_start, anomaly_type LIMIT 20""",
    "anomalies_in_time_order": _anomalies() + """
SELECT ticker, epoch_us(window_start) AS start_us, anomaly_type,
  CAST(CAST(window_start AS DATE) AS VARCHAR) AS date FROM anomalies ORDER BY window_start""",
    "anomaly_counts": _anomalies() + """
SELECT ticker, anomaly_type, count(*) AS anomalies,
  CASE anomaly_type WHEN 'volume_anomaly' THEN 'Volume Spike' ELSE 'Regime Change' END AS label
FROM anomalies GROUP BY ALL""",
    "latest_tick_per_symbol": f"""WITH {BY_USER}
SELECT symbol, arrival, epoch_us(ts) AS ts_us, price, size FROM trades
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY arrival DESC) = 1""",
    "tick_text": f"""WITH {MESSAGES}
SELECT event_id, type, CASE type WHEN 'trade' THEN printf('$%.2f', value) || ' × ' || CAST(CAST(size AS BIGINT) AS VARCHAR)
  ELSE printf('bid $%.2f / ask $%.2f', value, value + 0.5) END AS detail
FROM messages WHERE error IS NULL""",
    "latest_ticks_feed": f"""WITH {MESSAGES}
SELECT event_id AS arrival, symbol AS key,
  CASE WHEN event_type <> 'error' THEN type WHEN broken = 3 THEN 'bar' WHEN broken > 3 THEN 'trade' END AS type
FROM messages WHERE event_type <> 'error' OR broken NOT IN (0, 1, 6)
ORDER BY event_id DESC LIMIT 50""",
    "waiting_messages": f"""WITH {MESSAGES},
seen AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS last FROM events GROUP BY user_id)
SELECT symbol AS viewer, event_id AS arrival, "partition" FROM messages
JOIN seen ON symbol = CAST(user_id AS VARCHAR) WHERE last IS NULL OR event_id > last""",
    "model_freshness": LONG + """
SELECT symbol, epoch_us(max(e)) AS updated_us FROM windows GROUP BY symbol""",
    "consumer_lag": f"WITH {MARKS} SELECT group_id, lag FROM lags",
    "start_offsets": f"""WITH {MARKS} SELECT group_id, topic, "partition", "offset" FROM starts""",
    "topic_sizes": f"""WITH {MARKS}
SELECT t.topic, CAST(coalesce(sum(greatest(high - low, 0)), 0) AS BIGINT) AS messages
FROM (VALUES ('A'), ('N'), ('R'), ('absent')) AS t(topic) LEFT JOIN marks USING (topic) GROUP BY ALL""",
    "status_report": f"""{USERS}, {MARKS}
SELECT 'consumer_lag' AS section, CASE group_id WHEN 'tick-readers' THEN 'streaming' ELSE 'storage_sink' END AS name,
  lag AS number, CAST(NULL AS VARCHAR) AS at FROM lags
UNION ALL SELECT 'dlq_depth', 'dead_letters', CAST(sum(greatest(high - low, 0)) AS BIGINT), NULL FROM marks WHERE topic = 'R'
UNION ALL SELECT 'model_freshness', symbol, NULL, {_iso('u')}
FROM (SELECT symbol, max(e) AS u FROM windows GROUP BY symbol)""",
    "factor_scores": f"""WITH {DENSE}, {SCORES}
SELECT CAST(date AS VARCHAR) AS date, ticker, factor, round(score, 6) AS score FROM scores""",
    "factor_moves": f"WITH {DENSE}, {SCORES}, {MOVES} {MOVE_ROWS}",
    "factor_moves_sparse": f"WITH {SPARSE}, {SCORES}, {MOVES} {MOVE_ROWS}",
    "sharp_moves": f"WITH {SPARSE}, {SCORES}, {MOVES} {MOVE_ROWS} WHERE abs(z) >= 2.0",
    "cross_reference": CROSSED + """
SELECT ticker, CAST(anomaly_date AS VARCHAR) AS anomaly_date, 'volume_anomaly' AS anomaly_type,
  coalesce(matches, '') AS matches, n > 0 AS coincides_with_sharp_factor_move FROM crossed""",
    "match_summary": CROSSED + """
SELECT count(*) FILTER (n > 0) AS n_matched, count(*) AS n_total FROM crossed""",
    "universe_ticks": f"""WITH {BY_USER}
SELECT symbol, count(*) AS n, round(sum(size), 6) AS sum_size FROM trades
WHERE CAST(symbol AS BIGINT) + 1 <= 50 GROUP BY symbol""",
    "ticker_union": f"""{LONG}, {_scored("windows", "window_index", 2.0)}
SELECT CAST(user_id AS VARCHAR) AS ticker FROM events WHERE user_id + 1 <= 50
UNION SELECT symbol FROM scored WHERE is_volume_anomaly""",
    "prices_between": f"""WITH {DENSE}
SELECT CAST(date AS VARCHAR) AS date, ticker, round(ln(close), 6) AS log_close FROM panel
WHERE date >= DATE '1995-01-01' AND date < DATE '1996-02-05' AND ticker IN ('A', 'R')""",
    "delivery_audit": """
SELECT l_orderkey AS trade_id, first(l_returnflag ORDER BY l_shipdate, l_returnflag) AS ticker,
  count(*) AS attempts, epoch_us(min(l_shipdate)) AS first_us, epoch_us(max(l_shipdate)) AS last_us
FROM lineitem GROUP BY l_orderkey""",
    "delivery_summary": """
WITH audit AS (SELECT l_orderkey, count(*) AS attempts FROM lineitem GROUP BY ALL),
expected AS (SELECT count(*) AS n FROM orders)
SELECT count(*) AS row_count, count(DISTINCT l_orderkey) AS distinct_trade_ids, max(attempts) AS max_attempts,
  count(DISTINCT l_orderkey) = (SELECT n FROM expected) AS no_loss,
  count(*) = count(DISTINCT l_orderkey) AS no_duplicate_rows, max(attempts) > 1 AS redelivery_confirmed
FROM audit""",
    "drain_summary": """
WITH hourly AS (
  SELECT event_type AS run, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, count(*) AS n,
         min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM events GROUP BY ALL),
samples AS (
  SELECT run, (hour + 1 - min(hour) OVER r) * 3600.0 AS elapsed,
    sum(n) OVER r - sum(n) OVER (PARTITION BY run ORDER BY hour) AS lag, sum(n) OVER r AS size,
    (max(l) OVER r - min(f) OVER r) / 1e6 AS secs
  FROM hourly WINDOW r AS (PARTITION BY run))
SELECT run, CAST(max(size) AS BIGINT) AS burst_size, round(max(size) / max(secs), 6) AS produce_rate,
  CAST(max(lag) AS BIGINT) AS peak_lag,
  CAST(round(min(elapsed) FILTER (lag = 0 AND elapsed > 2), 6) AS DOUBLE) AS recovery_seconds
FROM samples GROUP BY run""",
    "detector_sweep": _sweep(),
}
ORACLES["streamed_window_scores"] = ORACLES["volume_scores"]
ORACLES["streamed_dead_letters"] = ORACLES["dead_letter_envelopes"]
ORACLES["resumed_window_scores"] = ORACLES["volume_scores"]
ORACLES["freshness_from_saved_state"] = ORACLES["model_freshness"]
ORACLES["streamed_delivery_audit"] = ORACLES["delivery_audit"]
ORACLES["streamed_detection"] = f"""WITH detected AS ({ORACLES["anomaly_events"]})
SELECT symbol, start_us, anomaly_type, CASE event_order WHEN 0 THEN anomaly_score END AS anomaly_score,
  CASE event_order WHEN 1 THEN changepoint_probability END AS changepoint_probability FROM detected"""
ORACLES["streamed_table_sink"] = f"""WITH kept AS ({ORACLES["anomaly_upsert"]})
SELECT ticker AS symbol, start_us, anomaly_type, anomaly_score, changepoint_probability, volume, realized_volatility
FROM kept"""
ORACLES["streamed_replay"] = f"""WITH {MESSAGES}, {BYTES}
SELECT 'market-ticks' AS topic, symbol AS key, hex(raw) AS value_hex, location,
       CASE WHEN event_id <= (SELECT max(event_id) // 2 FROM events) THEN 1 ELSE 2 END AS run FROM bad"""
ORACLES["late_subscriber_feed"] = f"""WITH {MESSAGES}
SELECT event_id, symbol AS key, CASE WHEN event_type = 'error' AND broken = 3 THEN 'bar'
         WHEN event_type = 'error' AND broken IN (4, 5, 8) THEN 'trade' ELSE type END AS type
FROM messages WHERE event_id > (SELECT max(event_id) // 2 FROM events) AND (event_type <> 'error' OR broken NOT IN (0, 1, 6))
ORDER BY ts DESC, "partition" DESC, event_id DESC LIMIT 50"""
ORACLES["streamed_drain"] = """
SELECT count(*) AS burst_size, CAST(count(*) AS DOUBLE) AS produce_rate, TRUE AS peak_below_burst, TRUE AS drained
FROM events"""
ORACLES["provider_messages"] = f"""WITH {MESSAGES}
SELECT event_id, 'market-ticks' AS topic, symbol AS key, type, {_iso("(ts - INTERVAL '9 hours')")} AS timestamp,
  CASE type WHEN 'trade' THEN value END AS price, CASE type WHEN 'trade' THEN size END AS size,
  CASE type WHEN 'trade' THEN 'V' END AS exchange, CASE type WHEN 'trade' THEN event_id END AS trade_id,
  CASE type WHEN 'quote' THEN value END AS bid_price, CASE type WHEN 'quote' THEN value + 0.5 END AS ask_price,
  CASE type WHEN 'quote' THEN size END AS ask_size, '["@","I"]' AS conditions, 'C' AS tape,
  CASE type WHEN 'trade' THEN 9 ELSE 11 END AS n_fields
FROM messages WHERE event_type <> 'error'"""
