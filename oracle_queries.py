"""DuckDB SQL for each registered query, written independently of the Spark plans."""

from __future__ import annotations

_START, _END = "DATE '1995-01-01'", "DATE '2001-04-03'"


def _round(expression: str, digits: int) -> str:
    # The nudge gives ties the half-up result of exact decimals, and one result for any summation
    # order of doubles.
    value = f"CAST({expression} AS DOUBLE)"
    return f"round({value} + sign({value}) * 1e-10, {digits})"


def _num(expression: str, digits: int = 6) -> str:
    return f"{_round(expression, digits)} + 0.0"


def _day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def _stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def _bucket(ticker: str) -> str:
    number = f"CAST(regexp_extract({ticker}, '([0-9]+)$', 1) AS INTEGER)"
    return (f"CASE WHEN {number} BETWEEN 0 AND 9 THEN 'LARGE' "
            f"WHEN {number} BETWEEN 10 AND 17 THEN 'MID' ELSE 'SMALL' END")


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

_LINES = """
priced_lines AS (
    SELECT l.*, n_name AS ticker, CAST(l_shipdate AS DATE) AS trade_date
    FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""

_BARS = _LINES + f""",
bars AS (
    SELECT ticker, trade_date,
        first(CAST(l_extendedprice AS DECIMAL(12,4)) ORDER BY {_ORDER}) AS open,
        max(CAST(l_extendedprice AS DECIMAL(12,4))) AS high,
        min(CAST(l_extendedprice AS DECIMAL(12,4))) AS low,
        last(CAST(l_extendedprice AS DECIMAL(12,4)) ORDER BY {_ORDER}) AS close,
        CAST(sum(l_quantity) AS BIGINT) AS volume
    FROM priced_lines GROUP BY ticker, trade_date
)"""

_VENDOR_BARS = _LINES + f""",
vendor_bars AS (
    SELECT ticker, strftime(trade_date, '%Y-%m-%d') AS trade_date,
        first(l_extendedprice ORDER BY {_ORDER}) AS open,
        max(l_extendedprice) AS high, min(l_extendedprice) AS low,
        last(l_extendedprice ORDER BY {_ORDER}) AS close,
        CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity
                      WHEN l_discount < 0.02 THEN 0 END) AS BIGINT) AS volume
    FROM priced_lines GROUP BY ticker, trade_date, l_returnflag
)"""

_SILVER_BARS = _VENDOR_BARS + f""",
silver_bars AS (
    SELECT ticker, CAST(trade_date AS DATE) AS trade_date, open, high, low, close, volume,
        {_bucket('ticker')} AS cap_bucket, CAST(trade_date AS DATE) - 1 AS local_date
    FROM vendor_bars WHERE close IS NOT NULL AND volume > 0
    QUALIFY row_number() OVER (
        PARTITION BY ticker, trade_date
        ORDER BY open DESC, high DESC, low DESC, close DESC, volume DESC) = 1
)"""

_FIRST_ORDERS = """
placed AS (
    SELECT n_name AS ticker, n_nationkey, o_orderpriority,
        CAST(o_orderdate AS DATE) AS d, date_trunc('quarter', o_orderdate) AS q
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
vendor_announcements AS (
    SELECT ticker, n_nationkey, min(d) AS event_date,
        ticker || '_' || strftime(min(d), '%Y%m%d') AS event_id
    FROM placed GROUP BY ticker, n_nationkey, q, o_orderpriority
)"""

_ANNOUNCEMENTS = _FIRST_ORDERS + f""",
announcements AS (
    SELECT ticker, min(d) AS event_date, ticker || '_' || strftime(min(d), '%Y%m%d') AS event_id,
        {_bucket('ticker')} AS cap_bucket, 'Q' || quarter(min(d)) AS fiscal_quarter
    FROM placed GROUP BY ticker, q
    HAVING min(d) BETWEEN {_START} AND {_END}
)"""

_SILVER_ANNOUNCEMENTS = _FIRST_ORDERS + f""",
silver_announcements AS (
    SELECT DISTINCT ticker, event_date, event_id, {_bucket('ticker')} AS cap_bucket,
        'Q' || quarter(event_date) AS fiscal_quarter
    FROM vendor_announcements
)"""


# Returns are decimals of 17 places, here whole numbers of 1e-17, from prices in units of 1e-4.
_PRICE_UNITS = "CAST(CAST(close AS DECIMAL(12,4)) * 10000 AS HUGEINT)"


def _exact6(return17: str) -> str:
    """Half-up to six places of a sum of 17-place returns."""
    return (f"CAST(sign({return17}) * ((abs({return17}) + {5 * 10**10}::HUGEINT) "
            f"// {10**11}::HUGEINT) AS DOUBLE) / 1e6")


def _study(events: str, bars: str, where: str = "TRUE") -> str:
    """CTEs days, priced, metrics, summary over the named tables."""
    return f"""
days AS (
    SELECT event_id, ticker, event_date, fiscal_quarter, cap_bucket,
        event_date + CAST(k AS INTEGER) AS day, CAST(k AS BIGINT) AS relative_day
    FROM (SELECT * FROM {events} WHERE {where}) e, generate_series(-5, 5) g(k)
    WHERE event_date - 5 < least(event_date + 5, {_END}) AND event_date + CAST(k AS INTEGER) <= {_END}
),
priced AS (
    SELECT d.*, b.trade_date, b.open, b.high, b.low, b.close, b.volume
    FROM days d LEFT JOIN {bars} b ON b.ticker = d.ticker AND b.trade_date = d.day
),
linked AS (
    SELECT *, {_PRICE_UNITS} AS units, lag({_PRICE_UNITS}) OVER w AS prev_units,
        avg(volume) OVER (PARTITION BY ticker, event_id) AS mean_volume
    FROM priced WINDOW w AS (PARTITION BY ticker, event_id ORDER BY day)
),
exact AS (
    SELECT *, sign(units - prev_units) * ((2 * abs(units - prev_units) * {10**17}::HUGEINT
        + prev_units) // (2 * nullif(prev_units, 0))) AS return17
    FROM linked
),
daily AS (
    SELECT *, CAST(return17 AS DOUBLE) / 1e17 AS daily_return,
        CASE WHEN mean_volume > 0 THEN volume / mean_volume END AS volume_ratio
    FROM exact
),
metrics AS (
    SELECT *, sum(daily_return) OVER (PARTITION BY ticker, event_id ORDER BY day
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_return
    FROM daily
),
pre AS (
    SELECT ticker, event_id, event_date, fiscal_quarter, cap_bucket,
        {_exact6('sum(return17)')} AS pre_return, avg(volume_ratio) AS avg_pre_volume_ratio
    FROM metrics WHERE relative_day BETWEEN -5 AND -1 GROUP BY ALL
),
day0 AS (
    SELECT ticker, event_id, {_exact6('return17')} AS day0_return, close AS event_close
    FROM metrics WHERE relative_day = 0
),
post AS (
    SELECT ticker, event_id, {_exact6('sum(return17)')} AS post_return,
        avg(volume_ratio) AS avg_post_volume_ratio
    FROM metrics WHERE relative_day BETWEEN 1 AND 5 GROUP BY ALL
),
summary AS (
    SELECT ticker, event_id, event_date, fiscal_quarter, cap_bucket,
        pre_return, {_round('avg_pre_volume_ratio', 4)} AS avg_pre_volume_ratio,
        day0_return, event_close, post_return,
        {_round('avg_post_volume_ratio', 4)} AS avg_post_volume_ratio
    FROM pre LEFT JOIN day0 USING (ticker, event_id) LEFT JOIN post USING (ticker, event_id)
)"""


_STUDY = _BARS + "," + _ANNOUNCEMENTS + "," + _study("announcements", "bars")


_CLEANED_STUDY = (
    f"{_SILVER_BARS}, {_SILVER_ANNOUNCEMENTS}, "
    + _study("silver_announcements", "silver_bars", f"event_date BETWEEN {_START} AND {_END}"))


def _cohorts(dims: str) -> str:
    return f"""
    SELECT {dims}, count(*) AS event_count,
        {_num('avg(daily_return)')} AS avg_return,
        {_num('quantile_disc(daily_return, 0.5)')} AS median_return,
        {_num('avg(volume_ratio)', 4)} AS avg_volume_ratio,
        {_num('avg(CASE WHEN daily_return > 0 THEN 1 ELSE 0 END)', 4)} AS positive_rate
    FROM metrics WHERE close IS NOT NULL GROUP BY {dims}"""


_MEASURES = ("pre_return", "day0_return", "post_return", "event_close", "avg_pre_volume_ratio",
             "avg_post_volume_ratio")


def _event_row(finite: bool = False) -> str:
    measures = (
        _num(f"CASE WHEN isfinite(CAST({m} AS DOUBLE)) THEN {m} END" if finite else m)
        + f" AS {m}" for m in _MEASURES)
    return (f"ticker, event_id, {_day('event_date')} AS event_date, fiscal_quarter, cap_bucket, "
            + ", ".join(measures))


_WINDOW_ROW = (
    f"ticker, event_id, {_day('event_date')} AS event_date, relative_day, "
    + ", ".join(f"{_num(m)} AS {m}" for m in ("daily_return", "cum_return", "volume_ratio", "close")))

_DAY_PRICES = (f"event_id, ticker, {_day('event_date')} AS event_date, fiscal_quarter, cap_bucket, "
               f"{_day('day')} AS day, relative_day, {_day('trade_date')} AS trade_date, "
               + ", ".join(f"{_num(m)} AS {m}" for m in ("open", "high", "low", "close"))
               + ", volume")

# The trading-day study: a plain range join and window functions over all candidate days.
_ALIGNED = _BARS + "," + _FIRST_ORDERS + f""",
timed AS (
    SELECT ticker, event_date + to_hours(CAST(n_nationkey % 3 * 8 AS INTEGER)) AS event_ts,
        count(*) AS copies
    FROM vendor_announcements
    WHERE event_date + to_hours(CAST(n_nationkey % 3 * 8 AS INTEGER))
        BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-04-03'
    GROUP BY ALL
),
near AS (
    SELECT t.*, b.trade_date, CAST(b.close AS DOUBLE) AS close, b.volume,
        abs(floor(date_diff('microsecond', event_ts, CAST(b.trade_date AS TIMESTAMP))
            / 86400000000.0)) AS distance
    FROM timed t JOIN bars b ON b.ticker = t.ticker
        AND b.trade_date BETWEEN t.event_ts - INTERVAL 14 DAY AND t.event_ts + INTERVAL 14 DAY
    WHERE b.trade_date BETWEEN {_START} AND {_END}
),
ranked AS (
    SELECT *,
        row_number() OVER (PARTITION BY ticker, event_ts ORDER BY trade_date) AS position,
        row_number() OVER (PARTITION BY ticker, event_ts ORDER BY distance, trade_date) AS nearness,
        count(*) OVER (PARTITION BY ticker, event_ts) AS n
    FROM near
),
aligned AS (
    SELECT *, position - max(CASE WHEN nearness = 1 THEN position END)
        OVER (PARTITION BY ticker, event_ts) AS relative_day
    FROM ranked WHERE n >= 3
)"""

_TRADING = _ALIGNED + f""",
t_linked AS (
    SELECT *, close / lag(close) OVER w - 1 AS daily_return,
        volume / avg(volume) OVER (PARTITION BY ticker, event_ts) AS volume_ratio
    FROM aligned WHERE relative_day BETWEEN -5 AND 5
    WINDOW w AS (PARTITION BY ticker, event_ts ORDER BY trade_date)
),
t_windows AS (
    SELECT ticker, event_ts, CAST(event_ts AS DATE) AS event_date,
        ticker || '_' || strftime(event_ts, '%Y%m%d') AS event_id,
        'Q' || quarter(event_ts) AS fiscal_quarter, {_bucket('ticker')} AS cap_bucket, copies,
        trade_date, relative_day, daily_return,
        CASE WHEN daily_return IS NOT NULL THEN sum(daily_return) OVER (
            PARTITION BY ticker, event_ts ORDER BY trade_date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cum_return,
        volume_ratio, close
    FROM t_linked
),
t_summary AS (
    SELECT ticker, event_ts, event_id, event_date, fiscal_quarter, cap_bucket, copies,
        CASE WHEN count(*) FILTER (relative_day < 0) > 0
            THEN coalesce(sum(daily_return) FILTER (relative_day < 0), 0) END AS pre_return,
        max(daily_return) FILTER (relative_day = 0) AS day0_return,
        CASE WHEN count(*) FILTER (relative_day > 0) > 0
            THEN coalesce(sum(daily_return) FILTER (relative_day > 0), 0) END AS post_return,
        max(close) FILTER (relative_day = 0) AS event_close,
        avg(volume_ratio) FILTER (relative_day < 0) AS avg_pre_volume_ratio,
        avg(volume_ratio) FILTER (relative_day > 0) AS avg_post_volume_ratio
    FROM t_windows GROUP BY ALL
)"""

_REPEAT = ", unnest(range(copies)) g(i)"

_TRADES = """
trades AS (
    SELECT 'U' || user_id AS ticker, ts AS trade_ts, CAST(value AS DECIMAL(12,4)) AS price,
        event_id AS trade_id
    FROM events
)"""

_BAR_TRADES = _SILVER_BARS + """,
bar_trades AS (
    SELECT ticker, trade_date, trade_date + INTERVAL '09:30:00' AS trade_ts, open AS price,
        'open' AS trade_type, cap_bucket FROM silver_bars
    UNION ALL SELECT ticker, trade_date, trade_date + INTERVAL '11:00:00', high, 'high', cap_bucket
        FROM silver_bars
    UNION ALL SELECT ticker, trade_date, trade_date + INTERVAL '14:00:00', low, 'low', cap_bucket
        FROM silver_bars
    UNION ALL SELECT ticker, trade_date, trade_date + INTERVAL '16:00:00', close, 'close', cap_bucket
        FROM silver_bars
)"""


def _sessions(trades: str, tie: str) -> str:
    """The rule as a plain running sum per ticker."""
    return f"""
local AS (
    SELECT *, trade_ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS local_ts FROM {trades}
),
prior AS (
    SELECT *, CAST(local_ts AS DATE) AS local_date, lag(trade_ts) OVER w AS prev_trade_ts,
        lag(CAST(local_ts AS DATE)) OVER w AS prev_local_date
    FROM local WINDOW w AS (PARTITION BY ticker ORDER BY trade_ts, {tie})
),
gaps AS (
    SELECT *, (floor(epoch(trade_ts)) - floor(epoch(prev_trade_ts))) / 60.0 AS gap_minutes FROM prior
),
flags AS (
    SELECT *, CAST(CASE WHEN prev_trade_ts IS NULL OR gap_minutes > 25
        OR local_date <> prev_local_date THEN 1 ELSE 0 END AS BIGINT) AS is_session_start
    FROM gaps
),
sessions AS (
    SELECT *, CAST(sum(is_session_start) OVER (PARTITION BY ticker ORDER BY trade_ts, {tie}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_index
    FROM flags
)"""


_SESSION_COLUMNS = (
    f"{_stamp('local_ts')} AS local_ts, {_day('local_date')} AS local_date, "
    f"{_stamp('prev_trade_ts')} AS prev_trade_ts, {_num('gap_minutes')} AS gap_minutes, "
    "is_session_start, session_index, "
    "ticker || '#' || lpad(CAST(session_index AS VARCHAR), 6, '0') AS session_id")

_ONE = "ticker = 'NATION_12'"
_STORED = "ticker = 'NATION_3'"
_ONE_EVENT = "event_id = 'NATION_12_19980401'"

_TOP = """
top AS (
    SELECT *, count(*) OVER (PARTITION BY ticker) AS event_count,
        first_value(cap_bucket) OVER (PARTITION BY ticker ORDER BY event_date DESC)
            AS ticker_cap_bucket
    FROM (SELECT * FROM summary {where}
          QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC, event_id) <= {n})
)"""


def _null_counts(name: str, table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
        f"count(*) - count({c}) AS null_count, count(*) AS total_rows FROM {table}"
        for c in columns)


def _returns_of(column: str) -> str:
    return f"WITH {_STUDY} SELECT ticker, event_id, relative_day, {_num(column)} AS {column} FROM metrics"


def _figures(name: str, table: str) -> str:
    return (f"SELECT '{name}' AS table_name, '1995-01-01' AS analysis_start, "
            f"'2001-04-03' AS analysis_end, count(DISTINCT ticker) AS ticker_count, "
            f"count(*) AS row_count FROM {table}")


def _curve(measure: str, alias: str, where: str) -> str:
    return (f"WITH {_STUDY} SELECT relative_day AS day, {_num(measure, 3)} AS {alias} "
            f"FROM metrics WHERE {where} GROUP BY relative_day")


def _studied_curve(measure: str, alias: str) -> str:
    return (f"WITH {_TRADING} SELECT relative_day AS day, {_num(measure, 3)} AS {alias} "
            f"FROM t_windows {_REPEAT} WHERE {_ONE} GROUP BY relative_day")


def _price_columns() -> str:
    return ", ".join(f"{_num(c)} AS {c}" for c in ("open", "high", "low", "close"))


def _written_figures(table: str, columns: dict[str, str | None], name: str) -> list[str]:
    """Rows, nulls, least and greatest of a table; numbers are expressions, None has no order."""
    def line(column: str, measure: str, value: str) -> str:
        return (f"SELECT '{name}' AS table_name, CAST(1 AS BIGINT) AS version, 'all' AS written, "
                f"'{column}' AS column_name, '{measure}' AS measure, CAST({value} AS DOUBLE) AS value FROM {table}")

    lines = [line("*", "rows", "count(*)")]
    for column, number in columns.items():
        lines.append(line(column, "nulls", f"count(*) FILTER (WHERE {column} IS NULL)"))
        if number:
            lines += [line(column, "least", f"min({number})"), line(column, "greatest", f"max({number})")]
    return lines


def _stored_quality() -> str:
    def days(column: str) -> str:
        return f"{column} - DATE '1970-01-01'"

    def rejected(table: str, where: str) -> str:
        return (f"SELECT 'bronze/{table[7:].replace('bars', 'prices')}', CAST(1 AS BIGINT), 'all', '*', 'rejected', "
                f"CAST(count(*) FILTER (WHERE {where}) AS DOUBLE) FROM {table}")

    numbers = {c: c for c in ("open", "high", "low", "close", "volume")}
    lines = [
        *_written_figures("silver_bars", {"ticker": None, "trade_date": days("trade_date"), **numbers, "cap_bucket": None,
                                          "local_date": days("local_date")}, "silver/prices"),
        *_written_figures("silver_announcements", {"ticker": None, "event_date": days("event_date"), "event_id": None,
                                                   "cap_bucket": None, "fiscal_quarter": None}, "silver/announcements"),
        *_written_figures("vendor_bars", {}, "bronze/prices"),
        *_written_figures("vendor_announcements", {}, "bronze/announcements"),
        rejected("vendor_bars", "close IS NULL OR coalesce(volume, 0) <= 0"),
        rejected("vendor_announcements", "event_date IS NULL OR ticker IS NULL"),
    ]
    return f"WITH {_SILVER_BARS}, {_SILVER_ANNOUNCEMENTS} " + " UNION ALL ".join(lines)


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    # What is written and read back is what it was.
    return found | {
        "stored_bronze_prices":
            f"WITH {_VENDOR_BARS} SELECT ticker, trade_date, {_price_columns()}, volume FROM vendor_bars",
        "stored_silver_prices": found["clean_prices"],
        "stored_silver_announcements": found["clean_events"],
        "stored_sessions": found["bar_trade_sessions"],
        "stored_manifest":
            f"WITH {_VENDOR_BARS}, {_FIRST_ORDERS} "
            "SELECT 'prices' AS table_name, count(*) AS row_count FROM vendor_bars UNION ALL "
            "SELECT 'announcements', count(*) FROM vendor_announcements",
        "stored_quality": _stored_quality(),
        "upserted_prices": found["clean_prices"],
        **dict.fromkeys(("upserted_event_summary", "served_after_reload", "served_event_summary"),
                        found["study_of_cleaned_rows"]),
        "served_windows": f"WITH {_CLEANED_STUDY} SELECT {_WINDOW_ROW} FROM metrics",
        "stored_cohorts": f"WITH {_CLEANED_STUDY} {_cohorts('relative_day, cap_bucket')}",
        "landed_csv_prices": f"""
            WITH {_VENDOR_BARS} SELECT ticker, trade_date, {_num('open')} AS open, {_num('high')} AS high,
                {_num('low')} AS low, CASE WHEN trade_date[9:10] <> '07' THEN {_num('close')} END AS close, volume
            FROM vendor_bars WHERE trade_date[9:10] <> '13'""",
        "landed_csv_rejects":
            f"WITH {_VENDOR_BARS} SELECT count(*) AS rejected FROM vendor_bars WHERE trade_date[9:10] = '13'",
        "landed_json_announcements": f"""
            WITH {_FIRST_ORDERS} SELECT ticker, {_day('event_date')} AS event_date,
                CASE WHEN day(event_date) % 2 = 1 THEN 'own_' ELSE '' END || event_id AS event_id
            FROM vendor_announcements""",
        "corrected_prices": f"""
            WITH {_LINES}, latest AS (
                SELECT *, CAST(l_quantity AS BIGINT) AS volume FROM priced_lines WHERE l_quantity >= 1
                QUALIFY row_number() OVER (PARTITION BY ticker, trade_date ORDER BY
                    l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) DESC, l_extendedprice DESC,
                    CAST(l_quantity AS BIGINT) DESC) = 1)
            SELECT ticker, {_day('trade_date')} AS trade_date,
                {', '.join(f"{_num('l_extendedprice')} AS {c}" for c in ('open', 'high', 'low', 'close'))},
                volume, {_bucket('ticker')} AS cap_bucket, {_day('trade_date - 1')} AS local_date
            FROM latest""",
    }


def _oracle_sql() -> dict[str, str]:
    return {
        "daily_bars": f"WITH {_BARS} SELECT ticker, {_day('trade_date')} AS trade_date, "
                      f"{_price_columns()}, volume FROM bars",
        "announcements_in_range":
            f"WITH {_FIRST_ORDERS} SELECT ticker, {_day('event_date')} AS event_date, event_id "
            f"FROM vendor_announcements WHERE event_date BETWEEN {_START} AND {_END}",
        "ticker_subset":
            f"WITH {_FIRST_ORDERS} SELECT ticker, {_day('event_date')} AS event_date, event_id "
            "FROM vendor_announcements WHERE ticker IN ('NATION_3', 'NATION_12', 'NATION_21')",
        "clean_prices":
            f"WITH {_SILVER_BARS} SELECT ticker, {_day('trade_date')} AS trade_date, "
            f"{_price_columns()}, volume, cap_bucket, {_day('local_date')} AS local_date "
            "FROM silver_bars",
        "clean_events":
            f"WITH {_SILVER_ANNOUNCEMENTS} SELECT ticker, {_day('event_date')} AS event_date, "
            "event_id, cap_bucket, fiscal_quarter FROM silver_announcements",
        "latest_line_per_key": f"""
            SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
                {_num('l_quantity')} AS l_quantity, {_num('l_extendedprice')} AS l_extendedprice,
                {_num('l_discount')} AS l_discount, {_num('l_tax')} AS l_tax, l_returnflag, l_linestatus,
                {_stamp('l_shipdate')} AS l_shipdate
            FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
                l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
                l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
                l_linestatus DESC) = 1""",
        "ticker_buckets": f"""
            WITH named AS (
                SELECT c_custkey, c_custkey % 5 AS kind, {_bucket('n_name')} AS known
                FROM customer JOIN nation ON c_nationkey = n_nationkey)
            SELECT c_custkey,
                CASE WHEN kind IN (1, 2) THEN 'OTHER' ELSE known END AS bucket,
                CASE WHEN kind IN (0, 1, 2) THEN 'SMALL' ELSE known END AS on_demand_bucket
            FROM named""",
        "bucket_sql_function":
            f"WITH {_ANNOUNCEMENTS} SELECT event_id, cap_bucket AS bucket FROM announcements",
        "fiscal_quarter": """
            SELECT 'Q' || CAST(ceil(month(o_orderdate) / 3.0) AS INTEGER) AS quarter,
                count(*) AS orders
            FROM orders GROUP BY 1""",
        "local_date": f"""
            SELECT {_day('day')} AS day,
                {_day("day AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'")} AS shifted,
                {_day('day')} AS as_is
            FROM (SELECT DISTINCT date_trunc('day', o_orderdate) AS day FROM orders)""",
        "finite_values": f"""
            SELECT event_id, CASE WHEN event_type NOT IN ('error', 'purchase') AND value >= 1
                THEN {_num('value')} END AS value
            FROM events""",
        "event_day_grid": f"""
            WITH {_STUDY} SELECT event_id, ticker, {_day('event_date')} AS event_date,
                fiscal_quarter, cap_bucket, {_day('day')} AS day, relative_day FROM days""",
        "event_day_prices": f"WITH {_STUDY} SELECT {_DAY_PRICES} FROM priced",
        "daily_returns": _returns_of("daily_return"),
        "cum_returns": _returns_of("cum_return"),
        "volume_ratio": _returns_of("volume_ratio"),
        "event_day_study": f"""
            WITH {_STUDY} SELECT {_DAY_PRICES}, {_num('daily_return')} AS daily_return,
                {_num('cum_return')} AS cum_return, {_num('volume_ratio')} AS volume_ratio
            FROM metrics""",
        "study_of_cleaned_rows": f"WITH {_CLEANED_STUDY} SELECT {_event_row()} FROM summary",
        "cohorts": f"WITH {_STUDY} {_cohorts('relative_day, cap_bucket')}",
        "exact_cohorts": f"WITH {_STUDY} {_cohorts('relative_day, cap_bucket')}",
        "merged_cohorts": f"""
            WITH {_STUDY} SELECT * EXCLUDE (median_return), TRUE AS median_within_error
            FROM ({_cohorts('relative_day, cap_bucket')})""",
        "cohorts_by_quarter":
            f"WITH {_STUDY} {_cohorts('relative_day, cap_bucket, fiscal_quarter')}",
        "event_summaries": f"WITH {_STUDY} SELECT {_event_row()} FROM summary",
        "intraday_rows": f"""
            WITH {_BAR_TRADES} SELECT ticker, {_day('trade_date')} AS trade_date,
                {_stamp('trade_ts')} AS trade_ts, {_num('price')} AS price, trade_type, cap_bucket
            FROM bar_trades""",
        "bar_trade_sessions": f"""
            WITH {_BAR_TRADES}, {_sessions('bar_trades', 'trade_type')}
            SELECT ticker, {_day('trade_date')} AS trade_date, {_stamp('trade_ts')} AS trade_ts,
                {_num('price')} AS price, trade_type, cap_bucket, {_SESSION_COLUMNS}
            FROM sessions""",
        "trade_sessions": f"""
            WITH {_TRADES}, {_sessions('trades', 'trade_id')}
            SELECT ticker, {_stamp('trade_ts')} AS trade_ts, {_num('price')} AS price, trade_id,
                {_SESSION_COLUMNS}
            FROM sessions""",
        "session_totals": f"""
            WITH {_TRADES}, {_sessions('trades', 'trade_id')}
            SELECT count(*) AS trade_count,
                count(DISTINCT ticker || '#' || session_index) AS session_count
            FROM sessions""",
        "nearest_trading_days": f"""
            WITH {_ALIGNED} SELECT ticker, {_stamp('event_ts')} AS event_ts, copies,
                {_day('trade_date')} AS trade_date, {_num('close')} AS close, volume
            FROM aligned WHERE relative_day = 0""",
        "trading_day_windows": f"""
            WITH {_TRADING} SELECT {_WINDOW_ROW}, {_stamp('event_ts')} AS event_ts, fiscal_quarter,
                cap_bucket, {_day('trade_date')} AS trade_date
            FROM t_windows {_REPEAT}""",
        "trading_day_summaries": f"""
            WITH {_TRADING} SELECT {_event_row()}, {_stamp('event_ts')} AS event_ts
            FROM t_summary {_REPEAT}""",
        "ticker_list": f"""
            WITH {_STUDY} SELECT ticker, min(cap_bucket) AS cap_bucket,
                count(event_id) AS event_count
            FROM summary GROUP BY ticker""",
        "ticker_chips": f"""
            WITH {_STUDY} SELECT ticker, min(cap_bucket) AS cap_bucket,
                count(event_id) AS event_count
            FROM summary GROUP BY ticker ORDER BY ticker LIMIT 12""",
        "ticker_events_top":
            f"WITH {_STUDY}, {_TOP.format(where='', n=7)} "
            f"SELECT {_event_row()}, event_count, ticker_cap_bucket FROM top",
        "ticker_events_one":
            f"WITH {_STUDY}, {_TOP.format(where='WHERE ' + _ONE, n=50)} "
            f"SELECT {_event_row()}, event_count, ticker_cap_bucket FROM top",
        "ticker_window_rows": f"WITH {_STUDY} SELECT {_WINDOW_ROW} FROM metrics WHERE {_ONE}",
        "event_window_rows":
            f"WITH {_STUDY} SELECT {_WINDOW_ROW} FROM metrics WHERE {_ONE} AND {_ONE_EVENT}",
        "cohort_rows": f"WITH {_STUDY} {_cohorts('relative_day, cap_bucket')}",
        "cohort_rows_by_cap":
            f"WITH {_STUDY} SELECT * FROM ({_cohorts('relative_day, cap_bucket')}) "
            "WHERE cap_bucket = 'MID'",
        "return_curve": _curve("avg(cum_return) * 100", "avg_return", _ONE),
        "return_curve_one_event":
            _curve("avg(cum_return) * 100", "avg_return", f"{_ONE} AND {_ONE_EVENT}"),
        "volume_curve": _curve("avg(volume_ratio)", "volume_ratio", _ONE),
        "curve_event_count":
            f"WITH {_STUDY} SELECT count(DISTINCT event_id) AS event_count FROM metrics WHERE {_ONE}",
        "gold_or_on_demand_events":
            f"WITH {_STUDY}, {_TRADING.replace(_BARS + ',' + _FIRST_ORDERS + ',', '')} "
            f"SELECT {_event_row()} FROM summary WHERE cap_bucket = 'LARGE' UNION ALL "
            f"SELECT {_event_row(finite=True)} FROM t_summary {_REPEAT} "
            "WHERE ticker NOT IN (SELECT ticker FROM summary WHERE cap_bucket = 'LARGE')",
        "gold_or_on_demand_windows":
            f"WITH {_STUDY}, {_TRADING.replace(_BARS + ',' + _FIRST_ORDERS + ',', '')} "
            f"SELECT {_WINDOW_ROW} FROM metrics WHERE cap_bucket = 'LARGE' UNION ALL "
            f"SELECT {_WINDOW_ROW} FROM t_windows {_REPEAT} "
            "WHERE ticker NOT IN (SELECT ticker FROM metrics WHERE cap_bucket = 'LARGE')",
        "events_of_stored_ticker":
            f"WITH {_STUDY}, {_TOP.format(where='WHERE ' + _STORED, n=5)} "
            f"SELECT {_event_row()}, event_count, ticker_cap_bucket FROM top",
        "events_of_studied_ticker":
            f"WITH {_TRADING} SELECT {_event_row(finite=True)}, count(*) OVER () AS event_count, "
            f"cap_bucket AS ticker_cap_bucket FROM t_summary {_REPEAT} WHERE {_ONE}",
        "window_of_stored_ticker": f"WITH {_STUDY} SELECT {_WINDOW_ROW} FROM metrics WHERE {_STORED}",
        "window_of_studied_ticker":
            f"WITH {_TRADING} SELECT {_WINDOW_ROW} FROM t_windows {_REPEAT} WHERE {_ONE}",
        "window_of_studied_event":
            f"WITH {_TRADING} SELECT {_WINDOW_ROW} FROM t_windows {_REPEAT} WHERE {_ONE} AND {_ONE_EVENT}",
        "studied_return_curve": _studied_curve("avg(cum_return) * 100", "avg_return"),
        "studied_volume_curve": _studied_curve("avg(volume_ratio)", "volume_ratio"),
        "null_counts":
            f"WITH {_STUDY}, {_VENDOR_BARS.replace(_LINES + ',', '')} "
            + _null_counts("vendor_bars", "vendor_bars",
                           ("ticker", "trade_date", "open", "high", "low", "close", "volume"))
            + " UNION ALL "
            + _null_counts("event_days", "metrics",
                           ("event_id", "ticker", "event_date", "fiscal_quarter", "cap_bucket",
                            "day", "relative_day", "trade_date", "open", "high", "low", "close",
                            "volume", "daily_return", "cum_return", "volume_ratio")),
        "run_figures":
            f"WITH {_SILVER_BARS}, {_SILVER_ANNOUNCEMENTS} "
            + _figures("prices", "silver_bars") + " UNION ALL "
            + _figures("announcements", "silver_announcements"),
    }
