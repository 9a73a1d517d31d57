"""DuckDB SQL that states the market queries a second time, to hold the Spark plans against."""

from __future__ import annotations

import math

SESSION = "(PARTITION BY session_date_jst, session_type ORDER BY bar_start_jst{frame})"
DAY = "(PARTITION BY session_date_jst ORDER BY bar_start_jst{frame})"


def over(scope: str, frame: str = "") -> str:
    return "OVER " + scope.format(frame=f" {frame}" if frame else "")


def rows(n: int) -> str:
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def ratio(a: str, b: str, default: str = "0.0") -> str:
    return f"CASE WHEN abs({b}) > 1e-9 THEN ({a}) / ({b}) ELSE {default} END"


def ln(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


def clock(ts: str) -> str:
    return f"CASE WHEN date_part('hour', {ts}) * 3600 + date_part('minute', {ts}) * 60 + date_part('second', {ts}) BETWEEN 31500 AND 56699 THEN 'DAY' ELSE 'NIGHT' END"


def lag(x: str, k: int = 1, scope: str = SESSION) -> str:
    return f"lag({x}, {k}) {over(scope)}"


def rolling(how: str, x: str, n: int, least: int, scope: str = SESSION) -> str:
    return f"CASE WHEN count({x}) {over(scope, rows(n))} >= {least} THEN {how}({x}) {over(scope, rows(n))} END"


def layer(name: str, of: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT *, " + ", ".join(f'{sql} AS "{k}"' for k, sql in columns.items()) + f" FROM {of})"


TICKS = """ticks AS (SELECT event_id AS sequence_no, ts AS trade_ts, strftime(ts, '%Y%m%d') AS trade_date, CAST(ts AS DATE) AS session_date_jst,
  CAST(202403 + 3 * (user_id % 2) AS INTEGER) AS contract_month, CASE WHEN event_type = 'error' THEN 'X' ELSE 'N' END AS price_type, value AS price, 1 + event_id % 10 AS trade_volume FROM events),
near_all AS (SELECT * FROM ticks t WHERE contract_month = (SELECT min(contract_month) FROM ticks u WHERE u.trade_date = t.trade_date)),
near AS (SELECT * FROM near_all WHERE price_type = 'N'),
moved AS (SELECT *, price - lag(price) OVER (PARTITION BY trade_date ORDER BY trade_ts, sequence_no) AS price_diff FROM near),
ruled AS (SELECT *, coalesce(last_value(CASE WHEN price_diff > 0 THEN 1 WHEN price_diff < 0 THEN -1 END IGNORE NULLS) OVER (PARTITION BY trade_date ORDER BY trade_ts, sequence_no ROWS UNBOUNDED PRECEDING), 0) AS direction FROM moved),
sided AS (SELECT *, CASE WHEN direction = 1 THEN trade_volume ELSE 0 END AS buy_vol, CASE WHEN direction = -1 THEN trade_volume ELSE 0 END AS sell_vol FROM ruled)"""


def bars(width: str) -> str:
    start = f"time_bucket(INTERVAL '{width}', trade_ts)"
    return f"""{TICKS},
summed AS (SELECT session_date_jst, contract_month, {start} AS bar_start_jst, arg_min(price, (trade_ts, sequence_no)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (trade_ts, sequence_no)) AS close,
  CAST(sum(trade_volume) AS DOUBLE) AS volume, count(*) AS tick_count, CAST(sum(buy_vol) AS DOUBLE) AS buy_volume, CAST(sum(sell_vol) AS DOUBLE) AS sell_volume, sum(price * trade_volume) AS turnover FROM sided GROUP BY 1, 2, 3),
bars AS (SELECT bar_start_jst, bar_start_jst + INTERVAL '{width}' AS bar_end_jst, session_date_jst, {clock('bar_start_jst')} AS session_type, 'nk225' AS symbol, CAST(contract_month AS VARCHAR) AS contract_code, open, high, low, close, volume, tick_count,
  buy_volume, sell_volume, buy_volume - sell_volume AS signed_volume, CASE WHEN volume > 0 THEN turnover / volume ELSE close END AS vwap_30s FROM summed)"""


#: What stands for the symbol in a table of many.
MANY = "'s' || user_id % 3"


def by_symbol(ctes: str) -> str:
    """The relations of one symbol's ticks, bars and what is made of them, as those of many: the symbol is a column of the
    ticks and leads every partition and group."""
    for one, many in (
        ("SELECT event_id AS sequence_no,", f"SELECT {MANY} AS symbol, event_id AS sequence_no,"),
        ("u.trade_date = t.trade_date", "u.trade_date = t.trade_date AND u.symbol = t.symbol"),
        ("PARTITION BY trade_date", "PARTITION BY symbol, trade_date"),
        ("PARTITION BY session_date_jst", "PARTITION BY symbol, session_date_jst"),
        ("summed AS (SELECT session_date_jst, contract_month,", "summed AS (SELECT symbol, session_date_jst, contract_month,"),
        ("turnover FROM sided GROUP BY 1, 2, 3)", "turnover FROM sided GROUP BY 1, 2, 3, 4)"),
        ("'nk225' AS symbol", "symbol"),
        ("raw AS (SELECT bar_start_jst,", "raw AS (SELECT symbol, bar_start_jst,"),
        ("bets AS (SELECT s.bar_start_jst,", "bets AS (SELECT s.symbol, s.bar_start_jst,"),
        ("e.session_date_jst = s.session_date_jst", "e.symbol = s.symbol AND e.session_date_jst = s.session_date_jst"),
        ("h.session_date_jst = b.session_date_jst", "h.symbol = b.symbol AND h.session_date_jst = b.session_date_jst"),
        ("final AS (SELECT bar_start_jst,", "final AS (SELECT symbol, bar_start_jst,"),
        ("sized AS (SELECT", "sized AS (SELECT symbol,"),
        ("FROM sided GROUP BY 1)", "FROM sided GROUP BY 1, 2)"),
        ("profile AS (SELECT", "profile AS (SELECT symbol,"),
        ("FROM sized GROUP BY 1, 2)", "FROM sized GROUP BY 1, 2, 3)"),
        ("dates AS (SELECT date, row_number() OVER (ORDER BY date)", "dates AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date)"),
        ("SELECT DISTINCT date FROM profile", "SELECT DISTINCT symbol, date FROM profile"),
        ("ON p.date = e.date WHERE", "ON p.date = e.date AND p.symbol = e.symbol WHERE e.symbol = d.symbol AND"),
        ("poc AS (SELECT d.date", "poc AS (SELECT d.symbol, d.date"),
    ):
        ctes = ctes.replace(one, many)
    return ctes


def quote_bars(width: str) -> str:
    start = f"time_bucket(INTERVAL '{width}', ts)"
    return f"""quotes AS (SELECT ts, event_type AS symbol, event_id, (value * 0.999 + value * 1.001) / 2 AS mid, value * 1.001 - value * 0.999 AS spread FROM events),
mids AS (SELECT symbol, {start} AS bar_start_jst, arg_min(mid, (ts, event_id)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (ts, event_id)) AS close, arg_max(spread, (ts, event_id)) AS spread_close, count(*) AS tick_count FROM quotes GROUP BY 1, 2),
ext AS (SELECT *, CASE WHEN date_part('hour', bar_start_jst) >= 16 THEN CAST(bar_start_jst AS DATE) + CASE isodow(bar_start_jst) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END ELSE CAST(bar_start_jst AS DATE) END AS session_date_jst, {clock('bar_start_jst')} AS session_type FROM mids)"""


def shape(p: str = "") -> dict[str, str]:
    h, lo, c, o = (f"{p}{x}" for x in ("high", "low", "close", "open"))
    return {f"{p}price_spread": f"{h} - {lo}", f"{p}close_pos_in_bar": ratio(f"{c} - {lo}", f"{h} - {lo}", "0.5"), f"{p}body_ratio": ratio(f"abs({c} - {o})", f"{h} - {lo}")}


FLOW = {
    "typical_price": "(close + high + low) / 3.0",
    "buy_ratio": ratio("buy_volume", "volume"),
    "sell_ratio": ratio("sell_volume", "volume"),
    "signed_volume_ratio": ratio("signed_volume", "volume"),
    "trade_size_mean": ratio("volume", "tick_count"),
    "volume_pressure": ln("(buy_volume + 1.0) / (sell_volume + 1.0)"),
    "dist_vwap_30s": "close - vwap_30s",
    "dist_vwap_30s_pct": ratio("close - vwap_30s", "close"),
    "log_vol": "ln(volume + 1.0)",
    "log_buy_vol": "ln(buy_volume + 1.0)",
    "log_sell_vol": "ln(sell_volume + 1.0)",
}


def change(x: str, k: int) -> str:
    return ratio(f"{x} - {lag(x, k)}", lag(x, k))


def slope(x: str, k: int) -> str:
    return f"({x} - {lag(x, k)}) / {k}.0"


def moves(p: str, returns: dict[str, int], slopes: dict[str, tuple[str, int]]) -> dict[str, str]:
    return {
        f"{p}log_ret": f"{ln(p + 'close')} - {ln(lag(p + 'close'))}",
        **{p + r: change(f"{p}close", k) for r, k in returns.items()},
        **{p + s: slope(p + x, k) for s, (x, k) in slopes.items()},
    }


RETURNS = {"ret_1m": 2, "ret_2m": 4, "ret_5m": 10, "ret_10m": 20, "ret_30m": 60, "ret_60m": 120}
SLOPES = {"close_slope_5m": ("close", 10), "close_slope_10m": ("close", 20), "signed_volume_slope_5m": ("signed_volume", 10), "tick_count_slope_5m": ("tick_count", 10)}
ROLLED = {
    "realized_vol_5m": ("stddev_samp", "log_ret", 10, 5),
    "realized_vol_10m": ("stddev_samp", "log_ret", 20, 10),
    "realized_vol_30m": ("stddev_samp", "log_ret", 60, 20),
    "signed_volume_sum_2m": ("sum", "signed_volume", 4, 2),
    "signed_volume_sum_5m": ("sum", "signed_volume", 10, 5),
    "signed_volume_sum_10m": ("sum", "signed_volume", 20, 10),
    "volume_sum_5m": ("sum", "volume", 10, 5),
    "tick_count_ma_5m": ("avg", "tick_count", 10, 5),
}
_GK = f"0.5 * (ln(high) - ln(low)) * (ln(high) - ln(low)) - {2 * math.log(2) - 1!r} * (ln(close) - ln(open)) * (ln(close) - ln(open))"


def zscores(pairs: list[tuple[str, int]]) -> dict[str, str]:
    out = {}
    for x, n in pairs:
        least = max(5, n // 4)
        mean, std = rolling("avg", x, n, least, DAY), rolling("stddev_samp", x, n, least, DAY)
        out |= {f"__{x}_mean_{n}": mean, f"__{x}_std_{n}": std, f"{x}_z_{n}": ratio(f"{x} - ({mean})", f"({std})")}
    return out


def base(of: str = "bars") -> str:
    """Layers b1 to b7 over a relation of bars."""
    vwap = f"({rolling('sum', 'typical_price * volume', 30, 10)}) / nullif({rolling('sum', 'volume', 30, 10)}, 0)"
    return ",\n".join(
        [
            layer("b1", of, shape() | FLOW),
            layer("b2", "b1", moves("", RETURNS, SLOPES)),
            layer("b3", "b2", {k: rolling(*v) for k, v in ROLLED.items()} | {"garman_klass_vol": f"sqrt(CASE WHEN {_GK} < 0 THEN 0.0 ELSE {_GK} END)", "dist_vwap_15m": f"close - {vwap}"}),
            layer("b4", "b3", {"tick_speed_ratio": ratio("tick_count", "tick_count_ma_5m"), "signed_volume_ratio_change": f"signed_volume_ratio - {lag('signed_volume_ratio')}", "buy_share_change": f"buy_ratio - {lag('buy_ratio')}", "sell_share_change": f"sell_ratio - {lag('sell_ratio')}", "range_per_volume": ratio("price_spread", "volume + 1.0"), "tick_per_volume": ratio("tick_count", "volume + 1.0")}),
            layer("b5", "b4", zscores([("volume", 10), ("volume", 60), ("tick_count", 10), ("signed_volume", 10), ("signed_volume_ratio", 10), ("price_spread", 10), ("dist_vwap_30s", 10)])),
            layer("b6", "b5", {"__session_turnover_cum": f"sum(typical_price * volume) {over(SESSION, UPTO)}", "__session_volume_cum": f"sum(volume) {over(SESSION, UPTO)}"}),
            layer("b7", "b6", {"session_vwap": ratio("__session_turnover_cum", "__session_volume_cum")}),
            layer("b8", "b7", {"dist_vwap_session": "close - session_vwap", "dist_vwap_session_pct": ratio("close - session_vwap", "close")}),
        ]
    )


CARRIED = ("open", "high", "low", "close", "spread_close", "tick_count")


def joined(symbols: dict[str, str]) -> str:
    """`joined` and `filled`: bars with the columns of external symbols, event type -> prefix."""
    select = ", ".join(["bars.*", *(f"{p}.{x} AS {p}_{x}" for p in symbols.values() for x in CARRIED), *(f"{p}.bar_start_jst IS NOT NULL AS {p}_there" for p in symbols.values())])
    tables = " ".join(f"LEFT JOIN (SELECT * FROM ext WHERE symbol = '{kind}') {p} ON bars.bar_start_jst = {p}.bar_start_jst AND bars.session_date_jst = {p}.session_date_jst AND bars.session_type = {p}.session_type" for kind, p in symbols.items())
    fills = ", ".join(f"last_value({p}_{x} IGNORE NULLS) {over(SESSION, UPTO)} AS {p}_{x}" for p in symbols.values() for x in CARRIED)
    names = ", ".join(f"{p}_{x}" for p in symbols.values() for x in CARRIED)
    return f"joined AS (SELECT {select} FROM bars {tables}),\nfilled AS (SELECT * EXCLUDE ({names}), {fills} FROM joined)"


def external(symbols: dict[str, str], of: str) -> str:
    """Layers e1 to e4."""
    ps = [f"{p}_" for p in symbols.values()]
    some = {r: RETURNS[r] for r in ("ret_1m", "ret_5m", "ret_10m")}
    slopes = {s: SLOPES[s] for s in ("close_slope_5m", "close_slope_10m", "tick_count_slope_5m")}
    return ",\n".join(
        [
            layer("e1", of, {k: v for p in ps for k, v in (shape(p) | moves(p, some, slopes)).items()}),
            layer("e2", "e1", {p + k: rolling(ROLLED[k][0], p + ROLLED[k][1], *ROLLED[k][2:]) for p in ps for k in ("realized_vol_5m", "realized_vol_10m", "tick_count_ma_5m")}),
            layer("e3", "e2", {f"{p}tick_speed_ratio": ratio(f"{p}tick_count", f"{p}tick_count_ma_5m") for p in ps}),
            layer("e4", "e3", zscores([(f"{p}{x}", 10) for p in ps for x in ("tick_count", "spread_close", "price_spread", "ret_1m")])),
        ]
    )


#: Frames by time: aggregate, column, seconds, least rows.
CLOCK = {
    "realized_vol_5m_clock": ("stddev_samp", "log_ret", 300, 2),
    "realized_vol_30m_clock": ("stddev_samp", "log_ret", 1800, 5),
    "signed_volume_sum_5m_clock": ("sum", "signed_volume", 300, 1),
    "signed_volume_sum_10m_clock": ("sum", "signed_volume", 600, 1),
    "volume_sum_5m_clock": ("sum", "volume", 300, 1),
    "volume_sum_30m_clock": ("sum", "volume", 1800, 1),
    "tick_count_ma_5m_clock": ("avg", "tick_count", 300, 1),
    "bars_30m_clock": ("count", "close", 1800, 1),
}


def clock_frames(of: str = "bars") -> str:
    """`returned` and `clocked`."""
    frame = lambda n: over(SESSION, f"RANGE BETWEEN INTERVAL {n - 1} SECOND PRECEDING AND CURRENT ROW")
    columns = {k: f"CASE WHEN count({x}) {frame(n)} >= {least} THEN {how}({x}) {frame(n)} END" for k, (how, x, n, least) in CLOCK.items()}
    vwap = f"sum((close + high + low) / 3.0 * volume) {frame(900)} / nullif(sum(volume) {frame(900)}, 0)"
    return layer("returned", of, {"log_ret": f"{ln('close')} - {ln(lag('close'))}"}) + ",\n" + layer("clocked", "returned", columns | {"dist_vwap_15m_clock": f"close - {vwap}"})


_MOD = "(date_part('hour', bar_start_jst) * 60 + date_part('minute', bar_start_jst))"
CALENDAR = {
    "minute_of_day": _MOD,
    "weekday": "isodow(bar_start_jst)",
    "is_day_session": "CASE WHEN session_type = 'DAY' THEN 1 ELSE 0 END",
    "is_night_session": "CASE WHEN session_type = 'NIGHT' THEN 1 ELSE 0 END",
    "minutes_from_open": f"CASE WHEN session_type = 'DAY' THEN {_MOD} - 525 WHEN {_MOD} >= 1020 THEN {_MOD} - 1020 ELSE {_MOD} + 420 END",
    "tod_sin": f"sin(2 * pi() * {_MOD} / 1440.0)",
    "tod_cos": f"cos(2 * pi() * {_MOD} / 1440.0)",
    "dow_sin": "sin(2 * pi() * isodow(bar_start_jst) / 7.0)",
    "dow_cos": "cos(2 * pi() * isodow(bar_start_jst) / 7.0)",
    "is_opening_window": f"CASE WHEN (CASE WHEN session_type = 'DAY' THEN {_MOD} - 525 WHEN {_MOD} >= 1020 THEN {_MOD} - 1020 ELSE {_MOD} + 420 END) <= 30 THEN 1 ELSE 0 END",
    "is_lunch_edge": f"CASE WHEN session_type = 'DAY' AND {_MOD} >= 660 THEN 1 ELSE 0 END",
    "is_night_late": f"CASE WHEN session_type = 'NIGHT' AND {_MOD} <= 180 THEN 1 ELSE 0 END",
}


def label(of: str, horizon: int) -> str:
    """`stepped` and `labelled`."""
    frame = f"ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING"
    path = f"CASE WHEN count(_step) {over(DAY, frame)} = {horizon} THEN sum(_step) {over(DAY, frame)} END"
    far = f"abs(lead(close, {horizon}) {over(DAY)} - close)"
    return layer("stepped", of, {"_step": f"abs(close - {lag('close', 1, DAY)})"}) + ",\n" + layer("labelled", "stepped", {f"label_efficiency_{horizon}": f"CAST({ratio(far, path)} AS FLOAT)"})


PROFILE = f"""{TICKS},
sized AS (SELECT time_bucket(INTERVAL '300 seconds', trade_ts) AS trade_ts, arg_min(price, (sided.trade_ts, sequence_no)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (sided.trade_ts, sequence_no)) AS close, avg(trade_volume) AS avg_trade_size,
  max(trade_volume) AS max_trade_size, CAST(sum(buy_vol) AS BIGINT) AS buy_volume, CAST(sum(sell_vol) AS BIGINT) AS sell_volume, CAST(sum(trade_volume) AS BIGINT) AS volume, count(*) AS tick_count FROM sided GROUP BY 1),
profile AS (SELECT CAST(trade_ts AS DATE) AS date, CAST(floor(close / 10.0) * 10 AS INTEGER) AS price_bin, CAST(sum(volume) AS BIGINT) AS volume FROM sized GROUP BY 1, 2)"""


def poc() -> str:
    parts = []
    for name, n in (("prev_poc_1d", 1), ("prev_poc_1w", 5), ("prev_poc_4w", 20)):
        parts.append(f"(SELECT price_bin FROM (SELECT price_bin, sum(volume) AS v FROM profile p JOIN dates e ON p.date = e.date WHERE e.i BETWEEN d.i - {n} AND d.i - 1 AND d.i > {n} GROUP BY 1) ORDER BY v DESC, price_bin LIMIT 1) AS {name}")
    return f"{PROFILE},\ndates AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM profile)),\npoc AS (SELECT d.date, {', '.join(parts)} FROM dates d)"


def outcomes(bet) -> str:
    """`outcomes` of `signals`: of the bars a signal may hold, the first that ends it, else the last."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY session_date_jst ORDER BY bar_start_jst) AS i FROM signals),
bets AS (SELECT s.bar_start_jst, s.session_date_jst, s.session_type, s.i, e.bar_start_jst AS entry_time, e.raw_open AS entry_price, sign(s.momentum) AS side FROM numbered s JOIN numbered e ON e.session_date_jst = s.session_date_jst AND e.i = s.i + 1 WHERE CAST(s.prob AS DOUBLE) >= {bet.threshold} AND s.momentum <> 0),
held AS (SELECT b.*, h.i AS j, h.bar_start_jst AS exit_time, h.raw_close, CASE WHEN side > 0 THEN raw_low <= entry_price - {bet.stop} ELSE raw_high >= entry_price + {bet.stop} END AS sl, CASE WHEN side > 0 THEN raw_high >= entry_price + {bet.target} ELSE raw_low <= entry_price - {bet.target} END AS tp
  FROM bets b JOIN numbered h ON h.session_date_jst = b.session_date_jst AND h.i BETWEEN b.i + 1 AND b.i + {bet.hold}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_date_jst, i ORDER BY CASE WHEN sl OR tp THEN 0 ELSE 1 END, CASE WHEN sl OR tp THEN j ELSE -j END) AS k FROM held),
ends AS (SELECT *, CASE WHEN sl THEN 'SL' WHEN tp THEN 'TP' ELSE 'TIME' END AS reason, CASE WHEN sl THEN entry_price - side * {bet.stop} WHEN tp THEN entry_price + side * {bet.target} ELSE raw_close END AS exit_price FROM ranked WHERE k = 1),
outcomes AS (SELECT *, CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, (exit_price - entry_price) * side * {bet.multiplier} - {bet.cost} AS pnl FROM ends)"""
