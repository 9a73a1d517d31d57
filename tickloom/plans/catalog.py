"""All registered queries of the market engine, each with its DuckDB twin where SQL can state it.

Both sides end in the same plain columns: times and dates as text, whole numbers as longs, other numbers rounded to six
decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import asof, bars, dataset, features, outcomes, profile, registry, report, rollup, score, ticks
from ..session import settled, shared_folder
from ..sources import sinks, tables, vendor
from ..streaming import jobs
from . import adapters, sql
from .adapters import external_bars, load, many_ticks, trade_bars, vendor_ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Sums of prices with two decimals often end in exactly half a unit of the sixth; moved aside, both sides round them alike.
NUDGE = 3e-8
HOUR, FIVE, HALF = "3600 seconds", "300 seconds", "30 seconds"
#: Label horizon and sequence length that fit 5-minute bars of a date.
HORIZON, LENGTH = 12, 12
SYMBOLS = adapters.SYMBOL_OF
#: Symbols that relative strength and lead-lag are taken against.
RELATIVE = ("usdjpy", "sp500", "nasdaq")


def _spark_column(name: str, kind: str) -> str:
    c = f"`{name}`"
    made = {"t": f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')", "d": f"date_format({c}, 'yyyy-MM-dd')", "f": f"round(cast({c} as double) + {NUDGE}D, 6)", "c": f"round(cast({c} as double), 2)", "i": f"cast({c} as bigint)"}
    return f"{made.get(kind, c)} AS {c}"


def _sql_column(name: str, kind: str) -> str:
    c = f'"{name}"'
    made = {"t": f"strftime({c}, '%Y-%m-%d %H:%M:%S')", "d": f"strftime({c}, '%Y-%m-%d')", "f": f"round(CAST({c} AS DOUBLE) + {NUDGE}, 6) + 0.0", "c": f"round(CAST({c} AS DOUBLE), 2) + 0.0", "i": f"CAST({c} AS BIGINT)"}
    return f"{made.get(kind, c)} AS {c}"


def _kinds(columns: str) -> list[tuple[str, str]]:
    return [(x.partition(":")[0], x.partition(":")[2] or "s") for x in columns.split()]


def query(name: str, columns: str, body: str | None = None) -> Callable[[Query], Query]:
    """Registers a query: its result columns as name:kind, and the SQL, ending in a relation, that is its twin."""

    def register(f: Query) -> Query:
        kinds = _kinds(columns)
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).selectExpr(*[_spark_column(*k) for k in kinds])
        if body is not None:
            head, _, relation = body.rpartition("\n")
            ORACLES[name] = f"{head}\nSELECT {', '.join(_sql_column(*k) for k in kinds)} FROM ({relation})"
        return f

    return register


def _with(ctes: str, relation: str) -> str:
    return f"WITH {ctes}\n{relation}"


KEY = "bar_start_jst:t session_date_jst:d session_type"
BAR = f"{KEY} symbol contract_code open:f high:f low:f close:f volume:f tick_count:i buy_volume:f sell_volume:f signed_volume:f vwap_30s:f"


def five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as features find them: written. A frame of some hundred features is then planned over one scan."""
    return settled(trade_bars(spark, sf_dir, FIVE))


def outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External bars, written."""
    return settled(external_bars(spark, sf_dir, FIVE))


# ticks


@query("near_contract", "trade_date trade_ts:t sequence_no:i contract_month:i price_type price:f", _with(sql.TICKS, "SELECT * FROM near_all"))
def near_contract(spark, d):
    return ticks.near_contract(vendor_ticks(spark, d))


@query("tick_rule", "trade_date sequence_no:i price:f price_diff:f direction:i buy_vol:i sell_vol:i", _with(sql.TICKS, "SELECT * FROM sided"))
def tick_rule(spark, d):
    return ticks.with_direction(ticks.regular(ticks.near_contract(vendor_ticks(spark, d))))


@query("normalised_ticks", "session_date_jst:d session_type trade_ts:t contract_code sequence_no:i price:f trade_volume:i direction:i symbol", _with(sql.TICKS, f"SELECT *, {sql.clock('trade_ts')} AS session_type, CAST(contract_month AS VARCHAR) AS contract_code, 'nk225' AS symbol FROM sided"))
def normalised_ticks(spark, d):
    return ticks.normalised(vendor_ticks(spark, d), "nk225")


@query("session_type", "event_id:i session_type", f"\nSELECT event_id, {sql.clock('ts')} AS session_type FROM events")
def session_type(spark, d):
    return load(spark, d, "events").withColumn("session_type", clock.session_type(F.col("ts")))


@query("session_date", "event_id:i session_date_jst:d iso_weekday:i", "\nSELECT event_id, CASE WHEN date_part('hour', ts) >= 16 THEN CAST(ts AS DATE) + CASE isodow(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END ELSE CAST(ts AS DATE) END AS session_date_jst, isodow(ts) AS iso_weekday FROM events")
def session_date(spark, d):
    return load(spark, d, "events").withColumns({"session_date_jst": clock.session_date(F.col("ts")), "iso_weekday": clock.iso_weekday(F.col("ts"))})


@query("parse_vendor_ts", "event_id:i trade_ts:t trade_ms:i", "\nSELECT event_id, date_trunc('milliseconds', ts) AS trade_ts, (epoch_us(ts) // 1000) % 1000 AS trade_ms FROM events")
def parse_vendor_ts(spark, d):
    t = F.col("ts")
    number = F.date_format(t, "HHmmssSSS").cast("long")  # leading zeros are lost, as in vendor files
    read = load(spark, d, "events").withColumn("trade_ts", clock.vendor_timestamp(F.date_format(t, "yyyyMMdd"), number))
    return read.withColumn("trade_ms", F.date_format("trade_ts", "SSS").cast("long"))


@query("tz_convert", "event_id:i tokyo:t", "\nSELECT event_id, ts AT TIME ZONE 'EET' AT TIME ZONE 'Asia/Tokyo' AS tokyo FROM events")
def tz_convert(spark, d):
    return load(spark, d, "events").withColumn("tokyo", clock.tokyo_time(F.col("ts")))


@query("week_partition", "event_type week_start:d n:i", "\nSELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n FROM events GROUP BY 1, 2")
def week_partition(spark, d):
    return load(spark, d, "events").groupBy("event_type", clock.week_start(F.col("ts")).alias("week_start")).agg(F.count("*").alias("n"))


@query("union_dates", "date:d", "\nSELECT DISTINCT CAST(ts AS DATE) AS date FROM events UNION SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders")
def union_dates(spark, d):
    one = load(spark, d, "events").select(F.to_date("ts").alias("date"))
    return one.unionByName(load(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))).distinct()


@query("json_record", "event_id:i k:i", "\nSELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def json_record(spark, d):
    return load(spark, d, "events").withColumn("k", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)))


# bars


@query("bars_30s", f"{BAR} bar_end_jst:t is_complete", _with(sql.bars(HALF), "SELECT *, true AS is_complete FROM bars"))
def bars_30s(spark, d):
    return trade_bars(spark, d, HALF)


@query("bars_1h", BAR, _with(sql.bars(HOUR), "SELECT * FROM bars"))
def bars_1h(spark, d):
    return trade_bars(spark, d, HOUR)


@query("mid_bars", f"{KEY} symbol open:f high:f low:f close:f spread_close:f tick_count:i", _with(sql.quote_bars(FIVE), "SELECT * FROM ext"))
def mid_bars(spark, d):
    return external_bars(spark, d, FIVE)


@query("bar_imbalance", "trade_ts:t open:f high:f low:f close:f avg_trade_size:f max_trade_size:i buy_volume:i sell_volume:i volume:i tick_count:i size_imb_1bar:f", _with(sql.PROFILE, "SELECT *, CASE WHEN volume > 0 THEN (buy_volume - sell_volume) / CAST(volume AS DOUBLE) ELSE 0 END AS size_imb_1bar FROM sized"))
def bar_imbalance(spark, d):
    return settled(bars.size_bars(ticks.normalised(vendor_ticks(spark, d), "nk225"), FIVE))


@query("completeness", "session_date_jst:d n:i", _with(sql.quote_bars(FIVE) + ", " + sql.bars(FIVE), "SELECT session_date_jst, count(*) AS n FROM bars WHERE session_date_jst IN (SELECT session_date_jst FROM ext GROUP BY 1 HAVING count(DISTINCT symbol) >= 5) GROUP BY 1"))
def completeness(spark, d):
    return features.complete_days(five(spark, d), outside(spark, d)).groupBy("session_date_jst").agg(F.count("*").alias("n"))


# base features on 5-minute bars

_BASE = _with(sql.bars(FIVE) + ",\n" + sql.base(), "SELECT * FROM b8")


def _base(name: str, columns: str) -> None:
    query(name, f"{KEY} {columns}", _BASE)(lambda spark, d: features.base_features(five(spark, d)))


_base("bar_shape", "price_spread:f close_pos_in_bar:f body_ratio:f typical_price:f")
_base("order_flow", "buy_ratio:f sell_ratio:f signed_volume_ratio:f trade_size_mean:f volume_pressure:f dist_vwap_30s:f dist_vwap_30s_pct:f log_vol:f log_buy_vol:f log_sell_vol:f range_per_volume:f tick_per_volume:f")
_base("log_return", "close:f log_ret:f")
_base("pct_returns", " ".join(f"{r}:f" for r in features.RETURNS))
_base("slopes", " ".join(f"{s}:f" for s in features.SLOPES))
_base("realized_vol", "realized_vol_5m:f realized_vol_10m:f realized_vol_30m:f garman_klass_vol:f")
_base("rolling_sums", "signed_volume_sum_2m:f signed_volume_sum_5m:f signed_volume_sum_10m:f volume_sum_5m:f")
_base("rolling_mean_speed", "tick_count_ma_5m:f tick_speed_ratio:f")
_base("rolling_vwap", "dist_vwap_15m:f")
_base("ratio_change", "signed_volume_ratio_change:f buy_share_change:f sell_share_change:f")
_base("zscores", " ".join(f"{x}_z_{n}:f __{x}_mean_{n}:f __{x}_std_{n}:f" for x, n in features.ZSCORES))
_base("session_vwap", "session_vwap:f dist_vwap_session:f dist_vwap_session_pct:f")

# external symbols

_JOINED = sql.bars(FIVE) + ",\n" + sql.quote_bars(FIVE) + ",\n" + sql.joined(SYMBOLS)
_CARRIED = " ".join(f"{p}_{x}:f" for p in SYMBOLS.values() for x in sql.CARRIED)


@query("external_join", f"{KEY} close:f {_CARRIED}", _with(_JOINED, "SELECT * FROM joined"))
def external_join(spark, d):
    return features.join_externals(five(spark, d), outside(spark, d), SYMBOLS)


@query("external_ffill", f"{KEY} close:f {_CARRIED}", _with(_JOINED, "SELECT * FROM filled"))
def external_ffill(spark, d):
    return features.fill_externals(external_join(spark, d), SYMBOLS.values())


_EXTERNAL = _JOINED + ",\n" + sql.base("filled") + ",\n" + sql.external(SYMBOLS, "b8")


def _cross_input(spark, d) -> DataFrame:
    return features.external_features(features.base_features(external_ffill(spark, d)), SYMBOLS.values())


@query("external_features", f"{KEY} " + " ".join(f"{p}_{x}:f" for p in SYMBOLS.values() for x in ("price_spread", "close_pos_in_bar", "body_ratio", "log_ret", "ret_1m", "ret_5m", "ret_10m", "close_slope_5m", "close_slope_10m", "tick_count_slope_5m", "realized_vol_5m", "realized_vol_10m", "tick_count_ma_5m", "tick_speed_ratio", "tick_count_z_10", "spread_close_z_10", "price_spread_z_10", "ret_1m_z_10")), _with(_EXTERNAL, "SELECT * FROM e4"))
def external_features(spark, d):
    return _cross_input(spark, d)


@query("rel_strength", f"{KEY} " + " ".join(f"rel_strength_vs_{p}_{r}:f" for p in RELATIVE for r in ("1m", "5m")), _with(_EXTERNAL, "SELECT *, " + ", ".join(f"ret_{r} - {p}_ret_{r} AS rel_strength_vs_{p}_{r}" for p in RELATIVE for r in ("1m", "5m")) + " FROM e4"))
def rel_strength(spark, d):
    return features.cross_asset(_cross_input(spark, d))


@query("lead_lag", f"{KEY} " + " ".join(f"lead_lag_vs_{p}_1m_lag{k}:f" for p in RELATIVE for k in (1, 2)), _with(_EXTERNAL, "SELECT *, " + ", ".join(f"ret_1m - {sql.lag(p + '_ret_1m', k, sql.DAY)} AS lead_lag_vs_{p}_1m_lag{k}" for p in RELATIVE for k in (1, 2)) + " FROM e4"))
def lead_lag(spark, d):
    return features.cross_asset(_cross_input(spark, d))


_GOLD_OIL = {f"{name}_vs_sp500_divergence_{r}": f"{p}_ret_{r} - sp500_ret_{r}" for name, p in (("gold", "xau"), ("oil", "xti")) for r in ("1m", "5m")}


@query("gold_oil", f"{KEY} " + " ".join(f"{x}:f" for x in _GOLD_OIL), _with(_EXTERNAL, "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _GOLD_OIL.items()) + " FROM e4"))
def gold_oil(spark, d):
    return features.cross_asset(_cross_input(spark, d))


_RISK = {"view": "sp500", "purchase": "nasdaq", "signup": "dow"}
_R1 = [f"{p}_ret_1m" for p in _RISK.values()]
_MEAN = f"(({' + '.join(_R1)}) / 3)"


@query("risk_on", f"{KEY} us_risk_on_ret_1m:f us_risk_on_ret_5m:f us_index_dispersion_1m:f us_sign_agreement_1m:f", _with(sql.bars(FIVE) + ",\n" + sql.quote_bars(FIVE) + ",\n" + sql.joined(_RISK) + ",\n" + sql.external(_RISK, "filled"), f"SELECT *, 0.4 * sp500_ret_1m + 0.4 * nasdaq_ret_1m + 0.2 * dow_ret_1m AS us_risk_on_ret_1m, 0.4 * sp500_ret_5m + 0.4 * nasdaq_ret_5m + 0.2 * dow_ret_5m AS us_risk_on_ret_5m, sqrt(({' + '.join(f'({x} - {_MEAN}) ** 2' for x in _R1)}) / 2) AS us_index_dispersion_1m, {' + '.join(f'sign({x})' for x in _R1)} AS us_sign_agreement_1m FROM e4"))
def risk_on(spark, d):
    joined = features.join_externals(five(spark, d), outside(spark, d), _RISK)
    return features.cross_asset(features.external_features(features.fill_externals(joined, _RISK.values()), _RISK.values()))


@query("calendar", f"{KEY} " + " ".join(f"{k}:{'f' if k[-3:] in ('sin', 'cos') else 'i'}" for k in sql.CALENDAR), _with(sql.bars(FIVE) + ",\n" + sql.layer("dated", "bars", sql.CALENDAR), "SELECT * FROM dated"))
def calendar(spark, d):
    return features.calendar(five(spark, d))


@query("efficiency_label", f"{KEY} close:f label_efficiency_{HORIZON}:f", _with(sql.bars(FIVE) + ",\n" + sql.label("bars", HORIZON), "SELECT * FROM labelled"))
def efficiency_label(spark, d):
    return features.efficiency_label(five(spark, d), HORIZON)


_PRICES = ("open", "high", "low", "close", "vwap_30s", "typical_price", "session_vwap")
_DIFFS = ", ".join(f"{x} - {sql.lag(x)} AS {x}" for x in _PRICES)


@query("stationary", f"{KEY} " + " ".join(f"{x}:f" for x in _PRICES), _with(sql.bars(FIVE) + ",\n" + sql.base() + f",\ndiffed AS (SELECT * EXCLUDE ({', '.join(_PRICES)}), {_DIFFS} FROM b8)", "SELECT * FROM diffed WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in _PRICES)))
def stationary(spark, d):
    return features.stationary(features.base_features(five(spark, d)))


_ALL_PRICES = [*_PRICES, *(f"{p}_{x}" for p in SYMBOLS.values() for x in ("open", "high", "low", "close"))]
_LABEL = f"label_efficiency_{HORIZON}"
_FRAME = [
    *("volume", "tick_count", "buy_volume", "sell_volume", "signed_volume", *_ALL_PRICES, *sql.shape(), *(x for x in sql.FLOW if x != "typical_price"), "log_ret", *sql.RETURNS, *sql.SLOPES, *sql.ROLLED, "garman_klass_vol", "dist_vwap_15m"),
    *("tick_speed_ratio", "signed_volume_ratio_change", "volume_z_10", "volume_z_60", "dist_vwap_session", "tod_sin", "dow_cos"),
    *(f"{p}_{x}" for p in SYMBOLS.values() for x in ("spread_close", "ret_1m", "ret_10m", "realized_vol_5m", "tick_speed_ratio", "ret_1m_z_10")),
    *(f"raw_{x}_abs" for x in ("open", "high", "low", "close")),
]
_FINAL = (
    _EXTERNAL + ",\n" + sql.layer("dated", "e4", sql.CALENDAR) + ",\n" + sql.label("dated", HORIZON)
    + f",\ndiffed AS (SELECT * EXCLUDE ({', '.join(_ALL_PRICES)}), open AS raw_open_abs, high AS raw_high_abs, low AS raw_low_abs, close AS raw_close_abs, " + ", ".join(f"{x} - {sql.lag(x)} AS {x}" for x in _ALL_PRICES) + " FROM labelled)"
    + ",\nkept AS (SELECT * FROM diffed WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in _ALL_PRICES) + ")"
    + ",\nfinal AS (SELECT bar_start_jst, session_date_jst, session_type, " + _LABEL + ", " + ", ".join(f"coalesce({x}, 0) AS {x}" for x in _FRAME) + " FROM kept)"
)


@query("finalize", f"{KEY} {_LABEL}:f " + " ".join(f"{x}:f" for x in _FRAME), _with(_FINAL, "SELECT * FROM final"))
def finalize(spark, d):
    return features.feature_frame(five(spark, d), outside(spark, d), SYMBOLS, HORIZON)


_NUMBERS = [x for x in _FRAME if not x.startswith("raw_")]


@query("stats_by_type", "feature mean:f std:f", _with(_FINAL, " UNION ALL ".join(f"SELECT '{x}' AS feature, avg({x}) AS mean, CASE WHEN stddev_samp({x}) > 0 THEN stddev_samp({x}) ELSE 1 END AS std FROM final HAVING count(*) > 0" for x in _NUMBERS)))
def stats_by_type(spark, d):
    frame = finalize(spark, d).select("bar_start_jst", "session_date_jst", "session_type", _LABEL, *_FRAME)
    return dataset.feature_stats(frame, dataset.feature_columns(frame, _LABEL))


# profiles


@query("volume_profile", "date:d price_bin:i volume:i", _with(sql.PROFILE, "SELECT * FROM profile"))
def volume_profile(spark, d):
    return profile.volume_profile(bar_imbalance(spark, d))


@query("poc_rolling", "date:d prev_poc_1d:f prev_poc_1w:f prev_poc_4w:f", _with(sql.poc(), "SELECT * FROM poc"))
def poc_rolling(spark, d):
    return profile.rolling_poc(volume_profile(spark, d))


@query("bars_with_poc", "trade_ts:t close:f volume:i prev_poc_1d:f prev_poc_1w:f prev_poc_4w:f", _with(sql.poc(), "SELECT s.trade_ts, s.close, s.volume, poc.* FROM sized s LEFT JOIN poc ON CAST(s.trade_ts AS DATE) = poc.date"))
def bars_with_poc(spark, d):
    return profile.with_poc(bar_imbalance(spark, d))


# joins and windows by time


@query("asof_quotes", "event_id:i symbol trade_ts:t price:f quoted:t bid:f ask:f", """WITH t AS (SELECT event_id, 'c' || user_id % 2 AS symbol, ts AS trade_ts, value AS price FROM events WHERE event_type = 'purchase'),
q AS (SELECT 'c' || user_id % 2 AS symbol, ts AS quoted, arg_max(value * 0.999, event_id) AS bid, arg_max(value * 1.001, event_id) AS ask FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
m AS (SELECT t.*, q.quoted, q.bid, q.ask FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.trade_ts >= q.quoted)
SELECT event_id, symbol, trade_ts, price, CASE WHEN quoted >= trade_ts - INTERVAL 10 MINUTE THEN quoted END AS quoted, CASE WHEN quoted >= trade_ts - INTERVAL 10 MINUTE THEN bid END AS bid, CASE WHEN quoted >= trade_ts - INTERVAL 10 MINUTE THEN ask END AS ask FROM m""")
def asof_quotes(spark, d):
    """Each purchase with the last quote of its contract, if that is at most ten minutes old."""
    rows = load(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("c"), F.col("user_id") % 2).alias("symbol"), F.col("ts").alias("trade_ts"), "value")
    trades = rows.filter("event_type = 'purchase'").select("event_id", "symbol", "trade_ts", F.col("value").alias("price"))
    quotes = rows.filter("event_type in ('view', 'click')").select("symbol", "trade_ts", (F.col("value") * 0.999).alias("bid"), (F.col("value") * 1.001).alias("ask"), F.col("event_id").alias("quote_id"))
    return asof.as_of(trades, quotes, ["symbol"], "trade_ts", tie="quote_id", within="10 minutes").withColumnRenamed("trade_ts_matched", "quoted")


@query("clock_windows", f"{KEY} " + " ".join(f"{x}:f" for x in sql.CLOCK) + " dist_vwap_15m_clock:f", _with(sql.bars(HALF) + ",\n" + sql.clock_frames(), "SELECT * FROM clocked"))
def clock_windows(spark, d):
    """Frames by time over half-minute bars, most of which are missing."""
    return features.clock_features(trade_bars(spark, d, HALF))


# training sets

_SET = ("ret_1m", "ret_5m", "realized_vol_5m", "signed_volume_ratio", "log_vol")
_SET_SQL = sql.bars(FIVE) + ",\n" + sql.base() + ",\n" + sql.label("b8", HORIZON)


def _set(spark, d) -> DataFrame:
    return features.efficiency_label(features.base_features(five(spark, d)), HORIZON)


@query("corpus_stats", "feature mean:f std:f", _with(_SET_SQL, " UNION ALL ".join(f"SELECT '{x}' AS feature, avg({x}) AS mean, CASE WHEN stddev_samp({x}) > 0 THEN stddev_samp({x}) ELSE 1 END AS std FROM labelled" for x in _SET)))
def corpus_stats(spark, d):
    return dataset.feature_stats(_set(spark, d), list(_SET))


_QUANTILE = f"(SELECT x FROM (SELECT {_LABEL} AS x, row_number() OVER (ORDER BY {_LABEL}) - 1 AS r, count(*) OVER () AS n FROM labelled WHERE {_LABEL} IS NOT NULL) WHERE r = round_even((n - 1) * 0.8, 0))"


@query("label_quantile", "threshold:f", _with(_SET_SQL, f"SELECT {_QUANTILE} AS threshold"))
def label_quantile(spark, d):
    return spark.createDataFrame([(dataset.nearest_quantile(_set(spark, d), _LABEL, 0.8),)], "threshold float")


@query("scaled", f"{KEY} " + " ".join(f"{x}:f" for x in _SET), _with(_SET_SQL, "SELECT bar_start_jst, session_date_jst, session_type, " + ", ".join(f"({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () AS {x}" for x in _SET) + " FROM labelled"))
def scaled(spark, d):
    rows = _set(spark, d)
    stats = {r["feature"]: (r["mean"], r["std"]) for r in dataset.feature_stats(rows, list(_SET)).collect()}  # a row a feature
    return dataset.scaled(rows, stats)


@query("binarised", f"{KEY} {_LABEL}:f", _with(_SET_SQL, f"SELECT bar_start_jst, session_date_jst, session_type, CASE WHEN {_LABEL} >= {_QUANTILE} THEN 1 WHEN {_LABEL} IS NOT NULL THEN 0 END AS {_LABEL} FROM labelled"))
def binarised(spark, d):
    rows = _set(spark, d)
    return dataset.binarised(rows, _LABEL, dataset.nearest_quantile(rows, _LABEL, 0.8))


_SEQ = f"list([{', '.join(f'CAST({x} AS DOUBLE)' for x in _SET)}]) {sql.over(sql.DAY, sql.rows(LENGTH))}"
_NULLS = f"sum(CASE WHEN {' OR '.join(f'{x} IS NULL' for x in (*_SET, _LABEL))} THEN 1 ELSE 0 END) {sql.over(sql.DAY, sql.rows(LENGTH))}"


@query("sequences", f"{KEY} steps:i first_ret:f last_vol:f total:f", _with(_SET_SQL + f",\nseq AS (SELECT *, {_SEQ} AS s, {_NULLS} AS spoilt FROM labelled)", "SELECT *, len(s) AS steps, s[1][2] AS first_ret, s[-1][5] AS last_vol, list_sum(list_transform(s, lambda r: r[3])) AS total FROM seq WHERE len(s) = 12 AND spoilt = 0 AND session_type = 'DAY'"))
def sequences(spark, d):
    s = dataset.sequences(_set(spark, d), list(_SET), _LABEL, LENGTH, "DAY")
    at = F.col("sequence")
    return s.withColumns({"steps": F.size(at), "first_ret": at[0][1], "last_vol": at[LENGTH - 1][4], "total": F.aggregate(at, F.lit(0.0), lambda a, r: a + r[2])})


@query("walk_forward", "window:d part date:d", "WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)), w AS (SELECT i AS k FROM d WHERE i + 18 <= n)\nSELECT (SELECT date FROM d f WHERE f.i = w.k + 15) AS \"window\", CASE WHEN d.i - w.k < 10 THEN 'train' WHEN d.i - w.k < 15 THEN 'valid' ELSE 'test' END AS part, d.date AS date FROM w JOIN d ON d.i BETWEEN w.k AND w.k + 17")
def walk_forward(spark, d):
    return dataset.walk_forward(load(spark, d, "events").select(F.to_date("ts").alias("session_date_jst")), 10, 5, 3)


@query("long_enough", "session_date_jst:d n:i", _with(sql.bars(FIVE), "SELECT session_date_jst, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) > 100"))
def long_enough(spark, d):
    return dataset.long_enough(five(spark, d), 100).groupBy("session_date_jst").agg(F.count("*").alias("n"))


# scores

_SCORED = "WITH scored AS (SELECT round(n_chars / 20000.0, 3) AS prob, quality AS label FROM documents JOIN labels USING (doc_id))"


def _quality(spark, d) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / 20000.0, 3).alias("prob")).join(load(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query("percentile_threshold", "threshold:f", f"{_SCORED}\nSELECT CASE WHEN count(prob) >= 5 THEN quantile_cont(prob, 0.8) ELSE 0.5 END AS threshold FROM scored")
def percentile_threshold(spark, d):
    return spark.createDataFrame([(score.percentile_threshold(_quality(spark, d)),)], "threshold double")


@query("roc_auc", "auc:f", f"{_SCORED}, r AS (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r FROM scored)\nSELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r")
def roc_auc(spark, d):
    return score.roc_auc(_quality(spark, d))


@query("lift", "threshold:f edge:f", f"{_SCORED}, t AS (SELECT quantile_cont(prob, 0.8) AS threshold FROM scored)\nSELECT max(threshold) AS threshold, (avg(label) FILTER (prob >= threshold) - avg(label)) * 100 AS edge FROM scored, t")
def lift(spark, d):
    return score.precision_lift(_quality(spark, d))


_WEIGHTS = {"ret_1m": 0.8, "signed_volume_ratio": 1.2, "log_vol": 0.3}
_LOGIT = " + ".join(f"{w} * {x}" for x, w in _WEIGHTS.items())


@query("linear_scores", f"{KEY} prob:f", _with(_SET_SQL, f"SELECT *, CAST(1 / (1 + exp(-({_LOGIT} - 0.5))) AS FLOAT) AS prob FROM labelled"))
def linear_scores(spark, d):
    return score.linear_scores(_set(spark, d), _WEIGHTS, -0.5)


@query("score_by_session", f"{KEY} prob:f", _with(_SET_SQL, "SELECT *, CAST(CASE session_type WHEN 'DAY' THEN 1 / (1 + exp(-(0.2 + 0.5 * log_vol))) ELSE 1 / (1 + exp(-(-0.1 + 0.9 * signed_volume_ratio))) END AS FLOAT) AS prob FROM labelled"))
def score_by_session(spark, d):
    return score.score_by_session(_set(spark, d), {"DAY": {"bias": 0.2, "log_vol": 0.5}, "NIGHT": {"bias": -0.1, "signed_volume_ratio": 0.9}})


# signals, their outcomes and reports

_SIM = """raw AS (SELECT bar_start_jst, session_date_jst, session_type, open AS raw_open, high AS raw_high, low AS raw_low, close AS raw_close, CAST((tick_count * 37 + CAST(volume AS BIGINT) * 11) % 100 / 100.0 AS FLOAT) AS prob FROM bars),
signals AS (SELECT *, raw_close - lag(raw_close, 4) OVER (PARTITION BY session_date_jst, session_type ORDER BY bar_start_jst) AS momentum, coalesce(CAST(prob AS FLOAT) - lag(prob, 2) OVER (PARTITION BY session_date_jst, session_type ORDER BY bar_start_jst), 0) AS prob_rise FROM raw)"""


def _signals(made: DataFrame, *more: str) -> DataFrame:
    prob = ((F.col("tick_count") * 37 + F.col("volume").cast("long") * 11) % 100 / 100.0).cast("float")
    raw = made.select(*more, "bar_start_jst", "session_date_jst", "session_type", *[F.col(x).alias(f"raw_{x}") for x in ("open", "high", "low", "close")], prob.alias("prob"), F.lit(0.0).cast("float").alias("threshold"))
    return score.with_signals(raw, 4, 2)


@query("momentum", f"{KEY} momentum:f", _with(sql.bars(FIVE) + ",\n" + _SIM, "SELECT * FROM signals"))
def momentum(spark, d):
    return _signals(five(spark, d))


@query("prob_rise", f"{KEY} prob:f prob_rise:f", _with(sql.bars(FIVE) + ",\n" + _SIM, "SELECT * FROM signals"))
def prob_rise(spark, d):
    return _signals(five(spark, d))


#: Score, points of stop and target, bars held.
_BET = outcomes.Bet(threshold=0.6, stop=60.0, target=125.0, hold=24)


@query("signal_outcomes", f"{KEY} entry_time:t exit_time:t direction entry_price:f exit_price:f pnl:f reason", _with(sql.bars(FIVE) + ",\n" + _SIM + ",\n" + sql.outcomes(_BET), "SELECT * FROM outcomes"))
def signal_outcomes(spark, d):
    return outcomes.signal_outcomes(_signals(five(spark, d)), _BET)


#: Seconds for which a signal looks at trades after its bar.
_LOOK = 1800


@query("signal_trades", "bar_start_jst:t n:i volume:i low:f high:f first:f", _with(sql.bars(FIVE) + ",\n" + _SIM + f",\nspans AS (SELECT bar_start_jst, bar_start_jst + INTERVAL 300 SECOND AS a, bar_start_jst + INTERVAL {300 + _LOOK} SECOND AS b FROM signals WHERE CAST(prob AS DOUBLE) >= 0.3)", "SELECT bar_start_jst, count(*) AS n, sum(trade_volume) AS volume, min(price) AS low, max(price) AS high, arg_min(price, (trade_ts, sequence_no)) AS first FROM spans JOIN sided ON trade_ts >= a AND trade_ts < b GROUP BY 1"))
def signal_trades(spark, d):
    """What was traded in the half hour after each signal's bar."""
    start = F.col("bar_start_jst")
    spans = _signals(five(spark, d)).filter(F.col("prob").cast("double") >= 0.3).select(F.lit("nk225").alias("symbol"), "bar_start_jst", (start + F.expr("INTERVAL 300 SECONDS")).alias("from_ts"), (start + F.expr(f"INTERVAL {300 + _LOOK} SECONDS")).alias("to_ts"))
    met = asof.inside(normalised_ticks(spark, d), spans, ["symbol"], "trade_ts", "from_ts", "to_ts", _LOOK)
    return met.groupBy("bar_start_jst").agg(F.count("*").alias("n"), F.sum("trade_volume").alias("volume"), F.min("price").alias("low"), F.max("price").alias("high"), F.min_by("price", F.struct("trade_ts", "sequence_no")).alias("first"))


# many symbols at once: each is a series of its own, and (symbol, date) the unit of work


def many_five(spark, d) -> DataFrame:
    return settled(bars.trade_bars(ticks.normalised(many_ticks(spark, d)), FIVE))


@query("many_bars", BAR, _with(sql.by_symbol(sql.bars(HALF)), "SELECT * FROM bars"))
def many_bars(spark, d):
    return bars.trade_bars(ticks.normalised(many_ticks(spark, d)), HALF)


@query("many_features", f"symbol {KEY} {_LABEL}:f " + " ".join(f"{x}:f" for x in _FRAME), _with(sql.by_symbol(_FINAL), "SELECT * FROM final"))
def many_features(spark, d):
    return features.feature_frame(many_five(spark, d), outside(spark, d), SYMBOLS, HORIZON)


@query("many_outcomes", f"symbol {KEY} entry_time:t exit_time:t direction entry_price:f exit_price:f pnl:f reason", _with(sql.by_symbol(sql.bars(FIVE) + ",\n" + _SIM + ",\n" + sql.outcomes(_BET)), "SELECT * FROM outcomes"))
def many_outcomes(spark, d):
    return outcomes.signal_outcomes(_signals(many_five(spark, d), "symbol"), _BET)


@query("many_pocs", "symbol date:d prev_poc_1d:f prev_poc_1w:f prev_poc_4w:f", _with(sql.by_symbol(sql.poc()), "SELECT * FROM poc"))
def many_pocs(spark, d):
    return profile.rolling_poc(profile.volume_profile(settled(bars.size_bars(ticks.normalised(many_ticks(spark, d)), FIVE))))


#: Orders as trades, so that reports have as many rows as the tables have.
_TRADES = "WITH trades AS (SELECT o_orderkey, o_orderdate AS exit_time, round(o_totalprice - 150000, 2) AS pnl, CASE o_orderkey % 5 WHEN 0 THEN 'TP' WHEN 1 THEN 'SL' WHEN 2 THEN 'SESSION' WHEN 3 THEN 'TIME' ELSE 'WEAK' END AS reason, o_custkey % 7 AS mfe_ticks FROM orders)"


def _trades(spark, d) -> DataFrame:
    reason = F.element_at(F.array(*[F.lit(x) for x in ("TP", "SL", "SESSION", "TIME", "WEAK")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("exit_time"), F.round(F.col("o_totalprice") - 150000, 2).alias("pnl"), reason.alias("reason"), (F.col("o_custkey") % 7).alias("mfe_ticks"))


@query("trade_totals", "n_trades:i n_wins:i n_losses:i gross_profit:f gross_loss:f net:f win_rate:f profit_factor:f", f"{_TRADES}, s AS (SELECT count(*) AS n_trades, count(*) FILTER (pnl > 0) AS n_wins, count(*) FILTER (pnl <= 0) AS n_losses, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gross_profit, coalesce(abs(sum(pnl) FILTER (pnl <= 0)), 0) AS gross_loss, coalesce(sum(pnl), 0) AS net FROM trades)\nSELECT *, n_wins * 100.0 / n_trades AS win_rate, CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss ELSE CAST('inf' AS DOUBLE) END AS profit_factor FROM s")
def trade_totals(spark, d):
    return report.totals(_trades(spark, d))


_CURVE = f"{_TRADES}, curve AS (SELECT *, sum(pnl) OVER (ORDER BY exit_time, o_orderkey ROWS UNBOUNDED PRECEDING) AS equity FROM trades), high AS (SELECT *, max(equity) OVER (ORDER BY exit_time, o_orderkey ROWS UNBOUNDED PRECEDING) AS high FROM curve)"


@query("drawdown", "max_drawdown:f", f"{_CURVE}\nSELECT max(high - equity) AS max_drawdown FROM high")
def drawdown(spark, d):
    return report.max_drawdown(_trades(spark, d), ("exit_time", "o_orderkey"))


@query("equity_curve", "o_orderkey:i equity:c", f"{_CURVE}\nSELECT * FROM curve")
def equity_curve(spark, d):
    return report.equity_curve(_trades(spark, d), ("exit_time", "o_orderkey"))


@query("by_reason", "reason n:i win_rate:f net:f place:i", f"{_TRADES}\nSELECT reason, count(*) AS n, count(*) FILTER (pnl > 0) * 100.0 / count(*) AS win_rate, sum(pnl) AS net, list_position(['TP', 'SESSION', 'SL', 'TIME', 'WEAK'], reason) AS place FROM trades GROUP BY 1")
def by_reason(spark, d):
    return report.by_reason(_trades(spark, d))


@query("mfe", "mean_mfe:f n_with_mfe:i", f"{_TRADES}\nSELECT avg(mfe_ticks) AS mean_mfe, count(*) FILTER (mfe_ticks >= 1) AS n_with_mfe FROM trades")
def mfe(spark, d):
    return report.excursions(_trades(spark, d))


@query("model_lookup", "window:d session edge:f threshold:f", "WITH w AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS \"window\" FROM orders), m AS (SELECT CAST(o_orderdate AS DATE) AS \"window\", o_orderpriority AS session, avg(o_totalprice) / 1000 - 240 AS edge, round(min(o_totalprice) / 500000, 4) AS t FROM orders GROUP BY 1, 2)\nSELECT w.\"window\", session, edge, CASE WHEN t > 0 THEN t ELSE 0.82 END AS threshold FROM w JOIN m USING (\"window\") WHERE edge > 10")
def model_lookup(spark, d):
    records = load(spark, d, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_orderpriority").alias("session")).agg((F.avg("o_totalprice") / 1000 - 240).alias("edge"), F.round(F.min("o_totalprice") / 500000, 4).alias("prob_threshold"))
    return registry.runnable(load(spark, d, "orders").select(F.to_date("o_orderdate").alias("window")), records, 0.82, 10)


# files: tables are written in a layout of the vendors or of the engine, and read again


def _vendor_layout(spark, d, date_name: str) -> DataFrame:
    """Events as a vendor's texts: times lose leading zeros, names are in capitals."""
    t = vendor_ticks(spark, d)
    return t.select(
        F.col("trade_date").alias("TRADE_DATE"),
        F.col("execution_date").alias(date_name),
        F.date_format("trade_ts", "HHmmssSSS").cast("long").alias("TIME"),
        F.col("price").alias("TRADE_PRICE"),
        F.col("trade_volume").alias("TRADE_VOLUME"),
        F.col("contract_month").alias("CONTRACT_MONTH"),
        F.col("price_type").alias("PRICE_TYPE"),
        F.col("sequence_no").alias("NO"),
    )


_FILED = sql.TICKS.replace("ts AS trade_ts", "date_trunc('milliseconds', ts) AS trade_ts")
_TICK = "session_date_jst:d session_type trade_date trade_ts:t contract_code sequence_no:i price:f trade_volume:i direction:i buy_vol:i sell_vol:i symbol"
_TICK_SQL = f"SELECT *, {sql.clock('trade_ts')} AS session_type, CAST(contract_month AS VARCHAR) AS contract_code, 'nk225' AS symbol FROM sided"


@query("vendor_files", _TICK, _with(_FILED, _TICK_SQL))
def vendor_files(spark, d):
    """Half of the dates in comma-separated files, half in gzipped tab-separated ones with other names."""
    at, odd = shared_folder(spark), F.col("TRADE_DATE").cast("int") % 2 == 1
    _vendor_layout(spark, d, "EXECUTION_DATE").filter(odd).write.option("header", True).csv(f"{at}/comma")
    drifted = _vendor_layout(spark, d, "MAKE_DATE").filter(~odd)
    drifted.toDF(*[x.lower() for x in drifted.columns]).write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(f"{at}/tab")
    return vendor.read_ticks(spark, [f"{at}/comma", f"{at}/tab"], "nk225")


@query("vendor_mixed", _TICK, _with(_FILED, _TICK_SQL))
def vendor_mixed(spark, d):
    """One tree of folders in which names, their order, separators and compression change from date to date."""
    at, which = shared_folder(spark), F.col("TRADE_DATE").cast("int") % 4
    rows = _vendor_layout(spark, d, "EXECUTION_DATE")
    small = rows.toDF(*[x.lower() for x in rows.columns])
    turned = small.select(*reversed(small.columns)).withColumnRenamed("execution_date", "make_date")
    dated = small.drop("execution_date").withColumn("sco_category", F.lit(0))  # the trade date is its execution date
    for i, (part, folder, mark, packed) in enumerate(((rows, "2024/a", ",", "none"), (turned, "2024/b", ",", "gzip"), (dated, "2024/b/c", "\t", "none"), (turned, "d", "\t", "gzip"))):
        part.filter(which == i).write.option("header", True).option("sep", mark).option("compression", packed).csv(f"{at}/tree/{folder}/{i}")
    return vendor.read_ticks(spark, [f"{at}/tree", f"{at}/tree/d"], "nk225")


@query("row_numbers", "trade_date sequence_no:i trade_ts:t price:f", _with(_FILED, "SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY t.trade_ts, sequence_no) AS sequence_no, t.trade_ts, price FROM ticks t"))
def row_numbers(spark, d):
    """A file for each date, in order and without numbers: lines are numbered as they stand in their file."""
    at = shared_folder(spark)
    rows = _vendor_layout(spark, d, "EXECUTION_DATE")
    dealt = rows.withColumn("day", F.col("TRADE_DATE")).repartition("day").sortWithinPartitions("day", "TIME", "NO")
    dealt.drop("NO").write.partitionBy("day").option("header", True).csv(f"{at}/days")
    return vendor.typed_ticks(vendor.fields(spark, [f"{at}/days"]))


@query("legacy_files", "trade_date execution_date trade_ts:t contract_month:i sequence_no:i price_type sco_category:i price:f trade_volume:i", _with(_FILED, "SELECT *, trade_date AS execution_date, 0 AS sco_category FROM ticks"))
def legacy_files(spark, d):
    at = shared_folder(spark)
    _vendor_layout(spark, d, "MAKE_DATE").write.option("header", True).option("sep", "\t").csv(f"{at}/legacy")
    return vendor.read_legacy_ticks(spark, [f"{at}/legacy"])


@query("quote_files", "trade_ts:t calendar_date_jst:d symbol bid:f ask:f mid:f spread:f", "\nSELECT t AS trade_ts, CAST(t AS DATE) AS calendar_date_jst, symbol, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread FROM (SELECT date_trunc('milliseconds', ts) AT TIME ZONE 'EET' AT TIME ZONE 'Asia/Tokyo' AS t, event_type AS symbol, value * 0.999 AS bid, value * 1.001 AS ask FROM events)")
def quote_files(spark, d):
    at = shared_folder(spark)
    rows = load(spark, d, "events").select(F.col("event_type").alias("symbol"), F.year("ts").alias("year"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"), (F.col("value") * 0.999).alias("bid"), (F.col("value") * 1.001).alias("ask"))
    rows.write.partitionBy("symbol", "year").option("sep", "\t").option("header", True).csv(f"{at}/quotes")
    return vendor.read_quotes(spark, f"{at}/quotes/*/*")


@query("daily_ticks", f"{_TICK} year:i", _with(sql.TICKS, _TICK_SQL.replace("SELECT *,", "SELECT *, year(session_date_jst) AS year,")))
def daily_ticks(spark, d):
    at = shared_folder(spark)
    made = ticks.normalised(vendor_ticks(spark, d), "nk225")
    sinks.by_date(made, f"{at}/ticks")
    return sinks.read_dates(spark, f"{at}/ticks", made)


@query("daily_bars", f"{BAR} year:i", _with(sql.bars(FIVE), "SELECT *, year(session_date_jst) AS year FROM bars"))
def daily_bars(spark, d):
    """Written twice, the second time the later dates alone: their partitions are replaced, the others stay."""
    at, made = shared_folder(spark), five(spark, d)
    for part in (made, registry.in_dates(made, "2024-01-15")):
        sinks.by_date(part, f"{at}/bars", ("bar_start_jst",))
    return sinks.read_dates(spark, f"{at}/bars", made)


@query("external_partitions", f"{KEY} symbol open:f high:f low:f close:f spread_close:f tick_count:i", _with(sql.quote_bars(FIVE), "SELECT * FROM ext WHERE symbol IN ('view', 'signup')"))
def external_partitions(spark, d):
    """Two symbols of a table that is partitioned by symbol, year and date: the others' folders aren't read."""
    at = shared_folder(spark)
    made = external_bars(spark, d, FIVE)
    sinks.by_date(made, f"{at}/external", ("bar_start_jst",), ("symbol",))
    return sinks.read_dates(spark, f"{at}/external", made).filter(F.col("symbol").isin("view", "signup"))


def _halves(df: DataFrame, time_col: str) -> list[tuple[str, DataFrame]]:
    """A table as two deliveries: mornings come late."""
    late = F.hour(time_col) < 12
    return [("first", df.filter(~late)), ("late", df.filter(late))]


@query("late_bars", f"{BAR} year:i", _with(sql.bars(FIVE), "SELECT *, year(session_date_jst) AS year FROM bars"))
def late_bars(spark, d):
    """Bars of files that arrive one after the other: a late one's rows are merged into dates that are written."""
    at = shared_folder(spark)
    for name, part in _halves(normalised_ticks(spark, d), "trade_ts"):
        made = bars.bars_of_segments(sinks.merged(spark, bars.trade_segments(part, FIVE), f"{at}/segments", name), FIVE)
        sinks.by_date(made, f"{at}/bars", ("bar_start_jst",))
    return sinks.read_dates(spark, f"{at}/bars", made)


@query("late_externals", f"{KEY} symbol open:f high:f low:f close:f spread_close:f tick_count:i", _with(sql.quote_bars(FIVE), "SELECT * FROM ext"))
def late_externals(spark, d):
    """As late_bars, of quotes; a delivery that comes twice counts once."""
    at = shared_folder(spark)
    parts = _halves(adapters.quotes(spark, d), "trade_ts")
    for name, part in [*parts, parts[-1]]:
        made = bars.mid_bars_of_segments(sinks.merged(spark, bars.quote_segments(part, FIVE), f"{at}/segments", name), FIVE)
        sinks.by_date(made, f"{at}/bars", ("bar_start_jst",), ("symbol",))
    return sinks.read_dates(spark, f"{at}/bars", made)


@query("monthly_ticks", "period sequence_no:i trade_ts:t price:f", _with(sql.TICKS, "SELECT *, strftime(trade_ts, '%Y%m') AS period FROM ticks"))
def monthly_ticks(spark, d):
    at = shared_folder(spark)
    sinks.by_month(vendor_ticks(spark, d), f"{at}/months")
    return spark.read.parquet(f"{at}/months").withColumn("period", F.col("period").cast("string"))


@query("model_records", "date session edge:f prob_threshold:f", "\nSELECT * FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS session, round_even(avg(o_totalprice) / 1000 - 240, 2) AS edge, round_even(min(o_totalprice) / 500000, 4) AS prob_threshold FROM orders GROUP BY 1, 2) WHERE edge > 10")
def model_records(spark, d):
    at = shared_folder(spark)
    made = load(spark, d, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_orderpriority").alias("session")).agg((F.avg("o_totalprice") / 1000 - 240).alias("edge"), (F.min("o_totalprice") / 500000).alias("prob_threshold"))
    sinks.write_records(made, f"{at}/records")
    return sinks.read_records(spark, f"{at}/records", 10)


@query("weekly_quotes", "symbol week_start timestamp bid:f ask:f", "\nSELECT event_type AS symbol, strftime(date_trunc('week', ts), '%Y%m%d') AS week_start, strftime(date_trunc('milliseconds', ts), '%Y-%m-%d %H:%M:%S.%g') AS timestamp, value * 0.999 AS bid, value * 1.001 AS ask FROM events")
def weekly_quotes(spark, d):
    """A stream of quotes to weekly files, read again."""
    at = shared_folder(spark)
    rows = load(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("timestamp"), (F.col("value") * 0.999).alias("bid"), (F.col("value") * 1.001).alias("ask"))
    rows.write.parquet(f"{at}/arriving")
    live = spark.readStream.schema(rows.schema).parquet(f"{at}/arriving")
    jobs.weekly_quote_sink(live, f"{at}/weeks", f"{at}/progress").awaitTermination()
    return spark.read.schema("timestamp string, bid double, ask double, symbol string, week_start string").option("sep", "\t").option("header", True).csv(f"{at}/weeks")


@query("date_range", "session_date_jst:d n:i", _with(sql.bars(FIVE), "SELECT session_date_jst, count(*) AS n FROM bars WHERE session_date_jst BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' GROUP BY 1"))
def date_range(spark, d):
    return registry.in_dates(five(spark, d), "2024-01-08", "2024-01-12").groupBy("session_date_jst").agg(F.count("*").alias("n"))


@query("streaming_bars", "bar_start:t symbol open:f high:f low:f close:f volume:i tick_count:i", _with(sql.TICKS, "SELECT time_bucket(INTERVAL '3600 seconds', t.trade_ts) AS bar_start, CAST(contract_month AS VARCHAR) AS symbol, arg_min(price, (t.trade_ts, sequence_no)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t.trade_ts, sequence_no)) AS close, sum(trade_volume) AS volume, count(*) AS tick_count FROM ticks t GROUP BY 1, 2"))
def streaming_bars(spark, d):
    rows = vendor_ticks(spark, d).select(F.col("trade_ts").cast("timestamp").alias("trade_ts"), F.col("contract_month").cast("string").alias("symbol"), "sequence_no", "price", "trade_volume")
    return jobs.streaming_bars(rows, HOUR)


def _arriving(spark, d) -> DataFrame:
    """Ticks as a stream has them: with zoned times."""
    return vendor_ticks(spark, d).select("sequence_no", F.col("trade_ts").cast("timestamp").alias("trade_ts"), F.col("contract_month").cast("string").alias("symbol"), "price", "trade_volume")


def _run(stream: DataFrame, at: str, name: str) -> None:
    """What has arrived, to the table {at}/{name}; the next run goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/progress/{name}").trigger(availableNow=True).start().awaitTermination()


def _slices(rows: DataFrame, time_col: str, n: int) -> list[DataFrame]:
    """Rows in n deliveries, one after the other in time."""
    low, high = rows.agg(F.min(F.unix_micros(time_col)), F.max(F.unix_micros(time_col))).first()
    part = F.least(F.lit(n - 1), F.floor((F.unix_micros(time_col) - F.lit(low)) * n / F.lit(max(1, (high or 0) - (low or 0)))))
    return [rows.filter(part == i) for i in range(n)]


@query("live_bars", "bar_start:t symbol open:f high:f low:f close:f volume:i tick_count:i", _with(sql.TICKS, "SELECT time_bucket(INTERVAL '3600 seconds', t.trade_ts) AS bar_start, CAST(contract_month AS VARCHAR) AS symbol, arg_min(price, (t.trade_ts, sequence_no)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t.trade_ts, sequence_no)) AS close, sum(trade_volume) AS volume, count(*) AS tick_count FROM ticks t GROUP BY 1, 2 HAVING bar_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"))
def live_bars(spark, d):
    """A stream of ticks that is stopped and started again twice: the bars that its watermark has passed."""
    at, rows, other = shared_folder(spark), _arriving(spark, d), jobs.live(spark)
    for part in _slices(rows, "trade_ts", 3):
        part.write.mode("append").parquet(f"{at}/arriving")
        _run(jobs.streaming_bars(other.readStream.schema(rows.schema).parquet(f"{at}/arriving"), HOUR), at, "bars")
    return spark.read.schema(jobs.streaming_bars(rows).schema).parquet(f"{at}/bars")


def _bursts_sql(rows: str, having: str = "") -> str:
    return f"""marked AS (SELECT *, CASE WHEN trade_ts - lag(trade_ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM {rows} WINDOW w AS (PARTITION BY contract_month ORDER BY trade_ts, sequence_no)),
counted AS (SELECT *, sum(fresh) OVER (PARTITION BY contract_month ORDER BY trade_ts, sequence_no ROWS UNBOUNDED PRECEDING) AS k FROM marked),
bursts AS (SELECT min(trade_ts) AS begins, max(trade_ts) AS ends, CAST(contract_month AS VARCHAR) AS symbol, count(*) AS n, sum(trade_volume) AS volume, min(price) AS low, max(price) AS high FROM counted GROUP BY contract_month, k{having})"""


@query("bursts", "begins:t ends:t symbol n:i volume:i low:f high:f", _with(sql.TICKS + ",\n" + _bursts_sql("ticks"), "SELECT * FROM bursts"))
def bursts(spark, d):
    return jobs.bursts(_arriving(spark, d))


_LATE = "sequence_no % 50 = 0 AND trade_ts < (SELECT min(ts) + INTERVAL 5 DAY FROM events)"


@query("late_bursts", "kind begins:t symbol n:i volume:i", _with(sql.TICKS + f",\nin_time AS (SELECT * FROM ticks WHERE NOT ({_LATE})),\n" + _bursts_sql("in_time", " HAVING max(trade_ts) + INTERVAL 10 MINUTE <= (SELECT max(trade_ts) FROM in_time) - INTERVAL 1 DAY") + f",\nsaid AS (SELECT 'burst' AS kind, begins, symbol, n, volume FROM bursts UNION ALL SELECT 'late', NULL, CAST(contract_month AS VARCHAR), count(*), sum(trade_volume) FROM ticks WHERE {_LATE} GROUP BY 3)", "SELECT * FROM said"))
def late_bursts(spark, d):
    """Bursts of a stream in several batches, the last delivery being old ticks: they are set aside, not dropped."""
    at, rows, other = shared_folder(spark), _arriving(spark, d), jobs.live(spark)
    first = rows.agg(F.min("trade_ts")).first()[0]
    old = (F.col("sequence_no") % 50 == 0) & (F.col("trade_ts") < F.lit(first) + F.expr("INTERVAL 5 DAYS"))
    stream = lambda path: other.readStream.schema(rows.schema).parquet(path)
    for part in [*_slices(rows.filter(~old), "trade_ts", 3), rows.filter(old)]:
        part.write.mode("append").parquet(f"{at}/arriving")
        jobs.set_late_aside(stream(f"{at}/arriving"), f"{at}/sorted", f"{at}/progress/sorted", "1 day").awaitTermination()
        _run(jobs.bursts(stream(f"{at}/sorted/in_time/*"), late="1 day"), at, "bursts")
    late = spark.read.schema(rows.schema).parquet(f"{at}/sorted/late").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("trade_volume").alias("volume"))
    told = spark.read.schema(jobs.bursts(rows).schema).parquet(f"{at}/bursts").select(F.lit("burst").alias("kind"), "begins", "symbol", "n", "volume")
    return told.unionByName(late.withColumn("kind", F.lit("late")), allowMissingColumns=True)


@query("restarted_quotes", "symbol week_start timestamp bid:f ask:f", "\nSELECT DISTINCT event_type AS symbol, strftime(date_trunc('week', ts), '%Y%m%d') AS week_start, strftime(date_trunc('milliseconds', ts), '%Y-%m-%d %H:%M:%S.%g') AS timestamp, value * 0.999 AS bid, value * 1.001 AS ask FROM events")
def restarted_quotes(spark, d):
    """A stream of quotes, stopped and started again over files that repeat a part of what it has written."""
    at, other = shared_folder(spark), jobs.live(spark)
    rows = load(spark, d, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("timestamp"), (F.col("value") * 0.999).alias("bid"), (F.col("value") * 1.001).alias("ask"))
    parts = _slices(rows, "timestamp", 4)
    for some in (parts[:3], parts[2:]):
        for part in some:
            part.write.mode("append").parquet(f"{at}/arriving")
        quotes = other.readStream.schema(rows.schema).parquet(f"{at}/arriving")
        jobs.weekly_quote_sink(jobs.quotes_once(quotes), f"{at}/weeks", f"{at}/progress").awaitTermination()
    return spark.read.schema("timestamp string, bid double, ask double, symbol string, week_start string").option("sep", "\t").option("header", True).csv(f"{at}/weeks")


# totals by levels, sketches, tables that are dealt alike


@query("level_totals", "level:i session_date_jst:d session_type symbol n:i volume:i low:f high:f", _with(sql.TICKS + f",\nrows AS (SELECT session_date_jst, {sql.clock('trade_ts')} AS session_type, CAST(contract_month AS VARCHAR) AS symbol, trade_volume, price FROM ticks)", "SELECT grouping(session_date_jst, session_type, symbol) AS level, session_date_jst, session_type, symbol, count(*) AS n, sum(trade_volume) AS volume, min(price) AS low, max(price) AS high FROM rows GROUP BY GROUPING SETS ((session_date_jst, session_type, symbol), (session_date_jst, session_type), (session_date_jst), (symbol), ())"))
def level_totals(spark, d):
    rows = vendor_ticks(spark, d).select(clock.vendor_date(F.col("trade_date")).alias("session_date_jst"), clock.session_type(F.col("trade_ts")).alias("session_type"), F.col("contract_month").cast("string").alias("symbol"), "trade_volume", "price")
    return rollup.totals(rows)


@query("weekly_sketches", "week:d n:i users:i users_within median_within", "\nSELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS median_within FROM events GROUP BY 1")
def weekly_sketches(spark, d):
    """Daily sketches, written and merged by week, held against exact counts: distinct users within three errors, the
    median within 3.3 % of ranks."""
    at = shared_folder(spark)
    rows = load(spark, d, "events").select(F.to_date("ts").alias("session_date_jst"), "user_id", "value")
    made = rollup.daily_sketches(rows, "user_id", "value")
    sinks.by_date(made, f"{at}/days", ())
    days = sinks.read_dates(spark, f"{at}/days", made).withColumn("week", clock.week_start(F.col("session_date_jst")))
    merged = rollup.merged_sketches(days, "week")
    exact = rows.withColumn("week", clock.week_start(F.col("session_date_jst"))).join(merged.select("week", "q50"), "week")
    told = exact.groupBy("week").agg(F.count_distinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("q50")).cast("double")).alias("rank"))
    error = 3 * 1.04 / 2 ** (rollup.HLL / 2)
    within = F.abs(F.col("about_who") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * error)
    return merged.join(told, "week").select("week", "n", "users", within.alias("users_within"), (F.abs(F.col("rank") - 0.5) <= 0.033).alias("median_within"))


@query("copartitioned_join", f"{KEY} close:f {_CARRIED}", _with(_JOINED, "SELECT * FROM joined"))
def copartitioned_join(spark, d):
    """As external_join, of tables that are dealt by the bar: they meet without an exchange."""
    keys = ["bar_start_jst", "session_date_jst", "session_type"]
    one, two = (tables.bucketed(x, keys, 8) for x in (five(spark, d), external_bars(spark, d, FIVE)))
    return features.join_externals(one, two, SYMBOLS)


@query("feature_partitions", f"{KEY} {_LABEL}:f " + " ".join(f"{x}:f" for x in _FRAME), _with(_FINAL, "SELECT * FROM final WHERE session_date_jst BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'"))
def feature_partitions(spark, d):
    """The feature frame written by date, and some dates of it read again: the other folders aren't."""
    at = shared_folder(spark)
    made = finalize(spark, d)
    sinks.by_date(made, f"{at}/features", ("bar_start_jst",))
    return registry.in_dates(sinks.read_dates(spark, f"{at}/features", made), "2024-01-08", "2024-01-12")


@query("prepared_set", f"{KEY} {_LABEL}:f " + " ".join(f"{x}:f" for x in _SET), _with(_SET_SQL, "SELECT bar_start_jst, session_date_jst, session_type, " + ", ".join(f"({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () AS {x}" for x in _SET) + f", CASE WHEN {_LABEL} >= {_QUANTILE} THEN 1 WHEN {_LABEL} IS NOT NULL THEN 0 END AS {_LABEL} FROM labelled"))
def prepared_set(spark, d):
    return dataset.prepared(_set(spark, d), list(_SET), _LABEL, 0.8)


@query("path_periods", "period date n:i", "\nSELECT strftime(ts, '%Y%m') AS period, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1, 2")
def path_periods(spark, d):
    """What file names tell, of as many names as there are events."""
    t = F.col("ts")
    path = lambda stem, end: F.concat(F.lit("file:/data/NK225/"), F.year(t), F.lit("/"), stem, F.lit(end))
    named = load(spark, d, "events").select(vendor.from_path(path(F.concat(F.lit("future_tick_"), F.date_format(t, "yyyyMM")), ".tsv.gz"), "period").alias("period"), vendor.from_path(path(F.date_format(t, "yyyy-MM-dd"), ".parquet"), "date").alias("date"))
    return named.groupBy("period", "date").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to ticks to hourly bars to session features."""
    return features.base_features(trade_bars(spark, sf_dir, HOUR)).select("bar_start_jst", "session_date_jst", "session_type", "open", "high", "low", "close", "volume", "tick_count", "vwap_30s", "signed_volume", "log_ret", "ret_1m", "realized_vol_5m", "session_vwap")
