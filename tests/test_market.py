"""Hand-made cases of the market operators, each with its literal result."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import blocks, clock
from tickloom.functions.scalars import change_share, filled_forward, floored, log1p_or_null, padded, ratio
from tickloom.functions.scope import session
from tickloom.operators import bars, dataset, features, outcomes, profile, report, score, ticks

T0 = dt.datetime(2024, 1, 5, 9, 0)


def values(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


# ticks


def tick_rows(spark, rows):
    """(trade_date, seconds, sequence_no, price, contract, price_type) rows."""
    full = [(d, T0 + dt.timedelta(seconds=s), n, float(p), 10, c, k) for d, s, n, p, c, k in rows]
    return spark.createDataFrame(full, "trade_date string, trade_ts timestamp_ntz, sequence_no long, price double, trade_volume long, contract_month int, price_type string")


def test_tick_rule_restarts_each_date(spark):
    rows = [("20240105", i, i, p, 202403, "N") for i, p in enumerate([100, 101, 101, 100, 100])] + [("20240106", 9, 9, 100, 202403, "N")]
    got = ticks.with_direction(tick_rows(spark, rows)).orderBy("trade_date", "trade_ts")
    assert values(got, "direction") == [0, 1, 1, -1, -1, 0]
    assert values(got, "buy_vol", "sell_vol") == [(0, 0), (10, 0), (10, 0), (0, 10), (0, 10), (0, 0)]


def test_near_contract_is_chosen_before_the_price_type(spark):
    rows = [("20240105", 1, 1, 5, 202403, "X"), ("20240105", 2, 2, 6, 202406, "N"), ("20240106", 1, 3, 7, 202406, "N")]
    got = ticks.regular(ticks.near_contract(tick_rows(spark, rows)))
    assert values(got, "sequence_no") == [3]


def test_rule_equals_a_loop(spark):
    rnd = random.Random(1)
    rows = [("20240105", i // 2, i, rnd.randint(98, 102), 202403, "N") for i in range(200)]
    got = values(ticks.with_direction(tick_rows(spark, rows)).orderBy("sequence_no"), "direction")
    want, last, before = [], 0, None
    for r in rows:
        if before is not None and r[3] != before:
            last = 1 if r[3] > before else -1
        before = r[3]
        want.append(last)
    assert got == want


# bars


def test_equal_times_open_and_close_by_sequence(spark):
    rows = [("20240105", 3, 2, 11, 202403, "N"), ("20240105", 3, 3, 12, 202403, "N"), ("20240105", 3, 1, 10, 202403, "N")]
    full = tick_rows(spark, rows).withColumns({"execution_date": F.col("trade_date"), "sco_category": F.lit(0)})
    bar = bars.trade_bars(ticks.normalised(full, "nk")).first()
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["tick_count"], bar["volume"]) == (10, 12, 10, 12, 3, 30)
    assert bar["bar_end_jst"] - bar["bar_start_jst"] == dt.timedelta(seconds=30)
    assert bar["vwap_30s"] == 11 and bar["signed_volume"] == 20 and bar["bid_close"] is None


@pytest.mark.parametrize(("time", "kind"), [("08:44:59", "NIGHT"), ("08:45:00", "DAY"), ("15:44:59", "DAY"), ("15:45:00", "NIGHT")])
def test_session_edges(spark, time, kind):
    assert spark.sql(f"select timestamp_ntz'2024-01-05 {time}' t").select(clock.session_type(F.col("t"))).first()[0] == kind


@pytest.mark.parametrize(("time", "date"), [("2024-01-05 16:00", "2024-01-08"), ("2024-01-06 00:30", "2024-01-06"), ("2024-01-04 15:59", "2024-01-04"), ("2024-01-04 16:00", "2024-01-05"), ("2024-01-06 17:00", "2024-01-08")])
def test_session_dates(spark, time, date):
    assert str(spark.sql(f"select timestamp_ntz'{time}:00' t").select(clock.session_date(F.col("t"))).first()[0]) == date


def test_times(spark):
    row = spark.sql("select timestamp_ntz'2026-03-02 10:00:00' a, timestamp_ntz'2026-07-02 10:00:00' b")
    assert [x.hour for x in row.select(clock.tokyo_time(F.col("a")), clock.tokyo_time(F.col("b"))).first()] == [17, 16]
    texts = spark.createDataFrame([("20240105", "84500123"), ("20240105", "084500123"), ("20240105", "999"), ("20241305", "84500123"), (None, "1")], "d string, t string")
    got = values(texts.select(clock.vendor_timestamp(F.col("d"), F.col("t")).alias("x")), "x")
    assert got[:2] == [dt.datetime(2024, 1, 5, 8, 45, 0, 123000)] * 2 and got[2] == dt.datetime(2024, 1, 5, 0, 0, 0, 999000) and got[3:] == [None, None]
    assert spark.range(1).select(padded(F.lit("1234567890"), 9)).first()[0] == "1234567890"


# features


def bar_rows(spark, closes, kind="DAY", start=T0, **more):
    kinds = [kind] * len(closes) if isinstance(kind, str) else kind
    rows = [(start + dt.timedelta(minutes=5 * i), start.date(), k, None if c is None else float(c)) for i, (c, k) in enumerate(zip(closes, kinds, strict=True))]
    return spark.createDataFrame(rows, "bar_start_jst timestamp_ntz, session_date_jst date, session_type string, close double")


def test_warm_up_returns_are_zero(spark):
    got = bar_rows(spark, [1, 2, 3, 4]).withColumn("r", change_share(F.col("close"), session(), 2)).orderBy("bar_start_jst")
    assert values(got, "r") == [0.0, 0.0, 2.0, 1.0]


def test_null_and_tiny_denominators(spark):
    row = spark.sql("select 1D a, cast(null as double) n, 0D z, -2D m")
    assert row.select(ratio(F.col("a"), F.col("n")), ratio(F.col("a"), F.col("z"), 0.5), floored(F.col("n")), floored(F.col("m")), log1p_or_null(F.col("m"))).first()[:] == (0.0, 0.5, None, 0.0, None)


def test_forward_fill_stays_in_the_session(spark):
    got = bar_rows(spark, [None, 5, None, None], ["NIGHT", "NIGHT", "NIGHT", "DAY"]).withColumn("f", filled_forward(F.col("close"), session())).orderBy("bar_start_jst")
    assert values(got, "f") == [None, 5, 5, None]


def test_zscores_cross_sessions(spark):
    closes = [1, 2, 3, 4, 5, 9]
    df = bar_rows(spark, closes, ["NIGHT"] * 5 + ["DAY"]).withColumns(features.zscores([("close", 10)])).orderBy("bar_start_jst")
    got = values(df, "close_z_10")
    assert got[:4] == [0.0] * 4 and got[5] == pytest.approx((9 - 4) / np.std(closes, ddof=1))


def test_labels(spark):
    def label(closes, h):
        return values(features.efficiency_label(bar_rows(spark, closes), h).orderBy("bar_start_jst"), f"label_efficiency_{h}")

    assert label(range(6), 2) == [1.0] * 4 + [0.0] * 2
    assert label([0, 1, 0, 1, 0, 1, 0], 2) == [0.0] * 7
    assert label([0, 2, 1], 2)[0] == pytest.approx(1 / 3)


def test_labels_do_not_see_the_past_nor_features_the_future(spark):
    rnd = random.Random(2)
    closes = [rnd.random() for _ in range(40)]
    changed = closes[:20] + [x + 1 for x in closes[20:]]
    add = lambda c: bar_rows(spark, c).withColumns({"m": change_share(F.col("close"), session(), 2), **features.zscores([("close", 10)])}).orderBy("bar_start_jst")
    assert values(add(closes), "m", "close_z_10")[:20] == values(add(changed), "m", "close_z_10")[:20]


def test_stationary_drops_rows_before_an_external_value(spark):
    df = bar_rows(spark, [1, 2, 4, 7, 11]).withColumn("us_close", F.when(F.col("close") >= 4, F.col("close") * 2))
    got = features.stationary(df, ["us"]).orderBy("bar_start_jst")
    assert values(got, "close", "us_close") == [(3, 6), (4, 8)]


def test_complete_days(spark):
    days = bar_rows(spark, [1, 2])
    ext = spark.createDataFrame([(T0.date(), "a"), (T0.date(), "a"), (T0.date(), "b")], "session_date_jst date, symbol string")
    assert features.complete_days(days, ext, 2).count() == 2 and features.complete_days(days, ext, 3).count() == 0


def test_one_exchange_for_both_scopes(spark):
    df = bar_rows(spark, [1, 2]).withColumn("r", change_share(F.col("close"), session(), 2)).withColumns(features.zscores([("close", 10)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # AQE prints the initial plan too


# profiles


def test_poc_needs_its_dates_and_ties_go_low(spark):
    rows = [(dt.datetime(2024, 1, d, 9), c, v) for d, c, v in [(1, 15, 5), (1, 25, 5), (2, 31, 9), (3, 15, 1), (4, 15, 2), (5, 15, 3), (6, 47, 1), (7, 47, 1)]]
    df = spark.createDataFrame(rows, "trade_ts timestamp_ntz, close int, volume int")
    got = profile.rolling_poc(profile.volume_profile(df)).orderBy("date")
    assert values(got, "prev_poc_1d") == [None, 10, 30, 10, 10, 10, 40]
    assert values(got, "prev_poc_1w") == [None] * 5 + [10, 30]
    assert values(got, "prev_poc_4w") == [None] * 7


# training sets


def test_constant_columns_are_scaled_by_one(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    got = {r["feature"]: (r["mean"], r["std"]) for r in dataset.feature_stats(df, ["a", "b"]).collect()}
    assert got["a"] == (1.0, 1.0) and got["b"] == (3.0, pytest.approx(math.sqrt(2)))
    assert values(dataset.scaled(df, {"b": (3.0, 2.0)}), "b") == [-0.5, 0.5]


@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 0.8, 1.0])
def test_nearest_quantile_equals_a_sort(spark, q):
    rnd = random.Random(int(q * 10))
    xs = [round(rnd.random(), 2) for _ in range(777)]
    got = dataset.nearest_quantile(spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double"), "x", q)
    assert got == sorted(xs)[round((len(xs) - 1) * q)]


def test_sequences_cross_sessions_and_end_in_one(spark):
    df = bar_rows(spark, [1, 2, 3, 4, None, 6, 7, 8], ["NIGHT"] * 2 + ["DAY"] * 6).withColumn("label", F.lit(1.0))
    got = dataset.sequences(df, ["close"], "label", 3, "DAY").orderBy("bar_start_jst")
    assert [[x[0] for x in s] for s in values(got, "sequence")] == [[1, 2, 3], [2, 3, 4], [6, 7, 8]]


def test_walk_forward_windows(spark):
    dates = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 11)], "session_date_jst date")
    got = dataset.walk_forward(dates, 3, 2, 1).toPandas()
    assert sorted({w.day for w in got["window"]}) == [6, 7, 8, 9, 10]
    first = got[got["window"] == dt.date(2024, 1, 6)]
    assert {p: sorted(d.day for d in g["date"]) for p, g in first.groupby("part")} == {"train": [1, 2, 3], "valid": [4, 5], "test": [6]}
    assert dataset.walk_forward(dates.limit(4), 3, 2, 1).count() == 0


# scores


def scored(spark, rows):
    return spark.createDataFrame(rows, "prob double, label int")


def test_auc_with_ties(spark):
    df = scored(spark, [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.4, 1)])
    assert score.roc_auc(df).first()[0] == pytest.approx(0.8333, abs=1e-4)
    assert score.roc_auc(df.filter("label = 1")).first()[0] is None


def test_lift_and_thresholds(spark):
    df = scored(spark, [(i / 10, int(i > 7)) for i in range(11)])
    row = score.precision_lift(df).first()
    assert row["threshold"] == pytest.approx(np.percentile([i / 10 for i in range(11)], 80)) and row["edge"] == pytest.approx((1 - 3 / 11) * 100)
    assert score.precision_lift(df.limit(1)).first()[:] == (0.5, 0.0)
    assert score.percentile_threshold(df.limit(4)) == 0.5


def test_any_scorer_takes_sequences(spark):
    df = bar_rows(spark, [1, 2, 3, 4]).withColumn("label", F.lit(1.0))
    seq = dataset.sequences(df, ["close"], "label", 2)
    got = score.scored_sequences(seq, lambda x: x[:, :, 0].sum(axis=1) - 5, ["bar_start_jst"]).orderBy("bar_start_jst")
    assert values(got, "prob") == pytest.approx([1 / (1 + math.exp(2)), 0.5, 1 / (1 + math.exp(-2))])


# outcomes of signals


def ends(spark, rows, **bet):
    """(open, high, low, close, prob, momentum) rows of one day -> what its signals come to."""
    full = [(T0 + dt.timedelta(seconds=30 * i), T0.date(), "DAY", *map(float, r[:4]), float(r[4]), None if r[5] is None else float(r[5])) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "bar_start_jst timestamp_ntz, session_date_jst date, session_type string, raw_open double, raw_high double, raw_low double, raw_close double, prob float, momentum double")
    block = bet.pop("block", outcomes.BLOCK)
    return outcomes.signal_outcomes(df, outcomes.Bet(**{"threshold": 0.6, "stop": 50.0, "target": 100.0, **bet}), block).orderBy("entry_time").collect()


FLAT = (1000, 1001, 999, 1000, 0.0, 5)
GO = (1000, 1001, 999, 1000, 0.9, 5)


def test_stop_wins_over_target(spark):
    (t,) = ends(spark, [GO, FLAT, (1000, 1200, 900, 1000, 0, 5), FLAT])
    assert (t["reason"], t["exit_price"], t["pnl"], t["direction"], t["exit_time"]) == ("SL", 950, -5080, "LONG", T0 + dt.timedelta(seconds=60))


def test_stop_on_the_first_held_bar(spark):
    (t,) = ends(spark, [GO, (1000, 1001, 940, 1000, 0, 5), (1000, 1200, 999, 1000, 0, 5)])
    assert (t["reason"], t["exit_time"]) == ("SL", T0 + dt.timedelta(seconds=30))


def test_short_signals_and_signals_without_a_bet(spark):
    (t,) = ends(spark, [(*GO[:5], -1), FLAT, (1000, 1001, 890, 900, 0.9, 0), (900, 901, 899, 900, 0.9, None), (900, 901, 899, 900, 0.9, 5)])
    assert (t["direction"], t["reason"], t["exit_price"], t["pnl"]) == ("SHORT", "TP", 900, 9920)


def test_signals_end_with_their_time_or_the_day(spark):
    one, two = ends(spark, [GO, FLAT, (*FLAT[:3], 1003, 0.9, 5), FLAT, (*FLAT[:3], 1004, 0, 5)], hold=2)
    assert (one["reason"], one["exit_price"], two["reason"], two["exit_price"]) == ("TIME", 1003, "TIME", 1004)


def test_float_scores_are_compared_as_doubles(spark):
    assert ends(spark, [(*GO[:4], 0.82, 5), FLAT, FLAT], threshold=0.82) == []


@pytest.mark.parametrize(("hold", "stop", "target", "block"), [(9, 30.0, 40.0, 32), (9, 30.0, 40.0, 2), (150, 90.0, 140.0, 8), (150, 90.0, 140.0, 32), (720, 200.0, 1e9, 16)])
def test_outcomes_equal_a_loop_on_random_bars(spark, hold, stop, target, block):
    rnd, price, rows = random.Random(4), 1000.0, []
    for _ in range(300):
        o = price
        price += rnd.gauss(0, 12)
        rows.append((o, max(o, price) + rnd.random() * 9, min(o, price) - rnd.random() * 9, price, rnd.random(), rnd.gauss(0, 20)))
    want = []
    for i, r in enumerate(rows[:-1]):
        if r[4] >= 0.6:
            side, entry = (1 if r[5] > 0 else -1), rows[i + 1][0]
            for b in rows[i + 1 : i + 1 + hold]:
                worst, best = (b[2], b[1]) if side > 0 else (b[1], b[2])
                last = ("SL", entry - stop * side) if side * (worst - entry) <= -stop else ("TP", entry + target * side) if side * (best - entry) >= target else ("TIME", b[3])
                if last[0] != "TIME":
                    break
            want.append(last)
    got = ends(spark, rows, hold=hold, stop=stop, target=target, block=block)
    assert [t["reason"] for t in got] == [w[0] for w in want] and [t["exit_price"] for t in got] == pytest.approx([w[1] for w in want])
    assert {w[0] for w in want} == {"SL", "TIME"} | ({"TP"} if target < 1e6 else set())


# orders in blocks


def test_blocks_change_no_result(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(rnd.randrange(500), i, float(rnd.randrange(-50, 50)), float(rnd.randrange(40)), rnd.randrange(2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "exit_time int, i int, pnl double, prob double, label int")
    order = ("exit_time", "i")

    def results():
        curve = sorted(map(tuple, report.equity_curve(df, order).select("i", "equity").collect()))
        thresholds = [score.percentile_threshold(df, percentile=p) for p in (0.0, 33.3, 80.0, 100.0)]
        return curve, report.max_drawdown(df, order).first()[0], score.roc_auc(df).first()[0], *thresholds, dataset.nearest_quantile(df, "pnl", 0.7)

    one = results()
    monkeypatch.setattr(blocks, "ROWS_A_BLOCK", 7)
    many = results()
    assert one[0] == many[0] and one[1:] == pytest.approx(many[1:])
    ordered, total, high, deepest = sorted(rows), 0.0, -math.inf, 0.0
    for r in ordered:
        total += r[2]
        high = max(high, total)
        deepest = max(deepest, high - total)
    assert one[1] == deepest and one[3:7] == pytest.approx(np.percentile([r[3] for r in rows], [0, 33.3, 80, 100]).tolist())
    assert one[7] == sorted(r[2] for r in rows)[round(1999 * 0.7)]
    assert dataset.nearest_quantile(df.limit(0), "pnl", 0.7) is None and score.percentile_threshold(df.limit(3)) == 0.5
    assert report.max_drawdown(df.limit(0), order).first()[0] is None and report.equity_curve(df.limit(0), order).collect() == []


# reports


def test_reports(spark):
    trades = spark.createDataFrame([(1, -5.0, "SL", 0), (2, 3.0, "TP", 4)], "exit_time int, pnl double, reason string, mfe_ticks int")
    assert report.max_drawdown(trades).first()[0] == 0
    assert report.totals(trades).first()[:] == (2, 1, 1, 3.0, 5.0, -2.0, 50.0, 0.6)
    assert report.totals(trades.filter("pnl > 0")).first()["profit_factor"] == math.inf
    assert report.totals(trades.limit(0)).first()["n_trades"] == 0
    assert values(report.by_reason(trades).orderBy("place"), "reason") == ["TP", "SL"]
    assert report.excursions(trades).first()[:] == (2.0, 1)
    assert values(report.equity_curve(trades).orderBy("exit_time"), "equity") == [-5, -2]
    assert isinstance(report.totals(trades).toPandas(), pd.DataFrame)
