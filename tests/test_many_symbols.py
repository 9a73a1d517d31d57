"""Frames of many symbols: each symbol's rows are those that it would have alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, dataset, features, outcomes, profile, score, ticks

T0 = dt.datetime(2024, 1, 5, 8, 0)


def random_ticks(spark, seed=0, n=1500, symbols=("a", "b", "c")):
    """Ticks of many symbols over three dates, most of them of the first symbol; months and times clash."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        symbol = symbols[0] if rnd.random() < 0.6 else rnd.choice(symbols)
        at = T0 + dt.timedelta(days=rnd.randrange(3), seconds=rnd.randrange(36_000))
        rows.append((symbol, at.strftime("%Y%m%d"), at.strftime("%Y%m%d"), at, i, float(rnd.randrange(95, 106)), rnd.randrange(1, 9), rnd.choice([202403, 202403, 202406]) + 3 * symbols.index(symbol), rnd.choice("NNNX")))
    return spark.createDataFrame(rows, "symbol string, trade_date string, execution_date string, trade_ts timestamp_ntz, sequence_no long, price double, trade_volume long, contract_month int, price_type string").withColumn("sco_category", F.lit(0).cast("tinyint"))


def rows_of(df, *order):
    names = sorted(df.columns)
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).orderBy(*order).collect()]


def alone(made, of, order):
    """What `of` makes of each symbol's rows by themselves, put together."""
    got = []
    for symbol in [r[0] for r in made.select("symbol").distinct().orderBy("symbol").collect()]:
        part = of(made.filter(F.col("symbol") == symbol).drop("symbol"))
        got.append(part.withColumn("symbol", F.lit(symbol)))
    whole = got[0]
    for part in got[1:]:
        whole = whole.unionByName(part)
    return rows_of(whole, *order)


def test_ticks(spark):
    made = random_ticks(spark)
    order = ("symbol", "sequence_no")
    for of in (ticks.near_contract, lambda x: ticks.with_direction(x, 600)):
        assert rows_of(of(made), *order) == alone(made, of, order)
    assert rows_of(ticks.normalised(made), *order) == alone(made, lambda x: ticks.normalised(x, "x").drop("symbol"), order)
    with pytest.raises(ValueError, match="symbol"):
        ticks.normalised(made.drop("symbol"))


def test_rows_without_a_symbol_are_a_series(spark):
    made = random_ticks(spark, n=300)
    unnamed = made.withColumn("symbol", F.when(F.col("symbol") != "a", F.col("symbol")))
    got = ticks.normalised(unnamed).fillna("a", ["symbol"])
    assert rows_of(got, "sequence_no") == rows_of(ticks.normalised(made), "sequence_no")


def test_features_labels_and_sequences(spark):
    made = bars.trade_bars(ticks.normalised(random_ticks(spark)), "300 seconds").persist()
    order = ("symbol", "bar_start_jst")

    def of(x):
        return features.stationary(features.clock_features(features.efficiency_label(features.base_features(x), 4)))

    assert rows_of(of(made), *order) == alone(made, of, order)
    windows = lambda x: dataset.sequences(features.base_features(x), ["ret_1m", "close"], "close", 5, "DAY").select(*[c for c in ("symbol",) if c in x.columns], "bar_start_jst", "sequence")
    assert rows_of(windows(made), *order) == alone(made, windows, order)
    counts = sorted(r["count"] for r in made.groupBy("symbol", "session_date_jst").count().collect())
    enough = lambda x: dataset.long_enough(x, counts[len(counts) // 2])
    assert rows_of(enough(made), *order) == alone(made, enough, order) != rows_of(made, *order)


def test_features_are_dealt_by_symbol_and_date(spark):
    made = bars.trade_bars(ticks.normalised(random_ticks(spark, n=50)), "300 seconds").persist()
    made.count()
    plan = features.base_features(made)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("symbol" in line for line in dealt if "session_date_jst" in line)


def test_outcomes(spark):
    rnd = random.Random(3)
    rows = []
    for symbol in "ab":
        for i in range(160):
            low = 100 + rnd.randrange(20)
            rows.append((symbol, T0 + dt.timedelta(minutes=5 * i), (T0 + dt.timedelta(minutes=5 * i)).date(), "DAY", float(low + 3), float(low + 9), float(low), float(low + rnd.randrange(9)), rnd.random()))
    made = spark.createDataFrame(rows, "symbol string, bar_start_jst timestamp_ntz, session_date_jst date, session_type string, raw_open double, raw_high double, raw_low double, raw_close double, prob double")
    of = lambda x: outcomes.signal_outcomes(score.with_signals(x, 3, 2), outcomes.Bet(0.5, 6.0, 9.0, 12), 4)
    got = rows_of(of(made), "symbol", "bar_start_jst")
    assert got == alone(made, of, ("symbol", "bar_start_jst")) and len(got) > 50


def test_profiles(spark):
    made = bars.size_bars(ticks.normalised(random_ticks(spark))).persist()
    back = {"one": 1, "two": 2}
    of = lambda x: profile.rolling_poc(profile.volume_profile(x, 2), back)
    assert rows_of(of(made), "symbol", "date") == alone(made, of, ("symbol", "date"))
    joined = lambda x: profile.with_poc(x, 2)
    assert rows_of(joined(made), "symbol", "trade_ts") == alone(made, joined, ("symbol", "trade_ts"))
