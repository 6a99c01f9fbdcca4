"""Hand-made panels for the null and edge rules N1-N20 of the survey."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelforge.functions.frames import PanelWindow
from panelforge.operators import evaluate as E
from panelforge.operators import scaling as Z
from panelforge.operators import selection as S
from panelforge.operators import windows as W
from panelforge.operators.labels import labels
from panelforge.operators.market import rolling_corr
from panelforge.operators.signals import reversal_signal, trend_consistency
from panelforge.operators.xsection import market_breadth, xs_rank, xs_zscore

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def series(spark, values, ticker="A", col="adj_close"):
    return spark.createDataFrame([(ticker, day(i), v) for i, v in enumerate(values)],
                                 f"ticker string, date date, {col} double")


def col(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_n1_rolling_needs_full_frame(spark):
    df = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0])
    got = col(df.select("*", PanelWindow().roll("adj_close", 3, "avg").alias("m")), "m")
    assert got == [None, None, None, None, None, 5.0, 6.0]


def test_n3_division_by_zero_is_null(spark):
    df = series(spark, [0.0, 5.0, 10.0])
    got = col(W.pct_change(df, "adj_close", [1]), "return_1d")
    assert got == [None, None, 1.0]


def test_n4_n5_rsi_edges(spark):
    # rising only: loss 0, gain > 0 → 100; defined from row n (first diff counts 0)
    up = series(spark, [1.0, 2.0, 3.0, 4.0])
    assert col(W.rsi(up, periods=[3]), "rsi_3") == [None, None, 100.0, 100.0]
    flat = series(spark, [2.0, 2.0, 2.0, 2.0])
    assert col(W.rsi(flat, periods=[3]), "rsi_3") == [None, None, None, None]


def test_n6_sample_std_single_row_null(spark):
    df = spark.createDataFrame([("A", day(0), 1.0)], "ticker string, date date, x double")
    assert df.agg(F.stddev_samp("x")).first()[0] is None


def test_n7_n8_corr_pairs_and_constant(spark):
    rows = [("A", day(i), float(i), 3.0) for i in range(5)]
    df = spark.createDataFrame(rows, "ticker string, date date, return_1d double, market_return_1d double")
    got = col(rolling_corr(df, n=3), "correlation_market")
    assert got == [None] * 5  # constant market → undefined, not an error
    rows = [("A", day(i), float(i), float(i) * 2 if i != 3 else None) for i in range(6)]
    df = spark.createDataFrame(rows, "ticker string, date date, return_1d double, market_return_1d double")
    got = col(rolling_corr(df, n=3), "correlation_market")
    assert got[2] == pytest.approx(1.0) and got[3] is None and got[4] is None and got[5] is None


def test_n9_dense_percent_rank(spark):
    rows = [("A", D0, 1.0), ("B", D0, 1.0), ("C", D0, 3.0), ("D", D0, None), ("E", D0, 2.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, return_1d double")
    got = {r["ticker"]: r["return_1d_rank"] for r in xs_rank(df, ["return_1d"]).collect()}
    assert got == {"A": 1 / 3, "B": 1 / 3, "C": 1.0, "D": None, "E": 2 / 3}


def test_n9_single_name_date(spark):
    df = spark.createDataFrame([("A", D0, 0.5)], "ticker string, date date, return_1d double")
    r = xs_zscore(xs_rank(df, ["return_1d"]), ["return_1d"]).first()
    assert r["return_1d_rank"] == 1.0 and r["return_1d_zscore"] is None


def test_n10_breadth_counts_null_rows(spark):
    rows = [("A", D0, 0.1), ("B", D0, -0.1), ("C", D0, None), ("D", D0, 0.2)]
    df = spark.createDataFrame(rows, "ticker string, date date, return_1d double")
    assert market_breadth(df).first()["market_breadth"] == 0.5


def test_n11_label_modes(spark):
    df = series(spark, [1.0, 2.0, 1.5])
    hz = [("1d", 1)]
    assert col(labels(df, horizons=hz, mode="strict"), "target_direction_1d") == [1, 0, None]
    assert col(labels(df, horizons=hz, mode="reference"), "target_direction_1d") == [1, 0, 0]


def test_n15_missing_averages_count_as_no(spark):
    df = spark.createDataFrame([("A", D0, 5.0, 4.0, None, 1.0, 0.5)],
                               "ticker string, date date, sma_5 double, sma_10 double, sma_20 double, "
                               "sma_50 double, sma_200 double")
    assert trend_consistency(df).first()["trend_consistency"] == 0.5
    df = spark.createDataFrame([("A", D0, 0.0, 60.0), ("B", D0, -0.1, 75.0), ("C", D0, None, 80.0)],
                               "ticker string, date date, dist_from_1m_high double, rsi_14 double")
    got = {r["ticker"]: r["reversal_signal"] for r in reversal_signal(df).collect()}
    assert got["A"] == 0.0 and math.copysign(1, got["A"]) == 1 and got["B"] == pytest.approx(0.1)
    assert got["C"] is None


def test_n16_robust_scaler_rules(spark):
    rows = [("A", day(i), float(i) if i != 2 else None) for i in range(12)]
    rows += [("B", day(i), 7.0) for i in range(12)]          # IQR 0 → scale 1
    rows += [("C", day(i), float(i)) for i in range(5)]      # < 10 rows: untouched
    df = spark.createDataFrame(rows, "ticker string, date date, x double")
    scaled, params = Z.robust_scale(df, ["x"], "2030-01-01")
    p = {r["ticker"]: (r["center"], r["scale"]) for r in params.collect()}
    assert set(p) == {"A", "B"} and p["B"] == (7.0, 1.0)
    import numpy as np
    a = np.array([i if i != 2 else 0 for i in range(12)], float)
    assert p["A"][0] == pytest.approx(np.percentile(a, 50))
    assert p["A"][1] == pytest.approx(np.percentile(a, 75) - np.percentile(a, 25))
    c_rows = {r["date"]: r["x"] for r in scaled.filter("ticker = 'C'").collect()}
    assert c_rows[day(3)] == 3.0
    a_null = scaled.filter(F.col("ticker") == "A").filter(F.col("date") == day(2)).first()["x"]
    assert a_null == pytest.approx((0 - p["A"][0]) / p["A"][1])


def test_n18_minmax_constant_gives_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "a double, b double")
    got = Z.minmax_scale(df, ["a", "b"]).collect()
    assert [r["b"] for r in got] == [0.0, 0.0, 0.0]
    assert sorted([r["a"] for r in got], key=lambda v: (v is None, v)) == [0.0, 1.0, None]


def test_n19_variance_threshold_is_population_and_strict(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "a double, b double")
    kept = {r["feature"] for r in S.variance_filter(df, ["a", "b"], 0.25).collect()}
    assert kept == {"b"}  # var_pop(a) = 0.25 exactly (var_samp would be 1/3): not kept


def test_auc_ties_and_symmetry(spark):
    rows = [("t", "m", y, p) for y, p in [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8), (0, 0.8), (1, 0.9)]]
    s = spark.createDataFrame(rows, "target string, model string, y int, p double")
    auc = E.roc_auc(s).first()["auc"]
    # pairs: positives {0.4, 0.8, 0.9} vs negatives {0.1, 0.4, 0.8}
    assert auc == pytest.approx((1 + 0.5 + 0) / 9 + (1 + 1 + 0.5) / 9 + 3 / 9)
    neg = E.roc_auc(s.withColumn("p", -F.col("p"))).first()["auc"]
    assert neg == pytest.approx(1 - auc)
    one_class = s.withColumn("y", F.lit(1))
    assert E.roc_auc(one_class).first()["auc"] is None


def test_confusion_always_four_cells(spark):
    s = spark.createDataFrame([("t", "m", 1, 0.9), ("t", "m", 1, 0.8)], "target string, model string, y int, p double")
    r = E.classification_metrics(s).first()
    assert (r["true_neg"], r["false_pos"], r["false_neg"], r["true_pos"]) == (0, 0, 0, 2)
    assert r["specificity"] == 0.0 and r["precision"] == 1.0


def test_exact_quantiles_skewed_ties(spark):
    import numpy as np
    from panelforge.functions.quantiles import exact_quantiles
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.zeros(3000), rng.normal(size=2000)])   # one group: a third of rows are zeros
    cold = rng.normal(size=7)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.25, 0.5, 0.75, 0.9]
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", qs, ranges=8).collect()}
    for g, vals in [("hot", hot), ("cold", cold)]:
        for i, q in enumerate(qs):
            assert got[g][f"q{i}"] == pytest.approx(np.percentile(vals, q * 100), rel=1e-12, abs=1e-12)
        assert got[g]["n"] == len(vals)


def test_label_purge_keeps_only_known_labels(spark):
    from panelforge.operators.labels import purge
    df = series(spark, [float(i + 1) for i in range(10)])
    cut = str(day(6))
    kept = [r["date"] for r in purge(df, cut, "5d").orderBy("date").collect()]
    # rows before the cut whose 5-row-ahead date is also before it
    assert kept == [day(0)]


def test_scaler_against_sorted_values(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    data = {t: [float(v) if v > -1.5 else None for v in rng.normal(size=n)] for t, n in [("A", 300), ("B", 40), ("C", 8)]}
    df = spark.createDataFrame([(t, day(i), v) for t, vs in data.items() for i, v in enumerate(vs)],
                               "ticker string, date date, x double")
    got = {r["ticker"]: r for r in Z.fit_scaler(df, ["x"], "2030-01-01").collect()}
    assert set(got) == {"A", "B"}
    for t, r in got.items():
        v = [0.0 if x is None else x for x in data[t]]
        lo, mid, hi = np.percentile(v, [25, 50, 75])
        assert (r["center"], r["scale"], r["n_train"]) == (pytest.approx(mid, abs=1e-12), pytest.approx(hi - lo, abs=1e-12), len(v))


def test_n2_nan_becomes_null(spark):
    from panelforge.functions.nulls import clean_doubles, flag
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "i int, x double")
    got = {r["i"]: (r["x"], r["f"]) for r in clean_doubles(df).withColumn("f", flag(F.col("x") > 0)).collect()}
    assert got == {1: (None, 0), 2: (1.0, 1), 3: (None, 0)}


def test_n12_filled_and_unfilled_changes(spark):
    df = series(spark, [10.0, None, 20.0])
    assert col(W.pct_change(df, "adj_close", [1]), "return_1d") == [None, None, None]
    assert col(W.pct_change(df, "adj_close", [1], fill=True), "return_1d") == [None, 0.0, 1.0]


def test_n13_n14_benchmarks_stay_within_a_ticker(spark):
    from panelforge.operators.benchmark import benchmark_features
    from panelforge.sources.bars import BENCHMARKS
    bench = spark.createDataFrame([(t, day(i), 100.0 + i) for t in BENCHMARKS.values() for i in range(30)],
                                  "ticker string, date date, close double")
    rows = [("A", day(i), 10.0, 0.5) for i in range(20, 30)] + [("B", day(40), 10.0, 0.25)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, return_21d double")
    got = benchmark_features(df, bench)
    b = got.filter("ticker = 'B'").first()
    assert b["vix_level"] is None and b["relative_strength_spy"] is None     # nothing carried over from A
    a = got.filter("ticker = 'A'").orderBy("date").collect()[-1]
    assert a["relative_strength_spy"] == pytest.approx(0.5 - (129.0 / 108.0 - 1))


def test_n20_universe_drops_index_rows(spark):
    from panelforge.operators.filters import universe_anti, universe_semi
    df = spark.createDataFrame([("A",), ("^IDX",), ("A",)], "ticker string")
    uni = spark.createDataFrame([("A",), ("A",)], "ticker string")
    assert universe_semi(df, uni).count() == 2 and universe_anti(df, uni).count() == 1


def test_p10_thin_targets_are_not_scored(spark):
    from panelforge.operators.train import enough_rows
    df = spark.createDataFrame([(1, None)] * 99 + [(1, 1)], "target_a int, target_b int")
    assert enough_rows(df, ["a", "b"], 100) == ["a"]


def test_labels_purged_for_all_horizons(spark):
    from panelforge.operators.labels import purge_labels
    df = labels(series(spark, [float(i + 1) for i in range(10)]), horizons=[("1d", 1), ("5d", 5)])
    got = purge_labels(df, str(day(6)), horizons=[("1d", 1), ("5d", 5)]).orderBy("date").collect()
    assert len(got) == 6
    assert [r["target_direction_5d"] for r in got] == [1, None, None, None, None, None]
    assert [r["target_direction_1d"] for r in got] == [1, 1, 1, 1, 1, None]


def test_selector_needs_fit_and_keeps_its_selection(spark):
    from panelforge.operators.selector import FeatureSelector
    df = spark.createDataFrame([(i % 2, float(i % 2), 0.0, float(i)) for i in range(60)], "y int, a double, b double, c double")
    s = FeatureSelector("variance")
    with pytest.raises(ValueError):
        s.transform(df)
    assert s.fit(df, ["a", "b", "c"], "y").selected == ["a", "c"]
    assert s.transform(df, ["y"]).columns == ["y", "a", "c"]
    assert FeatureSelector("mutual_info", 1).fit(df, ["a", "b", "c"], "y").selected == ["a"]
    assert FeatureSelector("importance", 1, rounds=2, task="regression").fit(df, ["a", "b", "c"], "c").selected == ["a"]
    with pytest.raises(ValueError):
        FeatureSelector("magic")
