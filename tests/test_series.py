"""Cleaning, panel and series features against pandas."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import clean, enrich, features, panel
from shelfcast.operators.encoding import ClusterEncoding

START = date(2017, 6, 1)


def synthetic_panel(n_days: int = 45) -> pd.DataFrame:
    rng = np.random.default_rng(0)
    rows = []
    for store, city, state, cluster in ((1, "Quito", "Pichincha", 5), (2, "Guayaquil", "Guayas", 11)):
        for family, extra, fresh in (("GROCERY I", 0, 0), ("BEVERAGES", 5, 1)):
            for i in range(n_days):
                rows.append(
                    dict(
                        store_nbr=store,
                        family=family,
                        date=START + timedelta(days=i),
                        target=max(0.0, 10.0 * store + extra + rng.normal(0, 2)),
                        onpromotion=int(i % 7 == 0),
                        is_earthquake_period=0,
                        holiday_type="Normal Day",
                        oil_price=50.0,
                        perishable=fresh,
                        transactions=int(800 + 10 * store + rng.normal(0, 20)),
                        city=city,
                        state=state,
                        type="D",
                        cluster=cluster,
                    )
                )
    return pd.DataFrame(rows)


@pytest.fixture(scope="module")
def pdf():
    return synthetic_panel()


@pytest.fixture(scope="module")
def built(spark, pdf):
    base = features.base_features(spark.createDataFrame(pdf))
    return features.extended_features(base, 1, cross=True).orderBy("store_nbr", "family", "date").toPandas()


def series_of(pdf, store=1, family="GROCERY I"):
    return pdf[(pdf.store_nbr == store) & (pdf.family == family)].sort_values("date").reset_index(drop=True)


def close(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)])


def test_required_columns_exist(built):
    groups = features.select_features(list(built.columns), 1, cross=True)
    assert not groups["dropped_for_lag"]
    for name in ("sales_std7", "sales_rolling_mean30", "is_payday", "slog_dow_mean4", "store_promo_share"):
        assert name in built.columns


def test_base_features_match_pandas(built, pdf):
    for store, family in ((1, "GROCERY I"), (2, "BEVERAGES")):
        got, y = series_of(built, store, family), series_of(pdf, store, family).target
        for lag in (7, 14, 28):
            close(got[f"sales_lag{lag}"], y.shift(lag))
        for w in (7, 14, 30):
            close(got[f"sales_rolling_mean{w}"], y.shift(1).rolling(w).mean())
        for w in (7, 28):
            close(got[f"sales_std{w}"], y.shift(1).rolling(w).std())


def test_extended_features_match_pandas(built, pdf):
    got, src = series_of(built), series_of(pdf)
    s = np.log1p(src.target)
    for lag in (1, 2, 3, 7, 14, 21, 28):
        close(got[f"slog_lag{lag}"], s.shift(lag))
    close(got.slog_roll_mean7, s.shift(1).rolling(7, min_periods=2).mean())
    close(got.slog_roll_mean28, s.shift(1).rolling(28, min_periods=9).mean())
    close(got.slog_roll_std28, s.shift(1).rolling(28, min_periods=7).std())
    dow = pd.to_datetime(src.date).dt.dayofweek
    want = s.groupby(dow).transform(lambda x: x.shift(1).rolling(4, min_periods=1).mean())
    close(got.slog_dow_mean4, want)
    close(got.promo_rate_7, src.onpromotion.shift(1).rolling(7, min_periods=2).mean())
    tr = src.transactions
    close(got.trans_roll_mean7, tr.shift(1).rolling(7, min_periods=2).mean())


def test_cross_series_means(built, pdf):
    src = pdf.assign(s=np.log1p(pdf.target))
    store_mean = src[src.store_nbr == 1].groupby("date").s.mean().shift(1)
    close(series_of(built).store_slog_mean_lag, store_mean.values)


def test_no_feature_reads_the_same_day(spark, pdf):
    """Masking the last day's target changes no feature of that day."""
    last = pdf.date.max()
    masked = pdf.assign(target=np.where(pdf.date == last, np.nan, pdf.target))

    def run(p):
        df = spark.createDataFrame(p).withColumn("target", F.when(~F.isnan("target"), F.col("target")))
        out = features.extended_features(features.base_features(df), 1, cross=True)
        return out.filter(F.col("date") == last)

    names = [*features.BASE_FEATURE_LAGS, *features.extended_names(1, cross=True)]
    names = [n for n in names if n in run(pdf).columns]
    from shelfcast.operators.metrics import leak_audit

    day_before = F.lit(last - timedelta(days=1))
    audit = leak_audit(run(pdf), run(masked), day_before, names, ["store_nbr", "family", "date"])
    assert audit.isEmpty()


def test_min_lag_drops_short_features(built):
    groups = features.select_features(list(built.columns), 16)
    assert groups["zero_filled"][0] == "sales_lag28"
    assert "sales_rolling_mean7" in groups["dropped_for_lag"]


def test_calendar_and_payday(spark):
    days = [date(2017, 2, 14), date(2017, 2, 15), date(2017, 2, 16), date(2017, 2, 28), date(2017, 3, 1)]
    rows = enrich.with_calendar(spark.createDataFrame([(d,) for d in days], "date date")).collect()
    got = {r["date"]: r for r in rows}
    assert [got[d]["is_payday"] for d in days] == [0, 1, 0, 1, 0]
    assert [got[d]["is_day_after_payday"] for d in days] == [0, 0, 1, 0, 1]
    assert got[days[0]]["days_to_payday"] == 1 and got[days[0]]["days_from_payday"] == 14
    assert got[days[3]]["days_from_payday"] == 13 and got[days[3]]["days_to_payday"] == 0
    assert got[days[3]]["is_month_end"] == 1 and got[days[4]]["is_month_start"] == 1


def test_back_to_school_by_coast(spark):
    rows = [("Guayas", date(2017, 4, 3)), ("Guayas", date(2017, 8, 3)), ("Azuay", date(2017, 8, 3)), (None, date(2017, 4, 3))]
    got = enrich.with_back_to_school(spark.createDataFrame(rows, "state string, date date")).collect()
    assert [r["is_back_to_school"] for r in got] == [1, 0, 1, 0]


def test_panel_completion_adds_zero_days(spark):
    rows = [(1, "A", START, 3.0, True, "Holiday"), (1, "A", START + timedelta(days=3), 2.0, False, "Normal Day"),
            (1, "B", START + timedelta(days=2), 4.0, False, "Normal Day")]
    df = spark.createDataFrame(rows, "store_nbr int, family string, date date, target double, onpromotion boolean, holiday_type string")
    got = panel.complete_panel(df).orderBy("family", "date").collect()
    assert [(r["family"], r["target"], r["observed"]) for r in got] == [
        ("A", 3.0, True), ("A", 0.0, False), ("A", 0.0, False), ("A", 2.0, True), ("B", 4.0, True), ("B", 0.0, False)]
    assert all(r["onpromotion"] is not None for r in got)
    lagged = features.base_features(panel.complete_panel(df).withColumns(
        {"is_earthquake_period": F.lit(False), "state": F.lit("x"), "cluster": F.lit(1)}))
    assert "sales_lag7" in lagged.columns


def test_panel_refuses_duplicates(spark):
    rows = [(1, "A", START, 3.0), (1, "A", START, 4.0)]
    df = spark.createDataFrame(rows, "store_nbr int, family string, date date, target double")
    with pytest.raises(ValueError, match="duplicate"):
        panel.complete_panel(df)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="target"):
        features.extended_features(spark.createDataFrame([(1, "A", START)], "store_nbr int, family string, date date"))


def test_remove_data_errors(spark):
    rows = [(1, 5.0), (1, -4.0), (1, -6.0), (2, -1.0), (3, None), (3, 2.0)]
    df = spark.createDataFrame(rows, "item_nbr int, unit_sales double")
    kept = sorted((r["item_nbr"], r["unit_sales"]) for r in clean.remove_data_errors(df).filter("unit_sales IS NOT NULL").collect())
    # item 2 only ever went back: its largest sale is -1, so the row is kept only if |x| <= max
    assert kept == [(1, -4.0), (1, 5.0), (3, 2.0)]
    assert clean.remove_data_errors(df).filter("unit_sales IS NULL").count() == 1


def test_fill_daily_forward_then_backward(spark):
    rows = [(START, None), (START + timedelta(days=1), 40.0), (START + timedelta(days=4), 44.0)]
    df = spark.createDataFrame(rows, "date date, dcoilwtico double")
    got = [r["oil_price"] for r in clean.fill_daily(df, "dcoilwtico", "oil_price").orderBy("date").collect()]
    assert got == [40.0, 40.0, 40.0, 40.0, 44.0]


def test_holiday_levels_and_row_count(spark):
    hol = spark.createDataFrame(
        [(START, "Holiday", "National", "World", "N", False), (START, "Holiday", "National", "World", "N2", False),
         (START, "Event", "Local", "Quito", "L", False), (START + timedelta(days=1), "Event", "Regional", "Azuay", "Terremoto x", False),
         (START + timedelta(days=1), "Event", "Local", "Quito", "L2", False), (START + timedelta(days=2), "Holiday", "National", "World", "T", True)],
        "date date, type string, locale string, locale_name string, description string, transferred boolean")
    rows = [(START, "Quito", "Pichincha"), (START + timedelta(days=1), "Quito", "Azuay"),
            (START + timedelta(days=1), "Quito", "Pichincha"), (START + timedelta(days=2), "Quito", "Azuay")]
    df = spark.createDataFrame(rows, "date date, city string, state string")
    got = clean.with_quake_flag(enrich.join_holidays(df, clean.prepare_holidays(hol))).collect()
    kinds = sorted((r["date"], r["state"], r["holiday_description"], r["is_earthquake_period"]) for r in got)
    assert kinds == [(START, "Pichincha", "N", False), (START + timedelta(days=1), "Azuay", "Terremoto x", True),
                     (START + timedelta(days=1), "Pichincha", "L2", False), (START + timedelta(days=2), "Azuay", "None", False)]


def test_encoding_uses_training_rows_only(spark):
    train = spark.createDataFrame([(5, "A", 1, 10.0), (5, "A", 0, 2.0), (7, "B", 0, 6.0)], "cluster int, family string, onpromotion int, target double")
    later = spark.createDataFrame([(5, "A", 1, 9999.0), (9, "Z", 0, 1.0)], "cluster int, family string, onpromotion int, target double")
    got = {r["cluster"]: r for r in ClusterEncoding.fit(train, 10.0).apply(later).collect()}
    assert got[5]["cluster_mean_sales"] == pytest.approx((12 + 60) / 12)
    assert got[5]["cluster_median_sales"] == pytest.approx((6 * 2 + 60) / 12)
    assert got[5]["cluster_promo_mean_sales"] == pytest.approx((10 + 60) / 11)
    assert got[9]["cluster_mean_sales"] == pytest.approx(6.0)


def test_ordinal_codes_send_unknown_to_sentinel(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "f string")
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "f string")
    got = {r["f"]: r["f_code"] for r in features.encode_ordinal(train, df, ["f"]).collect()}
    assert got == {"a": 0, "b": 1, "c": 9999}
