"""Schemas of the two input tables and the column groups of the feature table."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in spec.items()])


CLIENT_SCHEMA = _struct({
    "id": T.StringType(),
    "channel_sales": T.StringType(),
    "cons_12m": T.DoubleType(),
    "cons_gas_12m": T.DoubleType(),
    "cons_last_month": T.DoubleType(),
    "date_activ": T.TimestampType(),
    "date_end": T.TimestampType(),
    "date_modif_prod": T.TimestampType(),
    "date_renewal": T.TimestampType(),
    "forecast_cons_12m": T.DoubleType(),
    "forecast_cons_year": T.DoubleType(),
    "forecast_meter_rent_12m": T.DoubleType(),
    "has_gas": T.StringType(),
    "imp_cons": T.DoubleType(),
    "margin_gross_pow_ele": T.DoubleType(),
    "margin_net_pow_ele": T.DoubleType(),
    "net_margin": T.DoubleType(),
    "num_years_antig": T.IntegerType(),
    "churn": T.IntegerType(),
})

PRICE_SCHEMA = _struct({
    "id": T.StringType(),
    "price_date": T.TimestampType(),
    "price_off_peak_var": T.DoubleType(),
    "price_peak_var": T.DoubleType(),
    "price_mid_peak_var": T.DoubleType(),
    "price_off_peak_fix": T.DoubleType(),
    "price_peak_fix": T.DoubleType(),
    "price_mid_peak_fix": T.DoubleType(),
})

PRICE_COLUMNS = [f"price_{band}_{kind}" for kind in ("var", "fix")
                 for band in ("peak", "off_peak", "mid_peak")]

MONTH_FEATURES = ["months_to_end", "months_since_modified", "months_since_renewed"]

CONSUMPTION_FEATURES = [
    "yearly_consumption", "monthly_consumption", "yearly_gas_consumption",
    "yearly_forecast_consumption", "yearly_forecast_meter_rent", "paid_consumption",
    "net_margin_electricity", "net_margin_power", "net_margin",
]

PRICE_FEATURES = [
    "avg_price_off_peak_var", "avg_price_peak_var", "avg_price_mid_peak_var",
    "price_peak_off_peak_ratio_var",
    "std_price_off_peak_var", "std_price_peak_var", "std_price_mid_peak_var",
    "range_price_peak_var", "range_price_off_peak_var", "range_price_mid_peak_var",
]

CATEGORICAL_FEATURES = ["tenure_years", "channel_sales"]
NUMERIC_FEATURES = MONTH_FEATURES + CONSUMPTION_FEATURES + PRICE_FEATURES

FEATURE_COLUMNS = (["id", "channel_sales", "tenure_years"] + NUMERIC_FEATURES + ["churn"])
