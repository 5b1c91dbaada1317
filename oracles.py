"""SQL for DuckDB that states each registered query on its own terms.

The statements follow the definitions directly (join first, then aggregate; one kernel value
per row and grid point; a rank over all rows), not the shape of the Spark jobs.
"""

from __future__ import annotations

# The columns of the results, on their own here so that a wrong list is seen.
NUMERIC_FEATURES = """
months_to_end months_since_modified months_since_renewed
yearly_consumption monthly_consumption yearly_gas_consumption yearly_forecast_consumption
yearly_forecast_meter_rent paid_consumption net_margin_electricity net_margin_power net_margin
avg_price_off_peak_var avg_price_peak_var avg_price_mid_peak_var price_peak_off_peak_ratio_var
std_price_off_peak_var std_price_peak_var std_price_mid_peak_var
range_price_peak_var range_price_off_peak_var range_price_mid_peak_var""".split()
FEATURE_COLUMNS = ["id", "channel_sales", "tenure_years", *NUMERIC_FEATURES, "churn"]
PRICE_COLUMNS = """
price_peak_var price_off_peak_var price_mid_peak_var
price_peak_fix price_off_peak_fix price_mid_peak_fix""".split()
CHANNELS_SOLD = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

AS_OF = "TIMESTAMP '1998-01-01 00:00:00'"

CLIENT = """
client AS (
  SELECT c_custkey AS id, any_value(c_mktsegment) AS channel_sales,
         any_value(c_nationkey) AS num_years_antig,
         min(o_orderdate) AS date_activ, max(o_orderdate) AS date_end,
         max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS date_modif_prod,
         max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS date_renewal,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cons_12m,
         CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2))
                       ELSE CAST(0 AS DECIMAL(18,2)) END) AS DOUBLE) AS cons_gas_12m,
         max(o_totalprice) AS cons_last_month, max(o_totalprice) AS imp_cons,
         max(o_totalprice) AS net_margin,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 2 AS forecast_cons_12m,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 2 AS forecast_cons_year,
         min(o_totalprice) AS forecast_meter_rent_12m, min(o_totalprice) AS margin_net_pow_ele,
         max(o_totalprice) - min(o_totalprice) AS margin_gross_pow_ele,
         max(CASE WHEN o_orderstatus = 'P' THEN 't' ELSE 'f' END) AS has_gas,
         any_value(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS churn
  FROM customer JOIN orders ON c_custkey = o_custkey
  GROUP BY c_custkey
)"""

PRICE = """
price AS (
  SELECT o_custkey AS id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS price_date,
         max(ln(l_extendedprice)) AS price_peak_var,
         max(l_tax * ln(l_extendedprice / l_quantity)) AS price_off_peak_var,
         max(l_discount * ln(l_extendedprice / l_quantity)) AS price_mid_peak_var,
         min(ln(l_extendedprice)) AS price_peak_fix,
         min(l_tax * ln(l_extendedprice / l_quantity)) AS price_off_peak_fix,
         min(l_discount * ln(l_extendedprice / l_quantity)) AS price_mid_peak_fix
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2
)"""

FEATURES = f"""
{CLIENT},
{PRICE},
features AS (
  SELECT p.id, c.channel_sales,
    CAST(floor(avg(num_years_antig)) AS BIGINT) AS tenure_years,
    datesub('month', {AS_OF}, date_end) AS months_to_end,
    datesub('month', date_modif_prod, {AS_OF}) AS months_since_modified,
    datesub('month', date_renewal, {AS_OF}) AS months_since_renewed,
    round(avg(cons_12m)) AS yearly_consumption,
    CAST(floor(avg(cons_last_month)) AS BIGINT) AS monthly_consumption,
    CAST(floor(avg(cons_gas_12m)) AS BIGINT) AS yearly_gas_consumption,
    round(avg(forecast_cons_12m)) AS yearly_forecast_consumption,
    round(avg(forecast_meter_rent_12m), 3) AS yearly_forecast_meter_rent,
    round(avg(imp_cons), 3) AS paid_consumption,
    round(avg(margin_gross_pow_ele), 3) AS net_margin_electricity,
    round(avg(margin_net_pow_ele), 3) AS net_margin_power,
    round(avg(net_margin), 3) AS net_margin,
    round(avg(price_off_peak_var), 3) AS avg_price_off_peak_var,
    round(avg(price_peak_var), 3) AS avg_price_peak_var,
    round(avg(price_mid_peak_var), 3) AS avg_price_mid_peak_var,
    round(avg(price_peak_var / nullif(price_off_peak_var, 0)), 3)
      AS price_peak_off_peak_ratio_var,
    round(stddev_pop(price_off_peak_var), 3) AS std_price_off_peak_var,
    round(stddev_pop(price_peak_var), 3) AS std_price_peak_var,
    round(stddev_pop(price_mid_peak_var), 3) AS std_price_mid_peak_var,
    round(max(price_peak_var) - min(price_peak_var), 3) AS range_price_peak_var,
    round(max(price_off_peak_var) - min(price_off_peak_var), 3) AS range_price_off_peak_var,
    round(max(price_mid_peak_var) - min(price_mid_peak_var), 3) AS range_price_mid_peak_var,
    CAST(floor(avg(churn)) AS BIGINT) AS churn
  FROM price p JOIN client c ON p.id = c.id
  GROUP BY p.id, c.channel_sales, months_to_end, months_since_modified, months_since_renewed
)"""

ORDER_VALUES = """
vals AS (
  SELECT o_orderkey, o_totalprice, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS churn
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""

CHANNELS = """
channels AS (
  SELECT p_partkey AS id, concat(p_brand, '/', CAST(p_size % 4 AS VARCHAR)) AS channel_sales
  FROM part
)"""

# (column, churn, value) rows of all numeric features
LONG_FEATURES = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(churn AS INTEGER) AS churn, CAST({c} AS DOUBLE) AS v "
    f"FROM features WHERE {c} IS NOT NULL" for c in NUMERIC_FEATURES) + ")"

LONG_ORDERS = ("long AS (SELECT 'o_totalprice' AS \"column\", churn, o_totalprice AS v "
               "FROM vals WHERE o_totalprice IS NOT NULL)")


def share(column: str) -> str:
    return f"""
WITH {FEATURES},
counted AS (SELECT {column}, churn, count(*) AS n FROM features
            WHERE {column} IS NOT NULL AND churn IS NOT NULL GROUP BY 1, 2)
SELECT {column}, CASE churn WHEN 1 THEN 'churn' WHEN 0 THEN 'no churn' END AS churn,
       n AS "count",
       CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY {column}) AS DOUBLE) * 100
         AS percentage
FROM counted"""


def histogram(source: str, bins: int = 12) -> str:
    """Counts each value against every bin's edges."""
    return f"""
WITH {source},
names AS (SELECT DISTINCT "column" FROM long),
raw AS (SELECT "column", min(v) AS lo, max(v) AS hi FROM long WHERE churn = 1 GROUP BY 1),
rng AS (
  SELECT n."column",
         CASE WHEN lo IS NULL THEN 0.0 WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
         CASE WHEN lo IS NULL THEN 1.0 WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
  FROM names n LEFT JOIN raw USING ("column")
),
edges AS (
  SELECT "column", CAST(i AS INTEGER) AS bin,
         i * ((hi - lo) / {bins}) + lo AS e0,
         CASE WHEN i = {bins - 1} THEN hi ELSE (i + 1) * ((hi - lo) / {bins}) + lo END AS e1
  FROM rng, range({bins}) AS r(i)
),
counted AS (
  SELECT e."column", e.bin, any_value(e0) AS e0, any_value(e1) AS e1,
         count(*) FILTER (WHERE l.churn = 1) AS churn_count,
         count(*) FILTER (WHERE l.churn = 0) AS no_churn_count
  FROM edges e LEFT JOIN long l
    ON l."column" = e."column" AND l.v >= e.e0
       AND (l.v < e.e1 OR (e.bin = {bins - 1} AND l.v = e.e1))
  GROUP BY 1, 2
)
SELECT "column", bin, (e0 + e1) / 2 AS bin_center, churn_count, no_churn_count,
  CAST(churn_count AS DOUBLE) / CAST(greatest(churn_count + no_churn_count, 1) AS DOUBLE) * 100
    AS churn_pct,
  CAST(no_churn_count AS DOUBLE)
    / CAST(greatest(churn_count + no_churn_count, 1) AS DOUBLE) * 100 AS no_churn_pct
FROM counted"""


def kde(source: str, points: int = 1000, ranges: dict[str, tuple[float, float]] | None = None
        ) -> str:
    """One kernel value per row and grid point. Grids span a column's values, or ``ranges``."""
    lengths = "SELECT \"column\", min(v) AS lo, max(v) AS hi FROM long GROUP BY 1"
    if ranges:
        source = f"{source}, long AS (SELECT * FROM every WHERE \"column\" IN ({', '.join(repr(c) for c in ranges)}))"
        lengths = " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi"
            for c, (lo, hi) in ranges.items())
    return f"""
WITH {source},
cls AS (SELECT "column", churn, count(v) AS n, stddev_samp(v) AS s FROM long GROUP BY 1, 2),
rng AS ({lengths}),
grid AS (
  SELECT "column", hi - lo AS length, CAST(i AS INTEGER) AS point,
         CASE WHEN i = {points - 1} THEN hi ELSE lo + i * ((hi - lo) / {points - 1}) END AS x
  FROM rng, range({points}) AS r(i)
),
banded AS (
  SELECT cls."column", churn, n, s * pow(CAST(n AS DOUBLE), -0.2) AS h FROM cls
  WHERE n >= 2 AND s > 0
),
summed AS (
  SELECT g."column", b.churn, g.point, any_value(b.n) AS n, any_value(b.h) AS h,
         sum(exp(-((g.x - l.v) / b.h) * ((g.x - l.v) / b.h) / 2)) AS k
  FROM grid g JOIN banded b ON b."column" = g."column"
  JOIN long l ON l."column" = g."column" AND l.churn = b.churn
  GROUP BY 1, 2, 3
)
SELECT g."column", f.churn, g.point, round(g.x, 6) + 0.0 AS x,
       round(length * (k / (n * h * sqrt(2 * pi()))), 6) + 0.0 AS relative_density
FROM grid g CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS churn) f
LEFT JOIN summed s ON s."column" = g."column" AND s.point = g.point AND s.churn = f.churn"""


def hash_of(key: str, seed: int = 0) -> str:
    return f"CAST(('0x' || substr(md5(concat('{seed}:', {key})), 1, 8)) AS BIGINT)"


SPLIT = f"""
split AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {hash_of('id')}, id)
                      <= ceil(CAST(count(*) OVER () AS DOUBLE) * CAST(0.2 AS DOUBLE))
                 THEN 'test' ELSE 'train' END AS split
  FROM features
)"""


# The label is a rule on the channel, turned over for one client in ten.
RULED = f"""
{FEATURES.replace("features AS (", "measured AS (")},
ruled AS (SELECT *, CASE WHEN channel_sales IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS rule
          FROM measured),
features AS (SELECT * REPLACE (CASE WHEN {hash_of('id', 7)} % 10 = 0 THEN 1 - rule ELSE rule END
                               AS churn) FROM ruled)"""


def metrics(of: str, name: str = "") -> str:
    """Recall, precision and accuracy of the rule, as (metric, value) rows."""
    first = f"'{name}' AS model, " if name else ""
    rows = {"Recall": ("churn = 1 AND rule = 1", "churn = 1"),
            "Precision": ("churn = 1 AND rule = 1", "rule = 1"),
            "Accuracy": ("churn = rule", "true")}
    return " UNION ALL ".join(
        f"SELECT {first}'{metric}' AS metric, round(coalesce(count(*) FILTER (WHERE {part}) "
        f"/ nullif(count(*) FILTER (WHERE {whole}), 0), 0.0), 2) AS value FROM {of}"
        for metric, (part, whole) in rows.items())


def rule_test_rows() -> str:
    return f"WITH {RULED}, {SPLIT}, tested AS (SELECT * FROM split WHERE split = 'test')"


def rule_search(folds: int = 5) -> str:
    """Every setting of the search space; the rule's recall is that of each of them."""
    fold = " + ".join(
        f"(CASE WHEN rn > ceil(CAST(n * {i} AS DOUBLE) / {folds}) THEN 1 ELSE 0 END)"
        for i in range(1, folds))
    return f"""
WITH {RULED}, {SPLIT},
ranked AS (SELECT churn, rule, count(*) OVER (PARTITION BY churn) AS n,
                  row_number() OVER (PARTITION BY churn ORDER BY {hash_of('id')}, id) AS rn
           FROM split WHERE split = 'train'),
of_fold AS (SELECT {fold} AS fold, sum(rule) / count(*) AS recall
            FROM ranked WHERE churn = 1 GROUP BY 1),
mean AS (SELECT round(sum(recall) / {folds}, 6) AS recall FROM of_fold)
SELECT CAST(a AS INTEGER) AS n_estimators, CAST(b AS INTEGER) AS max_depth,
       CAST(c AS INTEGER) AS min_samples_split, CAST(d AS INTEGER) AS min_samples_leaf, recall,
       a = 90 AND b = 10 AND c = 2 AND d = 1 AS best
FROM mean, range(90, 111) AS r1(a), range(10, 13) AS r2(b), range(2, 6) AS r3(c),
     range(1, 4) AS r4(d)"""


def scaled_features(columns: list[str]) -> str:
    """The given features: fill with 0, scale by the training rows."""
    fills = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in columns)
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN min({c}) = max({c}) THEN 1.0 "
                      f"ELSE stddev_pop({c}) END AS s_{c}" for c in columns)
    scaled = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in columns)
    return f"""
WITH {FEATURES}, {SPLIT},
filled AS (SELECT id, churn, split, {fills} FROM split),
stats AS (SELECT {stats} FROM filled WHERE split = 'train')
SELECT id, churn, split, {scaled} FROM filled, stats"""


def column_ranges() -> str:
    parts = [f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min_value,
       CAST(max({c}) AS DOUBLE) AS max_value,
       (CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE)) / 100 AS step FROM features"""
             for c in NUMERIC_FEATURES]
    return f"WITH {FEATURES} " + " UNION ALL ".join(parts)


def schema_report() -> str:
    kinds = {"id": "bigint", "channel_sales": "string"}
    whole = ["tenure_years", "months_to_end", "months_since_modified", "months_since_renewed",
             "monthly_consumption", "yearly_gas_consumption", "churn"]
    kinds.update({c: "bigint" for c in whole})
    parts = [f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column",
       '{kinds.get(c, 'double')}' AS type, count(*) AS "rows", count({c}) AS non_null
       FROM features""" for i, c in enumerate(FEATURE_COLUMNS)]
    return f"WITH {FEATURES} " + " UNION ALL ".join(parts)


def price_changes() -> str:
    changes = ", ".join(
        f"round({c} - lag({c}) OVER w, 6) + 0.0 AS {c}_change" for c in PRICE_COLUMNS)
    return f"""
WITH {PRICE}
SELECT id, price_date, {changes} FROM price
WINDOW w AS (PARTITION BY id ORDER BY price_date NULLS FIRST)"""


def price_changes_repeated() -> str:
    """Order lines of a client and month are peers; the last of them by its prices counts."""
    names = PRICE_COLUMNS[:3]
    last = ", ".join(f"{c} DESC NULLS LAST" for c in names)
    changes = ", ".join(
        f"round(o.{c} - l.p_{c}, 6) + 0.0 AS {c}_change" for c in names)
    return f"""
WITH lines AS (
  SELECT o_custkey AS id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS price_date,
         ln(l_extendedprice) AS price_peak_var,
         l_tax * ln(l_extendedprice / l_quantity) AS price_off_peak_var,
         l_discount * ln(l_extendedprice / l_quantity) AS price_mid_peak_var
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ends AS (SELECT *, row_number() OVER (PARTITION BY id, price_date ORDER BY {last}) AS rn
         FROM lines),
lags AS (SELECT id, price_date, {", ".join(f"lag({c}) OVER w AS p_{c}" for c in names)}
         FROM ends WHERE rn = 1 WINDOW w AS (PARTITION BY id ORDER BY price_date NULLS FIRST))
SELECT o.id, o.price_date, {changes}
FROM lines o JOIN lags l ON o.id = l.id AND o.price_date IS NOT DISTINCT FROM l.price_date"""


DENSITY_RANGES = {"avg_price_mid_peak_var": (0.1, 0.2), "avg_price_peak_var": (0.0, 12.0)}


def oracle_sql() -> dict[str, str]:
    feature_rows = f"WITH {FEATURES} SELECT {', '.join(FEATURE_COLUMNS)} FROM features"
    folds = " + ".join(
        f"(CASE WHEN rn > ceil(CAST(n * {i} AS DOUBLE) / 5) THEN 1 ELSE 0 END)"
        for i in range(1, 5))
    dummy_columns = ", ".join(
        f"CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS channel_sales_{v}"
        for v in CHANNELS_SOLD)
    return {
        "price_sensitivity_features": feature_rows,
        "feature_table_roundtrip": feature_rows,
        "csv_text_roundtrip": "SELECT conv_id, turn, role, nullif(text, '') AS text FROM conversations",
        "forest_parameters": """SELECT CAST(100 AS INTEGER) AS n_estimators,
            CAST(20 AS INTEGER) AS max_depth, CAST(2 AS INTEGER) AS min_samples_split,
            CAST(1 AS INTEGER) AS min_samples_leaf""",
        "price_changes": price_changes(),
        "price_changes_repeated": price_changes_repeated(),
        "churn_kde_ranges": kde(f"{FEATURES}, {LONG_FEATURES.replace('long AS', 'every AS', 1)}",
                                ranges=DENSITY_RANGES),
        "selectable_columns": f"""
SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS position, feature
FROM (SELECT unnest({["tenure_years", *NUMERIC_FEATURES]}) AS feature
      UNION ALL SELECT DISTINCT concat('channel_sales_', c_mktsegment)
      FROM customer JOIN orders ON c_custkey = o_custkey)""",
        "rule_forest_scores": f"{rule_test_rows()} {metrics('tested')}",
        "rule_tuned_vs_custom":
            f"{rule_test_rows()} {metrics('tested', 'custom')} UNION ALL {metrics('tested', 'tuned')}",
        "rule_forest_tuned": rule_search(),
        "rule_model_roundtrip": f"""
WITH {RULED} SELECT id, CAST(churn AS BIGINT) AS churn, CAST(rule AS DOUBLE) AS prediction
FROM features""",
        "importance_of_nodes": f"""
SELECT unnest({["tenure_years", *NUMERIC_FEATURES,
                *(f"channel_sales_{c}" for c in CHANNELS_SOLD)]}) AS feature,
       true AS as_in_model, CAST(1 AS DOUBLE) AS sum_of_all""",
        "prepared_split_roundtrip": scaled_features(["yearly_consumption", "net_margin"]),
        "client_consumption_distinct":
            "SELECT o_custkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority",
        "clean_channel_sales": f"""
WITH {CHANNELS},
counted AS (SELECT channel_sales, count(*) AS n FROM channels
            WHERE channel_sales IS NOT NULL GROUP BY 1 HAVING count(*) > 20),
coded AS (SELECT channel_sales, dense_rank() OVER (ORDER BY n DESC) - 1 AS code FROM counted)
SELECT id, CAST(code AS INTEGER) AS channel_sales
FROM channels JOIN coded USING (channel_sales)""",
        "channel_codes": f"""
WITH {CHANNELS}
SELECT channel_sales, count(*) AS n,
       CAST(dense_rank() OVER (ORDER BY count(*) DESC) - 1 AS INTEGER) AS code
FROM channels WHERE channel_sales IS NOT NULL GROUP BY 1 HAVING count(*) > 20""",
        "clean_datatypes": f"""
WITH {CLIENT}
SELECT CAST(id AS VARCHAR) AS id, channel_sales, CAST(num_years_antig AS BIGINT)
         AS num_years_antig,
       cons_12m, cons_gas_12m, cons_last_month, forecast_cons_year,
       CAST(trunc(margin_gross_pow_ele) AS BIGINT) AS margin_gross_pow_ele,
       date_activ, date_end, date_modif_prod, date_renewal,
       CASE WHEN has_gas = 't' THEN 1 ELSE 0 END AS has_gas
FROM client""",
        "clean_client_table": f"""
WITH {CLIENT},
coded AS (SELECT channel_sales, dense_rank() OVER (ORDER BY count(*) DESC) - 1 AS code
          FROM client GROUP BY 1 HAVING count(*) > 20)
SELECT CAST(client.id AS VARCHAR) AS id, CAST(code AS BIGINT) AS channel_sales, num_years_antig,
       date_activ, date_end, date_modif_prod, date_renewal, cons_12m, cons_gas_12m,
       cons_last_month, imp_cons, net_margin, forecast_cons_12m, forecast_cons_year,
       forecast_meter_rent_12m, margin_net_pow_ele, margin_gross_pow_ele,
       CASE WHEN has_gas = 't' THEN 1 ELSE 0 END AS has_gas, churn
FROM client JOIN coded USING (channel_sales)""",
        "clean_price_table": f"""
WITH {PRICE}
SELECT CAST(id AS VARCHAR) AS id, price_date,
       {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in PRICE_COLUMNS)}
FROM price""",
        "feature_preview": feature_rows + " ORDER BY id LIMIT 5",
        "churn_share": share("tenure_years"),
        "churn_share_channel": share("channel_sales"),
        "churn_histogram": histogram(f"{ORDER_VALUES}, {LONG_ORDERS}"),
        "churn_histogram_all": histogram(f"{FEATURES}, {LONG_FEATURES}"),
        "churn_kde": kde(f"{ORDER_VALUES}, {LONG_ORDERS}"),
        "churn_kde_all": kde(f"{FEATURES}, {LONG_FEATURES}"),
        "column_ranges": column_ranges(),
        "schema_report": schema_report(),
        "channel_dummies": f"SELECT c_custkey AS id, {dummy_columns} FROM customer",
        "train_test_split": f"""
SELECT c_custkey AS id,
       CASE WHEN row_number() OVER (ORDER BY {hash_of('c_custkey')}, c_custkey)
                 <= ceil(CAST(count(*) OVER () AS DOUBLE) * CAST(0.2 AS DOUBLE))
            THEN 'test' ELSE 'train' END AS split
FROM customer""",
        "stratified_folds": f"""
WITH labelled AS (
  SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS churn FROM customer),
ranked AS (
  SELECT id, churn, row_number() OVER (PARTITION BY churn ORDER BY {hash_of('id')}, id) AS rn,
         count(*) OVER (PARTITION BY churn) AS n
  FROM labelled)
SELECT id, churn, CAST({folds} AS INTEGER) AS fold FROM ranked""",
        "scaled_features": scaled_features(["tenure_years", *NUMERIC_FEATURES]),
        "scaled_chosen_features": scaled_features(
            ["yearly_consumption", "net_margin", "avg_price_peak_var"]),
        "price_changes_by_channel": f"""
WITH {FEATURES},
changed AS (SELECT id, price_peak_var - lag(price_peak_var)
                         OVER (PARTITION BY id ORDER BY price_date) AS change FROM price),
counted AS (SELECT id, count(change) AS n FROM changed GROUP BY id)
SELECT channel_sales, churn, count(*) AS clients, CAST(sum(n) AS BIGINT) AS changes
FROM features JOIN counted USING (id) GROUP BY channel_sales, churn""",
        "class_weights": f"""
WITH {FEATURES}, {SPLIT},
counted AS (SELECT churn, count(*) AS n FROM split
            WHERE split = 'train' AND churn IS NOT NULL GROUP BY 1)
SELECT churn, n, CAST(sum(n) OVER () AS DOUBLE) / CAST(count(*) OVER () * n AS DOUBLE) AS weight
FROM counted""",
        "evaluate_predictions": f"""
WITH {FEATURES},
judged AS (SELECT churn, CASE WHEN months_to_end < 38 THEN 1 ELSE 0 END AS prediction
           FROM features),
counts AS (
  SELECT count(*) FILTER (WHERE churn = 1 AND prediction = 1) AS hits,
         count(*) FILTER (WHERE churn = 1) AS positives,
         count(*) FILTER (WHERE prediction = 1) AS guessed,
         count(*) FILTER (WHERE churn = prediction) AS correct, count(*) AS n
  FROM judged)
SELECT 'Recall' AS metric, round(coalesce(hits / nullif(positives, 0), 0.0), 2) AS value
FROM counts
UNION ALL SELECT 'Precision', round(coalesce(hits / nullif(guessed, 0), 0.0), 2) FROM counts
UNION ALL SELECT 'Accuracy', round(coalesce(correct / nullif(n, 0), 0.0), 2) FROM counts""",
    }
