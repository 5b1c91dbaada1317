"""Registered queries: each operator on the given tables, with SQL to check it against."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracles  # noqa: E402
from keepwatt import roles  # noqa: E402
from keepwatt.operators.cleaning import (  # noqa: E402
    channel_codes as codes_of, clean_channel_sales as clean_channels, clean_datatypes as retype,
)
from keepwatt.operators.density import churn_kde as kde  # noqa: E402
from keepwatt.operators.features import (  # noqa: E402
    client_consumption_distinct as distinct_pairs, price_changes as changes_of,
)
from keepwatt.operators.forest import (  # noqa: E402
    ForestParams, evaluate_predictions as evaluate, predict, with_scaler,
)
from keepwatt.operators.hash_split import (  # noqa: E402
    stratified_folds as folds_of, train_test_split as split_of,
)
from keepwatt.operators.preparation import (  # noqa: E402
    class_weights as weights_of, dummies, prepare_data, selectable_features,
)
from keepwatt.operators.profiling import (  # noqa: E402
    churn_histogram as histogram, churn_share as share, column_ranges as ranges_of,
)
from keepwatt.operators.tuning import SearchSpace, compare_models  # noqa: E402
from keepwatt.plans.churn_model import (  # noqa: E402
    custom_model, encoded_features, tuned_model,
)
from keepwatt.plans.clean_tables import (  # noqa: E402
    build_client_table, build_price_table,
)
from keepwatt.plans.feature_table import register_views  # noqa: E402
from keepwatt.schemas import NUMERIC_FEATURES, PRICE_COLUMNS  # noqa: E402
from keepwatt.session import (  # noqa: E402
    SHUFFLE_PARTITION_BYTES, configure, new_folder, stage,
)
from keepwatt.sources.catalog import (  # noqa: E402
    read_features, register_tables, write_features,
)
from keepwatt.sources.csv_tables import (  # noqa: E402
    ROWS_PER_GZIP, load_table, preview, schema_report as report_of, write_csv,
)
from keepwatt.sources.models import (  # noqa: E402
    ModelRegistry, load_model, load_prepared, save_model, save_prepared,
)

SMOKE_DIR = "/root/testdata/sf0.001"

FOREST = ForestParams()
DENSITY_RANGES = {"avg_price_mid_peak_var": (0.1, 0.2), "avg_price_peak_var": (0.0, 12.0)}


def staged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table written once, for queries that read it several times."""
    return stage(roles.feature_role(spark, sf_dir), "features")


def numeric_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_features(spark, sf_dir).drop("channel_sales")


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def price_sensitivity_features(spark, sf_dir):
    return roles.feature_role(spark, sf_dir)


def price_changes(spark, sf_dir):
    changes = changes_of(roles.price_role(spark, sf_dir))
    return rounded(changes, [f"{c}_change" for c in PRICE_COLUMNS])


def price_changes_repeated(spark, sf_dir):
    """Changes between the months of order lines, several of which share a client and month."""
    names = PRICE_COLUMNS[:3]
    changes = changes_of(roles.price_line_role(spark, sf_dir), names)
    return rounded(changes, [f"{c}_change" for c in names])


def client_consumption_distinct(spark, sf_dir):
    return distinct_pairs(roles.read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


def clean_channel_sales(spark, sf_dir):
    return clean_channels(roles.channel_role(spark, sf_dir))


def channel_codes(spark, sf_dir):
    return codes_of(roles.channel_role(spark, sf_dir))


def clean_datatypes(spark, sf_dir):
    """The client columns turned to text and cleaned back to their types."""
    floats = ["cons_12m", "cons_gas_12m", "cons_last_month", "forecast_cons_year"]
    dates = ["date_activ", "date_end", "date_modif_prod", "date_renewal"]
    whole = ["num_years_antig", "margin_gross_pow_ele"]
    client = roles.client_role(spark, sf_dir)
    text = client.select("id", "channel_sales", "margin_gross_pow_ele", *[
        F.col(c).cast("string").alias(c) for c in ["num_years_antig", *floats, *dates, "has_gas"]])
    return retype(text, float_columns=floats, int_columns=whole, str_columns=["id"],
                  date_columns=dates, bool_columns=["has_gas"])


def _work_folder(spark, name):
    """A new folder for one run of a query that writes files."""
    return new_folder(spark, name)


def clean_client_table(spark, sf_dir):
    """Raw client CSV to the clean client table."""
    folder = _work_folder(spark, "client")
    raw = roles.client_role(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    write_csv(raw, f"{folder}/raw", rows_per_gzip=ROWS_PER_GZIP)
    return build_client_table(spark, f"{folder}/raw", f"{folder}/clean")


def clean_price_table(spark, sf_dir):
    """Raw price CSV to the clean price table."""
    folder = _work_folder(spark, "price")
    raw = roles.price_role(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    write_csv(raw, f"{folder}/raw", rows_per_gzip=ROWS_PER_GZIP)
    return rounded(build_price_table(spark, f"{folder}/raw", f"{folder}/clean"), PRICE_COLUMNS)


def churn_share(spark, sf_dir):
    return share(roles.feature_role(spark, sf_dir), "tenure_years")


def churn_share_channel(spark, sf_dir):
    return share(roles.feature_role(spark, sf_dir), "channel_sales")


def churn_histogram(spark, sf_dir):
    return histogram(roles.order_value_role(spark, sf_dir), "o_totalprice", bins=12)


def churn_histogram_all(spark, sf_dir):
    return histogram(staged_features(spark, sf_dir), NUMERIC_FEATURES, bins=12)


def _scaled_density(densities: DataFrame) -> DataFrame:
    """Density times the length of the grid, which puts all columns on one scale for rounding.
    The window holds the 2000 grid points of one column."""
    one_grid = Window.partitionBy("column")
    length = F.max("x").over(one_grid) - F.min("x").over(one_grid)
    return densities.select(
        "column", "churn", "point", F.round("x", 6).alias("x"),
        F.round(length * F.col("density"), 6).alias("relative_density"))


def churn_kde(spark, sf_dir):
    return _scaled_density(kde(roles.order_value_role(spark, sf_dir), {"o_totalprice": None}))


def churn_kde_all(spark, sf_dir):
    return _scaled_density(kde(staged_features(spark, sf_dir),
                               {c: None for c in NUMERIC_FEATURES}))


def churn_kde_ranges(spark, sf_dir):
    """Densities on grids that a user gave."""
    return _scaled_density(kde(staged_features(spark, sf_dir), DENSITY_RANGES))


def column_ranges(spark, sf_dir):
    return ranges_of(roles.feature_role(spark, sf_dir))


def schema_report(spark, sf_dir):
    return report_of(roles.feature_role(spark, sf_dir))


def feature_preview(spark, sf_dir):
    """The first five rows of the feature table by id."""
    return preview(roles.feature_role(spark, sf_dir), 5, ["id"])


def channel_dummies(spark, sf_dir):
    customer = roles.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("channel_sales"))
    return dummies(customer, ["channel_sales"])


def train_test_split(spark, sf_dir):
    customer = roles.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return split_of(customer, ["id"], 0.2, seed=0)


def stratified_folds(spark, sf_dir):
    customer = roles.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("churn"))
    return folds_of(customer, "churn", ["id"], folds=5, seed=0)


def scaled_features(spark, sf_dir):
    prepared = prepare_data(numeric_input(spark, sf_dir), fill_missing=0.0)
    return rounded(prepared.data, prepared.features)


def scaled_chosen_features(spark, sf_dir):
    """Model input for features that a user picked."""
    chosen = ["yearly_consumption", "net_margin", "avg_price_peak_var"]
    prepared = prepare_data(numeric_input(spark, sf_dir), features=chosen, fill_missing=0.0)
    return rounded(prepared.data, prepared.features)


def price_changes_by_channel(spark, sf_dir):
    """The client and price tables through their SQL views."""
    register_tables(client_data=roles.client_role(spark, sf_dir),
                    price_data=roles.price_role(spark, sf_dir))
    register_views(spark, as_of=roles.AS_OF)
    return spark.sql("""
        WITH counted AS (SELECT id, count(price_peak_var_change) AS n
                         FROM price_change GROUP BY id)
        SELECT channel_sales, churn, count(*) AS clients, sum(n) AS changes
        FROM describe_price JOIN counted USING (id) GROUP BY channel_sales, churn""")


def class_weights(spark, sf_dir):
    labels = stage(roles.feature_role(spark, sf_dir).select("id", "churn"), "labels")
    split = split_of(labels, ["id"], 0.2, seed=0)
    return weights_of(split.where(F.col("split") == "train"))


def evaluate_predictions(spark, sf_dir):
    guess = F.when(F.col("months_to_end") < 38, 1).otherwise(0)
    return evaluate(roles.feature_role(spark, sf_dir).withColumn("prediction", guess))


def _encoded(spark, sf_dir):
    return encoded_features(staged_features(spark, sf_dir))


def forest_scores(spark, sf_dir):
    return custom_model(_encoded(spark, sf_dir), params=FOREST).scores()


def forest_importance(spark, sf_dir):
    return custom_model(_encoded(spark, sf_dir), params=FOREST).importance()


def importance_of_nodes(spark, sf_dir):
    """Whether importances added up from the stored trees are those of the model, by feature."""
    model = custom_model(_encoded(spark, sf_dir), params=FOREST)
    own = model.importance().withColumnRenamed("importance", "own")
    both = stage(model.importance_of_nodes().join(own, "feature"), "importances")
    close = F.abs(F.col("importance") - F.col("own")) < 0.00015
    total = both.agg(F.round(F.sum("importance"), 1)).scalar()
    return both.select("feature", close.alias("as_in_model"), total.alias("sum_of_all"))


def forest_parameters(spark, sf_dir):
    """The settings of a stored and loaded model."""
    registry = ModelRegistry(spark, _work_folder(spark, "models"))
    return custom_model(_encoded(spark, sf_dir), params=FOREST, registry=registry).parameters()


def forest_tuned(spark, sf_dir):
    """The whole search: 50 settings of the default space in 5 folds."""
    _, result = tuned_model(_encoded(spark, sf_dir), n_trials=50, folds=5)
    return result.trial_table(spark)


def _compared(encoded, chosen=None, n_trials=50):
    custom = custom_model(encoded, chosen, params=FOREST)
    tuned, _ = tuned_model(encoded, n_trials=n_trials, folds=5, chosen=chosen)
    return compare_models({"custom": (custom.model, custom.prepared),
                           "tuned": (tuned.model, tuned.prepared)})


def tuned_vs_custom(spark, sf_dir):
    return _compared(_encoded(spark, sf_dir))


def _ruled(spark, sf_dir):
    """Clients whose label is a noisy rule on the channel, and the features that show it. What a
    forest should say of them can be stated in SQL."""
    encoded = encoded_features(stage(roles.rule_role(spark, sf_dir), "features"))
    return encoded, [c for c in encoded.columns if c.startswith("channel_sales_")]


def rule_forest_scores(spark, sf_dir):
    encoded, chosen = _ruled(spark, sf_dir)
    return custom_model(encoded, chosen, params=FOREST).scores()


def rule_tuned_vs_custom(spark, sf_dir):
    return _compared(*_ruled(spark, sf_dir))


def rule_forest_tuned(spark, sf_dir):
    """All 756 settings of the default space in 5 folds."""
    encoded, chosen = _ruled(spark, sf_dir)
    space = SearchSpace()
    _, result = tuned_model(encoded, n_trials=len(space.settings()), folds=5, space=space,
                            chosen=chosen)
    best = F.lit(True)
    for name, value in result.best.as_dict().items():
        best = best & (F.col(name) == value)
    return rounded(result.trial_table(spark).withColumn("best", best), ["recall"])


def rule_model_roundtrip(spark, sf_dir):
    """Predictions for unscaled clients by a model that was stored with its scaler and loaded."""
    encoded, chosen = _ruled(spark, sf_dir)
    registry = ModelRegistry(spark, _work_folder(spark, "models"))
    trained = custom_model(encoded, chosen, params=FOREST, registry=registry)
    path = f"{registry.folder}/with-scaler"
    save_model(with_scaler(trained.prepared, trained.model), path)
    del trained  # the driver need not hold the model twice
    return predict(load_model(path), encoded).select("id", "churn", "prediction")


def prepared_split_roundtrip(spark, sf_dir):
    """Train and test rows, stored with their scaler and loaded."""
    chosen = ["yearly_consumption", "net_margin"]
    prepared = prepare_data(numeric_input(spark, sf_dir), features=chosen, fill_missing=0.0)
    path = _work_folder(spark, "prepared")
    save_prepared(prepared, path)
    loaded = load_prepared(spark, path)
    return rounded(loaded.data, loaded.features)


def selectable_columns(spark, sf_dir):
    """The columns that a user may pick as features, by name."""
    names = selectable_features(_encoded(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(names)), "position int, feature string")


def feature_table_roundtrip(spark, sf_dir):
    """Feature table to Parquet, from there to CSV, and back with the same types."""
    features = staged_features(spark, sf_dir)
    folder = _work_folder(spark, "roundtrip")
    write_csv(features, f"{folder}/csv")
    write_features(load_table(spark, f"{folder}/csv", features.schema), f"{folder}/parquet")
    return read_features(spark, f"{folder}/parquet")


def csv_text_roundtrip(spark, sf_dir):
    """Texts with quotes, line breaks and blanks to CSV and back."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text")
    folder = _work_folder(spark, "texts")
    write_csv(talks, f"{folder}/csv")
    return load_table(spark, f"{folder}/csv", talks.schema, missing=[""])


def model_roundtrip(spark, sf_dir):
    """Predictions for all clients by a model that was saved with its scaler and loaded."""
    encoded = _encoded(spark, sf_dir)
    registry = ModelRegistry(spark, _work_folder(spark, "models"))
    trained = custom_model(encoded, params=FOREST, registry=registry)
    path = f"{registry.folder}/with-scaler"
    save_model(with_scaler(trained.prepared, trained.model), path)
    del trained  # the driver need not hold the model twice
    return predict(load_model(path), encoded).select("id", "churn", "prediction")


def entry(spark: SparkSession) -> DataFrame:
    return price_sensitivity_features(configure(spark), SMOKE_DIR)


REGISTERED = [
    price_sensitivity_features, price_changes, client_consumption_distinct,
    clean_channel_sales, channel_codes, clean_datatypes, clean_client_table, clean_price_table,
    churn_share, churn_share_channel, churn_histogram, churn_histogram_all,
    churn_kde, churn_kde_all, column_ranges, schema_report, feature_preview,
    channel_dummies, train_test_split, stratified_folds, scaled_features,
    scaled_chosen_features, price_changes_by_channel, class_weights,
    evaluate_predictions, forest_scores, forest_importance, forest_parameters, forest_tuned,
    tuned_vs_custom, feature_table_roundtrip, csv_text_roundtrip, model_roundtrip,
    price_changes_repeated, churn_kde_ranges, selectable_columns, importance_of_nodes,
    rule_forest_scores, rule_tuned_vs_custom, rule_forest_tuned, rule_model_roundtrip,
    prepared_split_roundtrip,
]


LLM_QUERIES, LLM_SQL = {}, {}
try:  # the subpackage for training data may be left out
    from keepwatt.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name != "keepwatt.llm":
        raise
else:
    LLM_QUERIES |= {query.__name__: query for query in llm.REGISTERED}
    LLM_SQL |= llm.ORACLE_SQL
    try:  # and so may its pipeline
        import corpus_pipeline
    except ModuleNotFoundError as missing:
        if missing.name != "corpus_pipeline":
            raise
    else:
        LLM_QUERIES["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def sized(spark: SparkSession, folder: str) -> SparkSession:
    """The session configured for the tables of a folder: more shuffle partitions than it has, if
    their size asks for them, never fewer."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stored = files.getContentSummary(path).getLength()
    enough = int(spark.conf.get("spark.sql.shuffle.partitions")) * SHUFFLE_PARTITION_BYTES
    return configure(spark, stored if stored > enough else None)


def _configured(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(sized(spark, sf_dir), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {query.__name__: query for query in REGISTERED} | LLM_QUERIES
    return {name: _configured(query) for name, query in named.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | LLM_SQL
