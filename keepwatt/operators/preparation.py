"""From the feature table to model input: dummy columns, split, scaling and class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwatt.operators.hash_split import train_test_split
from keepwatt.session import stage


def category_values(df: DataFrame, column: str, max_categories: int | None = None) -> list:
    """Sorted distinct values of a column. They become column names, so the caller decides
    whether there may be any number; more than ``max_categories`` is an error."""
    values = df.select(F.col(f"`{column}`")).where(F.col(f"`{column}`").isNotNull()).distinct()
    found = (values if max_categories is None else values.limit(max_categories + 1)).collect()
    if max_categories is not None and len(found) > max_categories:
        raise ValueError(f"{column!r} has more than {max_categories} categories")
    return sorted(row[0] for row in found)


def dummies(df: DataFrame, columns: Sequence[str], max_categories: int | None = None,
            categories: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Replace each column by 0/1 columns ``name_value``, appended in value order.

    A missing value gives zeros in all of them. Pass ``categories`` to fix the values, which
    saves the pass that looks them up and keeps the schema independent of the data.
    """
    for name in columns:
        known = (categories or {}).get(name)
        values = known if known is not None else category_values(df, name, max_categories)
        df = df.withColumns({
            f"{name}_{value}": F.when(F.col(f"`{name}`") == F.lit(value), 1).otherwise(0)
            for value in values
        }).drop(name)
    return df


def dummy_vectors(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Replace each column by one sparse 0/1 vector of its name, and (column, position, value):
    what the places of the vectors stand for, values in text order.

    For columns with too many values to be columns of their own. A missing value gives a vector
    of zeros. The values are held by the driver while they are numbered.
    """
    indexes = [f"{c}__index" for c in columns]
    text = df.withColumns({i: F.col(f"`{c}`").cast("string")
                           for i, c in zip(indexes, columns, strict=True)})
    numbered = StringIndexer(inputCols=indexes, outputCols=[f"{i}_number" for i in indexes],
                             stringOrderType="alphabetAsc", handleInvalid="keep").fit(text)
    # missing values have the last number, which has no place in the vector
    encoder = OneHotEncoder(inputCols=[f"{i}_number" for i in indexes],
                            outputCols=[f"{i}_vector" for i in indexes], dropLast=True)
    rows = numbered.transform(text)
    encoded = encoder.fit(rows).transform(rows)
    labels = dict(zip(columns, numbered.labelsArray, strict=True))
    vectors = [F.col(f"{i}_vector").alias(c, metadata={"ml_attr": {"num_attrs": len(labels[c])}})
               for i, c in zip(indexes, columns, strict=True)]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    names = df.sparkSession.createDataFrame(
        [(c, k, value) for c in columns for k, value in enumerate(labels[c])],
        "column string, position int, value string")
    return encoded.select(*kept, *vectors), names


def _is_vector(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, VectorUDT)


def feature_names(df: DataFrame, target: str, drop_columns: Sequence[str] = (),
                  features: Sequence[str] | None = None) -> list[str]:
    """All columns but the target and the dropped ones, or the checked user selection."""
    if features is None:
        left_out = {target, *drop_columns}
        return [c for c in df.columns if c not in left_out]
    unknown = sorted(set(features) - (set(df.columns) - {target}))
    if unknown:
        raise ValueError(f"not available as features: {unknown}")
    return list(features)


def selectable_features(df: DataFrame, excluded: Sequence[str] = ("churn", "id")) -> list[str]:
    """Sorted names of the columns a user may pick as features."""
    return sorted(set(df.columns) - set(excluded))


def _number(value: float) -> str:
    return f"({float(value)!r}D)"


def _as_double(name: str, fill_missing: float | None) -> str:
    value = f"nanvl(CAST(`{name}` AS DOUBLE), NULL)"
    return value if fill_missing is None else f"coalesce({value}, {_number(fill_missing)})"


def fit_scaler(train: DataFrame, features: Sequence[str],
               fill_missing: float | None = None) -> SQLTransformer:
    """Standard scaler fitted on ``train`` in one aggregate: (x - mean) / population spread.

    A constant column is only centred, vectors of dummies stay as they are. The result is a
    Spark ML transformer that replaces the feature columns by their scaled values, so it can be
    saved in a pipeline with a model.
    """
    features = [c for c in features if not _is_vector(train, c)]
    if not features:
        return SQLTransformer(statement="SELECT * FROM __THIS__")
    wide = []
    for c in features:
        value = _as_double(c, fill_missing)
        wide += [f"avg({value}) AS `{c}__mean`", f"stddev_pop({value}) AS `{c}__spread`",
                 f"min({value}) AS `{c}__low`"]
    row = train.agg(*[F.expr(measure) for measure in wide]).first()
    scaled = []
    for c in features:
        value, spread = _as_double(c, fill_missing), row[f"{c}__spread"]
        if spread is None:
            scaled.append(f"{value} AS `{c}`")
            continue
        # the lowest value of a constant column is its exact mean
        centre, scale = (row[f"{c}__mean"], spread) if spread > 0 else (row[f"{c}__low"], 1.0)
        scaled.append(f"({value} - {_number(centre)}) / {_number(scale)} AS `{c}`")
    replaced = ", ".join(f"`{c}`" for c in features)
    return SQLTransformer(
        statement=f"SELECT * EXCEPT ({replaced}), {', '.join(scaled)} FROM __THIS__")


def class_weights(df: DataFrame, label: str = "churn") -> DataFrame:
    """(label, n, weight) with the balanced weight rows / (classes * rows of the class)."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")))
    # the unpartitioned sums run over one row per class
    per_class = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    totals = per_class.select(F.struct("rows", "classes")).scalar()
    return counts.select(
        label, "n",
        (totals.getField("rows") / (totals.getField("classes") * F.col("n"))).alias("weight"))


def weight_table(df: DataFrame, label: str, name: str) -> DataFrame:
    """(label, ``name``): the balanced weight of each class, written, so that its size is known
    where it is joined. There may be any number of classes."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return stage(weights, "class-weights")


@dataclass
class PreparedData:
    """Scaled rows with a ``split`` column, the fitted scaler and the column roles."""

    data: DataFrame
    scaler: SQLTransformer
    features: list[str]
    target: str

    @property
    def train(self) -> DataFrame:
        return self.data.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col("split") == "test")


def prepare_data(df: DataFrame, drop_columns: Sequence[str] = ("id",), target: str = "churn",
                 test_size: float = 0.2, seed: int = 0, keys: Sequence[str] = ("id",),
                 features: Sequence[str] | None = None,
                 fill_missing: float | None = None) -> PreparedData:
    """Select features, split, fit the scaler on the training rows and scale both sides.

    ``df`` is read four times (two counting passes, the scaler and the result), so hand in a
    stored table rather than a long lineage. Key columns stay in the result.
    """
    chosen = feature_names(df, target, drop_columns, features)
    kept = [k for k in dict.fromkeys(keys) if k not in chosen]
    split = train_test_split(df, keys, test_size, seed).select(
        *[F.col(f"`{c}`") for c in [*kept, target, "split", *chosen]])
    scaler = fit_scaler(split.where(F.col("split") == "train"), chosen, fill_missing)
    return PreparedData(scaler.transform(split), scaler, chosen, target)
