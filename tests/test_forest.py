import pytest
from pyspark.sql import functions as F

from conftest import rows
from keepwatt.operators.forest import (
    ForestParams, evaluate_model, evaluate_predictions, feature_importance, forest_of,
    model_parameters, predict, train_random_forest, with_scaler,
)
from keepwatt.operators.preparation import prepare_data
from keepwatt.operators.tuning import SearchSpace, compare_models, train_random_forest_tuned
from keepwatt.plans.churn_model import custom_model, tuned_model
from keepwatt.sources.models import (
    ModelRegistry, data_version, load_model, load_prepared, save_model, save_prepared,
)

SMALL = ForestParams(n_estimators=10, max_depth=4)


@pytest.fixture(scope="module")
def planted(spark):
    """About 12% churners, decided by ``signal`` but for one row in twenty."""
    df = spark.range(2000).select(
        "id", F.rand(1).alias("noise"), F.rand(2).alias("signal"), F.rand(3).alias("more_noise"))
    flipped = F.rand(4) < 0.05
    churn = (F.col("signal") > 0.92).cast("int")
    return df.withColumn("churn", F.when(flipped, 1 - churn).otherwise(churn)).persist()


@pytest.fixture(scope="module")
def prepared(planted):
    return prepare_data(planted)


@pytest.fixture(scope="module")
def model(prepared):
    return train_random_forest(prepared, SMALL)


def test_planted_signal_is_found(spark, prepared, model):
    scores = dict(rows(evaluate_model(model, prepared.test)))
    assert scores["Recall"] > 0.5 and scores["Accuracy"] > 0.85
    importance = rows(feature_importance(spark, model, prepared.features))
    assert importance[-1][0] == "signal"
    assert [v for _, v in importance] == sorted(v for _, v in importance)
    assert abs(sum(v for _, v in importance) - 1) < 1e-3


def test_balancing_raises_recall(planted, prepared, model):
    """Without weights the minority class would be predicted less often."""
    from pyspark.ml.classification import RandomForestClassifier
    from keepwatt.operators.forest import VECTOR, assemble
    plain = RandomForestClassifier(featuresCol=VECTOR, labelCol="churn", numTrees=10,
                                   maxDepth=4, seed=0)
    train = assemble(prepared.train, prepared.features, "churn")
    guessed = plain.fit(train).transform(assemble(prepared.test, prepared.features, "churn"))
    unweighted = dict(rows(evaluate_predictions(guessed)))
    assert dict(rows(evaluate_model(model, prepared.test)))["Recall"] >= unweighted["Recall"]


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, 1.0)] * 2 + [(1, 0.0)] + [(0, 1.0)] + [(0, 0.0)] * 4,
                               "churn int, prediction double")
    assert rows(evaluate_predictions(df)) == [("Recall", 0.67), ("Precision", 0.67),
                                              ("Accuracy", 0.75)]


def test_scores_without_positives(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0)], "churn int, prediction double")
    assert rows(evaluate_predictions(df)) == [("Recall", 0.0), ("Precision", 0.0),
                                              ("Accuracy", 0.5)]
    assert [v for _, v in rows(evaluate_predictions(df.limit(0)))] == [0.0, 0.0, 0.0]


def test_parameters(spark):
    assert rows(model_parameters(spark, ForestParams(10, 4, 5, 2))) == [(10, 4, 5, 2)]
    assert ForestParams(min_samples_split=5, min_samples_leaf=2).undoes_splits
    assert not ForestParams(min_samples_split=4, min_samples_leaf=2).undoes_splits
    assert ForestParams() == ForestParams(100, 20, 2, 1)
    with pytest.raises(ValueError, match="limit of 30"):
        ForestParams(max_depth=31)


def test_saved_model_keeps_its_scaler(planted, prepared, model, tmp_path):
    save_model(with_scaler(prepared, model), str(tmp_path / "model"))
    loaded = load_model(str(tmp_path / "model"))
    expected = rows(predict(model, prepared.data).select("id", "prediction"), "id")
    assert rows(predict(loaded, planted).select("id", "prediction"), "id") == expected


def test_saved_split(spark, prepared, tmp_path):
    save_prepared(prepared, str(tmp_path / "prepared"))
    loaded = load_prepared(spark, str(tmp_path / "prepared"))
    assert loaded.features == prepared.features and loaded.target == "churn"
    assert rows(loaded.test.select("id", "signal"), "id") == rows(
        prepared.test.select("id", "signal"), "id")


def test_registry_trains_only_on_change(spark, planted, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path))
    calls = []

    def build():
        calls.append(1)
        ready = prepare_data(planted)
        return ready, train_random_forest(ready, SMALL)

    features = ["signal", "noise"]
    key = registry.key(features, SMALL, "v1")
    assert key == registry.key(features[::-1], SMALL, "v1")
    assert not registry.has(key)
    for _ in range(2):
        registry.fit_or_load(key, build)
    assert len(calls) == 1 and registry.has(key)
    others = {registry.key(["signal"], SMALL, "v1"), registry.key(features, SMALL, "v2"),
              registry.key(features, ForestParams(), "v1"), registry.key(features, SMALL, "v1", 1)}
    assert len(others | {key}) == 5


def test_changed_data_trains_again(spark, planted, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path))
    data = planted.limit(400).persist()

    def stored(df):
        custom_model(df, ["signal"], SMALL, registry)
        return len([p for p in tmp_path.iterdir() if p.is_dir()])

    assert stored(data) == 1
    assert stored(data.orderBy("signal").repartition(3).select("churn", "signal", "id")) == 1
    other = F.when(F.col("id") == data.first()["id"], F.col("noise") + 1).otherwise(F.col("noise"))
    assert stored(data.withColumn("noise", other)) == 1, "not a feature of this model"
    assert stored(data.withColumn("signal", F.when(
        F.col("id") == data.first()["id"], F.col("signal") + 1e-9).otherwise(F.col("signal")))) == 2


def test_data_version(spark):
    schema = "a int, b string, c double"
    base = [(1, "x", 1.0), (2, None, 2.0), (None, "y", None), (1, "x", 1.0)]
    version = data_version(spark.createDataFrame(base, schema))
    assert version == data_version(spark.createDataFrame(base[::-1], schema).repartition(3))
    assert version == data_version(spark.createDataFrame(base, schema).select("c", "b", "a"))
    others = [base[:3], base + base[:1], [(1, "x", 1.5), *base[1:]], [*base[:1], (2, "", 2.0), *base[2:]],
              [(1, "x", 1.0), (None, "y", 2.0), (2, None, None), (1, "x", 1.0)], []]
    assert len({data_version(spark.createDataFrame(o, schema)) for o in others} | {version}) == 7
    assert version != data_version(spark.createDataFrame(base, "a long, b string, c double"))


def test_half_stored_model_does_not_count(spark, prepared, model, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path))
    save_model(model, f"{registry.path('half')}/model")
    assert not registry.has("half")


def test_search_space():
    space = SearchSpace()
    assert len(set(space.settings())) == 756
    assert len(set(space.sample(50))) == 50 and space.sample(50) == space.sample(50)
    assert space.sample(1000) == space.settings()


def test_tuning(spark, prepared):
    space = SearchSpace((4, 6), (2, 3), (2, 2), (1, 1))
    result = train_random_forest_tuned(prepared, n_trials=3, folds=3, space=space, parallelism=3)
    table = rows(result.trial_table(spark))
    assert len(table) == 3 and table[0][-1] == max(score for _, score in result.trials)
    assert forest_of(result.model).getNumTrees == result.best.n_estimators
    assert result.trials[[p for p, _ in result.trials].index(result.best)][1] == table[0][-1]


def test_model_plans(spark, planted, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path))
    custom = custom_model(planted, ["signal"], SMALL, registry, "v1")
    again = custom_model(planted, ["signal"], SMALL, registry, "v1")
    assert rows(custom.scores()) == rows(again.scores())
    assert rows(again.parameters()) == [(10, 4, 2, 1)]
    assert rows(custom.importance()) == [("signal", 1.0)]
    tuned, _ = tuned_model(planted, 1, 2, SearchSpace((4, 4), (3, 3)))
    assert rows(tuned.parameters())[0][:2] == (4, 3)
    both = compare_models({"custom": (custom.model, custom.prepared),
                           "tuned": (tuned.model, tuned.prepared)})
    assert both.count() == 6
