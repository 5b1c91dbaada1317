import math

import numpy as np
import pytest

from conftest import rows
from keepwatt.operators.density import churn_kde
from keepwatt.operators.profiling import churn_histogram, churn_share, column_ranges
from keepwatt.plans.churn_profile import profile_all, profile_column


def labelled(spark, churned, stayed, kind="double"):
    data = [(1, v) for v in churned] + [(0, v) for v in stayed]
    return spark.createDataFrame(data, f"churn int, x {kind}")


def test_share_sums_to_100(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 0), ("a", 0), ("b", 0), (None, 1), ("b", None), ("c", 2)],
        "kind string, churn int")
    assert rows(churn_share(df, "kind"), "kind", "count") == [
        ("a", "churn", 1, 1 / 3 * 100), ("a", "no churn", 2, 2 / 3 * 100),
        ("b", "no churn", 1, 100.0), ("c", None, 1, 100.0)]


def test_histogram_edges_come_from_the_churn_rows(spark):
    df = labelled(spark, [0.0, 10.0], [-1.0, 0.0, 10.0, 11.0])
    result = churn_histogram(df, "x", bins=5)
    assert rows(result.select("bin", "bin_center", "churn_count", "no_churn_count",
                              "churn_pct"), "bin") == [
        (0, 1.0, 1, 1, 50.0), (1, 3.0, 0, 0, 0.0), (2, 5.0, 0, 0, 0.0), (3, 7.0, 0, 0, 0.0),
        (4, 9.0, 1, 1, 50.0)]


@pytest.mark.parametrize("churned, centers", [
    ([3.0, 3.0], [2.625, 2.875, 3.125, 3.375]),
    ([], [0.125, 0.375, 0.625, 0.875]),
    ([None, float("nan")], [0.125, 0.375, 0.625, 0.875]),
])
def test_constant_and_empty_churn_class(spark, churned, centers):
    result = churn_histogram(labelled(spark, churned, [3.0]), "x", bins=4)
    assert [r["bin_center"] for r in result.orderBy("bin").collect()] == centers


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bins", [1, 7, 12])
def test_histogram_counts_like_numpy(spark, seed, bins):
    generator = np.random.default_rng(seed)
    # values on the edges are common with one decimal
    churned = np.round(generator.normal(0, 3, 400), 1)
    stayed = np.round(generator.normal(1, 4, 900), 1)
    first, edges = np.histogram(churned, bins=bins)
    second, _ = np.histogram(stayed, bins=edges)
    df = labelled(spark, churned.tolist(), stayed.tolist())
    result = churn_histogram(df, "x", bins).orderBy("bin").collect()
    assert [r["churn_count"] for r in result] == first.tolist()
    assert [r["no_churn_count"] for r in result] == second.tolist()
    np.testing.assert_allclose([r["bin_center"] for r in result],
                               (edges[:-1] + edges[1:]) / 2, rtol=1e-12)


def test_histogram_of_several_columns_in_one_result(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 3, None), (0, 2, 6.0)],
                               "churn int, a int, b double")
    result = churn_histogram(df, ["a", "b"], bins=2)
    assert rows(result.select("column", "bin", "churn_count", "no_churn_count"),
                "column", "bin") == [("a", 0, 1, 0), ("a", 1, 1, 1), ("b", 0, 0, 0),
                                     ("b", 1, 1, 0)]


def test_ranges(spark):
    df = spark.createDataFrame([(1.0, None), (5.0, None), (float("nan"), None)],
                               "a double, b double")
    assert rows(column_ranges(df, ["a", "b"]), "column") == [
        ("a", 1.0, 5.0, 0.04), ("b", None, None, None)]


def brute_force(values, grid):
    values = np.asarray(values)
    h = values.std(ddof=1) * len(values) ** -0.2
    u = (np.asarray(grid)[:, None] - values[None, :]) / h
    return np.exp(-u * u / 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("bounds, points", [
    (None, 1000), ((0.0, 2.0), 1000), ((-500.0, 500.0), 333), ((1.5, 1.5), 4), ((30, 31), 5)])
def test_density_equals_the_sum_over_all_rows(spark, bounds, points):
    generator = np.random.default_rng(5)
    churned = generator.lognormal(0, 1, 300)
    stayed = np.concatenate([generator.normal(4, 0.5, 500), [40.0, -20.0]])
    df = labelled(spark, churned.tolist(), stayed.tolist())
    result = churn_kde(df, {"x": bounds}, points).toPandas()
    assert len(result) == 2 * points
    low, high = bounds or (-20.0, churned.max() if churned.max() > 40 else 40.0)
    grid = np.linspace(low, high, points)
    for flag, values in ((1, churned), (0, stayed)):
        part = result[result.churn == flag].sort_values("point")
        np.testing.assert_allclose(part.x, grid, rtol=1e-12, atol=1e-9)
        exact = brute_force(values, grid)
        peak = 1 / (values.std(ddof=1) * len(values) ** -0.2 * math.sqrt(2 * math.pi))
        np.testing.assert_allclose(part.density, exact, rtol=1e-9, atol=1e-14 * peak)


def test_density_integrates_to_one(spark):
    generator = np.random.default_rng(1)
    df = labelled(spark, generator.normal(0, 1, 200).tolist(), [0.0, 1.0, 2.0])
    result = churn_kde(df, {"x": (-8.0, 10.0)}).toPandas()
    for _, part in result.groupby("churn"):
        assert abs(np.trapezoid(part.sort_values("point").density, dx=18 / 999) - 1) < 1e-6


@pytest.mark.parametrize("churned", [[], [1.0], [2.0, 2.0, 2.0]])
def test_no_density_without_spread(spark, churned):
    result = churn_kde(labelled(spark, churned, [1.0, 2.0]), {"x": (0.0, 3.0)}, 10).toPandas()
    assert result[result.churn == 1].density.isna().sum() == 10
    assert (result[result.churn == 0].density > 0).sum() == 10


def test_profile_plan(spark, small):
    from keepwatt import roles
    df = roles.feature_role(spark, small).persist()
    assert set(profile_column(df, "tenure_years")) == {"share"}
    numeric = profile_column(df, "net_margin", density_range=(0.0, 1e5))
    assert numeric["histogram"].count() == 12 and numeric["density"].count() == 2000
    everything = profile_all(df)
    assert everything["histograms"].count() == 22 * 12
    assert everything["ranges"].count() == 22
