"""Customer retention analytics as Spark jobs: cleaning, price-sensitivity features,
churn profiling and class-balanced random forests."""

__version__ = "0.1.0"
