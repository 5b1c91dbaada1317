"""Session settings the library relies on, and the shared folder for written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Results depend on the first two (month arithmetic, strict casts); the others are for scale.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows that hold whole texts: smaller batches keep Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


# Aimed-at size of one shuffle partition: a sort of it fits an executor core's memory share.
SHUFFLE_PARTITION_BYTES = 256 * 1024**2


def configure(spark: SparkSession, shuffled_bytes: int | None = None) -> SparkSession:
    """Apply the settings above to a running session. All of them are runtime settings.

    ``shuffled_bytes``, the size of the largest table that has to be shuffled (usually the
    price history), sets the number of shuffle partitions to start from. Adaptive execution
    merges small ones, but it cannot start more than that.
    """
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    if shuffled_bytes:
        wanted = -(-shuffled_bytes // SHUFFLE_PARTITION_BYTES)
        least = 2 * spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", str(max(wanted, least)))
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "keepwatt",
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no call-site capture for every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def _on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_folder(master: str, named: str | None, warehouse: str) -> str:
    """The folder for written tables: ``named``, or one in the warehouse. Without a name, a
    warehouse on the disk of each machine is an error unless all of Spark runs on one machine:
    tasks would write to their own disks and later reads would miss those files."""
    if named:
        return named.rstrip("/")
    scheme = warehouse.split(":", 1)[0] if "://" in warehouse or warehouse.startswith(
        "file:") else "file"
    if scheme == "file" and not _on_one_machine(master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach; "
                         f"the warehouse {warehouse} is a folder of each machine")
    return f"{warehouse.rstrip('/')}/shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``;
    without that setting, one in the session's warehouse. The session is not changed."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return shared_folder(spark.sparkContext.master, named,
                         spark.conf.get("spark.sql.warehouse.dir"))


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared folder; ``staging`` removes it."""
    path = f"{shared_dir(spark)}/keepwatt/{name}-{uuid.uuid4().hex}"
    if (written := _STAGED.get()) is not None:
        written.append(path)
    return path


_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[list[str]]:
    """Remove at the end what ``stage`` and ``new_folder`` wrote inside. Results that are still
    lazy have to be stored elsewhere before. Yields the list of the folders."""
    written: list[str] = []
    token = _STAGED.set(written)
    try:
        yield written
    finally:
        _STAGED.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in written:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several passes follow (split, scaler, forest, profiles): the lineage is cut,
    later scans are columnar and pruned, and a lost executor costs a re-read only. Filters on
    ``partition_by`` columns skip whole folders; use columns with few values. Inside ``staging``
    the table is removed when that ends, otherwise it stays.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
