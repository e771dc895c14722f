"""Session defaults and the shared folder for cut lineage and stage tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# hub entities: split a skewed join even where that costs one more exchange
SKEW = "spark.sql.adaptive.forceOptimizeSkewedJoin"
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"  # of a JSON object: the last one counts
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; a cluster's own settings win over these."""
    builder = (
        SparkSession.builder.appName("spoorline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(SKEW, "true")
        .config(REPEATED_KEYS, "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> None:
    """Turns on the splitting of skewed joins in a session made elsewhere, and lets Python workers find this package.

    Records with repeated keys are read. Batches for Python workers get fewer rows than Spark's default, as a row may be a whole document.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    for key in (SKEW, REPEATED_KEYS):
        if spark.conf.get(key, "false") != "true":
            spark.conf.set(key, "true")
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    # workers live on between stages: large arrays go back to the system when they are freed
    for name, value in (("MALLOC_MMAP_THRESHOLD_", "2097152"), ("MALLOC_ARENA_MAX", "2"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one below the warehouse.

    On a cluster a warehouse on the local disk is no such folder and is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
        if root.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


class Stage:
    """A scope whose stage tables are deleted when it ends; ``keep`` hands a table to the scope around it."""

    def __init__(self, paths: list[str], outer: tuple[list[str], ...]):
        self.paths, self._outer = paths, outer

    def keep(self, df: DataFrame) -> DataFrame:
        token = _scopes.set(self._outer)
        try:
            return cut(df)
        finally:
            _scopes.reset(token)


@contextmanager
def stage(spark: SparkSession) -> Iterator[Stage]:
    """Deletes at its end all tables that ``cut`` and ``scratch_path`` made inside; lazy results must be kept before."""
    outer = _scopes.get()
    made: list[str] = []
    token = _scopes.set((*outer, made))
    try:
        yield Stage(made, outer)
    finally:
        _scopes.reset(token)
        for path in made:
            if name := _table_of(path):
                spark.sql(f"drop table if exists {name}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder; the scope around it deletes it."""
    path = f"{shared_root(spark)}/spoorline/{name}-{uuid.uuid4().hex}"
    if scopes := _scopes.get():
        scopes[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads it back.

    Freezes the rows and drops the lineage, survives lost executors, and later steps read only the columns they
    need; the table's size is known, so the planner broadcasts it exactly when it is small.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_of(path: str) -> str | None:
    last = path.rsplit("/", 1)[-1]
    return f"spoorline_{last.replace('-', '_')}" if last.startswith("buckets-") else None


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """As ``cut``, but stored in sorted buckets of ``column``: joins and groups on it read the table without an exchange.

    There are as many buckets as shuffle partitions, so the other side of a join has the same layout. The table's files
    are in the shared folder; its catalog entry goes with them at the end of the scope.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "buckets")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one file per bucket
    laid_out = df.repartition(buckets, column)
    laid_out.write.option("compression", "lz4").option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(_table_of(path))
    return spark.table(_table_of(path))


def frozen(df: DataFrame) -> DataFrame:
    """The rows in a reliable checkpoint, which Spark's cleaner removes once the DataFrame is gone."""
    shared_root(df.sparkSession)
    return df.checkpoint()
