"""Written tables that cut lineage, and small helpers around the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A scan of fewer, smaller files than this is spread over all cores.
SMALL_INPUT_BYTES = 1 << 30


_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may do without it, and gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="themata-")
    return _local_roots[sc.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{scratch_root(spark)}/themata/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and return it read back, without its lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, new_folder(df.sparkSession, label))


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` in a fixed number of buckets by ``key`` and return it read back.

    Joins and sums by ``key`` of tables with the same buckets shuffle none of them.
    """
    name = f"themata_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key)
        .sortWithinPartitions(key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(name)
    )
    df.sparkSession.sql(f"DROP TABLE {name}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return read_buckets(df.sparkSession, path, columns, key, buckets)


def read_buckets(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A table of ``write_buckets``; ``schema`` is DDL.

    Only the catalog can tell Spark about buckets. The entry points to files outside of the
    warehouse and is needed while the frame is made, so none is left behind.
    """
    name = f"themata_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that a run wrote itself and no longer needs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of a few small files.

    Larger inputs already give the scan enough splits and are left as they are,
    so no large input is shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SMALL_INPUT_BYTES and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
