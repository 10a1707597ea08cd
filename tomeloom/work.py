"""Written tables between the steps of a job, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tasks that spread() makes for each core.
TASKS_PER_CORE = 4
#: Rows that a task of dealt() gets about, where its table is large.
ROWS_PER_TASK = 500_000

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-work-"))
    return _local[0]


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tomeloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a new shared folder and read back: cuts lineage, and a lost executor costs a task."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores, some tasks each: a table of small files is read by few tasks, too few for long work on each row."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, rows: int, key: str) -> DataFrame:
    """df dealt out by a key to a number of tasks that follows its rows, if the session's shuffles have fewer."""
    tasks = rows // ROWS_PER_TASK
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM, for what DataFrames cannot do: renames, listings, small files."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that nobody has written: False if there is one. The text is there whole or not at all.

    The text goes to a name of its own first and is then renamed, which fails if the target exists.
    """
    fs, target = hadoop_path(spark, path)
    if fs.exists(target):
        return False
    _, aside = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    try:
        none = spark.sparkContext._gateway.new_array(options, 0)
        context.rename(aside, target, none)
        return True
    except Exception:
        fs.delete(aside, False)
        if fs.exists(target):
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    fs, found = hadoop_path(spark, path)
    stream = fs.open(found)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no folder."""
    fs, found = hadoop_path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(found)] if fs.exists(found) else []
