"""Session helpers shared by tests, the benchmark and batch jobs."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN_FOLDERS: dict[str, str] = {}


def build_session(cores: int | str = "*", app: str = "riskloom") -> SparkSession:
    """Local session for tests and the benchmark; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")  # larger methods are never compiled by the JVM
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This run's own folder for intermediate tables, below ``spark.checkpoint.dir`` (shared storage on a cluster).

    Only where neither that setting nor a checkpoint folder exists, as in local tests, a fresh local
    folder is used. ``clean_up`` removes the run's folder once its results are written.
    """
    app = spark.sparkContext.applicationId
    if app not in _RUN_FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if root is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            root = tempfile.mkdtemp(prefix="riskloom-")
        _RUN_FOLDERS[app] = f"{root}/riskloom-{app}-{uuid.uuid4().hex[:8]}"
    return _RUN_FOLDERS[app]


def clean_up(spark: SparkSession) -> bool:
    """Delete this run's intermediate tables; call it when the results are written. True if there were any."""
    folder = _RUN_FOLDERS.pop(spark.sparkContext.applicationId, None)
    if folder is None:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def cut_lineage(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write an intermediate table once and read it back: computed once, safe against lost executors.

    Spark deals files to tasks by their bytes; where rows decide the work, ``rows_per_file`` bounds a file's rows (0: no
    bound), so that a well packed table does not end up in a few tasks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that no later step reads."""
    spark = table.sparkSession
    files = table.inputFiles()
    folder = shared_folder(spark)
    if files and folder.rpartition("/")[2] in files[0]:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so once their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for compute-heavy groups: small tables are not merged back into one task."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)
