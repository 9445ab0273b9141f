"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete shuffle files at the end of an execution.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: str | None = None


def get_spark(app: str = "kerbline", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KERBLINE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where none is set, which a local master alone can use."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not shared:
        global _own
        _own = _own or tempfile.mkdtemp(prefix="kerbline-")
        shared = _own
    return shared.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives the loss of an executor, and runs the plan once.

    What the plan shuffled is deleted as soon as it is written, so that the disk holds one step at a time.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before else spark.conf.unset(CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table made by written(); nothing may read it afterwards."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
