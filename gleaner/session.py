"""Session construction and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def get_session(master: str = "local[*]", app: str = "gleaner", **conf: str) -> SparkSession:
    """A session with UTC, AQE and few shuffle partitions; for local use and tests."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir is not set; executors of {master} need a shared folder")
        path = tempfile.mkdtemp(prefix="gleaner-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _cleanup() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; the folder's owner clears it
            pass


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as compressed Parquet to the shared folder and read it back.

    The table outlives executors. It is deleted when the driver exits.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_cleanup)
    path = f"{shared_dir(spark)}/gleaner-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
