"""Session helpers: sane defaults for local runs, and a shared checkpoint folder.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a shared file system path
named by the cluster); this module only invents one when the session has none *and* runs in local
mode, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.checkpoint.compress": "true",
}


def get_spark(
    master: str | None = None,
    app_name: str = "riskloom",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the SparkContext.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset and the master is local
    (tests, laptops) a fresh folder under the system temp dir is used; on a cluster an unset
    folder is an error, because a machine-local path would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS/...)"
            )
        configured = tempfile.mkdtemp(prefix="riskloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a materialised intermediate table inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    This cuts the lineage (every later use and every retry after an executor loss sees the same
    stored rows) with a columnar, compressed copy, so later passes read only the columns they use. Call
    :func:`drop_stored` when the results that depend on stored tables have been written.
    """
    spark = df.sparkSession
    path = stored_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_STORED: list[str] = []


def stored_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared checkpoint folder, which :func:`drop_stored` deletes."""
    _STORED.append(scratch_path(spark, f"{name}-{uuid.uuid4().hex}"))
    return _STORED[-1]


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialise` has stored in this process so far; return their number.

    DataFrames that still read them fail afterwards, so this belongs behind the last write of a job.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done
