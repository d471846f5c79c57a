"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: adaptive execution re-plans joins at run
# time (broadcast only what it measured to be small, split skewed join
# partitions, coalesce tiny shuffle partitions); ANSI mode makes overflow
# an error instead of a wrong number.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files of DataFrames that are no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "counterfoil",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it up if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    always used.  Only when it is unset and Spark runs in local mode (tests,
    a laptop) is a private scratch folder created.  On a cluster without the
    setting we refuse rather than write to a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # not set
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a shared folder "
                "(HDFS/S3/...) so iterative jobs can cut lineage")
        base = os.environ.get("TMPDIR", "/tmp")
        configured = tempfile.mkdtemp(prefix="counterfoil-ckpt-", dir=base)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet files in the shared checkpoint folder and read
    back, and the folder.  For loops: a ``checkpoint()`` keeps the planner's
    estimate of what it replaced, and a join multiplies its sides' estimates,
    so in a loop that joins its state to itself the digits of that number
    double every round.  The files give the planner their own size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    return store(df)[0]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``store`` made and that nothing reads any more."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        path_of(path).getFileSystem(conf).delete(path_of(path), True)
