"""Session settings the library relies on: UTC clock, adaptive execution, checkpoints."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job needs. Adaptive execution picks broadcast joins from measured
# sizes and splits skewed shuffle partitions, so operators carry no size-blind hints.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small shuffles that later unfold (n-grams, tiles) still use all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Table jobs: before a run the size of a join side is guessed from compressed files, which a join, an n-gram or a
# vector behind them exceeds many times over. Only sizes measured by adaptive execution may broadcast a side, and
# a task gets a fixed amount of input however large the tables are, so its memory does not grow with them.
TABLE_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.files.maxPartitionBytes": "16MB",
}


def build_session(app: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; ``conf`` uses double underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare_session(builder.getOrCreate())


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created and ship the package to its
    executors, so that functions run inside tasks can import it."""
    context = spark.sparkContext
    if not any(name.endswith("feedloom.zip") for name in context.listFiles):
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="spark-")) / "feedloom"), "zip", root.parent, root.name
        )
        context.addPyFile(archive)
    configure(spark, RUNTIME_CONF)
    return spark


def configure(spark: SparkSession, settings: dict[str, str]) -> None:
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only where the cluster names none (tests on one machine) a fresh folder is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write a result several later stages share and read it back.

    The written table cuts lineage, survives lost executors, and gives later joins true sizes.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/feedloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
