"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Everything here may also be set by the cluster; these are only what the operators rely on.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
FOLDER = "spark.checkpoint.dir"

_local_roots: dict[str, str] = {}


def build_session(app: str = "talkweave", master: str | None = None, folder: str | None = None, **conf: str) -> SparkSession:
    """``folder``: the shared scratch folder, where the cluster does not name one."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if folder:
        conf = {FOLDER: folder, **conf}
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names; a private one only where everything runs in this one process."""
    root = spark.conf.get(FOLDER, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError(f"set {FOLDER} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_roots[app]


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared scratch folder."""
    return os.path.join(scratch_root(spark), f"{purpose}-{uuid.uuid4().hex}")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
