"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Settings the jobs are written for. A cluster's own values for cores, memory and
# shuffle width win: pass them as overrides or set them in spark-defaults.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The JVM interprets, and never compiles, methods beyond 8,000 bytecodes. Wide metric
    # projections fused with their scan grow past that; under this limit Spark generates
    # them operator by operator, in small methods, which runs several times faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # lets a 10,000-row ordered reader prune inside each task before its shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def build_session(app: str = "larder", master: str | None = None, **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="larder-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that setting is absent, a session whose tasks all run on this machine gets a folder of its own;
    on a cluster there is none that all executors would see, so it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return _own_folder()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one run's written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
