"""Session settings this package is written for."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated key inside a nested JSON object keeps its last value, as most JSON readers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_session(app_name: str = "docloom", **settings: str) -> SparkSession:
    """Get or create a session with :data:`SETTINGS`; extra settings win (use ``__`` for dots)."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder that the cluster names.

    Everything a job has to find again after losing an executor (stream checkpoints, landing
    folders, written tables) goes below ``spark.checkpoint.dir``. Where the session does not name
    one, the session's warehouse takes its place. Old folders are the caller's to remove.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/docloom"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
