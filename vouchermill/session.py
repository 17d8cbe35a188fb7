"""Session settings for jobs that do not bring their own session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None, app: str = "vouchermill", extra: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # no call-site capture for every column expression: plans build faster
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables, below the folder that the session
    names in ``spark.checkpoint.dir``. Only a session without that setting (a
    test) falls back to a local temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # one process, so one file system
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="vouchermill-")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
