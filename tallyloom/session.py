"""Session defaults for tests and local runs; on a cluster the given session is used as it is."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "tallyloom", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions, a folder of its own for written tables."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("TALLYLOOM_CHECKPOINT_DIR") or f"{tempfile.gettempdir()}/tallyloom-{os.getpid()}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TALLYLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
