"""Session defaults for tests, the benchmark and stand-alone scripts.

On a cluster the session normally exists already; nothing in the library needs
these settings to be right, they only make local runs predictable.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the next operator could have reused the
    # join's partitioning: one extra shuffle beats one task with a third of it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording the Python call site of every column slows down large plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None, app_name: str = "termeval", **conf: str
) -> SparkSession:
    """Get or create a session with the defaults above."""
    if (master or "").startswith("local"):
        # One machine: any folder is shared. A cluster's session names its own.
        conf.setdefault("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "termeval-checkpoints"))
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
