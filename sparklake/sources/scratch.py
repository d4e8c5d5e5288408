"""A place for tables that a query makes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the folder that driver and executors share; in a temporary one only if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sparklake-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
