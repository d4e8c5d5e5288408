"""The SparkSession that the engine runs on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .config import Settings

# What results depend on (time zone, strict SQL) and what lets plans adapt to their data.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.runSQLOnFiles": "false",
}


def session(settings: Settings | None = None, app: str = "sparklake", master: str | None = None, **conf: str) -> SparkSession:
    """The session, made if there is none. Without a master of the cluster's own it is local, with the settings' threads.

    query.result_bytes bounds what a query may bring to the driver, query.temp_dir is where a local session spills, and
    query.threads how many tasks a shuffle of a local one has. Executors' memory is Spark's to manage: a query's own
    memory limit has no counterpart but spark.executor.memory."""
    settings = settings or Settings()
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ and not os.environ.get("SPARK_CONF_DIR"):
        builder = builder.master(master or f"local[{settings.runtime.cpu_threads}]")
    s = settings.storage
    for key, value in (("endpoint", s.s3_endpoint), ("endpoint.region", s.s3_region), ("access.key", s.s3_access_key.reveal()), ("secret.key", s.s3_secret_key.reveal())):
        if value:
            builder = builder.config(f"spark.hadoop.fs.s3a.{key}", value)
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(settings.query.arrow_batch_rows), "spark.driver.maxResultSize": str(settings.query.result_bytes)}
    if "SPARK_MASTER" not in os.environ and not os.environ.get("SPARK_CONF_DIR"):
        own |= {"spark.local.dir": settings.query.temp_dir, "spark.sql.shuffle.partitions": str(settings.query.threads)}
    spark = builder.config(map=CONF | own | conf).getOrCreate()
    harden(spark)
    return spark


def harden(spark: SparkSession) -> None:
    """No files named in SQL text, UTC, and timestamps with statistics; also for sessions that spark.newSession() makes."""
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
