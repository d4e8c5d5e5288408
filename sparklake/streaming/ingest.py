"""Continuous ingest: a stream of text files, validated and committed batch by batch, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..errors import DeadLetterThresholdExceeded
from ..operators.deadletter import write_rejects
from ..operators.validate import accepted, judge_lines, rejected
from ..table.log import SnapshotLog
from ..table.writer import append_frame


class StreamIngest:
    """What a stream does with each of its batches.

    The flush id is the stream's id with the batch number. A batch that is run again after a crash rewrites its dead
    letters, which are filed under the flush id, and finds its rows committed. The breaker counts what the log and the
    dead-letter folder hold for this stream: the folder is read once, by the first batch after a start, and counted on
    from there, so a restart doesn't forget and no batch reads the letters of those before.
    """

    def __init__(self, spark: SparkSession, log: SnapshotLog, settings: Settings, source: str, stream_id: str):
        self.spark, self.log, self.settings, self.source, self.stream_id = spark, log, settings, source, stream_id
        self.folder = f"{settings.ingestion.dlq_dir.rstrip('/')}/stream={stream_id}"
        self._bad: dict[str, int] | None = None

    def batch(self, lines: DataFrame, batch_id: int) -> None:
        flush_id = f"{self.stream_id}-{batch_id}"
        if self.log.replay(flush_id) is not None:
            return
        limits = self.settings.ingestion
        judged = judge_lines(lines, limits).persist()
        try:
            bad, good = self._count(judged)
            # a batch with a bad line is looked at line by line: then long lines are rejected too
            if bad and not lines.where(F.octet_length("raw") > limits.max_line_bytes).isEmpty():
                judged.unpersist()
                judged = judge_lines(lines, limits, isolated=True).persist()
                bad, good = self._count(judged)
            known = self._letters()
            write_rejects(rejected(judged), self.folder, flush_id, self.source)
            known[flush_id] = bad
            self._trip(good)
            append_frame(self.log, accepted(judged), flush_id, self.settings.buffer)
        finally:
            judged.unpersist()

    @staticmethod
    def _count(judged: DataFrame) -> tuple[int, int]:
        counts = {r.bad: r.n for r in judged.groupBy(F.col("reason").isNotNull().alias("bad")).agg(F.count("*").alias("n")).collect()}
        return counts.get(True, 0), counts.get(False, 0)

    def _letters(self) -> dict[str, int]:
        """Rejects of this stream by flush id."""
        if self._bad is None:
            try:
                read = self.spark.read.schema("value string, flush string").option("basePath", self.folder).text(self.folder)
                self._bad = {r.flush: r.n for r in read.groupBy("flush").agg(F.count("*").alias("n")).collect()}
            except AnalysisException:  # there is no folder yet
                self._bad = {}
        return self._bad

    def _trip(self, arriving: int) -> None:
        s = self.settings.ingestion
        kept = sum(rows for flush, (_, rows) in self.log.state().flushes.items() if flush.startswith(f"{self.stream_id}-"))
        bad = sum(self._letters().values())
        checked = kept + arriving + bad
        if checked >= s.reject_min_sample and bad / checked > s.max_reject_ratio:
            raise DeadLetterThresholdExceeded("too many records are rejected", checked=checked, rejected=bad, limit=s.max_reject_ratio, accepted_not_written=arriving)


def start(spark: SparkSession, log: SnapshotLog, settings: Settings, folder: str, checkpoint: str, stream_id: str, available_now: bool = False, files_per_trigger: int = 1000) -> StreamingQuery:
    """Ingests the NDJSON files of a folder, those that are there and those that come, or with available_now the former."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).withColumnRenamed("value", "raw")
    handler = StreamIngest(spark, log, settings, folder, stream_id)
    writer = lines.writeStream.foreachBatch(handler.batch).option("checkpointLocation", checkpoint).queryName(f"ingest-{stream_id}")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{settings.buffer.max_age_seconds:g} seconds")
    return writer.start()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window and name, for batches and streams; on a stream the watermark drops what comes later than late."""
    timed = events.withWatermark("event_ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("event_ts", width, slide).alias("w"), "event_name").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_name", "cnt")
