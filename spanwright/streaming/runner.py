"""Detection over a stream of spans, with a sink that replays leave unchanged.

Each micro-batch names the traces that got spans; those traces are read whole from the table of spans, detected, and their findings are written
unless the sink has them. Finding ids are hashes of content, so that a batch that runs twice adds nothing, and a trace that grows
adds only findings that are new. Spark's checkpoint moves on only after the batch is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators.detectors import Facts, Limits, detect

FINDINGS = "finding_id string, detector_id string, detector_version string, trace_id string, severity string, recovery string, subject string, operation string, error_kind string, failure_signature string, evidence array<string>, created_at string, metadata map<string,string>"


@dataclass
class RunStats:
    batches: int = 0
    traces: int = 0
    written: int = 0
    skipped: int = 0


class FindingSink:
    """A folder of findings, each at most once."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.schema(FINDINGS).parquet(self.path)

    def _there(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def write(self, found: DataFrame) -> tuple[int, int]:
        """(written, already there)."""
        found = found.dropDuplicates(["finding_id"]).persist()
        try:
            n = found.count()
            new = found.join(self.read().select("finding_id"), "finding_id", "left_anti") if self._there() else found
            new = new.select(*[x.split()[0] for x in FINDINGS.split(", ")]).persist()
            k = new.count()
            if k or not self._there():
                new.write.mode("append").parquet(self.path)
            new.unpersist()
            return k, n - k
        finally:
            found.unpersist()


def run_detection(spark: SparkSession, spans_path: str, sink_path: str, checkpoint: str, mappings: DataFrame | None = None, detectors: list[str] | None = None, limits: Limits | None = None, max_files: int = 1000, available_now: bool = True):
    """Starts (and with ``available_now`` finishes) the stream; returns (query, stats)."""
    schema = spark.read.parquet(spans_path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet").parquet(spans_path)
    sink, stats = FindingSink(spark, sink_path), RunStats()

    def batch(df: DataFrame, epoch: int) -> None:
        touched = df.select("trace_id").distinct()
        all_spans = spark.read.schema(schema).parquet(spans_path).join(touched, "trace_id", "left_semi")
        written, skipped = sink.write(detect(Facts.of(all_spans, mappings), detectors, limits))
        stats.batches += 1
        stats.traces += touched.count()
        stats.written += written
        stats.skipped += skipped

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    q = q.trigger(availableNow=True).start() if available_now else q.trigger(processingTime="10 seconds").start()
    if available_now:
        q.awaitTermination()
    return q, stats


def assembled_traces(spans: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Of a stream of spans (``ingested_at`` timestamp): sessions of each trace that end after ``gap`` without spans; repeated deliveries count once."""
    s = spans.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["trace_id", "id"])
    return s.groupBy("trace_id", F.session_window("ingested_at", gap)).agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
