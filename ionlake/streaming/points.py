"""Chromatograms of files as they arrive: a stream over a folder of point tables.

A file's points arrive in one Parquet file, so a micro-batch holds whole files and its
chromatograms are those a batch job would give. Pairs that are there already are not made
again, so a batch that is repeated after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ionlake.operators import extract as E
from ionlake.sources.readers import POINTS


def extract_arriving(spark: SparkSession, folder: str, targets: DataFrame, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Start a stream that appends the MS1 chromatograms of new point tables under ``folder`` to ``out`` and ends when none is left."""

    def step(points: DataFrame, _: int) -> None:
        points = points.filter("ms_file_label IS NOT NULL")
        samples = points.select("ms_file_label").distinct().withColumn("use_for_processing", F.lit(True))
        try:
            have = spark.read.parquet(out).select("peak_label", "ms_file_label", "ms_type")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = None
        pairs = E.pending_pairs(targets, samples, have)
        E.extract_ms1(points, targets, pairs, E.scan_lookup(points)).write.mode("append").parquet(out)

    source = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
