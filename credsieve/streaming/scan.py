"""Continuous scans with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.match import scan_scannable
from ..storage import path_exists


def scan_stream(lines: DataFrame, rules: DataFrame, placeholder: Callable[[Column], Column] = X.is_placeholder) -> DataFrame:
    """Matches of arriving lines (path, line, ts), as a batch finds them: overlaps and generic matches are settled within the line, so that nothing is shuffled and each micro-batch stands alone."""
    return scan_scannable(lines, rules, placeholder=placeholder).withColumn("fingerprint", X.fingerprint(F.col("display_name"), F.col("path"), F.col("value")))


def first_seen(hits: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each fingerprint once within the watermark's delay; remember_new has no such limit."""
    return hits.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def remember_new(root: str, key: str = "fingerprint") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append to the table at root those rows of each micro-batch whose key no earlier one had, one a key.

    The table is the memory, so that the stream itself has no state, and a key is known however long ago it came. Each
    micro-batch has a folder of its own (batch=<id>), which it overwrites; it looks at the folders of earlier ones only.
    So one that is done again after a failure finds what it found before, and nothing is kept twice. Of a key's rows the least
    (by key, then the other columns) is taken. What is known meets a micro-batch's keys, which are few, in a semi join, so that the
    table's keys are read but not shuffled when Spark can broadcast those. Null keys are one key.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        row = F.struct(key, *[c for c in batch.columns if c != key])
        new = batch.groupBy(F.col(key).alias("_key")).agg(F.min(row).alias("_row")).select("_row.*").select(*batch.columns)
        if path_exists(spark, root):
            new = new.persist()
            try:
                known = spark.read.schema(new.schema.add("batch", "long")).parquet(root).filter(F.col("batch") < batch_id)
                met = known.select(F.col(key).alias("_known")).join(new.select(F.col(key).alias("_asked")), F.col("_known").eqNullSafe(F.col("_asked")), "left_semi")
                new.join(met, F.col(key).eqNullSafe(F.col("_known")), "left_anti").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
            finally:
                new.unpersist()
        else:
            new.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return append


def leak_rate(hits: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Findings per severity and tumbling or sliding window."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return hits.withWatermark("ts", delay).groupBy(window.alias("w"), "severity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "severity", "n")


def leak_sessions(hits: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Bursts of findings per path."""
    return hits.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
