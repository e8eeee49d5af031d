"""Streams of images and captures.  The library this one follows has none; these are extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.images import dataset
from ..operators.rules import with_status
from ..sources.images import listed, with_names


def arriving(spark: SparkSession, root: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of the image files that appear below ``root``, as bytes."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(root)
    return files.where(listed("path"))


def analyse_arrivals(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the wide row of every arriving image to the table at ``out``; a batch that runs again overwrites its own folder."""

    def batch(files: DataFrame, number: int) -> None:
        paths = [r.path for r in files.select("path").collect()]  # at most files_a_batch
        if paths:
            images = spark.read.format("image").option("dropInvalid", False).load(paths).select("image.*").withColumnRenamed("origin", "path")
            dataset(with_names(images, root)).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return arriving(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(captures: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Captures by status and window of event time; rows later than ``late`` are left out by the watermark."""
    return with_status(captures.withWatermark(time, late)).groupBy(F.window(time, width).alias("window"), "analysis_status").agg(F.count(F.lit(1)).alias("count"))


def with_rates(amounts: DataFrame, rates: DataFrame, hours: int = 6) -> DataFrame:
    """A stream of amounts (amount, currency, ts) joined with a static table of rates: of each target the latest that was live then.

    A rate holds from its fetching until the next one of its pair, ``hours`` at most, so an amount meets one rate a target;
    of rates fetched at the same time the greatest stands.
    """
    one = rates.groupBy(F.col("base").alias("currency"), "target", "fetched_at").agg(F.max("rate").alias("rate"))
    after = F.lead("fetched_at").over(Window.partitionBy("currency", "target").orderBy("fetched_at"))
    end = F.least(after, F.col("fetched_at") + F.expr(f"INTERVAL {int(hours)} HOURS"))
    live = (F.col("fetched_at") <= F.col("ts")) & (F.col("ts") < F.col("until"))
    return amounts.join(one.withColumn("until", end), "currency").where(live).withColumn("value", F.col("amount") * F.col("rate")).drop("fetched_at", "until")
