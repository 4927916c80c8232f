"""Streams of arriving sources, progress events and token use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over a stored table, a file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def new_sources(stream: DataFrame, key: str = "content_hash", time: str | None = None, delay: str = "7 days") -> DataFrame:
    """The first arrival of each key. With a time column, keys older than the watermark are forgotten."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def token_ledger(events: DataFrame, time: str, amount: str) -> DataFrame:
    """(period, output_tokens): a running sum for each calendar month."""
    return events.groupBy(F.date_format(time, "yyyy-MM").alias("period")).agg(F.sum(F.floor(amount)).cast("bigint").alias("output_tokens"))


def with_advisory(ledger: DataFrame, limit: int = 1_000_000) -> DataFrame:
    return ledger.withColumn("warning", F.col("output_tokens") > limit)


def current_month(ledger: DataFrame) -> DataFrame:
    """The latest month alone, as a ledger that drops earlier months shows it."""
    return ledger.orderBy(F.desc("period")).limit(1)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and reads back its result from the shared checkpoint folder.

    append writes each batch's files; complete keeps the last batch's result, replaced as a whole.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(f"{base}/out")
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def event_message(name: Column, data: Column) -> Column:
    """A progress event as a server-sent message: its name and its data as JSON on one line."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def admission(active: set[str], waiting: list[str], identity: str, most: int = 4) -> str:
    """start, wait or refuse: one active run for all, at most `most` waiting, one for each identity."""
    if identity in active or identity in waiting:
        return "refuse"
    if not active:
        return "start"
    return "wait" if len(waiting) < most else "refuse"
