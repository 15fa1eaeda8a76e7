"""File streams: new documents are scanned as they arrive, and reviews are merged into their clients' literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.patterns import ALL, Recognizer
from veilspark.operators import crm, detect


def stream_documents(spark: SparkSession, folder: str, schema: str, *, files_a_batch: int = 100) -> DataFrame:
    """Documents of Parquet files that appear in a folder; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def stream_files(spark: SparkSession, folder: str, *, suffix: str = ".pdf") -> DataFrame:
    """client_id (the folder above the file), stem, path, length and bytes of files that appear below a folder's clients; each is read once."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -2).alias("client_id"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("stem"), "path", "length", "content")


def register_files(files: DataFrame, reviews: str, out: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Appends the files that have no review yet (a Parquet table of client_id, stem at `reviews`) to the table at `out`: all that
    has arrived, or again and again `every` so often ("15 seconds")."""

    def write(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.parquet(reviews).select("client_id", "stem").distinct()
        batch.drop("content").join(known, ["client_id", "stem"], "left_anti").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def detect_stream(docs: DataFrame, out: str, checkpoint: str, recognizers: list[Recognizer] | None = None) -> StreamingQuery:
    """Writes the detected spans of all that has arrived, then ends. The scan has no state, so a batch is one pass without a shuffle."""
    found = detect.detect(docs, ALL if recognizers is None else recognizers)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_documents(landed: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents that landed and have no review yet."""
    return landed.join(reviews.select("client_id", "doc_id").distinct(), ["client_id", "doc_id"], "left_anti")


def merge_reviews_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Folds review events (client_id, stem, phase, entity, category, tokenize, token, rejected) into the table at path.

    The table keeps all events, written once for each batch, so that a batch that is run again replaces its own rows;
    literals() folds them. Nothing is kept in memory between batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def literals(spark: SparkSession, path: str) -> DataFrame:
    return crm.union_literals(spark.read.parquet(path).drop("batch"))


def status_changes(history: DataFrame) -> DataFrame:
    """client_id, doc_id, at, status, message where they differ from the row before; a first sighting is no change."""
    from pyspark.sql import Window

    order = Window.partitionBy("client_id", "doc_id").orderBy("at")
    now = F.struct("status", "message")
    rows = history.withColumn("_before", F.lag(now).over(order))
    return rows.where(F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(now)).drop("_before")
