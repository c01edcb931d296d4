"""Incremental ingest: a stream of documents becomes chunks that the table does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.chunking import MAX_CHARS, chunk_articles
from loomgraph.operators.tables import pending

DOCUMENT = "doc_id string, text string"


def _append_new(df: DataFrame, path: str, key: str = "id") -> None:
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = spark.createDataFrame([], df.select(key).schema)
    # the table holds the ids, so the stream needs no state and no watermark; a repeated batch adds nothing
    pending(df, done, key).dropDuplicates([key]).write.mode("append").parquet(path)


def ingest_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, limit: int = MAX_CHARS):
    """Start a query that reads new JSON-lines files of ``source``, cuts their documents and appends chunks with new ids to ``target``.

    Chunk ids are prefixed with the document's id. The query takes what is there and ends.
    """
    docs = spark.readStream.schema(DOCUMENT).json(source)
    cut = chunk_articles(docs, limit=limit).select(F.concat("doc_id", F.lit("__"), "id").alias("id"), "text")
    return cut.writeStream.foreachBatch(lambda df, _: _append_new(df, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_stream(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Requests per minute of a stream of events; windows close ``late`` after their end."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("requests")).select(F.col("w.start").alias("minute"), "requests")
