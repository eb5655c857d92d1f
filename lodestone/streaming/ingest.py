"""Structured Streaming: ingestion, quotas, breakers, latest values.

Every sink is idempotent (keep-latest merges keyed by id), so replays after a
failure change nothing. Checkpoint folders come from the caller and are shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.chunking import fixed_chunks
from lodestone.operators.store import CorpusStore

# How far each stage of an ingestion has come when it begins and ends.
PROGRESS = (("QUEUED", 0.0, 0.05), ("PARSING", 0.05, 0.15), ("CHUNKING", 0.15, 0.30), ("EMBEDDING", 0.30, 0.70), ("INDEXING", 0.70, 1.0), ("DONE", 1.0, 1.0))


def progress(stage: Column, done: Column, total: Column) -> Column:
    """Overall progress of a stage that has done some of its units."""
    share = F.when(total > 0, done / total).otherwise(0.0)
    out = F.lit(0.0)
    for name, a, b in PROGRESS:
        out = F.when(stage == name, F.lit(a) + (b - a) * share).otherwise(out)
    return out


def start_ingestion(spark: SparkSession, source: str, schema: str, store: CorpusStore, scope: str, collection: str, embed: Callable[[Column], Column], checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Parquet files of (doc_id, text) to chunks and vectors of a collection. New contents only; stopping the query pauses,
    starting it again with the same checkpoint resumes after the last finished batch."""

    def batch(df: DataFrame, _: int) -> None:
        docs = df.select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))
        fresh = store.new_documents(scope, collection, docs)
        chunks = fixed_chunks(fresh.select(F.col("document_id").cast("long").alias("doc_id"), F.col("content").alias("text")))
        rows = chunks.select("chunk_id", F.col("doc_id").cast("string").alias("document_id"), "seq", "content", "token_count", F.create_map(F.lit("content_hash"), F.col("content_hash")).alias("metadata"), embed(F.col("content")).alias("vector"))
        documents = fresh.select("document_id", F.col("document_id").alias("name"), F.lit("text/plain").alias("mime_type"), F.length("content").cast("long").alias("size_bytes"), "checksum", F.lit(0).cast("long").alias("created_at"))
        store.upsert(scope, collection, rows, documents)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_quota(stream: DataFrame, limit: int, ts: str = "ts", tokens: str = "tokens", late: str = "1 day") -> DataFrame:
    """Tumbling UTC days of token sums with an over-limit flag."""
    days = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.sum(F.greatest(F.col(tokens), F.lit(0))).alias("tokens"))
    return days.select(F.col("window.start").alias("day"), "tokens", (F.col("tokens") > limit).alias("over_limit"))


def latest_value(stream: DataFrame, key: list[str], value: str, ts: str = "ts", forget: str | None = None) -> DataFrame:
    """The last value of each key (update mode). State is a row for each key seen; with `forget`, a delay such as
    "7 days", a key without events for so long behind the watermark is forgotten and its state freed."""
    if forget is None:
        return stream.groupBy(*key).agg(F.max(F.struct(ts, value)).alias("l")).select(*key, F.col(f"l.{value}").alias(value), F.col(f"l.{ts}").alias(ts))
    gap = F.window(ts, forget).alias("__w")
    # One row of state for a key and stretch of time; the watermark frees stretches that lie behind it.
    last = stream.withWatermark(ts, forget).groupBy(*key, gap).agg(F.max(F.struct(ts, value)).alias("l"))
    return last.select(*key, F.col(f"l.{value}").alias(value), F.col(f"l.{ts}").alias(ts))


def distinct_contents(stream: DataFrame, content: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """An extension: contents seen within the watermark pass once."""
    return stream.withWatermark(ts, late).withColumn("checksum", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicatesWithinWatermark(["checksum"])
