"""Structured Streaming ingest: files of documents into the store.

An extension of batch ingest. Each micro-batch is upserted as one version of
the store, which rewrites only the buckets it touches; a replayed batch is recognised by its number, so every file counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.analyze import stemmed_tokens
from corpusmill.operators import ingest as steps, sparse_index
from corpusmill.operators.chunking import ChunkOptions, chunk_documents
from corpusmill.operators.sections import split_sections
from corpusmill.session import materialise, release
from corpusmill.sources.store import Store

ARRIVAL = "id STRING, title STRING, text STRING, category STRING, product STRING, pdf_sha256 STRING, arrived_at TIMESTAMP"


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of documents from files of JSON lines."""
    return (
        spark.readStream.schema(ARRIVAL)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def apply_batch(store: Store, batch: DataFrame, number: int, opt: ChunkOptions = ChunkOptions()) -> None:
    """Upsert the latest row per document; replays of a batch change nothing."""
    done = store.read("batches")
    if done is not None and not done.where(F.col("batch") == number).isEmpty():
        return
    latest = steps.latest_entries(batch.withColumn("generated_at", F.col("arrived_at"))).drop("generated_at")
    stored = store.read("documents")
    if stored is not None:
        todo = steps.plan(latest, stored).where("action = 'upsert'")
        latest = latest.join(todo, "id", "left_semi")
    judged = steps.gate(
        latest.withColumn("sections", split_sections(F.col("text"), F.col("title")))
    ).where("state = 'ok'")
    fresh = chunk_documents(judged.withColumnRenamed("id", "document_id"), opt=opt)
    rows = judged.drop("sections", "state")
    mark = batch.sparkSession.range(1).select(F.lit(number).cast("bigint").alias("batch"))
    replaced = materialise(rows.select(F.col("id").alias("document_id")), "stream-documents")
    facts = rows.select(F.col("id").alias("document_id"), "category", "product")
    none = F.lit(None).cast("string")
    removed = None
    if stored is not None:
        removed = store.read("chunks", replaced).join(replaced, "document_id", "left_semi")
        removed = removed.withColumns({"category": none, "product": none})
    index = sparse_index.changes(
        fresh.join(facts, "document_id"), removed, stemmed_tokens, (store.current() or 0) + 1
    )
    store.commit(
        append={"batches": mark, **index},
        upsert={"documents": (rows, rows.select("id").where("false")), "chunks": (fresh, replaced)},
    )
    release(replaced)


def run_stream(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: apply_batch(store, batch, number)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arrival_counts(stream: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Documents per category and window; rows later than ``late`` are left out."""
    return (
        stream.withWatermark("arrived_at", late)
        .groupBy(F.window("arrived_at", width), "category")
        .agg(F.count("*").alias("documents"))
        .select(F.col("window.start").alias("start"), "category", "documents")
    )
