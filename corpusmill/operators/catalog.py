"""Catalog queries: list, fetch, look up, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

LISTED = (
    "id", "title", "category", "product", "version", "slug", "pages", "section_count", "ingested_at",
)


def list_documents(
    documents: DataFrame, category: str | None = None, product: str | None = None, limit: int = 100
) -> DataFrame:
    """The first ``limit`` (1 to 500) documents by category, title and id."""
    out = documents
    if category is not None:
        out = out.where(F.col("category") == category)
    if product is not None:
        out = out.where(F.col("product") == product)
    limit = min(max(limit, 1), 500)
    return out.select(*LISTED).orderBy("category", "title", "id").limit(limit)


def get_documents(documents: DataFrame, chunks: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Documents with ``chunk_count``, parents and leaves; all of them, or ``ids``.

    Re-delivered chunks count once. A document without chunks has 0.
    """
    if ids is not None:
        documents = documents.where(F.col("id").isin(ids))
        chunks = chunks.where(F.col("document_id").isin(ids))
    counted = (
        chunks.groupBy(F.col("document_id").alias("id"))
        .agg(F.countDistinct(chunks["id"]).alias("chunk_count"))
    )
    return documents.join(counted, "id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint"))
    )


def lookup_sections(chunks: DataFrame, kind: str | None = None) -> DataFrame:
    """Every section, put together from its chunks in their order.

    Columns: document_id, section_title, chunk_count, page_start (of the first
    chunk), page_end (of the last), body. Parents and leaves both count unless
    ``kind`` names one; re-delivered chunks count once. Filter the result by
    document and title for one section; the filter reaches the scan.
    """
    held = chunks if kind is None else chunks.where(F.col("chunk_kind") == kind)
    # newest delivery first among the rows of an id; one shuffle, by section
    age = -F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62)))
    piece = F.struct("chunk_index", "id", age.alias("age"), "raw_content", "page_start", "page_end")
    every = F.array_sort(F.collect_list(piece))
    at = lambda k: F.try_element_at("every", k)
    pieces = F.filter("every", lambda x, k: (k == 0) | (x["id"] != at(k)["id"]))
    return (
        held.where("section_title is not null")
        .groupBy("document_id", "section_title")
        .agg(every.alias("every"))
        .withColumn("pieces", pieces)
        .select(
            "document_id",
            "section_title",
            F.size("pieces").cast("bigint").alias("chunk_count"),
            F.element_at("pieces", 1)["page_start"].alias("page_start"),
            F.element_at("pieces", -1)["page_end"].alias("page_end"),
            F.array_join(F.col("pieces.raw_content"), "\n\n").alias("body"),
        )
    )


def lookup_section(chunks: DataFrame, document_id: str, title: str, kind: str | None = None) -> DataFrame:
    """One section by exact document and title; no row if it is not there."""
    own = chunks.where((F.col("document_id") == document_id) & (F.col("section_title") == title))
    return lookup_sections(own, kind)


def store_status(documents: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: healthy, documents, chunks and the last run."""
    last = runs.agg(
        F.max_by(
            F.struct("id", "status", "started_at"),
            F.struct("started_at", "id", F.col("finished_at").isNotNull()),
        ).alias("last")
    )
    d = documents.agg(F.count("*").alias("documents"))
    c = chunks.agg(F.count_distinct("id").alias("chunks"))
    return (
        d.crossJoin(F.broadcast(c))  # one row each
        .crossJoin(F.broadcast(last))
        .select(
            ((F.col("documents") > 0) & (F.col("chunks") > 0)).alias("healthy"),
            "documents",
            "chunks",
            F.col("last.id").alias("last_run_id"),
            F.col("last.status").alias("last_status"),
        )
    )
