"""Incremental ingest: what to do, doing it, and its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Opening of the title that converters give to placeholder documents, and
#: the fewest characters of a body.
PLACEHOLDER = "Fake conversion of"
LEAST_CHARACTERS = 40


def latest_entries(catalog: DataFrame) -> DataFrame:
    """One entry per id: the last delivered, ties to the largest sha."""
    order = W.partitionBy("id").orderBy(
        F.col("generated_at").desc_nulls_last(), F.col("pdf_sha256").desc_nulls_last()
    )
    return (
        catalog.where("id is not null")
        .withColumn("_n", F.row_number().over(order))
        .where("_n = 1")
        .drop("_n")
    )


def in_category(entries: DataFrame, category: str | None) -> DataFrame:
    """Entries of a category, without case; all of them for None."""
    if category is None:
        return entries
    return entries.where(F.lower("category") == category.lower())


def plan(entries: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """``(id, action)``: skip what is stored with the same sha, else upsert.

    A null sha on either side is never the same. One join for all entries.
    """
    stored = documents.select("id", F.col("pdf_sha256").alias("stored")).dropDuplicates(["id"])
    same = F.coalesce(F.col("pdf_sha256") == F.col("stored"), F.lit(False))
    return entries.join(stored, "id", "left").select(
        "id", F.when(same & F.lit(not force), "skip").otherwise("upsert").alias("action")
    )


def missing_documents(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored documents that the catalog no longer names."""
    return documents.join(entries.select("id").distinct(), "id", "left_anti")


def upserted(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """``target`` with the rows of ``source`` in place of those of equal key."""
    return target.join(source.select(key), key, "left_anti").unionByName(
        source, allowMissingColumns=True
    )


def without_documents(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Delete by key; apply to documents and chunks alike for the cascade."""
    return table.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def is_placeholder(sections: Column) -> Column:
    """Nothing was converted: the first title says so, or hardly any text."""
    title = F.try_element_at(sections, F.lit(1)).getField("title")
    size = F.aggregate(
        sections, F.lit(0), lambda n, s: n + F.coalesce(F.length(s.content), F.lit(0))
    )
    return F.coalesce(F.startswith(title, F.lit(PLACEHOLDER)), F.lit(False)) | (
        size < LEAST_CHARACTERS
    )


def gate(documents: DataFrame, sections: str = "sections") -> DataFrame:
    """Adds ``state``: error (null text), empty (no sections), placeholder or ok.

    Kinds are values of a column, never the text of a message, and a bad
    document never stops a task.
    """
    s = F.col(sections)
    return documents.withColumn(
        "state",
        F.when(s.isNull(), "error")
        .when(F.size(s) == 0, "empty")
        .when(is_placeholder(s), "placeholder")
        .otherwise("ok"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row per run: the finished one where there are both."""
    order = W.partitionBy("id").orderBy(
        F.col("finished_at").desc_nulls_last(), F.col("status"), F.col("started_at").desc_nulls_last()
    )
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def last_successful(runs: DataFrame, success: str = "success") -> DataFrame:
    """The latest successful run that has a catalog digest, or no row."""
    return (
        latest_runs(runs)
        .where((F.col("status") == success) & F.col("catalog_sha256").isNotNull())
        .orderBy(F.desc("started_at"), F.desc("id"))
        .limit(1)
    )


def run_status(outcomes: DataFrame) -> DataFrame:
    """One row per run of ``outcomes`` (run_id, state): counts and status.

    success without errors; else partial with any upsert, error without.
    """
    n = lambda *names: F.count_if(F.col("state").isin(*names))
    bad = n("error", "empty")
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("docs_total"),
        n("skip", "placeholder").alias("docs_skipped"),
        n("ok").alias("docs_upserted"),
        bad.alias("docs_failed"),
        F.when(bad == 0, "success").when(n("ok") > 0, "partial").otherwise("error").alias("status"),
    )
