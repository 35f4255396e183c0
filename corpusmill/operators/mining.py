"""Training triples and the reachability filter, from ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def is_hard_negative(row: dict[str, Column], positive: dict[str, Column]) -> Column:
    """Another chunk of another document, and not of the same product; a null
    or empty product is never the same."""
    same = F.coalesce(
        (F.lower(row["product"]) == F.lower(positive["product"])) & (row["product"] != ""),
        F.lit(False),
    )
    return (
        (row["chunk_id"] != positive["chunk_id"])
        & (row["document_id"] != positive["document_id"])
        & ~same
    )


def triples(results: DataFrame, negatives: int = 4) -> DataFrame:
    """``(query_id, positive, negatives)`` of queries that give a whole triple.

    ``results``: query_id, position, relevant, chunk_id, document_id, product.
    The positive is the first relevant row, negatives the first ones that
    qualify, wherever they stand; a query with fewer is dropped. One window
    per query over its own results.
    """
    entry = F.struct("chunk_id", "document_id", "product")
    own = W.partitionBy("query_id")
    with_positive = results.withColumn(
        "positive",
        F.min_by(F.when(F.col("relevant"), entry), F.when(F.col("relevant"), F.col("position"))).over(own),
    ).where("positive is not null")
    here = {c: F.col(c) for c in ("chunk_id", "document_id", "product")}
    there = {c: F.col(f"positive.{c}") for c in here}
    qualified = with_positive.where(is_hard_negative(here, there))
    order = W.partitionBy("query_id").orderBy("position")
    first = qualified.withColumn("n", F.row_number().over(order)).where(F.col("n") <= negatives)
    return (
        first.groupBy("query_id")
        .agg(
            F.first("positive").alias("positive"),
            F.array_sort(F.collect_list(F.struct("n", "chunk_id", "document_id", "product"))).alias("held"),
        )
        .where(F.size("held") == negatives)
        .select("query_id", "positive", F.col("held.chunk_id").alias("negatives"))
    )


def triple_rows(results: DataFrame, queries: DataFrame, negatives: int = 4) -> DataFrame:
    """``(query, positive, negatives)``: :func:`triples` as training rows.

    ``results`` also has document_slug, document_title, page_start, page_end
    and content, ``queries`` query_id and text. The texts are joined to the
    few chunks of the triples.
    """
    entry = F.struct(
        "document_id", "document_slug", "document_title", "product", "chunk_id", "page_start",
        "page_end", F.col("content").alias("text"),
    )
    held = results.select("query_id", "chunk_id", entry.alias("entry"))
    named = triples(results, negatives).select(
        "query_id",
        F.posexplode(F.concat(F.array("positive.chunk_id"), "negatives")).alias("place", "chunk_id"),
    )
    rows = named.join(held, ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "entry"))).alias("e")
    )
    return rows.join(queries.select("query_id", F.col("text").alias("query")), "query_id").select(
        "query", F.col("e")[0]["entry"].alias("positive"), F.slice(F.col("e.entry"), 2, negatives).alias("negatives")
    )


def survival(kept: int, total: int) -> dict[str, object]:
    """Counts of the reachability filter, with the share that is left in percent."""
    share = round(100 * kept / total, 2) if total else 0.0
    return {"kept": kept, "dropped": total - kept, "survival_percent": share}


def curation_statistics(results: DataFrame, queries: DataFrame, negatives: int = 4) -> DataFrame:
    """One row: queries, without results, without positive, without enough
    negatives, kept."""
    per_query = results.groupBy("query_id").agg(F.max(F.col("relevant").cast("int")).alias("hit"))
    kept = triples(results, negatives).select("query_id", F.lit(1).alias("kept"))
    return (
        queries.select("query_id")
        .distinct()
        .join(per_query, "query_id", "left")
        .join(kept, "query_id", "left")
        .agg(
            F.count("*").alias("queries"),
            F.count_if(F.col("hit").isNull()).alias("no_results"),
            F.count_if(F.col("hit") == 0).alias("no_positive"),
            F.count_if((F.col("hit") == 1) & F.col("kept").isNull()).alias("few_negatives"),
            F.count_if(F.col("kept") == 1).alias("kept"),
        )
    )


def reachability(results: DataFrame, sources: DataFrame, first: int = 10) -> DataFrame:
    """Queries whose source chunk is among their results.

    ``sources``: query_id, source_chunk_id. Adds ``retriever_rank`` (from 0)
    and ``top_ids``, the first ``first`` results in order.
    """
    listed = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "chunk_id"))).alias("held")
    )
    ids = F.col("held.chunk_id")
    return (
        sources.join(listed, "query_id")
        .withColumn("retriever_rank", (F.array_position(ids, F.col("source_chunk_id")) - 1).cast("int"))
        .where("retriever_rank >= 0")
        .select("query_id", "source_chunk_id", "retriever_rank", F.slice(ids, 1, first).alias("top_ids"))
    )
