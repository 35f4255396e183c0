"""Relevance, hit rates, latencies and the history of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def matches_expectation(any_tokens: Column, product: Column, slug: Column, title: Column, own_product: Column) -> Column:
    """Equal product without case, or a token inside slug or title without case."""
    tokens = F.exists(
        F.coalesce(any_tokens, F.array().cast("array<string>")),
        lambda t: F.coalesce(F.contains(F.lower(slug), F.lower(t)), F.lit(False))
        | F.coalesce(F.contains(F.lower(title), F.lower(t)), F.lit(False)),
    )
    same = F.coalesce(F.lower(product) == F.lower(own_product), F.lit(False))
    return same | F.coalesce(tokens, F.lit(False))


def is_relevant(
    chunk_id: Column, expected_ids: Column, any_tokens: Column, product: Column,
    slug: Column, title: Column, own_product: Column,
) -> Column:
    """Named chunk ids decide alone where there are any; else the expectation."""
    named = F.coalesce(F.size(expected_ids) > 0, F.lit(False))
    loose = matches_expectation(any_tokens, product, slug, title, own_product)
    return F.when(named, F.array_contains(expected_ids, chunk_id)).otherwise(loose)


def hit_rates(results: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """One row: queries, top1_hit_rate, topk_hit_rate in percent.

    ``results``: query_id, position, relevant. Queries without results count
    as misses. Rates are rounded half to even, as is usual for reports.
    """
    own = results.groupBy("query_id").agg(
        F.max(F.when((F.col("position") == 1) & F.col("relevant"), 1).otherwise(0)).alias("top1"),
        F.max(F.when((F.col("position") <= top_k) & F.col("relevant"), 1).otherwise(0)).alias("topk"),
    )
    rate = lambda c: F.bround(
        F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")) * 100, 2
    )
    return (
        queries.select("query_id")
        .distinct()
        .join(own, "query_id", "left")
        .agg(
            F.count("*").alias("queries"),
            rate("top1").alias("top1_hit_rate"),
            rate("topk").alias("topk_hit_rate"),
        )
    )


def latency_report(samples: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: n, p50 (upper median), p95 (nearest rank), average, maximum.

    Both percentiles are exact and come from one aggregation; null values do
    not count. Ranks are found over value counts, so repeated values are
    combined before the shuffle.
    """
    held = samples.where(F.col(value).isNotNull())
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    n = F.count(value)
    # the upper median is the lower one of the values read from the top
    upper = F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")
    return held.groupBy(by).agg(
        n.alias("n"),
        F.round(upper, 6).alias("p50"),
        F.round(p(0.95), 6).alias("p95"),
        F.round(F.avg(value), 6).alias("average"),
        F.round(F.max(value), 6).alias("maximum"),
    )
