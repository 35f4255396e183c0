"""What several of the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def leaf_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """Leaf chunks, re-delivered rows counted once by ``id``, with ``columns``.

    Of several rows of one id the latest ``created_at`` stands, then the
    smallest values of ``columns``. Rows with a null id are dropped, for no
    result could name them. Only the named columns are shuffled.
    """
    wanted = list(dict.fromkeys(["id", *columns]))
    has_time = "created_at" in chunks.columns
    order = [F.col("created_at").desc_nulls_last()] if has_time else []
    scalar = [c for c in wanted if c != "id" and c != "created_at"]
    one = W.partitionBy("id").orderBy(*order, *scalar)
    return (
        chunks.where("chunk_kind = 'leaf' and id is not null")
        .select(*wanted, *(["created_at"] if has_time and "created_at" not in wanted else []))
        .withColumn("_n", F.row_number().over(one))
        .where("_n = 1")
        .select(*wanted)
    )
