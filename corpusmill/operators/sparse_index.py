"""A stored inverted index for BM25: written at ingest, read by searches.

The index is four tables. ``postings`` has a row per term and chunk, kept in
buckets of the term's hash, so a search reads the buckets of its terms only.
``freq`` and ``stats`` hold signed changes of the document frequencies and of
the corpus size; a search adds them up, for its terms only. ``gone`` names the
documents whose earlier postings no longer count. Each change to the corpus
appends one segment to each and rewrites nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.operators.retrieval import DIGITS, Filters, Weights
from corpusmill.operators.topk import ranked, search
from corpusmill.session import materialise

TABLES = ("postings", "freq", "stats", "gone")
POSTINGS = (
    "id bigint, document_id string, chunk_kind string, category string, product string, "
    "segment bigint, dl int, term string, tf int"
)
#: Most queries whose terms are joined with the postings; in a larger set the
#: frequent terms would multiply with the queries that ask for them.
MOST_JOINED = 32
#: Most terms that are named to the scan, which then skips pages without them.
MOST_NAMED = 256


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in POSTINGS.split(", ")]
    for batch in batches:
        held = batch.column(6)
        size = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = held.flatten().dictionary_encode()
        terms = max(1, len(coded.dictionary))
        row = np.repeat(np.arange(batch.num_rows), size)
        key, tf = np.unique(row * terms + coded.indices.to_numpy(), return_counts=True)
        row, term = pa.array(key // terms), pa.array(key % terms)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k).take(row) for k in range(6)),
                pa.array(size[key // terms], pa.int32()),
                coded.dictionary.cast(pa.string()).take(term),
                pa.array(tf, pa.int32()),
            ],
            names,
        )


def postings(chunks: DataFrame, tokens: Callable[[Column], Column], segment: int) -> DataFrame:
    """Rows of POSTINGS for ``chunks`` (id, document_id, chunk_kind, category,
    product, content). Terms are counted within a row, nothing is shuffled."""
    return chunks.select(
        "id", "document_id", "chunk_kind", "category", "product",
        F.lit(segment).cast("bigint").alias("segment"), tokens(F.col("content")).alias("tokens"),
    ).mapInArrow(_postings, POSTINGS)


def changes(
    added: DataFrame, removed: DataFrame | None, tokens: Callable[[Column], Column], segment: int
) -> dict[str, DataFrame]:
    """One segment: the rows to append to each of TABLES.

    ``added`` and ``removed``: chunks as in :func:`postings`; the removed ones
    are all stored chunks of the documents that are replaced or dropped.
    """
    side = lambda df, sign: df.select(
        F.lit(sign).alias("sign"), F.array_distinct(tokens(F.col("content"))).alias("terms"),
        F.size(tokens(F.col("content"))).cast("bigint").alias("dl"),
    )
    both = side(added, 1)
    gone = added.select("document_id").where("false")
    if removed is not None:
        both = both.unionByName(side(removed, -1))
        gone = removed.select("document_id").distinct()
    return {
        "postings": postings(added, tokens, segment),
        "freq": both.select("sign", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("sign").alias("df"))
        .where("df <> 0"),
        "stats": both.agg(
            F.coalesce(F.sum("sign"), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("total"),
        ),
        "gone": gone.withColumn("segment", F.lit(segment).cast("bigint")),
    }


@dataclass
class SparseIndex:
    """An index to search. ``read(table, terms)`` gives the rows of a table, of
    tables with terms at least those that hold one of ``terms`` (a column)."""

    read: Callable[[str, DataFrame | None], DataFrame]

    @staticmethod
    def of(tables: dict[str, DataFrame]) -> "SparseIndex":
        return SparseIndex(lambda table, terms: tables[table])

    def topk(
        self, queries: DataFrame, k: int, tokens: Callable[[Column], Column], k1: float = 1.2, b: float = 0.75
    ) -> DataFrame:
        """As :func:`corpusmill.operators.retrieval.bm25_topk`, from the index.

        Only the buckets of the queries' terms are read. The postings of a few
        queries are joined with their weighted terms, and partial scores
        combine before the shuffle. For more queries the postings of all their
        terms are put together by chunk once per block of queries, and scored
        for the whole block.
        """
        asked = queries.select(
            "query_id", "category", "product", F.array_distinct(tokens(F.col("text"))).alias("terms")
        )
        split = asked.select("query_id", "category", "product", F.explode("terms").alias("term"))
        terms = split.select("term").distinct()
        named = [r[0] for r in terms.limit(MOST_NAMED + 1).collect()]
        if len(named) <= MOST_NAMED:
            terms = queries.sparkSession.createDataFrame([(t,) for t in named], "term string")
        else:
            terms = materialise(terms, "terms")
        stats = self.read("stats", None).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        n, avgdl = stats["n"] or 0, (stats["total"] or 0) / max(stats["n"] or 0, 1) or 1.0

        def of_terms(table: str) -> DataFrame:
            rows = self.read(table, terms)
            return rows.where(F.col("term").isin(named)) if len(named) <= MOST_NAMED else rows.join(
                terms, "term", "left_semi"
            )

        df = of_terms("freq").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        weighted = split.join(df, "term").select("query_id", "category", "product", "term", idf)
        held = of_terms("postings").where("chunk_kind = 'leaf'")
        gone = self.read("gone", None)
        if not gone.isEmpty():
            last = gone.groupBy("document_id").agg(F.max("segment").alias("gone"))
            held = held.join(last, "document_id", "left").where("gone is null or segment >= gone")
        if queries.limit(MOST_JOINED + 1).count() > MOST_JOINED:
            return self._in_blocks(held, weighted, k, avgdl, k1, b)
        wish = weighted.select("query_id", "term", "idf", F.col("category").alias("c"), F.col("product").alias("p"))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (
            F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl)))
        )
        hits = (
            held.join(wish, "term")
            .where("(c is null or c = category) and (p is null or p = product)")
            .groupBy("query_id", F.col("id").alias("chunk_id"))
            .agg(F.round(F.sum(part), DIGITS).alias("score"))
            .where("score > 0")
        )
        return ranked(hits, k)

    @staticmethod
    def _in_blocks(
        held: DataFrame, weighted: DataFrame, k: int, avgdl: float, k1: float, b: float
    ) -> DataFrame:
        rows = held.select("id", "term", "tf", "dl", "category", "product")
        asked = weighted.groupBy("query_id", "category", "product").agg(
            F.collect_list(F.struct("term", "idf")).alias("terms")
        )
        # put together again as one row per chunk, which the blocked search scores
        chunk = rows.groupBy("id").agg(
            F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tf"), F.first("dl").alias("dl"),
            F.first("category").alias("category"), F.first("product").alias("product"),
        )
        chunk = materialise(chunk, "chunk-terms")

        def scorer(block: list) -> Callable[[pa.RecordBatch], np.ndarray]:
            weights = Weights([(q[0], q[1]) for q in block])
            filters = Filters(block)

            def score(batch: pa.RecordBatch) -> np.ndarray:
                size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), size)
                tf = batch.column(2).flatten().to_numpy().astype(np.float64)
                dl = batch.column(3).to_numpy()[row]
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                out = weights.scores(batch.column(1).flatten(), row, part, batch.num_rows)
                return filters.masked(out, batch, 4)

            return score

        ordered = chunk.select("id", "terms", "tf", "dl", "category", "product")
        return search(ordered, asked, ["query_id", "terms", "category", "product"], scorer, k)
