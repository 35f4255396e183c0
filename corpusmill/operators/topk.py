"""Top-k search of a stated query set over all rows, in blocks of queries.

Queries go to the workers in blocks of a fixed size; each task keeps the best
k per query of its own rows, and only these are shuffled. A pass over the rows
serves one block, so what is broadcast is bounded whatever the number of
queries, and the rows themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusmill.session import materialise

QUERY_BLOCK = 4096
_ROWS = 1024  # rows scored at once
HITS = "query_id bigint, chunk_id bigint, score double"


class Best:
    """The k best rows per query, ties to the smaller id.

    Rows below a query's k-th best are passed over at once; the others wait
    until they are worth sorting.
    """

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.least = np.full(queries, -np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: queries x rows, -inf where a row is no answer."""
        wanted = (scores > -np.inf) & (scores >= self.least[:, None])
        if scores.shape[1] > self.k and np.count_nonzero(wanted) > 4 * self.k * self.queries:
            cut = np.partition(scores, -self.k, axis=1)[:, -self.k]
            wanted &= scores >= cut[:, None]
        q, at = np.nonzero(wanted)
        self.held.append((q, scores[q, at], ids[at]))
        self.waiting += len(q)
        if self.waiting > 4 * self.k * self.queries:
            self._sort()

    def _sort(self) -> None:
        q, s, i = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = s[last]
        keep = place < self.k
        self.held, self.waiting = [(q[keep], s[keep], i[keep])], 0

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        self._sort()
        q, s, i = self.held[0]
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[q]), pa.array(i), pa.array(s)], ["query_id", "chunk_id", "score"]
        )


def in_blocks(queries: DataFrame, columns: list[str], size: int = QUERY_BLOCK) -> Iterator[list]:
    """The queries in blocks; the driver holds one block at a time."""
    rows = queries.select(*columns).where(f"{columns[0]} is not null").toLocalIterator()
    while block := list(islice(rows, size)):
        yield block


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, rank, score)``, rank from 1, ties to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "chunk_id", "rank", "score")
    )


def search(
    rows: DataFrame,
    queries: DataFrame,
    query_columns: list[str],
    scorer: Callable[[list], Callable[[pa.RecordBatch], np.ndarray]],
    k: int,
    block: int = QUERY_BLOCK,
    blocks: Iterable[list] | None = None,
) -> DataFrame:
    """Best ``k`` of ``rows`` (first column: the id) for every query.

    ``blocks``: the queries' rows, where the caller has read them already.

    ``scorer(block of queries)`` runs once per task and gives a function from
    a batch of rows to the scores, queries x rows. No queries, no rows.
    """
    spark = rows.sparkSession
    out: DataFrame | None = None
    if blocks is None:
        blocks = in_blocks(queries, query_columns, block)
    for number, part in enumerate(blocks):
        if number and number % 16 == 0:  # many blocks: keep the plan short
            out = materialise(out, "hits")
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            score = scorer(sent.value)
            ids = np.array([r[0] for r in sent.value], np.int64)
            best = Best(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    piece = batch.slice(at, _ROWS)
                    best.add(score(piece), piece.column(0).to_numpy())
            yield best.rows(ids)

        hits = rows.mapInArrow(run, HITS)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], HITS)
    return ranked(out, k)
