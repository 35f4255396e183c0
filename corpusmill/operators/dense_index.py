"""A stored index for approximate nearest vectors: cells around centroids.

Centroids are learned from a bounded sample by spherical k-means; every vector
belongs to the cell of its nearest one. A query looks into the cells nearest to
it only, so a search reads those cells and not the corpus. Each change to the
corpus appends a segment; superseded documents are left out by the table
``gone`` of the inverted index, which both share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.operators.retrieval import DIGITS, Filters, usable_vector
from corpusmill.operators.topk import QUERY_BLOCK, in_blocks, search

#: Vectors that the centroids are learned from at most; the index has all.
SAMPLE = 65_536
#: Most cells; below, there are about as many as the root of the vectors.
MOST_CELLS = 4096
#: Share of the cells that a query looks into, and the least number of them.
PROBED, LEAST_PROBES = 0.125, 8


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    norm = np.sqrt((m * m).sum(-1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def learn(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centroids, cells x dimension; fewer if there are fewer vectors."""
    m = _unit(sample)
    rng = np.random.default_rng(7)
    centres = m[rng.permutation(len(m))[: max(1, min(cells, len(m)))]].copy()
    for _ in range(rounds if len(m) > len(centres) else 0):
        own = np.concatenate([(m[k : k + 8192] @ centres.T).argmax(1) for k in range(0, len(m), 8192)])
        total = np.zeros_like(centres)
        np.add.at(total, own, m)
        held = np.bincount(own, minlength=len(centres)) > 0
        centres[held] = _unit(total[held])
    return centres


def train(chunks: DataFrame, dimension: int) -> np.ndarray:
    """Centroids for the leaf chunks; the sample is chosen by a hash of the id."""
    rows = chunks.where((F.col("chunk_kind") == "leaf") & usable_vector(F.col("embedding"), dimension))
    n = rows.count()
    wanted = F.pmod(F.xxhash64("id"), F.lit(2**30)).cast("double") * n < 1.5 * SAMPLE * 2**30
    sample = [r[0] for r in rows.where(wanted).select("embedding").limit(SAMPLE).collect()]
    if not sample:
        return np.eye(1, dimension)
    return learn(np.array(sample), min(MOST_CELLS, int(np.ceil(np.sqrt(n)))))


def assigned(chunks: DataFrame, centres: np.ndarray, dimension: int, segment: int = 1) -> DataFrame:
    """``(id, v, category, product, document_id, segment, cell)`` of the leaf
    chunks with a usable vector. ``chunks`` has category and product."""
    sent = chunks.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows
    names = ["id", "v", "category", "product", "document_id", "segment", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            cell = (_unit(m) @ sent.value.T).argmax(1) if len(m) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names)

    return (
        chunks.where((F.col("chunk_kind") == "leaf") & usable_vector(F.col("embedding"), dimension))
        .select(
            "id", F.col("embedding").cast("array<float>").alias("v"), "category", "product", "document_id",
            F.lit(segment).cast("bigint").alias("segment"),
        )
        .mapInArrow(
            run, "id bigint, v array<float>, category string, product string, document_id string, "
            "segment bigint, cell int",
        )
    )


@dataclass
class DenseIndex:
    """``read(cells)`` gives at least the vectors of ``cells`` (None: all);
    ``gone`` has document_id and segment of superseded documents."""

    centres: np.ndarray
    read: Callable[[DataFrame | None], DataFrame]
    gone: DataFrame | None = None

    def topk(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """As :func:`corpusmill.operators.retrieval.dense_topk`, approximately:
        ``queries`` has query_id, embedding, category and product."""
        centres, dimension = self.centres, self.centres.shape[1]
        probes = probes or max(LEAST_PROBES, int(np.ceil(PROBED * len(centres))))
        asked = queries.where(usable_vector(F.col("embedding"), dimension))
        columns = ["query_id", "embedding", "category", "product"]
        near = lambda q: np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        cells: set[int] = set()
        read = in_blocks(asked, columns)
        first = next(read, [])
        blocks = [first] if len(first) < QUERY_BLOCK else None  # few queries are read once
        for block in (first, *(read if blocks is None else ())):
            if block:
                cells |= set(near(_unit(np.array([r[1] for r in block]))).ravel().tolist())
            if len(cells) > len(centres) // 2:
                break
        if blocks == [[]]:
            blocks = []
        spark = queries.sparkSession
        rows = self.read(None)
        if len(cells) <= len(centres) // 2:
            rows = self.read(spark.createDataFrame([(c,) for c in sorted(cells)], "cell int"))
            rows = rows.where(F.col("cell").isin(sorted(cells)))
        if self.gone is not None:
            last = self.gone.groupBy("document_id").agg(F.max("segment").alias("gone"))
            rows = rows.join(last, "document_id", "left").where("gone is null or segment >= gone")
        sent = spark.sparkContext.broadcast(centres)

        def scorer(block: list) -> Callable[[pa.RecordBatch], np.ndarray]:
            q, filters = _unit(np.array([r[1] for r in block])), Filters(block)
            order = np.argsort(-(q @ sent.value.T), axis=1, kind="stable")[:, :probes]
            looks = np.zeros((len(q), len(sent.value)), bool)
            np.put_along_axis(looks, order, True, axis=1)

            def score(batch: pa.RecordBatch) -> np.ndarray:
                m = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
                cell = batch.column(4).to_numpy()
                out = np.full((len(q), len(m)), -np.inf)
                for c in np.unique(cell):
                    own, who = np.flatnonzero(cell == c), np.flatnonzero(looks[:, c])
                    out[np.ix_(who, own)] = np.round(q[who] @ m[own].T, DIGITS)
                return filters.masked(out, batch, 2)

            return score

        held = rows.select("id", "v", "category", "product", "cell")
        return search(held, asked, columns, scorer, k, blocks=blocks)
