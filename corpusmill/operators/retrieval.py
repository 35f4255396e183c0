"""Hybrid retrieval of whole query sets.

Every step takes and gives rows ``(query_id, chunk_id, rank, ...)``; ranks are
from 1 and windows are over a query's candidates, never over the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusmill.operators.topk import search as blocked_search
from corpusmill.session import materialise

DIGITS = 6
#: Rows that a listwise judge puts in order.
LISTWISE_HEAD = 5


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    pool: int = 50
    rrf_k: int = 60
    rerank_top: int = 30
    dedup_sections: bool = False
    adaptive: bool = True
    k1: float = 1.2
    b: float = 0.75

    @staticmethod
    def for_top_k(top_k: int, dedup_sections: bool = False) -> "SearchOptions":
        """Options of the search tool: sizes clamped and grown with ``top_k``."""
        k = min(max(top_k, 1), 50)
        return SearchOptions(k, max(50, 5 * k), 60, max(30, 3 * k), dedup_sections)


# ---------------------------------------------------------------- dense


def usable_vector(c: Column, dimension: int) -> Column:
    """Whether a vector can be compared: full length, finite, not all zero."""
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) == dimension) & ok & F.exists(c, lambda x: x != 0), F.lit(False))


class Filters:
    """Wishes of a block of queries for category and product, as numbers.

    ``block``: rows whose third and fourth fields are the wishes; a query
    without a wish takes any row.
    """

    def __init__(self, block: list):
        self.sides = []
        for place in (2, 3):
            wanted = [q[place] for q in block]
            number = {w: n for n, w in enumerate(dict.fromkeys(w for w in wanted if w is not None))}
            self.sides.append((number, np.array([-1 if w is None else number[w] for w in wanted])))

    def masked(self, scores: np.ndarray, batch: pa.RecordBatch, at: int) -> np.ndarray:
        """``scores``, queries x rows, without what the wishes exclude; the
        rows' values stand in columns ``at`` and ``at + 1``."""
        for column, (number, wanted) in enumerate(self.sides):
            if not number:
                continue
            coded = batch.column(at + column).dictionary_encode()
            known = np.array([number.get(v, -2) for v in coded.dictionary.to_pylist()] + [-2])
            held = known[coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]
            scores[(wanted[:, None] != held[None, :]) & (wanted[:, None] >= 0)] = -np.inf
        return scores


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int, dimension: int = 64) -> DataFrame:
    """Nearest leaf chunks by cosine: ``(query_id, chunk_id, rank, score)``.

    ``queries``: query_id, embedding, category, product; the last two filter
    by equality where not null. Exact: every usable vector is compared. The
    score is the similarity, rounded to DIGITS before ranking. Unusable
    vectors, on either side, have no neighbours.
    """
    rows = chunks.where(
        (F.col("chunk_kind") == "leaf") & usable_vector(F.col("embedding"), dimension)
    ).select("id", "embedding", "category", "product")
    asked = queries.where(usable_vector(F.col("embedding"), dimension))

    def unit(flat: np.ndarray) -> np.ndarray:
        m = flat.reshape(-1, dimension).astype(np.float64)
        return m / np.sqrt((m * m).sum(1, keepdims=True))

    def scorer(block: list) -> Callable[[pa.RecordBatch], np.ndarray]:
        q, filters = unit(np.array([r[1] for r in block], np.float64)), Filters(block)

        def score(batch: pa.RecordBatch) -> np.ndarray:
            m = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False))
            return filters.masked(np.round(q @ m.T, DIGITS), batch, 2)

        return score

    return blocked_search(rows, asked, ["query_id", "embedding", "category", "product"], scorer, k)


# ---------------------------------------------------------------- sparse


def corpus_statistics(tokens: DataFrame) -> DataFrame:
    """``(n, avgdl)`` over all rows of ``tokens`` (id, tokens), parents too."""
    return tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    """``(term, df)``: rows that hold a term, over all rows."""
    return (
        tokens.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def postings(tokens: DataFrame) -> DataFrame:
    """``(term, id, tf, dl)``, the inverted index as a table.

    The count of a term is taken within its row, so nothing is shuffled.
    """
    counted = F.transform(
        F.array_distinct("tokens"),
        lambda t: F.struct(
            t.alias("term"), F.size(F.filter("tokens", lambda x: x == t)).alias("tf")
        ),
    )
    return tokens.select("id", F.size("tokens").alias("dl"), F.explode(counted).alias("p")).select(
        "p.term", "id", "p.tf", "dl"
    )


class Weights:
    """The weighted terms of a block of queries: (query, [(term, idf)])."""

    def __init__(self, block: list):
        places: dict[str, tuple[list, list]] = {}
        for at, (_, terms) in enumerate(block):
            for t in terms:
                x = places.setdefault(t["term"], ([], []))
                x[0].append(at)
                x[1].append(t["idf"])
        self.queries = len(block)
        self.number = {t: k for k, t in enumerate(places)}
        self.asking = [np.array(x[0]) for x in places.values()]
        self.weight = [np.array(x[1]) for x in places.values()]

    def scores(self, terms: pa.Array, row: np.ndarray, part: np.ndarray, rows: int) -> np.ndarray:
        """Scores, queries x rows, -inf where no term is shared; ``part`` is
        what each (term, row) adds but for the term's weight."""
        out = np.zeros((rows, self.queries))
        coded = terms.dictionary_encode()
        known = np.array([self.number.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
        if len(known):
            term = known[coded.indices.to_numpy()]
            order = np.argsort(term, kind="stable")
            order = order[term[order] >= 0]
            term, row, part = term[order], row[order], part[order]
            cuts = np.flatnonzero(np.diff(term)) + 1
            # one update per term: its rows times the queries that ask for it
            for r, p, t in zip(np.split(row, cuts), np.split(part, cuts), term[np.r_[0, cuts]] if len(term) else ()):
                out[r[:, None], self.asking[t][None, :]] += p[:, None] * self.weight[t][None, :]
        out = np.round(out.T, DIGITS)
        out[out <= 0] = -np.inf
        return out


def bm25_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    tokens: Callable[[Column], Column],
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """Best leaf chunks by BM25: ``(query_id, chunk_id, rank, score)``.

    ``queries``: query_id, text, category, product. Statistics cover all
    chunks, parents included; only leaves that share a term with the query are
    answers. A query's repeated terms count once. Weights of the query terms
    are joined to the queries, which are scored block by block against the
    rows' own terms; there is no join of postings with queries, whose frequent
    terms would multiply both sides.
    """
    held = chunks.select(
        "id", "chunk_kind", "category", "product", tokens(F.col("content")).alias("tokens")
    )
    asked = queries.select(
        "query_id", "category", "product", F.array_distinct(tokens(F.col("text"))).alias("terms")
    )
    # read three times: tokenising once is worth a table, all the more with a stemmer
    held = materialise(held, "tokens")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    df = (
        held.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    stats = corpus_statistics(held).first()  # one row
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (
        asked.select("query_id", "category", "product", F.explode("terms").alias("term"))
        .join(df, "term")
        .groupBy("query_id", "category", "product")
        .agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("terms"))
    )

    def scorer(block: list) -> Callable[[pa.RecordBatch], np.ndarray]:
        weights, filters = Weights([(q[0], q[1]) for q in block]), Filters(block)

        def score(batch: pa.RecordBatch) -> np.ndarray:
            rows = batch.num_rows
            dl = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            coded = batch.column(1).flatten().dictionary_encode()
            terms = max(1, len(coded.dictionary))
            row = np.repeat(np.arange(rows), dl)
            key, tf = np.unique(row * terms + coded.indices.to_numpy(), return_counts=True)
            row = key // terms
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
            out = weights.scores(coded.dictionary.take(pa.array(key % terms)), row, part, rows)
            return filters.masked(out, batch, 2)

        return score

    leaves = held.where("chunk_kind = 'leaf'").select("id", "tokens", "category", "product")
    return blocked_search(leaves, weighted, ["query_id", "terms", "category", "product"], scorer, k)


# ---------------------------------------------------------------- fusion


def union_best_rank(hits: DataFrame, k: int | None = None) -> DataFrame:
    """One list per query from the lists of its variants.

    ``hits``: query_id, variant, chunk_id, rank, score. A chunk keeps its best
    rank, the earliest variant on ties; the list is ordered by that rank, then
    by first appearance, and renumbered.
    """
    best = W.partitionBy("query_id", "chunk_id").orderBy("rank", "variant")
    order = W.partitionBy("query_id").orderBy("rank", "first_variant", "first_rank", "chunk_id")
    seen = F.min(F.struct(F.col("variant").alias("v"), F.col("rank").alias("r")))
    first = seen.over(W.partitionBy("query_id", "chunk_id"))
    kept = (
        hits.withColumn("_first", first)
        .withColumn("_n", F.row_number().over(best))
        .where("_n = 1")
        .withColumns({"first_variant": F.col("_first.v"), "first_rank": F.col("_first.r")})
    )
    out = kept.withColumn("rank", F.row_number().over(order))
    if k is not None:
        out = out.where(F.col("rank") <= k)
    return out.select("query_id", "chunk_id", "rank", "score")


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: ``(query_id, chunk_id, fused_rank, rrf, ...)``.

    A full outer join of both lists, which their ranking has already put
    together by query. Sums are rounded before they are ordered, as equal sums
    of different ranks differ in their last bits; ties keep dense hits in their
    order, then sparse-only hits in theirs.
    """
    side = lambda df, name, score: df.select(
        "query_id", "chunk_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(score)
    )
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = (
        side(dense, "dense", "dense_score")
        .join(side(sparse, "sparse", "bm25_score"), ["query_id", "chunk_id"], "full_outer")
        .withColumn("rrf", F.round(part("dense_rank") + part("sparse_rank"), 12))
    )
    order = W.partitionBy("query_id").orderBy(
        F.desc("rrf"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last()
    )
    return both.withColumn("fused_rank", F.row_number().over(order))


def _depth(top: int, shallow: int, spread: float, probe: int, over: Callable[[Column], Column]) -> Column:
    at = lambda r: over(F.max(F.when(F.col("fused_rank") == r, F.col("rrf"))))
    deep = (over(F.count("*")) < probe) | F.lit(top <= shallow) | (at(1) - at(probe) > spread)
    return F.when(deep, top).otherwise(shallow).cast("int")


def adaptive_depth(
    fused: DataFrame, top: int = 30, shallow: int = 10, spread: float = 0.02, probe: int = 5
) -> DataFrame:
    """``(query_id, fused, depth)``: how many candidates go to the reranker.

    All of ``top`` if there are fewer than ``probe`` candidates, if ``top`` is
    shallow anyway or if the first stands out from the fifth by more than
    ``spread``; else only ``shallow``.
    """
    depth = _depth(top, shallow, spread, probe, lambda c: c)
    return fused.groupBy("query_id").agg(F.count("*").alias("fused"), depth.alias("depth"))


def cut_to_depth(fused: DataFrame, opt: SearchOptions) -> DataFrame:
    """Candidates for the reranker; the depth is found in the same pass."""
    depth = F.lit(opt.rerank_top)
    if opt.adaptive:
        per_query = W.partitionBy("query_id")
        depth = _depth(opt.rerank_top, 10, 0.02, 5, lambda c: c.over(per_query))
    return fused.withColumn("_depth", depth).where(F.col("fused_rank") <= F.col("_depth")).drop("_depth")


# ---------------------------------------------------------------- rerank


def hydrate(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``rerank_text``: the parent's text where there is one, else the leaf's.

    ``candidates`` are read twice, so they should be a written table.
    """
    leaf = chunks.select(
        F.col("id").alias("chunk_id"), "raw_content", "parent_chunk_id"
    ).dropDuplicates(["chunk_id"])
    own = candidates.join(leaf, "chunk_id", "left")
    wanted = own.select(F.col("parent_chunk_id").alias("id")).where("id is not null").distinct()
    parents = (
        chunks.select("id", F.col("raw_content").alias("parent_text"))
        .join(wanted, "id", "left_semi")
        .dropDuplicates(["id"])
        .withColumnRenamed("id", "parent_chunk_id")
    )
    return (
        own.join(parents, "parent_chunk_id", "left")
        .withColumn("rerank_text", F.coalesce("parent_text", "raw_content"))
        .drop("parent_text", "raw_content", "parent_chunk_id")
    )


def noop_scores(candidates: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, rerank_score)``: a countdown that keeps the order."""
    n = F.count("*").over(W.partitionBy("query_id"))
    return candidates.select(
        "query_id", "chunk_id", (n - F.col("fused_rank") + 1).cast("double").alias("rerank_score")
    )


def apply_rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Order by score, missing ones as 0, ties in the fused order; ``score`` is
    the rerank score, or the fused one where there is none."""
    order = W.partitionBy("query_id").orderBy(
        F.coalesce("rerank_score", F.lit(0.0)).desc(), "fused_rank"
    )
    return (
        candidates.join(scores, ["query_id", "chunk_id"], "left")
        .withColumn("position", F.row_number().over(order))
        .withColumn("score", F.coalesce("rerank_score", "rrf"))
    )


def reorder_listwise(ranked: DataFrame, permutations: DataFrame, head: int = LISTWISE_HEAD) -> DataFrame:
    """Put the first ``head`` rows into the order that a listwise judge gave.

    ``permutations``: query_id, ids. Ids outside the head are ignored, rows the
    judge left out follow in their old order, the tail stays as it is. A query
    without permutation keeps its order.
    """
    judged = permutations.select(
        "query_id", F.posexplode(F.array_distinct("ids")).alias("judged", "chunk_id")
    )
    order = W.partitionBy("query_id").orderBy(
        F.when(F.col("position") > head, F.lit(2)).when(F.col("judged").isNull(), 1).otherwise(0),
        F.when(F.col("position") <= head, F.col("judged")),
        "position",
    )
    return (
        ranked.join(judged, ["query_id", "chunk_id"], "left")
        .withColumn("position", F.row_number().over(order))
        .drop("judged")
    )


def one_per_section(ranked: DataFrame) -> DataFrame:
    """Keep the best row per document and section; null titles are one section."""
    key = W.partitionBy(
        "query_id", "document_id", F.coalesce("section_title", F.lit(""))
    ).orderBy("position")
    order = W.partitionBy("query_id").orderBy("position")
    return (
        ranked.withColumn("_n", F.row_number().over(key))
        .where("_n = 1")
        .drop("_n")
        .withColumn("position", F.row_number().over(order))
    )


def limited(ranked: DataFrame, limit: int) -> DataFrame:
    return ranked.where(F.col("position") <= limit)


# ---------------------------------------------------------------- whole search


Side = Callable[[DataFrame, int], DataFrame]


def sides(
    chunks: DataFrame,
    queries: DataFrame,
    tokens: Callable[[Column], Column],
    opt: SearchOptions = SearchOptions(),
    variants: DataFrame | None = None,
    dimension: int = 64,
    dense: Side | None = None,
    sparse: Side | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Hits of the dense and of the sparse side.

    ``dense`` and ``sparse`` search an index for (queries, k); without them all
    chunks are scanned.
    """
    dense = dense or (lambda q, k: dense_topk(chunks, q, k, dimension))
    sparse = sparse or (lambda q, k: bm25_topk(chunks, q, k, tokens, opt.k1, opt.b))
    if variants is None:
        near = dense(queries, opt.pool)
    else:
        named = variants.join(queries.select("query_id", "category", "product"), "query_id")
        # a number of its own for each variant: ids of queries may use all 64 bits
        named = materialise(
            named.withColumn("_q", F.monotonically_increasing_id()), "variants"
        )
        flat = named.select(F.col("_q").alias("query_id"), "embedding", "category", "product")
        hits = dense(flat, opt.pool).withColumnRenamed("query_id", "_q")
        near = union_best_rank(hits.join(named.select("_q", "query_id", "variant"), "_q").drop("_q"))
    return near, sparse(queries, opt.pool)


def search(
    chunks: DataFrame,
    queries: DataFrame,
    tokens: Callable[[Column], Column],
    opt: SearchOptions = SearchOptions(),
    rerank: Callable[[DataFrame], DataFrame] | None = None,
    listwise: Callable[[DataFrame], DataFrame] | None = None,
    variants: DataFrame | None = None,
    dimension: int = 64,
    dense: Side | None = None,
    sparse: Side | None = None,
    diagnose: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The whole pipeline over a set of queries.

    ``chunks``: the chunk table joined with its documents' category, product,
    version, title and slug. ``queries``: query_id, text, embedding, category,
    product. ``variants`` (query_id, variant, embedding) replaces the dense
    side by the union of its lists. ``rerank`` gives (query_id, chunk_id,
    rerank_score) for hydrated candidates, ``listwise`` permutations for the
    first rows (query_id, position, chunk_id, text, rerank_text); both default
    to keeping the order. A query above 4000 characters has no results. With
    ``diagnose`` the :func:`diagnostics` of the queries are given as well.
    """
    queries = queries.where(F.length("text") <= 4000)
    near, said = sides(chunks, queries, tokens, opt, variants, dimension, dense, sparse)
    fused = fuse(near, said, opt.rrf_k)
    if diagnose:
        near, said = materialise(near, "dense"), materialise(said, "sparse")
        fused = materialise(fuse(near, said, opt.rrf_k), "fused")
    candidates = cut_to_depth(fused, opt)
    candidates = materialise(candidates, "candidates")  # a few rows per query, read several times
    asked = queries.select("query_id", "text")
    if rerank is None:
        scores = noop_scores(candidates)
    else:
        scores = rerank(hydrate(candidates, chunks).join(asked, "query_id"))
    ordered = apply_rerank(candidates, scores)
    if listwise is not None:
        ordered = materialise(ordered, "ordered")
        head = hydrate(ordered.where(F.col("position") <= LISTWISE_HEAD), chunks).join(asked, "query_id")
        ordered = reorder_listwise(ordered, listwise(head), LISTWISE_HEAD)
    facts = chunks.where("chunk_kind = 'leaf'").select(
        F.col("id").alias("chunk_id"), "document_id", "document_title", "document_slug",
        "category", "product", "version", "section_title", "page_start", "page_end",
        F.col("raw_content").alias("content"),
    )
    # the few chunks of the results are picked before their documents are joined
    wanted = ordered.select("chunk_id").distinct()
    found = ordered.join(facts.join(wanted, "chunk_id", "left_semi"), "chunk_id")
    if opt.dedup_sections:
        found = one_per_section(found)
    found = limited(found, opt.limit)
    return (found, diagnostics(near, said, fused, opt)) if diagnose else found


def diagnostics(dense: DataFrame, sparse: DataFrame, fused: DataFrame, opt: SearchOptions) -> DataFrame:
    """Per query: hits of either side, fused candidates, candidates reranked."""
    n = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    kept = n(cut_to_depth(fused, opt), "reranked")
    return (
        n(fused, "fused_hits")
        .join(n(dense, "dense_hits"), "query_id", "left")
        .join(n(sparse, "sparse_hits"), "query_id", "left")
        .join(kept, "query_id", "left")
        .na.fill(0, ["dense_hits", "sparse_hits", "reranked"])
    )
