"""The tools and verbs of the engine as one Python object.

Each method answers a whole set of queries where that makes sense; a single
query is a set of one.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.functions.analyze import stemmed_tokens
from corpusmill.functions.models import Embedder, HashEmbedder, embed
from corpusmill.functions.query import annotated, query_variants
from corpusmill.operators import catalog, evaluate, mining, retrieval
from corpusmill.operators.dense_index import DenseIndex
from corpusmill.operators.retrieval import SearchOptions
from corpusmill.operators.sparse_index import SparseIndex
from corpusmill.session import materialise
from corpusmill.sources.store import Store

LONGEST_QUERY = 4000


class Corpus:
    def __init__(
        self,
        spark: SparkSession,
        documents: DataFrame,
        chunks: DataFrame,
        runs: DataFrame | None = None,
        embedder: Callable[[], Embedder] = HashEmbedder,
        tokens: Callable[[Column], Column] = stemmed_tokens,
        rerank: Callable[[DataFrame], DataFrame] | None = None,
        dimension: int = 64,
        sparse_index: SparseIndex | None = None,
        dense_index: DenseIndex | None = None,
    ):
        self.sparse_index, self.dense_index = sparse_index, dense_index
        self.spark, self.documents, self.runs = spark, documents, runs
        self.chunks = chunks
        self.embedder, self.tokens, self.rerank = embedder, tokens, rerank
        self.dimension = dimension

    @staticmethod
    def open(spark: SparkSession, store: Store, **options) -> "Corpus":
        """The corpus of a store, searched by the indexes it has."""
        sparse = dense = None
        if store.read("postings") is not None:
            sparse = SparseIndex(store.read)
        centroids = store.read("centroids")
        if centroids is not None:
            centres = np.array([r["v"] for r in centroids.orderBy("cell").collect()])
            dense = DenseIndex(centres, lambda cells: store.read("vectors", cells), store.read("gone"))
        return Corpus(
            spark, store.read("documents"), store.read("chunks"), store.read("ingest_runs"),
            sparse_index=sparse, dense_index=dense, **options,
        )

    def _joined(self) -> DataFrame:
        facts = self.documents.select(
            F.col("id").alias("document_id"), "category", "product", "version",
            F.col("title").alias("document_title"), F.col("slug").alias("document_slug"),
        )
        return self.chunks.join(facts, "document_id")

    def queries(self, texts: list[str], category: str | None = None, product: str | None = None) -> DataFrame:
        rows = [(k, t, category, product) for k, t in enumerate(texts)]
        return self.spark.createDataFrame(
            rows, "query_id bigint, text string, category string, product string"
        )

    def search(
        self,
        queries: DataFrame,
        opt: SearchOptions = SearchOptions(),
        multi_query: bool = False,
        rewrite: Callable[[Column], Column] | None = None,
        listwise: Callable[[DataFrame], DataFrame] | None = None,
        diagnose: bool = False,
    ) -> DataFrame | tuple[DataFrame, DataFrame]:
        """Results of ``queries`` (query_id, text, category, product).

        Acronyms are explained first. ``rewrite`` changes the text that is
        embedded, and only that; with ``multi_query`` each variant of it is
        searched on the dense side and the lists are united.
        """
        asked = queries.withColumn("text", annotated(F.col("text")))
        dense_text = F.col("text") if rewrite is None else rewrite(F.col("text"))
        variants = None
        if multi_query:
            variants = asked.select(
                "query_id", F.posexplode(query_variants(dense_text)).alias("variant", "v")
            ).select("query_id", "variant", embed(F.col("v"), self.embedder, True).alias("embedding"))
        asked = asked.withColumn("embedding", embed(dense_text, self.embedder, True))
        asked = materialise(asked, "queries")  # embedded once, read by both sides
        dense = sparse = None
        if self.dense_index is not None:
            dense = self.dense_index.topk
        if self.sparse_index is not None:
            sparse = lambda q, k: self.sparse_index.topk(q, k, self.tokens, opt.k1, opt.b)
        return retrieval.search(
            self._joined(), asked, self.tokens, opt, self.rerank, listwise, variants, self.dimension,
            dense, sparse, diagnose,
        )

    def search_docs(
        self, query: str, top_k: int = 10, category: str | None = None, product: str | None = None,
        dedup_per_section: bool = False, with_diagnostics: bool = False,
    ) -> list[dict] | dict:
        """The search tool: at most 50 results of one query, as records.

        A query that is too long gives none and a warning. With diagnostics,
        a record of ``results``, ``diagnostics`` (hits of both sides, fused and
        reranked candidates) and ``warning``; results then have the scores of
        both sides.
        """
        if len(query) > LONGEST_QUERY:
            said = f"the query has {len(query)} characters, more than {LONGEST_QUERY}"
            if with_diagnostics:
                return {"results": [], "diagnostics": None, "warning": said}
            warnings.warn(said, stacklevel=2)
            return []
        found = self.search(
            self.queries([query], category, product),
            SearchOptions.for_top_k(top_k, dedup_per_section),
            diagnose=with_diagnostics,
        )
        columns = [
            "chunk_id", "document_id", "document_title", "document_slug", "category", "product",
            "version", "section_title", "page_start", "page_end", "score", "content",
        ]
        if not with_diagnostics:
            return [r.asDict() for r in found.orderBy("position").select(*columns).collect()]  # <= 50
        found, report = found
        columns += ["dense_score", "bm25_score"]
        rows = [r.asDict() for r in found.orderBy("position").select(*columns).collect()]  # <= 50
        row = report.drop("query_id").first()
        none = {"fused_hits": 0, "dense_hits": 0, "sparse_hits": 0, "reranked": 0}
        return {"results": rows, "diagnostics": none if row is None else row.asDict(), "warning": None}

    def lookup_section(self, document_id: str, section_title: str, kind: str | None = None) -> dict:
        row = catalog.lookup_section(self.chunks, document_id, section_title, kind).first()
        if row is None:
            return {"found": False, "message": f"no section {section_title!r} in {document_id!r}"}
        return {"found": True, **row.asDict()}

    def list_documents(self, category: str | None = None, product: str | None = None, limit: int = 100) -> dict:
        rows = [r.asDict() for r in catalog.list_documents(self.documents, category, product, limit).collect()]
        return {"count": len(rows), "documents": rows}

    def get_document(self, document_id: str) -> dict:
        row = catalog.get_documents(self.documents, self.chunks, [document_id]).first()
        return {"found": False} if row is None else {"found": True, **row.asDict()}

    def get_status(self) -> dict:
        try:
            return catalog.store_status(self.documents, self.chunks, self.runs).first().asDict()
        except Exception as error:  # noqa: BLE001 - the tool reports, it does not raise
            return {"healthy": False, "error": str(error)}

    def judged_results(self, queries: DataFrame, opt: SearchOptions) -> DataFrame:
        """Results with ``relevant``, by the expectations of ``queries``."""
        found = self.search(queries.select("query_id", "text", "category", "product"), opt)
        asked = queries.select("query_id", "expect_any", "expect_product", "expect_ids")
        return found.join(asked, "query_id").withColumn(
            "relevant",
            evaluate.is_relevant(
                F.col("chunk_id"), F.col("expect_ids"), F.col("expect_any"), F.col("expect_product"),
                F.col("document_slug"), F.col("document_title"), F.col("product"),
            ),
        )

    def bench(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        opt = SearchOptions(limit=top_k)
        return evaluate.hit_rates(self.judged_results(queries, opt), queries, top_k)

    def latencies(self, queries: DataFrame, top_k: int = 10) -> dict[str, float]:
        """p50, p95 and average milliseconds of the queries, searched one by one.

        Meant for an evaluation set, not for a corpus of queries.
        """
        took = []
        for row in queries.select("text", "category", "product").where("text is not null").toLocalIterator():
            began = time.perf_counter()
            self.search_docs(row["text"], top_k, row["category"], row["product"])
            took.append((1000 * (time.perf_counter() - began),))
        samples = self.spark.createDataFrame(took, "ms double").withColumn("all", F.lit(0))
        row = evaluate.latency_report(samples, "ms", "all").first()
        names = {"p50": "latency_p50_ms", "p95": "latency_p95_ms", "average": "latency_avg_ms"}
        return {name: None if row is None else row[c] for c, name in names.items()}

    def _curated(self, queries: DataFrame) -> DataFrame:
        opt = SearchOptions(limit=20, pool=40, rerank_top=20, dedup_sections=True)
        loose = queries.withColumn("expect_ids", F.lit(None).cast("array<bigint>"))
        return materialise(self.judged_results(loose, opt), "judged")

    def curate_triples(self, queries: DataFrame, negatives: int = 4) -> tuple[DataFrame, dict]:
        """Training rows (query, positive, negatives) and the funnel's counts."""
        results = self._curated(queries)
        funnel = mining.curation_statistics(results, queries, negatives).first().asDict()
        return mining.triple_rows(results, queries, negatives), funnel

    def validate_queries(self, queries: DataFrame, top_k: int = 20) -> DataFrame:
        """``queries`` also has source_chunk_id; those that reach it remain."""
        found = self.search(queries.select("query_id", "text", "category", "product"), SearchOptions(limit=top_k))
        return mining.reachability(found, queries.select("query_id", "source_chunk_id"))
