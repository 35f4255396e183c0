"""The whole ingest: catalog, files, sections, chunks, vectors, snapshot."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.functions.analyze import stemmed_tokens
from corpusmill.functions.models import Embedder, HashEmbedder, embed
from corpusmill.operators import dense_index, ingest as steps, sparse_index
from corpusmill.operators.chunking import ChunkOptions, chunk_documents
from corpusmill.operators.sections import split_sections, stamp_pages
from corpusmill.session import materialise, release
from corpusmill.sources import files
from corpusmill.sources.store import Store

RUN = (
    "id BIGINT, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, docs_total INT, "
    "docs_skipped INT, docs_upserted INT, chunks_upserted INT, catalog_sha256 STRING, "
    "error_msg STRING"
)


def prepare(
    entries: DataFrame,
    texts: DataFrame,
    listed: DataFrame,
    opt: ChunkOptions = ChunkOptions(),
) -> tuple[DataFrame, DataFrame]:
    """Documents with sections and state, and the chunks of those that are ok."""
    held = files.with_section_lists(files.with_markdown(entries, texts), listed)
    sections = split_sections(F.col("text"), F.col("title"))
    held = held.withColumn("sections", stamp_pages(sections, F.col("listed")))
    judged = steps.gate(held)
    ok = judged.where("state = 'ok'").withColumnRenamed("id", "document_id")
    return judged, chunk_documents(ok, opt=opt)


def _vectors(
    store: Store, fresh: DataFrame, dimension: int, segment: int
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows of the vector index, and its centroids where the store has none."""
    held = store.read("centroids")
    if held is not None:
        rows = held.orderBy("cell").collect()  # at most dense_index.MOST_CELLS
        return dense_index.assigned(fresh, np.array([r["v"] for r in rows]), dimension, segment), {}
    centres = dense_index.train(fresh, dimension)
    rows = [(k, v.tolist()) for k, v in enumerate(centres)]
    table = store.spark.createDataFrame(rows, "cell int, v array<double>")
    return dense_index.assigned(fresh, centres, dimension, segment), {"centroids": table}


def ingest(
    spark: SparkSession,
    base: str,
    store: Store,
    catalog: str = "catalog.json",
    embedder: Callable[[], Embedder] = HashEmbedder,
    embedding_model: str = "hash",
    force: bool = False,
    dry_run: bool = False,
    category: str | None = None,
    prune: bool = False,
    opt: ChunkOptions = ChunkOptions(),
    tokens: Callable[[Column], Column] = stemmed_tokens,
    dimension: int = 64,
) -> dict[str, object]:
    """Bring ``store`` up to the catalog at ``base``; the run's log row.

    The same catalog with the same category filter is skipped as a whole,
    unchanged documents one by one; ``force`` does neither. A dry run writes
    nothing, so it never makes the next run skip. Errors are kept as rows of
    the table ``outcomes``, all of them. With ``prune``, documents that the
    catalog does not name any more go, with their chunks. The inverted index
    and the vector index get one segment each in the same version of the store;
    ``tokens`` is the analyser, which searches must share, and the first run's
    vectors make the cells.
    """
    started = datetime.now(timezone.utc)
    digest = files.file_digests(spark, f"{base}/{catalog}").first()["sha256"]
    mark = digest if category is None else f"{digest}/{category.lower()}"
    runs = store.read("ingest_runs")
    last = steps.last_successful(runs).first() if runs is not None else None
    run = {"id": int(started.timestamp() * 1e6), "started_at": started, "catalog_sha256": mark}
    run |= {"docs_total": 0, "docs_skipped": 0, "docs_upserted": 0, "chunks_upserted": 0}
    if last is not None and last["catalog_sha256"] == mark and not force:
        return run | {"status": "skipped"}
    every = steps.latest_entries(files.read_catalog(spark, f"{base}/{catalog}"))
    entries = steps.in_category(every, category)
    documents, chunks = store.read("documents"), store.read("chunks")
    empty = entries.limit(0)
    planned = steps.plan(entries, documents if documents is not None else empty, force)
    todo = entries.join(planned.where("action = 'upsert'"), "id", "left_semi")
    texts, listed = files.read_texts(spark, base, "md"), files.read_texts(spark, base, "json")
    judged, fresh = prepare(todo, texts, listed, opt)
    judged = materialise(judged.drop("text", "listed", "sections"), "ingest-documents")
    vectors = F.when(F.col("chunk_kind") == "leaf", embed(F.col("content"), embedder))
    fresh = materialise(
        fresh.withColumns(
            {
                "embedding": vectors,
                "embedding_model": F.when(F.col("chunk_kind") == "leaf", F.lit(embedding_model)),
                "created_at": F.lit(started).cast("timestamp"),
            }
        ),
        "ingest-chunks",
    )
    outcomes = judged.select("id", "state").unionByName(
        planned.where("action = 'skip'").select("id", F.lit("skip").alias("state"))
    )
    outcomes = outcomes.select(F.lit(run["id"]).alias("run_id"), "id", "state")
    counted = steps.run_status(outcomes).first()
    if counted is None:
        run |= {"status": "success"}
    else:
        run |= {k: counted[k] for k in ("docs_total", "docs_skipped", "docs_upserted", "status")}
    run["chunks_upserted"] = fresh.count()
    if not dry_run:
        new = judged.where("state = 'ok'").drop("state").withColumn(
            "ingested_at", F.lit(started).cast("timestamp")
        )
        gone_documents = new.select("id")
        if prune and documents is not None:
            gone_documents = gone_documents.unionByName(steps.missing_documents(every, documents).select("id"))
        gone_documents = materialise(gone_documents.distinct(), "ingest-gone")
        gone_chunks = gone_documents.withColumnRenamed("id", "document_id")
        finished = datetime.now(timezone.utc)
        log = spark.createDataFrame(
            [
                (run["id"], started, finished, run["status"], run["docs_total"], run["docs_skipped"],
                 run["docs_upserted"], run["chunks_upserted"], mark, None)
            ],
            RUN,
        )
        facts = new.select(F.col("id").alias("document_id"), "category", "product")
        none = F.lit(None).cast("string")
        removed = None
        if chunks is not None:
            stored = store.read("chunks", gone_chunks).join(gone_chunks, "document_id", "left_semi")
            removed = stored.withColumns({"category": none, "product": none})
        index = sparse_index.changes(
            fresh.join(facts, "document_id"), removed, tokens, (store.current() or 0) + 1
        )
        index["vectors"], centroids = _vectors(
            store, fresh.join(facts, "document_id"), dimension, (store.current() or 0) + 1
        )
        store.commit(
            replace=centroids,
            append={"ingest_runs": log, "outcomes": outcomes, **index},
            upsert={"documents": (new, gone_documents), "chunks": (fresh, gone_chunks)},
        )
        release(gone_documents)
    release(judged, fresh)
    return run


