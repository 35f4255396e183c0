"""Command line: ``python -m corpusmill VERB``.

ingest BASE STORE, bench STORE QUERIES, curate-triples STORE QUERIES OUT,
validate-bench-queries STORE CANDIDATES OUT, dump STORE OUT, restore DUMP
STORE. Exit codes: 0 for success, 1 else.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import functions as F

from corpusmill.api import Corpus
from corpusmill.operators.mining import survival
from corpusmill.plans.ingest import ingest
from corpusmill.session import build_session
from corpusmill.settings import load_settings
from corpusmill.sources import files
from corpusmill.sources.dump import dump, restore
from corpusmill.sources.store import Store


def _asked(queries):
    none = F.lit(None).cast("string")
    return queries.withColumnRenamed("query", "text").withColumns({"category": none, "product": none})


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusmill")
    parser.add_argument("--settings")
    verbs = parser.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("ingest")
    v.add_argument("base")
    v.add_argument("store")
    v.add_argument("--catalog", default="catalog.json")
    v.add_argument("--category")
    for flag in ("--force", "--dry-run", "--prune"):
        v.add_argument(flag, action="store_true")
    v = verbs.add_parser("bench")
    v.add_argument("store")
    v.add_argument("queries")
    v.add_argument("--limit", type=int, default=10)
    v.add_argument("--history")
    v.add_argument("--label", default="")
    for name in ("curate-triples", "validate-bench-queries"):
        v = verbs.add_parser(name)
        v.add_argument("store")
        v.add_argument("queries")
        v.add_argument("out")
    verbs.choices["curate-triples"].add_argument("--negatives-per-query", type=int, default=4)
    verbs.choices["validate-bench-queries"].add_argument("--top-k", type=int, default=20)
    verbs.choices["bench"].add_argument("--no-latency", action="store_true")
    v = verbs.add_parser("dump")
    v.add_argument("store")
    v.add_argument("out")
    v = verbs.add_parser("restore")
    v.add_argument("dump")
    v.add_argument("store")
    v.add_argument("--sha256")
    given = parser.parse_args(args)
    spark = build_session()
    store = Store(spark, given.store)
    if given.verb == "ingest":
        run = ingest(
            spark, given.base, store, given.catalog, force=given.force, dry_run=given.dry_run,
            category=given.category, prune=given.prune,
        )
        print(json.dumps(run, default=str))
        return 0 if run["status"] in ("success", "skipped") else 1
    if given.verb == "dump":
        print(json.dumps({"sha256": dump(store, given.out)}))
        return 0
    if given.verb == "restore":
        print(json.dumps({"version": restore(spark, given.dump, store, given.sha256)}))
        return 0
    settings = load_settings(given.settings)
    corpus = Corpus.open(spark, store, dimension=settings.embedding_dimension)
    if given.verb == "validate-bench-queries":
        rows = files.read_lines(spark, given.queries, files.CANDIDATE).where("query is not null")
        rows = rows.withColumn("query_id", F.xxhash64("query", "source_chunk_id")).dropDuplicates(["query_id"])
        kept = corpus.validate_queries(_asked(rows), given.top_k)
        kept = rows.join(kept.drop("source_chunk_id"), "query_id").withColumnRenamed("top_ids", "retriever_top10_chunk_ids")
        files.write_lines(kept.drop("query_id"), given.out)
        left = files.read_lines(spark, given.out, files.CANDIDATE).count()
        print(json.dumps(survival(left, rows.count())))
        return 0 if left else 1
    asked = files.read_query_set(spark, given.queries)
    queries = _asked(asked).withColumnRenamed(
        "expect_any_of_chunk_ids", "expect_ids"
    )
    if given.verb == "curate-triples":
        rows, funnel = corpus.curate_triples(queries, given.negatives_per_query)
        files.write_lines(rows, given.out)
        print(json.dumps(funnel))
        return 0
    top_k = min(max(given.limit, 1), 50)
    row = corpus.bench(queries, top_k).first().asDict()
    row["query_count"] = row.pop("queries")
    row["query_set_version"] = asked.agg(F.max("version")).first()[0]
    if not given.no_latency:
        row |= corpus.latencies(queries, top_k)
    row |= {"date": datetime.now(timezone.utc).isoformat(), "label": given.label, "top_k": top_k}
    print(json.dumps(row))
    if given.history:
        files.write_lines(spark.createDataFrame([row]), given.history, "append")
    return 0 if row["topk_hit_rate"] >= 80 else 1


if __name__ == "__main__":
    sys.exit(main())
