import math
import random

from pyspark.sql import functions as F

from corpusmill.operators import catalog, evaluate, mining

RESULTS = "query_id bigint, position int, relevant boolean, chunk_id bigint, document_id string, product string"


def ranked(spark, rows):
    return spark.createDataFrame(rows, RESULTS)


def six(query, relevant=1):
    """Six ranked rows; the first is relevant, the second of its product."""
    products = ["a", "A", "b", None, "", "c"]
    return [(query, k + 1, k + 1 == relevant, 100 + k, f"d{k}", p) for k, p in enumerate(products)]


def test_triples(spark):
    rows = [*six(1), *six(2, relevant=0), *six(3)[:3]]
    got = mining.triples(ranked(spark, rows), 4).collect()
    assert [(r.query_id, r.positive.chunk_id, r.negatives) for r in got] == [(1, 100, [102, 103, 104, 105])]
    queries = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "query_id bigint")
    row = mining.curation_statistics(ranked(spark, rows), queries).first()
    assert tuple(row) == (4, 1, 1, 1, 1)
    assert mining.triples(ranked(spark, []), 4).count() == 0


def test_negative_is_of_another_document(spark):
    rows = [(1, 1, True, 1, "d", "a"), (1, 2, False, 2, "d", "b"), (1, 3, False, 3, "e", "b")]
    assert mining.triples(ranked(spark, rows), 1).first().negatives == [3]


def test_reachability(spark):
    rows = [(1, k + 1, False, 10 + k, "d", None) for k in range(12)]
    sources = spark.createDataFrame([(1, 14), (2, 14), (3, None)], "query_id bigint, source_chunk_id bigint")
    got = mining.reachability(ranked(spark, rows), sources).collect()
    assert [(r.query_id, r.retriever_rank, r.top_ids) for r in got] == [(1, 4, list(range(10, 20)))]


def test_relevance(spark):
    columns = "chunk_id bigint, ids array<bigint>, tokens array<string>, want string, slug string, title string, product string"
    rows = [
        (5, [5], ["x"], None, None, None, None, True),
        (5, [6], ["slug"], "p", "slug", "t", "p", False),
        (5, [], None, "P", None, None, "p", True),
        (5, None, ["LUG"], "q", "slug", None, "p", True),
        (5, None, ["title"], None, "slug", "A Title", None, True),
        (5, None, ["none"], None, "slug", "t", None, False),
        (5, None, None, None, None, None, None, False),
    ]
    df = spark.createDataFrame([r[:-1] for r in rows], columns)
    c = F.col
    got = df.select(evaluate.is_relevant(c("chunk_id"), c("ids"), c("tokens"), c("want"), c("slug"), c("title"), c("product")))
    assert [r[0] for r in got.collect()] == [r[-1] for r in rows]


def test_hit_rates(spark):
    rows = [(1, 1, True, 1, "d", None), (2, 1, False, 1, "d", None), (2, 3, True, 2, "d", None), (3, 11, True, 3, "d", None)]
    queries = spark.createDataFrame([(k,) for k in range(1, 5)], "query_id bigint")
    row = evaluate.hit_rates(ranked(spark, rows), queries).first()
    assert tuple(row) == (4, 25.0, 50.0)
    empty = evaluate.hit_rates(ranked(spark, []), queries).first()
    assert tuple(empty) == (4, 0.0, 0.0)


def test_latencies(spark):
    rng = random.Random(1)
    rows = [(f"g{n}", float(rng.randint(0, 50))) for n in range(1, 25) for _ in range(n)] + [("g1", None)]
    got = {r.g: r for r in evaluate.latency_report(spark.createDataFrame(rows, "g string, ms double"), "ms", "g").collect()}
    for n in range(1, 25):
        v = sorted(x for g, x in rows if g == f"g{n}" and x is not None)
        r = got[f"g{n}"]
        assert (r.n, r.p50, r.p95, r.maximum) == (n, v[n // 2], v[min(n - 1, math.ceil(0.95 * n) - 1)], v[-1])


def test_section_pages_come_from_the_ends(spark):
    rows = [(3, "d", "S", 2, "c", 7, 8), (1, "d", "S", 0, "a", None, 5), (2, "d", "S", 1, "b", 6, 6), (2, "d", "S", 1, "b", 6, 6)]
    df = spark.createDataFrame(rows, "id bigint, document_id string, section_title string, chunk_index int, raw_content string, page_start int, page_end int")
    df = df.withColumns({"created_at": F.current_timestamp(), "chunk_kind": F.lit("leaf")})
    row = catalog.lookup_section(df, "d", "S").first()
    assert (row.chunk_count, row.page_start, row.page_end, row.body) == (3, None, 8, "a\n\nb\n\nc")
    assert catalog.lookup_section(df, "d", "s").first() is None
