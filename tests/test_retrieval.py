import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.api import Corpus
from corpusmill.functions.models import HashEmbedder, rerank_with
from corpusmill.functions.text import lower_tokens
from corpusmill.operators import retrieval as r
from corpusmill.operators.retrieval import SearchOptions
from corpusmill.operators.topk import Best

CHUNKS = (
    "id bigint, document_id string, chunk_index int, chunk_kind string, content string, raw_content string, "
    "section_title string, page_start int, page_end int, parent_chunk_id bigint, embedding array<float>, "
    "created_at timestamp, category string, product string, version string, document_title string, document_slug string"
)


def chunk(id_, content, doc="d", kind="leaf", embedding=None, section="s", product="p", parent=None):
    return (id_, doc, id_, kind, content, content, section, 1, 1, parent, embedding, None, "toi", product, "1", doc, doc)


def hits(spark, rows):
    return spark.createDataFrame(
        [(q, c, k, 1.0) for q, c, k in rows], "query_id bigint, chunk_id bigint, rank int, score double"
    )


def test_bm25_known_answer(spark):
    texts = ["EVPN overlay design", "OSPF areas", "BGP peers", "EVPN symmetric routing", "QoS maps"]
    df = spark.createDataFrame([chunk(k, t) for k, t in enumerate(texts)] + [chunk(9, "EVPN", kind="parent")], CHUNKS)
    q = spark.createDataFrame([(1, "EVPN overlay", None, None)], "query_id bigint, text string, category string, product string")
    got = r.bm25_topk(df, q, 10, lower_tokens).orderBy("rank").collect()
    assert [x.chunk_id for x in got] == [0, 3] and got[0].score > got[1].score > 0
    empty = r.bm25_topk(df.where("false"), q, 10, lower_tokens)
    assert empty.count() == 0
    assert r.bm25_topk(df, q.where("false"), 10, lower_tokens).count() == 0


def test_dense_finds_itself(spark):
    rng = np.random.default_rng(42)
    v = rng.uniform(-1, 1, (500, 64)).astype(np.float32)
    rows = [chunk(k, "x", embedding=v[k].tolist()) for k in range(500)]
    rows += [chunk(600, "x"), chunk(601, "x", embedding=[0.0] * 64), chunk(602, "x", embedding=[float("nan")] * 64),
             chunk(603, "x", embedding=[1.0]), chunk(604, "x", kind="parent", embedding=v[0].tolist())]
    df = spark.createDataFrame(rows, CHUNKS)
    q = df.where("id < 40").select(F.col("id").alias("query_id"), "embedding", F.lit(None).cast("string").alias("category"), F.lit("p").alias("product"))
    got = r.dense_topk(df, q, 5).collect()
    assert len(got) == 200
    u = v.astype(np.float64) / np.linalg.norm(v, axis=1, keepdims=True)
    for x in got:
        order = np.argsort(-np.round(u @ u[x.query_id], 6), kind="stable")
        assert order[x.rank - 1] == x.chunk_id
    assert all(x.chunk_id == x.query_id for x in got if x.rank == 1)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=3, max_size=3), min_size=1, max_size=30), st.integers(1, 6))
def test_best_keeps_ties_by_id(rows, k):
    scores = np.array(rows, float).T
    best = Best(3, k)
    order = np.random.default_rng(0).permutation(scores.shape[1])
    for part in np.array_split(order, 3):
        best.add(scores[:, part], part.astype(np.int64))
    for q in range(3):
        want = sorted(range(scores.shape[1]), key=lambda j: (-scores[q, j], j))[:k]
        own = best.rows(np.arange(3))
        got = {i for a, i in zip(own[0].to_pylist(), own[1].to_pylist()) if a == q}
        assert got == set(want)


def test_fusion_properties(spark):
    dense = hits(spark, [(1, c, c) for c in range(1, 51)])
    sparse = hits(spark, [(1, c, c - 39) for c in range(40, 90)])
    got = r.fuse(dense, sparse).collect()
    assert len(got) == 89 and max(x.rrf for x in got) <= 2 / 61
    both = [x.rrf for x in got if x.dense_rank and x.sparse_rank]
    assert min(both) > max(x.rrf for x in got if not (x.dense_rank and x.sparse_rank))
    swapped = {(x.chunk_id, x.rrf) for x in r.fuse(sparse, dense).collect()}
    assert swapped == {(x.chunk_id, x.rrf) for x in got}
    tie = sorted(r.fuse(hits(spark, [(1, 7, 1)]), hits(spark, [(1, 3, 1)])).collect(), key=lambda x: x.fused_rank)
    assert [x.chunk_id for x in tie] == [7, 3]


@pytest.mark.parametrize(("n", "k", "depth"), [(4, 60, 30), (50, 60, 10), (50, 10, 30)])
def test_adaptive_depth(spark, n, k, depth):
    fused = r.fuse(hits(spark, [(1, c, c) for c in range(1, n + 1)]), hits(spark, [(1, 1, 1)]), k)
    assert r.adaptive_depth(fused).first()["depth"] == depth
    assert r.cut_to_depth(fused, SearchOptions()).count() == min(n, depth)
    assert r.cut_to_depth(fused, SearchOptions(adaptive=False)).count() == min(n, 30)


def test_union_best_rank(spark):
    rows = spark.createDataFrame(
        [(1, 0, 5, 1, 0.1), (1, 0, 6, 2, 0.2), (1, 1, 6, 1, 0.3), (1, 1, 7, 2, 0.4)],
        "query_id bigint, variant int, chunk_id bigint, rank int, score double",
    )
    got = r.union_best_rank(rows).orderBy("rank").collect()
    assert [(x.chunk_id, x.score) for x in got] == [(5, 0.1), (6, 0.3), (7, 0.4)]


def test_listwise_and_sections(spark):
    rows = spark.createDataFrame(
        [(1, c, c, "d", "s" if c < 3 else None) for c in range(1, 8)],
        "query_id bigint, chunk_id bigint, position int, document_id string, section_title string",
    )
    order = spark.createDataFrame([(1, [3, 99, 1, 3])], "query_id bigint, ids array<bigint>")
    got = r.reorder_listwise(rows, order).orderBy("position").collect()
    assert [x.chunk_id for x in got] == [3, 1, 2, 4, 5, 6, 7]
    assert [x.chunk_id for x in r.one_per_section(rows).orderBy("position").collect()] == [1, 3]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = {"evpn": "EVPN overlay with VXLAN", "ospf": "OSPF areas and costs", "cake": "Bake a cake slowly"}
    e = HashEmbedder()
    documents = spark.createDataFrame(
        [(d, d, "toi", d, "1", d, 1, 1, None) for d in texts],
        "id string, title string, category string, product string, version string, slug string, pages int, section_count int, ingested_at timestamp",
    )
    rows = []
    for k, (d, t) in enumerate(texts.items()):
        rows.append((2 * k, d, 0, "parent", f"{d} > A\n\n{t} whole", f"{t} whole", "A", 1, 2, None, None, None))
        rows.append((2 * k + 1, d, 1, "leaf", f"{d} > A\n\n{t}", t, "A", 1, 2, 2 * k, e([t])[0].tolist(), None))
    chunks = spark.createDataFrame(
        rows, "id bigint, document_id string, chunk_index int, chunk_kind string, content string, raw_content string, "
        "section_title string, page_start int, page_end int, parent_chunk_id bigint, embedding array<float>, created_at timestamp",
    )
    runs = spark.createDataFrame([], "id bigint, status string, started_at timestamp, finished_at timestamp")
    return Corpus(spark, documents, chunks, runs)


def test_tools(corpus):
    got = corpus.search_docs("EVPN overlay", 5)
    assert got[0]["document_id"] == "evpn" and got[0]["content"] == "EVPN overlay with VXLAN"
    assert corpus.search_docs("x" * 4001) == []
    assert {g["document_id"] for g in corpus.search_docs("EVPN overlay", 5, product="ospf")} == {"ospf"}
    found = corpus.lookup_section("evpn", "A")
    assert found["found"] and found["chunk_count"] == 2
    assert found["body"] == "EVPN overlay with VXLAN whole\n\nEVPN overlay with VXLAN"
    assert not corpus.lookup_section("evpn", "a")["found"]
    assert corpus.list_documents(limit=2)["count"] == 2
    assert corpus.get_document("evpn")["chunk_count"] == 2
    assert corpus.get_document("none") == {"found": False}
    assert corpus.get_status()["healthy"] and corpus.get_status()["chunks"] == 6


def test_reranker_sees_parents_and_decides(spark, corpus):
    seen = rerank_with(lambda: lambda q, texts: [1.0 if "cake slowly whole" in t else 0.0 for t in texts])
    other = Corpus(spark, corpus.documents, corpus.chunks, corpus.runs, rerank=seen)
    assert other.search_docs("EVPN overlay", 5)[0]["document_id"] == "cake"


def test_multi_query_and_bench(spark, corpus):
    q = spark.createDataFrame(
        [(0, "how do I configure EVPN overlay", None, None, ["evpn"], None, None, 1),
         (1, "ospf costs", None, None, None, "OSPF", None, 3),
         (2, "ospf costs", None, None, ["x"], "ospf", [1], 5)],
        "query_id bigint, text string, category string, product string, expect_any array<string>, "
        "expect_product string, expect_ids array<bigint>, source_chunk_id bigint",
    )
    found = corpus.search(q, multi_query=True).where("position = 1").orderBy("query_id").collect()
    assert [x.document_id for x in found] == ["evpn", "ospf", "ospf"]
    row = corpus.bench(q).first()
    assert (row.queries, row.top1_hit_rate, row.topk_hit_rate) == (3, 66.67, 100.0)
    rows, funnel = corpus.curate_triples(q, 2)
    assert rows.count() == funnel["kept"] == 3
    assert {len(r.negatives) for r in rows.collect()} == {2}
    huge = q.withColumn("query_id", F.lit(2**62) + F.col("query_id"))
    assert {r.query_id for r in corpus.search(huge, multi_query=True).collect()} == {2**62 + k for k in range(3)}
    picked = corpus.search(q, listwise=lambda head: head.where("position = 2").groupBy("query_id").agg(F.collect_list("chunk_id").alias("ids")))
    plain = {(r.query_id, r.position): r.chunk_id for r in corpus.search(q).collect()}
    assert {r.query_id: r.chunk_id for r in picked.where("position = 1").collect()} == {k: plain[k, 2] for k in range(3)}
    assert corpus.validate_queries(q).where("query_id = 1").first().retriever_rank == 0
