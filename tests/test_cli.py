import json

import pytest

from corpusmill.__main__ import main
from corpusmill.api import Corpus
from corpusmill.plans.ingest import ingest
from corpusmill.sources.store import Store
from tests.test_ingest import write_catalog

EVPN = "# Overlay\n" + "EVPN overlay with VXLAN tunnels between leaf switches. " * 3
OSPF = "# Areas\n" + "OSPF areas summarise routes at their borders. " * 3


def test_verbs(spark, tmp_path, capsys):
    base, store = tmp_path / "in", f"file://{tmp_path}/store"
    base.mkdir()
    write_catalog(base, [("evpn", "1", EVPN, []), ("ospf", "1", OSPF, [])])
    assert main(["ingest", str(base), store]) == 0
    assert json.loads(capsys.readouterr().out)["docs_upserted"] == 2
    assert main(["ingest", str(base), store]) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "skipped"
    (tmp_path / "q.json").write_text(json.dumps({"version": 1, "queries": [
        {"query": "EVPN overlay", "expect_any": ["evpn"]}, {"query": "OSPF areas", "expect_any": ["ospf"]}]}))
    history = str(tmp_path / "history")
    assert main(["bench", store, str(tmp_path / "q.json"), "--history", history, "--label", "x"]) == 0
    row = json.loads(capsys.readouterr().out)
    assert row["top1_hit_rate"] == 100.0 and row["query_count"] == 2 and row["query_set_version"] == 1
    assert 0 < row["latency_p50_ms"] <= row["latency_p95_ms"] and row["latency_avg_ms"] > 0
    kept = spark.read.json(history).first()
    assert kept.label == "x" and kept.latency_p95_ms == row["latency_p95_ms"]
    assert main(["curate-triples", store, str(tmp_path / "q.json"), str(tmp_path / "t"), "--negatives-per-query", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["kept"] == 2
    triple = spark.read.json(str(tmp_path / "t")).where("query = 'EVPN overlay'").first()
    assert triple.positive.document_id == "evpn" and triple.positive.text.startswith("EVPN overlay with")
    assert [(n.document_id, n.document_title) for n in triple.negatives] == [("ospf", "Doc ospf")]
    chunk = Store(spark, store).read("chunks").where("chunk_kind = 'leaf' and document_id = 'evpn'").first()
    lines = [{"query": "EVPN overlay", "source_chunk_id": chunk.id}, {"query": "EVPN overlay", "source_chunk_id": 5}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert main(["validate-bench-queries", store, str(tmp_path / "c.jsonl"), str(tmp_path / "v")]) == 0
    assert json.loads(capsys.readouterr().out) == {"kept": 1, "dropped": 1, "survival_percent": 50.0}
    kept = spark.read.json(str(tmp_path / "v")).collect()
    assert [(r.source_chunk_id, r.retriever_rank) for r in kept] == [(chunk.id, 0)]


def test_dump_and_restore(spark, tmp_path, capsys):
    base, store = tmp_path / "in", f"file://{tmp_path}/store"
    base.mkdir()
    write_catalog(base, [("evpn", "1", EVPN, []), ("ospf", "1", OSPF, [])])
    main(["ingest", str(base), store])
    capsys.readouterr()
    assert main(["dump", store, f"file://{tmp_path}/out"]) == 0
    digest = json.loads(capsys.readouterr().out)["sha256"]
    again = f"file://{tmp_path}/again"
    with pytest.raises(ValueError):
        main(["restore", f"file://{tmp_path}/out", again, "--sha256", "0" * 64])
    assert main(["restore", f"file://{tmp_path}/out", again, "--sha256", digest]) == 0
    old, new = Store(spark, store), Store(spark, again)
    for name in ("documents", "chunks"):
        assert new.read(name).exceptAll(old.read(name)).isEmpty() and new.read(name).count() == old.read(name).count()
    found = Corpus.open(spark, new).search_docs("EVPN overlay")  # without indexes
    assert found[0]["document_id"] == "evpn"
    part = next((tmp_path / "out" / "tables" / "chunks").rglob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        main(["restore", f"file://{tmp_path}/out", f"file://{tmp_path}/third"])


def test_indexed_search_follows_ingest(spark, tmp_path):
    base, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store", buckets=4)
    base.mkdir()
    write_catalog(base, [("evpn", "1", EVPN, []), ("ospf", "1", OSPF, [])])
    ingest(spark, str(base), store)
    write_catalog(base, [("evpn", "2", EVPN.replace("overlay", "underlay"), []), ("ospf", "1", OSPF, [])])
    ingest(spark, str(base), store)
    asked = ["EVPN overlay", "underlay tunnels", "borders"]
    indexed, scanned = Corpus.open(spark, store), Corpus(spark, store.read("documents"), store.read("chunks"))
    assert indexed.sparse_index and indexed.dense_index
    for query in asked:
        a, b = (c.search_docs(query, with_diagnostics=True) for c in (indexed, scanned))
        assert a == b and a["results"] and a["warning"] is None
    assert indexed.search_docs("borders", with_diagnostics=True)["diagnostics"]["sparse_hits"] == 1
    assert {r["document_id"] for r in indexed.search_docs("EVPN tunnels")} == {"evpn", "ospf"}
    long = indexed.search_docs("x" * 4001, with_diagnostics=True)
    assert long["results"] == [] and "4001" in long["warning"]
    with pytest.warns(UserWarning):
        assert indexed.search_docs("x" * 4001) == []
