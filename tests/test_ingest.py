import json

import pytest

from corpusmill.operators import ingest as steps
from corpusmill.plans.ingest import ingest
from corpusmill.sources import files
from corpusmill.sources.store import ConcurrentWrite, Store


def write_catalog(base, docs):
    for d in ("md", "json"):
        (base / d).mkdir(exist_ok=True)
    entries = []
    for id_, sha, md, listed in docs:
        if md is not None:
            (base / "md" / f"{id_}.md").write_text(md)
        (base / "json" / f"{id_}.json").write_text(listed if isinstance(listed, str) else json.dumps({"sections": listed}))
        entries.append({"id": id_, "CATEGORY": "toi" if id_ != "m" else "Manual", "title": f"Doc {id_}", "slug": id_,
                        "md_path": f"md\\{id_}.md", "json_path": f"json/{id_}.json", "pdf_sha256": sha, "extra": 1})
    (base / "catalog.json").write_text(json.dumps({"generated_at": "2026-01-01T00:00:00Z", "documents": entries}, indent=1))


BODY = "# One\n" + "alpha beta " * 30 + "\n# Two\n" + "gamma delta " * 30
DOCS = [
    ("a", "s1", BODY, [{"title": "One", "level": 1, "page_start": 3, "page_end": 4}]),
    ("b", "s2", BODY, "{corrupt"),
    ("f", "s3", "# Fake conversion of fake.pdf\n72839 bytes and a good deal more of text than that.", []),
    ("t", "s4", "tiny", []),
    ("g", "s5", None, []),
    ("m", "s6", BODY, []),
]


def test_whole_ingest(spark, tmp_path):
    base = tmp_path / "in"
    base.mkdir()
    write_catalog(base, DOCS)
    store = Store(spark, f"file://{tmp_path}/store")
    assert ingest(spark, str(base), store, dry_run=True)["status"] == "partial"
    assert store.current() is None
    assert ingest(spark, str(base), store, category="MANUAL")["docs_total"] == 1
    run = ingest(spark, str(base), store)
    assert (run["status"], run["docs_total"], run["docs_upserted"], run["docs_skipped"]) == ("partial", 6, 2, 3)
    chunks = store.read("chunks")
    assert chunks.count() == run["chunks_upserted"] + 4
    assert chunks.where("section_title = 'One' and document_id = 'a'").first().page_start == 3
    assert chunks.where("chunk_kind = 'leaf' and size(embedding) = 64").count() == 6
    states = {(r.id, r.state) for r in store.read("outcomes").where(f"run_id = {run['id']}").collect()}
    assert states == {("a", "ok"), ("b", "ok"), ("f", "placeholder"), ("t", "placeholder"), ("g", "error"), ("m", "skip")}
    # a partial run is no success: the next one tries again, but stored documents are skipped
    again = ingest(spark, str(base), store)
    assert again["docs_upserted"] == 0 and again["docs_skipped"] == 5


def test_unchanged_catalog_is_skipped_and_one_change_is_one_document(spark, tmp_path):
    base = tmp_path / "in"
    base.mkdir()
    write_catalog(base, DOCS[:2])
    store = Store(spark, f"file://{tmp_path}/store")
    assert ingest(spark, str(base), store)["status"] == "success"
    assert ingest(spark, str(base), store)["status"] == "skipped"
    before = {r.id for r in store.read("chunks").where("document_id = 'b'").collect()}
    write_catalog(base, [("a", "new", "# X\n" + "words " * 40, []), DOCS[1]])
    run = ingest(spark, str(base), store)
    assert (run["docs_upserted"], run["docs_skipped"]) == (1, 1)
    assert {r.id for r in store.read("chunks").where("document_id = 'b'").collect()} == before
    assert {r.section_title for r in store.read("chunks").where("document_id = 'a'").collect()} == {"X"}
    write_catalog(base, DOCS[1:2])
    ingest(spark, str(base), store, prune=True)
    assert {r.id for r in store.read("documents").collect()} == {"b"}
    assert {r.document_id for r in store.read("chunks").collect()} == {"b"}
    store.drop_before(1)
    assert store.read("documents").count() == 1


def test_catalog_errors(spark, tmp_path):
    (tmp_path / "c.json").write_text("null")
    with pytest.raises(Exception):
        files.read_catalog(spark, str(tmp_path / "c.json"))
    with pytest.raises(Exception):
        files.read_catalog(spark, str(tmp_path / "none.json"))


def test_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a", "source_chunk_id": 1}\n\n{"query": "b"}\n')
    assert files.read_lines(spark, str(tmp_path / "q.jsonl"), files.CANDIDATE).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"query": "a"\n')
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path / "bad.jsonl"), files.CANDIDATE).collect()
    out = str(tmp_path / "out")
    files.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), out)
    files.write_lines(spark.createDataFrame([(2, "x")], "a int, b string"), out, "append")
    got = sorted(r.value for r in spark.read.text(out).collect())
    assert got == ['{"a":1}', '{"a":2,"b":"x"}']


def test_query_set(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"version": 2, "queries": [{"query": "a", "expect_any": ["x"]}, {"query": "b", "expect_any_of_chunk_ids": [5]}]}))
    got = files.read_query_set(spark, str(tmp_path / "q.json")).orderBy("query_id").collect()
    assert [(r.query_id, r.query) for r in got] == [(0, "a"), (1, "b")] and got[1].expect_any_of_chunk_ids == [5]


def test_null_sha_is_never_the_same(spark):
    entries = spark.createDataFrame([("a", None), ("b", "x"), ("c", "x")], "id string, pdf_sha256 string")
    stored = spark.createDataFrame([("a", None), ("b", "x")], "id string, pdf_sha256 string")
    got = {r.id: r.action for r in steps.plan(entries, stored).collect()}
    assert got == {"a": "upsert", "b": "skip", "c": "upsert"}
    assert {r.action for r in steps.plan(entries, stored, force=True).collect()} == {"upsert"}


def test_run_log(spark):
    runs = spark.createDataFrame(
        [(1, "running", None, None), (1, "success", "s1", "2026-01-02"), (2, "running", None, None)],
        "id bigint, status string, catalog_sha256 string, f string",
    ).selectExpr("id", "status", "catalog_sha256", "timestamp'2026-01-01' as started_at", "cast(f as timestamp) as finished_at")
    assert {(r.id, r.status) for r in steps.latest_runs(runs).collect()} == {(1, "success"), (2, "running")}
    assert steps.last_successful(runs).first().id == 1
    assert steps.last_successful(runs.where("false")).first() is None


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=8)
    rows = lambda ids, v: spark.createDataFrame([(str(k), v) for k in ids], "id string, v string")
    none = rows([], "").select("id")
    store.commit(upsert={"documents": (rows(range(200), "old"), none)})
    before = set(store._manifest()["tables"]["documents"]["paths"])
    store.commit(upsert={"documents": (rows([7], "new"), none)}, append={"log": rows([1], "a")})
    after = set(store._manifest()["tables"]["documents"]["paths"])
    assert len(before) == 8 and len(before & after) == 7 and len(after) == 8
    held = {r.id: r.v for r in store.read("documents").collect()}
    assert len(held) == 200 and held["7"] == "new" and held["8"] == "old"
    store.commit(upsert={"documents": (rows([], ""), rows([7, 9], "").select("id"))}, append={"log": rows([2], "b")})
    assert store.read("documents").count() == 198 and store.read("log").count() == 2
    store.drop_before(1)
    assert store.versions() == [3] and store.read("documents").count() == 198
    assert store.read("nothing") is None


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a",)], "id string")
    store.commit(replace={"documents": rows})
    monkeypatch.setattr(Store, "current", lambda self: 1)
    store.commit(replace={"documents": rows})
    with pytest.raises(ConcurrentWrite):
        store.commit(replace={"documents": rows.where("false")})
    monkeypatch.undo()
    assert store.read("documents").count() == 1


def test_streaming(spark, tmp_path):
    from corpusmill.streaming.documents import apply_batch, arrivals, run_stream

    (tmp_path / "in").mkdir()
    rows = [{"id": "a", "title": "A", "text": "alpha " * 50, "pdf_sha256": "1"}, {"id": "b", "title": "B", "text": "beta " * 50, "pdf_sha256": "1"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    store = Store(spark, f"file://{tmp_path}/store")
    run_stream(arrivals(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "2.json").write_text(json.dumps(rows[0] | {"text": "gamma " * 50, "pdf_sha256": "2"}))
    run_stream(arrivals(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert store.read("documents").count() == 2
    assert store.read("chunks").where("raw_content like 'gamma%'").count() == 2
    n = store.current()
    apply_batch(store, spark.read.schema("id string, title string, text string, category string, product string, pdf_sha256 string, arrived_at timestamp").json(str(tmp_path / "in")), 1)
    assert store.current() == n
