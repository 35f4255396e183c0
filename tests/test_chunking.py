import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.operators.chunking import ChunkOptions, chunk_documents

KIND = "array<struct<title:string,level:smallint,content:string,page_start:int,page_end:int>>"


def chunks(spark, sections, opt=ChunkOptions()):
    rows = [("d", "Doc", [(t, 1, c, None, None) for t, c in sections])]
    df = spark.createDataFrame(rows, f"document_id string, title string, sections {KIND}")
    return chunk_documents(df, opt=opt).orderBy("chunk_index").collect()


def test_short_section(spark):
    parent, leaf = chunks(spark, [("Section", "One sentence."), ("Blank", "   ")])
    assert (parent.chunk_kind, leaf.chunk_kind) == ("parent", "leaf")
    assert leaf.content == "Doc > Section\n\nOne sentence."
    assert leaf.parent_chunk_id == parent.id and parent.parent_chunk_id is None


def test_tiny_tail_merges(spark):
    opt = ChunkOptions(10, 15, 0, 8)
    leaves = [c for c in chunks(spark, [("S", " ".join(f"w{k}" for k in range(22)))], opt) if c.chunk_kind == "leaf"]
    assert [c.token_count for c in leaves] == [10, 10, 12]
    assert leaves[-1].raw_content.endswith("\n\nw21")


def test_parent_is_shortened(spark):
    w = [f"w{k}" for k in range(1600)]
    parent = chunks(spark, [("S", " ".join(w))])[0]
    head, tail = parent.raw_content.split("\n\n[…section continues…]\n\n")
    assert head.split() == w[:1378] and tail.split() == w[-196:]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 2500), min_size=1, max_size=4))
def test_windows_rebuild_the_text(spark, sizes):
    bodies = [[f"s{k}w{j}" for j in range(n)] for k, n in enumerate(sizes)]
    found = chunks(spark, [(f"T{k}", " ".join(b)) for k, b in enumerate(bodies)])
    assert [c.chunk_index for c in found] == list(range(len(found)))
    by_id = {c.id: c for c in found}
    for k, body in enumerate(bodies):
        own = [c for c in found if c.chunk_kind == "leaf" and c.section_title == f"T{k}"]
        assert all(by_id[c.parent_chunk_id].section_title == f"T{k}" for c in own)
        words = own[0].raw_content.split(" ")
        for a, b in zip(own, own[1:]):
            assert a.raw_content.split(" ")[-49:] == b.raw_content.split(" ")[:49]
            words += b.raw_content.split(" ")[49:]
        assert words == body
        if len(own) > 1:
            assert len(own[-1].raw_content.split(" ")) >= 50


def test_options_are_checked():
    with pytest.raises(ValueError):
        ChunkOptions(min_tokens=600)


def test_no_sections(spark):
    df = spark.createDataFrame([("d", "t", None), ("e", "t", [])], f"document_id string, title string, sections {KIND}")
    assert chunk_documents(df).count() == 0
    assert chunk_documents(df.where(F.lit(False))).count() == 0
