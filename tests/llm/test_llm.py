"""Operators of the pipeline against brute force, and their edge cases."""

import base64
import itertools
import random
import re
from array import array
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import (
    bpe,
    leakage,
    near_duplicates,
    scan_repair,
    site_lines,
    splitting,
    truncation,
    vector_neighbours,
)

CHUNKS = (
    "id bigint, document_id string, chunk_index int, content string, raw_content string, section_title string, "
    "section_level smallint, page_start int, page_end int, token_count int, parent_chunk_id bigint, chunk_kind string, "
    "embedding array<float>, embedding_model string, created_at timestamp_ntz"
)
# columns whose names clash with what the operators use inside
CLASH = ("n", "at", "key", "word", "line", "rep", "class", "source", "title", "kind", "text", "model", "v", "a", "b")
DOCUMENTS = (
    "doc_id bigint, id string, text string, source string, category string, product string, title string"
)


def chunk(id_, raw, doc="d", kind="leaf", title="Running title of the manual", **more):
    row = {
        "id": id_, "document_id": doc, "chunk_index": id_,
        "content": None if raw is None else f"{title} > S\n\n{raw}", "raw_content": raw, "section_title": "S", "section_level": 1,
        "page_start": None, "page_end": None, "token_count": None, "parent_chunk_id": None, "chunk_kind": kind,
        "embedding": None, "embedding_model": None, "created_at": datetime(2025, 1, 1),
    }
    return tuple((row | more).values())


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, CHUNKS)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).withColumn("n", F.lit(1)).withColumn("tail", F.lit(2))


ODD = [None, "", " \n ", "word", "x" * 200_000, "a b " * 50_000, "﻿​👩‍💻 漢字"]


@pytest.fixture(scope="module")
def odd_chunks(spark):
    rows = [chunk(k, t, doc=None if k == 1 else f"d{k}") for k, t in enumerate(ODD)]
    rows += [chunk(3, "word"), chunk(None, "word"), chunk(50, None, content=None)]
    return frame(spark, rows, clash=True)


@pytest.fixture(scope="module")
def odd_documents(spark):
    rows = [(k, f"d{k}", t, None if k % 2 else "s", None, None if k % 3 else " P ", None) for k, t in enumerate(ODD)]
    return docs(spark, [*rows, rows[3]])


# ---------------------------------------------------------------- 1


LINES = {
    1: ["The quick replication list is reset by the con-", "troller when the update ends. We use dual-", "homing only",
        "", "- 12 -", "Running title of the manuai", "in this case and the c0ntroller keeps thc update"],
    2: ["Allowed ids:", "12", "13", "", "```", "12", "```", "| 12 |", "12", "ends with 12."],
}


def corpus_of_scans(spark):
    plain = "the controller keeps the update and the dual-homing list in this case"
    rows = [chunk(100 + k, plain, page_start=1, page_end=2) for k in range(60)]
    rows += [chunk(k, "\n".join(x), page_start=12, page_end=13) for k, x in LINES.items()]
    return frame(spark, rows, clash=True)


def test_scan_defects(spark):
    got = {(r.id, r.line_no, r.defect) for r in scan_repair.defects(corpus_of_scans(spark)).collect()}
    assert got == {
        (1, 1, "hyphen"), (1, 5, "page_number"), (1, 6, "header"), (1, 7, "misread"), (2, 9, "page_number"),
    }


def test_scan_repair(spark):
    got = {r.id: r.text for r in scan_repair.repaired(corpus_of_scans(spark)).collect()}
    assert got[1] == (
        "The quick replication list is reset by the controller when the update ends. "
        "We use dual-homing only in this case and the controller keeps the update"
    )


def test_swapped_letters_are_no_misreading(spark):
    rows = [chunk(100 + k, "the controller keeps the update") for k in range(60)]
    rows.append(chunk(1, "the contorller keeps teh update here"))
    assert scan_repair.defects(frame(spark, rows)).count() == 0


def test_running_lines_of_a_document_and_of_a_source(spark):
    foot = "CONFIDENTIAL AND PROPRIETARY - DO NOT COPY"
    note = "Draft of the committee, not for release"
    rows = []
    for k in range(120):  # forty documents of three chunks, the foot misread in some
        seen = foot.replace("PROPRIETARY", "PR0PRIETARY") if k % 5 == 0 else foot
        lines = [f"Sentence {k} goes on", seen, str(10 + k % 3), "and ends here."]
        rows.append(chunk(k, "\n".join(lines), doc=f"d{k // 3}", page_start=10 + k % 3, page_end=11 + k % 3))
    for k in range(30):  # once in each document of a source
        lines = [f"Text {'abcdefghij'[k % 10] * 4} of its own goes", "", note, "", "on with more words."]
        rows.append(chunk(200 + k, "\n".join(lines), doc=f"e{k}"))
    documents = docs(spark, [(k, f"e{k}", None, "s", "toi", " Edge" if k % 2 else "EDGE ", None) for k in range(30)])
    chunks = frame(spark, rows, clash=True)
    headers = lambda df: {(r.id, r.line_no) for r in df.where("defect = 'header'").collect()}
    own = {(k, 2) for k in range(120)}
    assert headers(scan_repair.defects(chunks)) == own
    assert headers(scan_repair.defects(chunks, documents)) == own | {(200 + k, 3) for k in range(30)}
    numbers = scan_repair.defects(chunks).where("defect = 'page_number'")
    assert {(r.id, r.line_no) for r in numbers.collect()} == {(k, 3) for k in range(120)}


def test_page_numbers_follow_the_sequence_of_a_document(spark, monkeypatch):
    monkeypatch.setattr(scan_repair, "SPAN", 2)
    body = lambda *n: "\n".join(x for k in n for x in ("so it goes", f"- {k} -", "and ends"))
    known = {0: (5, 6), 3: (200, 201), 7: (400, 401)}
    numbers = {1: (90,), 2: (120, 3), 4: (300, 302), 5: (500,), 6: (399,)}
    rows = [chunk(k, body(*n)) for k, n in numbers.items()]
    rows += [chunk(k, "text", page_start=a, page_end=b) for k, (a, b) in known.items()]
    rows.append(chunk(50, body(10, 12, 11, 11, 12, 14), doc="e", page_start=10, page_end=12))
    rows.append(chunk(60, body(7, 2, 1), doc="f"))  # no page is known: 2 is out of order on both sides
    got = {(r.id, r.line_no) for r in scan_repair.defects(frame(spark, rows)).collect()}
    # 3 is before the pages of chunk 0, 500 and 14 are beyond those known
    assert {g for g in got if g[0] < 50} == {(1, 2), (2, 2), (4, 2), (4, 5), (6, 2)}
    assert {g for g in got if g[0] == 50} == {(50, 2), (50, 8), (50, 11), (50, 14)}
    assert {g for g in got if g[0] == 60} == {(60, 2), (60, 8)}


def test_confusions_are_learned_from_the_corpus(spark):
    words = ["market", "blanket", "locked", "token", "kernel", "socket", "marker", "packet", "looking", "asking"]
    rng = random.Random(2)
    rows = [chunk(k, " ".join(rng.choices(words, k=400))) for k in range(40)]
    seen = [w.replace("k", "lc") for w in words]  # one that no list of this module names
    rows += [chunk(100 + k, f"the {w} stands", doc="s") for k, w in enumerate(seen)]
    rows.append(chunk(200, "the packat stands"))
    found = scan_repair.Defects(frame(spark, rows))
    assert scan_repair.confusions(found.vocabulary) == [("k", "lc")]
    assert {(r.word, r.printed) for r in found.words().collect()} == set(zip(seen, words))


def test_scan_edges(spark, odd_chunks):
    assert scan_repair.defects(odd_chunks).count() == 0
    texts = {r.id: r.text for r in scan_repair.repaired(odd_chunks).collect()}
    assert texts[0] is None and texts[1] == "" and texts[3] == "word"
    assert scan_repair.defects(odd_chunks.where("false")).count() == 0


# ---------------------------------------------------------------- 2


def runs(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:], w[2:]))


def linked_classes(texts):
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {k: runs(t) for k, t in texts.items()}
    for a, b in itertools.combinations(texts, 2):
        u = len(sets[a] | sets[b])
        if u and len(sets[a] & sets[b]) * 5 >= u * 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    out = defaultdict(list)
    for k in texts:
        out[root(k)].append(k)
    return {(a, b) for g in out.values() for a, b in itertools.combinations(sorted(g), 2)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = {}
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        for v in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, len(t) // 9)):
                p = rng.randrange(len(t))
                t[p : p + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
            texts[len(texts)] = " ".join(t)
    texts[len(texts)] = texts[0]
    rows = [chunk(k, t, content=t) for k, t in texts.items()]
    got = {(r.id_a, r.id_b) for r in near_duplicates.case_pairs(frame(spark, rows, clash=True)).collect()}
    assert got == linked_classes(texts)


def test_hot_group_of_near_duplicates(spark):
    """A third of all rows differ by small edits, another by nothing at all."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(400):
        t = list(base)
        t[rng.randrange(120)] = f"x{k}"
        t[rng.randrange(120)] = f"y{k}"
        rows.append(chunk(k, "t", content=" ".join(t)))
    rows += [chunk(1000 + k, "t", content="one exact copy of a text in many rows") for k in range(400)]
    rows += [chunk(5000 + k, "t", content=" ".join(f"z{rng.randrange(10**6)}" for _ in range(50))) for k in range(400)]
    got = near_duplicates.classes(frame(spark, rows)).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.class_id] += 1
    assert sizes[0] == 400 and sizes[1000] == 400 and len(sizes) == 402


def test_stragglers_of_a_star_are_compared(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "STAR_FROM", 2)
    words = [f"c{k}" for k in range(100)]
    texts = {}
    for k in range(12):  # a chain: neighbours are linked, distant ones are not
        texts[k] = " ".join(words[: 100 - 8 * k] + [f"e{j}" for j in range(8 * k)])
    for k in range(5):
        texts[20 + k] = " ".join([f"q{j}" for j in range(60)] + [f"r{k}"])
    found = near_duplicates.Groups(frame(spark, [chunk(k, t, content=t) for k, t in texts.items()]))
    classes = {r.id: r["class"] for r in found.members.collect()}
    got = {(a, b) for a, b in itertools.combinations(sorted(classes), 2) if classes[a] == classes[b]}
    assert got == linked_classes(texts)


@pytest.mark.parametrize("few", [64, 0])
def test_a_crowded_bucket_of_unlinked_texts(spark, monkeypatch, few):
    """Texts that share a form but are not linked do not meet in all pairs."""
    monkeypatch.setattr(near_duplicates, "STAR_FROM", 4)
    monkeypatch.setattr(near_duplicates, "FEW", few)
    tested = []
    likely = near_duplicates._likely
    monkeypatch.setattr(near_duplicates, "_likely", lambda pairs, short: tested.append(pairs.count()) or likely(pairs, short))
    rng = random.Random(3)
    form = [f"f{k}" for k in range(50)]
    texts = {k: " ".join(form + [f"w{rng.randrange(10**6)}" for _ in range(55)]) for k in range(1500)}
    for k in range(0, 200, 2):  # some of them are
        words = texts[k].split()
        words[-1] = "other"
        texts[k + 1] = " ".join(words)
    rows = [chunk(k, t, content=t) for k, t in texts.items()]
    got = {(r.id_a, r.id_b) for r in near_duplicates.case_pairs(frame(spark, rows)).collect()}
    assert got == {(k, k + 1) for k in range(0, 200, 2)}
    assert len(tested) >= 2 and sum(tested) < 0.5 * 1500 * 1499 / 2, tested


def test_near_duplicate_edges(spark, odd_chunks):
    got = {(r.id, r.class_id) for r in near_duplicates.classes(odd_chunks).collect()}
    ids = {k for k in range(len(ODD))} | {50}
    assert {g[0] for g in got} == ids
    assert near_duplicates.case_pairs(odd_chunks.where("false")).count() == 0
    assert near_duplicates.case_pairs(odd_chunks.drop("created_at")).count() >= 0


# ---------------------------------------------------------------- 3


def test_repeated_lines_and_blocks(spark):
    a, b = "All rights in this text are reserved", "Share this page with all your friends"
    rows, documents = [], []
    for k in range(60):
        own = [f"Line {k} says something of its own here {'x' * k}", a.upper() + f" {k}!", b.replace(" ", "  "), "too short"]
        rows.append(chunk(k, "\n".join(own if k < 40 else own[:1]), doc=f"d{k}"))
        documents.append((k, f"d{k}", None, "s", " Toi" if k % 2 else "TOI", "edge " if k % 3 else "EDGE", None))
    rows.append(chunk(99, a, doc="free"))
    documents.append((99, "free", None, "s", "toi", None, None))
    chunks, documents = frame(spark, rows + rows[:1], clash=True), docs(spark, documents)
    got = {(r.id, r.line_no) for r in site_lines.repeated_lines(chunks, documents).collect()}
    assert got == {(k, n) for k in range(40) for n in (2, 3)}
    found = site_lines.Repeated(chunks, documents)
    assert len({r.block for r in found.blocks().collect()}) == 1
    assert {r.weight for r in found.edges().collect()} == {40}
    kept = {r.id: r for r in site_lines.without_repeated_lines(chunks, documents).collect()}
    assert kept[0].kept_content.split("\n")[1] == "too short" and kept[0].lines_removed == 2
    assert kept[99].lines_removed == 0


def test_edges_need_support_to_make_a_block(spark):
    a, b, c = "All rights in this text are reserved", "Share this page with all your friends", "Printed for you from our own site today"
    rows, documents = [], []
    for k in range(100):  # b follows a in 30 documents, c follows b in 6, fewer than a tenth
        lines = [a, b] if k < 30 else [a, "short", b] if k < 40 else [c] if k < 60 else ["nothing here"]
        rows.append(chunk(k, "\n".join(lines + [c] * (k < 6)), doc=f"d{k}"))
        documents.append((k, f"d{k}", None, "s", "toi", "edge", None))
    chunks, documents = frame(spark, rows), docs(spark, documents)
    report = lambda: {(r.lines, r.least, r.most) for r in site_lines.block_report(chunks, documents).collect()}
    assert report() == {(2, 40, 40), (1, 26, 26)}
    found = site_lines.Repeated(chunks, documents, min_share=0.06)
    assert len({r.block for r in found.blocks().collect()}) == 1


def test_repeated_line_edges(spark, odd_chunks, odd_documents):
    assert site_lines.repeated_lines(odd_chunks, odd_documents).count() == 0
    kept = {r.id: r.kept_content for r in site_lines.without_repeated_lines(odd_chunks, odd_documents).collect()}
    assert kept[0] is None and kept[1] == "" and kept[3] == "word"
    assert site_lines.repeated_lines(odd_chunks.where("false"), odd_documents.where("false")).count() == 0


# ---------------------------------------------------------------- 4


def exact_mutual(ids, vectors, models, k, least):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = set()
    for i in range(len(ids)):
        s = np.round(u @ u[i], 12)
        rows = [j for j in range(len(ids)) if j != i and models[j] == models[i] and s[j] >= least]
        rows.sort(key=lambda j: (-s[j], ids[j]))
        near |= {(ids[i], ids[j]) for j in rows[:k]}
    return {(a, b) for a, b in near if a < b and (b, a) in near}


def test_vector_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 64))
    v = np.concatenate([centres + rng.normal(size=(300, 64)) * rng.uniform(0.02, 0.25, (300, 1)) for _ in range(4)])
    v = np.concatenate([v, v[:5], v[:2] * 3]).astype(np.float32)
    models = ["m" if k % 7 else "old" for k in range(len(v))]
    rows = [chunk(k, "t", embedding=v[k].tolist(), embedding_model=models[k]) for k in range(len(v))]
    got = {(r.id_a, r.id_b) for r in vector_neighbours.mutual_pairs(frame(spark, rows, clash=True)).collect()}
    want = exact_mutual(list(range(len(v))), v.astype(np.float64), models, 10, 0.9)
    assert len(want) > 300
    assert len(got & want) / len(want) >= 0.98 and not {p for p in got if p not in want and p[0] == p[1]}
    assert len(got - want) <= 0.02 * len(want)


def test_recall_does_not_depend_on_the_number_of_vectors(spark, monkeypatch):
    # beyond so many vectors keys once took two substrings
    monkeypatch.setattr(vector_neighbours, "ONE_SUBSTRING", 0, raising=False)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 64))
    v = np.concatenate([centres + rng.normal(size=(200, 64)) * 0.25 for _ in range(3)]).astype(np.float32)
    rows = [chunk(k, "t", embedding=v[k].tolist(), embedding_model="m") for k in range(len(v))]
    got = {(r.id_a, r.id_b) for r in vector_neighbours.mutual_pairs(frame(spark, rows)).collect()}
    want = exact_mutual(list(range(len(v))), v.astype(np.float64), ["m"] * len(v), 10, 0.9)
    assert len(want) > 300 and len(got & want) / len(want) >= 0.95


@pytest.mark.parametrize("load", [2048, 0.2])  # the plan of so many vectors, and of as many millions
def test_recall_in_every_band_of_unclustered_vectors(spark, monkeypatch, load):
    monkeypatch.setattr(vector_neighbours, "LOAD", load)
    rng = np.random.default_rng(11)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.normal(size=a.shape)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.901, 0.999, (len(a), 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * other
    v = np.concatenate([a, b, rng.normal(size=(2000, 64))]).astype(np.float32)
    rows = [chunk(k, "t", embedding=v[k].tolist(), embedding_model="m") for k in range(len(v))]
    got = {(r.id_a, r.id_b) for r in vector_neighbours.mutual_pairs(frame(spark, rows)).collect()}
    for low in (0.90, 0.92, 0.94, 0.96, 0.98):
        want = {(k, k + 1500) for k in np.flatnonzero((cosine[:, 0] >= low) & (cosine[:, 0] < low + 0.02))}
        assert len(want) > 200 and len(got & want) >= 0.95 * len(want)


def test_plan_keeps_the_chance_of_a_miss():
    for n in (0, 1, 10**3, 10**6, 10**9, 10**12):
        plan = vector_neighbours.Plan.of(n, 0.9)
        p = np.arccos(0.9) / np.pi
        hit = (1 - p) ** plan.bits + plan.bits * p * (1 - p) ** (plan.bits - 1)
        assert (1 - hit) ** plan.tables <= vector_neighbours.MISS
        assert plan.tables <= plan.rotations * (64 // plan.bits)
        assert 128 * p < plan.radii[0] < 64 and 256 * p < plan.radii[1] < 128


@pytest.mark.parametrize(("name", "value"), [("HOT", 50), ("CROWD", 0.001)])
def test_hot_vectors(spark, monkeypatch, name, value):
    """A third of all vectors are equal, a third nearly so; crowds are searched exactly."""
    monkeypatch.setattr(vector_neighbours, name, value)
    rng = np.random.default_rng(4)
    base, near = rng.normal(size=64), rng.normal(size=64)
    rows = [chunk(k, "t", embedding=base.tolist(), embedding_model="m") for k in range(300)]
    rows += [chunk(1000 + k, "t", embedding=(near + rng.normal(size=64) * 0.05).tolist(), embedding_model="m") for k in range(300)]
    rows += [chunk(5000 + k, "t", embedding=rng.normal(size=64).tolist(), embedding_model="m") for k in range(300)]
    got = vector_neighbours.neighbours(frame(spark, rows)).collect()
    per = defaultdict(list)
    for r in got:
        per[r.id].append((r.place, r.neighbour))
    assert [n for _, n in sorted(per[200])] == list(range(10))
    assert [n for _, n in sorted(per[3])] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    assert all(len(per[1000 + k]) == 10 for k in range(300)) and not any(k >= 5000 for k in per)


def test_vector_edges(spark, odd_chunks):
    bad = [None, [], [1.0], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63]
    rows = [chunk(k, "t", embedding=e, embedding_model="m") for k, e in enumerate(bad)]
    rows += [chunk(10 + k, "t", embedding=[1.0] * 64, embedding_model=m) for k, m in enumerate(("m", "m", None, "o"))]
    rows += [chunk(10, "t", embedding=[1.0] * 64, embedding_model="m"), chunk(20, "t", kind="parent", embedding=[1.0] * 64, embedding_model="m")]
    got = {(r.id_a, r.id_b) for r in vector_neighbours.mutual_pairs(frame(spark, rows)).collect()}
    assert got == {(10, 11)}
    assert vector_neighbours.mutual_pairs(odd_chunks).count() == 0
    assert vector_neighbours.mutual_pairs(odd_chunks.where("false")).count() == 0


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("seed", range(12))
def test_cut(seed):
    rng = random.Random(seed)
    ends = ["", "", "", ".", ",", "\n", ".\n\n"] if seed % 3 else [""]
    text = " ".join(f"w{k}{rng.choice(ends)}" for k in range(rng.randint(900, 9000)))
    pieces = splitting.cut(text)
    words = text.split()
    at = 0
    for n, (a, b, size, shared) in enumerate(pieces):
        own = text[a:b].split()
        assert len(own) == size and splitting.tokens_of_words(size) <= 1200
        assert splitting.tokens_of_words(shared) <= 64 and (shared > 0 or n == 0 or seed % 3)
        assert own == words[at - shared : at - shared + size]
        at += size - shared
        if seed % 3 and n < len(pieces) - 1:
            assert own[-1][-1] == "." or "\n" in text[b : b + 1]
    assert at == len(words)


def test_cut_is_optimal_on_a_small_text():
    text = "a b c d. e f g h i. j k l m n o p."
    pieces = splitting.cut(text, max_tokens=12, overlap_tokens=0)  # nine words
    assert [text[a:b] for a, b, *_ in pieces] == ["a b c d. e f g h i.", "j k l m n o p."]


def test_pieces(spark, odd_chunks):
    got = splitting.split_oversized(odd_chunks, "raw_content").collect()
    assert {r.id for r in got} == {5} and all(r.section_title == "S" and r.piece_tokens <= 1200 for r in got)
    assert sorted(r.piece_no for r in got) == list(range(1, got[0].pieces + 1))
    rows = [chunk(1, "w " * 923), chunk(2, "w " * 924), chunk(2, "w " * 924), chunk(3, "w " * 924, kind="parent")]
    assert [r.id for r in splitting.oversized(frame(spark, rows)).collect()] == [2]
    assert splitting.oversized(odd_chunks.where("false")).count() == 0


# ---------------------------------------------------------------- 6


def test_ids_are_those_of_the_tokenizer(spark, odd_documents):
    tiktoken = pytest.importorskip("tiktoken")
    path = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    tokens = list(ranks)
    texts = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 30))).decode("utf8", "ignore") for _ in range(2000)]
    texts += ["".join(rng.choice("ab é漢\n\t<|>'sre") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a" * 5000, " " * 3000]
    encoder = bpe.encoder(path)
    for t in texts:
        ids = array("i")
        encoder.encode(t, ids)
        assert list(ids) == own.encode_ordinary(t)
    got = {r.doc_id: r.ids for r in bpe.encode_documents(odd_documents).collect()}
    assert got == {k: own.encode_ordinary(t or "") for k, t in enumerate(ODD)}
    assert own.decode(got[3]) == "word"
    assert bpe.encode_documents(odd_documents).count() == len(ODD) + 1
    assert bpe.encode_documents(odd_documents.where("false")).count() == 0


# ---------------------------------------------------------------- 7


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for k in range(60)]
    items += [(60, None), (61, ""), (62, items[0][1])]
    texts = []
    for _ in range(300):
        t = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        w = (rng.choice(items)[1] or "").split()
        n = rng.randint(8, 16)
        start = rng.randint(0, max(0, len(w) - n))
        p = rng.randint(0, len(t))
        texts.append(" ".join(t[:p] + [x.upper() for x in w[start : start + n]] + t[p:]))
    documents = docs(spark, [(k, str(k), t, None, None, None, None) for k, t in enumerate(texts)])
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    grams = lambda t: {tuple(w[p : p + 12]) for w in [(t or "").lower().split()] for p in range(len(w) - 11)}
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if grams(t) & grams(x)}
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(documents, asked).collect()}
    assert got == want and len(want) > 30
    blocks = leakage.overlaps(documents, asked, block_words=100).where("exact_run >= 12")
    assert {(r.doc, r.item_id) for r in blocks.collect()} == want


def test_substitutions_are_tolerated(spark):
    w = [f"p{k}" for k in range(40)]
    t = list(w)
    for k in (9, 20, 31):
        t[k] = "changed"
    documents = docs(spark, [(1, "1", "before " + " ".join(t) + " after", None, None, None, None)])
    items = spark.createDataFrame([(7, " ".join(w))], "item_id bigint, text string")
    row = leakage.overlaps(documents, items).collect()
    assert [(r.item_id, r.words, r.matched, r.exact_run) for r in row] == [(7, 40, 37, 10)]
    assert leakage.leaked(documents, items).count() == 0


def test_leak_edges(spark, odd_documents):
    items = spark.createDataFrame([(1, "a b " * 20), (2, None), (None, "a b " * 20)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked(odd_documents, items).collect()} == {(5, 1)}
    assert leakage.leaked(odd_documents, items.where("false")).count() == 0
    assert leakage.leaked(odd_documents.where("false"), items).count() == 0


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("A sentence.", "closed"), ("He said so!\"", "closed"), ("Ends in the mid", "open"), ("one, two,", "open"),
        ("- Restore the tier (6)", "closed"), ("- Restore the ti", "open"), ("| a | b |\n| 1 | 2 |", "closed"),
        ("| a | b |\n| 1 |", "open"), ("| a | b |\n| 1 | 2", "open"), ("```\nx\n```", "closed"), ("```\nx", "open"),
        ("A text…", "sign"), ("A text...", "sign"), ("cut [truncated]", "sign"), ("## Head", "open"),
        ("sent to 198.51.100.7.", "closed"), ("sent to 198.51.100.", "open"), ("Slots:\n12\n13", "maybe"),
        ("中文。", "closed"), ("*A line.*", "closed"),
    ],
)
def test_endings(text, kind):
    assert truncation.ending(text)[0] == kind


def sentence(rng, n):
    s = ""
    while len(s) < n:
        s += " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(9)) + ". "
    return s


def test_limits_and_cuts(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for k in range(1500):
        whole = sentence(rng, rng.randint(200, 3000)).strip()
        source = "capped" if k % 3 else "free"
        if source == "capped" and len(whole) > 1000:
            text = whole[:999] + "…" if k % 2 else whole[:1000]
            if k % 2 or not text.rstrip().endswith("."):
                want.add(k)
        elif k % 50 == 0:
            text = whole.rstrip(".") + "gh"  # ends inside a word of its own
            want.add(k)
        elif k % 7 == 0:
            text = whole + "\nLike what you read about this page? Pass the word along"
        elif k % 11 == 0:
            text = whole + " The others follow the same rule, and so on..."
        else:
            text = whole
        rows.append((k, str(k), text, source, None, None, None))
    documents = docs(spark, rows)
    got = {r.doc_id for r in truncation.cut_documents(documents).collect()}
    assert len(want ^ got) <= 0.01 * len(want), (want - got, got - want)
    report = {r.source: r for r in truncation.source_report(documents).collect()}
    assert report["capped"].cut_at_limit > 400 and report["free"].cut_at_limit == 0


def test_copies_and_versions_do_not_acquit_each_other(spark):
    rng = random.Random(12)
    set_line = "\nLike what you read about this page? Pass the word along"
    base = sentence(rng, 1500).split()
    texts, want = [], set()
    for k in range(600):
        if k % 3 == 0:  # versions of one text, cut at the same place
            own = list(base)
            for _ in range(8):
                own[rng.randrange(len(own))] = "v" * rng.randint(1, 12)
            text = " ".join(own) + "\nAn own start of the text. Once the whole queue is empt"
        elif k % 10 == 1:  # exact copies
            text = "An own start of the text. Once the other queue is empt"
        elif k % 60 == 2:  # cut inside the set line
            text = sentence(rng, rng.randint(200, 900)) + set_line[: -2 - k // 60 % 3]
        else:
            text = sentence(rng, rng.randint(200, 900)).strip() + (set_line if k % 2 else "")
        if text.endswith("empt") or k % 60 == 2:
            want.add(k)
        texts.append((k, str(k), text, "s", None, None, None))
    got = {r.doc_id for r in truncation.cut_documents(docs(spark, texts)).collect()}
    assert got == want


def test_hazards_weigh_the_texts_that_reach_a_length(spark):
    """Twelve ends at one length are a limit where thousands go on, not where few are left."""
    rng = random.Random(4)
    lengths = {"many": [rng.randint(900, 9000) for _ in range(4000)] + [1000] * 12}
    lengths["few"] = [rng.randint(10, 890) for _ in range(4000)] + [*range(951, 1050)] * 6 + [1000] * 6
    rows = [(s, n, n) for s, ns in lengths.items() for n in ns]
    ends = spark.createDataFrame(rows, "source string, chars bigint, bytes bigint")
    cells = {(r.source, r.length): r for r in truncation.hazards(ends).where("unit = 'chars'").collect()}
    for source, ns in lengths.items():
        for at in rng.sample(sorted(set(ns)), 40) + [1000]:
            around = [x for x in range(max(1, at - truncation.NEIGHBOURS), at + truncation.NEIGHBOURS + 1) if x != at]
            ended = sum(x in around for x in ns)
            reached = sum(n >= at for n in ns)
            risk = sum(n >= x for x in around for n in ns if n >= around[0])
            got = cells[source, at]
            assert got.texts == ns.count(at) and got.reached == reached
            assert got.expected == pytest.approx(reached * (ended + 1) / max(risk, 1))
    found = {(r.source, r.length) for r in truncation.limits(ends).where("unit = 'chars'").collect()}
    assert cells["many", 1000].texts <= cells["few", 1000].texts + 2
    assert ("many", 1000) in found and ("few", 1000) not in found


def test_truncation_edges(spark, odd_documents):
    got = {r.doc_id for r in truncation.judged(odd_documents).collect()}
    assert got == {3, 4, 5, 6}
    assert truncation.cut_documents(odd_documents.where("false")).count() == 0
    assert truncation.source_report(odd_documents.where("false")).count() == 0


def test_queries_run(spark):
    import os

    from corpusmill.llm.queries import ORACLE, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    assert set(ORACLE) <= set(QUERIES)
    columns = {
        "p1_found": ["id", "line_no", "defect"], "p2_found": ["id_a", "id_b"], "p3_found": ["id", "line_no"],
        "p4_found": ["id_a", "id_b"], "p5_found": ["id"], "p6_ids": ["doc_id", "ids"],
        "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
    }
    for name, f in QUERIES.items():
        df = f(spark, folder)
        assert df.columns == columns.get(name, df.columns)
        assert df.count() >= 0
