"""Passages of evaluation items inside a training corpus, by spaced seeds.

A seed is a mask over consecutive words; only the words at its set positions
are hashed, so a hit survives substitutions at the others. Hashes of the items
and of the documents are joined; around each hit the overlap is verified on
the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.session import materialise

#: Masks of at most MIN_RUN words: a run of MIN_RUN equal words hits each of them.
MASKS = ("110101101011", "11101001011")
MIN_RUN = 12
#: Most item words that one broadcast index may hold (about 60 bytes each);
#: longer item tables are processed in blocks of this many words.
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc key, item_id bigint, doc_pos int, item_pos int, words int, matched int, exact_run int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Index:
    """Seed hashes of a block of items, for use inside workers."""

    def __init__(self, items: list[tuple[int, list[str]]], masks=MASKS, min_run=MIN_RUN):
        self.items = [(i, w) for i, w in items if len(w) >= min_run]
        self.masks = [np.flatnonzero([c == "1" for c in m]) for m in masks]
        self.spans = [len(m) for m in masks]
        self.min_run = min_run
        names = sorted({w for _, ws in self.items for w in ws})
        self.code = {w: n + 1 for n, w in enumerate(names)}
        self.arrays = [np.array([self.code[w] for w in ws], np.uint64) for _, ws in self.items]
        self.keys, self.places = [], []
        for m, span in zip(self.masks, self.spans):
            parts, where = [], []
            for k, a in enumerate(self.arrays):
                h = self.hashes(a, m, span)
                parts.append(h)
                where.append(np.stack([np.full(len(h), k), np.arange(len(h))], 1))
            key = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            place = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.places.append(place[order])

    @staticmethod
    def hashes(codes: np.ndarray, mask: np.ndarray, span: int) -> np.ndarray:
        n = len(codes) - span + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for at in mask:
                h = (h ^ codes[at : at + n]) * _MUL
                h ^= h >> np.uint64(29)
        return h

    def hits(self, codes: np.ndarray) -> set[tuple[int, int, int]]:
        """(item, diagonal, a document position on it) of every seed hit.

        One position per diagonal and mask suffices where hits are adjacent;
        others are kept, so that no overlap on the same diagonal is lost.
        """
        found = set()
        for m, span, key, place in zip(self.masks, self.spans, self.keys, self.places):
            n = len(codes) - span + 1
            if n <= 0 or not len(key):
                continue
            live = np.ones(n, bool)
            for at in m:  # words that no item has cannot be part of a hit
                live &= codes[at : at + n] != 0
            if not live.any():
                continue
            h = self.hashes(codes, m, span)
            at = np.searchsorted(key, h)
            live &= key[np.minimum(at, len(key) - 1)] == h
            for p in np.flatnonzero(live):
                j = at[p]
                while j < len(key) and key[j] == h[p]:
                    k, q = place[j]
                    found.add((int(k), int(p) - int(q), int(p)))
                    j += 1
        return found

    def overlaps(self, words: list[str], tolerance: int) -> Iterator[tuple]:
        """Verified overlaps of one document: the maximal stretches on each
        diagonal with at most ``tolerance`` substitutions between two equal
        words, as (item, doc_pos, item_pos, words, matched, exact_run)."""
        code = self.code.get
        codes = np.fromiter((code(w, 0) for w in words), np.uint64, len(words))
        done: dict[tuple[int, int], int] = {}
        for k, diagonal, p in sorted(self.hits(codes)):
            if done.get((k, diagonal), -1) >= p:
                continue
            item = self.arrays[k]
            lo = max(0, diagonal)
            hi = min(len(codes), diagonal + len(item))
            same = codes[lo:hi] == item[lo - diagonal : hi - diagonal]
            left = right = p - lo
            while left > 0:  # skip up to `tolerance` substitutions, then need an equal word
                step = next((d for d in range(1, tolerance + 2) if left >= d and same[left - d]), 0)
                if not step:
                    break
                left -= step
            end = len(same)
            while right + 1 < end:
                step = next(
                    (d for d in range(1, tolerance + 2) if right + d < end and same[right + d]), 0
                )
                if not step:
                    break
                right += step
            span = same[left : right + 1]
            run = best = 0
            for ok in span:
                run = run + 1 if ok else 0
                best = max(best, run)
            done[(k, diagonal)] = lo + right
            yield (
                self.items[k][0], lo + left, lo + left - diagonal,
                len(span), int(span.sum()), best,
            )


def overlaps(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    tolerance: int = 2,
    min_matched: int = MIN_RUN,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every overlap of at least ``min_matched`` equal words of a document with
    an item, where up to ``tolerance`` words in a row may be substituted.

    Columns: doc, item_id, doc_pos, item_pos, words (length of the overlap),
    matched (equal words in it), exact_run (longest run without substitution).
    Every overlap with a run of MIN_RUN equal words is found, as each mask
    hits inside it; others are found where a mask fits between substitutions.

    The items are the held-out side. Their seeds are sent to the workers in
    blocks of at most ``block_words`` words, one pass over the corpus per
    block, so what is broadcast is bounded whatever their number; the corpus
    is never shuffled. Null, blank and short items have no overlaps; items that
    repeat a passage are each reported; null and empty documents give no rows;
    empty tables give an empty result; repeated documents each give their rows.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(
        "text is not null"
    )
    kind = source.schema["doc"].dataType.simpleString()
    schema = FOUND.replace("doc key", f"doc {kind}")
    out: DataFrame | None = None
    block: list[tuple[int, list[str]]] = []
    size = 0

    def scan(batch_items: list[tuple[int, list[str]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(batch_items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for batch in batches:
                docs, rows = [], []
                for n, value in enumerate(batch.column(1).to_pylist()):
                    for row in index.overlaps(words_of(value), tolerance):
                        if row[4] >= min_matched:
                            docs.append(n)
                            rows.append(row)
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(docs, pa.int32())),
                        pa.array(columns[0], pa.int64()),
                        *(pa.array(c, pa.int32()) for c in columns[1:]),
                    ],
                    ["doc", "item_id", "doc_pos", "item_pos", "words", "matched", "exact_run"],
                )

        return source.mapInArrow(run, schema)

    wanted = items.select(
        F.col(item_key).cast("bigint").alias("item_id"), F.col(item_text).alias("text")
    ).where("item_id is not null and text is not null")
    passes = 0
    for row in wanted.distinct().orderBy("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if len(words) < MIN_RUN:
            continue
        if block and size + len(words) > block_words:
            out = scan(block) if out is None else out.unionByName(scan(block))
            block, size, passes = [], 0, passes + 1
            if passes % 16 == 0:  # many blocks: keep the plan short
                out = materialise(out, "p7-overlaps")
        block.append((row["item_id"], words))
        size += len(words)
    if block or out is None:
        out = scan(block) if out is None else out.unionByName(scan(block))
    return out


def leaked(documents: DataFrame, items: DataFrame, run: int = MIN_RUN) -> DataFrame:
    """``(doc_id, item_id)`` of documents with ``run`` consecutive item words."""
    return (
        overlaps(documents, items)
        .where(F.col("exact_run") >= run)
        .select(F.col("doc").alias("doc_id"), "item_id")
        .distinct()
    )


def item_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item that leaked: documents, and the largest overlap."""
    return (
        overlaps(documents, items)
        .groupBy("item_id")
        .agg(
            F.countDistinct("doc").alias("documents"),
            F.max("matched").alias("most_words"),
            F.max("exact_run").alias("longest_run"),
        )
    )
