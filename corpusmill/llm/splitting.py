"""Cutting oversized chunks at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.common import leaf_chunks

MAX_TOKENS = 1200
OVERLAP_TOKENS = 64
#: Penalty of a cut after a paragraph, a line, a sentence, a clause, any word.
PENALTY = (0.0, 0.15, 0.25, 0.7, 3.0)
#: Weight of a piece's squared relative distance from the even size.
IMBALANCE = 0.5
_TOKEN = re.compile(r"\S+")


def tokens_of_words(words: int) -> int:
    """1.3 tokens a word, rounded up, in integers."""
    return (13 * words + 9) // 10


def words_within(tokens: int) -> int:
    """The most words that hold at most ``tokens`` tokens."""
    return tokens * 10 // 13


def _cut_levels(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Kind of the boundary after each word, as an index into PENALTY."""
    levels = np.full(len(spans), 4, np.int8)
    for k in range(len(spans) - 1):
        gap = text[spans[k][1] : spans[k + 1][0]]
        last = text[spans[k][1] - 1]
        lines = gap.count("\n")
        if lines > 1:
            levels[k] = 0
        elif last in ".!?。！？…":
            levels[k] = 2
        elif lines == 1:
            levels[k] = 1
        elif last in ",;:)":
            levels[k] = 3
    if len(spans):
        levels[-1] = 0
    return levels


def cut(
    text: str, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS
) -> list[tuple[int, int, int, int]]:
    """Pieces of ``text`` as (start char, end char, words, words shared with
    the piece before).

    Minimises the sum of cut penalties and size imbalance over all ways to cut
    at the boundaries, every piece within ``max_tokens``, overlap included. The
    overlap is the longest run of whole sentences or lines within
    ``overlap_tokens``, else the full number of words. Where no natural
    boundary lies within the reach of a piece, words are boundaries, so a
    solution always exists; a single run without white space is one word.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n, most = len(spans), words_within(max_tokens)
    if not n:
        return []
    if n <= most:
        return [(0, len(text), n, 0)]
    levels = _cut_levels(text, spans)
    shared_most = min(words_within(overlap_tokens), most - 1)
    natural = np.flatnonzero(levels <= 2) + 1
    ends: list[int] = []
    # candidate cut positions: natural ones, and words where these are too far apart
    previous = 0
    for e in [*natural.tolist(), n]:
        if e - previous > most - shared_most:
            ends.extend(range(previous + 1, e))
        if not ends or ends[-1] != e:
            ends.append(e)
        previous = e
    ends_a = np.array(sorted(set(ends)))

    def shared(at: int) -> int:
        """Words before cut ``at`` that the next piece repeats."""
        lo = np.searchsorted(natural, at - shared_most)
        first = natural[lo] if lo < len(natural) and natural[lo] < at else at - shared_most
        return int(at - max(0, first))

    pieces = -(-n // (most - shared_most))
    even = n / pieces
    cost = np.full(len(ends_a), np.inf)
    origin = np.full(len(ends_a), -1)
    penalties = np.array(PENALTY)[levels[ends_a - 1]]
    overlap = np.array([shared(int(e)) for e in ends_a])
    for j, e in enumerate(ends_a):
        reach = np.searchsorted(ends_a, e - most)
        sizes = e - ends_a[reach:j]
        options = np.where(
            sizes + overlap[reach:j] <= most,
            cost[reach:j] + IMBALANCE * ((sizes - even) / even) ** 2,
            np.inf,
        )
        best = int(np.argmin(options)) if len(options) else -1
        if e <= most:
            first = IMBALANCE * ((e - even) / even) ** 2
            if best < 0 or first <= options[best]:
                cost[j], origin[j] = first + penalties[j], -1
                continue
        if best >= 0 and np.isfinite(options[best]):
            cost[j], origin[j] = options[best] + penalties[j], reach + best
    chain, j = [], len(ends_a) - 1
    while j >= 0:
        chain.append(j)
        j = int(origin[j])
    out, start, common = [], 0, 0
    for j in reversed(chain):
        e = int(ends_a[j])
        first = start - common
        a = 0 if first == 0 else spans[first][0]
        b = len(text) if e == n else spans[e - 1][1]
        out.append((a, b, e - first, common))
        start, common = e, int(overlap[j])
    return out


def split_oversized(
    chunks: DataFrame,
    text: str = "content",
    max_tokens: int = MAX_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Pieces of the leaf chunks whose ``text`` has more than ``max_tokens``.

    Columns: id, document_id, section_title, parent_chunk_id, piece_no (from
    1), pieces, piece, piece_tokens, overlap_tokens. ``token_count`` is not
    trusted. Null, empty and short texts give no rows, re-delivered chunks
    count once, an empty table gives an empty one. A text is cut inside one
    row's task, whole.
    """
    leaves = leaf_chunks(
        chunks.where(F.length(text) > 2 * words_within(max_tokens)),
        "document_id",
        "section_title",
        "parent_chunk_id",
        text,
    )
    schema = (
        "id bigint, document_id string, section_title string, parent_chunk_id bigint, "
        "piece_no int, pieces int, piece string, piece_tokens int, overlap_tokens int"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows, parts = [], []
            for k, value in enumerate(batch.column(4).to_pylist()):
                if len(value.split()) <= words_within(max_tokens):
                    continue
                pieces = cut(value, max_tokens, overlap_tokens)
                for no, (a, b, words, common) in enumerate(pieces, 1):
                    rows.append(k)
                    parts.append(
                        (no, len(pieces), value[a:b], tokens_of_words(words), tokens_of_words(common))
                    )
            at = pa.array(rows, pa.int32())
            columns = list(zip(*parts)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in range(4)]
                + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names,
            )

    return leaves.mapInArrow(run, schema)


def oversized(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``id`` of the leaf chunks that the operator cuts by their body."""
    return split_oversized(chunks, "raw_content", max_tokens).where("piece_no = 1").select("id")
