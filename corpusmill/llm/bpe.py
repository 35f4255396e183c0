"""Encoding of whole texts with a public byte-level BPE vocabulary.

The vocabulary's byte strings are mapped to Latin-1, so that one Aho-Corasick
automaton over characters works on bytes. A piece of text is encoded by taking
the longest token at each position and backtracking: a token is kept only if
it is compatible with its left neighbour, that is, if merging their bytes in
rank order would give exactly these two tokens. Compatibility is memoised, and
positions that proved dead are never entered again, which bounds the work by
the length of the piece times the longest token.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed value: the public pattern that splits text before merges of this vocabulary.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Pieces remembered per worker; the memo is emptied when it is full.
MEMO_PIECES = 400_000
#: Longest piece that is worth remembering, in characters.
MEMO_LENGTH = 64


def default_vocabulary() -> str:
    """Path of byte_bpe_50k, from ``TOKENIZER_DIR`` or the installed package."""
    folder = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
    if not os.path.isdir(folder):
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else folder
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


class Encoder:
    """Exact byte-pair encoding by backtracking over longest matches."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        self.rank: dict[str, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.split = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, (rank, len(token)))
        self.automaton.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._learn_halves()

    def _learn_halves(self) -> None:
        """The two tokens that each token is merged from, in rank order."""
        rank = self.rank
        for token, r in sorted(rank.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[r] = (r, r)
                continue
            for cut in range(len(token) - 1, 0, -1):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if (
                    left is not None
                    and right is not None
                    and left < r
                    and right < r
                    and self._fits(left, right)
                ):
                    self.merged[(left, right)] = r
                    self.halves[r] = (left, right)
                    break
            else:
                self.halves[r] = (r, r)
        self.compatible.clear()  # judged while merges were still missing

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both in rank order ends at the two.

        Undoes the later of the two merges step by step; if at any step the
        tokens that meet at the border would have merged earlier than what has
        been undone, the border would not have survived.
        """
        merged, halves = self.merged, self.halves
        bound = 1 << 60
        while True:
            joint = merged.get((left, right))
            if joint is not None and joint < bound:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    inner = halves[left][1]
                    if inner != left:
                        bound, left = left, inner
                        break
                else:
                    inner = halves[right][0]
                    if inner != right:
                        bound, right = right + 1, inner
                        break
                undo_left = not undo_left
            else:
                return True

    def _pair(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        """Token ids of one piece, given as Latin-1 of its UTF-8 bytes."""
        whole = self.rank.get(text)
        if whole is not None:
            return (whole,)
        n = len(text)
        # choices[p]: tokens that start at p, longest last
        choices: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, found in self.automaton.iter(text):
            r, length = found
            choices[last - length + 1].append((r, length))
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        starts: list[int] = []
        tried: list[int] = [len(choices[0])]
        p = 0
        while p < n:
            k = tried[-1] - 1
            before = out[-1] if out else -1
            options = choices[p]
            while k >= 0:
                r, length = options[k]
                if alive[p + length] and (before < 0 or self._pair(before, r)):
                    break
                k -= 1
            if k >= 0:
                tried[-1] = k
                out.append(r)
                starts.append(p)
                p += length
                if p < n:
                    tried.append(len(choices[p]))
            else:
                alive[p] = 0
                tried.pop()
                p = starts.pop()
                out.pop()
        return tuple(out)

    def encode(self, text: str | None, into: array) -> int:
        """Append the ids of ``text`` to ``into``; how many they are."""
        if not text:
            return 0
        before = len(into)
        memo, piece = self.pieces, self.piece
        for part in self.split(text):
            ids = memo.get(part)
            if ids is None:
                ids = piece(part.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(part) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[part] = ids
            into.extend(ids)
        return len(into) - before


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of ``path``, built once per process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """``(key, ids)`` of every row, whole texts, without a shuffle.

    Null and empty texts both give an empty list, blank ones are encoded like
    any other; strings that look like special tokens are ordinary text.
    Repeated rows each give their row, a null key stays null, an empty table
    gives an empty one. Only ``key`` and ``text`` are read. The vocabulary is a
    file of fixed size that each worker reads by path.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, offsets = array("i"), array("i", [0])
            for value in batch.column(1).to_pylist():
                enc.encode(value, ids)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(
                pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(ids), pa.int32())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])

    narrow = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")
