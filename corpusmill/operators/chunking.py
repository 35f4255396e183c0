"""Sections to parent and leaf chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions.text import approx_tokens, prefixed, trim_all, words, words_of_tokens

#: Fixed value: what stands between the head and the tail of a shortened parent.
CONTINUES = "\n\n[…section continues…]\n\n"


@dataclass(frozen=True)
class ChunkOptions:
    target_tokens: int = 512
    max_tokens: int = 1200
    overlap_tokens: int = 64
    min_tokens: int = 40
    parent_max_tokens: int = 2048
    parent_head_tokens: int = 1792
    parent_tail_tokens: int = 256

    def __post_init__(self) -> None:
        if not 0 <= self.min_tokens <= self.target_tokens <= self.max_tokens:
            raise ValueError("tokens must satisfy min <= target <= max")
        if not 0 <= self.overlap_tokens < self.target_tokens:
            raise ValueError("overlap must be smaller than the target")

    @property
    def window(self) -> int:
        return words_of_tokens(self.target_tokens)

    @property
    def step(self) -> int:
        return max(1, self.window - words_of_tokens(self.overlap_tokens))


def parent_text(body: Column, opt: ChunkOptions = ChunkOptions()) -> Column:
    """The body, or its head and tail where it exceeds the parent's limit."""
    w = words(body)
    head, tail = words_of_tokens(opt.parent_head_tokens), words_of_tokens(opt.parent_tail_tokens)
    short = (approx_tokens(F.size(w)) <= opt.parent_max_tokens) | (F.size(w) <= head + tail)
    cut = F.concat(
        F.array_join(F.slice(w, 1, head), " "),
        F.lit(CONTINUES),
        F.array_join(F.slice(w, -tail, tail), " "),
    )
    return F.when(short, body).otherwise(cut)


def leaf_texts(body: Column, opt: ChunkOptions = ChunkOptions()) -> Column:
    """Leaf bodies with their tokens: array of struct<body, tokens>.

    A body within the limit is one leaf, verbatim. A longer one is cut into
    overlapping windows of words; neighbours below ``min_tokens`` are then
    merged into the piece before, in one fold.
    """
    w = words(body)
    n = F.size(w)
    last = F.greatest(F.ceil((n - opt.window) / opt.step), F.lit(0)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.slice(w, k * opt.step + 1, opt.window),
    )
    pieces = F.transform(
        windows,
        lambda p: F.struct(F.array_join(p, " ").alias("body"), approx_tokens(F.size(p)).alias("tokens")),
    )

    def merge(done: Column, piece: Column) -> Column:
        end = F.element_at(done, -1)
        grown = F.struct(
            F.concat(end.body, F.lit("\n\n"), piece.body).alias("body"),
            (end.tokens + piece.tokens).alias("tokens"),
        )
        tiny = (F.size(done) > 0) & (piece.tokens < opt.min_tokens)
        return F.when(
            tiny, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))
        ).otherwise(F.concat(done, F.array(piece)))

    merged = F.aggregate(pieces, F.array().cast("array<struct<body:string,tokens:int>>"), merge)
    one = F.array(F.struct(body.alias("body"), approx_tokens(n).alias("tokens")))
    return F.when(approx_tokens(n) <= opt.max_tokens, one).otherwise(merged)


def chunk_documents(
    documents: DataFrame,
    id_column: str = "document_id",
    title_column: str = "title",
    sections: str = "sections",
    opt: ChunkOptions = ChunkOptions(),
) -> DataFrame:
    """Chunks of every document, parents first, without a shuffle.

    Numbering is contiguous per document: parents ``0..P-1``, then leaves. Ids
    are hashes of document and number, so a leaf names its parent without
    reading it back and re-ingest keeps every id. Blank sections are skipped;
    documents with null or empty sections give no chunk.
    """
    kept = F.filter(F.col(sections), lambda s: trim_all(s.content) != "")
    per_section = F.transform(
        kept,
        lambda s, k: F.struct(
            s.title.alias("title"),
            s.level.alias("level"),
            s.page_start.alias("page_start"),
            s.page_end.alias("page_end"),
            k.alias("ordinal"),
            parent_text(s.content, opt).alias("parent"),
            leaf_texts(s.content, opt).alias("leaves"),
        ),
    )
    doc = documents.select(
        F.col(id_column).alias("document_id"),
        F.col(title_column).alias("document_title"),
        per_section.alias("s"),
    ).where(F.size("s") > 0)

    def row(s: Column, body: Column, tokens: Column, kind: str) -> list[Column]:
        return [
            body.alias("raw_content"),
            s.title.alias("section_title"),
            s.level.alias("section_level"),
            s.page_start.alias("page_start"),
            s.page_end.alias("page_end"),
            tokens.alias("token_count"),
            F.lit(kind).alias("chunk_kind"),
            s.ordinal.alias("parent_ordinal"),
        ]

    parents = F.transform(
        F.col("s"), lambda s: F.struct(*row(s, s.parent, approx_tokens(F.size(words(s.parent))), "parent"))
    )
    leaves = F.flatten(
        F.transform(
            F.col("s"),
            lambda s: F.transform(s.leaves, lambda x: F.struct(*row(s, x.body, x.tokens, "leaf"))),
        )
    )
    c = F.col("c")
    return doc.select(
        "document_id", "document_title", F.posexplode(F.concat(parents, leaves)).alias("chunk_index", "c")
    ).select(
        F.xxhash64("document_id", "chunk_index").alias("id"),
        "document_id",
        "chunk_index",
        prefixed(
            F.coalesce("document_title", F.lit("")), F.coalesce(c.section_title, F.lit("")), c.raw_content
        ).alias("content"),
        c.raw_content.alias("raw_content"),
        c.section_title.alias("section_title"),
        c.section_level.alias("section_level"),
        c.page_start.alias("page_start"),
        c.page_end.alias("page_end"),
        c.token_count.alias("token_count"),
        F.when(c.chunk_kind == "leaf", F.xxhash64("document_id", c.parent_ordinal)).alias(
            "parent_chunk_id"
        ),
        c.chunk_kind.alias("chunk_kind"),
    )
