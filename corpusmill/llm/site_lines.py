"""Lines that one source repeats over its documents.

Lines are the nodes of a graph per source, weighted by the number of
documents; consecutive lines of a chunk are its edges. Nodes and edges of high
support are kept, connected components of what remains are the boilerplate
blocks, and every occurrence of a block's lines is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import leaf_chunks
from corpusmill.operators.components import connected_components
from corpusmill.session import materialise

MIN_DOCUMENTS = 5
MIN_SHARE = 0.1
MIN_WORDS = 6


def source_name(category: Column, product: Column) -> Column:
    """One source: category and product without case and outer spaces.

    Null where the product is null or blank; a null category is a source of
    its own name, the empty one.
    """
    clean = lambda c: F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    product = clean(product)
    return F.when(
        product.isNotNull() & (product != ""),
        F.concat_ws("\u0001", F.coalesce(clean(category), F.lit("")), product),
    )


def _lines(leaves: DataFrame) -> DataFrame:
    """Lines of at least MIN_WORDS words with the hash of their letters.

    Two 64-bit hashes stand for the lower-case letters of the line, so case,
    spacing, punctuation and digits make no difference.
    """
    letters = F.regexp_replace(F.lower("line"), r"[^\p{L}]+", " ")
    return (
        leaves.where("raw_content is not null")
        .select("id", "document_id", F.posexplode(F.split("raw_content", "\n")).alias("pos", "line"))
        .select("id", "document_id", "pos", F.trim(letters).alias("letters"))
        .where(F.size(F.split("letters", " ")) >= MIN_WORDS)
        .withColumn("letters", F.replace(F.col("letters"), F.lit(" "), F.lit("")))
        .select(
            "id",
            "document_id",
            (F.col("pos") + 1).alias("line_no"),
            F.xxhash64("letters").alias("h1"),
            F.xxhash64(F.lit(1), "letters").alias("h2"),
        )
    )


class Repeated:
    """The repeated lines of a corpus: nodes, occurrences, edges and blocks.

    Chunks without document or documents without product belong to no source
    and have none; null and empty texts have no lines; re-delivered chunks
    count once; a document counts once per line however often it holds it;
    empty tables give empty results. All counts cover all documents. Counts
    run over distinct (document, line) pairs and combine before the shuffle,
    so neither a source with a third of the rows nor one very long document
    gathers its rows in a task.
    """

    def __init__(
        self,
        chunks: DataFrame,
        documents: DataFrame,
        min_documents: int = MIN_DOCUMENTS,
        min_share: float = MIN_SHARE,
    ):
        self.leaves = leaf_chunks(chunks, "document_id", "raw_content").where(
            "document_id is not null"
        )
        self.lines = materialise(_lines(self.leaves), "p3-lines")
        sources = (
            documents.select(
                F.col("id").alias("document_id"),
                source_name(F.col("category"), F.col("product")).alias("source"),
            )
            .where("document_id is not null and source is not null")
            .groupBy("document_id")
            .agg(F.min("source").alias("source"))
        )
        with_leaves = (
            chunks.where("chunk_kind = 'leaf' and id is not null and document_id is not null")
            .select("document_id")
            .distinct()
            .join(sources, "document_id")
        )
        self.sources = materialise(with_leaves, "p3-sources")
        per_source = self.sources.groupBy("source").agg(F.count("*").alias("documents"))
        held = self.lines.select("document_id", "h1", "h2").distinct()
        often = (
            held.groupBy("h1", "h2")
            .agg(F.count("*").alias("all_documents"))
            .where(F.col("all_documents") >= min_documents)
        )
        pairs = held.join(often, ["h1", "h2"]).join(self.sources, "document_id")
        self.pairs = materialise(pairs, "p3-pairs")
        counted = self.pairs.groupBy("source", "h1", "h2").agg(
            F.count("*").alias("weight"), F.first("all_documents").alias("all_documents")
        )
        self.nodes = materialise(
            counted.join(per_source, "source").where(
                F.col("weight") >= F.col("documents") * min_share
            ),
            "p3-nodes",
        )
        self.min_documents, self.min_share = min_documents, min_share

    def occurrences(self) -> DataFrame:
        """``(id, line_no, source, h1, h2)`` of every line of every block."""
        hot = self.pairs.join(self.nodes.select("source", "h1", "h2"), ["source", "h1", "h2"])
        return self.lines.join(
            hot.select("document_id", "h1", "h2", "source"), ["document_id", "h1", "h2"]
        ).select("id", "document_id", "line_no", "source", "h1", "h2")

    def edges(self) -> DataFrame:
        """Consecutive repeated lines with the number of documents they share.

        ``step`` counts lines, blank and short ones included, so only direct
        neighbours form an edge.
        """
        at = self.occurrences()
        nxt = at.select(
            "id",
            (F.col("line_no") - 1).alias("line_no"),
            F.col("h1").alias("n1"),
            F.col("h2").alias("n2"),
        )
        return (
            at.join(nxt, ["id", "line_no"])
            .select("source", "h1", "h2", "n1", "n2", "document_id")
            .distinct()
            .groupBy("source", "h1", "h2", "n1", "n2")
            .agg(F.count("*").alias("weight"))
        )

    def blocks(self) -> DataFrame:
        """``(source, h1, h2, weight, documents, block)``: each node's block.

        An edge needs the support a line needs, in documents and as a share of
        its source; a line without such an edge is a block of its own.
        """
        name = lambda a, b: F.xxhash64("source", a, b)
        size = self.nodes.select("source", "documents").distinct()
        strong = self.edges().join(size, "source").where(
            (F.col("weight") >= self.min_documents)
            & (F.col("weight") >= F.col("documents") * self.min_share)
        )
        linked = connected_components(
            strong.select(name("h1", "h2").alias("a"), name("n1", "n2").alias("b"))
        )
        nodes = self.nodes.withColumn("node", name("h1", "h2"))
        return nodes.join(linked, "node", "left").select(
            "source",
            "h1",
            "h2",
            "weight",
            "documents",
            F.coalesce("component", "node").alias("block"),
        )


def repeated_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(id, line_no)`` of every line to delete: the lines of all blocks."""
    found = Repeated(chunks, documents)
    blocks = found.blocks().select("source", "h1", "h2")
    return (
        found.occurrences()
        .join(blocks, ["source", "h1", "h2"], "left_semi")
        .select("id", "line_no")
    )


def block_report(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(source, block, lines, least, most)`` of every block: how many lines it
    has, and in how many documents of its source the rarest and the commonest
    of them stand."""
    return (
        Repeated(chunks, documents)
        .blocks()
        .groupBy("source", "block")
        .agg(
            F.count("*").alias("lines"), F.min("weight").alias("least"), F.max("weight").alias("most")
        )
    )


def without_repeated_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``(id, document_id, kept_content, lines_removed)`` of every leaf chunk.

    A null text stays null; a chunk that consists of repeated lines only comes
    out empty.
    """
    leaves = leaf_chunks(chunks, "document_id", "raw_content")
    gone = (
        repeated_lines(chunks, documents)
        .groupBy("id")
        .agg(F.collect_set("line_no").alias("gone"))
    )
    kept = F.expr(
        "filter(split(raw_content, '\n'), (x, i) -> gone is null or not array_contains(gone, i + 1))"
    )
    return leaves.join(gone, "id", "left").select(
        "id",
        "document_id",
        F.when(F.col("raw_content").isNotNull(), F.array_join(kept, "\n")).alias("kept_content"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"),
    )
