"""The registry of named queries and their SQL twins.

Queries run over whole tables. The query set of the searches is either every
leaf chunk whose id is divisible by 50 or all mined queries, whose vector is
that of the chunk they were written from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from corpusmill.functions import text
from corpusmill.functions.analyze import stemmed_tokens
from corpusmill.functions.query import ACRONYMS, OPENINGS, annotated, query_variants
from corpusmill.operators import catalog, dense_index, evaluate, ingest, mining, retrieval, sparse_index
from corpusmill.operators.chunking import ChunkOptions, chunk_documents
from corpusmill.operators.retrieval import SearchOptions
from corpusmill.operators.sections import split_sections, stamp_pages
from corpusmill.session import materialise, scratch
from corpusmill.sources import files
from corpusmill.sources.store import Store
from corpusmill.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs


def once(chunks: DataFrame) -> DataFrame:
    """Re-delivered chunks once, by id, the latest."""
    order = W.partitionBy("id").orderBy(F.col("created_at").desc_nulls_last(), "chunk_index")
    return (
        chunks.where("id is not null")
        .withColumn("_n", F.row_number().over(order))
        .where("_n = 1")
        .drop("_n")
    )


def chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks joined with what the searches need of their documents."""
    facts = table(spark, folder, "documents").select(
        F.col("id").alias("document_id"), "category", "product", "version",
        F.col("title").alias("document_title"), F.col("slug").alias("document_slug"),
    )
    return once(table(spark, folder, "chunks")).join(facts, "document_id")


def mined(spark: SparkSession, folder: str) -> DataFrame:
    """Mined queries once, by id, with the vector of their source chunk.

    Written as a table: both sides of a search and its judgement read it.
    """
    rows = table(spark, folder, "mined_queries").groupBy("query_id").agg(
        F.min("query").alias("text"),
        F.min("source_chunk_id").alias("source_chunk_id"),
        F.min("source_product").alias("expect_product"),
    )
    vectors = once(table(spark, folder, "chunks")).select(
        F.col("id").alias("source_chunk_id"), "embedding"
    )
    none = F.lit(None).cast("string")
    asked = rows.join(vectors, "source_chunk_id", "left")
    return materialise(asked.withColumns({"category": none, "product": none}), "queries")


def held_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaf chunk whose id is divisible by 50, with its vector."""
    return (
        chunk_table(spark, folder)
        .where("chunk_kind = 'leaf' and id % 50 = 0")
        .select(F.col("id").alias("query_id"), "embedding", "category", "product")
    )


def _sides(spark: SparkSession, folder: str, filtered: bool = False) -> tuple:
    chunks, asked = chunk_table(spark, folder), mined(spark, folder)
    if filtered:
        asked = asked.withColumn("product", F.col("expect_product"))
    opt = SearchOptions()
    dense = retrieval.dense_topk(chunks, asked, opt.pool)
    sparse = retrieval.bm25_topk(chunks, asked, opt.pool, text.lower_tokens)
    return chunks, asked, dense, sparse


def _found(spark: SparkSession, folder: str, opt: SearchOptions, filtered: bool = False) -> DataFrame:
    asked = mined(spark, folder)
    if filtered:
        asked = asked.withColumn("product", F.col("expect_product"))
    return retrieval.search(chunk_table(spark, folder), asked, text.lower_tokens, opt)


# ---------------------------------------------------------------- SQL parts

_K = """
    kk as (select * from chunks where id is not null qualify row_number() over (
        partition by id order by created_at desc nulls last, chunk_index) = 1),
    ct as (select kk.*, d.category, d.product, d.version, d.title as document_title,
        d.slug as document_slug from kk join documents d on d.id = kk.document_id),
    vec as (select id, document_id, category, product, embedding::double[] as v from ct
        where chunk_kind = 'leaf' and len(embedding) = 64
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_MQ = """
    mq as (select m.*, kk.embedding from (select query_id, min(query) as text,
        min(source_chunk_id) as source_chunk_id, min(source_product) as expect_product
        from mined_queries group by query_id) m left join kk on kk.id = m.source_chunk_id)"""


def _dense_sql(queries: str, where: str = "true", k: int = 50) -> str:
    return f"""
    qv as (select * from ({queries}) q where len(v) = 64
        and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0
        and len(list_filter(v, lambda x: x <> 0)) > 0),
    dense as (select query_id, chunk_id, cast(rank as int) as rank, score from (
        select query_id, chunk_id, score, row_number() over (partition by query_id
            order by score desc, chunk_id) as rank from (
            select qv.query_id, vec.id as chunk_id,
                round(list_cosine_similarity(qv.v, vec.v), 6) as score
            from qv, vec where {where})) where rank <= {k})"""


def _sparse_sql(where: str = "true", k: int = 50) -> str:
    return f"""
    tok as (select id, chunk_kind, category, product,
        coalesce(regexp_extract_all(lower(content), '[a-z0-9]+'), []) as tokens from ct),
    stats as (select count(*) as n, avg(len(tokens)) as avgdl from tok),
    post as (select id, chunk_kind, category, product, dl, term, count(*) as tf from (
        select id, chunk_kind, category, product, len(tokens) as dl, unnest(tokens) as term
        from tok) group by all),
    freq as (select term, count(*) as df from post group by term),
    qt as (select distinct query_id, expect_product,
        unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from mq),
    sparse as (select query_id, chunk_id, cast(rank as int) as rank, score from (
        select query_id, chunk_id, score, row_number() over (partition by query_id
            order by score desc, chunk_id) as rank from (
            select qt.query_id, post.id as chunk_id, round(sum(
                ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
            from qt join post using (term) join freq using (term), stats
            where chunk_kind = 'leaf' and {where} group by 1, 2) where score > 0)
        where rank <= {k})"""


def _fused_sql(k: int = 60, name: str = "fused") -> str:
    return f"""
    {name} as (select *, row_number() over (partition by query_id order by rrf desc,
        dense_rank nulls last, sparse_rank nulls last) as fused_rank from (
        select query_id, chunk_id, round(sum(1.0::double / ({k} + rank)), 12) as rrf,
            max(rank) filter (side = 'd') as dense_rank,
            max(rank) filter (side = 's') as sparse_rank
        from (select *, 'd' as side from dense union all by name select *, 's' as side from sparse)
        group by 1, 2))"""


_CUT = """
    depth as (select query_id, case when count(*) < 5
        or max(rrf) filter (fused_rank = 1) - max(rrf) filter (fused_rank = 5) > 0.02
        then 30 else 10 end as depth from fused group by 1),
    cut as (select fused.* from fused join depth using (query_id) where fused_rank <= depth)"""
_OWN = "select query_id, embedding::double[] as v, expect_product from mq"
_BASE = f"with {_K}, {_MQ}, {_dense_sql(_OWN)}, {_sparse_sql()}, {_fused_sql()}, {_CUT}"
_FILTERED = (
    f"with {_K}, {_MQ}, "
    + _dense_sql(_OWN, "(qv.expect_product is null or qv.expect_product = vec.product)")
    + ", "
    + _sparse_sql("(qt.expect_product is null or qt.expect_product = post.product)")
    + f", {_fused_sql()}, {_CUT}"
)
_RESULT = """
    select query_id, cast(fused_rank as int) as position, chunk_id, document_id, section_title,
        round(n - fused_rank + 1.0::double, 6) as score
    from (select *, count(*) over (partition by query_id) as n from cut) c
    join ct on ct.id = c.chunk_id where fused_rank <= 10"""

def _annotated_sql(c: str) -> str:
    """Each acronym explained where it first stands as a token of its own."""
    for short, meaning in ACRONYMS.items():
        c = (
            f"regexp_replace({c}, '(^-*|[^\\w-]-*)({short})(-*$|-*[^\\w-])', "
            f"'\\1\\2 ({meaning})\\3', 'i')"
        )
    return c


# ---------------------------------------------------------------- dense and sparse


@query(
    f"with {_K}, "
    + _dense_sql("select id as query_id, v from vec where id % 50 = 0")
    + " select * from dense"
)
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.dense_topk(chunk_table(spark, folder), held_queries(spark, folder)
        .withColumns({"category": F.lit(None).cast("string"), "product": F.lit(None).cast("string")}), 50)


@query(
    f"with {_K}, "
    + _dense_sql(
        "select id as query_id, v, category, product from vec where id % 50 = 0",
        "(qv.category is null or qv.category = vec.category) "
        "and (qv.product is null or qv.product = vec.product)",
    )
    + " select * from dense"
)
def dense_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.dense_topk(chunk_table(spark, folder), held_queries(spark, folder), 50)


@query(
    f"with {_K}, "
    + _dense_sql("select id as query_id, v from vec where id % 50 = 0", k=10)
    + " select count(distinct query_id) as queries, count(*) as neighbours, true as recall_reached from dense"
)
def dense_index_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the index finds nine tenths of the ten exact neighbours of the
    stated query set, itself included, over all rows."""
    none = F.lit(None).cast("string")
    chunks = chunk_table(spark, folder)
    asked = materialise(
        held_queries(spark, folder).withColumns({"category": none, "product": none}), "queries"
    )
    rows = materialise(chunks.drop("content", "raw_content"), "vectors")
    centres = dense_index.train(rows, 64)
    held = materialise(dense_index.assigned(rows, centres, 64), "cells")
    found = dense_index.DenseIndex(centres, lambda cells: held).topk(asked, 10)
    exact = retrieval.dense_topk(rows, asked, 10)
    both = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"),
        F.count("*").alias("neighbours"),
        (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"),
    )


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_table(spark, folder).select("id", text.lower_tokens(F.col("content")).alias("tokens"))


@query(f"with {_K}, {_MQ}, {_sparse_sql()} select n, round(avgdl, 6) as avgdl from stats")
def bm25_corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.corpus_statistics(_tokens(spark, folder)).select(
        "n", F.round("avgdl", 6).alias("avgdl")
    )


@query(f"with {_K}, {_MQ}, {_sparse_sql()} select term, df from freq")
def bm25_doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.document_frequency(_tokens(spark, folder))


@query(
    f"with {_K}, {_MQ}, {_sparse_sql()} select term, id, cast(tf as int) as tf, "
    "cast(dl as int) as dl from post"
)
def bm25_postings(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.postings(_tokens(spark, folder))


@query(f"with {_K}, {_MQ}, {_sparse_sql()} select * from sparse")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25_topk(chunk_table(spark, folder), mined(spark, folder), 50, text.lower_tokens)


@query(
    f"with {_K}, {_MQ.replace('mq as', 'plain as', 1)}, "
    f"mq as (select * replace ({_annotated_sql('text')} as text) from plain), {_sparse_sql(k=10)} select * from sparse"
)
def bm25_annotated_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The mined queries with their acronyms explained, as a search takes them."""
    asked = mined(spark, folder).withColumn("text", annotated(F.col("text")))
    return retrieval.bm25_topk(chunk_table(spark, folder), asked, 10, text.lower_tokens)


def _bench_queries(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("string")
    asked = table(spark, folder, "bench_items").groupBy(F.col("item_id").alias("query_id")).agg(
        F.min("query").alias("text"),
        F.min("expect_any").alias("expect_any"),
        F.min("expect_product").alias("expect_product"),
    )
    return asked.withColumns({"category": none, "product": none})


@query(
    f"with {_K}, mq as (select item_id as query_id, min(query) as text, min(expect_product) as expect_product "
    f"from bench_items group by 1), {_sparse_sql(k=10)} select * from sparse"
)
def bm25_index_topk(spark: SparkSession, folder: str) -> DataFrame:
    """All evaluation items from an inverted index, which is written in two
    segments: all chunks, then those of one category over again."""
    chunks = materialise(chunk_table(spark, folder), "chunks")
    again = chunks.where("category = 'manual'")
    store = Store(spark, scratch(spark, "index"))
    store.commit(append=sparse_index.changes(chunks, None, text.lower_tokens, 1))
    store.commit(append=sparse_index.changes(again, again, text.lower_tokens, 2))
    index = sparse_index.SparseIndex(store.read)
    return index.topk(_bench_queries(spark, folder), 10, text.lower_tokens)


@query()
def bm25_topk_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25_topk(chunk_table(spark, folder), mined(spark, folder), 50, stemmed_tokens)


# ---------------------------------------------------------------- fusion and ranking


@query(
    _BASE + " select query_id, chunk_id, cast(fused_rank as int) as fused_rank, rrf, "
    "cast(dense_rank as int) as dense_rank, cast(sparse_rank as int) as sparse_rank from fused"
)
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    _, _, dense, sparse = _sides(spark, folder)
    return retrieval.fuse(dense, sparse).select(
        "query_id", "chunk_id", "fused_rank", "rrf", "dense_rank", "sparse_rank"
    )


@query(
    _BASE
    + f""", {_fused_sql(10, "fused10")},
    ks as (select 60 as k, query_id, fused_rank, rrf from fused
        union all select 10, query_id, fused_rank, rrf from fused10)
    select k, query_id, count(*) as fused, cast(case when count(*) < 5
        or max(rrf) filter (fused_rank = 1) - max(rrf) filter (fused_rank = 5) > 0.02
        then 30 else 10 end as int) as depth from ks group by 1, 2"""
)
def adaptive_depth(spark: SparkSession, folder: str) -> DataFrame:
    _, _, dense, sparse = _sides(spark, folder)
    dense, sparse = materialise(dense, "dense"), materialise(sparse, "sparse")
    per = lambda k: retrieval.adaptive_depth(retrieval.fuse(dense, sparse, k)).select(
        F.lit(k).alias("k"), "query_id", "fused", "depth"
    )
    return per(60).unionByName(per(10))


@query(
    _BASE
    + """, hits as (select query_id, 0 as variant, chunk_id, rank, score from dense
        union all select query_id, 1, chunk_id, rank, score from sparse),
    best as (select *, row_number() over (partition by query_id, chunk_id order by rank, variant) as n,
        min((variant, rank)) over (partition by query_id, chunk_id) as f from hits)
    select query_id, chunk_id, cast(row_number() over (partition by query_id
        order by rank, f, chunk_id) as int) as rank, score from best where n = 1"""
)
def union_best_rank(spark: SparkSession, folder: str) -> DataFrame:
    _, _, dense, sparse = _sides(spark, folder)
    hits = dense.withColumn("variant", F.lit(0)).unionByName(sparse.withColumn("variant", F.lit(1)))
    return retrieval.union_best_rank(hits)


@query(_BASE + _RESULT)
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, SearchOptions()).select(
        "query_id", "position", "chunk_id", "document_id", "section_title", "score"
    )


@query(_FILTERED + _RESULT)
def hybrid_search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, SearchOptions(), filtered=True).select(
        "query_id", "position", "chunk_id", "document_id", "section_title", "score"
    )


@query(
    _BASE
    + """, s as (select query_id, fused_rank, chunk_id, document_id, section_title
        from cut join ct on ct.id = cut.chunk_id),
    one as (select * from s qualify row_number() over (partition by query_id, document_id,
        coalesce(section_title, '') order by fused_rank) = 1)
    select query_id, cast(row_number() over (partition by query_id order by fused_rank) as int)
        as position, chunk_id from one qualify position <= 10"""
)
def section_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder, SearchOptions(dedup_sections=True)).select(
        "query_id", "position", "chunk_id"
    )


@query(
    _BASE
    + """ select query_id, chunk_id, md5(coalesce(p.raw_content, ct.raw_content)) as text_md5
    from cut join ct on ct.id = cut.chunk_id left join kk p on p.id = ct.parent_chunk_id"""
)
def parent_hydration(spark: SparkSession, folder: str) -> DataFrame:
    chunks, _, dense, sparse = _sides(spark, folder)
    cut = retrieval.cut_to_depth(retrieval.fuse(dense, sparse), SearchOptions())
    return retrieval.hydrate(materialise(cut, "candidates"), chunks).select(
        "query_id", "chunk_id", F.md5("rerank_text").alias("text_md5")
    )


def _ordered(spark: SparkSession, folder: str) -> DataFrame:
    _, _, dense, sparse = _sides(spark, folder)
    cut = retrieval.cut_to_depth(retrieval.fuse(dense, sparse), SearchOptions())
    cut = materialise(cut, "candidates")
    return retrieval.apply_rerank(cut, retrieval.noop_scores(cut))


@query(
    _BASE
    + """ select query_id, chunk_id, cast(fused_rank as int) as position,
        (count(*) over (partition by query_id) - fused_rank + 1)::double as score from cut"""
)
def noop_rerank_order(spark: SparkSession, folder: str) -> DataFrame:
    return _ordered(spark, folder).select("query_id", "chunk_id", "position", "score")


@query(
    _BASE
    + """, judged as (select *, case when fused_rank > 5 then 2 when fused_rank in (5, 3, 1) then 0
        else 1 end as part, case when fused_rank in (5, 3, 1) then 6 - fused_rank end as j from cut)
    select query_id, chunk_id, cast(row_number() over (partition by query_id
        order by part, j, fused_rank) as int) as position from judged"""
)
def listwise_reorder(spark: SparkSession, folder: str) -> DataFrame:
    """A judge that names the fifth, third and first row, in this order."""
    ordered = materialise(_ordered(spark, folder), "ordered")
    named = (
        ordered.where("position in (1, 3, 5)")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct(-F.col("position"), "chunk_id"))).alias("h"))
        .select("query_id", F.col("h.chunk_id").alias("ids"))
    )
    return retrieval.reorder_listwise(ordered, named).select("query_id", "chunk_id", "position")


def _stripped_sql(c: str) -> str:
    """The text without one opening, or null."""
    opening = "^[ ]*(?:" + "|".join(OPENINGS) + ")"
    tail = f"trim(substr({c}, 1 + len(regexp_extract(lower({c}), '{opening}'))))"
    return f"case when regexp_matches(lower({c}), '{opening}') and len({tail}) >= 3 then {tail} end"


@query(
    f"""with {_K}, {_MQ}, v1 as (select query_id, text, case when contains(text, '(') then
        trim(regexp_replace(regexp_replace(text, '[{chr(92)}s]*[(][^)]*[)]', '', 'g'), '[ ]{{2,}}', ' ', 'g'))
        else text end as plain from mq),
    v2 as (select *, {_stripped_sql("plain")} as s1 from v1),
    v3 as (select *, {_stripped_sql("s1")} as s2 from v2),
    v4 as (select *, {_stripped_sql("s2")} as s3 from v3)
    select query_id, list_filter([text, case when plain <> text and plain <> '' then plain end, s1, s2, s3],
        lambda x: x is not null) as variants from v4"""
)
def query_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Variants of the mined queries."""
    return mined(spark, folder).select("query_id", query_variants(F.col("text")).alias("variants"))


@query(f"with {_K}, {_MQ} select query_id, {_annotated_sql('text')} as text from mq")
def query_annotations(spark: SparkSession, folder: str) -> DataFrame:
    return mined(spark, folder).select("query_id", annotated(F.col("text")).alias("text"))


@query(
    _BASE
    + """ select query_id, count(*) as fused_hits, count(dense_rank) as dense_hits,
        count(sparse_rank) as sparse_hits, (select count(*) from cut c where c.query_id = f.query_id)
        as reranked from fused f group by query_id"""
)
def search_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    _, _, dense, sparse = _sides(spark, folder)
    dense, sparse = materialise(dense, "dense"), materialise(sparse, "sparse")
    fused = materialise(retrieval.fuse(dense, sparse), "fused")
    return retrieval.diagnostics(dense, sparse, fused, SearchOptions()).select(
        "query_id", "fused_hits", "dense_hits", "sparse_hits", "reranked"
    )


# ---------------------------------------------------------------- document ETL

_WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TRIM = lambda c: f"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_SECTIONS = rf"""
    md as (select id, title, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
        '\{{\d+\}}-+', '', 'g') as t from documents where text is not null),
    ln as (select id, unnest(string_split(t, chr(10))) as line,
        generate_subscripts(string_split(t, chr(10)), 1) as n from md),
    hd as (select *, regexp_matches(line, '^#{{1,6}}[ \t]+[^\r\n]+$') as h from ln),
    gr as (select *, sum(h::int) over (partition by id order by n) as g from hd),
    se as (select id, g, {_TRIM("regexp_extract(min(line) filter (h), '^#{1,6}[ \t]+(.+)$', 1)")} as title,
        length(regexp_extract(min(line) filter (h), '^(#{{1,6}})', 1)) as level,
        {_TRIM("coalesce(string_agg(line, chr(10) order by n) filter (not h), '')")} as content
        from gr where g > 0 group by id, g),
    kept as (select id, g, title, level, content from se where content <> ''),
    sections as (
        select id, cast(row_number() over (partition by id order by g) - 1 as int) as ordinal,
            title, level, content from kept
        union all
        select id, 0, title, 1, {_TRIM("t")} from md
        where id not in (select id from kept) and {_TRIM("t")} <> '')"""


def _sectioned(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "id", "title", split_sections(F.col("text"), F.col("title")).alias("sections")
    )


@query(
    f"with {_SECTIONS} select id, ordinal, title, cast(level as smallint) as level, "
    "md5(content) as content_md5 from sections"
)
def heading_sections(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _sectioned(spark, folder)
        .select("id", F.posexplode("sections").alias("ordinal", "s"))
        .select("id", "ordinal", "s.title", "s.level", F.md5("s.content").alias("content_md5"))
    )


def _clean_sql(c: str) -> str:
    for pattern, put in (
        ("<[^>]+>", ""),
        (r"[*][*]([^*]+)[*][*]", r"\1"),
        (r"[*]([^*]+)[*]", r"\1"),
        ("_([^_]+)_", r"\1"),
        (f"[{_WS}]+", " "),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{put}', 'g')"
    return _TRIM(c)


@query(f"select document_id, ordinal, {_clean_sql('title')} as cleaned from doc_sections")
def heading_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "doc_sections").select(
        "document_id", "ordinal", text.clean_heading(F.col("title")).alias("cleaned")
    )


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """Section lists in their order; repeated records once."""
    order = W.partitionBy("document_id", "ordinal").orderBy("title", "page_start", "page_end")
    rows = (
        table(spark, folder, "doc_sections")
        .repartition("document_id")
        .withColumn("_n", F.row_number().over(order))
        .where("_n = 1")
    )
    return (
        rows.groupBy(F.col("document_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "title", "page_start", "page_end"))).alias("listed"))
    )


@query(
    f"""with recursive {_SECTIONS},
    rec as (select distinct on (document_id, ordinal) * from doc_sections
        order by document_id, ordinal, title, page_start, page_end),
    listed as (select document_id as id,
        list(coalesce({_clean_sql("title")}, '') order by ordinal) as titles,
        list(page_start order by ordinal) as starts, list(page_end order by ordinal) as ends
        from rec group by 1),
    fold(id, n, cursor, title, page_start, page_end) as (
        select id, -1, cast(1 as bigint), cast(null as varchar), cast(null as int), cast(null as int)
        from (select distinct id from sections)
        union all
        select id, n + 1, cursor + pos, title, case when pos > 0 then starts[cursor + pos - 1] end,
            case when pos > 0 then ends[cursor + pos - 1] end
        from (select f.id, f.n, f.cursor, s.title, l.starts, l.ends, coalesce(list_position(
                l.titles[f.cursor:f.cursor + 3], {_clean_sql("s.title")}), 0) as pos
            from fold f join sections s on s.id = f.id and s.ordinal = f.n + 1
            left join listed l on l.id = f.id))
    select id, n as ordinal, title, page_start, page_end from fold where n >= 0"""
)
def page_stamp(spark: SparkSession, folder: str) -> DataFrame:
    held = _sectioned(spark, folder).join(_listed(spark, folder), "id", "left")
    return (
        held.select("id", F.posexplode(stamp_pages(F.col("sections"), F.col("listed"))).alias("ordinal", "s"))
        .select("id", "ordinal", "s.title", "s.page_start", "s.page_end")
    )


_WORDS = "list_filter(string_split(content, ' '), lambda w: w <> '')"
_CHUNKS = _SECTIONS + f""",
    body as (select id, ordinal, title, level, content, {_WORDS} as w from sections),
    par as (select id, ordinal, title, level, 'parent' as chunk_kind, 0 as piece, case
        when (13 * len(w) + 9) // 10 <= 2048 or len(w) <= 1574 then content
        else array_to_string(w[1:1378], ' ') || chr(10) || chr(10) || '[…section continues…]'
            || chr(10) || chr(10) || array_to_string(w[len(w) - 195:], ' ') end as raw_content
        from body),
    leaf as (
        select id, ordinal, title, level, 'leaf' as chunk_kind, 0 as piece, content as raw_content
        from body where (13 * len(w) + 9) // 10 <= 1200
        union all
        select id, ordinal, title, level, 'leaf', k, array_to_string(w[k * 344 + 1:k * 344 + 393], ' ')
        from body, unnest(range(0, 1 + cast(ceil((len(w) - 393) / 344.0) as bigint))) as r(k)
        where (13 * len(w) + 9) // 10 > 1200),
    numbered as (select *, cast(row_number() over (partition by id
        order by chunk_kind desc, ordinal, piece) - 1 as int) as chunk_index
        from (select * from par union all select * from leaf))"""
_CHUNK_RESULT = """ select id as document_id, chunk_index, title as section_title, chunk_kind,
    md5(raw_content) as raw_md5 from numbered"""


def _chunked(spark: SparkSession, folder: str) -> DataFrame:
    held = _sectioned(spark, folder).withColumnRenamed("id", "document_id")
    return chunk_documents(held).select(
        "document_id", "chunk_index", "section_title", "chunk_kind", F.md5("raw_content").alias("raw_md5")
    )


@query(f"with {_CHUNKS} {_CHUNK_RESULT} where chunk_kind = 'leaf'")
def chunk_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return _chunked(spark, folder).where("chunk_kind = 'leaf'")


@query(f"with {_CHUNKS} {_CHUNK_RESULT} where chunk_kind = 'parent'")
def chunk_parents(spark: SparkSession, folder: str) -> DataFrame:
    return _chunked(spark, folder).where("chunk_kind = 'parent'")


@query(
    f"""with {_CHUNKS} select n.id as document_id, n.chunk_index, p.chunk_index as parent_index,
        md5(concat(coalesce(d.title, ''), ' > ', coalesce(n.title, ''), chr(10), chr(10), n.raw_content)) as content_md5,
        cast((13 * len(list_filter(string_split(n.raw_content, ' '), lambda w: w <> '')) + 9) // 10 as int) as token_count
    from numbered n join documents d on d.id = n.id
    join numbered p on p.id = n.id and p.chunk_kind = 'parent' and p.ordinal = n.ordinal
    where n.chunk_kind = 'leaf'"""
)
def chunk_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves with the text that is indexed and the number of their parent."""
    held = _sectioned(spark, folder).withColumnRenamed("id", "document_id")
    chunks = chunk_documents(held)
    parents = chunks.where("chunk_kind = 'parent'").select(
        F.col("id").alias("parent_chunk_id"), F.col("chunk_index").alias("parent_index")
    )
    return (
        chunks.where("chunk_kind = 'leaf'")
        .join(parents, "parent_chunk_id")
        .select(
            "document_id", "chunk_index", "parent_index", F.md5("content").alias("content_md5"), "token_count"
        )
    )


@query(
    f"""with {_CHUNKS} select id as document_id, count(*) as chunks, max(chunk_index) as last_index,
    count(*) filter (chunk_kind = 'parent') as parents from numbered group by 1"""
)
def chunk_numbering(spark: SparkSession, folder: str) -> DataFrame:
    return _chunked(spark, folder).groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.max("chunk_index").alias("last_index"),
        F.count_if(F.col("chunk_kind") == "parent").alias("parents"),
    )


@query(
    f"""with {_SECTIONS}, body as (select id, ordinal, content, {_WORDS} as w from sections),
    win as (select id, ordinal, k, w[k * 7 + 1:k * 7 + 7] as p, len(w) as n from body,
        unnest(range(0, 1 + greatest(0, cast(ceil((len(w) - 7) / 7.0) as bigint)))) as r(k)
        where (13 * len(w) + 9) // 10 > 15),
    grp as (select *, sum((k = 0 or (13 * len(p) + 9) // 10 >= 8)::int)
        over (partition by id, ordinal order by k) as g from win)
    select id as document_id, ordinal, cast(g - 1 as int) as piece,
        cast(sum((13 * len(p) + 9) // 10) as int) as tokens,
        md5(string_agg(array_to_string(p, ' '), chr(10) || chr(10) order by k)) as raw_md5
    from grp group by 1, 2, 3"""
)
def tiny_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Small windows without overlap, so that last ones are tiny and merge."""
    from corpusmill.operators.chunking import leaf_texts

    opt = ChunkOptions(target_tokens=10, max_tokens=15, overlap_tokens=0, min_tokens=8)
    sections = _sectioned(spark, folder).select(
        F.col("id").alias("document_id"), F.posexplode("sections").alias("ordinal", "s")
    )
    long = text.approx_tokens(F.size(text.words(F.col("s.content")))) > opt.max_tokens
    return (
        sections.where(long)
        .select("document_id", "ordinal", F.posexplode(leaf_texts(F.col("s.content"), opt)).alias("piece", "x"))
        .select("document_id", "ordinal", "piece", "x.tokens", F.md5("x.body").alias("raw_md5"))
    )


# ---------------------------------------------------------------- catalog


@query(
    """select id, title, category, product, version, slug, pages, section_count, ingested_at
    from documents order by category nulls first, title nulls first, id limit 100"""
)
def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_documents(table(spark, folder, "documents"))


@query(
    """select 'category' as by, id, title, category, product from (select * from documents where category = 'manual'
        order by category, title nulls first, id limit 500)
    union all select 'product', id, title, category, product from (select * from documents
        where product = (select max(product) from documents) and category = 'toi'
        order by category, title nulls first, id limit 1)"""
)
def list_documents_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Filters by category and product; limits above 500 and below 1 are clamped."""
    documents = table(spark, folder, "documents")
    last = documents.agg(F.max("product")).first()[0]
    columns = lambda df, by: df.select(F.lit(by).alias("by"), "id", "title", "category", "product")
    return columns(catalog.list_documents(documents, "manual", None, 9999), "category").unionByName(
        columns(catalog.list_documents(documents, "toi", last, 0), "product")
    )


@query("select id, to_json(coalesce(tags, [])) as tags_json, coalesce(tags, []) as tags from documents")
def tags_json(spark: SparkSession, folder: str) -> DataFrame:
    """Tags as stored, and read back."""
    held = table(spark, folder, "documents").select("id", text.tags_to_json(F.col("tags")).alias("tags_json"))
    return held.withColumn("tags", text.tags_from_json(F.col("tags_json")))


@query(
    """with n as (select document_id, count(distinct id) as c from chunks group by 1)
    select id, title, pdf_sha256, tags, coalesce(c, 0) as chunk_count
    from documents left join n on n.document_id = id"""
)
def get_document(spark: SparkSession, folder: str) -> DataFrame:
    held = catalog.get_documents(table(spark, folder, "documents"), table(spark, folder, "chunks"))
    return held.select("id", "title", "pdf_sha256", "tags", "chunk_count")


@query(
    f"""with {_K} select document_id, section_title, count(*) as chunk_count,
        (list(page_start order by chunk_index, id))[1] as page_start,
        (list(page_end order by chunk_index, id))[-1] as page_end,
        md5(string_agg(raw_content, chr(10) || chr(10) order by chunk_index, id)) as body_md5
    from kk where section_title is not null group by 1, 2"""
)
def lookup_section(spark: SparkSession, folder: str) -> DataFrame:
    """Every section of every document, put together."""
    return catalog.lookup_sections(table(spark, folder, "chunks")).select(
        "document_id", "section_title", "chunk_count", "page_start", "page_end", F.md5("body").alias("body_md5")
    )


@query(
    f"""with {_K}, one as (select document_id, max(section_title) as section_title from kk
        where chunk_kind = 'parent' and section_title is not null group by 1)
    select document_id, section_title, count(*) as chunk_count,
        md5(string_agg(raw_content, chr(10) || chr(10) order by chunk_index, id)) as body_md5
    from kk join one using (document_id, section_title) where chunk_kind = 'parent' group by 1, 2"""
)
def lookup_section_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document the section with the last title, from its parents only."""
    chunks = table(spark, folder, "chunks")
    wanted = (
        chunks.where("chunk_kind = 'parent' and section_title is not null")
        .groupBy("document_id")
        .agg(F.max("section_title").alias("section_title"))
    )
    found = catalog.lookup_sections(chunks, "parent").join(wanted, ["document_id", "section_title"])
    return found.select("document_id", "section_title", "chunk_count", F.md5("body").alias("body_md5"))


@query(
    """with r as (select * from ingest_runs order by started_at desc, id desc,
        (finished_at is not null) desc limit 1)
    select (select count(*) from documents) > 0 and (select count(*) from chunks) > 0 as healthy,
        (select count(*) from documents) as documents, (select count(distinct id) from chunks) as chunks,
        id as last_run_id, status as last_status from r"""
)
def store_status(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.store_status(*(table(spark, folder, n) for n in ("documents", "chunks", "ingest_runs")))


# ---------------------------------------------------------------- ingest

_LATEST = """
    latest as (select * from catalog_entries where id is not null qualify row_number() over (
        partition by id order by generated_at desc nulls last, pdf_sha256 desc nulls last) = 1)"""


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.latest_entries(table(spark, folder, "catalog_entries"))


@query(
    f"""with {_LATEST} select l.id, case when l.pdf_sha256 = d.pdf_sha256 then 'skip' else 'upsert' end
    as action from latest l left join documents d on d.id = l.id"""
)
def incremental_diff(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.plan(_entries(spark, folder), table(spark, folder, "documents"))


@query(
    f"""with {_LATEST} select id, pdf_sha256, 'catalog' as origin from latest where lower(category) = 'toi'
    union all select id, pdf_sha256, 'stored' from documents
    where id not in (select id from latest where lower(category) = 'toi')"""
)
def upsert_latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    new = ingest.in_category(_entries(spark, folder), "TOI").select(
        "id", "pdf_sha256", F.lit("catalog").alias("origin")
    )
    old = table(spark, folder, "documents").select("id", "pdf_sha256", F.lit("stored").alias("origin"))
    return ingest.upserted(old, new)


@query(
    f"""with {_LATEST} select id, pdf_sha256, 'catalog' as origin from latest where lower(category) = 'toi'
    union all select id, pdf_sha256, 'stored' from documents
    where id not in (select id from latest where lower(category) = 'toi') and product is not null"""
)
def store_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written to a store; then those of the catalog in place of
    theirs, and those without product deleted, in one version."""
    new = ingest.in_category(_entries(spark, folder), "TOI").select(
        "id", "pdf_sha256", F.lit("catalog").alias("origin")
    )
    old = table(spark, folder, "documents")
    store = Store(spark, scratch(spark, "store"))
    store.commit(upsert={"documents": (old.select("id", "pdf_sha256", F.lit("stored").alias("origin")), old.select("id").limit(0))})
    store.commit(upsert={"documents": (new, old.where("product is null").select("id"))})
    return store.read("documents")


@query(
    """select generated_at, id, title, product, tags, pages, size_bytes, converted_at
    from catalog_entries where id is not null"""
)
def catalog_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog written as its JSON file, one per delivery, and read back.

    A file is one row by its format, as large as one delivery of a catalog.
    """
    path = scratch(spark, "catalog")
    entry = F.struct("id", "title", "product", "tags", "pages", "size_bytes", "converted_at")
    utc = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    rows = table(spark, folder, "catalog_entries").where("id is not null")
    rows.groupBy("generated_at").agg(F.collect_list(entry).alias("documents")).select(
        F.to_json(F.struct("generated_at", "documents"), utc)
    ).write.option("maxRecordsPerFile", 1).text(path)
    read = files.read_catalog(spark, path)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return read.select(
        ntz("generated_at"), "id", "title", "product", "tags", "pages", "size_bytes", ntz("converted_at")
    )


@query(
    """select 2 as version, cast(row_number() over (order by item_id) - 1 as bigint) as query_id, query,
        expect_any, expect_product, [item_id] as expect_any_of_chunk_ids from bench_items"""
)
def query_set_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation items (300 at every scale) as a query-set file, read back."""
    path = scratch(spark, "queries")
    item = F.struct("item_id", "query", "expect_any", "expect_product", F.array("item_id").alias("expect_any_of_chunk_ids"))
    held = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("item_id"))
    table(spark, folder, "bench_items").agg(held.alias("queries")).select(
        F.to_json(F.struct(F.lit(2).alias("version"), "queries"))
    ).write.text(path)
    return files.read_query_set(spark, path)


@query(
    f"""with {_LATEST}, gone as (select id from documents
        where id not in (select id from latest where lower(category) = 'toi'))
    select document_id, count(*) as chunk_rows from chunks
    where document_id not in (select id from gone) group by 1"""
)
def prune_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk rows that remain when only one category stays in the catalog."""
    entries = ingest.in_category(_entries(spark, folder), "toi")
    gone = ingest.missing_documents(entries, table(spark, folder, "documents"))
    left = ingest.without_documents(table(spark, folder, "chunks"), gone, "document_id")
    return left.groupBy("document_id").agg(F.count("*").alias("chunk_rows"))


@query(
    f"""with {_SECTIONS}, agg as (select id, sum(length(content)) as size,
        (list(title order by ordinal))[1] as first_title from sections group by id)
    select d.id, case when d.text is null then 'error' when a.id is null then 'empty'
        when coalesce(starts_with(first_title, 'Fake conversion of'), false) or size < 40
        then 'placeholder' else 'ok' end as state
    from documents d left join agg a on a.id = d.id"""
)
def placeholder_gate(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.gate(_sectioned(spark, folder)).select("id", "state")


@query(
    """select id, status, started_at, finished_at from ingest_runs qualify row_number() over (
    partition by id order by finished_at desc nulls last, status, started_at desc nulls last) = 1"""
)
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.latest_runs(table(spark, folder, "ingest_runs")).select(
        "id", "status", "started_at", "finished_at"
    )


@query(
    """with l as (select * from ingest_runs qualify row_number() over (partition by id
        order by finished_at desc nulls last, status, started_at desc nulls last) = 1)
    select id, catalog_sha256 from l where status = 'completed' and catalog_sha256 is not null
    order by started_at desc, id desc limit 1"""
)
def last_successful_run(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.last_successful(table(spark, folder, "ingest_runs"), "completed").select(
        "id", "catalog_sha256"
    )


@query(
    f"""with {_SECTIONS}, agg as (select id, sum(length(content)) as size,
        (list(title order by ordinal))[1] as first_title from sections group by id),
    st as (select d.source as run_id, case when d.text is null then 'error' when a.id is null then 'empty'
        when coalesce(starts_with(first_title, 'Fake conversion of'), false) or size < 40
        then 'placeholder' else 'ok' end as state
        from documents d left join agg a on a.id = d.id)
    select run_id, count(*) as docs_total, count(*) filter (state = 'placeholder') as docs_skipped,
        count(*) filter (state = 'ok') as docs_upserted,
        count(*) filter (state in ('error', 'empty')) as docs_failed,
        case when count(*) filter (state in ('error', 'empty')) = 0 then 'success'
            when count(*) filter (state = 'ok') > 0 then 'partial' else 'error' end as status
    from st group by 1"""
)
def run_status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """A run per source of the documents."""
    source = table(spark, folder, "documents").select("id", F.col("source").alias("run_id"))
    judged = ingest.gate(_sectioned(spark, folder)).select("id", "state")
    return ingest.run_status(judged.join(source, "id"))


@query(
    """select distinct query_id, query, source_chunk_id from mined_queries
    where query is not null and source_chunk_id is not null"""
)
def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Written as lines of JSON to the shared folder and read back."""
    import uuid

    from corpusmill.session import delete, shared_dir

    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    rows = table(spark, folder, "mined_queries").where(
        "query is not null and source_chunk_id is not null"
    )
    files.write_lines(rows.select("query_id", "query", "source_chunk_id").distinct(), path)
    back = files.read_lines(spark, path, "query_id BIGINT, query STRING, source_chunk_id BIGINT")
    back = materialise(back, "jsonl")
    delete(spark, path)
    return back


# ---------------------------------------------------------------- evaluation and mining

_BQ = """mq as (select item_id as query_id, min(query) as text, min(expect_any) as expect_any,
        min(expect_product) as expect_product from bench_items group by 1)"""
_REL = """(coalesce(lower({p}) = lower(ct.product), false)
    or len(list_filter({a}, lambda t: coalesce(contains(lower(document_slug), lower(t)), false)
        or coalesce(contains(lower(document_title), lower(t)), false))) > 0)"""


@query(
    f"with {_K}, {_BQ}, {_sparse_sql(k=10)}, "
    + f"""hits as (select query_id, max((rank = 1 and r)::int) as top1, max(r::int) as topk from (
        select sparse.query_id, rank, {_REL.format(p="mq.expect_product", a="coalesce(mq.expect_any, [])")} as r
        from sparse join mq using (query_id) join ct on ct.id = sparse.chunk_id) group by 1)
    select count(*) as queries, round_even(avg(coalesce(top1, 0)) * 100, 2) as top1_hit_rate,
        round_even(avg(coalesce(topk, 0)) * 100, 2) as topk_hit_rate
    from mq left join hits using (query_id)"""
)
def bench_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    """All evaluation items, searched by their query's words."""
    asked = _bench_queries(spark, folder)
    chunks = chunk_table(spark, folder)
    hits = retrieval.bm25_topk(chunks, asked, 10, text.lower_tokens)
    facts = chunks.select(F.col("id").alias("chunk_id"), "product", "document_slug", "document_title")
    results = (
        hits.join(facts, "chunk_id")
        .join(asked.drop("category", "product"), "query_id")
        .select(
            "query_id",
            F.col("rank").alias("position"),
            evaluate.is_relevant(
                F.col("chunk_id"), F.lit(None).cast("array<bigint>"), F.col("expect_any"),
                F.col("expect_product"), F.col("document_slug"), F.col("document_title"), F.col("product"),
            ).alias("relevant"),
        )
    )
    return evaluate.hit_rates(results, asked, 10)


@query(
    _BASE
    + """, hits as (select query_id, max((fused_rank = 1 and chunk_id = source_chunk_id)::int) as top1,
        max((chunk_id = source_chunk_id)::int) as topk from cut join mq using (query_id)
        where fused_rank <= 10 group by 1)
    select count(*) as queries, round_even(avg(coalesce(top1, 0)) * 100, 2) as top1_hit_rate,
        round_even(avg(coalesce(topk, 0)) * 100, 2) as topk_hit_rate
    from mq left join hits using (query_id)"""
)
def bench_hit_rate_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All mined queries in the hybrid search; the chunk each was written from
    is the only relevant one, whatever its product."""
    asked = mined(spark, folder)
    want = asked.select("query_id", F.array("source_chunk_id").alias("ids"), "expect_product")
    results = _found(spark, folder, SearchOptions()).join(want, "query_id")
    relevant = evaluate.is_relevant(
        F.col("chunk_id"), F.col("ids"), F.lit(None).cast("array<string>"), F.col("expect_product"),
        F.col("document_slug"), F.col("document_title"), F.col("product"),
    )
    return evaluate.hit_rates(results.withColumn("relevant", relevant), asked, 10)


@query(
    """with v as (select event_type, value, count(*) over (partition by event_type) as n,
        row_number() over (partition by event_type order by value) - 1 as k
        from events where value is not null)
    select event_type, count(*) as n, round(max(value) filter (k = n // 2), 6) as p50,
        round(max(value) filter (k = least(n - 1, cast(ceil(0.95 * n) as bigint) - 1)), 6) as p95,
        round(avg(value), 6) as average, round(max(value), 6) as maximum
    from v group by 1"""
)
def bench_latency(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.latency_report(table(spark, folder, "events"), "value", "event_type")


_JUDGED = _BASE + """, one as (select s.*, mq.expect_product from (
        select query_id, fused_rank, chunk_id, document_id, product, document_slug, document_title
        from cut join ct on ct.id = cut.chunk_id qualify row_number() over (partition by query_id,
            document_id, coalesce(section_title, '') order by fused_rank) = 1) s
        join mq using (query_id)),
    res as (select *, row_number() over (partition by query_id order by fused_rank) as position,
        coalesce(lower(expect_product) = lower(product), false) as relevant from one),
    pos as (select query_id, arg_min(chunk_id, position) as pc, arg_min(document_id, position) as pd,
        arg_min(coalesce(product, ''), position) as pp from res where relevant and position <= 20 group by 1),
    neg as (select res.*, pc, row_number() over (partition by query_id order by position) as n
        from res join pos using (query_id) where chunk_id <> pc and document_id <> pd and position <= 20
        and not coalesce(lower(product) = lower(pp) and product <> '', false)),
    kept as (select query_id, min(pc) as positive_id, list(chunk_id order by n) as negatives
        from neg where n <= 4 group by 1 having count(*) = 4)"""


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    asked = mined(spark, folder)
    found = _found(spark, folder, SearchOptions(limit=20, dedup_sections=True))
    want = asked.select("query_id", "expect_product")
    results = found.join(want, "query_id").withColumn(
        "relevant",
        evaluate.matches_expectation(
            F.lit(None).cast("array<string>"), F.col("expect_product"), F.col("document_slug"),
            F.col("document_title"), F.col("product"),
        ),
    )
    return materialise(results, "judged"), asked


@query(_JUDGED + " select * from kept")
def triples(spark: SparkSession, folder: str) -> DataFrame:
    results, _ = _judged(spark, folder)
    return mining.triples(results).select(
        "query_id", F.col("positive.chunk_id").alias("positive_id"), "negatives"
    )


@query(
    _JUDGED
    + """, per as (select query_id, max(relevant::int) as hit from res where position <= 20 group by 1)
    select count(*) as queries, count(*) filter (hit is null) as no_results,
        count(*) filter (hit = 0) as no_positive,
        count(*) filter (hit = 1 and kept.query_id is null) as few_negatives,
        count(kept.query_id) as kept
    from mq left join per using (query_id) left join kept using (query_id)"""
)
def curation_statistics(spark: SparkSession, folder: str) -> DataFrame:
    results, asked = _judged(spark, folder)
    return mining.curation_statistics(results, asked)


@query(
    _BASE
    + """, res as (select query_id, list(chunk_id order by fused_rank) as ids from cut
        where fused_rank <= 20 group by 1)
    select query_id, source_chunk_id, cast(list_position(ids, source_chunk_id) - 1 as int) as retriever_rank,
        ids[1:10] as top_ids from res join mq using (query_id)
    where list_position(ids, source_chunk_id) > 0"""
)
def reachability(spark: SparkSession, folder: str) -> DataFrame:
    found = _found(spark, folder, SearchOptions(limit=20))
    return mining.reachability(found, mined(spark, folder).select("query_id", "source_chunk_id"))
