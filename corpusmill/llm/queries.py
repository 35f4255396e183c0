"""Named queries of the pipeline operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

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
from corpusmill.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.defects(table(spark, folder, "chunks"), table(spark, folder, "documents"))


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.repaired(table(spark, folder, "chunks"), table(spark, folder, "documents"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.case_pairs(table(spark, folder, "chunks"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.classes(table(spark, folder, "chunks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_lines(
        table(spark, folder, "chunks"), table(spark, folder, "documents")
    )


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.without_repeated_lines(
        table(spark, folder, "chunks"), table(spark, folder, "documents")
    )


def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Without the blocks' names, which are hashes."""
    return site_lines.block_report(
        table(spark, folder, "chunks"), table(spark, folder, "documents")
    ).drop("block")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return vector_neighbours.mutual_pairs(table(spark, folder, "chunks"))


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: every leaf chunk whose id is divisible by 50."""
    return table(spark, folder, "chunks").where("chunk_kind = 'leaf' and id % 50 = 0").select("id")


def p4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return vector_neighbours.nearest(table(spark, folder, "chunks"), _queries(spark, folder))


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    return vector_neighbours.recall(table(spark, folder, "chunks"), _queries(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(table(spark, folder, "chunks"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"))


def p5_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every text that was cut, put together again from its pieces: the words
    without the overlaps, and whether all pieces keep to the limits."""
    pieces = splitting.split_oversized(table(spark, folder, "chunks"))
    words = F.regexp_extract_all("piece", F.lit(r"\S+"), F.lit(0))
    own = F.slice(words, F.floor(F.col("overlap_tokens") * 10 / 13).cast("int") + 1, F.size(words))
    held = F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own"))))
    return (
        pieces.groupBy("id")
        .agg(
            held.alias("held"),
            (F.max("piece_tokens") <= splitting.MAX_TOKENS).alias("within_limit"),
            (F.max("overlap_tokens") <= splitting.OVERLAP_TOKENS).alias("within_overlap"),
        )
        .withColumn("w", F.flatten("held.own"))
        .select(
            "id", F.size("w").alias("words"), F.md5(F.array_join("w", " ")).alias("words_md5"),
            "within_limit", "within_overlap",
        )
    )


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(
        table(spark, folder, "documents"), table(spark, folder, "bench_items")
    )


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.item_report(
        table(spark, folder, "documents"), table(spark, folder, "bench_items")
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_documents(table(spark, folder, "documents"))


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.source_report(table(spark, folder, "documents"))


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.limit_report(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_text, p2_found, p2_classes, p3_found, p3_clean, p3_blocks, p4_found, p4_nearest, p4_recall,
        p5_found, p5_pieces, p5_rebuilt, p6_ids, p7_found, p7_items,
        p8_found, p8_sources, p8_limits,
    )
}

_LEAVES = """
        leaf as (select * from chunks where chunk_kind = 'leaf' and id is not null
            qualify row_number() over (partition by id order by created_at desc nulls last) = 1)"""
_P3 = r"""
        with base as (
            select id, document_id, raw_content from chunks where chunk_kind = 'leaf' and id is not null
            qualify row_number() over (partition by id order by created_at desc nulls last,
                document_id, raw_content) = 1),
        leaf as (select * from base where document_id is not null),
        src as (
            select id as document_id, min(lower(trim(coalesce(category, ''))) || chr(1)
                || lower(trim(product))) as source
            from documents where product is not null and trim(product) <> '' group by id),
        split as (
            select id, document_id, unnest(string_split(raw_content, chr(10))) as line,
                generate_subscripts(string_split(raw_content, chr(10)), 1) as line_no
            from leaf where raw_content is not null),
        lines as (
            select id, document_id, line_no,
                trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')) as letters from split),
        keyed as (
            select id, document_id, line_no, replace(letters, ' ', '') as k from lines
            where len(string_split(letters, ' ')) >= 6),
        everywhere as (
            select k from keyed group by k having count(distinct document_id) >= 5),
        size as (
            select source, count(distinct document_id) as n from leaf join src using (document_id)
            group by source),
        hot as (
            select source, k from keyed join src using (document_id) join size using (source)
            where k in (select k from everywhere)
            group by source, k, n having count(distinct document_id) >= 0.1 * n)"""
_VECTORS = _LEAVES + """,
        vec as (select id, embedding_model as model, embedding::double[] as v from leaf
            where embedding_model is not null and len(embedding) = 64
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
            and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_RUNS = _LEAVES + r""",
        w as (select id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from leaf),
        g as (select distinct id, unnest(list_transform(range(1, len(w) - 1),
            lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2])) as g from w where len(w) >= 3),
        n as (select id, count(*) as n from g group by 1),
        both as materialized (select a.id as id_a, b.id as id_b, count(*) as c
            from g a join g b on a.g = b.g and a.id < b.id group by 1, 2),
        link as materialized (select id_a, id_b from "both" join n x on x.id = id_a
            join n y on y.id = id_b where 5 * c >= 3 * (x.n + y.n - c)),
        sym as (select id_a as x, id_b as y from link union all select id_b, id_a from link),
        reach(x, y) as (select x, y from sym union select r.x, s.y from reach r join sym s on r.y = s.x)"""

ORACLE = {
    "p2_found": f"with recursive {_RUNS.replace('both as', '"both" as')} "
    "select x as id_a, y as id_b from reach where x < y",
    "p2_classes": f"with recursive {_RUNS.replace('both as', '\"both\" as')} "
    "select id, coalesce((select min(least(x, y)) from reach where x = id), id) as class_id from leaf",
    "p4_found": f"""with {_VECTORS},
        near as (select a, b from (select q.id as a, vec.id as b, list_cosine_similarity(q.v, vec.v) as s
            from vec q, vec where q.model = vec.model and q.id <> vec.id
            and list_cosine_similarity(q.v, vec.v) >= 0.9)
            qualify row_number() over (partition by a order by s desc, b) <= 10)
        select x.a as id_a, x.b as id_b from near x join near y on x.a = y.b and x.b = y.a where x.a < x.b""",
    "p4_nearest": f"""with {_VECTORS} select id, neighbour, cast(place as int) as place, similarity from (
        select *, row_number() over (partition by id order by similarity desc, neighbour) as place from (
            select q.id, vec.id as neighbour, round(list_cosine_similarity(q.v, vec.v), 6) as similarity
            from vec q, vec where q.id % 50 = 0 and q.model = vec.model and q.id <> vec.id))
        where place <= 10""",
    "p4_recall": f"""with {_VECTORS}, near as (
            select q.id, vec.id as neighbour, round(list_cosine_similarity(q.v, vec.v), 6) as s
            from vec q, vec where q.id % 50 = 0 and q.model = vec.model and q.id <> vec.id
            qualify row_number() over (partition by q.id order by s desc, neighbour) <= 10)
        select round(least(floor(s * 50 + 1e-9), 49) / 50, 2) as band, count(*) as exact,
            count(*) as found, 1.0::double as recall from near where s >= 0.9 group by 1""",
    "p3_found": _P3
    + """ select id, cast(line_no as int) as line_no from keyed join src using (document_id)
        join hot using (source, k)""",
    "p3_blocks": _P3.replace("with base", "with recursive base")
    + """, node as (select source, k, n, count(distinct document_id) as weight
            from keyed join src using (document_id) join hot using (source, k) join size using (source)
            group by all),
        hit as (select distinct id, document_id, line_no, source, k from keyed
            join src using (document_id) join hot using (source, k)),
        edge as (select a.source, a.k as x, b.k as y from hit a
            join hit b on b.id = a.id and b.line_no = a.line_no + 1 join size on size.source = a.source
            where a.k <> b.k group by a.source, a.k, b.k, n
            having count(distinct a.document_id) >= greatest(5, 0.1 * n)),
        sym as (select source, x, y from edge union select source, y, x from edge),
        reach(source, x, y) as (select source, k, k from node union
            select r.source, r.x, s.y from reach r join sym s on s.source = r.source and s.x = r.y),
        block as (select source, x as k, min(y) as block from reach group by all)
        select source, count(*) as lines, min(weight) as least, max(weight) as most
        from node join block using (source, k) group by source, block""",
    "p3_clean": _P3 + r""",
        hit as (select distinct id, line_no from keyed join src using (document_id)
            join hot using (source, k)),
        kept as (select s.id, coalesce(string_agg(line, chr(10) order by s.line_no)
                filter (h.id is null), '') as t, count(h.id) as n
            from split s left join hit h on h.id = s.id and h.line_no = s.line_no group by 1)
        select b.id, b.document_id, case when b.raw_content is not null then t end as kept_content,
            cast(coalesce(n, 0) as int) as lines_removed
        from base b left join kept using (id)""",
    "p5_found": r"""
        select distinct id from chunks where chunk_kind = 'leaf' and id is not null
        and (13 * len(regexp_extract_all(raw_content, '\S+')) + 9) // 10 > 1200""",
    "p8_limits": r"""
        with t as (select coalesce(source, '') as source, text from documents
            where text is not null and not regexp_full_match(text, '[\s\p{Z}\x0B\x1C-\x1F\x85]*')),
        u as (select source, 'chars' as unit, length(text) as length from t
            union all select source, 'bytes', strlen(text) from t),
        c as (select source, unit, length, count(*) as texts from u group by all),
        w as (select *, coalesce(sum(texts) over (b range between current row and unbounded following), 0) as reached,
                sum(texts) over (b range between 50 preceding and 50 following) - texts as near,
                101 * coalesce(sum(texts) over (b range between 51 following and unbounded following), 0)
                    + sum(texts * length) over (b range between 50 preceding and 50 following)
                    - (length - 51) * sum(texts) over (b range between 50 preceding and 50 following)
                    - greatest(51 - length, 0) * sum(texts) over (partition by source, unit) as passed
            from c window b as (partition by source, unit order by length)),
        e as (select *, reached * (near + 1.0)::double / greatest(passed - reached, 1) as expected from w),
        p as (select *, case when texts > expected
                then texts - expected - texts * ln(texts / expected) else 0.0 end as log_p from e),
        h as (select floor(log_p / 0.25) as bin, count(*) as n, max(log_p) as upper from p group by 1),
        r as (select upper, sum(n) over (order by bin) as rank, sum(n) over () as m from h),
        best as (select max(upper) as most from r where upper <= ln(0.01 * rank / m))
        select source, unit, length::bigint as length, texts, reached::bigint as reached, round(expected, 6) as expected
        from p, best where log_p <= most""",
    "p5_rebuilt": f"with {_LEAVES}" + r""",
        w as (select id, regexp_extract_all(content, '\S+') as w from leaf)
        select id, cast(len(w) as int) as words, md5(array_to_string(w, ' ')) as words_md5,
            true as within_limit, true as within_overlap
        from w where (13 * len(w) + 9) // 10 > 1200""",
    "p7_found": r"""
        with w as (
            select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
        grams as (
            select doc_id, unnest(list_transform(range(1, len(w) - 10),
                lambda p: array_to_string(w[p:p + 11], ' '))) as g from w where len(w) >= 12),
        v as (
            select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from bench_items),
        held as (
            select item_id, unnest(list_transform(range(1, len(w) - 10),
                lambda p: array_to_string(w[p:p + 11], ' '))) as g from v where len(w) >= 12)
        select distinct doc_id, item_id from grams join held using (g)""",
}
