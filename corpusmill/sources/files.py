"""Files in and out: catalogs, Markdown, section lists, lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ENTRY = (
    "id STRING, url STRING, category STRING, product STRING, version STRING, title STRING, "
    "slug STRING, tags ARRAY<STRING>, pdf_path STRING, md_path STRING, json_path STRING, "
    "pdf_sha256 STRING, pages INT, size_bytes BIGINT, convert_mode STRING, image_count INT, "
    "section_count INT, level1_section_count INT, toc_count INT, downloaded_at TIMESTAMP, "
    "converted_at TIMESTAMP"
)
SECTIONS = "title STRING, sections ARRAY<STRUCT<title: STRING, level: SMALLINT, page_start: INT, page_end: INT>>"
CANDIDATE = (
    "query STRING, source_chunk_id BIGINT, source_product STRING, source_doc_title STRING, "
    "source_section_title STRING, generation_model STRING"
)
QUERY = (
    "query STRING, expect_any ARRAY<STRING>, expect_product STRING, "
    "expect_any_of_chunk_ids ARRAY<BIGINT>"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a catalog file, with ``generated_at``.

    Names match without case, unknown ones are ignored. A missing file or one
    that holds no catalog raises.
    """
    lower = lambda m: F.transform_keys(m, lambda k, _: F.lower(k))
    whole = spark.read.text(path, wholetext=True).select(
        lower(F.from_json("value", "map<string,string>")).alias("c")
    )
    held = whole.select(
        F.to_timestamp(F.col("c")["generated_at"]).alias("generated_at"),
        F.from_json(F.col("c")["documents"], "array<map<string,string>>").alias("documents"),
    )
    if held.where("documents is not null").isEmpty():
        raise ValueError(f"{path} holds no catalog")
    entry = F.col("e")
    columns = []
    for name, kind in (x.split(" ", 1) for x in ENTRY.split(", ")):
        value = entry[name]
        value = F.from_json(value, kind) if kind.startswith("ARRAY") else value.try_cast(kind)
        columns.append(value.alias(name))
    return held.select("generated_at", F.explode("documents").alias("d")).select(
        "generated_at", lower(F.col("d")).alias("e")
    ).select("generated_at", *columns)


def _as_struct(ddl: str) -> str:
    return ", ".join(x.replace(" ", ": ", 1) for x in ddl.split(", "))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of whole files, lower-case hex."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.sha2("content", 256).alias("sha256")
    )


def _relative(c: str, base: str) -> F.Column:
    path = F.url_decode(F.regexp_replace(F.replace(F.col(c), F.lit("+"), F.lit("%2B")), "^file:/+", "/"))
    return F.replace(path, F.lit(base.rstrip("/") + "/"), F.lit(""))


def read_texts(spark: SparkSession, base: str, folder: str) -> DataFrame:
    """``(path, text)`` of the files under ``base/folder``, path from ``base``."""
    return (
        spark.read.text(f"{base}/{folder}", wholetext=True, recursiveFileLookup=True)
        .select(F.input_file_name().alias("file"), F.col("value").alias("text"))
        .select(_relative("file", base).alias("path"), "text")
    )


def with_markdown(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries with the text of their Markdown file; null where it is missing."""
    path = F.replace(F.col("md_path"), F.lit("\\"), F.lit("/"))
    named = entries.withColumn("_path", path)
    return named.join(texts.withColumnRenamed("path", "_path"), "_path", "left").drop("_path")


def with_section_lists(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Entries with ``listed``, the sections of their JSON file.

    A file that is missing or corrupt gives null and never an error.
    """
    parsed = texts.select(
        F.col("path").alias("_path"), F.from_json("text", SECTIONS).getField("sections").alias("listed")
    )
    path = F.replace(F.col("json_path"), F.lit("\\"), F.lit("/"))
    return entries.withColumn("_path", path).join(parsed, "_path", "left").drop("_path")


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """Queries of an evaluation file, version 1 or 2, numbered from 0."""
    schema = f"version INT, queries ARRAY<STRUCT<{_as_struct(QUERY)}>>"
    return (
        spark.read.schema(schema)
        .json(path, multiLine=True)
        .select("version", F.posexplode("queries").alias("query_id", "q"))
        .select("version", F.col("query_id").cast("bigint").alias("query_id"), "q.*")
    )


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank lines are skipped, a malformed one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines of JSON without null fields; ``append`` keeps a history."""
    df.write.mode(mode).json(path)
