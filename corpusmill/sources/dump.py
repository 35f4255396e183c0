"""A corpus as a folder of plain tables with digests, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.sources.store import Store


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """``(file, sha256)`` of all table files below ``path``."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    held = held.option("pathGlobFilter", "*.parquet").load(f"{path}/tables")
    return held.select(
        F.regexp_extract("path", r"/tables/(.+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256")
    )


def dump(store: Store, path: str, tables: tuple[str, ...] = ("documents", "chunks", "ingest_runs", "outcomes")) -> str:
    """Write the current version's ``tables`` to ``path``; the digest of all.

    Each file's digest is a line of ``digests``; the digest of all is over
    these lines in order.
    """
    for name in tables:
        df = store.read(name)
        if df is not None:
            df.write.parquet(f"{path}/tables/{name}")
    found = _digests(store.spark, path)
    found.coalesce(1).orderBy("file").write.json(f"{path}/digests")
    return whole(store.spark.read.schema("file string, sha256 string").json(f"{path}/digests"))


def whole(digests: DataFrame) -> str:
    """One digest of a list of files, whatever the order of its rows."""
    line = F.concat_ws(" ", "file", "sha256")
    joined = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return digests.agg(F.sha2(joined, 256).alias("d")).first()["d"]


def restore(spark: SparkSession, path: str, store: Store, digest: str | None = None) -> int:
    """Make the dump at ``path`` the store's next version; its number.

    A file that is missing, changed or not listed, or another ``digest`` than
    the one given, raises before anything is written. Indexes are not dumped:
    the store has none until they are built again.
    """
    listed = spark.read.schema("file string, sha256 string").json(f"{path}/digests")
    found = _digests(spark, path)
    bad = listed.join(found.withColumnRenamed("sha256", "now"), "file", "full_outer").where(
        "not (sha256 <=> now)"
    )
    wrong = [r["file"] for r in bad.select("file").limit(5).collect()]
    if wrong:
        raise ValueError(f"{path} is damaged: {', '.join(wrong)}")
    if digest is not None and digest != whole(listed):
        raise ValueError(f"{path} has another digest than {digest}")
    names = listed.select(F.split("file", "/")[0].alias("t")).distinct().collect()
    return store.commit(replace={r["t"]: spark.read.parquet(f"{path}/tables/{r['t']}") for r in names})
