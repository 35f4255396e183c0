"""Versions of the corpus tables on a shared file system.

A version is one small manifest that lists, per table, the folders it is made
of. Tables with a key are kept in buckets of its hash: a change rewrites the
buckets that it touches and the manifest takes over the folders of the others;
other tables are appended to or replaced. Writers put their data into folders
of their own and create the next manifest last, which fails if another writer
was first. Readers see one version or the next, a lost job leaves nothing but
folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Key of each table that is kept in buckets.
KEYS = {"documents": "id", "chunks": "document_id", "postings": "term", "freq": "term",
        "vectors": "cell"}
BUCKETS = 64


def _number(path: str) -> int:
    return int(path.rsplit("=", 1)[1])


class ConcurrentWrite(RuntimeError):
    """Another writer made the next version first; read again and repeat."""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._asked: tuple[DataFrame, set[int]] | None = None
        self.buckets = (self._manifest() or {}).get("buckets", buckets)

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.conf)

    def versions(self) -> list[int]:
        """Numbers of all versions, in order."""
        if not self._fs().exists(self._path(self.root)):
            return []
        names = [str(f.getPath().getName()) for f in self._fs().listStatus(self._path(self.root))]
        return sorted(
            int(n[8:-5]) for n in names if n.startswith("version-") and n.endswith(".json")
        )

    def current(self) -> int | None:
        """Number of the version that counts, None in an empty store."""
        return max(self.versions(), default=None)

    def _manifest(self, number: int | None = None) -> dict | None:
        n = self.current() if number is None else number
        if n is None:
            return None
        stream = self._fs().open(self._path(f"{self.root}/version-{n}.json"))  # no job for one small file
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _frame(self, held: dict) -> DataFrame | None:
        paths = [f"{self.root}/{p}" for p in held["paths"]]
        if not paths:
            return self.spark.createDataFrame([], held["schema"])
        return self.spark.read.schema(held["schema"]).parquet(*paths)

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame | None:
        """A table of the current version, None if there is none.

        With ``keys`` (one column) only the buckets that hold them.
        """
        held = (self._manifest() or {"tables": {}})["tables"].get(table)
        if held is None:
            return None
        if keys is not None and table in KEYS:
            wanted = self._buckets(keys)
            held = held | {"paths": [p for p in held["paths"] if _number(p) in wanted]}
        return self._frame(held)

    def _buckets(self, keys: DataFrame) -> set[int]:
        """The buckets of ``keys``; at most as many as the store has."""
        if self._asked is not None and self._asked[0] is keys:
            return self._asked[1]
        number = self.bucket(F.col(keys.columns[0]))
        self._asked = keys, {r[0] for r in keys.select(number).distinct().collect()}
        return self._asked[1]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, df: DataFrame) -> dict:
        """Write ``df`` into new folders; its entry of a manifest."""
        folder = f"data/{table}-{uuid.uuid4().hex}"
        key = KEYS.get(table)
        if key is None:
            df.write.parquet(f"{self.root}/{folder}")
            return {"paths": [folder], "schema": df._jdf.schema().toDDL()}
        order = [c for c in (key, "chunk_index") if c in df.columns]
        (
            df.withColumn("_bucket", self.bucket(F.col(key)))
            .repartition("_bucket")
            .sortWithinPartitions("_bucket", *order)
            .write.partitionBy("_bucket")
            .parquet(f"{self.root}/{folder}")
        )
        listed = self._fs().listStatus(self._path(f"{self.root}/{folder}"))
        names = sorted(str(f.getPath().getName()) for f in listed)
        paths = [f"{folder}/{n}" for n in names if n.startswith("_bucket=")]
        return {"paths": paths, "schema": df._jdf.schema().toDDL()}

    def commit(
        self,
        replace: dict[str, DataFrame] | None = None,
        append: dict[str, DataFrame] | None = None,
        upsert: dict[str, tuple[DataFrame, DataFrame]] | None = None,
    ) -> int:
        """Make the next version: its number.

        ``upsert``: per table with a key, the rows that are new, and the keys
        (a column of the key's name) whose stored rows go. Only buckets of
        either are read and written. Frames that depend on the store's own
        tables may be given, since no folder of a version is changed.
        """
        before = self.current()
        old = self._manifest(before) or {"tables": {}, "buckets": self.buckets}
        tables = dict(old["tables"])
        for table, df in (replace or {}).items():
            tables[table] = self._write(table, df)
        for table, df in (append or {}).items():
            new, held = self._write(table, df), tables.get(table, {"paths": []})
            tables[table] = new | {"paths": held["paths"] + new["paths"]}
        for table, (rows, gone) in (upsert or {}).items():
            key, held = KEYS[table], tables.get(table)
            if held is None:
                tables[table] = self._write(table, rows)
                continue
            keys = rows.select(key).unionByName(gone.select(key)).distinct()
            touched = self._buckets(keys)
            mine = held | {"paths": [p for p in held["paths"] if _number(p) in touched]}
            kept = self._frame(mine).join(keys, key, "left_anti")
            new = self._write(table, kept.unionByName(rows, allowMissingColumns=True))
            others = [p for p in held["paths"] if _number(p) not in touched]
            tables[table] = new | {"paths": others + new["paths"]}
        n = (before or 0) + 1
        staged = self._path(f"{self.root}/data/manifest-{uuid.uuid4().hex}")
        out = self._fs().create(staged, False)
        out.write(bytearray(json.dumps({"tables": tables, "buckets": old["buckets"]}).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.conf)
        never = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, self._path(f"{self.root}/version-{n}.json"), never)
        except Exception as error:
            if self._fs().exists(self._path(f"{self.root}/version-{n}.json")):
                raise ConcurrentWrite(f"version {n} of {self.root} was made by another writer") from error
            raise
        return n

    def drop_before(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions and the folders only they name."""
        numbers = self.versions()
        old, kept = numbers[: len(numbers) - keep], numbers[len(numbers) - keep :]
        named = lambda ns: {p for n in ns for t in self._manifest(n)["tables"].values() for p in t["paths"]}
        gone = named(old) - named(kept)
        for n in old:
            self._fs().delete(self._path(f"{self.root}/version-{n}.json"), False)
        for path in gone:
            self._fs().delete(self._path(f"{self.root}/{path}"), True)
