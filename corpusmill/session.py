"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a union's claimed partitioning does not survive the coalescing of its inputs
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "corpusmill", master: str | None = None, **extra: str
) -> SparkSession:
    """A session with the library's defaults; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per context.

    Functions that run in Python workers are sent by name, so workers must be
    able to import it wherever they run.
    """
    context = spark.sparkContext
    if not getattr(context, "_corpusmill_shipped", False):
        package = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="corpusmill-")) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(path))
        context._corpusmill_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master may go without the setting: then the driver's temporary
    folder serves, since driver and executors are the same machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    existing = jsc.getCheckpointDir()
    if existing.isDefined():
        return existing.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, path)
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the plan once. The
    files are replicated storage of the cluster, so a lost executor costs
    nothing that was written. They are removed when the driver ends, or
    earlier by :func:`release`.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._corpusmill_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing will read again."""
    for df in frames:
        path = getattr(df, "_corpusmill_path", None)
        if path:
            delete(df.sparkSession, path)
