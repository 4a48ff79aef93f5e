"""Session helpers: settings every plan relies on, table access and scratch tables that survive lost executors."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Every table of the driver's data set.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_scratch: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def build(master: str = "local[*]", app: str = "quarry", **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for; `conf` overrides by Spark key with `__` for a dot."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application: their Python may not have it on its path."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    _shipped.add(context.applicationId)
    path = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Only Spark's reader touches the path, so any store Spark knows will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The tables of a folder, sorted: its entries called <name>.parquet, listed through Spark's file systems."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in found]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for the named tables (all of them by default)."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a local one where that is unset and all runs on one machine (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/checkpoints/quarry-{os.getpid()}"
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes with `clean`."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str = "zstd") -> DataFrame:
    """`df` written to the shared folder and read back: cuts lineage, and later stages survive a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(session: SparkSession, path: str) -> None:
    _scratch.remove((session, path))
    p = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a table that `written` made, once nothing that is still to run reads it."""
    path = getattr(df, "_scratch_path", None)
    if path and (df.sparkSession, path) in _scratch:
        _delete(df.sparkSession, path)


def clean(spark: SparkSession | None = None) -> None:
    """Delete the scratch tables written so far (of one session, or all); frames that read them must be done."""
    for session, path in [x for x in _scratch if spark is None or x[0] is spark]:
        try:
            _delete(session, path)
        except Exception:  # the session may be gone at exit
            continue


atexit.register(clean)
