"""Session settings and the shared folder used for staged tables."""

from __future__ import annotations

import functools
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# One row per input split or per write task; about 150 bytes each.
MAX_BROADCAST_ROWS = 1_000_000
# Weights travel to every executor, so their size is checked before each use.
MAX_MODEL_BYTES = 1 << 30


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings this package is tested with."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="labelvec-code-")) / "labelvec.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="labelvec-")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``.

    A machine-local folder stands in only for a local session that sets none;
    on a cluster the executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/labelvec/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Whatever depends on task layout (partition ids, row positions) is fixed by
    the write, so retries and lost executors cannot change it later.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; larger frames join by shuffle."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
