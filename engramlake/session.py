"""A session with the settings that results depend on, and adaptive execution."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPING = threading.Lock()


def session(master: str | None = None, shuffle_partitions: int | None = None, name: str = "engramlake") -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def _shared(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share; a local session without it gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/engramlake-{spark.sparkContext.applicationId}"


_SCOPE = threading.local()


def scratch(spark: SparkSession) -> str:
    """A new folder for a table in between, within the scope that this thread is in."""
    inner = getattr(_SCOPE, "name", None)
    return "/".join([_shared(spark), *([inner] if inner else []), uuid.uuid4().hex])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables in between that this thread makes within are deleted at the end, those of other queries that run are not. Results must be written by then."""
    outer = getattr(_SCOPE, "name", None)
    _SCOPE.name = f"{outer}/{uuid.uuid4().hex}" if outer else f"scope-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        _delete(spark, f"{_shared(spark)}/{_SCOPE.name}")
        _SCOPE.name = outer


def clean(spark: SparkSession) -> None:
    """Deletes all tables in between of this application, whichever query made them; ``scope`` spares others."""
    _delete(spark, _shared(spark))


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here and lost executors lose nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """df, written, and to be broadcast if it has at most so many rows (of a few numbers)."""
    out = written(df)
    return F.broadcast(out) if out.count() <= bound else out


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once in a session, so that functions defined in it can run there."""
    sc = spark.sparkContext
    with _SHIPPING:
        if getattr(sc, "_engramlake_sent", False):
            return
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp()).resolve() / f"{root.name}.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(out))
        sc._engramlake_sent = True
