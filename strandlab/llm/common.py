"""Shared helpers: shared-folder staging, table loading, Arrow batches, row hashes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regex of a word of the mixing and quality contracts.
WORD = r"[^\x20\x09-\x0D]+"

_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch at most, the same for every operator, so that plans built earlier aren't changed.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that long texts don't pile up in a worker.

    Also lets Python workers on this machine import the package wherever the driver was started.
    """
    paths = spark.sparkContext.environment
    if _HOME not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH"), _HOME]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="strandlab-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def temporary(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, deleted at the end of the application."""
    path = f"{shared_root(spark)}/strandlab-{label}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and return the written table.

    Cuts lineage without depending on any one executor: a lost executor costs only its running tasks.
    The table lives until discard() or the end of the application.
    """
    spark = df.sparkSession
    path = temporary(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandlab_path = path  # noqa: SLF001
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001
    except Exception:  # noqa: BLE001  the application may be ending
        if path.startswith("file:///tmp/strandlab-"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_strandlab_path", None)
        if path:
            _delete(t.sparkSession, path)
            _STAGED[:] = [x for x in _STAGED if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _STAGED:
        _delete(spark, path)


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def parts_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns of a row; nulls count, maps by their JSON form."""
    values = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(F.lit(seed), *(v for c in values for v in (c, c.isNull())))


def starts(counts: DataFrame, order: str, n: str) -> DataFrame:
    """counts (one row a range, so as many as there are partitions) with start: the rows of all ranges before."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum(n).over(before), F.lit(0)))
