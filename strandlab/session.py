"""Sessions, tables and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the library is tuned for; conf: further settings, dots as double underscores."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).config(map=base).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_python(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was started."""
    paths = spark.sparkContext.environment
    if _HOME not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH"), _HOME]))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="strandlab-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/strandlab-{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001
        except Exception:  # noqa: BLE001  the JVM may be gone
            if path.startswith("file:///tmp/strandlab-"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet into the shared folder; cuts lineage."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Below so many bytes a core, rows are dealt out anew before costly work: small tables come as one row group, one task.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its input is small; as it is beyond, where files alone give tasks enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # noqa: SLF001
    return df.repartition(cores) if size < SMALL * cores else df
