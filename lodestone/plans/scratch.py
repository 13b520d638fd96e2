"""Cut points of long plans, kept where every executor can read them again.

A cut point is a Parquet table below the folder named by ``spark.checkpoint.dir``.
It survives the loss of any executor, keeps column statistics, and is removed when
the Python process ends or when :func:`release` is called.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_live: dict[str, weakref.ref] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the cut points go."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _live[path] = weakref.ref(spark)
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> set[str]:
    """The cut points there are now; see :func:`release`."""
    return set(_live)


def release(keep: set[str] | None = None) -> None:
    """Delete every cut point that this process has written, but for those in ``keep``."""
    for path, ref in list(_live.items()):
        if keep and path in keep:
            continue
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone at interpreter exit
            pass
        _live.pop(path, None)


atexit.register(release)
