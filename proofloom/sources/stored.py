"""Tables written once and read by several parts of a plan: an index is stored, not worked out again for each of its readers."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session without executors elsewhere may go without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own_folder()
    return f"{shared}/stored-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_stored(spark: SparkSession) -> None:
    """Delete all that this application stored, once its results are written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _BY_NAME.clear()


_BY_NAME: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make):
    """What ``make`` gives, made from a folder of tables at its first use in an application.

    It stands for the folder as it was then; ``discard_stored`` forgets it.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BY_NAME:
        _BY_NAME[key] = make()
    return _BY_NAME[key]


def stored_once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """The table ``name`` made from a folder of tables, stored at its first use."""
    return once(spark, sf_dir, name, lambda: stored(make()))
