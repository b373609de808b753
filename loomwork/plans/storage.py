"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder.  Only where it is unset and the
master is local (tests, a laptop) a temporary folder of this machine takes its
place; on a cluster without the setting nothing is written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Parquet options of plain tables.
PLAIN = {"parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20)}

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, with no slash at its end."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    path = f"{shared_dir(spark)}/loomwork/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """df as Parquet in the shared folder: lineage ends there, whole files survive lost executors. plain: values hardly repeat, so no dictionaries are tried, and row groups are small, as their buffers are."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.options(**PLAIN) if plain else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomwork_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written()."""
    for df in tables:
        path = getattr(df, "_loomwork_path", None)
        if path:
            remove(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; nothing is left to do then
            return


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
