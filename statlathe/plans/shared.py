"""Tables in the cluster's shared folder, and joins that stand a hot key."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this part of all rows; so there are at most 1 / HOT_PART hot keys.
HOT_PART = 0.001

_written: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set, else (only where driver and executors are
    one process, as in tests) a new folder of this process, which then becomes the session's setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.getCheckpointDir():
            return spark.sparkContext.getCheckpointDir()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="statlathe-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives the loss of executors and computes
    the plan once (``checkpoint`` computes it twice). ``drop_written`` removes a table; the rest go at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/statlathe-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    _written.append((hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop))
    out._statlathe_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Remove what ``written`` made, once nothing reads it any more."""
    path = getattr(df, "_statlathe_path", None)
    for item in [x for x in _written if path and x[1].toString().endswith(path.rsplit("/", 1)[1])]:
        item[0].delete(item[1], True)
        _written.remove(item)


@contextmanager
def scratch():
    """Tables that ``written`` makes inside are removed at the end, but for those handed to the function this yields.
    What is returned from inside must be such a table (or read nothing else)."""
    older, kept = list(_written), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._statlathe_path.rsplit("/", 1)[1])
        return df

    try:
        yield keep
    finally:
        for item in [x for x in _written if x not in older and x[1].getName() not in kept]:
            item[0].delete(item[1], True)
            _written.remove(item)


@atexit.register
def _clean() -> None:
    for fs, path in _written:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def salted_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, by: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``table`` on ``key``, where ``table`` has one row for each key and in ``weight`` the number of
    ``rows`` that hold it, out of ``total``.

    Hot keys (at most ``1 / HOT_PART`` of them, as weights sum to ``total``; that bound is why their list may be
    broadcast) are spread over as many salts as they hold multiples of ``HOT_PART``, by the column ``by``; their table
    rows are repeated once for each salt. Null keys match nothing and are spread likewise."""
    least = max(1.0, total * HOT_PART)
    parts = F.least(F.ceil(F.col(weight) / F.lit(least)), F.lit(int(1 / HOT_PART))).cast("int")
    hot = table.where(F.col(weight) > least).select(F.col(key).alias("_hot_key"), parts.alias("_parts"))
    spread = F.pmod(F.xxhash64(by), F.coalesce(F.col("_parts"), F.when(F.col(key).isNull(), F.lit(int(1 / HOT_PART))), F.lit(1))).cast("int")
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn("_salt", spread).drop("_hot_key", "_parts")
    right = table.withColumn("_salt", F.explode(F.when(F.col(weight) > least, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
