"""Session settings, the shared working folder and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g", **more: str) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster the launcher sets these."""
    spark = (
        SparkSession.builder.config(map=more).master(f"local[{cores}]")
        .appName("regelspur")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()
_own: dict[str, str] = {}
_homes: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application.

    Where they have it on their path already this changes nothing but where it is read from.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="regelspur-"), "regelspur")
        sc.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(home), os.path.basename(home)))
        _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the session's ``spark.checkpoint.dir``, else the one set on the context. Where neither is
    set, a session on one machine (tests) gets a folder of its own, once an application; on a cluster that is an error,
    for the machines would not see each other's files.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _own.get(sc.applicationId)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="regelspur-")
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` into the shared folder and read it back, so later steps start from the files.

    The files survive the loss of an executor, unlike blocks of a local checkpoint. They stay until the
    application ends, for frames that refer to them may live as long; ``clear`` removes them earlier.
    """
    spark = df.sparkSession
    home = _home(spark)
    path = f"{home}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _home(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the interpreter ends."""
    sc = spark.sparkContext
    home = f"{shared_dir(spark)}/regelspur/{sc.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_leave, spark, home)
    return home


def _leave(spark: SparkSession, home: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, home)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete what ``cut`` has written for this application; frames made of it can no longer be read."""
    _delete(spark, _home(spark))


def fits(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; looks at no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] <= limit
