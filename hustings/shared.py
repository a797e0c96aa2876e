"""Tables kept in the folder that all executors share, to cut lineage and to compute once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Local sessions without spark.checkpoint.dir (tests on one machine) share this folder; it is made on first use.
_own_folder: list[str] = []
#: What was written so far, for :func:`release`.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local session gets one of this process's own; a cluster is an error.

    Executors on other machines would write a temporary folder of this machine each on its own disk, and the driver would read a part of it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="hustings-"))
    return _own_folder[0]


def new_folder(spark: SparkSession) -> str:
    """The name of a folder, not yet there, inside the shared one."""
    _written.append(f"{shared_folder(spark)}/hustings-{uuid.uuid4().hex}")
    return _written[-1]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it as read back.

    Cuts the lineage: what is read later survives the loss of any executor, and is computed once. The files stay until :func:`release`.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` to be joined by shuffles, never by sending it out whole.

    Spark takes rows made by ``explode`` or text that is made in the plan for as few bytes as the columns of the file that they come from, and files for
    as large as they are compressed: what it then sends out fills the driver. Use it where both sides of a join grow with the input.
    """
    return df.hint("merge")


def spread(df: DataFrame, key: str | list[str], rows: int = 50_000) -> DataFrame:
    """``df`` dealt by ``key``, one column or several, to a task for every so many rows. A file of a few narrow columns is one split, however much work its rows make."""
    return df.repartition(max(1, -(-df.count() // rows)), *([key] if isinstance(key, str) else key))


def written() -> int:
    """How many folders this process has written so far and not released: a mark for :func:`release`."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete what this process has written into the shared folder since a mark, all by default, but for the last ``keep`` folders; return how many that were.

    Results that are still to be read depend on these tables: write or collect them first.
    """
    jvm, done = spark.sparkContext._jvm, 0
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        done += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return done
