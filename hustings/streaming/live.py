"""A tally that keeps up with rows as they arrive, change and are corrected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hustings.functions import status as st
from hustings.operators.methods import TRANSFERS, supplementary_vote, with_certainty


def read_rows(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def deltas(rows: DataFrame, row_id: str, keys: list[str], measures: dict[str, Column], event_time: str, delay: str = "1 day", buckets: int = 1024) -> DataFrame:
    """A streaming table (keys, measures) of what each batch adds to the sums of ``measures`` and takes back from them.

    A row is known by ``row_id``; each time that it comes it is a new version, and only its last one counts: the one with the latest ``event_time``,
    of equals the one with the greater measures, then keys. What the version before had given is taken back, also from other keys if it has moved. A version
    that comes twice, or after a later one, changes nothing; versions older than the watermark, which is the latest event of the batches before
    less the ``delay``, are left out. Rows without an id or a time are left out; a null measure counts 0.

    State is the last version of each row, for as long as the query runs, since a correction may come at any time. Rows are kept in ``buckets`` by a
    hash of their id, and a batch reads and writes the buckets that it touches: take about a bucket for every 4,000 rows on the
    roster where batches touch most of it (calling Python for a bucket costs as much as some hundred rows), fewer rows where batches are small.
    """
    names = list(measures)
    known = rows.filter(F.col(event_time).isNotNull() & F.col(row_id).isNotNull()).withWatermark(event_time, delay)
    slim = known.select(F.pmod(F.xxhash64(row_id), F.lit(buckets)).alias("_bucket"), F.col(row_id).alias("_id"), F.col(event_time).alias("_when"), F.unix_micros(F.col(event_time).cast("timestamp")).alias("_at"), *keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in measures.items()])
    types = dict(slim.dtypes)

    def apply(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(frames).drop(columns=["_bucket", "_when"])
        new = new[new["_at"] > state.getCurrentWatermarkMs() * 1000]
        old = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new.iloc[:0]
        last = pd.concat([old, new], ignore_index=True).sort_values(["_id", "_at", *names, *keys]).drop_duplicates("_id", keep="last")
        table = pa.Table.from_pandas(last, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        back = old[old["_id"].isin(new["_id"])]
        again = last[last["_id"].isin(new["_id"])]
        change = pd.concat([again[[*keys, *names]], back[keys].join(-back[names])]).groupby(keys, dropna=False, as_index=False).sum()
        yield change[(change[names] != 0).any(axis=1)]

    out = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *names])
    return slim.groupBy("_bucket").applyInPandasWithState(apply, out, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)


def declarations_per(rows: DataFrame, width: str, event_time: str = "declared_at", delay: str = "1 day") -> DataFrame:
    """A streaming count of declarations for each stretch of time; a stretch is final once the watermark has passed it."""
    return rows.filter(F.col(event_time).isNotNull()).withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("window")).agg(F.count(F.lit(1)).alias("n"))


def seat_measures(state: str = "status") -> dict[str, Column]:
    """What a version of a result row gives to its seat: votes once it is declared, its turnout from counting on, its electorate always; and the votes
    that may still come from it: none if declared, the turnout if counting, else the electorate."""
    declared, electorate = F.col(state) == st.DECLARED, F.col("Electorate")
    pool = F.when(declared, 0).when(F.col(state) == st.COUNTING, F.col("Turnout")).otherwise(electorate)
    votes = {c: F.when(declared, F.col(c)) for c in (*TRANSFERS, "Spoil")}
    return {"n_rows": F.lit(1), "n_declared": declared.cast("int"), "Electorate": electorate, "Turnout": F.when(st.at_least(state, st.COUNTING), F.col("Turnout")), "undecided": pool, **votes}


def decided(sums: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """Winner and certainty of running sums with ``undecided``. ``roster`` has each seat's whole electorate (keys, all_electorate): what of it no row
    has come from may still vote too."""
    known = sums.join(roster, keys, "left").withColumn("undecided", F.col("undecided") + F.greatest(F.lit(0), F.coalesce("all_electorate", "Electorate") - F.col("Electorate")))
    return with_certainty(supplementary_vote(known.drop("all_electorate")))


def _version(folder: str, number: int) -> str:
    return f"{folder}/totals/batch={number:09d}"


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the totals that are whole, ascending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/totals/batch=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def run_totals(changes: DataFrame, folder: str, keys: list[str]) -> str:
    """Add what is there to the totals in ``folder``, a batch at a time, and stop; called again, go on from there.

    Each batch writes the totals after it, which have a row for each seat, beside those before it; it reads those of the last batch before its
    own number, so that a batch that runs again replaces itself. The totals before the last two are deleted.
    """
    spark = changes.sparkSession
    names = [c for c in changes.columns if c not in keys]

    def write(batch: DataFrame, number: int) -> None:
        before = [n for n in _batches(spark, folder) if n < number]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(_version(folder, before[-1]))) if before else batch
        rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names]).write.mode("overwrite").parquet(_version(folder, number))
        for n in before[:-1]:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_version(folder, n))
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    query = changes.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return folder


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """The totals after the last whole batch."""
    return spark.read.parquet(_version(folder, _batches(spark, folder)[-1]))


def run_available(stream: DataFrame, folder: str, each: Callable[[DataFrame], DataFrame] | None = None, mode: str = "update") -> str:
    """Process what is there, a batch at a time, and stop; called again, go on from there. Batches go to ``folder``/out with their number; a batch that
    runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return f"{folder}/out"


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    rows = spark.read.parquet(path).drop("part")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("batch").desc()))).filter("_n = 1").drop("_n", "batch")
