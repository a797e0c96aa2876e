"""Readers and writers of tables as text files, with the quirks that such files have."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import types as T

from hustings.operators.checks import require_columns
from hustings.shared import materialize


def _records(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Rows (record): the records of text files but for the first of each file, cut where a line ends outside of quotes; an open quote runs to the end.

    Spark deals a file's lines in splits, which it names in the lines' metadata. First the quotes of each split are counted, and summed along the file:
    that tells which splits begin inside of quotes. Then each split cuts its own lines into records, in order. What began in a split before, or goes
    on in the next, is put together at the end: two pieces a split, so a file of any size is many tasks, and a record may be longer than a split.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    split = F.xxhash64("file", "start")
    if multi_line:
        counts = lines.groupBy("file", "start").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("n"))
        before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        found = sorted((h, bool(odd)) for h, odd in counts.select(split, F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).collect())
        known = spark.sparkContext.broadcast((np.array([h for h, _ in found], dtype=np.int64), np.array([odd for _, odd in found], dtype=bool)))

    def inside(h: int) -> bool:
        if not multi_line:
            return False
        keys, odd = known.value
        at = int(np.searchsorted(keys, h))
        if at == len(keys) or keys[at] != h:
            raise ValueError("the file was split otherwise when its quotes were counted; read it again")
        return bool(odd[at])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("kind", pa.string())])
        now, open_, pending, head, first, place = None, False, [], False, False, None

        def close(last: bool) -> tuple | None:
            """The record that is pending, as a row; none for a file's first."""
            row = None
            if pending or head:
                kind = "head" if head else "tail" if last and open_ else None
                if first and kind is None:
                    return None
                row = ("\n".join(pending), *(place if kind else (None, None)), "first" if first and kind == "tail" else kind)
            return row

        for batch in batches:
            rows = []
            values, splits = batch.column(0), batch.column(3).to_numpy(zero_copy_only=False)
            quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2 if multi_line else np.zeros(len(values), dtype=np.int64)
            for i, (text, h) in enumerate(zip(values.to_pylist(), splits.tolist(), strict=True)):
                if h != now:
                    rows.append(close(True))
                    now, place = h, (batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                    open_ = head = inside(h)
                    pending, first, fresh = [], place[1] == 0, True
                    if open_:
                        first = fresh = False
                else:
                    fresh = False
                if not open_ and not fresh:
                    rows.append(close(False))
                    pending, head, first = [], False, False
                pending.append(text)
                open_ ^= bool(quotes[i])
            rows = [r for r in rows if r is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        row = close(True)
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, schema.types, strict=True)], schema=schema)

    made = lines.withColumn("split", split).mapInArrow(cut, "record string, file string, start long, kind string")
    if not multi_line:
        return made.select("record")
    # pieces of records that lie in several splits: a tail, then the heads of the splits that follow
    made = materialize(made)
    order = Window.partitionBy("file").orderBy("start", F.col("kind") != "head")
    pieces = made.filter("kind is not null").withColumn("n", F.sum((F.col("kind") != "head").cast("int")).over(order))
    whole = pieces.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("p"), F.bool_or(F.col("kind") == "first").alias("first"))
    joined = whole.filter(~F.col("first")).select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return made.filter("kind is null").select("record").unionByName(joined)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, required: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """A table with a header: quoted cells may hold commas, newlines and doubled quotes; lines end in LF or CRLF; a BOM is skipped.

    Without a schema all columns are text. Short rows are filled with nulls, empty cells are null, and a blank row stays as a row of nulls (only
    the end of the last line makes no row). Missing ``required`` columns are an error. The first record of each file is its header.

    Large files are split among tasks. With ``multi_line`` their quotes are counted first, to know which splits begin inside of a cell, so files are read
    twice, and records written once; without it every line is a record.
    """
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    names = [c.lstrip("\ufeff").rstrip("\r").strip() for c in spark.read.options(**options).option("header", True).option("multiLine", multi_line).csv(path).columns]
    if schema is None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    record = F.regexp_replace("record", "\r?\n?\\z", "")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = _records(spark, path, multi_line).select(F.from_csv(record, ddl, options).alias("r")).select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields])
    return require_columns(rows, required or [], path)


def read_directory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every CSV of a folder by name, as text columns; the listing goes through Spark's own file system, whatever the path's scheme."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    listing = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(s.getPath().getName() for s in listing if s.getPath().getName().endswith(".csv"))
    return {n.removesuffix(".csv"): read_csv(spark, f"{path}/{n}") for n in names}


def with_source(df: DataFrame, name: str = "source_file") -> DataFrame:
    return df.withColumn(name, F.input_file_name())


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One header a file; cells are quoted only where they must be, quotes inside are doubled."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder with one folder of CSV for each sheet."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


#: The parts of an election manifest that are read; other fields may be there.
MANIFEST = (
    "election_id string, spectrums array<struct<id:string,name:string,color:string>>, parties array<struct<abbreviation:string,name:string,spectrum:string>>, "
    "seat_types array<struct<id:string,name:string,count:bigint,method:string,basis:string,results_file:string,threshold_pct:double,lists:array<struct<id:string,parties:array<string>>>>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def seat_types(manifest: DataFrame) -> DataFrame:
    return manifest.select("election_id", F.inline("seat_types"))


def parties_of_lists(manifest: DataFrame) -> DataFrame:
    """Rows (seat_type, list, party)."""
    lists = seat_types(manifest).select(F.col("id").alias("seat_type"), F.explode("lists").alias("l"))
    return lists.select("seat_type", F.col("l.id").alias("list"), F.explode("l.parties").alias("party"))


def results_of(spark: SparkSession, manifest: DataFrame, seat_type: str, folder: str) -> DataFrame:
    """The results table that the manifest names for a seat type."""
    found = seat_types(manifest).filter(F.col("id") == seat_type).select("results_file").limit(1).collect()
    if not found:
        raise ValueError(f"the manifest has no seat type {seat_type}")
    return read_csv(spark, f"{folder}/{found[0][0]}")


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(path)
