"""Helpers shared by the training-data operators: salts, and ranks inside groups of any size."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from hustings.shared import materialize  # noqa: F401  used by the operators through this module

#: The six characters that separate words and are stripped from lines. ``bytes.split()`` and ``bytes.strip()`` use the same six.
SPACE = " \t\n\x0b\x0c\r"
#: A key with more than one in so many of all rows is dealt to several tasks.
SHARE = 1000


def slices(batches: Iterator[pa.RecordBatch], texts: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about ``size`` bytes in the column number ``texts``, one row at least: what a task makes of a run is bounded
    by that, whatever the number of rows in a batch; a longer text is a run of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(lengths) - 1) // size)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def private_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Keep the caller's columns apart from an operator's own, whose names begin with two underscores.

    Columns of the first argument that begin so have other names inside: they are renamed on the way in and back on the way out. Arguments that
    name such a column are renamed too; a Column that refers to one is not, and fails.
    """

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        inner = {}
        for c in df.columns:
            if c.startswith("__"):
                name = f"caller{c}"
                while name in df.columns or name in inner.values():
                    name = "x" + name
                inner[c] = name
        if not inner:
            return operator(df, *args, **named)
        bound = inspect.signature(operator).bind(df, *args, **named)
        rename = lambda v: inner.get(v, v) if isinstance(v, str) else tuple(map(rename, v)) if isinstance(v, tuple) else v
        values = {k: rename(v) for k, v in bound.arguments.items()}
        values[next(iter(values))] = df.withColumnsRenamed(inner)
        return operator(**values).withColumnsRenamed({v: k for k, v in inner.items()})

    return run


def set_apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that no operator uses, and what each column is called now: a stage returns all columns as they were."""
    names = {c: f"doc{i}_{c}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def put_back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def join_counted(many: DataFrame, few: DataFrame, keys: list[str], n: str, spread: str, how: str = "inner") -> DataFrame:
    """Join ``many`` with ``few``, which has a row for a key and in ``n`` how many rows of ``many`` have that key; keys are not null.

    A key with more than one in SHARE of all rows is dealt to as many tasks as it has such shares, by a hash of ``spread``, and its row of ``few``
    is repeated for each of them. There are SHARE such keys at most, since their rows sum to the whole: that is what is sent to all executors.
    ``few`` should be materialized.
    """
    limit = max(1, (few.agg(F.sum(n)).first()[0] or 0) // SHARE)
    parts = F.when(F.col(n) > limit, F.ceil(F.col(n) / limit).cast("int")).otherwise(1)
    hot = few.filter(F.col(n) > limit).select(*keys, parts.alias("__parts"))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.xxhash64(spread), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    repeated = few.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(repeated, [*keys, "__part"], how).drop("__part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def salt(parts: int, *columns: Column | str) -> Column:
    """A number from 0 to parts - 1 that depends on the columns alone, so that a task that runs again gives the same."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def salts_for(rows: int, per_task: int = 100_000, least: int = 64) -> int:
    """How many salts split a key that may hold all of ``rows`` into groups of about ``per_task``."""
    return max(least, -(-rows // per_task))


def ranked(df: DataFrame, keys: list[str], buckets: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Add ``rank``: the place from 0 of each row among the rows with the same ``keys``, ordered by ``buckets``, then ``order``.

    Rows are counted by (keys, buckets) first, and the counts summed along the buckets of a key; rows are then numbered inside their bucket
    only. So a key that holds a third of all rows is numbered by as many tasks as it has buckets, and no window sees more than a bucket.
    ``df`` is used twice, so it should be materialized. Rows that tie in all of ``order`` should be alike.
    """
    by = [*keys, *buckets]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    joined = df.join(bases, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in by], "left")
    within = Window.partitionBy(*by).orderBy(*order)
    return joined.select(*df.columns, (F.col("__base") + F.row_number().over(within) - 1).alias(rank))
