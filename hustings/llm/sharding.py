"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import documents, materialize, private_names, ranked, salt, salts_for


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places on the ring of 64-bit numbers, ascending, and the shard of each: ``nodes`` of each shard, by a hash of shard and node."""
    points = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(nodes))
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def plan_arcs(counts: np.ndarray, owners: np.ndarray, shards: int) -> np.ndarray:
    """Rows (arc, first rank, shard, first slot): where the keys of each arc of the ring go, by their rank in the arc.

    A shard takes keys of its own arcs while it has room; what is over goes on clockwise to the next node whose shard has room. Rooms sum to
    the number of keys and differ by one at most, so all are filled.
    """
    total = int(counts.sum())
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    used, rows, over = np.zeros(shards, dtype=np.int64), [], []

    def give(arc: int, first: int, n: int, shard: int) -> int:
        n = min(n, int(room[shard] - used[shard]))
        if n:
            rows.append((arc, first, shard, int(used[shard])))
            used[shard] += n
        return n

    for arc, (n, shard) in enumerate(zip(counts.tolist(), owners.tolist(), strict=True)):
        if taken := n - give(arc, 0, n, shard):
            over.append((arc, n - taken, taken))
    for arc, first, n in over:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            taken = give(arc, first, n, int(owners[at]))
            first, n = first + taken, n - taken
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


@private_names
def shard_rows(df: DataFrame, key: str, shards: int = 40, nodes: int = 128) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (from 0 without gaps in each shard). Counts of shards differ by one at most.

    A row's key hashes to a point of the ring and belongs to the next node clockwise, or beyond it where that shard is full. The driver sees one
    count for each arc of the ring (shards x nodes of them, whatever the data); rows are ranked within their arc, in salted groups. A null key
    is a key. Rows with equal keys share an arc, and are ranked about 100,000 at a time however many they are. Another number of shards moves only the arcs that the new nodes cut and what overflows.
    ``df`` is used twice: it should be materialized. Columns named shard or slot are replaced, all others pass through. An empty table gives an
    empty one.
    """
    spark = df.sparkSession
    points, owners = ring(shards, nodes)
    where = spark.sparkContext.broadcast(points)

    @F.pandas_udf("int")
    def arc_of(hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(where.value, hashes.to_numpy(np.int64)) % len(where.value))

    others = [c for c in df.columns if c not in ("shard", "slot")]
    arcs = materialize(df.select(*others, arc_of(F.xxhash64(key)).alias("__arc"), salt(salts_for(df.count()), *others).alias("__salt")))
    counts = np.zeros(len(points), dtype=np.int64)
    for arc, n in arcs.groupBy("__arc").count().collect():
        counts[arc] = n
    plan = plan_arcs(counts, owners, shards)
    shared = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan))

    @F.pandas_udf("shard int, slot bigint")
    def place(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = shared.value
        number = rank.to_numpy(np.int64)
        row = rows[np.searchsorted(keys, arc.to_numpy(np.int64) << 44 | number, side="right") - 1]
        return pd.DataFrame({"shard": row[:, 2].astype(np.int32), "slot": row[:, 3] + number - row[:, 1]})

    numbered = ranked(arcs, ["__arc"], ["__salt"], others, "__rank")
    return numbered.withColumn("__at", place("__arc", "__rank")).select(*others, "__at.shard", "__at.slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards with as many rows each, or one more."""
    text = F.coalesce("text", F.lit(""))
    slim = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(slim, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
