"""Best-fit packing by minimum bin slack: each bin gets the fullest combination of the lengths that are left."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import documents, materialize, private_names, ranked, salt, salts_for, slices

CAPACITY = 2048


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest that fits into ``room``; bit s of ``reach`` says that sum s can be had."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left, part = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            n = min(part, left)
            steps.append((length, n, reach))
            reach = (reach | reach << (length * n)) & mask
            left, part = left - n, part * 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + n
            total -= length * n
    return taken


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, first offset): the pieces of a length, in order of rank, go to bins by these.

    Takes the number of pieces of each length, so its size depends on ``capacity`` alone. Each bin holds the longest piece left and the fullest
    combination beside it; the same bin is repeated for as long as there are pieces for it.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used, rows, number = dict.fromkeys(left, 0), [], 0
    lengths = sorted(left, reverse=True)
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        need = fullest(lengths, left, capacity - longest)
        left[longest] += 1
        need[longest] = need.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in need.items()), 0
        for length, n in sorted(need.items(), reverse=True):
            rows.append((length, used[length], n, number, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
        number += times
        lengths = [k for k in lengths if left[k]]
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def tokenize_pieces(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, special: dict[str, int] | None = None, vocabulary: str | None = None) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): the pieces of each text's ids, closed by ``end_id``.

    A text of more than ``capacity`` ids is cut into pieces of that length, the first of which takes the rest. Null is the empty text: one piece.
    ``ranks`` is a byte-level BPE vocabulary file, ``pattern`` its word pattern. ``special`` has the added tokens: wherever such a string stands in
    a text it is that one id, and what lies between is encoded part by part. The word pattern's engine gives up on runs of about a million white-space
    characters; such a text is encoded by the tokenizers library from ``vocabulary``, the same vocabulary in its format, with the same ids. An
    empty table gives no pieces.
    """
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens=special or {})
        slow = []

        def encode(value: str) -> list[int]:
            try:
                return encoding.encode(value, allowed_special="all")
            except ValueError:
                if vocabulary is None:
                    raise
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(vocabulary))
                return slow[0].encode(value, add_special_tokens=False).ids

        for batch in slices(batches, 1):
            at, out = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(value or ""), end_id], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(row)
                    out.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[id_column, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


@private_names
def pack_pieces(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Lengths are 1 to ``capacity``.

    The driver sees one count for each length, at most ``capacity`` of them, and plans the bins; pieces are ranked within their length, in salted
    groups of about 100,000 at most, and find their bin in the plan by rank. Repeated rows are pieces of their own. An empty table gives an empty
    one. Columns named sequence_id or offset are replaced, all others pass through. ``pieces`` is used several times, so it should be materialized.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}
    plan = plan_bins(counts, capacity)
    shared = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan))
    salts = salts_for(sum(counts.values()))
    parts = ranked(pieces.withColumn("__salt", salt(salts, *order)), [length], ["__salt"], list(order), "__rank")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        keys, rows = shared.value
        size, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        row = rows[np.searchsorted(keys, size << 44 | rank, side="right") - 1]
        number, slot = np.divmod(rank - row[:, 1], row[:, 2])
        return pd.DataFrame({"sequence_id": row[:, 3] + number, "offset": row[:, 4] + slot * size})

    return parts.withColumn("__at", place(length, "__rank")).select(*pieces.columns, "__at.sequence_id", "__at.offset")


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of a vocabulary in the format of the tokenizers library."""
    with open(vocabulary, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def pack_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The pieces of all ``docs`` and their places; the vocabulary is the public one of 50k byte-level tokens unless another is named.

    The public vocabulary comes with its added tokens; one that is named has none. The result has a row for each piece, with the document's id and
    no other column of ``docs``. Null and empty texts are one piece of one id.
    """
    special = vocabulary = None
    if ranks is None or pattern is None:
        import public_tokenizers

        if ranks is None:
            vocabulary = public_tokenizers.path("byte_bpe_50k.json")
            special = added_tokens(vocabulary)
        ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return pack_pieces(materialize(tokenize_pieces(docs, ranks, pattern, special=special, vocabulary=vocabulary)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    return pack_documents(documents(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces in sequences of 2048 tokens; a row that comes twice, by mixing, is packed twice. Null texts are one id each.

    An empty table gives no pieces.
    """
    return pack_documents(docs)
