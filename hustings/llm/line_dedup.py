"""Line dedup: lines that many documents share are dropped from all of them."""

from __future__ import annotations

import string

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import SPACE, documents, materialize, private_names


def line_keys(text: Column) -> Column:
    """The key of each line of a text: the line without white space at its ends, A-Z in lower case; other letters keep their case."""
    # lower() works on bytes where all are ASCII, and gives the same there; translate() walks code points
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.transform(F.split(low, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)))


def _hash(key: Column) -> Column:
    """128 bits of a key: two 64-bit hashes that see it with different beginnings."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


@private_names
def dedup_lines(docs: DataFrame, text: str = "text", min_documents: int = 10, min_length: int = 1) -> DataFrame:
    """Every row of ``docs`` with its text less the frequent lines, and ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line stripped and in lower case (:func:`line_keys`). Keys of at least ``min_length`` code points that occur in at least
    ``min_documents`` rows lose all their lines in every row; the others stay, in their places, joined by newlines. A row counts once for a
    key however often it has it. A null or empty text has one empty line; empty keys are never dropped when ``min_length`` is 1 or more.
    Repeated rows are documents of their own. Columns named n_lines or n_dropped in ``docs`` are replaced; all others pass through.

    Only hashes are exploded and shuffled, and counted in part before the shuffle, so a line in every document costs one row a task. Documents
    meet the places of their dropped lines by 128 bits of hashes of the whole row, not by an id that might repeat; rows that are equal in all
    columns lose the same lines, so they may share it.

    An empty table gives an empty one; a very long text is one row whose lines' hashes are exploded.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n", -1)
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = ["__row", "__more"]
    content = [F.col(c) for c in kept_columns]
    rows = docs.select(*kept_columns, F.xxhash64(*content).alias("__row"), F.xxhash64(F.lit("row"), *content).alias("__more"))
    hashes = rows.select(*row, F.transform(line_keys(whole), lambda k: F.when(F.length(k) >= min_length, _hash(k))).alias("__h"))
    each = hashes.select(*row, F.posexplode("__h").alias("__pos", "__h")).filter("__h is not null").select(*row, "__pos", F.col("__h.a").alias("__a"), F.col("__h.b").alias("__b"))
    once = hashes.select(F.explode(F.array_distinct("__h")).alias("__h")).filter("__h is not null").select(F.col("__h.a").alias("__a"), F.col("__h.b").alias("__b"))
    # written, so that Spark knows its size before the join: sent out whole while small, else joined in parts that it can split where a key is hot
    frequent = materialize(once.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_documents).select("__a", "__b"))
    drops = each.join(frequent, ["__a", "__b"], "left_semi").groupBy(*row).agg(F.collect_set("__pos").alias("__drop"))
    none = F.array().cast("array<int>")
    found = rows.join(drops, row, "left").select(*kept_columns, lines.alias("__lines"), F.coalesce("__drop", none).alias("__drop"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.when(F.size("__drop") == 0, F.col("__lines")).otherwise(F.transform(places, lambda i: F.col("__lines")[i]))
    columns = [F.array_join(kept, "\n").alias(text) if c == text else F.col(c) for c in kept_columns]
    return found.select(*columns, F.size("__lines").cast("long").alias("n_lines"), F.size("__drop").cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT row_id, doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY row_id, doc_id
"""
