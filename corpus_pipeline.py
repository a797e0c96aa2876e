"""A corpus pipeline of five stages: quality rules, line dedup, n-gram Jaccard join, mixing, packing.

Every stage takes all that its predecessor kept, as Parquet that was written and read again. The first four return rows of documents; the
last returns the packed pieces.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from hustings.llm.common import materialize, put_back, set_apart
from hustings.llm.jaccard import jaccard_stage
from hustings.llm.line_dedup import dedup_lines
from hustings.llm.mixing import mixing_stage
from hustings.llm.packing import packing_stage
from hustings.llm.quality import quality_stage
from hustings.shared import release, written


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten rows or more have go; ``n_chars``, where there is one, follows the text. A null text becomes an empty one."""
    inner, names = set_apart(docs)
    lines = dedup_lines(inner, names["text"])
    return put_back(lines.withColumn(names["n_chars"], F.length(names["text"]).cast("long")) if "n_chars" in names else lines, names)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: Tokens and shingle joins are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage has written for itself, and its predecessor's rows, go once its own rows are written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs)
            release(spark, mark, keep=1)
    return docs
