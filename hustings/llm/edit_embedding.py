"""Document fingerprints by a randomised edit embedding: shared random walks over characters, sampled places, bands, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .common import documents, materialize, private_names, slices
from .shingles import stir

#: Steps after which a walk's random bits begin again, and classes of characters that share them.
PERIOD, CLASSES = 1024, 64
#: Characters that a sampled place looks at; characters walked at a time.
WIDE, CHUNK = 4, 1 << 20
SAMPLES, WALKS, SEED, BAND = 128, 2, 13, 8
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


class Embedding:
    """Walks over texts and what is sampled from them.

    A walk stands on a character and, at each step, goes on to the next one if a random bit of that step and character says so; the embedding is
    the character under each step. All texts share the bits, so equal stretches make equal steps, and two walks that an edit has set apart meet
    again by chance: few edits change few steps. Each sample has a place in the embedding, by a rule that gives embeddings of lengths a < b the
    same place with probability a / b: places of a fixed descending chain, the first that lies inside. Its four bits are a hash of the characters
    there; so a fingerprint has a fixed length, looks at the whole of any text, and the share of equal samples estimates the share of equal steps.
    """

    def __init__(self, samples: int = SAMPLES, walks: int = WALKS, seed: int = SEED) -> None:
        raw = np.random.PCG64(seed)
        bits = (raw.random_raw(walks * PERIOD * CLASSES) >> np.uint64(63)).astype(bool).reshape(walks, PERIOD, CLASSES)
        self.tables = [self._table(b) for b in bits]
        self.each = samples // walks
        places = np.full(samples, 1 << 48, dtype=np.int64)
        chain = []
        while places.any():
            places = (places * ((raw.random_raw(samples) >> np.uint64(11)) / float(1 << 53))).astype(np.int64)
            chain.append(places)
        self.chain = np.stack(chain, axis=1)
        self.salts = raw.random_raw(samples)

    @staticmethod
    def _table(bits: np.ndarray) -> list[list[int]]:
        """For each class of characters and step (modulo the period), the step after the one that goes on to the next character."""
        after = np.full(CLASSES, -1)
        rows = np.empty((PERIOD, CLASSES), dtype=np.int64)
        for step in range(2 * PERIOD - 1, -1, -1):
            after = np.where(bits[step % PERIOD], (step + 1) % PERIOD, after)
            if step < PERIOD:
                rows[step] = after
        return rows.T.tolist()

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)

    def walk(self, codes: np.ndarray, starts: list[int]) -> list[np.ndarray]:
        """For each walk, the step (modulo the period) after each character, from the step where it starts."""
        classes = (codes * np.uint32(0x9E3779B1) >> np.uint32(26)).astype(np.uint8)
        out = []
        for table, at in zip(self.tables, starts, strict=True):
            parts = []
            for i in range(0, len(classes), CHUNK):
                steps = [at := table[c][at] for c in classes[i : i + CHUNK].tobytes()]
                parts.append(np.array(steps, dtype=np.int16))
            out.append(np.concatenate(parts) if parts else np.empty(0, np.int16))
        return out

    def fingerprint(self, codes: np.ndarray, walks: list[np.ndarray]) -> np.ndarray:
        """Samples (0 to 15) of a text by its walks from step 0. A text without characters has one of code 0."""
        if not len(codes):
            codes, walks = np.zeros(1, np.uint32), [np.ones(1, np.int16)] * len(walks)
        padded = np.concatenate([codes, np.zeros(WIDE, np.uint32)]).astype(np.uint64)
        out = []
        for k, steps in enumerate(walks):
            mine = slice(k * self.each, (k + 1) * self.each)
            stays = np.diff(steps, prepend=np.int16(0)) % PERIOD
            stays[stays == 0] = PERIOD
            sums = np.add.reduceat(stays, np.arange(0, len(stays), CHUNK), dtype=np.int64)
            ends = np.cumsum(sums)
            chain = self.chain[mine]
            places = chain[np.arange(self.each), np.argmax(chain < ends[-1], axis=1)]
            which = np.searchsorted(ends, places, side="right")
            at = np.empty(self.each, dtype=np.int64)
            for c in np.unique(which).tolist():
                here = which == c
                inner = np.cumsum(stays[c * CHUNK : (c + 1) * CHUNK], dtype=np.int64)
                at[here] = c * CHUNK + np.searchsorted(inner, places[here] - (ends[c] - sums[c]), side="right")
            mixed = self.salts[mine] + places.astype(np.uint64)
            for j in range(WIDE):
                mixed = stir(mixed) + padded[at + j]
            out.append((stir(stir(mixed)) & np.uint64(15)).astype(np.uint8))
        return np.concatenate(out)

    def of(self, text: str) -> np.ndarray:
        codes = self.codes(text)
        return self.fingerprint(codes, self.walk(codes, [0] * len(self.tables)))


def as_text(samples: np.ndarray) -> str:
    return _HEX[samples].tobytes().decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the share of equal samples, less what chance makes equal."""
    return max(0.0, (float(np.mean(a == b)) * 16 - 1) / 15)


def share_a_band(a: np.ndarray, b: np.ndarray, band: int = BAND) -> bool:
    """Whether some run of ``band`` samples is equal in both: what makes two texts candidates."""
    return bool((a == b).reshape(-1, band).all(axis=1).any())


def bands(fingerprint: Column, samples: int = SAMPLES, band: int = BAND) -> Column:
    """An array of the bands of a fingerprint, each with its number."""
    return F.array(*[F.concat(F.lit(f"{i}:"), F.substring(fingerprint, i * band + 1, band)) for i in range(samples // band)])


def likeness_of(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """:func:`likeness` of two fingerprint columns."""
    equal = sum((F.substring(a, i + 1, 1) == F.substring(b, i + 1, 1)).cast("int") for i in range(samples))
    return F.greatest(F.lit(0.0), (equal * 16.0 / samples - 1) / 15)


@private_names
def with_fingerprints(docs: DataFrame, text: str = "text", samples: int = SAMPLES, walks: int = WALKS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``fingerprint``: one hexadecimal digit a sample. Equal texts have equal fingerprints; a null text counts as empty.

    Whole texts are walked, in time and memory linear in their length; one text is in memory at a time beside its Arrow batch. Other columns pass
    through; one named fingerprint is replaced. An empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        walker = Embedding(samples, walks, seed)
        for batch in texts:
            yield pd.Series([as_text(walker.of(t or "")) for t in batch], dtype=object)

    return docs.withColumn("fingerprint", run(F.col(text)))


@private_names
def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8, samples: int = SAMPLES, walks: int = WALKS, seed: int = SEED) -> DataFrame:
    """Rows (id, fingerprint, near_class): each row's least id reachable over verified pairs; ids should be distinct and not null.

    Equal fingerprints are one entry from the start, with the least id; so copies, however many, meet nothing twice. Entries that share a band are
    candidates: in every band's group each is held against the group's leader, its least entry, and those at least ``least`` alike are linked to
    it; the others form a group of their own with a new leader, until all are a leader or linked. So a group of n entries costs n comparisons a
    round, and no group is gathered in one place. Links are joined to classes by contracting edges. A null id is dropped; an empty table gives an
    empty one.
    """
    from hustings.operators.graph import connected_components

    marked = materialize(with_fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter("id is not null"), "text", samples, walks, seed).select("id", "fingerprint"))
    entries = materialize(marked.groupBy("fingerprint").agg(F.min("id").alias("entry")))
    open_ = materialize(entries.select("entry", "fingerprint", F.explode(bands(F.col("fingerprint"), samples)).alias("group")))
    links = None
    while True:
        led = open_.groupBy("group").agg(F.min(F.struct("entry", "fingerprint")).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        if led.isEmpty():
            break
        met = open_.join(led.select("group", F.col("l.entry").alias("leader"), F.col("l.fingerprint").alias("theirs")), "group").filter("entry <> leader")
        met = materialize(met.withColumn("like", likeness_of(F.col("fingerprint"), F.col("theirs"), samples)))
        found = met.filter(F.col("like") >= least).select("entry", "leader").distinct()
        links = materialize(found if links is None else links.unionByName(found))
        open_ = materialize(met.filter(F.col("like") < least).select("entry", "fingerprint", "group"))
    joined = marked.join(entries, "fingerprint")
    if links is None:
        return joined.select("id", "fingerprint", F.col("entry").alias("near_class"))
    found = connected_components(links, "entry", "leader").withColumnRenamed("id", "entry")
    return joined.join(found, "entry", "left").select("id", "fingerprint", F.coalesce("component", "entry").alias("near_class"))


_EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, candidate_edited boolean, candidate_next boolean"


class _Walked:
    """A text with its walks and samples; kept while the next text comes."""

    def __init__(self, walker: Embedding, text: str) -> None:
        self.walker, self.text, self.codes = walker, text, walker.codes(text)
        self.walks = walker.walk(self.codes, [0] * len(walker.tables))
        self.samples = walker.fingerprint(self.codes, self.walks)

    def against(self, after: _Walked) -> tuple:
        """The row of _EDITED of this text, where ``after`` is the next one. The edited text begins like this one, and so does its walk."""
        n = len(self.codes)
        keep = n - n // 2
        new = after.codes[: n // 2]
        walks = [np.concatenate([w[:keep], more]) for w, more in zip(self.walks, self.walker.walk(new, [int(w[keep - 1]) if keep else 0 for w in self.walks]), strict=True)]
        samples = self.walker.fingerprint(np.concatenate([self.codes[:keep], new]), walks)
        edited = self.text[:keep] + after.text[: n // 2]
        mine, theirs = self.samples, after.samples
        return n, hashlib.sha256(edited.encode()).hexdigest(), as_text(mine), as_text(samples), likeness(mine, samples), likeness(mine, theirs), share_a_band(mine, samples), share_a_band(mine, theirs)


def edited_by_next(docs: DataFrame, id: str = "doc_id", text: str = "text", samples: int = SAMPLES, walks: int = WALKS, seed: int = SEED) -> DataFrame:
    """Rows (id and what _EDITED names): each text against the text whose last half is replaced by the beginning of the next one's, and against
    the next one, in ascending id (nulls first), after the last the first. A null text is empty; rows that tie in id are ordered by a hash of the text.

    Texts are dealt by ranges of id once, and each task reads its range in order. Where a range ends, the last text is kept apart and meets the
    first one of the next range; these are two texts a task. Equal texts that follow each other are walked once. Other columns are left out; an
    empty table gives an empty one.
    """
    kind = dict(docs.dtypes)[id]
    rows = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    out_type = f"id {kind}, {_EDITED}, part int, edge string, text string"
    names = [c.split()[0] for c in _EDITED.split(", ")]

    def table(found: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        types = [ids, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string()]
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["id", *names, "part", "edge", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, walker = TaskContext.get().partitionId(), Embedding(samples, walks, seed)
        last: tuple | None = None
        ids = None
        edge = lambda at, name, x: (at, *[None] * len(names), part, name, x)
        for batch in slices(batches, 1):
            ids, found = batch.schema.field(0).type, []
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = x.as_py()
                if last is None:
                    found.append(edge(at, "head", x))
                    last = at, _Walked(walker, x)
                    continue
                now = last[1] if last[1].text == x else _Walked(walker, x)
                found.append((last[0], *last[1].against(now), None, None, None))
                last = at, now
            if found:
                yield table(found, ids)
        if last is not None:
            yield table([edge(last[0], "tail", last[1].text)], ids)

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = materialize(dealt.mapInArrow(run, out_type))
    # the parts that have rows, each with the next of them
    parts = out.filter("edge = 'head'").select("part")
    place = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(place), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("after"))
    heads = out.filter("edge = 'head'").select(F.col("part").alias("after"), F.col("text").alias("next"))
    tails = out.filter("edge = 'tail'").select("id", "text", "part").join(following, "part").join(heads, "after").select("id", "text", "next")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Embedding(samples, walks, seed)
        for batch in slices(batches, 1):
            for at, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                row = (at, *_Walked(walker, x.as_py()).against(_Walked(walker, y.as_py())), None, None, None)
                yield table([row], batch.schema.field(0).type)

    met = tails.mapInArrow(meet, out_type)
    return out.filter("edge is null").unionByName(met).drop("part", "edge", "text").withColumnRenamed("id", id)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_by_next(documents(spark, sf_dir).select("doc_id", "text"))
