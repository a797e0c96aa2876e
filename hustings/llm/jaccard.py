"""N-gram Jaccard join by a token-group matrix: similar documents form groups, a query meets a group's token union before its members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import types as T

from hustings.operators.graph import connected_components

from .common import SHARE, documents, join_counted, materialize, put_back, set_apart, slices
from .shingles import shingle_sets, stir

#: Counting cells for shingles: what the driver collects and sends out is this many numbers, whatever the data.
CELL_BITS = 18
#: Min-hashes by which groups are formed, leaders of each of both sorts, hashes of a set that tell the nearest leaders, and leaders a set is
#: compared with.
HASHES, LEADERS, SKETCH, COMPARED = 3, 4, 32, 2
#: Members of a group that a query tries before it meets all; parts in which a set's hashes are counted.
TRIED, PARTS = 16, 512
#: Bits of a set that go with each of its first tokens, in words of 64, and their columns.
BIT_WORDS = 4
BITS = [f"b{i}" for i in range(BIT_WORDS)]
#: Up to so many ids a table of ids is sent to all executors (16 bytes each); a larger one is joined by shuffles.
BROADCAST_IDS = 500_000


def _enough(common: Column, x: Column, y: Column, percent: int) -> Column:
    """100 * intersection >= percent * union."""
    return (100 + percent) * common >= percent * (x + y)


def count_cells(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each cell (the first bits of shingles' hashes) in ascending order of how many shingles fall into it, rare cells first; and
    the counts in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in slices(batches, 0):
            values, _ = shingle_sets(batch.column(0).to_pylist(), width)
            np.add.at(total, (values >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        cells = np.flatnonzero(total)
        for at in range(0, len(cells), 50_000):
            some = cells[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
    rows = docs.select(text).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    places = np.empty(1 << CELL_BITS, dtype=np.uint64)
    order = np.argsort(counts, kind="stable")
    places[order] = np.arange(1 << CELL_BITS, dtype=np.uint64)
    return places, counts[order]


def describe(docs: DataFrame, places: np.ndarray, id_column: str, text: str, width: int, percent: int) -> DataFrame:
    """Rows (id, n, fa, fb, m, sketch, typical, prefix, b0, b1, ...): set size, fingerprint, min-hashes, least hashes, the mean place of the set's
    tokens, its first tokens, rarest first, and a bit for each of 64 * BIT_WORDS parts of all hashes: whether it has an odd number of the set's.

    The prefix is as long as it must be for any partner at ``percent`` or more to share one of its tokens. Of near copies of one text, the text
    itself has the greatest mean place: what a copy changed is rare.
    """
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            values, starts = shingle_sets(batch.column(1).to_pylist(), width)
            sizes = np.diff(starts)
            some, full = starts[:-1][sizes > 0], sizes > 0

            def reduced(f, x: np.ndarray, some=some, full=full) -> np.ndarray:
                out = np.zeros(len(full), dtype=np.uint64)
                if len(some):
                    out[full] = f.reduceat(x, some)
                return out.view(np.int64)

            stirred = stir(values ^ np.uint64(0x5851F42D4C957F2D))
            mins = np.stack([reduced(np.minimum, stir(values + np.uint64(0xD1342543DE82EF95 * (j + 1) % 2**64))) for j in range(HASHES)], axis=1).ravel() if len(full) else np.empty(0, np.int64)
            low = np.uint64(64 - CELL_BITS)
            ends = np.minimum(sizes, SKETCH)
            sketch = np.concatenate([values[a : a + e] for a, e in zip(starts[:-1].tolist(), ends.tolist(), strict=True)]) if len(sizes) else values
            ranks = shared.value[(values >> low).astype(np.int64)]
            typical = reduced(np.add, ranks) // np.maximum(sizes, 1)
            keys = ranks << low | values & np.uint64((1 << (64 - CELL_BITS)) - 1)
            lengths = np.where(full, sizes - -(-percent * sizes // 100) + 1, 0)
            prefixes = []
            for a, n, p in zip(starts[:-1].tolist(), sizes.tolist(), lengths.tolist(), strict=True):
                part = keys[a : a + n]
                part.sort()
                prefixes.append(part[:p])
            offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
            np.cumsum(lengths, out=offsets[1:])
            tokens = np.concatenate(prefixes).view(np.int64) if prefixes else np.empty(0, np.int64)
            part = np.repeat(np.arange(len(sizes)), sizes) * 64 * BIT_WORDS + (stirred >> np.uint64(32)).astype(np.int64) % (64 * BIT_WORDS)
            odd = np.bincount(part, minlength=len(sizes) * 64 * BIT_WORDS).astype(np.uint8) & 1
            bits = np.packbits(odd).view(np.int64).reshape(-1, BIT_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(reduced(np.add, stirred)),
                    pa.array(reduced(np.bitwise_xor, stir(stirred + np.uint64(1)))),
                    pa.ListArray.from_arrays(np.arange(0, HASHES * len(sizes) + 1, HASHES, dtype=np.int32), mins),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32), sketch.astype(np.uint32).view(np.int32)),
                    pa.array(typical),
                    pa.ListArray.from_arrays(offsets, tokens),
                    *[pa.array(np.ascontiguousarray(bits[:, j])) for j in range(BIT_WORDS)],
                ],
                names=["id", "n", "fa", "fb", "m", "sketch", "typical", "prefix", *BITS],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text).mapInArrow(run, f"id {kind}, n bigint, fa bigint, fb bigint, m array<bigint>, sketch array<int>, typical bigint, prefix array<bigint>, {', '.join(f'{b} bigint' for b in BITS)}")


def _sets(docs: DataFrame, ids: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """Rows (id, n, parts, s): the whole sets of the documents in ``ids``, as sorted hashes, and how many hashes fall into each of PARTS parts.

    ``parts`` is null where a part has more than a byte can count. A document that comes twice counts once.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            values, starts = shingle_sets(batch.column(1).to_pylist(), width)
            cell = np.repeat(np.arange(batch.num_rows), np.diff(starts)) * PARTS + (values >> np.uint64(32)).astype(np.int64) % PARTS
            counts = np.bincount(cell, minlength=batch.num_rows * PARTS).reshape(-1, PARTS)
            parts = [x.astype(np.uint8).tobytes() if x.max() < 256 else None for x in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(parts, pa.binary()), pa.ListArray.from_arrays(starts.astype(np.int32), values.view(np.int64))], names=["id", "n", "parts", "s"])

    ids = materialize(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    some = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    return materialize(some.mapInArrow(run, f"id {kind}, n bigint, parts binary, s array<bigint>"))


@F.pandas_udf(T.LongType())
def _most_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """At most so many hashes are common to two sets, by their counts in parts: the sum of the smaller counts. Null counts tell nothing."""
    known = a.notna() & b.notna()
    out = np.full(len(a), np.iinfo(np.int64).max)
    if known.any():
        x, y = (np.frombuffer(b"".join(c[known]), dtype=np.uint8).reshape(-1, PARTS) for c in (a, b))
        out[known.to_numpy()] = np.minimum(x, y).sum(axis=1)
    return pd.Series(out)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, *more: str) -> DataFrame:
    """The rows of ``pairs`` (a, b, more) whose sets are similar enough.

    The counts in parts are an upper bound of what two sets have in common; only pairs that it leaves open are sent the sets themselves.
    """
    of = lambda k, *columns: sets.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in columns])
    bound = pairs.join(of("b", "n", "parts"), "b").join(of("a", "n", "parts"), "a").withColumn("most", _most_common("partsa", "partsb"))
    some = F.col("most") >= F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    left = materialize(bound.filter(some).select("a", "b", *more))  # few pairs are then sent to the sets, not the sets to them
    full = left.join(of("b", "n", "s"), "b").join(of("a", "n", "s"), "a")
    return full.filter(_enough(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"), percent)).select("a", "b", *more)


def meeting_groups(tokens: DataFrame, percent: int, limit: int | None = None) -> DataFrame:
    """Rows (ga, gb), ga < gb, pairs of groups that meet at a token of the matrix; a pair may come more than once.

    ``tokens`` has rows (id, n, g, i, token, bits) of first tokens; a class without a group (``g`` is null) is its own row of the matrix, a group
    has one row for each token, the extremes of its members. With ``limit`` a token with more rows than that is dealt to several tasks, of
    ``limit`` rows each, which all get the other side's rows of that token.

    Bits: a part with an odd number of hashes in one set and an even one in the other has a hash that only one of them has, so there are no fewer
    of these than bits that differ.
    """
    rest, indexed = F.col("n") - F.col("i") - 1, F.col("i") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    small = [F.min(F.when(indexed, F.col("n"))).alias("least"), F.max(F.when(indexed, F.col("n"))).alias("most"), F.max(F.when(indexed, rest)).alias("rest")]
    large = [F.min("n").alias("x_least"), F.max("n").alias("x_most"), F.max(rest).alias("x_rest")]
    extremes = ["x_least", "x_most", "x_rest", "least", "most", "rest"]
    alone = tokens.filter("g is null").select("token", F.col("id").alias("g"), "n", "i", *BITS)
    several = tokens.filter("g is not null").groupBy("token", "g").agg(*large, *small).select("token", "g", F.struct(*extremes).alias("members"))
    matrix = alone.unionByName(several, allowMissingColumns=True)

    def side(m: str) -> DataFrame:
        return matrix.select("token", *[F.col(c).alias(f"{m}_{c}") for c in ("g", "n", "i", *BITS, "members")])

    def of(m: str, name: str) -> Column:
        """An extreme of a group's members, or of a class that is alone."""
        n, i = F.col(f"{m}_n"), F.col(f"{m}_i")
        value = n - i - 1 if name.endswith("rest") else n
        own = value if name.startswith("x_") else F.when(i <= n - F.ceil(2 * percent * n / (100 + percent)), value)
        return F.when(n.isNotNull(), own).otherwise(F.col(f"{m}_members.{name}"))

    def meets(p: str, q: str) -> Column:
        """A set of group p can be the larger of a pair, one of group q the smaller."""
        x = F.greatest(of(p, "x_least"), of(q, "least"))  # the least sizes that can match: of the larger set, then of the smaller
        y = F.greatest(of(q, "least"), F.ceil(percent * x / 100))
        return (of(q, "least") <= of(p, "x_most")) & (100 * of(q, "most") >= percent * of(p, "x_least")) & _enough(1 + F.least(of(p, "x_rest"), of(q, "rest")), x, y, percent)

    differ = sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in BITS), F.lit(0))
    near = F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col("a_n") + F.col("b_n")), F.lit(True))
    left, right, keys = side("a"), side("b"), ["token"]  # both sides have the same columns, so that one exchange serves both
    if limit is not None:
        hot = materialize(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("token", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
        left = left.join(F.broadcast(hot), "token", "left").withColumn("part", F.pmod(F.xxhash64("a_g"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        right = right.join(F.broadcast(hot), "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        keys = ["token", "part"]
    return left.join(right, keys).filter((F.col("a_g") < F.col("b_g")) & near & (meets("a", "b") | meets("b", "a"))).select(F.col("a_g").alias("ga"), F.col("b_g").alias("gb"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of ``docs``: the components of the graph of documents at ``percent`` or more.

    Documents link when 100 * intersection >= percent * union of their sets of word shingles; texts without words (or null) link with nothing.
    The component is the smallest id that can be reached. Rows with equal texts, or with equal sets, are in one component; so are rows that share
    an id by repetition. A row with a null id joins the component of its set; if no row with an id has that set, its component is null.

    1. Rows with equal sets are one class, the smallest id stands for it.
    2. Groups: classes with a common min-hash are held against a few leaders of that min-hash, and compared with the most typical one and those
       that look nearest; those similar enough are linked, and the components of these links are the groups. Leaders are chosen by lot and by
       how typical their tokens are: of many near copies of a text, the text, with which most of them link. Other classes are groups of their
       own.
    3. Token-group matrix: for each token the groups that have it in the union of their members' first tokens, with the members' sizes. Two
       groups meet where they share such a token and the sizes and places leave room for enough overlap. Tokens come rarest first, by counts in
       a fixed number of cells over all documents, so tokens of common passages seldom serve. Of two classes that are alone in their groups the
       bits must leave room too: documents put together from common passages share tokens, but differ in more bits than similar ones could.
    4. Of two groups that meet, each member of the smaller is a query against the other. If that has several members, the query's whole set is
       counted against the union of their whole sets: only where that bound is enough is the group opened. The pairs with its members are
       verified exactly, first with a few of them, then with all if none of the few links; the links are added to those of step 2.

    Every pair that links is found: in step 3 the larger set brings its first n - ceil(t n) + 1 tokens, the smaller its first
    n - ceil(2t / (1 + t) n) + 1, of which one is common to any two sets that similar. Large groups of copies cost a few comparisons for each
    member, not one for each pair, because members of one group never meet; copies too far from the text to link with it have more changed, hence
    rare, tokens in front than their places leave room for. The result has no other columns of ``docs``.

    An empty table gives an empty one; a very long text is one set, held whole where its shingles are made.
    """
    places, counts = count_cells(docs, text, width)
    rows = materialize(describe(docs, places, id_column, text, width, percent))
    # equal sets have equal values in all but the id
    classes = materialize(rows.filter("n > 0").groupBy("fa", "fb", "n").agg(F.min("id").alias("id"), F.first("m").alias("m"), F.first("sketch").alias("sketch"), F.first("typical").alias("typical"), F.count(F.lit(1)).alias("copies")).filter("id is not null"))

    keyed = classes.select("id", "n", "typical", F.posexplode("m").alias("j", "k"))
    chosen = F.struct(F.col("id").alias("leader"), F.col("n").alias("ln"))
    by_lot = [F.min(F.struct(F.xxhash64(F.lit(i), "id").alias("h"), chosen.alias("l"))).alias(f"l{i}") for i in range(LEADERS)]
    by_type = [F.max(F.when(F.pmod(F.xxhash64("id"), F.lit(LEADERS)) == i, F.struct("typical", chosen.alias("l")))).alias(f"l{LEADERS + i}") for i in range(LEADERS)]
    top = F.max(F.struct("typical", "id"))["id"].alias("top")
    leaders = materialize(keyed.groupBy("j", "k").agg(F.count(F.lit(1)).alias("members"), top, *by_lot, *by_type).filter("members > 1"))
    each = F.array_distinct(F.filter(F.array(*[F.col(f"l{i}.l") for i in range(2 * LEADERS)]), lambda x: x.isNotNull()))
    held = join_counted(keyed.select("id", "n", "j", "k"), leaders.select("j", "k", "members", "top", each.alias("ls")), ["j", "k"], "members", "id").select("id", "n", "top", F.explode("ls").alias("l"))
    near = (F.col("id") != F.col("l.leader")) & (100 * F.least("n", "l.ln") >= percent * F.greatest("n", "l.ln"))
    sketches = classes.select("id", "sketch")
    met = held.filter(near).groupBy("id", F.col("l.leader").alias("leader")).agg(F.max(F.col("top") == F.col("l.leader")).alias("top"))
    met = met.join(sketches, "id").join(sketches.select(F.col("id").alias("leader"), F.col("sketch").alias("ls")), "leader").select("id", "leader", "top", F.size(F.array_intersect("sketch", "ls")).alias("common"), F.least(F.size("sketch"), F.size("ls")).alias("size"))
    met = met.filter(2 * F.col("common") >= F.col("size"))  # others are too far apart to be worth a comparison here; step 3 would find them all the same
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("common").desc(), "leader"))
    nearest = met.withColumn("_p", place).filter((F.col("_p") <= COMPARED) | F.col("top"))
    first = materialize(nearest.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct())
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = materialize(_verified(first, _sets(docs, ends(first), id_column, text, width), percent))
    groups = connected_components(links, "a", "b")

    member = classes.select("id", "n", "fa", "fb").join(groups, "id", "left").select("id", "n", "fa", "fb", F.col("component").alias("g"))
    member = materialize(member)
    grouped = member.select("id", "n", F.coalesce("g", "id").alias("g"))
    tokens = rows.select("id", "n", "fa", "fb", "prefix", *BITS).join(member, ["id", "n", "fa", "fb"]).select("id", "n", "g", *BITS, F.posexplode("prefix").alias("i", "token"))
    first_tokens = rows.agg(F.sum(F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)).first()[0] or 0
    often = int(np.searchsorted(counts, max(1, first_tokens // SHARE), side="right"))  # a token with more than its share has a place from here on
    frequent = F.shiftrightunsigned("token", 64 - CELL_BITS) >= often
    pairs = materialize(meeting_groups(tokens.filter(~frequent), percent).unionByName(meeting_groups(tokens.filter(frequent), percent, max(1, first_tokens // SHARE))).distinct())

    met_groups = pairs.select(F.explode(F.array("ga", "gb")).alias("g")).distinct()
    sizes = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = materialize(sizes.join(met_groups, "g", "left_semi"))
    inside = materialize(join_counted(grouped, sizes.select("g", "members"), ["g"], "members", "id").drop("members"))
    of = lambda g: sizes.select(F.col("g").alias(g), F.struct("members", "least", "most").alias(f"_{g}"))
    sided = pairs.join(of("ga"), "ga").join(of("gb"), "gb")
    swap = F.col("_ga.members") > F.col("_gb.members")
    sided = sided.select(F.when(swap, F.col("gb")).otherwise(F.col("ga")).alias("g"), F.when(swap, F.col("ga")).otherwise(F.col("gb")).alias("group"), F.when(swap, F.col("_ga")).otherwise(F.col("_gb")).alias("_s"))
    fits = (100 * F.col("_s.most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("_s.least"))
    queries = materialize(sided.join(inside, "g").filter(fits).select("id", "n", "group", "_s.members", "_s.least"))
    sets = _sets(docs, inside.select("id").distinct(), id_column, text, width)

    bounding = materialize(queries.filter("members > 1"))
    opened_members = inside.select(F.col("g").alias("group"), F.col("id").alias("y"), F.col("n").alias("ny")).join(queries.select("group").distinct(), "group", "left_semi")
    bounding_members = materialize(opened_members.join(bounding.select("group").distinct(), "group", "left_semi"))
    union = bounding_members.join(sets.select(F.col("id").alias("y"), "s"), "y").select("group", F.explode("s").alias("token")).distinct()
    seen = bounding.join(sets.select("id", "s"), "id").select("id", "n", "group", "least", F.explode("s").alias("token")).join(union, ["group", "token"]).groupBy("id", "n", "group", "least").agg(F.count(F.lit(1)).alias("common"))
    bounded = seen.filter(_enough(F.col("common"), F.col("n"), F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100)), percent))
    bounded = materialize(bounded.select("id", "n", "group", "common"))
    near = 100 * F.least("n", "ny") >= percent * F.greatest("n", "ny")

    # a query that links with one of a few members is done with its group; only the others meet all members
    pick = [F.min(F.struct(F.xxhash64(F.lit(i), "y").alias("h"), "y", "ny")).alias(f"l{i}") for i in range(TRIED)]
    some = opened_members.join(bounded.select("group").distinct(), "group", "left_semi").groupBy("group").agg(*pick)
    some = some.select("group", F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"l{i}.y"), F.col(f"l{i}.ny")) for i in range(TRIED)]))).alias("l")).select("group", "l.y", "l.ny")
    # a member has no more in common with the query than its group has, so it must be small enough for that
    fits = near & _enough(F.col("common"), F.col("n"), F.col("ny"), percent)
    tried = bounded.join(some, "group").filter(fits).select(F.col("id").alias("a"), F.col("y").alias("b"), "group")
    early = materialize(_verified(materialize(tried), sets, percent, "group"))
    done = early.select(F.col("a").alias("id"), "group").distinct()
    opened = queries.filter("members = 1").select("id", "n", "group", F.least("n", "least").alias("common")).unionByName(bounded.join(done, ["id", "group"], "left_anti"))
    second = materialize(opened.join(opened_members, "group").filter(fits).select(F.col("id").alias("a"), F.col("y").alias("b")))
    more = early.select("a", "b").unionByName(_verified(second, sets, percent))

    found = connected_components(links.unionByName(more), "a", "b")
    named = materialize(classes.select("id", "fa", "fb", "n", "copies").join(found, "id", "left").select("fa", "fb", "n", "copies", F.coalesce("component", "id").alias("component_id")))
    out = join_counted(rows.select("id", "n", "fa", "fb"), named, ["fa", "fb", "n"], "copies", "id", "left")
    empty = F.when(F.col("n") == 0, F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", empty).alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: four-word shingles, similarity of 0.85."""
    out = jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Five-word shingles, similarity of 0.8.

    A row is a document, whatever its id: rows that repeat an id, and rows with a null id, stay unless their texts link with another's. A null id
    comes after all others; between rows of one id the hash of their whole content decides, so a rerun keeps the same. Texts without words link
    with nothing, so all of them stay, but rows alike in all columns with an id stay once.

    Where ids are not null and not repeated, they are the rows' keys. Otherwise each row is numbered, and written with its number before use.

    An empty table gives an empty one.
    """
    inner, names = set_apart(docs)
    doc_id, text = names["doc_id"], names["text"]
    several = inner.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(doc_id).isNull())
    told_apart = several.isEmpty()
    rows = inner.withColumn("row", F.col(doc_id)) if told_apart else materialize(inner.withColumn("row", F.monotonically_increasing_id()))
    found = jaccard_components(rows.select("row", text), "row", text, width=5, percent=80)
    if told_apart:
        stay = found.filter(F.col("id") == F.col("component_id")).select(F.col("id").alias("row"))
    else:
        content = F.sha2(F.to_json(F.struct(*names.values()), {"ignoreNullFields": "false"}), 256)
        named = found.join(rows.select("row", F.col(doc_id).alias("doc_id"), content.alias("content")), F.col("id") == F.col("row"))
        group = F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull(), F.col("content")).otherwise(F.col("component_id").cast("string"))
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content", "row"))
        stay = named.groupBy(group).agg(first.alias("first")).select("first.row")
    return put_back(rows.join(stay, "row", "left_semi"), names)
