"""LM scoring: bigrams, words and a uniform floor, mixed by deleted interpolation with weights for each class of context frequency."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import documents, materialize, slices
from .shingles import hashed_words, stir

#: The end of a text counts as a token; no word holds a newline, so its hash is free. It is also the context of a text's first token.
END = np.uint64(0x2545F4914F6CDD1D)
#: Steps of an octave in which ratios of estimates are told apart when weights are learned; a cell keeps the mean of what it holds.
STEPS = 4
#: One row of requests shall hold so many words or pairs at least, however large the corpus.
RUN = 8


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first byte of all, then the second of all, and so on: high bytes are mostly zero."""
    import zstandard

    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _pairs(tokens: np.ndarray, starts: np.ndarray, leads: np.ndarray, words: int) -> np.ndarray:
    """For each token its context and itself in one number; ``leads`` are the contexts of the pieces' first tokens."""
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[starts[:-1]] = leads
    return context * words + tokens


def chunks(docs: DataFrame, id_column: str, text: str, held: Column, chunk_tokens: int) -> DataFrame:
    """One row for ``chunk_tokens`` tokens: pieces of texts, the distinct words' hashes and the tokens as places among them.

    A piece has its text's id, number (``rows``), start and the word before it (``leads``: the end token at the start of a text). Texts go on in
    the next chunk where one is full, so no chunk is longer, however long a text.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def flush(pieces: list[tuple], name: int, ids_type: pa.DataType) -> pa.RecordBatch:
        ids, rows, held_out, leads, parts = zip(*pieces, strict=True)
        starts = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=starts[1:])
        words, places, counts = np.unique(np.concatenate([*parts, np.array(leads, dtype=np.uint64)]), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        places = place[places]
        kept = ~np.repeat(np.array(held_out, dtype=bool), np.diff(starts))
        row = [[name], [list(ids)], [list(rows)], [list(held_out)], [starts.tolist()], [places[starts[-1] :].tolist()], [_packed(words[order])], [_packed(places[: starts[-1]])], [int(kept.sum())]]
        types = [pa.int64(), pa.list_(ids_type), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["chunk", "ids", "rows", "held", "starts", "leads", "words", "tokens", "n_train"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        number, row, size, pieces = 0, 0, 0, []
        end = np.array([END], dtype=np.uint64)
        ids_type = pa.int64()
        for batch in slices(batches, 1):
            ids_type = batch.schema.field(0).type
            values, starts = hashed_words(batch.column(1).to_pylist())
            for k, (i, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text, lead = np.concatenate([values[starts[k] : starts[k + 1]], end]), END
                while len(text):
                    part, text = text[: chunk_tokens - size], text[chunk_tokens - size :]
                    pieces.append((i, base + row, bool(h), lead, part))
                    size, lead = size + len(part), part[-1]
                    if size == chunk_tokens:
                        yield flush(pieces, base + number, ids_type)
                        number, size, pieces = number + 1, 0, []
                row += 1
        if pieces:
            yield flush(pieces, base + number, ids_type)

    schema = f"chunk bigint, ids array<{kind}>, rows array<bigint>, held array<boolean>, starts array<bigint>, leads array<bigint>, words binary, tokens binary, n_train bigint"
    return docs.select(id_column, text, held.alias("__held")).mapInArrow(run, schema)


class _Chunk:
    """A row of chunks, unpacked; its distinct words and pairs, and what it asks about them."""

    def __init__(self, row: dict):
        self.row = row
        self.words, self.tokens = _unpacked(row["words"], np.uint64), _unpacked(row["tokens"], np.uint32).astype(np.int64)
        self.starts, self.leads = np.array(row["starts"], dtype=np.int64), np.array(row["leads"], dtype=np.int64)
        self.pairs, self.at = np.unique(_pairs(self.tokens, self.starts, self.leads, len(self.words)), return_inverse=True)
        self.context, self.word = self.pairs // len(self.words), self.pairs % len(self.words)

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hash, count in training texts) of the distinct words and of the distinct pairs."""
        train = ~np.repeat(np.array(self.row["held"], dtype=bool), np.diff(self.starts))
        both = stir(stir(self.words[self.context]) * np.uint64(3) + self.words[self.word])
        return [(self.words, np.bincount(self.tokens[train], minlength=len(self.words))), (both, np.bincount(self.at[train], minlength=len(self.pairs)))]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of some batches, one at a time as Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _table(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def exchange_counts(table: DataFrame, shards: int) -> DataFrame:
    """Rows (chunk, kind, shard, totals, distinct): for each chunk the corpus counts of its words and pairs.

    A chunk asks once for each distinct word and pair, with its own count, so a word in every text makes one request a chunk. Requests go to
    shards by ranges of the hash; a shard adds up the counts of equal hashes and answers each chunk in the order of its request.
    """
    edges = np.array([(1 << 64) * i // shards for i in range(1, shards)], dtype=np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            out = []
            for kind, (keys, counts) in enumerate(_Chunk(row).asked()):
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                for shard, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if b > a:
                        part = keys[a:b]
                        out.append((kind, shard, row["chunk"], _packed(np.concatenate([part[:1], np.diff(part)])), _packed(counts[a:b].astype(np.uint32))))
            yield from _table(["kind", "shard", "chunk", "keys", "counts"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], out).to_batches()

    def answer(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in group["keys"].to_pylist()]
        counts = np.concatenate([_unpacked(x, np.uint32) for x in group["counts"].to_pylist()]).astype(np.int64)
        values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.int64)  # doubles hold counts below 2^53 exactly
        totals = [_packed(x) for x in np.split(sums[inverse], np.cumsum([len(k) for k in keys])[:-1])]
        distinct = [int((sums > 0).sum())] + [0] * (len(totals) - 1)
        rows = list(zip(group["chunk"].to_pylist(), group["kind"].to_pylist(), group["shard"].to_pylist(), totals, distinct, strict=True))
        return _table(["chunk", "kind", "shard", "totals", "distinct"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()], rows)

    requests = table.select("chunk", "rows", "held", "starts", "leads", "words", "tokens").mapInArrow(ask, "kind int, shard int, chunk bigint, keys binary, counts binary")
    return requests.groupBy("kind", "shard").applyInArrow(answer, "chunk bigint, kind int, shard int, totals binary, distinct bigint")


def _bucket(count: np.ndarray) -> np.ndarray:
    """Class of a context's count: -1 for none, else the whole part of its binary logarithm."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), -1)


def cells_of(c: np.ndarray, w: np.ndarray, both: np.ndarray, times: np.ndarray, n: int, v: int) -> tuple[np.ndarray, ...]:
    """What training tokens say about the weights, as cells (code, n, second, first).

    Given counts of context, word and pair, and how often. A cell has a context class and a step of the log-ratio, to the floor, of the deleted
    bigram estimate and of the deleted word estimate; ``second`` and ``first`` are the sums of these log-ratios, so that a cell's mean is exact.
    Deleted: each token's own occurrence is taken out of all counts before it is predicted.
    """
    none = -10_000
    with np.errstate(divide="ignore", invalid="ignore"):
        second = np.log2(np.where((both > 1) & (c > 1), (both - 1) / np.maximum(c - 1, 1), 0) * (v + 1))
        first = np.log2(np.where(w > 1, (w - 1) / max(n - 1, 1), 0) * (v + 1))
    ratios = [np.where(np.isfinite(x), x, none / STEPS) for x in (second, first)]
    steps = [np.round(x * STEPS).astype(np.int64) for x in ratios]
    codes, at = np.unique((_bucket(c) + 1) << 40 | (steps[0] + 20_000) << 20 | (steps[1] + 20_000), return_inverse=True)
    return codes, *(np.bincount(at, weights=x, minlength=len(codes)) for x in (times.astype(np.float64), times * ratios[0], times * ratios[1]))


def joined_counts(table: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    """Chunks with the corpus counts of their words and pairs in place, and the cells of their training tokens (:func:`cells_of`)."""
    kept = ["ids", "rows", "held", "starts", "leads", "tokens"]
    types = {"one": pa.binary(), "two": pa.binary(), "codes": pa.list_(pa.int64()), "ns": pa.list_(pa.float64()), "seconds": pa.list_(pa.float64()), "firsts": pa.list_(pa.float64())}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _Chunk(left.to_pylist()[0])
        right, totals = right.sort_by("shard"), []
        asked = chunk.asked()
        for k, (keys, _) in enumerate(asked):
            sums = np.concatenate([_unpacked(x, np.int64) for x, kind in zip(right["totals"].to_pylist(), right["kind"].to_pylist(), strict=True) if kind == k])
            place = np.empty_like(sums)
            place[np.argsort(keys, kind="stable")] = sums
            totals.append(place)
        (one, two), times = totals, asked[1][1]
        some = times > 0
        cells = cells_of(one[chunk.context[some]], one[chunk.word[some]], two[some], times[some], n, v)
        out = left.select(kept)
        for name, value in zip(types, (_packed(one), _packed(two), *(x.tolist() for x in cells)), strict=True):
            out = out.append_column(name, pa.array([value], types[name]))
        return out

    kind = table.schema["ids"].dataType.simpleString()
    schema = f"ids {kind}, rows array<bigint>, held array<boolean>, starts array<bigint>, leads array<bigint>, tokens binary, one binary, two binary, codes array<bigint>, ns array<double>, seconds array<double>, firsts array<double>"
    return table.drop("n_train").groupBy("chunk").cogroup(answers.drop("distinct").groupBy("chunk")).applyInArrow(run, schema)


def learn_weights(cells: pd.DataFrame, rounds: int = 40) -> dict[int, np.ndarray]:
    """Weights (bigram, word, floor) for each context class by expectation-maximisation on cells (code, n, second, first)."""
    cells = cells.sort_values("code")
    code, n = cells["code"].to_numpy(np.int64), cells["n"].to_numpy(np.float64)
    bucket = (code >> 40) - 1
    none = [(code >> at & 0xFFFFF) - 20_000 == -10_000 for at in (20, 0)]
    ratio = np.stack([*(np.where(z, 0.0, 2.0 ** (cells[name].to_numpy(np.float64) / n)) for z, name in zip(none, ("second", "first"), strict=True)), np.ones(len(code))])
    out = {}
    for b in np.unique(bucket):
        x, times, weights = ratio[:, bucket == b], n[bucket == b], np.full(3, 1 / 3)
        for _ in range(rounds):
            shares = weights[:, None] * x
            weights = ((shares / shares.sum(axis=0)) @ times + 0.5) / (times.sum() + 1.5)  # half a token each: no weight gets stuck at zero
        out[int(b)] = weights
    return out


def mixture(weights: dict[int, np.ndarray]) -> np.ndarray:
    """The weights of context classes -1, 0, 1 and so on. A class that was not seen has those of the next that was; -1 has no bigram part."""
    last = max(weights, default=0)
    mixed = np.zeros((last + 2, 3))
    for b in range(-1, last + 1):
        near = min((k for k in weights if k >= max(b, 0)), default=None)
        w = weights[near] if near is not None else np.array([0.0, 0.5, 0.5])
        mixed[b + 1] = w if b >= 0 else np.array([0.0, *w[1:] / w[1:].sum()])
    return mixed


def score_documents(docs: DataFrame, held: Column, id_column: str = "doc_id", text: str = "text", chunk_tokens: int = 1_000_000, shard_tokens: int = 1_000_000) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    Counts and weights come from the rows where ``held`` is false or null; all rows are scored. Tokens are the words, A-Z lowered, and one end. A
    null or empty text is one end token. ``base_score`` adds one to each word count; ``score`` mixes the bigram estimate c(u w) / c(u), the word
    estimate c(w) / N and the floor 1 / (V + 1), with weights for the class of c(u). Weights are learned on the training tokens themselves, each
    with its own occurrence deleted from the counts; contexts without a training count use the weights of the least frequent class without the
    bigram. An empty table gives no rows; if nothing is left for training, all counts are 0. Repeated rows are texts of their own. Columns of
    ``docs`` other than the id and the text are not returned.

    Texts are cut into words once and kept as chunks of ``chunk_tokens`` tokens. Counts are exchanged for distinct words and pairs of a chunk, so
    a frequent word costs one request a chunk; no vocabulary goes to the driver or to all executors. A chunk, or the requests that meet in a
    shard, are all that a task holds. Requests travel in runs, one for a chunk and a shard: chunks and shards grow with the square root of the
    corpus (from 10^11 tokens on; 12 million tokens each, some 300 MB in a task, at 2 * 10^13), so a run keeps RUN requests or more, and the
    runs stay in proportion to the tokens. The driver sees weights' cells: their number is bounded by the logarithms of the counts.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = math.isqrt(RUN * size // 6)  # six bytes a word, about
    table = materialize(chunks(docs, id_column, text, held, max(chunk_tokens, least)))
    n, size = (int(x or 0) for x in table.agg(F.sum("n_train"), F.sum(F.element_at("starts", -1))).first())
    answers = materialize(exchange_counts(table, max(1, -(-size // max(shard_tokens, least)))))
    v = int(answers.filter("kind = 0").agg(F.sum("distinct")).first()[0] or 0)
    full = materialize(joined_counts(table, answers, n, v))
    cells = full.select(F.explode(F.arrays_zip("codes", "ns", "seconds", "firsts")).alias("c")).groupBy(F.col("c.codes").alias("code"))
    mixed = mixture(learn_weights(cells.agg(*[F.sum(f"c.{x}s").alias(x) for x in ("n", "second", "first")]).toPandas()))
    last = len(mixed) - 2
    kind = docs.schema[id_column].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens, starts = _unpacked(row["tokens"], np.uint32).astype(np.int64), np.array(row["starts"], dtype=np.int64)
                one, two = _unpacked(row["one"], np.int64), _unpacked(row["two"], np.int64)
                pairs, inverse = np.unique(_pairs(tokens, starts, np.array(row["leads"], dtype=np.int64), len(one)), return_inverse=True)
                c, w = one[pairs // len(one)], one[pairs % len(one)]
                mix = mixed[np.minimum(_bucket(c), last) + 1]
                p = mix[:, 0] * two / np.maximum(c, 1) + mix[:, 1] * w / max(n, 1) + mix[:, 2] / (v + 1)
                base = np.log10((one[tokens] + 1) / (n + 1 * (v + 1)))
                sums = [np.add.reduceat(x, starts[:-1]) for x in ((one[tokens] > 0).astype(np.int64), base, np.log10(p)[inverse])]
                columns = [pa.array(row["rows"], pa.int64()), pa.array(row["ids"], batch.schema.field("ids").type.value_type), pa.array(row["held"], pa.bool_()), *map(pa.array, (np.diff(starts), *sums))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    pieces = full.select("ids", "rows", "held", "starts", "leads", "tokens", "one", "two").mapInArrow(score, f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    texts = pieces.groupBy("row").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return texts.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; those whose number's CRC leaves 2 when divided by 7 are held out."""
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_documents(documents(spark, sf_dir), held)
