"""Quality rules: a cascade that stops at the first rule a text fails, cheapest rejections first."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, put_back, set_apart, slices

WINDOW = 5
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
_SPACES = b" \t\n\x0b\x0c\r"
_NOT_SPACES = bytes(set(range(256)) - set(_SPACES))


class Text:
    """A text and its measures; each is computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.bytes = self.text.encode()
        self._known: dict[str, object] = {}

    def _once(self, name: str, f: Callable[[], object]):
        if name not in self._known:
            self._known[name] = f()
        return self._known[name]

    @property
    def words(self) -> list[bytes]:
        return self._once("words", self.bytes.split)  # bytes.split() cuts at the same six characters as [^\x20\x09-\x0D]+

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return len(self.text) - self._once("spaces", lambda: len(self.bytes.translate(None, _NOT_SPACES)))

    @property
    def n_symbols(self) -> int:
        return self._once("symbols", lambda: len(self.bytes.translate(None, _NOT_SYMBOLS)))

    @property
    def lines(self) -> list[bytes]:
        """The lines that have a word."""
        return self._once("lines", lambda: [x for x in self.bytes.split(b"\n") if x.strip(_SPACES)])

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @property
    def n_repeat_words(self) -> int:
        return self._once("repeats", self._repeats)

    def _repeats(self) -> int:
        w = self.words
        windows = list(zip(*[w[i:] for i in range(WINDOW)], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times, end, total = Counter(windows), 0, 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                total += i + WINDOW - max(i, end)
                end = i + WINDOW
        return total


@dataclass(frozen=True)
class Rule:
    """``fails`` says whether a text is to be rejected."""

    name: str
    fails: Callable[[Text], bool]


#: The first two are the base; the others find symbol noise, menus and pasted lines. A text without words fails the first.
RULES = (
    Rule("too_few_words", lambda t: t.n_words < 10),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
    Rule("symbols", lambda t: 100 * t.n_symbols > 10 * t.n_words),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines > 50 * len(t.lines)),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 12 * t.n_words),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: int = 400, seed: int = 7) -> tuple[Rule, ...]:
    """``rules`` by rejections per second of cost, most first, as estimated on about ``sample`` texts drawn from all partitions.

    The tasks that hold the drawn texts time each rule on its own, with nothing computed before; the driver gets a sum of seconds and of
    rejections for each rule, never a text. The order depends on timing, so it can differ between runs; it decides how soon a text is done with,
    never the verdict: a text is kept when it fails no rule. An empty table, or an empty sample, leaves the order as it is; ties too.
    """
    total = docs.count()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                rejected[i] += sum(rule.fails(Text(x)) for x in texts)
                seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected, pa.int64())], names=["rule", "seconds", "rejected"])

    drawn = docs.select(text).sample(min(1.0, sample / max(total, 1)), seed=seed)
    sums = drawn.mapInArrow(measure, "rule int, seconds double, rejected bigint").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected")).collect()
    worth = {rules[r[0]].name: (r[2] + 0.5) / (r[1] + 1e-9) for r in sums if r[1]}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, 0)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", measures: bool = False) -> DataFrame:
    """``docs`` with ``kept`` and ``failed`` (the first rule in the given order that the text fails, null if none); with all measures on request.

    ``kept`` does not depend on the order of ``rules``, ``failed`` does. Without ``measures`` a text costs only the rules up to its first failure. A null text is empty and fails too_few_words. Repeated rows are
    judged alike. Columns of these names in ``docs`` are replaced. No shuffle.

    An empty table gives an empty one; a long text is read whole, rule by rule.
    """
    made = [*(MEASURES if measures else ()), "kept", "failed"]
    passed = [c for c in docs.columns if c not in made]
    kinds = [*([T.StructField(m, T.LongType()) for m in MEASURES] if measures else []), T.StructField("kept", T.BooleanType()), T.StructField("failed", T.StringType())]
    schema = T.StructType([*[docs.schema[c] for c in passed], *kinds])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, passed.index(text)):
            rows = []
            for value in batch.column(passed.index(text)).to_pylist():
                t = Text(value)
                failed = next((r.name for r in rules if r.fails(t)), None)
                rows.append(([getattr(t, m) for m in MEASURES] if measures else []) + [failed is None, failed])
            columns = list(zip(*rows, strict=True)) or [[] for _ in made]
            types = [*[pa.int64()] * (len(made) - 2), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[*passed, *made])

    return docs.select(*passed).mapInArrow(judge, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over all documents, with every measure."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = apply_rules(docs, order_rules(docs), measures=True)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *MEASURES, base.alias("base_failed"), "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that fail no rule, as they are. Rows with a null text, or fewer than ten words, go; repeated rows are judged alike.

    An empty table gives an empty one.
    """
    inner, names = set_apart(docs)
    return put_back(apply_rules(inner, order_rules(docs), names["text"]).filter("kept"), names)


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row_id, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT row_id, i, ws[i:i+4] AS k FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, k) AS n FROM g) WHERE n > 1),
c AS (SELECT row_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(5)) AS j) GROUP BY row_id),
m AS (
  SELECT w.row_id, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN c ON w.row_id = c.row_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words) AS kept
FROM m
"""
