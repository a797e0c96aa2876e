"""The pipeline's stages, each on all that the one before kept, against plain versions of them."""

import collections

import corpus_pipeline
import pyspark.sql.functions as F
import pytest
from hustings.llm.common import materialize
from test_operators import SCHEMA, awkward, brute_components, brute_repeats, brute_targets, crowded, empty

SMALL = "/root/testdata/sf0.001"


def plain_quality(docs):
    kept = []
    for d, text in docs:
        w, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().strip()]
        chars, symbols = sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>")
        bad = len(w) < 10 or 100 * brute_repeats(text) > 20 * len(w) or 100 * symbols > 10 * len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or not 2 * len(w) <= chars <= 12 * len(w)
        kept += [] if bad else [(d, text)]
    return kept


def key(line):
    return line.encode().strip().lower().decode()


def plain_lines(docs):
    counts = collections.Counter(k for _, t in docs for k in {key(x) for x in t.split("\n")})
    return [(d, "\n".join(x for x in t.split("\n") if not (key(x) and counts[key(x)] >= 10))) for d, t in docs]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    want = sorted((r.doc_id, r.text) for r in docs.collect())
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, materialize(stage(spark, docs, SMALL))
        if number == 0:
            want = plain_quality(want)
        elif number == 1:
            want = plain_lines(want)
        elif number == 2:
            groups = brute_components(want, 5, 80)
            want = [(d, t) for d, t in want if groups[d][1] == d]
        if number < 4:
            assert docs.columns == columns, name
        if number < 3:
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
        if number == 3:
            rows, texts = docs.collect(), dict(want)
            assert all(texts[r.doc_id] == r.text for r in rows)
            times = collections.Counter(r.doc_id for r in rows)
            assert max(times.values()) <= 2
            size = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in before.collect()}
            sources = collections.Counter()
            for s, n in size.values():
                sources[s] += n
            target = brute_targets(sources)
            taken = sum(times[d] * n for d, (_, n) in size.items())
            assert abs(taken / sum(target.values()) - 1) < 0.2
            repeats = times
        if number == 4:
            pieces = docs.toPandas()
            assert pieces[pieces["piece"] == 0]["doc_id"].value_counts().to_dict() == dict(repeats)
            assert (pieces.groupby("sequence_id")["length"].sum() <= 2048).all()


STAGES = dict(corpus_pipeline.STAGES)
PIECES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_awkward_rows(spark, name):
    """Nulls, blanks, repeated rows and ties: what each stage keeps of them."""
    docs = awkward(spark)
    out = STAGES[name](spark, docs, SMALL)
    rows = out.collect()
    assert out.columns == (PIECES if name == "best-fit packing" else docs.columns)
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "quality rules":
        assert ids == {3: 1} or not ids  # all others have fewer than ten words
    elif name == "line dedup":
        assert len(rows) == 13 and ids[4] == 3 and ids[None] == 1 and {r.text for r in rows if r.doc_id == 0} == {""}
    elif name == "n-gram Jaccard join":
        assert ids[4] == 1 and ids[5] == 0 and ids[None] == 1 and all(ids[i] == 1 for i in (0, 1, 2, 3, 6, 7, 8, 9))
    elif name == "mixing sources to target weights":
        assert max(ids.values()) <= 6 and ids  # three rows of one id, twice each at most
    else:
        assert ids[4] == 3 and ids[0] == ids[None] == 1 and ids[3] > 1


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_empty_tables(spark, name):
    out = STAGES[name](spark, empty(spark), SMALL)
    assert out.count() == 0 and out.columns == (PIECES if name == "best-fit packing" else empty(spark).columns)


@pytest.mark.parametrize("name", STAGES)
def test_stages_with_clashing_columns(spark, name):
    """More columns, named as the operators name their own, come through as they were and change nothing."""
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"{words} x{i % 3}\nline {i}", "en", f"s{i % 2}", 0) for i in range(12)], SCHEMA)
    more = crowded(docs).withColumns({n: F.lit(8) for n in ("row", "content", "__copy", "copies2", "doc0_doc_id")})
    plain, out = (STAGES[name](spark, d, SMALL) for d in (docs, more))
    same = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(str, out.select(*same).collect())) == sorted(map(str, plain.select(*same).collect()))
    if name != "best-fit packing":
        assert out.columns == more.columns
        added = [c for c in more.columns if c not in docs.columns]
        assert {tuple(r) for r in out.select(*added).collect()} <= {tuple(r) for r in more.select(*added).collect()}


def test_a_blank_line_of_many_documents_is_no_link(spark):
    """The whole pipeline on clean documents that share nothing keeps all of them up to mixing."""
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{k}" for k in range(40)) + "\n\n" + " ".join(f"more{i}x{k}" for k in range(20)), "en", "s", 0) for i in range(15)], SCHEMA)
    for name in list(STAGES)[:3]:
        docs = materialize(STAGES[name](spark, docs, SMALL))
        assert docs.count() == 15, name
