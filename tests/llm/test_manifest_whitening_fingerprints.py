"""The Merkle manifest, whitening and document fingerprints against plain versions, and on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from hustings.llm import edit_embedding, merkle, whitening
from test_operators import SMALL, awkward, crowded, empty

# 11


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """Rows (group, order, leaf, claimed) with subroot, root, siblings, folded root."""

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([r[2] for r in groups[g]]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            folded, siblings = r[3] or r[2], []
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    siblings.append(other)
                    folded = sha(other + folded if at & 1 else folded + other)
                    at >>= 1
            out.append((r[0], r[1], trees[k][-1][0], top[-1][0], "".join(siblings), folded, folded == top[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_manifest_of_groups_of_many_sizes(spark, levels):
    rng = random.Random(levels)
    rows = [(g, i, sha(f"{g}{i}"), sha("other") if rng.random() < 0.2 else None) for g, n in ((None, 9), ("", 1), ("a", 8), ("é", 23), ("z", 2)) for i in rng.sample(range(100), n)]
    rows += [("a", None, sha("no id"), None), ("a", 5000, sha("twice"), None), ("a", 5000, sha("twice"), None)]
    df = spark.createDataFrame(rows, "grp string, id int, leaf string, claimed string").repartition(5)
    out = merkle.merkle_manifest(df, "grp", ("id",), levels=levels).collect()
    got = sorted(str((r.grp, r.id, r.subroot, r.root, "".join(x[1:] for x in r.path), r.folded_root, r.verified)) for r in out)
    assert got == brute_manifest(rows)
    assert {r.verified for r in out if r.claimed is None} == {True} and {r.verified for r in out if r.claimed} == {False}


def test_manifest_of_awkward_documents(spark):
    def leaf(d):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d.doc_id, d.source, d.lang, d.n_chars, d.text)))

    docs = awkward(spark).withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    leaves = docs.select("*", merkle.leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"), F.lit(None).cast("string").alias("claimed"))
    rows = [(d.lang, d.doc_id, leaf(d), None) for d in docs.collect()]
    out = merkle.merkle_manifest(leaves, "lang", ("doc_id",))
    assert sorted(str((r.lang, r.doc_id, r.subroot, r.root, "".join(x[1:] for x in r.path), r.folded_root, r.verified)) for r in out.collect()) == brute_manifest(rows)
    crowd = crowded(leaves).withColumns({c: F.lit(3) for c in ("root", "tree", "at", "hash", "block", "own", "height", "claim", "c0", "__rank", "__g")})
    assert sorted(r.folded_root for r in merkle.merkle_manifest(crowd, "lang", ("doc_id",)).collect()) == sorted(r.folded_root for r in out.collect())
    none = merkle.merkle_manifest(leaves.filter("false"), "lang", ("doc_id",))
    assert none.columns == out.columns and none.count() == 0


def test_only_tampered_rows_fail(spark):
    rows = merkle.op11_merkle_manifest(spark, SMALL).collect()
    known = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in rows if not r.verified} == {i for i, n in known.items() if n is not None and zlib.crc32(str(i).encode()) % 7 == 0}


# 12


def brute_whitening(vectors, wanted=16):
    x = np.array([[int(np.floor(np.float64(c) * 64)) + 1000000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_whitening_against_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(200)]
    bad = [(-1, None), (-2, []), (-3, [1.0] * 19 + [None]), (-4, [float("nan")] * 20), (-5, [1.0] * 19 + [float("inf")]), (-6, [2.0] * 7), (None, base[1].tolist())]
    got = whitening.whiten(embeddings(spark, rows + bad).repartition(4)).toPandas()
    n, deviation, whitened, explained = brute_whitening([v for _, v in rows])
    assert got["n"].unique().tolist() == [n] and len(got) == 16 * (len(rows) + 1) and got["vec_id"].isna().sum() == 16
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    table = got.dropna(subset="vec_id").sort_values(["vec_id", "component"])
    assert table["deviation"].to_numpy().reshape(-1, 16)[:, 0].tolist() == deviation.tolist()
    mine = table["whitened"].to_numpy().reshape(-1, 16)
    sign = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine - whitened * sign).max() < 1e-8
    assert np.abs(table["explained"].to_numpy().reshape(-1, 16)[0] - explained).max() < 1e-12


def test_components_without_variance_are_left_out(spark):
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).count() == 0
    out = whitening.whiten(embeddings(spark, [(1, [1.0, 1.0, 0.0]), (2, [-1.0, -1.0, 0.0]), (3, [3.0, 3.0, 0.0])])).toPandas()
    assert out["component"].tolist() == [1, 1, 1] and out["explained"].round(12).tolist() == [1.0] * 3


@pytest.mark.parametrize("seed", range(8))
def test_intervals_and_contours_miss_no_eigenvalue(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 70))
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.sort(rng.choice([5.0, 5.0, 2.0, 1.0, 1 + 1e-8, 1e-3, 0.0], d) if seed % 2 else rng.lognormal(0, 3, d))[::-1]
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    for shift in (values[0] * 0.7, values[d // 2] * 1.01 + 1e-6):
        assert whitening.positive_count(matrix, shift) == (values > shift).sum()
    pairs = [whitening.feast(matrix, *span) for span in whitening.intervals(matrix, 16)]
    found = np.sort(np.concatenate([v for v, _ in pairs]))[::-1][:16]
    assert len(found) >= min(16, (values > 1e-9 * values[0]).sum())
    assert np.allclose(found, values[: len(found)], rtol=1e-9, atol=1e-12 * values[0])
    for v, u in pairs:
        assert np.abs(matrix @ u - u * v).max() < 1e-11 * values[0] and np.abs(u.T @ u - np.eye(len(v))).max() < 1e-12


# 13


def brute_embedding(walker, text, walk):
    """Step by step: the place in the text under each step of the walk."""
    bits = (np.random.PCG64(edit_embedding.SEED).random_raw(2 * 1024 * 64) >> np.uint64(63)).astype(bool).reshape(2, 1024, 64)[walk]
    at, step, out = 0, 0, []
    while at < len(text):
        out.append(at)
        at += bool(bits[step % 1024][ord(text[at]) * 0x9E3779B1 % 2**32 >> 26])
        step += 1
    return out


def test_walks_go_step_by_step():
    walker = edit_embedding.Embedding()
    text = "Füchse \U0001f600 jagen über das Feld. " * 60
    codes = walker.codes(text)
    for k, steps in enumerate(walker.walk(codes, [0, 0])):
        under = brute_embedding(walker, text, k)
        assert (np.flatnonzero(np.diff([*under, len(text)])) + 1 == np.cumsum(np.diff(steps, prepend=0) % 1024)).all()


def test_long_texts_are_walked_in_pieces(monkeypatch):
    text = "".join(random.Random(3).choices("abcdefgh \n", k=5000))
    whole = edit_embedding.Embedding().of(text)
    monkeypatch.setattr(edit_embedding, "CHUNK", 77)
    assert (edit_embedding.Embedding().of(text) == whole).all()


def test_few_edits_change_few_samples():
    rng, walker = random.Random(9), edit_embedding.Embedding()
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(40)]
    likes = {0: [], 1: [], 4: [], "other": []}
    for i, t in enumerate(texts):
        for k in (0, 1, 4):
            edited = list(t)
            for _ in range(k):
                j = rng.randrange(len(edited))
                edited[j : j + rng.randint(0, 1)] = rng.choice(["", "x"])
            likes[k].append(edit_embedding.likeness(walker.of(t), walker.of("".join(edited))))
        likes["other"].append(edit_embedding.likeness(walker.of(t), walker.of(texts[i - 1])))
    mean = {k: sum(v) / len(v) for k, v in likes.items()}
    assert min(likes[0]) == 1 and mean[1] > 0.9 and mean[4] > 0.75 and mean["other"] < 0.05


def test_edited_by_the_next_in_ranges(spark):
    docs = awkward(spark).unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100).select("doc_id", "text", "lang", "source", "n_chars"))
    walker = edit_embedding.Embedding()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.text or "") for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()))
    want = []
    for i, (known, at, _, text) in enumerate(rows):
        after, n = rows[(i + 1) % len(rows)][3], len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        a, b, c = walker.of(text), walker.of(edited), walker.of(after)
        want.append(str((at if known else None, n, sha(edited), edit_embedding.as_text(a), edit_embedding.as_text(b), edit_embedding.likeness(a, b), edit_embedding.likeness(a, c))))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = edit_embedding.edited_by_next(docs).collect()
        assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)) for r in got) == sorted(want)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert edit_embedding.edited_by_next(empty(spark)).count() == 0
    one = edit_embedding.edited_by_next(docs.filter("doc_id = 3")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, sha(LONG_EDITED))


from test_operators import LONG  # noqa: E402

LONG_EDITED = LONG[: len(LONG) - len(LONG) // 2] + LONG[: len(LONG) // 2]


def test_fingerprints_keep_columns(spark):
    plain = edit_embedding.with_fingerprints(awkward(spark)).select("doc_id", "fingerprint").collect()
    assert sorted(map(str, edit_embedding.with_fingerprints(crowded(awkward(spark)).withColumn("fingerprint", F.lit(1))).select("doc_id", "fingerprint").collect())) == sorted(map(str, plain))
    assert len({r.fingerprint for r in plain if r.doc_id in (4, 5)}) == 1 and edit_embedding.with_fingerprints(empty(spark)).count() == 0


def test_near_classes_of_copies_and_strangers(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400)]
    rows, want = [], {}
    for c in range(12):
        text = " ".join(rng.choices(words, k=300))
        for k in range(20 if c == 0 else 3):
            i = len(rows)
            rows.append((i, text if k % 2 == 0 else text[:-1] + "!"))
            want[i] = want.get(i, min(j for j, r in enumerate(rows) if r[1][:50] == text[:50]))
    rows.append((999, None))
    got = {r.id: r.near_class for r in edit_embedding.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {**want, 999: 999}
    assert edit_embedding.near_classes(empty(spark)).count() == 0


def test_likeness_columns_agree(spark):
    walker = edit_embedding.Embedding()
    a, b = walker.of("one two three four five six"), walker.of("one two three four five sex")
    df = spark.createDataFrame([(edit_embedding.as_text(a), edit_embedding.as_text(b))], "a string, b string")
    row = df.select(edit_embedding.likeness_of(F.col("a"), F.col("b")).alias("x"), F.arrays_overlap(edit_embedding.bands(F.col("a")), edit_embedding.bands(F.col("b"))).alias("y")).first()
    assert abs(row.x - edit_embedding.likeness(a, b)) < 1e-12 and row.y == edit_embedding.share_a_band(a, b)
