"""A Merkle manifest of a dataset: leaves, subroots by group, one root, proofs, and what a tampered row makes of the root."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from hustings.operators.windows import ranked_in_group

from .common import documents, materialize, set_apart

#: Levels of a superblock: 2 to this power nodes are in one at most.
LEVELS = 10


def leaf_hash(*values: Column) -> Column:
    """H (lowercase hex SHA-256) of values: each "-" if null, else its length in UTF-8 bytes, ":", and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def join_hashes(hashes: Sequence[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def rounds(hashes: list[str], levels: int) -> list[list[str]]:
    """The rows of nodes from ``hashes`` up to ``levels`` levels above; of each two that follow, the node above is their H, or that of a last one alone."""
    rows = [hashes]
    for _ in range(levels):
        below = rows[-1]
        rows.append([join_hashes(below[i : i + 2]) for i in range(0, len(below), 2)])
    return rows


def path_of(rows: list[list[str]], at: int) -> list[str]:
    """For each level below the top, how node ``at`` goes up: "L" or "R" and the hash of the sibling on that side, or "A" where it is alone."""
    path = []
    for row in rows[:-1]:
        other = at ^ 1
        path.append("A" if other >= len(row) else ("L" if other < at else "R") + row[other])
        at >>= 1
    return path


def fold(hash: str, path: Sequence[str]) -> str:
    """The hash at the end of a path."""
    for step in path:
        hash = join_hashes([step[1:], hash] if step[0] == "L" else [hash, step[1:]])
    return hash


def _reduce(nodes: DataFrame, levels: int) -> DataFrame:
    """Rows (tree, at, hash, height): the nodes above the superblocks of ``nodes``, ``levels`` levels up or as many as their tree has left."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        up = min(levels, int(block["height"].iloc[0]))
        top = rounds(block["hash"].tolist(), up)[-1]
        first = block.iloc[0]
        return pd.DataFrame({"tree": [first["tree"]], "at": [int(first["at"]) >> levels], "hash": top, "height": [int(first["height"]) - up]})

    return nodes.select("tree", "at", "hash", "height", F.shiftright("at", levels).alias("block")).groupBy("tree", "block").applyInPandas(run, "tree long, at long, hash string, height int")


def _exchange(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Rows (tree, at, path): how each node goes up to its tree's root, from the ``path`` of the nodes above the superblocks.

    The nodes of a superblock and the outer nodes that they need, which are those of the path of the node above it, meet in a cogroup: siblings inside
    come from reducing the block once more, and the path outside is the same for all of them.
    """

    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        rows = rounds(block["hash"].tolist(), min(levels, int(block["height"].iloc[0])))
        rest = [x for x in outer["path"].iloc[0].split(",") if x]
        paths = [",".join(path_of(rows, i) + rest) for i in range(len(block))]
        return pd.DataFrame({"tree": block["tree"], "at": block["at"], "path": paths})

    inner = nodes.select("tree", "at", "hash", "height", F.shiftright("at", levels).alias("block"))
    outer = above.select("tree", F.col("at").alias("block"), "path")
    return inner.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, "tree long, at long, path string")


def _height(n: Column) -> Column:
    """How many times n nodes are halved, rounded up, until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes at every ``levels``-th level over ``nodes`` (tree, at, hash, height), all but the last written; and the roots (tree, hash).

    Each table has a 2 to the power of ``levels``-th of the rows of the one before.
    """
    tables = [nodes]
    left = nodes.agg(F.max("height")).first()[0] or 0
    while left > 0:
        tables.append(materialize(_reduce(tables[-1], levels)))
        left -= levels
    return tables, tables[-1].select("tree", "hash")


def _paths_above(tables: list[DataFrame], levels: int) -> DataFrame:
    """Rows (tree, at, path) of the nodes of ``tables[1]``, from the roots down: a superblock of superblocks at a time."""
    paths = tables[-1].select("tree", "at", F.lit("").alias("path"))
    for table in tables[-2:0:-1]:
        paths = materialize(_exchange(table, paths, levels))
    return paths


def merkle_manifest(leaves: DataFrame, group: str, order: tuple[str, ...], leaf: str = "leaf", claimed: str = "claimed", levels: int = LEVELS) -> DataFrame:
    """``leaves`` with subroot, root, path, folded_root and verified.

    The leaves of each ``group`` (null is one) ascend by ``order`` (nulls first, ties by leaf hash, so that leaves that tie are alike); each two that
    follow are hashed together, a last one alone, until one is left: the subroot. The subroots, in the order of their groups, give the root in
    the same way. ``path`` says how a leaf goes up to the root, level by level, through its subroot: an entry "L" or "R" and the sibling's
    hash by the side where it stands, or "A" where it has none. folded_root is what ``claimed``, or the leaf where that is null, gives along
    the path, and verified whether it is the root.

    A tree is cut into superblocks of 2 to the power of ``levels`` leaves, those of superblocks of superblocks, and so on. First each superblock is
    reduced to the node above it; then the leaves of one and the outer nodes that they need are cogrouped, and the local reduction, the joining
    of proofs and the folding are finished together. So a group of any size is many tasks, and no task has more than a superblock. Leaf hashes
    are all that is shuffled: ``leaves`` should hold no texts. Rows are ranked by ranges, also inside a group. Columns with the names of results
    are replaced, others pass through. An empty table gives an empty one.
    """
    made = ("subroot", "root", "path", "folded_root", "verified")
    kept = [c for c in leaves.columns if c not in made]
    inside, names = set_apart(leaves.select(*[F.col(f"`{c}`") for c in kept]))
    group, leaf, claimed = names[group], names[leaf], names[claimed]
    placed = [F.col(names[c]).asc_nulls_first() for c in order]
    ranked = materialize(ranked_in_group(inside, [group], [*placed, F.col(leaf)], "__rank"))
    counts = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    trees = ranked_in_group(counts, [], [F.col(group).asc_nulls_first()], "__tree")
    trees = materialize(trees.select(F.col(group).alias("__g"), (F.col("__tree") - 1).alias("tree"), _height(F.col("__n")).alias("height")))
    rows = ranked.join(trees, F.col(group).eqNullSafe(F.col("__g"))).withColumn("at", F.col("__rank") - 1)
    nodes = rows.select("tree", "at", F.col(leaf).alias("hash"), "height")
    tables, roots = _climb(nodes, levels)
    # the tree of the subroots: tree 0, a leaf a group
    top = materialize(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "hash", F.lit(max(0, roots.count() - 1).bit_length()).alias("height")))
    top_tables, root = _climb(top, levels)
    root_hash = root.first()
    if len(top_tables) > 1:
        top_paths = _exchange(top, _paths_above(top_tables, levels), levels)
    else:
        top_paths = top.select("tree", "at", F.lit("").alias("path"))
    top_paths = materialize(top_paths.join(top.select("at", "hash"), "at").select(F.col("at").alias("tree"), F.col("hash").alias("subroot"), F.col("path").alias("top_path")))
    inner = _paths_above(tables, levels) if len(tables) > 1 else materialize(nodes.select("tree", "at", F.lit("").alias("path")))
    # a superblock that is a whole tree has no path of its own; all paths go on with that of the subroot
    join = F.concat_ws(",", F.nullif("path", F.lit("")), F.nullif("top_path", F.lit("")))
    outer = inner.join(top_paths, "tree").select("tree", F.col("at").alias("block"), join.alias("path"), "subroot", F.lit(root_hash[1] if root_hash else None).cast("string").alias("root"))
    blocks = rows.select("tree", "at", F.col(leaf).alias("hash"), "height", F.coalesce(F.col(claimed), F.col(leaf)).alias("claim"), F.struct(*names.values()).alias("own"), F.shiftright("at", levels).alias("block"))
    own_type = dict(blocks.dtypes)["own"]

    def run(block: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        local = rounds(block["hash"].tolist(), min(levels, int(block["height"].iloc[0])))
        rest = [x for x in out["path"].iloc[0].split(",") if x]
        subroot, root = out["subroot"].iloc[0], out["root"].iloc[0]
        paths = [path_of(local, i) + rest for i in range(len(block))]
        folded = [fold(h, p) for h, p in zip(block["claim"], paths, strict=True)]
        return pd.DataFrame({"own": block["own"], "subroot": subroot, "root": root, "path": paths, "folded_root": folded, "verified": [f == root for f in folded]})

    done = blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(run, f"own {own_type}, subroot string, root string, path array<string>, folded_root string, verified boolean")
    return done.select(*[F.col(f"own.{n}").alias(c) for c, n in names.items()], *made)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language; where 7 divides the CRC-32 of the id, n_chars is one more than the leaf says."""
    docs = documents(spark, sf_dir)
    leaf = lambda n: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claimed = F.when(tampered, leaf(F.col("n_chars") + 1))
    leaves = materialize(docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), claimed.alias("claimed")))
    out = merkle_manifest(leaves, "lang", ("doc_id",))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.substring(x, 2, 64)), ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, leaves: str) -> str:
    """Rows (tree, lvl, pos, h, m): all nodes over ``leaves`` (tree, pos, h, m), where m is how many a level has."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, pos, h, m FROM {leaves}
  UNION ALL SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (m + 1) // 2 FROM {name} WHERE m > 1 GROUP BY tree, lvl, pos // 2, m)"""


#: CRC-32 bit by bit, from the lowest bit of each byte on (the polynomial and the first and last masks are the standard's fixed values).
_CRC_SQL = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: (ord(c) >> b) & 1)))),
   lambda r, b: xor(r >> 1, CASE WHEN xor(r, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {_CRC_SQL} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS claim FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS m FROM leaves
), {_tree_sql('nodes', 'placed')}, subroots AS (
  SELECT tree AS lang_tree, 0 AS tree, tree AS pos, h, count(*) OVER () AS m FROM nodes WHERE m = 1
), {_tree_sql('tops', 'subroots')}, steps AS (
  SELECT p.rid, 0 AS part, n.lvl, n.pos, s.h FROM placed p JOIN nodes n ON n.tree = p.tree AND n.pos = p.pos >> n.lvl AND n.m > 1 LEFT JOIN nodes s ON s.tree = n.tree AND s.lvl = n.lvl AND s.pos = xor(n.pos, 1)
  UNION ALL
  SELECT p.rid, 1, n.lvl, n.pos, s.h FROM placed p JOIN tops n ON n.pos = p.tree >> n.lvl AND n.m > 1 LEFT JOIN tops s ON s.lvl = n.lvl AND s.pos = xor(n.pos, 1)
), paths AS (
  SELECT rid, list(CASE WHEN h IS NULL THEN 'A' WHEN pos % 2 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY part, lvl) AS path FROM steps GROUP BY rid
), folded AS (
  SELECT p.*, sha256(coalesce(list_aggregate(list_transform(path, lambda s: s[2:]), 'string_agg', ''), '')) AS proof_sha256,
         list_reduce(list_concat([claim], coalesce(path, [])), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM placed p LEFT JOIN paths USING (rid)
)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, proof_sha256, folded_root, folded_root = t.h AS verified
FROM folded f JOIN subroots s ON s.lang_tree = f.tree JOIN tops t ON t.m = 1
"""
