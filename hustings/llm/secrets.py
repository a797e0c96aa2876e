"""Secret scans: credentials in text, told apart by how many repositories and owners hold the same value."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import documents, join_counted, materialize, private_names

#: name, pattern, group that holds the value, least code points of the value. Base kinds first, in their order; `token` is the method's own.
KINDS = (
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run's leftmost match is the whole run, so the length can stand in the pattern
    ("token", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
BASE = 3


#: Matches are added up in blocks of so many: within a block, then over the blocks.
BLOCK = 128


def _blocks(text: Column, number: int) -> Column:
    """The matches of a kind with values long enough, in blocks (start, end, found): start, kind's number, end, hash of the value of each.

    The text cut at the matches gives what lies between them, so starts are sums of lengths; all lengths are code points. Sums run inside blocks of
    matches and over the blocks, so that a text with very many matches does not copy a growing array for each.
    """
    name, pattern, group, least = KINDS[number]
    whole, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), values.alias("value"))
    spans = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string>>")
    blocks = F.array().cast("array<struct<start:int,end:int,found:array<struct<start:int,kind:int,end:int,hash:string>>>>")

    def step(at: Column, part: Column) -> Column:
        start = at["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        good = F.length(part["value"]) >= least
        if number >= BASE:
            good = good & part["value"].rlike("[0-9]") & part["value"].rlike("[A-Za-z]")
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), F.sha2(part["value"], 256).alias("hash"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(good, F.concat(at["found"], F.array(span))).otherwise(at["found"]).alias("found"))

    def moved(at: Column, block: Column) -> Column:
        by = at["at"]
        found = F.transform(block["found"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["hash"].alias("hash")))
        end = by + block["at"]
        return F.struct(end.alias("at"), F.when(F.size(found) > 0, F.concat(at["blocks"], F.array(F.struct(by.alias("start"), end.alias("end"), found.alias("found"))))).otherwise(at["blocks"]).alias("blocks"))

    first = F.struct(F.lit(0).alias("at"), spans.alias("found"))
    each = F.transform(F.sequence(F.lit(0), F.ceil(F.size(parts) / BLOCK).cast("int") - 1), lambda b: F.aggregate(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)), first, step))
    found = F.aggregate(each, F.struct(F.lit(0).alias("at"), blocks.alias("blocks")), moved, lambda at: at["blocks"])
    return F.when(text.rlike(pattern), found).otherwise(blocks)


def _flat(*kinds: str) -> Column:
    """The spans of some kinds' blocks."""
    return F.concat(*[F.flatten(F.transform(k, lambda b: b["found"])) for k in kinds])


def _written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start, then kind."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


@private_names
def scan_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2) -> DataFrame:
    """One row per row of ``docs``: its other columns (without the text), ``base`` and ``owned`` spans, ``n_live``, ``n_example``, ``most_owners``
    and ``most_repositories``.

    ``base`` has the spans of the fixed kinds. Candidates are these and unnamed tokens (20 or more characters of the base64 alphabets, with a letter
    and a digit, that overlap no base span). For each candidate value, distinct repositories and owners are counted over the whole corpus: a
    value with at most ``max_owners`` owners and at most ``max_repositories`` repositories is live-looking, one with more of either a widely copied
    example. Unnamed tokens that are live-looking are the ``owned`` spans; ``n_live`` and ``n_example`` count the row's candidates of each sort,
    ``most_owners`` and ``most_repositories`` are the largest counts of its candidates' values (0 without candidates).

    A null text is empty; a null owner or repository is a value of its own. Repeated rows stay. Columns of the names above in ``docs`` are replaced,
    all others pass through. An empty table gives an empty one.

    One pass reads the texts; what it finds goes to the shared folder, and only hashes are counted: by (value, owner, repository) with partial
    sums, so a value copied everywhere shuffles a row for each owner and task. On the way back to the rows, hot values are dealt to several tasks.
    """
    made = ("base", "owned", "n_live", "n_example", "most_owners", "most_repositories")
    other = [c for c in docs.columns if c not in (text, *made)]
    kinds = [f"__k{k}" for k in range(len(KINDS))]
    found = docs.select(*other, F.col(owner).alias("__owner"), F.struct(*repository).alias("__repository"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    found = found.select("*", *[_blocks(F.col("__text"), k).alias(kinds[k]) for k in range(len(KINDS))])
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    covered = lambda s: [F.exists(k, lambda b: meets(b, s) & F.exists(b["found"], lambda x: meets(x, s))) for k in kinds[:BASE]]
    apart = F.filter(_flat(kinds[BASE]), lambda s: ~(covered(s)[0] | covered(s)[1] | covered(s)[2]))
    found = materialize(found.select(*other, "__owner", "__repository", _flat(*kinds[:BASE]).alias("base"), apart.alias("__token"), F.monotonically_increasing_id().alias("__row")))

    each = found.select("__row", "__owner", "__repository", F.explode(F.concat("base", "__token")).alias("__s")).select("*", F.col("__s.hash").alias("__hash"))
    repositories = each.groupBy("__hash", "__owner", "__repository").agg(F.count(F.lit(1)).alias("__n"))
    owners = repositories.groupBy("__hash", "__owner").agg(F.count(F.lit(1)).alias("__repositories"), F.sum("__n").alias("__n"))
    values = materialize(owners.groupBy("__hash").agg(F.count(F.lit(1)).alias("__owners"), F.sum("__repositories").alias("__repositories"), F.sum("__n").alias("__n")))
    told = join_counted(each.select("__row", "__s", "__hash"), values, ["__hash"], "__n", "__row")
    live = (F.col("__owners") <= max_owners) & (F.col("__repositories") <= max_repositories)
    owned = F.collect_list(F.when(live & (F.col("__s.kind") >= BASE), F.col("__s")))
    rows = told.groupBy("__row").agg(owned.alias("owned"), F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"), F.max("__owners").alias("most_owners"), F.max("__repositories").alias("most_repositories"))
    joined = found.join(rows, "__row", "left")
    none = F.array().cast(joined.schema["owned"].dataType)
    return joined.select(*other, "base", F.coalesce("owned", none).alias("owned"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in made[2:]])


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; an owner is a source, a repository a source and a language."""
    out = scan_secrets(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k][0]}")
    return out.select("doc_id", *[count(k) for k in range(BASE)], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "owned")).alias("spans"), "n_live", "n_example", "most_owners", "most_repositories")


def _kind_sql(number: int) -> str:
    name, pattern, group, least = KINDS[number]
    pattern = pattern.replace("'", "''")
    more = " AND regexp_matches(vs[i], '[0-9]') AND regexp_matches(vs[i], '[A-Za-z]')" if number >= BASE else ""
    return f"""
  SELECT row_id, {number} AS kind, vs[i] AS v, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s, length(ms[i]) AS n
  FROM (SELECT row_id, gs, ms, vs, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT row_id, string_split_regex(t, '{pattern}') AS gs, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS vs FROM d WHERE regexp_matches(t, '{pattern}')))
  WHERE length(vs[i]) >= {least}{more}"""


_NAME_SQL = "CASE kind " + " ".join(f"WHEN {i} THEN '{k[0]}'" for i, k in enumerate(KINDS)) + " END || ':' || s || ':' || (s + n)"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join(_kind_sql(k) for k in range(BASE))}),
loose AS ({_kind_sql(BASE)}),
cand AS (
  SELECT * FROM base
  UNION ALL SELECT * FROM loose l WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_id = l.row_id AND b.s < l.s + l.n AND l.s < b.s + b.n)
),
owners AS (
  SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT {{'s': coalesce('=' || source, ''), 'l': coalesce('=' || lang, '')}}) AS repositories
  FROM cand JOIN d USING (row_id) GROUP BY v
),
told AS (SELECT row_id, kind, s, n, owners, repositories, owners <= 1 AND repositories <= 2 AS live FROM cand JOIN owners USING (v)),
agg AS (
  SELECT row_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg({_NAME_SQL}, ',' ORDER BY s, kind) FILTER (kind < {BASE}) AS b, string_agg({_NAME_SQL}, ',' ORDER BY s, kind) FILTER (kind < {BASE} OR live) AS a,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(owners) AS most_owners, max(repositories) AS most_repositories
  FROM told GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
       coalesce(a, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN agg USING (row_id)
"""
