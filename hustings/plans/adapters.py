"""The library's input shapes as views of a star schema: each is a DataFrame and the SQL text of the same rows."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from hustings.operators.joins import CLUSTERS
from hustings.operators.methods import SIDES, TRANSFERS
from hustings.shared import spread

NOW_MID, NOW_LATE = "1998-07-01 00:00:00", "2002-01-01 00:00:00"
PARTIES = {"1-URGENT": "L1", "2-HIGH": "L1", "3-MEDIUM": "L2", "4-NOT SPECIFIED": "L3", "5-LOW": "L4"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def precinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as precincts: nations are counties, so a county is in one constituency; market segments are districts, which span several."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        F.col("c_custkey").alias("Shape_ID"),
        F.col("c_nationkey").alias("County"),
        (F.col("n_nationkey") % 10).alias("Constituency"),
        (F.col("n_nationkey") % 7).alias("Zone"),
        F.col("r_name").alias("Region"),
        F.col("c_mktsegment").alias("District"),
        F.floor(F.col("c_custkey") / 4).alias("Ward"),
        F.floor(F.abs("c_acctbal") * 10).alias("Population"),
        (F.col("c_custkey") % 50 + 1).cast("double").alias("Area"),
    )


def result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines as result rows: the return flag is the first preference, the line number the second, quantities are votes."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    flags = {"Left": "A", "Right": "R", "MR": "N"}
    cycle = {"Left": ("Right", "MR"), "Right": ("MR", "Left"), "MR": ("Left", "Right")}
    quantity, second = F.col("l_quantity").cast("long"), F.col("l_linenumber") % 3

    def votes(a: str, b: str):
        number = 0 if a == b else cycle[a].index(b) + 1
        return F.coalesce(F.sum(F.when((F.col("l_returnflag") == flags[a]) & (second == number), quantity)), F.lit(0)).alias(f"{a}_{b}")

    sums = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[votes(a, b) for a in SIDES for b in SIDES])
    valid = sum((F.col(c) for c in TRANSFERS[1:]), F.col(TRANSFERS[0]))
    spoil = F.col("o_orderkey") % 7
    never = (F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0)
    return o.join(sums, "o_orderkey").select(
        F.col("o_orderkey").alias("Result_ID"),
        F.col("o_custkey").alias("Shape_ID"),
        (2 * (valid + spoil)).alias("Electorate"),
        (valid + spoil).alias("Turnout"),
        *TRANSFERS,
        spoil.alias("Spoil"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).cast("timestamp").alias("verified_at"),
        F.when(~never, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).cast("timestamp").alias("declared_at"),
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows with their precinct's places; a result whose owner is no customer has none and is left out."""
    return result(spark, sf_dir).join(precinct(spark, sf_dir), "Shape_ID")


def sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (Sector, party, list, votes): orders by priority; priorities are parties of four lists."""
    o = table(spark, sf_dir, "orders")
    names = F.create_map(*[F.lit(x) for kv in PARTIES.items() for x in kv])
    rows = o.groupBy((F.col("o_custkey") % 10).alias("Sector"), F.col("o_orderpriority").alias("party")).agg(F.sum(F.floor("o_totalprice")).cast("long").alias("votes"))
    return rows.select("Sector", "party", names[F.col("party")].alias("list"), "votes")


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentage for each nation and cluster; nation 24 is left out on purpose."""
    n = table(spark, sf_dir, "nation")
    return n.filter("n_nationkey <> 24").select(F.col("n_nationkey").alias("Sub_Region"), F.when(F.col("n_nationkey") % 2 == 0, "A").otherwise("B").alias("Type"), *[((F.col("n_nationkey") * 7 + i) % 100).cast("double").alias(c) for i, c in enumerate(CLUSTERS, 1)])


def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as areas with a number of people in each cluster."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("Area_ID"), F.col("s_nationkey").alias("Sub_Region"), *[((F.col("s_suppkey") * (i + 2)) % 101).cast("double").alias(c) for i, c in enumerate(CLUSTERS, 1)])


def point(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), (F.col("c_custkey") % 97).cast("double").alias("x"), ((F.col("c_custkey") * 31) % 89).cast("double").alias("y"))


def cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as unit squares on a grid of 20 columns, as WKT; brands are groups."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    i, j = (F.col("p_partkey") % 20).cast("string"), F.floor(F.col("p_partkey") / 20).cast("string")
    i1, j1 = (F.col("p_partkey") % 20 + 1).cast("string"), (F.floor(F.col("p_partkey") / 20) + 1).cast("string")
    at = lambda x, y: F.concat_ws(" ", x, y)
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", at(i, j), at(i1, j), at(i1, j1), at(i, j1), at(i, j)), F.lit("))"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), wkt.alias("geometry"))


def plot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as shapes of four forms, as WKT: a rectangle with a hole, a slanted four-sided one (clockwise), one with a dent, a triangle."""
    k = F.col("p_partkey")
    x, y, w, h = (c.cast("double") for c in (k % 20 * 20, F.floor(k / 20) * 20, k % 5 + 2, k % 7 + 2))
    at = lambda *points: F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", (x + a).cast("string"), (y + b).cast("string")) for a, b in (*points, points[0])]), F.lit(")"))
    half, one, zero = F.lit(0.5), F.lit(1.0), F.lit(0.0)
    holed = F.concat(at((zero, zero), (w, zero), (w, h), (zero, h)), F.lit(", "), at((half, half), (half, one), (one, one), (one, half)))
    forms = [holed, at((zero, zero), (zero, h), (w, h + 1), (w, one)), at((zero, zero), (w, zero), (w, one), (one, one), (one, h), (zero, h)), at((zero, zero), (w, zero), (zero, h))]
    body = F.when(k % 4 == 0, forms[0]).when(k % 4 == 1, forms[1]).when(k % 4 == 2, forms[2]).otherwise(forms[3])
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("id"), F.concat(F.lit("POLYGON ("), body, F.lit(")")).alias("geometry"))


def brick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bricks of 2 x 1 whose rows are shifted by half a brick, so that edges overlap in part, as WKT."""
    k = F.col("p_partkey")
    j = F.floor(k / 20)
    x = (k % 20) * 2 + j % 2
    at = lambda *points: F.concat_ws(", ", *[F.concat_ws(" ", (x + a).cast("string"), (j + b).cast("string")) for a, b in points])
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("id"), F.concat(F.lit("POLYGON (("), at((0, 0), (2, 0), (2, 1), (0, 1), (0, 0)), F.lit("))")).alias("geometry"))


def _votes_sql(a: str, b: str) -> str:
    flags = {"Left": "A", "Right": "R", "MR": "N"}
    cycle = {"Left": ("Right", "MR"), "Right": ("MR", "Left"), "MR": ("Left", "Right")}
    number = 0 if a == b else cycle[a].index(b) + 1
    return f"CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = '{flags[a]}' AND l_linenumber % 3 = {number}), 0) AS BIGINT) AS {a}_{b}"


VIEWS = {
    "precinct": """precinct AS (SELECT c_custkey AS Shape_ID, c_nationkey AS County, n_nationkey % 10 AS Constituency, n_nationkey % 7 AS Zone, r_name AS Region, c_mktsegment AS District,
      c_custkey // 4 AS Ward, CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS Population, CAST(c_custkey % 50 + 1 AS DOUBLE) AS Area
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "result": f"""_lines AS (SELECT l_orderkey, {', '.join(_votes_sql(a, b) for a in SIDES for b in SIDES)} FROM lineitem GROUP BY l_orderkey),
    result AS (SELECT o_orderkey AS Result_ID, o_custkey AS Shape_ID, 2 * ({' + '.join(TRANSFERS)} + o_orderkey % 7) AS Electorate, {' + '.join(TRANSFERS)} + o_orderkey % 7 AS Turnout, {', '.join(TRANSFERS)},
      o_orderkey % 7 AS Spoil, o_orderdate AS received_at, o_orderdate + INTERVAL 30 DAY AS verified_at,
      CASE WHEN NOT (o_orderstatus = 'P' AND o_custkey % 3 = 0) THEN o_orderdate + INTERVAL 90 DAY END AS declared_at
      FROM orders JOIN _lines ON o_orderkey = l_orderkey)""",
    "located": "located AS (SELECT r.*, p.* EXCLUDE (Shape_ID) FROM result r JOIN precinct p ON r.Shape_ID = p.Shape_ID)",
    "sector": f"""sector AS (SELECT o_custkey % 10 AS Sector, o_orderpriority AS party, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PARTIES.items())} END AS list,
      CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS votes FROM orders GROUP BY 1, 2)""",
    "rate": f"""rate AS (SELECT n_nationkey AS Sub_Region, CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS Type, {', '.join(f'CAST((n_nationkey * 7 + {i}) % 100 AS DOUBLE) AS {c}' for i, c in enumerate(CLUSTERS, 1))}
      FROM nation WHERE n_nationkey <> 24)""",
    "cluster": f"cluster AS (SELECT s_suppkey AS Area_ID, s_nationkey AS Sub_Region, {', '.join(f'CAST((s_suppkey * {i + 2}) % 101 AS DOUBLE) AS {c}' for i, c in enumerate(CLUSTERS, 1))} FROM supplier)",
    "point": "point AS (SELECT c_custkey AS id, c_nationkey AS grp, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST((c_custkey * 31) % 89 AS DOUBLE) AS y FROM customer)",
    "cell": "cell AS (SELECT p_partkey AS id, p_brand AS grp, p_partkey % 20 AS i, p_partkey // 20 AS j FROM part)",
    # area, perimeter, centre and box of each form of plot, as their formulas say
    "plot": """plot AS (SELECT id, f, CASE f WHEN 0 THEN w * h - 0.25 WHEN 1 THEN w * h WHEN 2 THEN w + h - 1 ELSE w * h / 2 END AS area,
      CASE f WHEN 1 THEN 2 * (h + sqrt(w * w + 1)) WHEN 3 THEN w + h + sqrt(w * w + h * h) ELSE 2 * (w + h) END AS perimeter,
      x + CASE f WHEN 2 THEN (w * w / 2 + (h - 1) / 2) / (w + h - 1) WHEN 3 THEN w / 3 ELSE w / 2 END AS cx,
      y + CASE f WHEN 0 THEN h / 2 WHEN 1 THEN (h + 1) / 2 WHEN 2 THEN (w / 2 + (h - 1) * (h + 1) / 2) / (w + h - 1) ELSE h / 3 END AS cy, x AS x0, y + h + (f = 1)::INT AS y1, f = 1 AS clockwise
      FROM (SELECT p_partkey AS id, p_partkey % 4 AS f, (p_partkey % 5 + 2)::DOUBLE AS w, (p_partkey % 7 + 2)::DOUBLE AS h, (p_partkey % 20 * 20)::DOUBLE AS x, (p_partkey // 20 * 20)::DOUBLE AS y FROM part))""",
    "brick": "brick AS (SELECT p_partkey AS id, p_partkey % 20 * 2 + p_partkey // 20 % 2 AS x, p_partkey // 20 AS j FROM part)",
    # the corners of each square, in order, and its four edges as pairs of corners
    "corner": "corner AS (SELECT id, grp, i + (k IN (1, 2))::INT AS x, j + (k IN (2, 3))::INT AS y, k FROM cell, (SELECT unnest(range(4)) AS k))",
    "edge": """edge AS (SELECT id, grp, least(ax * 100000 + ay, bx * 100000 + by_) AS k1, greatest(ax * 100000 + ay, bx * 100000 + by_) AS k2 FROM (
      SELECT a.id, a.grp, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM corner a JOIN corner b ON a.id = b.id AND b.k = (a.k + 1) % 4))""",
}
NEEDS = {"located": ("precinct", "result"), "corner": ("cell",), "edge": ("cell", "corner")}


def sql(body: str, *views: str, more: str = "") -> str:
    """A query over views: their texts, those they need first, then ``more`` common tables, then ``body``."""
    order: list[str] = []
    for v in views:
        for x in (*NEEDS.get(v, ()), v):
            if x not in order:
                order.append(x)
    parts = [VIEWS[v] for v in order] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body


def status_sql(now: str) -> str:
    """``now`` is a quoted moment or a column."""
    return f"CASE WHEN declared_at <= {now} THEN 'Declared' WHEN verified_at <= {now} THEN 'Counting' WHEN received_at <= {now} THEN 'Verifying' ELSE 'Not Received' END"
