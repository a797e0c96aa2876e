"""Queries on plain tables: projections, filters, joins, aggregates, order, sets, reshaping and checks."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from hustings.functions import numbers as num
from hustings.functions import scores
from hustings.operators import checks, joins, reshape, windows
from hustings.operators.joins import CLUSTERS
from hustings.plans.adapters import cluster, point, precinct, rate, result, sector, sql, table
from hustings.plans.registry import query

REGIONS = {"AFRICA": "South", "AMERICA": "West", "ASIA": "East"}
_CASE = "CASE Region " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGIONS.items())


@query("s006_extra_columns", sql("SELECT Shape_ID, '' AS ward_immigrant, '' AS ward_localists FROM precinct", "precinct"))
def extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.ensure_columns(precinct(spark, sf_dir).select("Shape_ID"), {"Shape_ID": 0, "ward_immigrant": "", "ward_localists": ""})


@query("s007_lean_copy", sql("SELECT * EXCLUDE (Population, Area) FROM precinct", "precinct"))
def lean_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).drop("Population", "Area")


@query("s011_remap_keep", sql(f"SELECT Shape_ID, {_CASE} ELSE Region END AS region FROM precinct", "precinct"))
def remap_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).select("Shape_ID", scores.remap("Region", REGIONS).alias("region"))


@query("s012_remap_or_zero", sql("SELECT Shape_ID, CASE District WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 20 ELSE 0 END AS score FROM precinct", "precinct"))
def remap_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).select("Shape_ID", scores.cases("District", {"BUILDING": 5, "MACHINERY": 20}, 0).alias("score"))


@query("s013_broad_region", sql("SELECT Shape_ID, CASE WHEN Region IN ('ASIA', 'EUROPE') THEN 'Capital' WHEN Region = 'AFRICA' THEN 'Highland' ELSE 'Lowland' END AS broad FROM precinct", "precinct"))
def broad_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).select("Shape_ID", scores.cases("Region", {"ASIA": "Capital", "EUROPE": "Capital", "AFRICA": "Highland"}, "Lowland").alias("broad"))


@query("s014_set_filter", sql("SELECT Shape_ID FROM precinct WHERE Zone IN (1, 3) AND Region = 'ASIA'", "precinct"))
def set_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).filter(F.col("Zone").isin(1, 3) & (F.col("Region") == "ASIA")).select("Shape_ID")


@query("s015_vote_columns", sql("SELECT Result_ID, Left_Left + Left_Right + Left_MR + Right_Left + Right_Right + Right_MR + MR_Left + MR_Right + MR_MR AS votes FROM result", "result"))
def vote_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result(spark, sf_dir)
    metadata = {"Result_ID", "Shape_ID", "Electorate", "Turnout", "Spoil", "received_at", "verified_at", "declared_at"}
    return rows.select("Result_ID", num.total(reshape.vote_columns(rows, metadata)).alias("votes"))


@query("s016_renames", sql(f"SELECT Sub_Region, {', '.join(f'{c} AS {c}_rate' for c in CLUSTERS)} FROM rate", "rate"))
def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.prefixed(rate(spark, sf_dir).select("Sub_Region", *CLUSTERS), list(CLUSTERS), suffix="_rate")


@query("s017_exclusions", sql("SELECT DISTINCT District FROM precinct WHERE District <> '' AND District NOT IN ('FURNITURE')", "precinct"))
def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).filter((F.col("District") != "") & ~F.col("District").isin("FURNITURE")).select("District").distinct()


@query("s018_split_by_category", sql("SELECT 'A' AS part, Sub_Region FROM rate WHERE Type = 'A' UNION ALL SELECT 'B', Sub_Region FROM rate WHERE Type = 'B'", "rate"))
def split_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = reshape.split_by(rate(spark, sf_dir), "Type", ["A", "B"])
    return reshape.union_all([d.select(F.lit(v).alias("part"), "Sub_Region") for v, d in parts.items()])


@query("s019_known_and_modelled", sql("SELECT Shape_ID, CASE WHEN Population > 50000 THEN 'known' ELSE 'modelled' END AS part FROM precinct", "precinct"))
def known_and_modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = precinct(spark, sf_dir)
    known = F.col("Population") > 50_000
    return reshape.union_all([rows.filter(known).select("Shape_ID", F.lit("known").alias("part")), rows.filter(~known).select("Shape_ID", F.lit("modelled").alias("part"))])


@query("s021_box_and_tier_filter", sql("SELECT id FROM point WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 60 AND grp IN (1, 2, 3, 5)", "point"))
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point(spark, sf_dir).filter(F.col("x").between(10, 40) & F.col("y").between(5, 60) & F.col("grp").isin(1, 2, 3, 5)).select("id")


@query("s023_left_join", sql("SELECT p.Shape_ID, r.Type FROM precinct p LEFT JOIN rate r ON p.County = r.Sub_Region", "precinct", "rate"))
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = precinct(spark, sf_dir), rate(spark, sf_dir)
    return p.join(r, p.County == r.Sub_Region, "left").select("Shape_ID", "Type")


WARD_SQL = "ward AS (SELECT District, Ward, CAST(sum(Population) AS BIGINT) AS ward_population FROM precinct GROUP BY District, Ward)"


@query("s024_composite_join", sql("SELECT Shape_ID, ward_population FROM precinct JOIN ward USING (District, Ward)", "precinct", more=WARD_SQL))
def composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = precinct(spark, sf_dir)
    wards = rows.groupBy("District", "Ward").agg(F.sum("Population").alias("ward_population"))
    return rows.join(wards, ["District", "Ward"], "left").select("Shape_ID", "ward_population")


_RATES = ", ".join(f"coalesce(r.{c}, 0) AS rate_{c}" for c in CLUSTERS)


@query("s025_rate_join", sql(f"SELECT c.Area_ID, {_RATES} FROM cluster c LEFT JOIN rate r ON c.Sub_Region = r.Sub_Region AND r.Type = 'A'", "cluster", "rate"))
def rate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.with_rates(cluster(spark, sf_dir), rate(spark, sf_dir), ["Sub_Region"], list(CLUSTERS), type_column="Type", type_value="A", on_missing="zero")
    return out.select("Area_ID", *[f"rate_{c}" for c in CLUSTERS])


@query("s026_missing_keys", sql("SELECT DISTINCT Sub_Region FROM cluster WHERE Sub_Region NOT IN (SELECT Sub_Region FROM rate)", "cluster", "rate"))
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.missing_keys(cluster(spark, sf_dir), rate(spark, sf_dir), ["Sub_Region"])


@query("s027_apply_rates", sql(f"SELECT c.Area_ID, {', '.join(f'round(c.{c} * coalesce(r.{c}, 0) / 100, 6) AS {c}' for c in CLUSTERS)} FROM cluster c LEFT JOIN rate r USING (Sub_Region)", "cluster", "rate"))
def apply_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.apply_rates(cluster(spark, sf_dir), rate(spark, sf_dir), ["Sub_Region"], list(CLUSTERS), divide_by=100, on_missing="zero")
    return out.select("Area_ID", *[F.round(c, 6).alias(c) for c in CLUSTERS])


@query("s028_apply_and_sum", sql(f"SELECT c.Area_ID, round({' + '.join(f'c.{c} * coalesce(r.{c}, 0) / 100' for c in CLUSTERS)}, 6) AS total FROM cluster c LEFT JOIN rate r USING (Sub_Region)", "cluster", "rate"))
def apply_and_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.apply_rates(cluster(spark, sf_dir), rate(spark, sf_dir), ["Sub_Region"], list(CLUSTERS), divide_by=100, total="total", on_missing="zero")
    return out.select("Area_ID", F.round("total", 6).alias("total"))


@query("s029_combined_rates", sql(f"SELECT c.Area_ID, {', '.join(f'round(c.{c} * (coalesce(a.{c}, 0) + coalesce(b.{c}, 0)) / 100, 6) AS {c}' for c in CLUSTERS)} FROM cluster c LEFT JOIN rate a ON c.Sub_Region = a.Sub_Region AND a.Type = 'A' LEFT JOIN rate b ON c.Sub_Region = b.Sub_Region", "cluster", "rate"))
def combined_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rate(spark, sf_dir)
    specs = [{"rates": r, "on": ["Sub_Region"], "type_column": "Type", "type_value": "A", "on_missing": "zero"}, {"rates": r, "on": ["Sub_Region"], "on_missing": "zero"}]
    out = joins.apply_combined_rates(cluster(spark, sf_dir), specs, list(CLUSTERS), 100)
    return out.select("Area_ID", *[F.round(c, 6).alias(c) for c in CLUSTERS])


LONG_SQL = f"cl AS (UNPIVOT cluster ON {', '.join(CLUSTERS)} INTO NAME k VALUE v), rl AS (UNPIVOT rate ON {', '.join(CLUSTERS)} INTO NAME k VALUE r)"


@query("s030_melted_join", sql("SELECT Area_ID, k AS cluster, round(v * r / 100, 6) AS votes FROM cl JOIN rl USING (Sub_Region, k)", "cluster", "rate", more=LONG_SQL))
def melted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reshape.melt(cluster(spark, sf_dir), ["Area_ID", "Sub_Region"], list(CLUSTERS), "cluster", "v")
    r = reshape.melt(rate(spark, sf_dir), ["Sub_Region"], list(CLUSTERS), "cluster", "r")
    return c.join(r, ["Sub_Region", "cluster"]).select("Area_ID", "cluster", F.round(F.col("v") * F.col("r") / 100, 6).alias("votes"))


@query("s031_hierarchy_rollup", sql("SELECT Zone, Constituency, count(*) AS precincts, CAST(sum(Population) AS BIGINT) AS population FROM precinct GROUP BY Zone, Constituency", "precinct"))
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).groupBy("Zone", "Constituency").agg(F.count(F.lit(1)).alias("precincts"), F.sum("Population").alias("population"))


@query("s032_fragment_labels", sql("SELECT Shape_ID, CASE WHEN ward_population > 100000 THEN District || ' (' || Ward || ')' END AS label FROM precinct JOIN ward USING (District, Ward)", "precinct", more=WARD_SQL))
def fragment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = precinct(spark, sf_dir)
    wards = rows.groupBy("District", "Ward").agg(F.sum("Population").alias("p")).filter("p > 100000").select("District", "Ward", F.concat("District", F.lit(" ("), F.col("Ward").cast("string"), F.lit(")")).alias("label"))
    return rows.join(wards, ["District", "Ward"], "left").select("Shape_ID", "label")


@query("s033_members_of_split_district", sql("SELECT Shape_ID FROM precinct WHERE District = 'BUILDING' AND Constituency = 3", "precinct"))
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.members(precinct(spark, sf_dir), {"District": "BUILDING", "Constituency": 3}).select("Shape_ID")


@query("s034_semi_join", sql("SELECT Shape_ID FROM precinct WHERE Shape_ID IN (SELECT Shape_ID FROM result WHERE Spoil = 6)", "precinct", "result"))
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).join(result(spark, sf_dir).filter("Spoil = 6"), "Shape_ID", "left_semi").select("Shape_ID")


@query("s036_full_list_with_zeros", sql("SELECT n_nationkey AS County, coalesce(c, 0) AS n FROM nation LEFT JOIN (SELECT County, count(*) AS c FROM precinct WHERE Population > 90000 GROUP BY County) ON n_nationkey = County", "precinct"))
def full_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("County"))
    counts = precinct(spark, sf_dir).filter("Population > 90000").groupBy("County").agg(F.count(F.lit(1)).alias("n"))
    return joins.with_roster(roster, counts, ["County"], {"n": 0})


@query("s038_fill_from_aggregate", sql("SELECT p.Shape_ID, coalesce(nullif(p.Population, 0) + CASE WHEN p.Shape_ID % 5 = 0 THEN NULL ELSE 0 END, t) AS population FROM precinct p LEFT JOIN (SELECT Shape_ID, CAST(sum(Turnout) AS BIGINT) AS t FROM result GROUP BY Shape_ID) r ON p.Shape_ID = r.Shape_ID", "precinct", "result"))
def fill_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = precinct(spark, sf_dir).select("Shape_ID", F.when(F.col("Shape_ID") % 5 != 0, F.nullif("Population", F.lit(0))).alias("population"))
    sums = result(spark, sf_dir).groupBy("Shape_ID").agg(F.sum("Turnout").alias("t"))
    return joins.fill_from(rows, sums, ["Shape_ID"], "population", "t")


@query("s039_unmatched_count", sql("SELECT count(*) AS n_rows, count(*) FILTER (Shape_ID NOT IN (SELECT Shape_ID FROM precinct WHERE Zone <> 2)) AS n_unmatched FROM result", "precinct", "result"))
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.count_unmatched(result(spark, sf_dir), precinct(spark, sf_dir).filter("Zone <> 2"), ["Shape_ID"])


@query("s048_group_sums", sql(f"SELECT Sub_Region, {', '.join(f'sum({c}) AS {c}' for c in CLUSTERS)} FROM cluster GROUP BY Sub_Region", "cluster"))
def group_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, sf_dir).groupBy("Sub_Region").agg(*[F.sum(c).alias(c) for c in CLUSTERS])


@query("s049_first_and_sum", sql("SELECT County, arg_min(District, Shape_ID) AS district, CAST(sum(Population) AS BIGINT) AS population FROM precinct GROUP BY County", "precinct"))
def first_and_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).groupBy("County").agg(F.min_by("District", "Shape_ID").alias("district"), F.sum("Population").alias("population"))


@query("s050_total_row", sql("SELECT CASE WHEN GROUPING(Zone) = 1 THEN 'Total' ELSE CAST(Zone AS VARCHAR) END AS Zone, CAST(sum(Population) AS BIGINT) AS population, sum(Area) AS area, round(sum(Population) / sum(Area), 6) AS density FROM precinct GROUP BY ROLLUP (Zone)", "precinct"))
def total_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = {"population": F.sum("Population"), "area": F.sum("Area")}
    return reshape.with_totals(precinct(spark, sf_dir), ["Zone"], sums, {"density": F.round(F.col("population") / F.col("area"), 6)})


@query("s051_region_subtotals", sql("SELECT CASE WHEN GROUPING(Region) = 1 THEN 'Total' ELSE Region END AS Region, CASE WHEN GROUPING(Constituency) = 1 THEN 'Total' ELSE CAST(Constituency AS VARCHAR) END AS Constituency, count(*) AS n FROM precinct GROUP BY ROLLUP (Region, Constituency)", "precinct"))
def region_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.with_totals(precinct(spark, sf_dir), ["Region", "Constituency"], {"n": F.count(F.lit(1))}, {})


@query("s053_distinct_count", sql("SELECT District, count(DISTINCT Ward) AS wards FROM precinct GROUP BY District", "precinct"))
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precinct(spark, sf_dir).groupBy("District").agg(F.count_distinct("Ward").alias("wards"))


@query("s054_dependency_check", sql("SELECT * FROM (SELECT District, count(DISTINCT Constituency) AS n_Constituency, count(DISTINCT Region) AS n_Region FROM precinct GROUP BY District) WHERE n_Constituency > 1 OR n_Region > 1", "precinct"))
def dependency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.broken_dependency(precinct(spark, sf_dir), "District", ["Constituency", "Region"])


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE"]


@query("s055_category_shares", sql(f"SELECT County, {', '.join(f'round(count(*) FILTER (District = {chr(39)}{s}{chr(39)}) / count(*) * 100, 2) AS {s}' for s in _SEGMENTS)} FROM precinct GROUP BY County", "precinct"))
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.shares_wide(precinct(spark, sf_dir), ["County"], "District", _SEGMENTS)


@query("s056_breakdown", sql("SELECT District, count(*) AS n, CAST(sum(Population) AS BIGINT) AS total, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM precinct WHERE Zone = 2 GROUP BY District", "precinct"))
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.breakdown(precinct(spark, sf_dir).filter("Zone = 2"), "District", F.col("Population"))
    return out.select("District", "n", "total", F.round("percent", 6).alias("percent"))


@query("s057_tally_over_domain", sql("SELECT d AS District, coalesce(n, 0) AS n, coalesce(p, 0) AS population FROM (SELECT unnest(['BUILDING', 'MACHINERY', 'NOWHERE']) AS d) LEFT JOIN (SELECT District, count(*) AS n, CAST(sum(Population) AS BIGINT) AS p FROM precinct GROUP BY District) ON d = District", "precinct"))
def tally_over_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.tally_over_domain(precinct(spark, sf_dir), "District", ["BUILDING", "MACHINERY", "NOWHERE"], {"n": F.count(F.lit(1)), "population": F.sum("Population")})


@query("s059_binned_histogram", sql("SELECT b AS bracket, coalesce(n, 0) AS n FROM (SELECT unnest(['0', '1-2', '3-4', '5-6', '7-8', '9-10', '11-12', '12+']) AS b) LEFT JOIN (SELECT CASE WHEN s <= 0.5 THEN '0' WHEN s <= 2.5 THEN '1-2' WHEN s <= 4.5 THEN '3-4' WHEN s <= 6.5 THEN '5-6' WHEN s <= 8.5 THEN '7-8' WHEN s <= 10.5 THEN '9-10' WHEN s <= 12.5 THEN '11-12' ELSE '12+' END AS k, count(*) AS n FROM (SELECT (Shape_ID % 11) * 0.5 AS s FROM precinct) GROUP BY 1) ON b = k", "precinct"))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = precinct(spark, sf_dir).select(scores.score_bracket((F.col("Shape_ID") % 11) * 0.5).alias("bracket"))
    return reshape.tally_over_domain(rows, "bracket", list(scores.SCORE_LABELS), {"n": F.count(F.lit(1))})


@query("s060_weighted_centre", sql("SELECT grp, round(sum(x * (1 + id % 3)) / sum(1 + id % 3), 6) AS cx, round(sum(y * (1 + id % 3)) / sum(1 + id % 3), 6) AS cy, count(*) AS n FROM point GROUP BY grp", "point"))
def weighted_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hustings.operators.spatial import weighted_centres

    return weighted_centres(point(spark, sf_dir), ["grp"], F.col("id") % 3 + 1).select("grp", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n")


@query("s076_area_balance", sql("SELECT County, before, after, after - before AS difference FROM (SELECT County, coalesce(sum(Area), 0) AS before, coalesce(sum(CASE WHEN Shape_ID % 97 = 0 THEN Area + 1 ELSE Area END) FILTER (Shape_ID % 101 <> 0), 0) AS after FROM precinct GROUP BY County) WHERE abs(after - before) > 5", "precinct"))
def area_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = precinct(spark, sf_dir)
    new = old.filter("Shape_ID % 101 <> 0").withColumn("Area", F.when(F.col("Shape_ID") % 97 == 0, F.col("Area") + 1).otherwise(F.col("Area")))
    return reshape.area_balance(old, new, ["County"], "Area", 5.0)


_ERR_SQL = "e AS (SELECT County, round((sum(Population) - sum(Area) * 2000) / (sum(Area) * 2000) * 100, 1) AS error_pct FROM precinct GROUP BY County)"


@query("s077_error_report", sql("SELECT County, error_pct FROM e", "precinct", more=_ERR_SQL))
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = precinct(spark, sf_dir)
    return checks.error_report(rows.groupBy("County").agg((F.sum("Area") * 2000).alias("expected")), rows.groupBy("County").agg(F.sum("Population").alias("found")), "County").select("County", "error_pct")


@query("s077_mean_error", sql("SELECT round(avg(abs(error_pct)), 6) AS mae FROM e", "precinct", more=_ERR_SQL))
def mean_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_report(spark, sf_dir).agg(F.round(F.avg(F.abs("error_pct")), 6).alias("mae"))


@query("s078_rank_by_distance", sql("SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY x * x + y * y, id) AS rank FROM point", "point"))
def rank_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ranked_in_group(point(spark, sf_dir), ["grp"], [F.col("x") * F.col("x") + F.col("y") * F.col("y"), F.col("id")]).select("id", "grp", F.col("rank").cast("long").alias("rank"))


@query("s079_group_max", sql("SELECT Result_ID, max(received_at) OVER (PARTITION BY Shape_ID) AS barrier FROM result", "result"))
def group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.group_max(result(spark, sf_dir), ["Shape_ID"], "received_at", "barrier").select("Result_ID", "barrier")


@query("s080_dependency_cascade", sql("SELECT County, max(m) AS declared_at FROM (SELECT County, max(declared_at) AS m FROM precinct p JOIN result r USING (Shape_ID) WHERE Zone <= 3 GROUP BY County UNION ALL SELECT County, max(verified_at) FROM precinct p JOIN result r USING (Shape_ID) GROUP BY County) GROUP BY County", "precinct", "result"))
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A county declares when both its own rows and another table's have come."""
    rows = result(spark, sf_dir).join(precinct(spark, sf_dir), "Shape_ID")
    both = rows.filter("Zone <= 3").select("County", F.col("declared_at").alias("m")).unionByName(rows.select("County", F.col("verified_at").alias("m")))
    return both.groupBy("County").agg(F.max("m").alias("declared_at"))


@query("s081_group_rescale", sql("SELECT Shape_ID, round(Population * 100000 / sum(Population * Area) OVER (PARTITION BY County), 6) AS scaled FROM precinct", "precinct"))
def group_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = precinct(spark, sf_dir).withColumn("target", F.lit(100000.0))
    return windows.rescale_to(rows, ["County"], F.col("Population"), F.col("Area"), "target", "scaled").select("Shape_ID", F.round("scaled", 6).alias("scaled"))


@query("s082_first_per_key", sql("SELECT District, Ward, Shape_ID, County FROM (SELECT *, row_number() OVER (PARTITION BY District, Ward ORDER BY Shape_ID) AS n FROM precinct) WHERE n = 1", "precinct"))
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_rows(precinct(spark, sf_dir).select("District", "Ward", "Shape_ID", "County"), ["District", "Ward"], ["Shape_ID"])


@query(
    "s083_clockwise_ids",
    sql(
        "SELECT id, 'G' || grp || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS new_id FROM (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY round(a - floor(a / 6.283185307179586) * 6.283185307179586, 9), dx * dx + dy * dy, x, y, id) AS n FROM (SELECT *, 1.5707963267948966 - atan2(dy, dx) AS a FROM (SELECT *, x - 48.5 AS dx, y - 44.5 AS dy FROM point)))",
        "point",
    ),
)
def clockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = point(spark, sf_dir)
    return windows.clockwise_ids(rows, ["grp"], F.col("x"), F.col("y"), F.lit(48.5), F.lit(44.5), F.concat(F.lit("G"), F.col("grp").cast("string"), F.lit("-")), ties=("id",)).select("id", "new_id")


_IDS_SQL = "ids AS (SELECT CASE WHEN c_custkey % 50 = 7 THEN 'bad' || c_custkey ELSE 'N' || c_nationkey || '-' || (CASE WHEN c_custkey % 11 = 3 THEN c_custkey // 25 + 1 ELSE c_custkey // 25 END + 1) END AS id FROM customer)"


@query(
    "s084_id_problems",
    sql(
        "SELECT id, 'bad format' AS problem FROM ids WHERE id LIKE 'bad%' UNION ALL SELECT id, 'repeated' FROM ids WHERE id NOT LIKE 'bad%' GROUP BY id HAVING count(*) > 1 UNION ALL SELECT g || k, 'missing' FROM (SELECT g, unnest(range(1, m + 1)) AS k FROM (SELECT regexp_extract(id, '^(N[0-9]+-)([0-9]+)$', 1) AS g, max(CAST(regexp_extract(id, '^(N[0-9]+-)([0-9]+)$', 2) AS INT)) AS m FROM ids WHERE id NOT LIKE 'bad%' GROUP BY 1)) WHERE g || k NOT IN (SELECT id FROM ids)",
        more=_IDS_SQL,
    ),
)
def id_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.floor(F.col("c_custkey") / 25)
    number = F.when(F.col("c_custkey") % 11 == 3, k + 1).otherwise(k) + 1
    ids = c.select(F.when(F.col("c_custkey") % 50 == 7, F.concat(F.lit("bad"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("-"), number.cast("string"))).alias("id"))
    return checks.id_problems(ids, "id", "^(N[0-9]+-)([0-9]+)$")


_TOP = "list_sort([{'v': -A1, 'o': 0, 's': 'A1'}, {'v': -B1, 'o': 1, 's': 'B1'}, {'v': -C1, 'o': 2, 's': 'C1'}])"


@query("s085_winner_second_margin", sql(f"SELECT Area_ID, t[1].s AS winner, t[2].s AS second, t[3].s AS third, t[2].v - t[1].v AS margin FROM (SELECT Area_ID, {_TOP} AS t FROM cluster)", "cluster"))
def winner_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hustings.operators.methods import ranked

    r = ranked({c: F.col(c) for c in ("A1", "B1", "C1")})
    return cluster(spark, sf_dir).withColumn("r", r).select("Area_ID", F.col("r")[0]["side"].alias("winner"), F.col("r")[1]["side"].alias("second"), F.col("r")[2]["side"].alias("third"), (F.col("r")[0]["votes"] - F.col("r")[1]["votes"]).alias("margin"))


_SLOTS = """items AS (SELECT Ward, Result_ID, epoch(received_at)::DOUBLE AS r, ceil(Turnout * 1.8 / 7500 * 60 / 15) * 15 / 60 * 3600 AS d,
   CASE WHEN count(*) OVER (PARTITION BY Ward) > 18 THEN 5 ELSE 2 END AS s, row_number() OVER (PARTITION BY Ward ORDER BY Result_ID) AS n FROM located),
 walk AS (SELECT DISTINCT Ward, 0::BIGINT AS n, list_transform(range(s), lambda x: 0.0::DOUBLE) AS free, 0::BIGINT AS Result_ID, 0::INTEGER AS slot, 0.0::DOUBLE AS done FROM items
   UNION ALL
   SELECT Ward, n, list_transform(free, lambda f, j: CASE WHEN j = slot + 1 THEN done ELSE f END), Result_ID, slot, done FROM (
     SELECT i.Ward, i.n, w.free, i.Result_ID, (list_position(w.free, list_min(w.free)) - 1)::INTEGER AS slot, greatest(list_min(w.free), i.r) + i.d AS done FROM walk w JOIN items i ON i.Ward = w.Ward AND i.n = w.n + 1))"""


@query("s086_earliest_free_slot", "WITH RECURSIVE " + sql("SELECT Ward, Result_ID, slot, done FROM walk WHERE n > 0", "located", more=_SLOTS)[5:])
def earliest_free_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wards count their results at two tables, large wards at five."""
    rows = result(spark, sf_dir).join(precinct(spark, sf_dir).select("Shape_ID", "Ward"), "Shape_ID")
    sizes = rows.groupBy("Ward").agg(F.count(F.lit(1)).alias("size"))
    rows = rows.join(sizes, "Ward")
    hours = num.round_up_hours(F.col("Turnout") * 1.8 / 7500, 15)
    return windows.earliest_free_slot(rows, ["Ward"], "Result_ID", F.unix_seconds("received_at"), hours * 3600, F.when(F.col("size") > 18, 5).otherwise(2))


@query("s177_suffixed_keys", sql("SELECT id, CASE WHEN n > 1 THEN c_mktsegment || '_' || n ELSE c_mktsegment END AS key FROM (SELECT c_custkey AS id, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)"))
def suffixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return windows.suffixed_keys(c.select(F.col("c_custkey").alias("id"), "c_mktsegment"), "c_mktsegment", ["id"]).select("id", "key")


@query("s178_free_ids", sql("SELECT grp, grp || '_' || lpad(CAST(k AS VARCHAR), 3, '0') AS new_id FROM (SELECT grp, k, row_number() OVER (PARTITION BY grp ORDER BY k) AS r FROM (SELECT grp, unnest(range(1, 104)) AS k FROM (SELECT DISTINCT grp FROM point)) WHERE (grp, k) NOT IN (SELECT grp, id % 100 + 1 FROM point WHERE id % 3 <> 0)) WHERE r <= 3", "point"))
def free_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = point(spark, sf_dir)
    used = p.filter("id % 3 <> 0").select("grp", (F.col("id") % 100 + 1).alias("k"))
    return windows.free_ids(used, "grp", "k", p.select("grp").distinct().withColumn("n", F.lit(3)), "n")


@query("s087_runs_by_region", sql('SELECT CAST(run AS BIGINT) AS run, Zone, min(Shape_ID) AS "first", max(Shape_ID) AS "last", count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY Region ORDER BY Shape_ID) AS run FROM (SELECT *, CASE WHEN Zone IS NOT DISTINCT FROM lag(Zone) OVER (PARTITION BY Region ORDER BY Shape_ID) THEN 0 ELSE 1 END AS f FROM precinct)) GROUP BY Region, run, Zone', "precinct"))
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.runs_by_region(precinct(spark, sf_dir), "Shape_ID", "Zone", ["Region"]).select("run", "Zone", "first", "last", "n")


@query("s088_natural_sort", sql("SELECT code, row_number() OVER (ORDER BY regexp_extract(code, '^([A-Za-z]*)', 1), CAST(regexp_extract(code, '([0-9]+)$', 1) AS BIGINT)) AS place FROM (SELECT DISTINCT left(c_mktsegment, 1) || (c_nationkey * 7) AS code FROM customer)"))
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "customer").select(F.concat(F.substring("c_mktsegment", 1, 1), (F.col("c_nationkey") * 7).cast("string")).alias("code")).distinct()
    return windows.ranked_in_group(codes, [], reshape.natural_order("code"), "place")


@query("s089_sort_by_size", sql("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey"))
def sort_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, largest absolute value first."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey")


@query("s090_top_row", sql("SELECT County, Shape_ID, Population FROM (SELECT *, row_number() OVER (PARTITION BY County ORDER BY Population DESC, Shape_ID) AS n FROM precinct) WHERE n = 1", "precinct"))
def top_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = precinct(spark, sf_dir).select("County", "Shape_ID", "Population")
    return reshape.top_row(rows, ["County"], F.col("Population"), F.col("Shape_ID"))


@query("s091_leader_first", sql(f"SELECT Area_ID, list_transform(list_sort([{{'l': (Area_ID % 3 <> 0)::INT, 'v': -A1, 'o': 0, 's': 'A1'}}, {{'l': (Area_ID % 3 <> 1)::INT, 'v': -B1, 'o': 1, 's': 'B1'}}, {{'l': (Area_ID % 3 <> 2)::INT, 'v': -C1, 'o': 2, 's': 'C1'}}]), lambda x: x.s)[1] AS first, list_transform(list_sort([{{'l': (Area_ID % 3 <> 0)::INT, 'v': -A1, 'o': 0, 's': 'A1'}}, {{'l': (Area_ID % 3 <> 1)::INT, 'v': -B1, 'o': 1, 's': 'B1'}}, {{'l': (Area_ID % 3 <> 2)::INT, 'v': -C1, 'o': 2, 's': 'C1'}}]), lambda x: x.s)[2] AS next FROM cluster", "cluster"))
def leader_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leader first, whoever has most votes; the others by votes."""
    sides = [F.struct((F.col("Area_ID") % 3 != i).alias("l"), (-F.col(c)).alias("v"), F.lit(i).alias("o"), F.lit(c).alias("s")) for i, c in enumerate(("A1", "B1", "C1"))]
    ordered = F.array_sort(F.array(*sides))
    return cluster(spark, sf_dir).select("Area_ID", ordered[0]["s"].alias("first"), ordered[1]["s"].alias("next"))


@query("s093_union_all", sql("SELECT Shape_ID, Population, NULL::DOUBLE AS Area FROM precinct WHERE Zone % 2 = 0 UNION ALL SELECT Shape_ID, NULL, Area FROM precinct WHERE Zone % 2 = 1", "precinct"))
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All precincts: those of even zones come with their population, the others with their area."""
    rows = precinct(spark, sf_dir)
    return reshape.union_all([rows.filter("Zone % 2 = 0").select("Shape_ID", "Population"), rows.filter("Zone % 2 = 1").select("Shape_ID", "Area")])


@query("s094_set_difference", sql("SELECT Shape_ID, 'only roster' AS part FROM (SELECT Shape_ID FROM precinct EXCEPT SELECT Shape_ID FROM result WHERE Spoil < 3) UNION ALL SELECT Shape_ID, 'both' FROM (SELECT Shape_ID FROM precinct INTERSECT SELECT Shape_ID FROM result WHERE Spoil < 3)", "precinct", "result"))
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = precinct(spark, sf_dir).select("Shape_ID"), result(spark, sf_dir).filter("Spoil < 3").select("Shape_ID")
    return a.exceptAll(b.distinct()).withColumn("part", F.lit("only roster")).unionByName(a.intersect(b).withColumn("part", F.lit("both")))


@query("s094a_melt_and_remainder", sql("SELECT Area_ID, k AS cluster, v, 100 - v AS rest FROM cl", "cluster", more=f"cl AS (UNPIVOT cluster ON {', '.join(CLUSTERS)} INTO NAME k VALUE v)"))
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.remainder(reshape.melt(cluster(spark, sf_dir), ["Area_ID"], list(CLUSTERS), "cluster", "v"), ["v"], "rest")


@query("s094a_pivot", sql(f"SELECT Sector, {', '.join(f'coalesce(CAST(sum(votes) FILTER (list = {chr(39)}{x}{chr(39)}) AS BIGINT), 0) AS {x}' for x in ('L1', 'L2', 'L3', 'L4'))} FROM sector GROUP BY Sector", "sector"))
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["L1", "L2", "L3", "L4"]
    return sector(spark, sf_dir).groupBy("Sector").pivot("list", names).sum("votes").fillna(0, names)


@query("s094b_derived_wide", sql(f"SELECT Area_ID, {', '.join(f'{c} * 2 AS L_{c}, {c} + 1 AS MR_{c}, 100 - {c} AS R_{c}' for c in CLUSTERS)} FROM cluster", "cluster"))
def derived_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.derived_wide(cluster(spark, sf_dir), ["Area_ID"], list(CLUSTERS), {"L": lambda c: c * 2, "MR": lambda c: c + 1, "R": lambda c: 100 - c})


@query("s179_snapshot_diff", sql("SELECT Shape_ID, CASE WHEN Shape_ID % 101 = 0 THEN 'removed' WHEN Shape_ID % 97 = 0 THEN 'changed' END AS change FROM precinct WHERE Shape_ID % 101 = 0 OR Shape_ID % 97 = 0 UNION ALL SELECT -1 - Shape_ID, 'added' FROM precinct WHERE Shape_ID % 101 = 0", "precinct"))
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = precinct(spark, sf_dir)
    new = old.filter("Shape_ID % 101 <> 0").withColumn("Area", F.when(F.col("Shape_ID") % 97 == 0, F.col("Area") + 1).otherwise(F.col("Area")))
    added = old.filter("Shape_ID % 101 = 0").withColumn("Shape_ID", -1 - F.col("Shape_ID"))
    return reshape.snapshot_diff(old, new.unionByName(added), "Shape_ID")


@query("s171_key_uniqueness", sql("SELECT District, Ward, count(*) AS n FROM precinct GROUP BY District, Ward HAVING count(*) > 1", "precinct"))
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated_keys(precinct(spark, sf_dir), ["District", "Ward"])


@query("s170_quota_report", sql("SELECT District, population, quota, CAST(ceil(population / quota) AS BIGINT) AS seats, round(population / ceil(population / quota), 6) AS new_quota, total_wards FROM (SELECT District, CAST(sum(Population) AS BIGINT) AS population, count(DISTINCT Ward) AS total_wards, CASE WHEN sum(Population) <= 400000 THEN 20000 WHEN sum(Population) <= 650000 THEN 23000 WHEN sum(Population) <= 1000000 THEN 24000 ELSE 25000 END AS quota FROM precinct GROUP BY District)", "precinct"))
def quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = precinct(spark, sf_dir).groupBy("District").agg(F.sum("Population").alias("population"), F.count_distinct("Ward").alias("total_wards"))
    rows = sums.withColumn("quota", scores.population_quota("population")).withColumn("seats", F.ceil(F.col("population") / F.col("quota")))
    return rows.select("District", "population", "quota", "seats", F.round(F.col("population") / F.col("seats"), 6).alias("new_quota"), "total_wards")


@query("s145_bound_checks", sql("SELECT count(*) AS n_rows, count(*) FILTER (Turnout > Electorate) AS turnout_over, count(*) FILTER (Left_Left + Left_Right + Left_MR + Right_Left + Right_Right + Right_MR + MR_Left + MR_Right + MR_MR + Spoil <> Turnout) AS sum_off FROM result", "result"))
def bound_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hustings.operators.methods import TRANSFERS

    return checks.violations(result(spark, sf_dir), {"turnout_over": F.col("Turnout") > F.col("Electorate"), "sum_off": num.total([*TRANSFERS, "Spoil"]) != F.col("Turnout")})
