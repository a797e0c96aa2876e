"""Queries that go through files and streams: tables are written to the shared folder and read back."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from hustings.operators import checks
from hustings.operators.methods import TRANSFERS
from hustings.plans.adapters import cell, located, precinct, sector, sql
from hustings.plans.registry import query
from hustings.plans.tally_queries import CERTAINTY_SQL, SV_SQL
from hustings.shared import materialize, new_folder
from hustings.sources import files
from hustings.streaming import live


@query(
    "s001_csv_scan",
    sql("SELECT CASE WHEN id % 5 <> 0 THEN CAST(id AS VARCHAR) END AS id, CASE WHEN id % 5 NOT IN (0, 1, 2) THEN 'a \"quoted\", text' || chr(10) || grp WHEN id % 5 = 2 THEN grp END AS note, CASE WHEN id % 5 = 2 THEN 'x' END AS more FROM cell", "cell"),
)
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of rows with commas, quotes and newlines in cells, blank rows, short rows, LF and CRLF, read as a table."""
    path = new_folder(spark)
    kind = F.col("id") % 5
    quoted = F.concat("id", F.lit(',"a ""quoted"", text\n'), "grp", F.lit('"'))
    line = F.when(kind == 0, "").when(kind == 1, F.col("id").cast("string")).when(kind == 2, F.concat("id", F.lit(","), "grp", F.lit(",x\r"))).otherwise(quoted)
    # files of about 100 rows, each with its header
    texts = cell(spark, sf_dir).groupBy(F.floor(F.col("id") / 100).alias("part")).agg(F.concat_ws("\n", F.lit("id,note,more\r"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n")).alias("value"))
    texts.repartition("part").select("value", "part").write.partitionBy("part").text(path)
    return files.read_csv(spark, f"{path}/part=*", required=["id", "note"])


@query("s008_csv_sink", sql("SELECT Shape_ID, Region, Population FROM precinct", "precinct"))
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    files.write_csv(precinct(spark, sf_dir).select("Shape_ID", "Region", "Population"), path)
    return files.read_csv(spark, path, "Shape_ID bigint, Region string, Population bigint")


@query("s002_directory_of_tables", sql("SELECT 'counties' AS name, CAST(count(DISTINCT County) AS BIGINT) AS n FROM precinct UNION ALL SELECT 'zones', count(DISTINCT Zone) FROM precinct", "precinct"))
def directory_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets of a report (10), read back as a folder of tables (2)."""
    path = new_folder(spark)
    rows = precinct(spark, sf_dir)
    files.write_report({"counties.csv": rows.groupBy("County").count(), "zones.csv": rows.groupBy("Zone").count()}, path)
    tables = files.read_directory(spark, path)
    parts = [df.select(F.lit(name).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    return parts[0].unionByName(parts[1])


@query("s010_report_sink", sql("SELECT 'county' AS sheet, CAST(County AS VARCHAR) AS key, CAST(CAST(sum(Population) AS BIGINT) AS VARCHAR) AS population FROM precinct GROUP BY County UNION ALL SELECT 'zone', CAST(Zone AS VARCHAR), CAST(CAST(sum(Population) AS BIGINT) AS VARCHAR) FROM precinct GROUP BY Zone", "precinct"))
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of two sheets, counties and zones, each a folder of CSV; read back sheet by sheet."""
    path = new_folder(spark)
    sums = precinct(spark, sf_dir).groupBy("County", "Zone").agg(F.sum("Population").alias("population"))
    sheet = lambda key: sums.groupBy(F.col(key).alias("key")).agg(F.sum("population").alias("population"))
    files.write_report({"county": sheet("County"), "zone": sheet("Zone")}, path)
    parts = [files.read_csv(spark, f"{path}/{name}", multi_line=False).select(F.lit(name).alias("sheet"), "key", "population") for name in ("county", "zone")]
    return parts[0].unionByName(parts[1])


@query("s003_manifest_lists", sql("SELECT DISTINCT 'GeneralProportional' AS seat_type, list, party FROM sector", "sector"))
def manifest_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested manifest, made of the sectors' lists, written as JSON and read with its schema (3, 118)."""
    path = new_folder(spark)
    lists = sector(spark, sf_dir).groupBy("list").agg(F.sort_array(F.collect_set("party")).alias("parties"))
    packed = lists.agg(F.sort_array(F.collect_list(F.struct(F.col("list").alias("id"), "parties"))).alias("lists"))
    seat = F.struct(F.lit("GeneralProportional").alias("id"), F.lit("sectors.csv").alias("results_file"), F.lit(15.0).alias("threshold_pct"), "lists")
    packed.select(F.lit("e1").alias("election_id"), F.array(seat).alias("seat_types")).write.json(path)
    return files.parties_of_lists(files.read_manifest(spark, path))


@query("s004_manifest_resolution", sql("SELECT CAST(Sector AS VARCHAR) AS Sector, party, CAST(votes AS VARCHAR) AS votes FROM sector", "sector"))
def manifest_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results file of a seat type is found through the manifest."""
    path = new_folder(spark)
    files.write_csv(sector(spark, sf_dir).select("Sector", "party", "votes"), f"{path}/sectors.csv")
    files.write_manifest(spark, {"election_id": "e1", "seat_types": [{"id": "GeneralProportional", "results_file": "sectors.csv", "lists": []}]}, f"{path}/meta.json")
    return files.results_of(spark, files.read_manifest(spark, f"{path}/meta.json"), "GeneralProportional", path)


@query("s005_required_columns", sql("SELECT Shape_ID, County, Area FROM precinct", "precinct"))
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.require_columns(precinct(spark, sf_dir), ["Shape_ID", "County", "Area"], "precinct").select("Shape_ID", "County", "Area")


#: When rows come: all versions up to each of these moments in one go. The rows of a tenth all come after the others.
_ARRIVALS = ("1996-12-31", "1999-06-30", "9999-12-31")
_DELAY_DAYS = 30
#: Files of one arrival; a batch takes as many.
_FILES = 4
_LIVE = ["n_rows", "n_declared", "Electorate", "Turnout", "Spoil", *TRANSFERS, "undecided"]


def _versions(rows: DataFrame) -> DataFrame:
    """Each row as it was received, verified and declared, with ``at`` and ``status``; a third of the declared rows are corrected ten days later:
    five more votes, and some of them belong to another seat."""
    amended = F.col("Result_ID") % 3 == 0
    kinds = [("received_at", "Verifying", 0), ("verified_at", "Counting", 0), ("declared_at", "Declared", 0), ("declared_at", "Declared", 10)]
    made = [F.struct((F.col(c) + F.expr(f"INTERVAL {days} DAYS")).alias("at"), F.lit(s).alias("status"), F.lit(5 if days else 0).alias("more"), F.when(amended | (F.lit(days) == 0), True).alias("real")) for c, s, days in kinds]
    each = rows.select("*", F.inline(F.array(*made))).filter("at is not null and real")
    moved = (F.col("more") > 0) & (F.col("Result_ID") % 2 == 0)
    return each.withColumns({"Left_Left": F.col("Left_Left") + F.col("more"), "Turnout": F.col("Turnout") + F.col("more"), "Constituency": F.when(moved, (F.col("Constituency") + 1) % 10).otherwise(F.col("Constituency"))}).drop("more", "real")


_VERSIONS_SQL = f"""v AS (SELECT * REPLACE (Left_Left + more AS Left_Left, Turnout + more AS Turnout, CASE WHEN more > 0 AND Result_ID % 2 = 0 THEN (Constituency + 1) % 10 ELSE Constituency END AS Constituency) FROM (
   SELECT *, received_at AS moment, 'Verifying' AS status, 0 AS more FROM located UNION ALL SELECT *, verified_at, 'Counting', 0 FROM located UNION ALL SELECT *, declared_at, 'Declared', 0 FROM located
   UNION ALL SELECT *, declared_at + INTERVAL 10 DAY, 'Declared', 5 FROM located WHERE Result_ID % 3 = 0) WHERE moment IS NOT NULL),
 came AS (SELECT * FROM v WHERE Result_ID % 10 <> 1 OR moment > (SELECT max(moment) FROM v WHERE Result_ID % 10 <> 1) - INTERVAL {_DELAY_DAYS} DAY),
 lastv AS (SELECT * FROM came QUALIFY row_number() OVER (PARTITION BY Result_ID ORDER BY moment DESC) = 1)"""


@query(
    "s175_live_tally",
    sql(
        f"SELECT Constituency, {', '.join(_LIVE)}, winner, stage, result_certain, certain_winner FROM certain",
        "located",
        more=f"""{_VERSIONS_SQL}, tot AS (SELECT Constituency, sum(Electorate) AS e FROM located GROUP BY Constituency),
 live AS (SELECT Constituency, count(*) AS n_rows, count(*) FILTER (status = 'Declared') AS n_declared, CAST(sum(Electorate) AS BIGINT) AS Electorate, CAST(coalesce(sum(Turnout) FILTER (status IN ('Counting', 'Declared')), 0) AS BIGINT) AS Turnout,
   CAST(sum(CASE status WHEN 'Declared' THEN 0 WHEN 'Counting' THEN Turnout ELSE Electorate END) AS BIGINT) AS pool, {', '.join(f"CAST(coalesce(sum({c}) FILTER (status = 'Declared'), 0) AS BIGINT) AS {c}" for c in (*TRANSFERS, 'Spoil'))} FROM lastv GROUP BY Constituency),
 sums AS (SELECT live.* EXCLUDE (pool), CAST(pool + greatest(0, e - Electorate) AS BIGINT) AS undecided FROM live JOIN tot USING (Constituency)), {SV_SQL}, {CERTAINTY_SQL}""",
    ),
)
def live_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows come as received, counting, declared and corrected, some twice and some too late; the totals are the tally of each row's last version."""
    folder = new_folder(spark)
    rows = materialize(_versions(located(spark, sf_dir).select("Result_ID", "Constituency", "Electorate", "Turnout", "Spoil", *TRANSFERS, "received_at", "verified_at", "declared_at")).drop("received_at", "verified_at", "declared_at"))
    # every row is received, and then in the seat where it belongs at first
    roster = materialize(rows.filter("status = 'Verifying'").groupBy("Constituency").agg(F.sum("Electorate").alias("all_electorate"), F.count(F.lit(1)).alias("n")))
    late = F.col("Result_ID") % 10 == 1
    upto = "0001-01-01"
    for moment in (*_ARRIVALS, None):
        if moment is None:
            part = rows.filter(late)
        else:
            fresh = rows.filter(~late & (F.col("at") > F.lit(upto).cast("timestamp")) & (F.col("at") <= F.lit(moment).cast("timestamp")))
            part, upto = fresh.unionByName(fresh.filter("Result_ID % 10 = 2")), moment
        part.repartition(_FILES).write.mode("append").parquet(f"{folder}/in")
    stream = live.read_rows(spark, f"{folder}/in", rows.schema, _FILES)
    buckets = max(16, roster.agg(F.sum("n")).first()[0] // 4000)
    live.run_totals(live.deltas(stream, "Result_ID", ["Constituency"], live.seat_measures(), "at", f"{_DELAY_DAYS} days", buckets), folder, ["Constituency"])
    return live.decided(live.totals(spark, folder), roster.drop("n"), ["Constituency"]).select("Constituency", *_LIVE, "winner", "stage", "result_certain", "certain_winner")


@query("s176_streamed_declarations", sql("SELECT time_bucket(INTERVAL 1 DAY, declared_at) AS day, count(*) AS n FROM located WHERE declared_at IS NOT NULL GROUP BY 1", "located"))
def streamed_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations come in order of time; a day's state goes once the watermark has passed it."""
    folder = new_folder(spark)
    rows = located(spark, sf_dir).select("Result_ID", "declared_at")
    upto = "0001-01-01"
    for moment in _ARRIVALS:
        rows.filter((F.col("declared_at") > F.lit(upto).cast("timestamp")) & (F.col("declared_at") <= F.lit(moment).cast("timestamp"))).write.mode("append").parquet(f"{folder}/in")
        upto = moment
        out = live.run_available(live.declarations_per(live.read_rows(spark, f"{folder}/in", rows.schema), "1 day", delay="2 days"), folder)
    return live.latest(spark, out, ["window"]).select(F.col("window.start").alias("day"), "n")
