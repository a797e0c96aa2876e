"""The live tally under corrections that come late, twice, out of order and move to other seats, over several runs."""

import datetime
import random

import pyspark.sql.functions as F
import pytest

from hustings.plans import registry
from hustings.streaming import live

SCHEMA = "id long, seat string, at timestamp, votes long"


def test_totals_are_of_the_last_versions(spark, tmp_path):
    r = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    versions = [(r.randrange(40), r.choice("abc"), start + datetime.timedelta(hours=r.randrange(100)), r.randrange(1, 50)) for _ in range(300)]
    versions += r.sample(versions, 40) + [(None, "a", start, 5), (7, "a", None, 5)]
    batches = [versions[i::3] for i in range(3)]
    folder = str(tmp_path)
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        stream = live.read_rows(spark, f"{folder}/in", SCHEMA)
        live.run_totals(live.deltas(stream, "id", ["seat"], {"n": F.lit(1), "votes": F.col("votes")}, "at", "1000 hours", buckets=4), folder, ["seat"])
        last = {}
        for i, seat, at, votes in (v for b in batches[: k + 1] for v in b):
            if i is not None and at is not None and (i not in last or (at, votes, seat) > last[i]):
                last[i] = at, votes, seat
        want = {s: (sum(v[2] == s for v in last.values()), sum(v[1] for v in last.values() if v[2] == s)) for s in "abc"}
        assert {x.seat: (x.n, x.votes) for x in live.totals(spark, folder).collect()} == want


def test_versions_older_than_the_watermark_are_left_out(spark, tmp_path):
    folder = str(tmp_path)
    for rows in ([(1, "a", "2024-03-01", 5)], [(1, "a", "2024-02-29", 9), (2, "a", "2024-02-25", 7), (3, "b", "2024-01-01", 50)]):
        spark.createDataFrame(rows, "id long, seat string, at string, votes long").withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")
        stream = live.read_rows(spark, f"{folder}/in", SCHEMA)
        live.run_totals(live.deltas(stream, "id", ["seat"], {"votes": F.col("votes")}, "at", "10 days", buckets=2), folder, ["seat"])
    assert [tuple(x) for x in live.totals(spark, folder).collect()] == [("a", 12)]


def test_buckets_hold_thousands_of_rows(spark, monkeypatch):
    """A call of Python for each bucket and batch is what the live tally's time goes by."""

    class Found(Exception):
        pass

    def stop(rows, row_id, keys, measures, event_time, delay, buckets):
        raise Found(buckets)

    monkeypatch.setattr(live, "deltas", stop)
    with pytest.raises(Found) as found:
        registry.queries()["s175_live_tally"](spark, "/root/testdata/sf0.01")
    assert found.value.args[0] <= 16  # 15,000 rows
