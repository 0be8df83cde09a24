"""Every registered query runs; those with SQL give what DuckDB gives."""

import math
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from helpbooks.jobs.registry import ORACLES, QUERIES
from helpbooks.operators import search
from helpbooks.operators.clickstream import replayed
from helpbooks.schemas import NAV_STATES, PAGES_TEXT
from helpbooks.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    where = [[c[0] for c in want.description].index(c) for c in columns]
    rows = ordered([r[c] for c in columns] for r in got.collect())
    assert rows and rows == ordered([r[i] for i in where] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_history_over_several_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(4)}", 1_700_000_000 + k * 7 + rng.randrange(40), k, rng.choice(["navigate", "navigate", "back", "forward"]), f"chm://b/{rng.randrange(5)}.htm") for k in range(400)]
    log = spark.createDataFrame(rows, "session_id string, at long, seq long, action string, url string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    for k in range(8):  # later files hold some earlier events
        log.filter(F.col("seq").between(50 * k, 50 * k + 49)).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
        time.sleep(0.05)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = streams.replay(arriving).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert out.lastProgress["batchId"] >= 7
    got = spark.read.schema(NAV_STATES).parquet(str(tmp_path / "out")).collect()
    end = max(r[1] for r in rows) - 60
    want = [r for r in replayed(log).collect() if r.ts.timestamp() < end]
    assert len(want) > 300 and sorted(map(str, got)) == sorted(map(str, want))


def test_idle_readers_leave_no_state(spark, tmp_path):
    hour = 3600
    batches = [[("a", 0, 0, "navigate", "chm://b/1.htm"), ("a", 5, 1, "navigate", "chm://b/2.htm")], [("b", 3 * hour, 2, "navigate", "chm://b/9.htm")], [("b", 3 * hour + 300, 3, "back", None), ("a", 3 * hour + 301, 4, "back", None)], [("c", 9 * hour, 5, "navigate", "chm://b/5.htm")], [("c", 19 * hour, 6, "forward", None)]]
    for k, rows in enumerate(batches):
        log = spark.createDataFrame(rows, "session_id string, at long, seq long, action string, url string").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)).drop("at")
        log.coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
        time.sleep(0.05)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = streams.replay(arriving, idle_ms=hour * 1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = {r.seq: (r.current_url, r.can_back) for r in spark.read.schema(NAV_STATES).parquet(str(tmp_path / "out")).collect()}
    assert got[1] == ("chm://b/2.htm", True) and got[4] == (None, False)  # two hours later nothing is left to go back to
    assert got[3] == ("chm://b/9.htm", False) and set(got) == {0, 1, 2, 3, 4, 5}


def test_pages_that_come_again(spark, tmp_path):
    folder, one = str(tmp_path / "index"), [("b", "/x.htm", "X", "rain gauge"), ("b", "/y.htm", "Y", "frost")]
    batches = [one, one, [("b", "/x.htm", "X", "snow")], [("b", "/x.htm", "X", "rain gauge"), ("b", "/z.htm", "Z", "")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, PAGES_TEXT).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
        arriving = spark.readStream.schema(PAGES_TEXT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        streams.index_pages(arriving, folder, str(tmp_path / "state")).start().awaitTermination()
        latest = {r[1]: r for batch in batches[: k + 1] for r in batch}
        want = search.postings(spark.createDataFrame(list(latest.values()), PAGES_TEXT))
        assert sorted(streams.current_postings(spark, folder).collect()) == sorted(want.collect())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
