"""Of joins with exploded tables only the small side is sent to all machines."""

import pytest
from pyspark.sql import functions as F

from helpbooks.operators import navigation, search, sides


def sent(df):
    """Rows of all broadcasts of a query, after it has run."""
    rows = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name == "BroadcastExchangeExec":
            rows.append(plan.metrics().apply("numOutputRows").value())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(rows)


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names") / "t")
    spark.range(2000).select(F.col("id").alias("at"), F.concat(F.lit("name"), F.hex(F.col("id") * 2_654_435_761)).alias("name")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("most", [sides.MOST_SENT, 0])
def test_pieces_of_names_stay_where_they_are(spark, names, monkeypatch, most):
    monkeypatch.setattr(sides, "MOST_SENT", most)
    needles = ["me1", "ff", "nam", "no such", "AA9"]
    df = navigation.substring_matches(names, "name", spark.createDataFrame([(n,) for n in needles], "needle string"))
    got = sorted((r["at"], r["needle"]) for r in df.collect())
    assert got == sorted((r["at"], n) for r in names.collect() for n in needles if n in r["name"]) and got
    assert sent(df) < 100


@pytest.mark.parametrize("most", [sides.MOST_SENT, 0])
def test_entries_met_by_queries_stay_where_they_are(spark, names, monkeypatch, most):
    monkeypatch.setattr(sides, "MOST_SENT", most)
    entries = names.select(F.lit("b").alias("book_id"), F.col("at").cast("string").alias("entry_id"), "name")
    asked = [(1, "me1"), (2, "ME1"), (3, " "), (4, "no such"), (5, "ff")]
    df = navigation.filtered_by_queries(entries, spark.createDataFrame(asked, "query_id long, q string"))
    got = sorted((r["query_id"], int(r["entry_id"])) for r in df.collect())
    assert got == sorted((i, r["at"]) for r in names.collect() for i, q in asked if not q.strip() or q.lower() in r["name"].lower())
    assert sent(df) < 100


@pytest.mark.parametrize("most", [sides.MOST_SENT, 0])
@pytest.mark.parametrize("match", [search.edge_matches, search.prefix_matches, search.fuzzy_matches])
def test_beginnings_of_terms_stay_where_they_are(spark, names, monkeypatch, most, match):
    monkeypatch.setattr(sides, "MOST_SENT", most)
    terms, first = names.select(F.col("name").alias("term")), names.filter("at = 7").first()["name"]
    tokens = spark.createDataFrame([("name1",), ("name2a",), (first,)], "token string")
    df = match(terms, tokens)
    got = {(r["token"], r["term"]) for r in df.collect()}
    assert (first, first) in got
    if match is not search.fuzzy_matches:
        assert got == {(t, r["name"]) for r in names.collect() for t in ("name1", "name2a", first) if r["name"].startswith(t)}
    assert sent(df) < 100
