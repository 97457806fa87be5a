"""File and database sources, and what they read, against the tables they were made from."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F

from siftlake.functions.dims import CATEGORIES
from siftlake.operators.reports import compare, latest_runs
from siftlake.session import table
from siftlake.sources import database, files
from siftlake.streaming import totals

SF = "/root/testdata/sf0.001"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_goals_are_found_below_a_folder(spark, tmp_path):
    goal = lambda u, *k: json.dumps({"pages": [{"url": u, "keywords": list(k), "x": 1}], "y": 2}, indent=1)
    put(tmp_path / "a/goals.json", goal("u1", "one", "two"))
    put(tmp_path / "a/b/site-goals.json", goal("u2", "thrée"))
    put(tmp_path / "a/b/other.json", goal("u3", "not taken"))
    put(tmp_path / "c/goals.json", goal("u4", "cut")[:-9])
    put(tmp_path / "d/goals.json", " \n")
    put(tmp_path / "f/goals.json", "")
    put(tmp_path / "e/goals.json", "[]")
    assert {tuple(r) for r in files.goals(spark, str(tmp_path)).collect()} == {("u1", "one"), ("u1", "two"), ("u2", "thrée")}
    found = files.json_files(spark, str(tmp_path), "*goals.json")
    assert sorted(r["path"].split("/")[-2] for r in files.broken(found).collect()) == ["c", "d"] and found.count() == 5
    assert files.goals(spark, str(tmp_path), "none.json").count() == 0


def test_baseline_files(spark, tmp_path):
    page = lambda u, s: {"url": u, "scores": dict.fromkeys(CATEGORIES, s), "findings": [{"rule_id": "r"}]}
    put(tmp_path / "one.json", json.dumps(page("u1", 1)))
    put(tmp_path / "x/list.json", json.dumps([page("u2", 2), page("u3", 3)], indent=2))
    put(tmp_path / "x/bad.json", "{")
    assert sorted((r["url"], r["seo"], len(r["findings"])) for r in files.baselines(spark, str(tmp_path)).collect()) == [("u1", 1, 1), ("u2", 2, 1), ("u3", 3, 1)]


def test_logs_are_followed_from_where_they_were_left(spark, tmp_path):
    line = lambda i: json.dumps({"type": "page", "url": f"u{i}", "status": 200})
    put(tmp_path / "in/a/1.log", "\n".join([line(1), "broken {", line(2)]))
    put(tmp_path / "in/2.log", line(3) + "\n" + json.dumps({"type": "odd"}) + "\n\n")
    put(tmp_path / "in/2.txt", line(9))
    follow = lambda: sorted(r["url"] for r in files.follow(totals.parsed_events(files.line_stream(spark, str(tmp_path / "in"), max_files=1)), str(tmp_path / "out")).collect())
    assert follow() == ["u1", "u2", "u3"]
    assert follow() == ["u1", "u2", "u3"]
    put(tmp_path / "in/b/3.log", line(4))
    assert follow() == ["u1", "u2", "u3", "u4"]


def test_json_files_as_a_stream(spark, tmp_path):
    put(tmp_path / "in/a.json", '{"a":\n1}')
    put(tmp_path / "in/b/c.json", "no")
    follow = lambda: files.follow(files.json_file_stream(spark, str(tmp_path / "in"), max_files=1), str(tmp_path / "out"))
    assert sorted((r["body"], r["is_json"]) for r in follow().collect()) == [("no", False), ('{"a":\n1}', True)]
    put(tmp_path / "in/d.json", "[]")
    assert follow().count() == 3


@pytest.mark.parametrize("column", ["event_id", "ts"])
def test_run_history_from_a_database(spark, column):
    url = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true"
    at = F.col("ts").cast("timestamp").alias("ts")
    runs = table(spark, SF, "events").select("event_id", "user_id", at, F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("s"), "event_id")).alias("scores"))
    late = spark.createDataFrame([(-5, None, None, "x")], runs.schema)
    runs = runs.unionByName(late)
    runs.write.format("jdbc").options(url=url, dbtable="runs").save()
    read = database.read_table(spark, url, "runs", column, 4)
    assert read.rdd.getNumPartitions() == 4 and read.count() == runs.count()
    sizes = [n for n in read.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 0.5 * runs.count()
    some = read.filter("user_id = 8").select("event_id", "user_id")
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,8)" in scan and "scores" not in scan.split("ReadSchema")[1]
    history = lambda df: sorted(map(str, latest_runs(df, "user_id", "ts", 20, "event_id", "scores").drop("scores").collect()))
    got, want = history(read.select(*runs.columns)), history(runs)
    assert got == want and any("scores_json='null'" in r for r in got)


def test_empty_database_table(spark):
    url = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true"
    spark.createDataFrame([], "k long, t timestamp").write.format("jdbc").options(url=url, dbtable="empty").save()
    assert database.read_table(spark, url, "empty", "k", 3).count() == 0
    with pytest.raises(ValueError):
        database.read_table(spark, url, "empty", "k", 0)


def test_latest_runs_without_scores(spark):
    rows = [("a", datetime.datetime(2024, 1, 1), '{"seo":1}'), ("a", datetime.datetime(2024, 1, 2), None)]
    out = latest_runs(spark.createDataFrame(rows, "k string, at timestamp, scores string"), "k", "at", scores="scores").collect()
    assert {r["rank"]: r["scores_json"] for r in out} == {1: "null", 2: '{"seo":1}'}


def test_compare_has_a_row_of_technologies(spark):
    schema = "page string, " + ", ".join(f"{c} int" for c in CATEGORIES) + ", findings array<struct<severity:string>>, builtwith array<string>"
    rows = [(p, *range(7), [], b) for p, b in (("p.1", ["x", "y"]), ("p.2", []), ("p.3", None), ("p.4", None))]
    df = spark.createDataFrame(rows, schema)
    line = lambda *pages: [tuple(r)[1:] for r in compare(df, "page", list(pages)).filter("category = 'tech stack'").collect()]
    assert line("p.3", "p.1", "p.2") == [("—", "2 detected", "0 detected")] and line("p.3", "p.4") == []
    assert compare(df.drop("builtwith"), "page", ["p.1"]).count() == 8
