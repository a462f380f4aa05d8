import os

import pytest
from pyspark.sql import functions as F

from rawharbor.plans.ingest import PayloadRejected, Request, ingest, ingest_all
from rawharbor.plans.layout import dataset_dir, write_description, write_raw_batch
from rawharbor.plans.publish import export, publish
from rawharbor.plans.requests import plan_requests
from rawharbor.session import shared_dir
from rawharbor.sources import delimited
from rawharbor.sources.registry import registry_table


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id int, sources string, topic string")


def test_plan(spark):
    rows = [(1, "all, SEC", "Anime Sales"), (2, None, " "), (3, "sec", "board GAMES"), (4, "gopher,yfinance", "AMZN stock!")]
    plan = plan_requests(requests(spark, rows), registry_table(spark))
    got = [tuple(r) for r in plan.orderBy("request_id", "position").collect()]
    assert got == [
        (1, 0, "kaggle", "Anime Sales", True, "planned", "kaggle", "anime_sales", "anime_sales_raw.csv"),
        (1, 1, "openml", "Anime Sales", True, "planned", "openml", "anime_sales", "anime_sales_raw.csv"),
        (1, 2, "sec", "Anime Sales", True, "planned", "sec", "anime_sales", "anime_sales_raw.csv"),
        (2, 0, "kaggle", "finance", False, "planned", "kaggle", "finance", "finance_raw.csv"),
        (3, 0, "sec", "board GAMES", True, "planned", "sec", "board_games", "board_games_raw.csv"),
        (4, 0, "gopher", "AMZN stock!", False, "unknown source", None, "amzn_stock_", "amzn_stock_raw.csv"),
        (4, 1, "yfinance", "AMZN stock!", False, "planned", "yahoofinance", "amzn_stock_", "amzn_stock_raw.csv"),
    ]
    dropped = plan_requests(requests(spark, rows), registry_table(spark), drop_unrelated=True)
    assert {(r["request_id"], r["source"]) for r in dropped.where("warned").collect()} == {
        (1, "kaggle"), (1, "openml"), (3, "kaggle")
    }


@pytest.fixture
def listings(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text("id,price\n" + "".join(f"{i},${i}.00\n" for i in range(100)))
    (path / "small.csv").write_text("id\n1\n")
    return str(path)


def test_ingest_writes_csv_and_description(spark, listings, tmp_path):
    request = Request("Kaggle", "City Prices 2024!", listings, row_limit=10, order_by=["id"])
    path = ingest(spark, request, str(tmp_path / "out"))
    assert path == str(tmp_path / "out/datasets/kaggle/CSV/city_prices_2024_/city_prices_2024_raw.csv")
    back = delimited.scan_csv_inferred(spark, path)
    assert back.columns == ["id", "price"] and back.count() == 10 and back.agg(F.max("id")).first()[0] == 9
    text = spark.read.text(os.path.join(os.path.dirname(path), "dataset_description"), wholetext=True).first()[0]
    assert text.startswith("Dataset Topic: City Prices 2024!\nTotal Rows: 10\nTotal Columns: 2\n")


def test_limit_is_applied_before_the_gate(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a,b,c,d,e\n" + "1,,,,,\n" * 3 + "2,1,1,1,1,1\n" * 30)
    ingest(spark, Request("kaggle", "t", str(tmp_path)), str(tmp_path / "all"))
    with pytest.raises(PayloadRejected, match=r"exceeds 80% \(83.33%\)"):
        ingest(spark, Request("kaggle", "t", str(tmp_path), row_limit=3, order_by=["id"]), str(tmp_path / "cut"))
    assert not os.path.exists(tmp_path / "cut")


def test_batch_survives_failures(spark, listings, tmp_path):
    (tmp_path / "none").mkdir()
    good = Request("kaggle", "good", listings)
    bad = [Request("gopher", "x", listings), Request("kaggle", "x", str(tmp_path / "none"))]
    results = ingest_all(spark, [bad[0], good, bad[1]], str(tmp_path / "out"))
    assert [r.status for r in results] == ["failed", "passed", "failed"]
    assert "gopher" in results[0].message
    with pytest.raises(ValueError, match="gopher"):
        ingest_all(spark, bad, str(tmp_path / "out"))


def test_json_sources(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"observations": [\n{"date": "2024-01-01", "value": "."}]}')
    (tmp_path / "f.json").write_text('{"facts":{"t":{"c":{"units":{"U":[{"val":1}]}}}}}')
    (tmp_path / "e.json").write_text('{"facts":{}}')
    out = str(tmp_path / "out")
    series = delimited.scan_csv(spark, ingest(spark, Request("fred", "GDP", str(tmp_path / "o.json")), out))
    assert [tuple(r) for r in series.collect()] == [("2024-01-01", ".")]
    assert delimited.scan_csv(spark, ingest(spark, Request("sec", "AAPL", str(tmp_path / "f.json")), out)).count() == 1
    with pytest.raises(ValueError, match="no facts"):
        ingest(spark, Request("sec", "AAPL", str(tmp_path / "e.json")), out)


def test_target_source(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([(2, 9)], "k int, y int").write.parquet(str(tmp_path / "y"))
    options = {"target_path": str(tmp_path / "y"), "key": "k", "target": "y"}
    path = ingest(spark, Request("openml", "iris", str(tmp_path / "x"), options), str(tmp_path / "out"))
    assert {tuple(r) for r in delimited.scan_csv(spark, path).collect()} == {("1", "a", None), ("2", "b", "9")}


def test_batch_layout_leaves_other_datasets_alone(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = [("https://www.A.com/x", "Topic One!", 1, None), ("b", "two", 2, "y")]
    df = spark.createDataFrame(rows, "host string, what string, v int, w string")
    write_raw_batch(df, root, "host", "what")
    write_raw_batch(df.where("host = 'b'").withColumn("v", F.lit(5)), root, "host", "what")
    assert os.path.isdir(f"{root}/source=a.com/format=CSV/topic=topic_one_")
    got = {tuple(r) for r in delimited.scan_csv(spark, root).collect()}
    assert got == {("1", None, "a.com", "CSV", "topic_one_"), ("5", "y", "b", "CSV", "two")}
    with pytest.raises(ValueError, match="topic"):
        write_raw_batch(df.withColumn("topic", F.lit(1)), root, "host", "what")


def test_descriptions_per_dataset(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "d string, v int, w string")
    write_description(df, str(tmp_path / "text"), "T", ["d"])
    got = {r["d"]: r["value"] for r in spark.read.text(str(tmp_path / "text"), wholetext=True).collect()}
    assert got["a"].endswith("- v (Nulls: 0)\n- w (Nulls: 1)\n") and "Total Rows: 1" in got["b"]


def test_publish(spark, tmp_path):
    source = tmp_path / "sales_raw.csv"
    source.mkdir()
    (source / "1.csv").write_text("col1,col2\n1,\n2,\n3,\n")
    result = publish(spark, str(source), ["col1"])
    assert result["table"] == "sales" and result["sheets"] == 1
    assert [tuple(r) for r in spark.table("sales").orderBy("col1").collect()] == [(1, None), (2, None), (3, None)]
    widths = delimited.scan_csv(spark, os.path.join(result["export"], "widths")).collect()
    assert {r["column"]: r["width"] for r in widths} == {"col1": "6", "col2": "6"}
    (source / "1.csv").write_text("col1,col2\n9,x\n")
    publish(spark, str(source), ["col1"])
    spark.catalog.refreshTable("sales")
    assert [tuple(r) for r in spark.table("sales").collect()] == [(9, "x")]


def test_publish_names_and_errors(spark, tmp_path):
    source = tmp_path / ("a" * 40 + "_raw.csv")
    source.write_text("col1\n1\n")
    result = publish(spark, str(source), ["col1"])
    assert (result["table"], result["sheet"]) == ("a" * 40, "a" * 31)
    (tmp_path / "empty_raw.csv").write_text("col1\n")
    with pytest.raises(ValueError, match="empty"):
        publish(spark, str(tmp_path / "empty_raw.csv"), ["col1"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        publish(spark, str(tmp_path / "no_raw.csv"), ["col1"])


def test_export_is_one_sorted_file(spark, tmp_path):
    assert export(spark.range(50).repartition(4), str(tmp_path / "x"), ["id"], cap=20)
    files = [f for f in os.listdir(tmp_path / "x/rows") if f.endswith(".csv")]
    assert len(files) == 1
    assert (tmp_path / "x/rows" / files[0]).read_text().split() == ["id", *map(str, range(20))]


def test_dataset_dir():
    assert dataset_dir("/o", "sec", "A & B") == "/o/datasets/sec/CSV/a_b"


def test_scratch_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
